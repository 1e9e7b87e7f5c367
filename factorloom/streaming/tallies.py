"""Tallies of Gibbs runs that are still going, as a structured stream.

Such jobs drop files of (vid, dense, n) and (vid, n) rows; the running sums are what merging the
tallies of finished copies gives in a batch, so marginals can be read while drawing goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TALLIES = "vid bigint, dense bigint, n bigint"


def stream_tallies(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the tally files that arrive under a folder."""
    return spark.readStream.schema(TALLIES).parquet(path)


def running_tallies(stream: DataFrame) -> DataFrame:
    """(vid, dense, n) summed over all that has arrived; partial sums are made in each task."""
    return stream.groupBy("vid", "dense").agg(F.sum("n").alias("n"))


def running_marginals(stream: DataFrame) -> DataFrame:
    """(vid, prob): share of value 1 among the samples of each boolean so far, from tallies of both values."""
    one = F.sum(F.when(F.col("dense") == 1, F.col("n")).otherwise(0))
    return stream.groupBy("vid").agg((one / F.sum("n")).alias("prob"))
