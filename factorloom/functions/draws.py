"""Uniform numbers from a counter, and sampling by inverse distribution function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on seed and parts only, not on how rows are partitioned."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def draw_boolean(u: Column, pot0: Column, pot1: Column) -> Column:
    """1 with the probability 1 / (1 + exp(pot0 - pot1))."""
    return F.when(u * (1.0 + F.exp(pot0 - pot1)) < 1.0, 1).otherwise(0).cast("bigint")


def softmax(potentials: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds prob to rows (vid, dense, pot), stable for large potentials."""
    by = by or ["vid"]
    one = Window.partitionBy(*by)
    shifted = potentials.withColumn("_e", F.exp(F.col("pot") - F.max("pot").over(one)))
    return shifted.withColumn("prob", F.col("_e") / F.sum("_e").over(one)).drop("_e")


def draw_by_cdf(rows: DataFrame, prob: str, u: Column, fallback: str = "last", by: list[str] | None = None) -> DataFrame:
    """(*by, dense): the first value in dense order whose running sum of prob reaches u.

    Where rounding or missing mass leaves none, the last value ("last") or value 0 ("zero").
    """
    by = by or ["vid"]
    running = Window.partitionBy(*by).orderBy("dense").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.sum(prob).over(running)).withColumn("_u", u)
    chosen = F.min(F.when(F.col("_c") >= F.col("_u"), F.col("dense")))
    other = F.max("dense") if fallback == "last" else F.lit(0)
    return rows.groupBy(*by).agg(F.coalesce(chosen, other).cast("bigint").alias("dense"))
