"""Session helpers: the shared scratch folder, materialised intermediates and table reading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_made: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a temporary folder is made, one for
    each application.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        name = spark.sparkContext.applicationId
        found = _made.get(name) or _made.setdefault(name, tempfile.mkdtemp(prefix="factorloom-"))
    return found.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries built and run inside leave no shuffle files behind; for results that are collected and small."""
    flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(flag, None)
    spark.conf.set(flag, "true")
    try:
        yield
    finally:
        spark.conf.set(flag, before) if before is not None else spark.conf.unset(flag)


class Scratch:
    """Tables written once under the shared folder and read back, so lineage ends there.

    A lost executor then costs a reread of a shared file rather than a rerun of what made it.
    `drop` deletes a table that later steps no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        df.write.parquet(path)
        kept = self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
        kept._factorloom_path = path
        return kept

    def drop(self, df: DataFrame) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._factorloom_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or with underscores before it until no column of df (any case) has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
