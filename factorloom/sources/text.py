"""Tab-separated graph files: readers and writers as native expressions over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.schema import FUNCTIONS
from factorloom.session import Scratch


def number(text: Column, kind: str = "bigint") -> Column:
    """The number that a field starts with; 0 where it starts with none."""
    start = F.regexp_extract(text, r"^\s*([+-]?\d+)" if kind == "bigint" else r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(start != "", start.cast(kind)).otherwise(F.lit(0).cast(kind))


def array_fields(text: Column, kind: str = "bigint") -> Column:
    """Items of {a,b,...}; anything else is an error, {} is empty."""
    inner = F.regexp_extract(text, r"^\s*\{(.*)\}\s*$", 1)
    items = F.transform(F.split(inner, ","), lambda x: number(x, kind))
    bad = F.raise_error(F.concat(F.lit("not an array: "), text)).cast(f"array<{kind}>")
    return F.when(~text.rlike(r"^\s*\{.*\}\s*$"), bad).when(F.trim(inner) == "", F.array().cast(f"array<{kind}>")).otherwise(items)


def dense_ids(df: DataFrame, name: str) -> DataFrame:
    """Adds 0 .. n-1 in the order of partitions and rows. Only a count per partition is put together."""
    kept = Scratch(df.sparkSession, "ids").keep(df.withColumn("_at", F.monotonically_increasing_id()))
    kept = kept.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ahead = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    return kept.join(ahead, "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_ahead")).drop("_at", "_part", "_first", "_ahead")


def _fields(spark: SparkSession, paths, pattern: str) -> DataFrame:
    lines = spark.read.text(paths).where(F.trim("value") != "")
    return lines.select(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), pattern).alias("f"))


def parse_meta(lines: DataFrame) -> DataFrame:
    """Four counts from each line; what follows them is ignored."""
    names = ("num_weights", "num_variables", "num_factors", "num_edges")
    first = lines.select(F.split(F.split("value", "\n")[0], ",").alias("f"))
    return first.select(*[number(F.get("f", F.lit(i))).alias(n) for i, n in enumerate(names)])


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """The counts of a one-line file."""
    return parse_meta(spark.read.text(path, wholetext=True))


def read_weights(spark: SparkSession, paths) -> DataFrame:
    f = _fields(spark, paths, r"\s+")
    return f.select(number(F.col("f")[0]).alias("wid"), (number(F.col("f")[1]) != 0).alias("is_fixed"), number(F.col("f")[2], "double").alias("init_value"))


def read_variables(spark: SparkSession, paths) -> DataFrame:
    f = _fields(spark, paths, r"\s+")
    kinds = (("vid", "bigint"), ("role", "tinyint"), ("init_value", "bigint"), ("dtype", "smallint"), ("cardinality", "bigint"))
    return f.select(*[number(F.col("f")[i]).cast(k).alias(n) for i, (n, k) in enumerate(kinds)])


def read_domains(spark: SparkSession, paths) -> DataFrame:
    f = _fields(spark, paths, r"\s+")
    vals = F.arrays_zip(array_fields(F.col("f")[2]).alias("value"), array_fields(F.col("f")[3], "double").alias("truthiness"))
    rows = f.select(number(F.col("f")[0]).alias("vid"), number(F.col("f")[1]).alias("cardinality"), vals.alias("vals"))
    wrong = F.raise_error(F.concat(F.lit("domain size of variable "), F.col("vid").cast("string")))
    return rows.select("vid", "cardinality", F.when(F.size("vals") == F.col("cardinality"), F.col("vals")).otherwise(wrong.cast(rows.schema["vals"].dataType)).alias("vals"))


def parse_factors(lines: DataFrame, func: int, equal_to: list[int]) -> DataFrame:
    """Columns of a factor but its id from lines(value): variables, then (and_categorical only) values, weight, feature."""
    n, categorical = len(equal_to), func == FUNCTIONS["and_categorical"]
    f = lines.where(F.trim("value") != "").select(F.split("value", "\t").alias("f"))
    eq = F.slice("f", n + 1, n) if categorical else F.array(*[F.lit(str(e)) for e in equal_to])
    vifs = F.transform(F.slice("f", 1, n), lambda v, i: F.struct(i.cast("int").alias("pos"), number(v).alias("vid"), number(F.get(eq, i)).alias("equal_to")))
    at = 2 * n if categorical else n
    return f.select(
        F.lit(func).cast("smallint").alias("func"), F.lit(n).cast("bigint").alias("arity"), vifs.alias("vifs"),
        number(F.col("f")[at]).alias("wid"), number(F.get("f", F.lit(at + 1)), "double").alias("feature_value"),
    )


def read_factors(spark: SparkSession, files: list[tuple[str, int, list[int]]]) -> DataFrame:
    """Factors of (path, func, equal_to) files, numbered in their order."""
    rows = None
    for path, func, equal_to in files:
        part = parse_factors(spark.read.text(path), func, equal_to)
        rows = part if rows is None else rows.unionByName(part)
    return dense_ids(rows, "fid").select("fid", "func", "arity", "vifs", "wid", "feature_value")


def _array(items: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(items, lambda x: x.cast("string")), ","), F.lit("}"))


def write_lines(df: DataFrame, path: str, *fields: Column) -> None:
    df.select(F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("value")).write.mode("overwrite").text(path)


def write_weights(weights: DataFrame, path: str) -> None:
    write_lines(weights, path, F.col("wid"), F.col("is_fixed").cast("int"), F.col("init_value"))


def write_variables(variables: DataFrame, path: str) -> None:
    write_lines(variables, path, *[F.col(c) for c in ("vid", "role", "init_value", "dtype", "cardinality")])


def write_domains(domains: DataFrame, path: str) -> None:
    """Truthiness is kept, so the files can be read again."""
    write_lines(domains, path, F.col("vid"), F.col("cardinality"), _array(F.col("vals.value")), _array(F.col("vals.truthiness")))


def write_factors(factors: DataFrame, path: str) -> list[tuple[str, int, list[int]]]:
    """One folder for each (func, values) so that nothing is lost, all written by one job; returns what read_factors takes.

    The number of folders is that of distinct value vectors of non-categorical factors, and the list of them is all that is collected.
    """
    categorical = F.col("func") == FUNCTIONS["and_categorical"]
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "\t")
    eq = F.when(categorical, F.transform("vifs", lambda v: F.lit(1).cast("bigint"))).otherwise(F.col("vifs.equal_to"))
    folder = F.concat(F.col("func").cast("string"), F.lit("-"), F.array_join(F.transform(eq, lambda x: x.cast("string")), "_"))
    fields = [joined(F.col("vifs.vid")), F.when(categorical, joined(F.col("vifs.equal_to"))), F.col("wid").cast("string"), F.col("feature_value").cast("string")]
    factors.select(folder.alias("rule"), F.concat_ws("\t", *fields).alias("value")).write.mode("overwrite").partitionBy("rule").text(path)
    rules = factors.select("func", eq.alias("eq"), folder.alias("rule")).distinct().orderBy("func", "eq").collect()
    return [(f"{path}/rule={r.rule}", r.func, list(r.eq)) for r in rules]


def write_meta(graph, path: str) -> None:
    from factorloom.operators.graph import descriptor

    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("n_weights", "n_variables", "n_factors", "n_edges")])
    descriptor(graph).select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_results(weights: DataFrame, probs: DataFrame, path: str) -> None:
    """Learned weights as `wid value` and marginals as `vid value prob`, both in order of ids."""
    six = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.6g", F.col(c)), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    weights.orderBy("wid").select(F.concat_ws(" ", F.col("wid").cast("string"), six("w")).alias("value")).write.mode("overwrite").text(f"{path}/inference_result.out.weights.text")
    if probs is not None:
        line = F.concat_ws(" ", F.col("vid").cast("string"), F.col("value").cast("string"), six("prob"))
        probs.orderBy("vid", "value").select(line.alias("value")).write.mode("overwrite").text(f"{path}/inference_result.out.text")


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(component, vid) from lines of vids; a component is named by its smallest vid."""
    vids = _fields(spark, path, r"\s+").select(F.transform("f", lambda x: number(x)).alias("vids"))
    return vids.select(F.array_min("vids").alias("component"), F.explode("vids").alias("vid"))


def read_samples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(sample, vid, value) from one file per sample with lines `vid value`."""
    rows = None
    for i, path in enumerate(paths):
        part = _fields(spark, path, r"\s+").select(F.lit(i).cast("bigint").alias("sample"), number(F.col("f")[0]).alias("vid"), number(F.get("f", F.lit(1))).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def write_compact(weights: DataFrame, path: str) -> None:
    """Lines `vid_i vid_j weight` of a compacted graph."""
    weights.orderBy("vid_i", "vid_j").select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("vid_i", "vid_j", "weight")]).alias("value")).write.mode("overwrite").text(path)
