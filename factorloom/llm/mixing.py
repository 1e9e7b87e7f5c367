"""Mixing sources to target weights as a time-varying curriculum; native expressions only.

Each source offers its documents in a fixed shuffled order, pass after pass, as one stream of words.
Its demand over training time u in [0, 1] has the density 1 - ramp + 2 * ramp * u, whose integral is
D(u) = (1 - ramp) * u + ramp * u^2. A document that starts at word x of a stream with target g is
trained on at the position u that solves D(u) = x / g; sorting by position gives the training order.
That order is a property of a written table: its files are numbered by range, and `with_place` reads it
back as a column.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.words import word_count
from factorloom.session import Scratch

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
#: Rows of a source that one window task orders.
BUCKET_ROWS = 5_000
#: The table of sources is broadcast up to so many rows, about a megabyte; beyond, it is joined by shuffles.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, n, weight, ramp, target, goal) from rows (source, size).

    Sources in code point order, null last, take the weights in turn. The budget is the sum of all
    sizes. In order of size per weight, a source is capped at max_passes times its size while the
    level that the rest would get exceeds that; the others share what remains by weight. This table
    has a row per source, so its unpartitioned windows see the catalogue of sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    cap = F.col("source_size") * max_passes
    per = per.withColumn("cap", cap.cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("capped", F.col("ratio") < level)
    left = F.sum(F.col("source_size")).over(whole) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(whole)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * left / free))
    per = per.withColumn("target", F.round(target, 6)).withColumn("goal", F.round("target").cast("long"))
    return per.withColumn("ramp", (F.col("weight") - F.lit(2.0)) / 4).select("source", "source_size", "n", "weight", "ramp", "target", "goal")


def _position(done: Column, ramp: Column) -> Column:
    """u with D(u) = done, in the form that also holds for ramp 0."""
    return 2 * done / ((1 - ramp) + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * done))


def plan_mix(docs: DataFrame, keep: tuple = ("doc_id",), weights: tuple = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Every row of docs(doc_id, text, source): row (struct of the columns in keep), size, source,
    source_size, target, taken and copies, an array of (words, position), one for each pass over it.

    A stream ends at its goal, so the last document of its last pass may give only part of its words.
    Null texts have size 0, take nothing and get no copies; a null source is a source of its own.
    The order inside a source is by the MD5 of doc_id, then doc_id, size and a hash of the text, so
    reruns agree and rows that tie in all are alike. A source is cut into buckets by that hash, each ordered
    by its own task; only bucket sums are added up across them.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size, h = word_count(F.col("text")), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    share = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    bucket = lambda share: F.floor(share * F.ceil(F.col("n") / F.lit(BUCKET_ROWS)))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key")  # never null, so one shuffle serves join and window
    # what the sums need of each document, written once; documents themselves are read once more for the plan
    slim = scratch.keep(docs.select("source", size.alias("size"), share.alias("share")))
    sources = scratch.keep(source_targets(slim, weights, max_passes).select(key, "source_size", "n", "ramp", "target", "goal"))
    sources = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "doc_id", "source", key, size.alias("size"), h.alias("h"), share.alias("share"), F.xxhash64("text").alias("mark"))
    rows = rows.join(sources, "key").withColumn("bucket", bucket(F.col("share"))).drop("share")
    sums = slim.select(key, "size", "share").join(sources, "key").groupBy("key", bucket(F.col("share")).alias("bucket")).agg(F.sum("size").alias("s"))
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "bucket", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("ahead"))
    rows = rows.join(sums, ["key", "bucket"])
    inside = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("passes", passes)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("passes") * F.col("source_size") - F.col("start")))
    rows = rows.withColumn("part", part.cast("long"))
    copy = lambda c: F.struct(
        F.when(c < F.col("passes"), F.col("size")).otherwise(F.col("part")).alias("words"),
        _position((c * F.col("source_size") + F.col("start")) / F.greatest(F.col("goal"), F.lit(1)), F.col("ramp")).alias("position"),
    )
    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), copy), lambda x: x.words > 0)
    return rows.select(
        "row", "size", "source", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), copies.alias("copies")
    )


def training_order(plan: DataFrame) -> DataFrame:
    """The columns of row for each copy that gives at least half its words, whole, range-sorted by position."""
    return (
        plan.select("row", "size", F.explode("copies").alias("copy"))
        .where(F.col("copy.words") * 2 >= F.col("size"))
        .orderBy("copy.position", "row.doc_id", "copy.words")
        .select("row.*")
    )


def with_place(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column `name`: 0 .. n-1 in the order in which the Parquet files that docs reads were written.

    Spark numbers a sorted table's files by range and keeps rows in place inside them. Only the number
    of rows of each file is put together. Null where docs isn't read straight from files.
    """
    try:
        at = docs.metadataColumn("_metadata")
        marked = docs.withColumn("_file", at["file_name"]).withColumn("_row", at["row_index"])
        marked.schema  # noqa: B018  resolves the columns, which only files have
    except AnalysisException:
        return docs.withColumn(name, F.lit(None).cast("long"))
    order = Window.orderBy(F.regexp_extract("_file", r"^part-(\d+)", 1).cast("long"), "_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    counts = marked.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    ahead = counts.select(F.col("_file").alias("_of"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_ahead"))
    ahead = Scratch(docs.sparkSession, "places").keep(ahead)
    return marked.join(ahead, F.col("_file") == F.col("_of")).withColumn(name, F.col("_row") + F.col("_ahead")).drop("_file", "_row", "_of", "_ahead")
