"""SimHash near-duplicates: exact fingerprints, exact links by masks within pairs of tiles, components.

Fingerprints are made once per text and written down. Equal fingerprints become one row, so a group
of copies of any size costs a row. Distinct fingerprints are dealt to tiles by hash; any two tiles meet in
one line of tiles, whose links are found under masks that can't miss one (hamming.py), so a task holds
a line of bounded size and doesn't compare all its rows. It reports the links as a spanning forest,
which keeps every component and is no longer than the line, however dense the links are.

A fingerprint has one or more words of 64 bits. The bits of a pair differ with the probability
arccos(c) / pi, where c is the cosine of the shingle counts, so more words estimate the similarity more
sharply. The corpus stage takes STAGE_WORDS words of 5-word shingles and a radius that most pairs of
similarity 0.8 are within; unlike texts differ in half of all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, count
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.batches import as_batch, map_batches, texts
from factorloom.llm.hamming import link_near
from factorloom.llm.tiles import Forest
from factorloom.llm.words import lower_words
from factorloom.operators.components import connected_components
from factorloom.session import Scratch

SHINGLE = 4
RADIUS = 4
SEED = 42
#: A line of tiles has about twice TILE_ROWS rows at most; smaller tables have lines of up to FEW_TILES tiles, of LEAST_ROWS rows or so, for enough tasks.
TILE_ROWS, FEW_TILES, LEAST_ROWS = 1 << 18, 5, 1 << 13
#: The corpus stage: 256 bits of 5-word shingles; a pair of Jaccard similarity 0.8 differs in 39 of them, with deviation 6.
STAGE_SHINGLE, STAGE_WORDS, STAGE_RADIUS = 5, 4, 48
_CHUNK = 255 << 4


def _word(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit word of each shingle: the hash itself, then mixes of it."""
    if k == 0:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = SHINGLE, n_words: int = 1) -> bytes:
    """8 * n_words bytes, big-endian: a bit is 1 if set in over half of the hashes of the text's shingles, repeats included."""
    words = lower_words(text)
    if not words:
        return bytes(8 * n_words)
    line = b" ".join(words)
    ends = [*accumulate(map(len, words), lambda a, n: a + 1 + n)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    last = min(shingle, len(words)) - 1
    hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[last:], strict=False)], dtype=np.uint64)
    ones = np.zeros(64 * n_words, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        bits = np.unpackbits(np.stack([_word(part, k) for k in range(n_words)], axis=1).astype(">u8").view(np.uint8), axis=1)
        for few in range(0, len(part), 255):  # a byte counts as far
            ones += bits[few : few + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, n_words: int = 1, carry: dict | None = None) -> DataFrame:
    """(doc_id, fp) of docs(doc_id, text). Null and empty texts have fingerprint 0. carry: name -> type of columns beside."""
    carry = carry or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {**{c: batch.column(c) for c in ("doc_id", *carry)}, "fp": [fingerprint(t, shingle, n_words) for t in texts(batch)]}

    columns = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast(k).alias(c) for c, k in carry.items()]]
    return map_batches(docs.select(*columns, "text"), run, "doc_id long, fp binary" + "".join(f", {c} {k}" for c, k in carry.items()))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, n_words: int = 1, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(u, v): links that connect all rows of distinct(cls, fp) at most `radius` bits apart, a spanning forest per line of tiles.

    Tiles are the points (x, y) of a plane modulo a prime; of its lines, exactly one holds any two of them.
    """
    n, parts = distinct.count(), int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(1, -(-n // (2 * tile_rows)), min(FEW_TILES, -(-n // LEAST_ROWS)))
    side = next(p for p in count(least) if all(p % d for d in range(2, isqrt(p) + 1)))
    steep = side if side > 1 else 0  # the last slope is that of lines of one x; a lone tile is one line
    tile = F.pmod(F.xxhash64("cls"), F.lit(side * side).cast("long"))
    x, y = F.floor(tile / side).cast("long").alias("x"), (tile % side).alias("y")
    dealt = distinct.select("cls", "fp", x, y, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steep).cast("long"))).alias("slope"))
    line = F.when(F.col("slope") == side, side * side + F.col("x")).otherwise(F.col("slope") * side + F.pmod(F.col("y") - F.col("slope") * F.col("x"), F.lit(side).cast("long")))
    n_lines = side * (steep + 1)  # ranges finer than the lines, so that few lines have a task each
    meet = dealt.select(line.alias("line"), "cls", "fp").repartitionByRange(max(parts, 4 * min(n_lines, 64)), "line")

    def compare(rows: pa.Table) -> pa.Table:
        names = rows["cls"].to_numpy()
        fps = np.frombuffer(b"".join(rows["fp"].to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, n_words)
        forest = Forest(len(fps))
        link_near(fps, radius, forest)
        nodes, roots = forest.edges()
        return pa.Table.from_batches([as_batch({"u": names[nodes], "v": names[roots]}, "u long, v long")])

    return meet.groupBy("line").applyInArrow(compare, "u long, v long")


def fingerprint_classes(made: DataFrame, first, radius: int, n_words: int, tile_rows: int, scratch: Scratch) -> DataFrame:
    """(cls, fp, first, c): distinct fingerprints of made with the aggregate first and the component c that links within the radius give."""
    distinct = scratch.keep(made.groupBy("fp").agg(first.alias("first")).withColumn("cls", F.monotonically_increasing_id()))
    parts = connected_components(scratch.keep(fingerprint_links(distinct, radius, n_words, tile_rows)))
    return distinct.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("c", F.coalesce("component", "cls"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, n_words: int = 1, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits a word), component_id for each row of docs(doc_id, text).

    component_id is the smallest doc_id reachable over links of at most `radius` bits, itself
    included; rows with no words have fingerprint zero and link like others. Repeated rows repeat; a
    null doc_id counts after all others, so a component of null ids alone has a null component_id.
    Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    made = scratch.keep(fingerprints(docs, shingle, n_words))
    joined = fingerprint_classes(made, F.min("doc_id"), radius, n_words, tile_rows, scratch)
    ids = joined.groupBy("c").agg(F.min("first").alias("component_id"))
    classes = joined.join(ids, "c").select("fp", "component_id")
    return made.join(classes, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def drop_near_copies(
    docs: DataFrame, shingle: int = STAGE_SHINGLE, radius: int = STAGE_RADIUS, n_words: int = STAGE_WORDS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """docs with one row of each component: of the smallest doc_id, nulls last, the one whose text has the least hash.

    Rows that repeat that doc_id and text are one row too. So a doc_id with several texts keeps only
    those of its rows that lead a component, and a component of null ids keeps one row. Null and empty
    texts link with each other. Columns pass as they are; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash-stage")
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    made = scratch.keep(fingerprints(docs.select("doc_id", "text", mark.alias("mark")), shingle, n_words, {"mark": "long"}))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), "mark"))
    joined = fingerprint_classes(made, first, radius, n_words, tile_rows, scratch)
    key = lambda c: F.coalesce(c.cast("string"), F.lit("null"))  # noqa: E731  never null, so null ids meet by equality
    leads = joined.groupBy("c").agg(F.min("first").alias("k")).select(key(F.col("k.id")).alias("_key"), F.col("k.mark").alias("_mark")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), key(F.col("doc_id").cast("long")).alias("_key"), mark.alias("_mark"))
    return rows.join(leads, ["_key", "_mark"], "left_semi").dropDuplicates(["_key", "_mark"]).select("row.*")
