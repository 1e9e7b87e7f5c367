"""Exact duplicates through a cuckoo-filter index of live digests.

Digests are made by native expressions, so texts never enter Python. Every input task folds its own
rows through a CuckooIndex (a partial aggregate): a row is inserted under its digest, and a withdrawn
row deleted again, which frees the slot once no live row of the digest is left. The partial groups are
dealt by digest to partitions of about PART_LIVE digests, and the index of a partition, which grows by
doubling, gives the final groups: no aggregate stands behind it. A digest that a third of all rows
share reaches its partition as one row per task and flush. The index of an input task yields its
groups at MAX_LIVE digests, deletes them and goes on, so memory is bounded whatever a task reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.batches import map_batches
from factorloom.session import Scratch, free_name

SLOTS = 4
MAX_KICKS = 200
MAX_LIVE = 400_000
#: Digests that a final partition is dealt on average; one row of a written table each, counted before.
PART_LIVE = 250_000
GROUPS = "digest binary, keep_id long, keep_chars long, group_size long, gone long"


class CuckooIndex:
    """Fingerprints in two candidate buckets of SLOTS, with the digest and payload of each slot beside them.

    `get` looks at fingerprints first; only a hit compares the stored digest. `insert` moves entries
    between their two buckets when both are full, and after MAX_KICKS moves doubles the table and
    puts every stored key in again. `delete` frees a slot, so withdrawn digests leave no trace.
    """

    def __init__(self, buckets: int = 1024):
        self.size = 0
        self.resizes = -1
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = bytearray(2 * SLOTS * buckets)
        self.marks = memoryview(self.prints).cast("H")
        self.keys: list = [None] * (SLOTS * buckets)
        self.values: list = [None] * (SLOTS * buckets)
        self.resizes += 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "big") or 1
        first = int.from_bytes(key[2:10], "big") & self.mask
        return mark, first, (first ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[at] == mark and self.keys[at] == key:
                    return at
        return -1

    def get(self, key: bytes):
        at = self._slot(key)
        return None if at < 0 else self.values[at]

    def delete(self, key: bytes) -> bool:
        at = self._slot(key)
        if at < 0:
            return False
        self.marks[at], self.keys[at], self.values[at] = 0, None, None
        self.size -= 1
        return True

    def insert(self, key: bytes, value) -> None:
        """Puts a live digest in, or replaces the value of one that is there."""
        at = self._slot(key)
        if at >= 0:
            self.values[at] = value
            return
        self.size += 1
        left = self._place(key, value)
        if left:
            self._grow([*self.items(), left])

    def _grow(self, live: list) -> None:
        """Doubles the table until every stored key has a place."""
        while True:
            self._clear(2 * (self.mask + 1))
            if not any(self._place(k, v) for k, v in live):
                return

    def _place(self, key: bytes, value):
        """None, or the entry that found no room; the table then holds all the others."""
        mark, bucket, second = self._places(key)
        for b in (bucket, second):
            for at in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.marks[at]:
                    self.marks[at], self.keys[at], self.values[at] = mark, key, value
                    return None
        for kick in range(MAX_KICKS):
            at = bucket * SLOTS + kick % SLOTS
            key, self.keys[at] = self.keys[at], key
            value, self.values[at] = self.values[at], value
            mark, self.marks[at] = self.marks[at], mark
            bucket = (bucket ^ (mark * 0x5BD1E995)) & self.mask
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[at]:
                    self.marks[at], self.keys[at], self.values[at] = mark, key, value
                    return None
        return key, value

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (chars, doc_id, rows, gone) the longer live text, then the smaller id (null ids last); rows and withdrawals add up."""
    rows, gone = a[2] + b[2], a[3] + b[3]
    if (b[0], b[1] is not None, -(b[1] or 0)) > (a[0], a[1] is not None, -(a[1] or 0)):
        return b[0], b[1], rows, gone
    return a[0], a[1], rows, gone


def fold(index: CuckooIndex, key: bytes, new: tuple) -> None:
    """Enters (chars, doc_id, rows, gone) under a digest; a digest whose rows are all withdrawn leaves the index."""
    old = index.get(key)
    new = new if old is None else _better(old, new)
    if new[2] == new[3]:
        index.delete(key)
    else:
        index.insert(key, new)


def _folded(max_live: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index = CuckooIndex()

        def flush() -> dict:
            live = list(index.items())
            for key, _ in live:
                index.delete(key)
            chars, ids, rows, gone = zip(*[v for _, v in live], strict=True)
            return {"digest": [k for k, _ in live], "keep_id": ids, "keep_chars": chars, "group_size": rows, "gone": gone}

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("digest", "keep_id", "keep_chars", "group_size", "gone"))
            for key, doc_id, chars, rows, gone in zip(*columns, strict=True):
                fold(index, key, (chars, doc_id, rows, gone))
                if max_live and index.size >= max_live:
                    yield flush()
        if index.size:
            yield flush()

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", ""), 256))


def _live(docs: DataFrame, withdrawn: DataFrame | None) -> tuple[DataFrame, str]:
    """docs with a boolean column that marks the rows of withdrawn ids, and its name."""
    name = free_name(docs, "is_gone")
    if withdrawn is None:
        return docs.withColumn(name, F.lit(False)), name
    gone = withdrawn.select(F.col("doc_id").alias("_gone_id")).where("_gone_id is not null").distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone_id"), "left").withColumn(name, F.col("_gone_id").isNotNull()).drop("_gone_id"), name


def digest_groups(docs: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """(digest, keep_id, keep_chars, group_size) of every normalised text with a live row in docs(doc_id, text)."""
    flagged, gone = _live(docs.select("doc_id", "text"), withdrawn)
    out = F.col(gone)
    # a withdrawn row counts as inserted and withdrawn, and can't be the one that stays: its length is below any text's
    rows = flagged.select(
        _digest(F.col("text")).alias("digest"),
        F.when(~out, F.col("doc_id").cast("long")).alias("keep_id"),
        F.when(out, -1).otherwise(F.length(F.coalesce(F.col("text"), F.lit("")))).cast("long").alias("keep_chars"),
        F.lit(1).cast("long").alias("group_size"),
        out.cast("long").alias("gone"),
    )
    partial = Scratch(docs.sparkSession, "exact-dedup").keep(map_batches(rows, _folded(MAX_LIVE), GROUPS))
    parts = max(1, -(-partial.count() // PART_LIVE), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = map_batches(partial.repartition(parts, "digest"), _folded(None), GROUPS)
    return found.select("digest", "keep_id", "keep_chars", (F.col("group_size") - F.col("gone")).alias("group_size"))


def exact_dedup(docs: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """One row per live row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree without [\\x20\\x09-\\x0D]; a null text counts as empty. The longest
    original stays, then the smallest doc_id; a null doc_id comes last. Rows that repeat the kept
    doc_id with the same text are all marked kept. Rows of `withdrawn`(doc_id) are deleted from the
    index and come out of no group. Empty tables give empty results, and other columns are ignored.
    """
    flagged, gone = _live(docs.select("doc_id", "text"), withdrawn)
    rows = flagged.where(~F.col(gone)).select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest"))
    return rows.join(digest_groups(docs, withdrawn), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
