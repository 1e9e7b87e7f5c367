"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector x is rotated at random to r and coded by the signs of r, one bit a component; the code
stands for the unit vector s = sign(r) / sqrt(D). Stored beside it are the correction factor
f = <s, r> and, for the vector's turn as a query, r in BITS bits a component with the length of what
that rounds off. For another unit vector q with <x, q> = c, <s, q> = f * c + sqrt(1 - f^2) * <e, q> with a
unit vector e across x, and <e, q> has mean zero over rotations: <s, q> / f estimates c without bias,
with the standard error sqrt(1 - f^2) * sqrt(1 - c^2) / (f * sqrt(D - 1)). A pair whose estimate lies more
than `confidence` standard errors (those of a pair at the threshold) under the threshold is settled
by the codes; at sqrt(D - 1) of them, which is more than can ever occur, no link can be lost.

Codes are made once for each distinct vector and written. Tiles of codes meet each other by
exclusive bit operations and bit counts; only vectors of pairs that the codes leave undecided are
fetched, and those pairs are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.batches import as_batch, map_batches
from factorloom.llm.tiles import Forest, make_tiles, pair_tiles
from factorloom.operators.components import connected_components
from factorloom.session import Scratch

THRESHOLD = 0.98
#: Standard errors that a link may lie below its cosine; at 64 components one link in 10^11 is further off.
CONFIDENCE = 6.0
TILE_ROWS = 8192
BITS = 4
#: Rows of either side that one exact comparison takes at most.
EXACT_ROWS = 1024
_STRIP = 256
_SLACK = 1e-6


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _layout(words: int) -> np.dtype:
    """A coded vector: sign bits, bit planes of the rounded query, and f, low, step, sum, error, D."""
    return np.dtype([("code", "<u8", (words,)), ("planes", "<u8", (BITS, words)), ("numbers", "<f4", (6,))])


def _bits(flags: np.ndarray, words: int) -> np.ndarray:
    packed = np.packbits(flags, axis=1)
    return np.pad(packed, ((0, 0), (0, 8 * words - packed.shape[1]))).view("<u8")


def encode(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Coded vectors, as the rows of a structured array."""
    n, dim = vectors.shape
    turned = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ turn
    low = turned.min(axis=1, keepdims=True)
    step = (turned.max(axis=1, keepdims=True) - low) / (2**BITS - 1)
    step[step == 0] = 1.0
    level = np.rint((turned - low) / step)
    rounded = low + step * level
    out = np.zeros(n, _layout(-(-dim // 64)))
    out["code"] = _bits(turned >= 0, out["code"].shape[1])
    for k in range(BITS):
        out["planes"][:, k] = _bits(level.astype(np.int64) >> k & 1 == 1, out["code"].shape[1])
    factor, error = np.abs(turned).sum(axis=1) / np.sqrt(dim), np.linalg.norm(turned - rounded, axis=1)
    out["numbers"] = np.stack([factor, low[:, 0], step[:, 0], rounded.sum(axis=1), error, np.full(n, dim)], axis=1)
    return out


def estimates(queries: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """Estimated cosine of every query (rows) with every coded vector (columns), from bits and correction factors alone."""
    f, dim = coded["numbers"][:, 0][None, :], coded["numbers"][0, 5]
    low, step, total = (queries["numbers"][:, k][:, None] for k in (1, 2, 3))
    met = np.zeros((len(queries), len(coded)), np.float32)
    for k in range(BITS):
        for w in range(coded["code"].shape[1]):
            met += np.bitwise_count(queries["planes"][:, k, w][:, None] & coded["code"][:, w][None, :]) * np.float32(1 << k)
    ones = np.bitwise_count(coded["code"]).sum(axis=1, dtype=np.float32)[None, :]
    return (2 * (low * ones + step * met) - total) / np.sqrt(dim) / f


def undecided(queries: np.ndarray, coded: np.ndarray, threshold: float, confidence: float | None) -> np.ndarray:
    """Boolean matrix of the pairs whose confidence bound reaches the threshold; with confidence None the bound that holds for certain."""
    f, dim = coded["numbers"][:, 0][None, :], float(coded["numbers"][0, 5])
    most = np.sqrt(max(dim - 1, 1))
    across = np.sqrt(np.maximum(1 - f * f, 0)) * np.sqrt(max(1 - threshold * threshold, 0)) / most
    bound = (across * min(confidence or most, most) + queries["numbers"][:, 4][:, None]) / f
    return estimates(queries, coded) + bound >= threshold - 1e-4


def usable() -> Column:
    """True for rows whose label is not null and whose vector has only finite components, not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & some, F.lit(False))


def coded_classes(classes: DataFrame) -> DataFrame:
    """(cls, label, dim, packed) of classes(cls, label, embedding): one code for each, made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            x, sizes = batch.column("x"), batch.column("dim").to_numpy()
            packed: list = [None] * len(batch)
            flat, starts = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                turn = turns.setdefault(dim, rotation(dim)) if dim not in turns else turns[dim]
                coded = encode(flat[starts[rows][:, None] + np.arange(dim)], turn)
                for r, made in zip(rows.tolist(), coded, strict=True):
                    packed[r] = made.tobytes()
            yield {"cls": batch.column("cls"), "label": batch.column("label"), "dim": batch.column("dim"), "packed": packed}

    rows = classes.select("cls", F.col("label").cast("string").alias("label"), F.size("embedding").cast("long").alias("dim"), F.col("embedding").cast("array<double>").alias("x"))
    return map_batches(rows, run, "cls long, label string, dim long, packed binary")


ROWS = "a long, b long, i int, j int, side int, cls long"
FOUND = "u long, v long, links long"


def undecided_rows(tiles: DataFrame, threshold: float, confidence: float | None) -> DataFrame:
    """ROWS: the vectors of the pairs that codes leave undecided, once for each piece (a, i) x (b, j) of two tiles, of at most EXACT_ROWS rows a side."""

    def arrays(items: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
        packed = items.values.field("packed").to_pylist()
        words = (len(packed[0]) - 24) // (8 * (1 + BITS))
        return items.values.field("cls").to_numpy(), np.frombuffer(b"".join(packed), _layout(words))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for a, b, same in zip(*(batch.column(c) for c in ("a", "b", "same")), strict=True):
                (ida, a), (idb, b), same = arrays(a), arrays(b), same.as_py()
                for i in range(0, len(a), EXACT_ROWS):
                    for j in range(i if same else 0, len(b), EXACT_ROWS):
                        left, right = _involved(a[i : i + EXACT_ROWS], b[j : j + EXACT_ROWS], same and i == j, threshold, confidence)
                        cls = np.concatenate([ida[i : i + EXACT_ROWS][left], idb[j : j + EXACT_ROWS][right]])
                        n = np.ones(len(cls), np.int64)
                        side = np.repeat([0, 1], [len(left), len(right)])
                        yield {"a": n * ida[0], "b": n * idb[0], "i": n * (i // EXACT_ROWS), "j": n * (j // EXACT_ROWS), "side": side, "cls": cls}

    return map_batches(pair_tiles(tiles, ["label", "dim"]).select("a", "b", "same"), find, ROWS)


def _involved(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, confidence: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of either side in an undecided pair; where both sides are one, all in the first."""
    left, right = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for at in range(0, len(a), _STRIP):
        near = undecided(a[at : at + _STRIP], b, threshold, confidence)
        if same:
            near &= np.arange(len(b))[None, :] > np.arange(at, at + len(near))[:, None]
        left[at : at + _STRIP] |= near.any(axis=1)
        right |= near.any(axis=0)
    if same:
        return np.flatnonzero(left | right), np.zeros(0, np.int64)
    return np.flatnonzero(left), np.flatnonzero(right)


def exact_links(wanted: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """FOUND: degrees by class (links) and spanning links (v) of the pairs among wanted rows whose cosine reaches the threshold."""

    def recheck(key: tuple, rows: pa.Table) -> pa.Table:
        same = key[0] == key[1] and key[2] == key[3]
        side = rows["side"].to_numpy()
        cls, copies = rows["cls"].to_numpy(), rows["copies"].to_numpy()
        x = np.stack(rows["x"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1))
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        return pa.Table.from_batches([as_batch(_compare(x, cls, copies, left, right, same, threshold), FOUND)])

    vectors = classes.select("cls", "copies", F.col("embedding").cast("array<double>").alias("x"))
    return wanted.join(vectors, "cls").groupBy("a", "b", "i", "j").applyInArrow(recheck, FOUND)


def _compare(x: np.ndarray, cls: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> dict:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    forest, degree = Forest(len(x)), np.zeros(len(x), np.int64)
    for at in range(0, len(left), _STRIP):
        near = unit[left[at : at + _STRIP]] @ unit[right].T
        # what rounding leaves in doubt is computed once more from the raw vectors
        for p, q in zip(*np.nonzero(np.abs(near - threshold) < _SLACK), strict=True):
            a, b = x[left[at + p]], x[right[q]]
            near[p, q] = (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
        p, q = np.nonzero(near >= threshold)
        p = p + at
        if same:
            p, q = p[p < q], q[p < q]
        i, j = left[p], right[q]
        np.add.at(degree, i, copies[j])
        np.add.at(degree, j, copies[i])
        forest.link(i, j)
    nodes, roots = forest.edges()
    some = np.flatnonzero(degree)
    return {
        "u": np.concatenate([cls[nodes], cls[some]]),
        "v": pa.array([*cls[roots].tolist(), *[None] * len(some)], pa.int64()),
        "links": pa.array([*[None] * len(nodes), *degree[some].tolist()], pa.int64()),
    }


def embedding_components(
    embeddings: DataFrame, threshold: float = THRESHOLD, confidence: float | None = CONFIDENCE, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings(vec_id, embedding, label).

    Rows link when labels are equal as text and the cosine in double precision is at least `threshold`.
    Null, zero or not finite vectors and null labels link with nothing; vectors of unlike length don't
    link. Equal vectors of a label become one class with a count, so a third of all rows in one class
    is one row to compare; they are told apart by two 64-bit hashes. Rows that repeat a vec_id are
    vectors of their own; a null vec_id comes after all others. Other columns are ignored.
    """
    scratch = Scratch(embeddings.sparkSession, "embedding-dedup")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    good, name = rows.where(usable()), ["label", "h1", "h2"]
    classes = good.groupBy(*name).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    # classes are named by position in a written table, so null and repeated vec_ids can't confuse them
    classes = scratch.keep(classes.withColumn("cls", F.monotonically_increasing_id()))
    codes = scratch.keep(coded_classes(classes))
    tiles = scratch.keep(make_tiles(codes, ["label", "dim"], "cls", F.struct("cls", "packed"), tile_rows))
    wanted = scratch.keep(undecided_rows(tiles, threshold, confidence))
    found = scratch.keep(exact_links(wanted, classes, threshold))
    parts = connected_components(found.where("v is not null").select("u", "v"))
    degree = found.where("links is not null").groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
    whole = classes.drop("embedding").join(degree, "cls", "left").join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    whole = whole.withColumn("c", F.coalesce("component", "cls"))
    ids = whole.groupBy("c").agg(F.min("least").alias("component_id"))
    whole = whole.join(ids, "c").select(*name, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", *name).join(whole, name).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
