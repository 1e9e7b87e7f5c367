"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 poor, 1 well written but toxic, 2 good. All grades share one weight vector over
hashed text features, and ordered thresholds cut the score: P(grade <= k) = sigmoid(t_k - w.x). The
expected grade and the tail probability P(grade = 2) come from that; rows whose tail probability
reaches the model's cut are selected. The cut is chosen on a fifth of the labelled rows, which the fit
leaves out: the greatest that selects KEEP_GOOD of the good ones, within CUT_RANGE.

The model is fitted on at most TRAIN_ROWS documents that have a label (the smallest hashes of doc_id)
and at most TRAIN_FEATURES features of them; the hashed features, not the texts, go to the driver.
Scoring reads every whole text where it lies, with a model of 2^18 weights whatever the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.batches import map_batches, texts
from factorloom.session import Scratch, free_name

BUCKETS = 1 << 18
#: Bounds on the labelled sample: rows, and features of all rows together (rows in hash order up to that sum; 64 MB).
TRAIN_ROWS, TRAIN_FEATURES = 8_000, 16_000_000
MIN_ROWS = 20
#: The share of good held-out training rows that the cut must keep, where the cut may lie, and where it lies with too few such rows.
KEEP_GOOD, CUT_RANGE, PLAIN_CUT, MIN_GOOD = 0.99, (0.05, 0.95), 0.5, 50
STEPS, RATE, MOMENTUM, DAMP, SPARSE = 200, 0.1, 0.8, 0.01, 0.0015
_CACHE_WORDS = 200_000
_ALNUM = bytes(c for c in range(128) if chr(c).isalnum())
SCORED = "p0 double, p1 double, p2 double, expected_grade double, tail_prob double"


class Features(dict):
    """word -> (hashed features of the word, its shape); a text has each feature once."""

    def __missing__(self, word: bytes) -> tuple[tuple[int, ...], bytes]:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        if word.isascii():  # the same in bytes
            low = word.lower()
            kind = b"U" if low != word and word.upper() == word else b"l" if word.isalpha() else b"x"
            shape = b"^" + kind + low.translate(None, _ALNUM)[-2:]
            made = self[word] = (tuple([crc32(x) % BUCKETS for x in {low, low[:3] + b"*", low[:4] + b"*", low[:5] + b"*"}]), shape)
            return made
        text = word.decode("utf-8")
        low = text.lower()
        kind = "U" if low != text and text.upper() == text else "l" if text.isalpha() else "x"
        shape = f"^{kind}{''.join(c for c in low if not c.isalnum())[-2:]}".encode()
        made = self[word] = (tuple(crc32(x.encode()) % BUCKETS for x in {low, low[:3] + "*", low[:4] + "*", low[:5] + "*"}), shape)
        return made

    def of(self, text: str | None) -> np.ndarray:
        """Sorted buckets of a text: words, their beginnings, how common each shape is, how much repeats."""
        words = Counter((text or "").encode("utf-8", "replace").split())
        total = sum(words.values())
        if not total:
            return np.array([crc32(b"^empty") % BUCKETS], dtype=np.int32)
        known = [self[word] for word in words]
        found = set(chain.from_iterable([ids for ids, _ in known]))
        shapes: dict[bytes, int] = {}
        for (_, shape), n in zip(known, words.values(), strict=True):
            shapes[shape] = shapes.get(shape, 0) + n
        for shape, n in shapes.items():
            found.add(crc32(b"%s%d" % (shape, 4 * n // total)) % BUCKETS)
        found.add(crc32(b"^distinct%d" % (8 * len(words) // total)) % BUCKETS)
        made = np.fromiter(found, dtype=np.int32, count=len(found))
        made.sort()
        return made


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels(doc_id, quality, toxic); rows that nulls leave undecided are left out, of several ratings the lowest counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class CumulativeLink:
    """Shared weights and two ordered thresholds; select_at and fitted_rows say what train made of the sample."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights.astype(np.float32), cuts
        self.select_at, self.fitted_rows = PLAIN_CUT, 0

    def score(self, features: np.ndarray) -> float:
        return self.weights[features].sum(dtype=np.float64)

    @classmethod
    def fit(cls, rows: list[np.ndarray], grade: np.ndarray) -> CumulativeLink:
        """Proximal gradient with momentum on the log-likelihood; features of fewer than MIN_ROWS rows get no weight.

        Steps are scaled by the inverse of how common a feature is, and an L1 penalty leaves weights
        only where many rows agree: texts have hundreds of features each, most of them chance.
        """
        # cuts that give the grades' smoothed shares where nothing else is known; without any row, grade 2
        share = np.bincount(grade, minlength=3) + (0.5 if len(grade) else np.array([0.01, 0.01, 1.0]))
        below = np.cumsum(share / share.sum())[:2]
        cuts = np.log(below / (1 - below))
        full = np.zeros(BUCKETS)
        if len(set(grade.tolist())) < 2:
            return cls(full, cuts)
        df = np.zeros(BUCKETS, np.int32)
        for r in rows:
            df[r] += 1
        number = np.full(BUCKETS, -1, np.int32)
        names = np.flatnonzero(df >= min(MIN_ROWS, max(1, len(rows) // 50)))
        number[names] = np.arange(len(names), dtype=np.int32)
        # every row ends with a feature of weight 0, so that none is empty; then the same by feature
        col = [np.append(c[c >= 0], np.int32(len(names))) for c in (number[r] for r in rows)]
        starts = np.cumsum([0, *map(len, col[:-1])])
        col = np.concatenate(col)
        row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(np.append(starts, len(col))))[np.argsort(col, kind="stable")]
        firsts = np.concatenate([[0], np.cumsum(df[names])])
        rate = np.append(RATE / (df[names] / len(rows) + DAMP), 0.0)
        w, move, cut_move = np.zeros(len(rate)), np.zeros(len(rate)), np.zeros(2)
        for _ in range(STEPS):
            z = np.add.reduceat(w[col], starts)
            high = np.where(grade < 2, _sigmoid(cuts[np.minimum(grade, 1)] - z), 1.0)
            low = np.where(grade > 0, _sigmoid(cuts[np.maximum(grade - 1, 0)] - z), 0.0)
            p = np.maximum(high - low, 1e-9)
            up, down = high * (1 - high) / p, low * (1 - low) / p  # slopes of -log p at either cut
            slope = np.add.reduceat((up - down)[row], firsts) / len(rows)
            cut_slope = np.array([(down * (grade == k + 1) - up * (grade == k)).mean() for k in (0, 1)])
            move = MOMENTUM * move - rate * slope
            cut_move = MOMENTUM * cut_move - 0.2 * cut_slope
            w = w + move
            w = np.sign(w) * np.maximum(np.abs(w) - rate * SPARSE, 0)
            move[w == 0] = 0
            cuts = np.sort(cuts + cut_move)
        full[names] = w[:-1]
        return cls(full, cuts)

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Rows of P(grade = 0), P(1), P(2)."""
        low, high = _sigmoid(self.cuts[0] - score), _sigmoid(self.cuts[1] - score)
        return np.stack([low, high - low, 1 - high], axis=1)


def training_sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_features: int = TRAIN_FEATURES) -> DataFrame:
    """(doc_id, grade, ids): features and grades of a bounded sample of the documents that have a label, a row for each doc_id.

    The sample is taken after labels have met documents, so labels of other documents cost nothing of
    it. A doc_id with several texts gives the one with the least hash.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = grades(labels).join(docs.select("doc_id"), "doc_id", "left_semi")
    sample = scratch.keep(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    rows = docs.join(F.broadcast(sample), "doc_id")  # at most train_rows rows of 12 bytes
    rows = rows.select("doc_id", "grade", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        make = Features()
        for batch in batches:
            ids = pa.array([make.of(t) for t in texts(batch)], pa.list_(pa.int32()))
            yield {**{c: batch.column(c) for c in ("doc_id", "grade", "mark")}, "ids": ids}

    made = map_batches(rows, features, "doc_id long, grade int, mark long, ids array<int>")
    made = made.groupBy("doc_id").agg(F.min(F.struct("mark", "grade", "ids")).alias("m")).select("doc_id", "m.grade", "m.ids")
    made = scratch.keep(made)
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # train_rows rows at most
    fits = made.select("doc_id", F.sum(F.size("ids").cast("long")).over(upto).alias("n")).where(F.col("n") <= train_features).select("doc_id")
    return made.join(F.broadcast(fits), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_features: int = TRAIN_FEATURES) -> CumulativeLink:
    """Fits on four fifths of the sample of docs(doc_id, text) and chooses the cut on the rest."""
    found = training_sample(docs, labels, train_rows, train_features).toArrow().sort_by("doc_id")
    rows = [np.asarray(x.values, dtype=np.int32) for x in found["ids"]]
    grade = found["grade"].to_numpy().astype(np.int64)
    held = np.array([crc32(str(i).encode()) % 5 == 0 for i in found["doc_id"].to_pylist()], dtype=bool)
    if (grade[held] == 2).sum() < MIN_GOOD:
        held[:] = False
    model = CumulativeLink.fit([r for r, h in zip(rows, held, strict=True) if not h], grade[~held])
    model.fitted_rows = int((~held).sum())
    if held.any():
        good = model.probabilities(np.array([model.score(r) for r, h in zip(rows, held & (grade == 2), strict=True) if h]))[:, 2]
        model.select_at = float(np.clip(np.quantile(good, 1 - KEEP_GOOD), *CUT_RANGE))
    return model


def grade_udf(model: CumulativeLink):
    """Column function: text -> struct of SCORED."""

    @F.pandas_udf(SCORED)
    def scored(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        make = Features()
        for batch in columns:
            p = model.probabilities(np.array([model.score(make.of(t)) for t in batch]))
            yield pd.DataFrame({"p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2], "expected_grade": p @ np.arange(3.0), "tail_prob": p[:, 2]})

    return scored


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, p0, p1, p2, expected_grade, tail_prob, selected, fitted_rows for each row of docs(doc_id, text).

    Null and empty texts have one feature of their own. Repeated rows repeat, other columns are
    ignored. Where the labelled documents have one grade or none, the shares of the grades decide for
    every row; fitted_rows is how many documents the fit saw, and with 0 of them every row is selected.
    """
    model = train(docs, labels, train_rows)
    scored = grade_udf(model)
    rows = docs.select("doc_id", scored(F.col("text")).alias("s"))
    return rows.select("doc_id", "s.*", (F.col("s.tail_prob") >= model.select_at).alias("selected"), F.lit(model.fitted_rows).cast("long").alias("fitted_rows"))


def select_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, at: Column | float | None = None) -> DataFrame:
    """The rows of docs whose tail probability reaches `at` (the model's cut unless given), all columns as they are."""
    model = train(docs, labels, train_rows)
    name, scored = free_name(docs, "quality_scored"), grade_udf(model)
    return docs.withColumn(name, scored(F.col("text"))).where(F.col(name)["tail_prob"] >= (model.select_at if at is None else at)).drop(name)
