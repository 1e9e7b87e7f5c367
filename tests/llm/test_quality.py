"""The ordinal classifier: held-out accuracy, gradients by differences, odd tables."""

import numpy as np

from factorloom.llm import quality
from tests.llm.util import ODD, docs_of, with_clashes


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 3 <> 0")
    got = quality.score_quality(docs, train).join(quality.grades(labels), "doc_id").where("doc_id % 3 = 0").toPandas()
    share = got.groupby("grade")["selected"].mean()
    assert share[2] > 0.97 and share[0] < 0.1 and share[1] < 0.45
    assert np.allclose(got[["p0", "p1", "p2"]].sum(axis=1), 1) and np.allclose(got["expected_grade"], got["p1"] + 2 * got["p2"])


def test_odd_tables(spark):
    docs = with_clashes(docs_of(spark, ODD))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, none).toPandas()
    assert len(got) == len(ODD) and got["selected"].all()
    some = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 1), (None, 1, 0), (7, None, 1), (8, 0, 1), (11, 1, 1), (11, 1, 1)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.grade) for r in quality.grades(some).collect()} == {(1, 2), (5, 0), (7, 1), (8, 0), (11, 1)}
    assert quality.score_quality(docs, some).count() == len(ODD)
    kept = quality.select_quality(docs, some)
    assert kept.columns == docs.columns and 0 < kept.count() <= len(ODD)
    assert quality.score_quality(docs_of(spark, []), some).count() == 0


def test_thresholds_are_ordered_and_shared_weights_rank_grades():
    rng = np.random.default_rng(1)
    rows, grade = [], []
    for _ in range(600):
        g = int(rng.integers(3))
        rows.append(np.unique(np.array([10 + g, int(rng.integers(100, 140))], dtype=np.int32)))
        grade.append(g)
    model = quality.CumulativeLink.fit(rows, np.array(grade))
    w = model.weights[[10, 11, 12]]
    assert model.cuts[0] <= model.cuts[1] and w[0] < w[1] < w[2]
    assert (model.probabilities(w.astype(float)).argmax(axis=1) == [0, 1, 2]).all()


def test_fit_and_scores_equal_a_plain_version():
    """The same steps with dense matrices and a loop over rows, and probabilities by the formula."""
    import math

    rng = np.random.default_rng(2)
    names, rows, grade = [3, 17, 40, 90, 200], [], []
    for _ in range(300):
        g = int(rng.integers(3))
        have = [n for n, p in zip(names, ([0.8, 0.3, 0.1, 0.5, 0.5], [0.3, 0.8, 0.3, 0.5, 0.4], [0.1, 0.3, 0.8, 0.5, 0.6])[g], strict=True) if rng.random() < p]
        rows.append(np.array(have, dtype=np.int32))
        grade.append(g)
    model = quality.CumulativeLink.fit(rows, np.array(grade))
    x = np.array([[float(n in r) for n in names] for r in rows])
    share = np.cumsum((np.bincount(grade, minlength=3) + 0.5) / (len(grade) + 1.5))[:2]
    cuts, w, move, cut_move = np.log(share / (1 - share)), np.zeros(5), np.zeros(5), np.zeros(2)
    rate = quality.RATE / (x.mean(axis=0) + quality.DAMP)
    f = lambda z: 1 / (1 + math.exp(-z))
    for _ in range(quality.STEPS):
        slope, cut_slope = np.zeros(5), np.zeros(2)
        for xi, g in zip(x, grade, strict=True):
            high, low = f(cuts[g] - xi @ w) if g < 2 else 1.0, f(cuts[g - 1] - xi @ w) if g else 0.0
            up, down = high * (1 - high) / (high - low), low * (1 - low) / (high - low)
            slope += xi * (up - down)
            if g < 2:
                cut_slope[g] -= up
            if g:
                cut_slope[g - 1] += down
        move = quality.MOMENTUM * move - rate * slope / len(x)
        cut_move = quality.MOMENTUM * cut_move - 0.2 * cut_slope / len(x)
        w = w + move
        w = np.sign(w) * np.maximum(np.abs(w) - rate * quality.SPARSE, 0)
        move[w == 0] = 0
        cuts = np.sort(cuts + cut_move)
    assert np.allclose(model.weights[names], w, atol=1e-5) and np.allclose(model.cuts, cuts, atol=1e-6)
    z = sum(w[[0, 3]])
    want = [f(cuts[0] - z), f(cuts[1] - z) - f(cuts[0] - z), 1 - f(cuts[1] - z)]
    assert np.allclose(model.probabilities(np.array([model.score(np.array([3, 90]))])), [want], atol=1e-5)


def test_labels_of_other_documents_cost_no_sample(spark):
    rows = [(i, ("good fine words here " if i % 2 else "bad poor stuff there ") * 5 + f"w{i}") for i in range(100)]
    labels = [(i, i % 2, 0) for i in range(100)] + [(10_000 + i, 1, 0) for i in range(3000)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs_of(spark, rows), labels, train_rows=200).collect()
    assert {r.fitted_rows for r in got} == {100} and all(r.selected == (r.doc_id % 2 == 1) for r in got)
    none = quality.score_quality(docs_of(spark, rows), labels.where("doc_id > 5000")).collect()
    assert {(r.fitted_rows, r.selected) for r in none} == {(0, True)}


def test_the_sample_is_bounded_and_has_a_row_an_id(spark):
    rows = [(1, "a b c"), (1, "d e f"), (1, None), *[(i, f"x{i} y z " * 3) for i in range(2, 40)]]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    whole = quality.training_sample(docs_of(spark, rows), labels).collect()
    assert sorted(r.doc_id for r in whole) == list(range(1, 40))
    again = quality.training_sample(docs_of(spark, rows[::-1]).repartition(5), labels).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, again))
    some = quality.training_sample(docs_of(spark, rows), labels, train_features=100).collect()
    assert 0 < len(some) < 20 and sum(len(r.ids) for r in some) <= 100
