"""SimHash and embedding near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from factorloom.llm import embedding_dedup, queries, simhash
from tests.conftest import SF
from tests.llm.util import ODD, docs_of, with_clashes


def least_reachable(n, links, ids):
    at = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(at[a], at[b])
            if at[a] != m or at[b] != m:
                at[a] = at[b] = m
                changed = True
    best = {}
    for i in range(n):
        if ids[i] is not None:
            best[at[i]] = min(best.get(at[i], ids[i]), ids[i])
    return [best.get(at[i]) for i in range(n)]


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_wide(text, shingle, n_words):
    """The fingerprint of several words with Python integers."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole, mask = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed=42) for i in range(max(1, len(words) - shingle + 1))], 2**64 - 1
    out = 0
    for k in range(n_words):
        h = whole
        if k:
            h = [(x + k * 0x9E3779B97F4A7C15) & mask for x in h]
            h = [((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask for x in h]
            h = [((x ^ x >> 27) * 0x94D049BB133111EB) & mask for x in h]
            h = [x ^ x >> 31 for x in h]
        out = out << 64 | sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out


def check(spark, rows, **how):
    got = simhash.simhash_components(with_clashes(docs_of(spark, rows)), **how).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = least_reachable(len(rows), links, [r[0] for r in rows])
    key = lambda r: tuple(map(str, r))
    assert sorted([tuple(r) for r in got], key=key) == sorted([(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True)], key=key)


def test_simhash(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    near = [b + " extra" for b in base[:30]] + [b.replace("aa", "bb", 1) for b in base] + base[:10]
    odd = [r for r in ODD if r[0] != 8]
    check(spark, [*odd, *[(100 + i, t) for i, t in enumerate(base + near)]], tile_rows=7)
    check(spark, odd)
    check(spark, [])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, docs)


def test_wide_fingerprints(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(40, 200))] for _ in range(30)]
    near = [[("new" if rng.random() < 0.01 else w) for w in b] for b in base] + [[("new" if rng.random() < 0.1 else w) for w in b] for b in base]
    rows = [(i, " ".join(t)) for i, t in enumerate(base + near)] + [(900, None), (901, "")]
    got = simhash.simhash_components(docs_of(spark, rows), shingle=5, radius=48, n_words=4, tile_rows=11).collect()
    fps = [slow_wide(r[1], 5, 4) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 48]
    want = least_reachable(len(rows), links, [r[0] for r in rows])
    assert sorted(map(tuple, got)) == sorted((r[0], f"{f:064x}", c) for r, f, c in zip(rows, fps, want, strict=True))
    kept = {r.doc_id for r in simhash.drop_near_copies(docs_of(spark, rows)).collect()}
    assert kept == set(want) and set(range(30)) <= kept and len(kept & set(range(30, 60))) <= 3


def test_simhash_stage_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (9, "quite other words in here now"), (None, None)]
    left = simhash.drop_near_copies(with_clashes(docs_of(spark, rows)))
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 9] and left.first()["size"] == "clash"
    assert simhash.drop_near_copies(docs_of(spark, [])).count() == 0


def test_spark_hash_is_the_same():
    assert xxhash.xxh64_intdigest(b"a b c d", seed=simhash.SEED) >= 0


@pytest.mark.parametrize("confidence", [None, 6.0])
def test_embeddings(spark, confidence):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((12, 16))
    vecs = [list(map(float, np.float32(centre[i % 12] + rng.standard_normal(16) * 0.05 * (i % 3)))) for i in range(150)]
    rows = [(i, v, i % 2) for i, v in enumerate(vecs)] + [(200, vecs[0], 0), (201, vecs[0], 0), (201, vecs[0], 0), (202, vecs[0], None), (203, None, 1), (204, [0.0] * 16, 1), (205, [float("nan")] * 16, 1), (206, [float("inf")] * 16, 0), (207, [None, 1.0], 0), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0), (210, [], 1), (None, vecs[3], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    def unit(r):
        if r[1] is None or r[2] is None or any(x is None or not np.isfinite(x) for x in r[1]) or not any(r[1]):
            return None
        x = np.array(r[1])
        return x / np.linalg.norm(x)
    us = [unit(r) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if us[i] is not None and us[j] is not None and rows[i][2] == rows[j][2] and len(us[i]) == len(us[j]) and us[i] @ us[j] >= 0.98]
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    want = least_reachable(len(rows), links, [r[0] for r in rows])
    key = lambda r: tuple(map(str, r))
    got = embedding_dedup.embedding_components(with_clashes(df), confidence=confidence, tile_rows=9).collect()
    assert sorted([tuple(r) for r in got], key=key) == sorted([(r[0], int(d), c, r[0] == c) for r, d, c in zip(rows, degree, want, strict=True)], key=key)
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_embeddings_equal_sql(spark):
    from tests.llm.util import duck, same

    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    same(queries.op10_embeddings(spark, SF).toPandas(), duck(queries.ORACLE_SQL["op10_embeddings"], embeddings=e))


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((1, 64)))
    far = rng.standard_normal((40, 64))
    far = unit(far - (far @ x.T) * x)  # across x
    for c in (0.0, 0.8, 0.98, 0.995):
        q = c * x + np.sqrt(1 - c * c) * far
        made = []
        for seed in range(150):
            turn = embedding_dedup.rotation(64, seed)
            a, b = embedding_dedup.encode(x, turn), embedding_dedup.encode(q, turn)
            made.append(embedding_dedup.estimates(b, a)[:, 0])
            if c >= 0.98:  # neither bound gives up a link
                assert embedding_dedup.undecided(b, a, 0.98, None).all() and embedding_dedup.undecided(b, a, 0.98, 6.0).all()
            if c == 0.0:
                assert not embedding_dedup.undecided(b, a, 0.98, 6.0).any()
        assert abs(np.mean(made) - c) < 0.01


def test_codes_decide_and_vectors_of_decided_pairs_stay(spark):
    """Recall against brute force on random near copies, and how few rows the exact pass sees."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((1500, 64))
    base[1000:] = base[:500] + rng.standard_normal((500, 64)) * 0.19 * np.linalg.norm(base[:500], axis=1, keepdims=True) / 8
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(base)], "vec_id long, embedding array<double>, label string")
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    degree = (u @ u.T >= 0.98).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_components(df, tile_rows=400).collect()}
    assert [got[i] for i in range(1500)] == degree.tolist() and 100 < degree.sum() < 1000
    classes = df.select(df.vec_id.alias("cls"), "label", "embedding")
    codes = embedding_dedup.coded_classes(classes)
    from pyspark.sql import functions as F

    tiles = embedding_dedup.make_tiles(codes, ["label", "dim"], "cls", F.struct("cls", "packed"), 400)
    seen = embedding_dedup.undecided_rows(tiles, 0.98, 6.0).select("cls").distinct().count()
    assert seen <= 1100
