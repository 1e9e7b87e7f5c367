"""Links by masks against all pairs."""

import numpy as np
import pytest

from factorloom.llm import hamming, simhash
from factorloom.llm.tiles import Forest


def flipped(rng, rows, n_bits):
    """rows with so many of their bits changed, other ones in each row."""
    bits = np.unpackbits(rows.astype(">u8").view(np.uint8), axis=1)
    for row in bits:
        row[rng.choice(len(row), n_bits, replace=False)] ^= 1
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def random_rows(rng, n, n_words):
    return rng.integers(0, 2**64, (n, n_words), dtype=np.uint64)


def least_rows(rows, radius):
    """The least row of each row's component, by all pairs."""
    at = np.arange(len(rows))
    near = [np.flatnonzero(np.bitwise_count(rows ^ r).sum(axis=1, dtype=int) <= radius) for r in rows]
    while True:
        new = np.array([at[js].min() for js in near])
        if (new == at).all():
            return at
        at = new


def linked(rows, radius, parts=None):
    forest = Forest(len(rows))
    hamming.link_near(rows, radius, forest, parts)
    return forest.roots(np.arange(len(rows)))


def parts_of(bits, radius, n):
    cuts = [bits * i // n for i in range(n + 1)]
    return tuple((cuts[i], cuts[i + 1] - cuts[i], (radius + 1 + i) // n) for i in range(n))


@pytest.mark.parametrize(("width", "dimensions"), [(43, 8), (37, 7), (13, 1), (20, 3), (4, 3)])
def test_some_mask_holds_none_of_the_bits(width, dimensions):
    rng, masks = np.random.default_rng(1), hamming.code_masks(width, dimensions)
    assert len(masks) == 2**dimensions - 1 and int(np.bitwise_or.reduce(masks)) < 2**width
    for _ in range(300):
        bits = rng.choice(width, dimensions - 1, replace=False)
        assert (masks & np.uint64(sum(1 << int(b) for b in bits)) == 0).any()


@pytest.mark.parametrize(("n_words", "radius", "n_parts"), [(4, 48, 6), (4, 48, 7), (4, 48, 8), (4, 48, 15), (1, 4, 1), (1, 4, 2), (1, 4, 5), (2, 9, 3)])
def test_no_link_is_missed(n_words, radius, n_parts):
    rng = np.random.default_rng(n_parts)
    base = random_rows(rng, 150, n_words)
    rows = np.concatenate([base, *[flipped(rng, base, radius + more) for more in (0, 1)], flipped(rng, flipped(rng, base[:40], radius // 2), radius // 2)])
    rows = np.concatenate([rows, flipped(rng, np.repeat(base[:1], 200, axis=0), max(1, radius // 3))])  # a large group of near copies
    rows = rows[rng.permutation(len(rows))]
    want = least_rows(rows, radius)
    assert len(set(want)) < 440 and (linked(rows, radius, parts_of(64 * n_words, radius, n_parts)) == want).all()


def test_rows_that_agree_in_most_parts_are_compared_whole():
    rng = np.random.default_rng(3)
    rows = random_rows(rng, 500, 4)
    rows[:, 2:] = rows[0, 2:]
    rows = np.concatenate([rows, flipped(rng, rows[:50], 40)])
    assert (linked(rows, 48, parts_of(256, 48, 7)) == least_rows(rows, 48)).all()
    assert list(linked(rows[:0], 48)) == [] and list(linked(rows[:1], 48)) == [0]


def test_few_of_all_pairs_are_compared(monkeypatch):
    """40 thousand rows have 800 million pairs, and four times the rows not sixteen times the comparisons by parts."""
    rng, met = np.random.default_rng(4), []
    rows = random_rows(rng, 40_000, 4)
    rows[20_000:20_100] = flipped(rng, rows[:100], 48)
    link, pairs = hamming._link, hamming.near_pairs
    monkeypatch.setattr(hamming, "_link", lambda rows, i, *rest: met.append(len(i)) or link(rows, i, *rest))
    monkeypatch.setattr(hamming, "near_pairs", lambda a, b, *rest: met.append(len(a) * len(b)) or pairs(a, b, *rest))
    at = linked(rows, 48)
    assert (at[20_000:20_100] == np.arange(100)).all() and len(set(at)) == 39_900
    assert 100 <= sum(met) < 8_000_000


def test_links_of_pairs_of_tiles(spark):
    rng = np.random.default_rng(6)
    base = random_rows(rng, 9000, 4)
    rows = np.concatenate([base, flipped(rng, base[:300], 48), flipped(rng, base[300:600], 49), flipped(rng, np.repeat(base[:1], 300, axis=0), 12)])
    df = spark.createDataFrame([(int(i), r.astype(">u8").tobytes()) for i, r in enumerate(rows)], "cls long, fp binary")
    assert hamming.cut_parts(256, 48, 1 << 13)  # a pair of tiles is searched by masks
    links = simhash.fingerprint_links(df, 48, 4, tile_rows=3300).collect()
    forest = Forest(len(rows))
    forest.link(np.array([r.u for r in links]), np.array([r.v for r in links]))
    want = Forest(len(rows))
    for i, j in hamming.near_pairs(rows, rows, True, 48):
        want.link(i, j)
    assert (forest.roots(np.arange(len(rows))) == want.roots(np.arange(len(rows)))).all()


def test_tiles_meet_in_lines_once_and_few_times_each(spark, monkeypatch):
    """Any two of the 25 tiles share one task, and a row goes to six tasks; by pairs of tiles of such tasks it went to nine."""
    met = spark.createDataFrame([(i, bytes(8)) for i in range(500)], "cls long, fp binary")
    plans = []
    monkeypatch.setattr(simhash, "LEAST_ROWS", 10)
    grouped = type(met.groupBy("cls")).applyInArrow
    monkeypatch.setattr(type(met.groupBy("cls")), "applyInArrow", lambda self, *how: plans.append(self._df) or grouped(self, *how))
    simhash.fingerprint_links(met)
    lines = {}
    for r in plans[0].collect():
        lines.setdefault(r.line, set()).add(r.cls)
    of = {c: frozenset(line for line, rows in lines.items() if c in rows) for c in range(500)}
    assert len(lines) == 30 and len(set(of.values())) == 25 and {len(x) for x in of.values()} == {6}
    assert all(len(a & b) == 1 for a in set(of.values()) for b in set(of.values()) if a != b)
