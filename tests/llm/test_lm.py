"""The backoff automaton against a dictionary model written out per token."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from factorloom.llm import lm_score, queries
from tests.conftest import SF
from tests.llm.util import ODD, docs_of, duck, same, with_clashes


def slow(rows, mu):
    cut = lambda t: (t or "").encode().lower().split()
    held = [zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 5 == 1 for r in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for r, h in zip(rows, held, strict=True):
        if not h:
            w = [*cut(r[1]), None]
            uni.update(w)
            ctx.update([0, *w[:-1]])
            bi.update(zip([0, *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    out = []
    for r, h in zip(rows, held, strict=True):
        w = [*cut(r[1]), None]
        base = score = 0.0
        prev = 0
        for x in w:
            p = (uni[x] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            score += math.log10((bi[prev, x] + mu * p) / (ctx[prev] + mu))
            prev = x
        out.append((r[0], h, len(w), sum(uni[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_chars", [10**7, 3000])
def test_scores(spark, block_chars):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for docs in (rows, ODD, [(6, "a b")], []):
        got = lm_score.lm_scores(with_clashes(docs_of(spark, docs)), block_chars=block_chars).collect()
        got = [(*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in got]
        want = slow(docs, lm_score.MU)
        for a, b in zip(sorted(got, key=str), want, strict=True):
            assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9, atol=2e-6)


def test_every_state_sums_to_one():
    block = lm_score.Block(["a b a c", "b a b"], [False, False])
    words, pairs = block.totals(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    n, v = int(words[:-1].sum()), int((words[:-1] > 0).sum())
    model = lm_score.Automaton(block, words, pairs, n, v, 5.0)
    for state in range(block.width):
        if state == block.width - 2:
            continue  # nothing follows an end
        some = np.arange(block.width - 1)
        gained, _ = model.step(np.full(len(some), state), some)
        unknown = 0.5 / (n + 0.5 * (v + 1)) * 10 ** model.fail[state]
        assert abs((10.0**gained).sum() + unknown - 1) < 1e-9


def test_query_equals_sql(spark, tmp_path):
    docs_of(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (SF, str(tmp_path)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        same(queries.op3_lm_score(spark, folder).toPandas(), duck(queries.ORACLE_SQL["op3_lm_score"], documents=docs))
