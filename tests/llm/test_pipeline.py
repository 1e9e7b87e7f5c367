"""The pipeline's stages against brute force on the smallest tables."""

import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from factorloom.llm import queries, quality
from tests.conftest import SF
from tests.llm.test_lines import slow
from tests.llm.test_near import least_reachable, slow_wide
from tests.llm.util import docs_of, with_clashes


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, scored = docs.columns, {r.doc_id: r.selected for r in quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        after = docs.collect()
        if n < 4:
            assert docs.columns == columns
        if n == 0:
            assert Counter(before) - Counter(after) == Counter(r for r in before if not scored[r.doc_id])
        elif n == 1:
            want = slow([(r.doc_id, r.text) for r in before], 10)
            new = {r.doc_id: want[r.doc_id, r.text] for r in before}
            assert {r.doc_id: r.text for r in after} == {i: t for i, (t, dead) in new.items() if not dead or t.strip()}
        elif n == 2:
            fps = [slow_wide(r.text, 5, 4) for r in before]
            links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 48]
            best = least_reachable(len(fps), links, [r.doc_id for r in before])
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, b in zip(before, best, strict=True) if r.doc_id == b)
        elif n == 3:
            size = lambda rs: sum(len(r.text.split()) for r in rs)
            assert set(after) <= set(before) and max(Counter(after).values()) <= 3 and abs(size(after) / size(before) - 1) < 0.3
        else:
            library = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
            want = Counter()
            for r in before:
                ids = library.encode(r.text, add_special_tokens=False).ids
                packed = b"".join(i.to_bytes(4, "little") for i in ids)
                decoded = library.decode(ids, skip_special_tokens=False).encode()
                want[r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()] += 1
            assert Counter(tuple(r)[:4] for r in after) == want
            # before lists the written rows in the order of their files
            assert [r.doc_id for r in sorted(after, key=lambda r: r.position)] == [r.doc_id for r in before]
    ran = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r)[:4] for r in ran) == want and [r.position for r in ran] == list(range(len(ran)))
    assert [r.doc_id for r in ran] == [r.doc_id for r in sorted(after, key=lambda r: r.position)]


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None), (2, ""), (2, ""), (3, "a b c " * 2000)]])
def test_stages_bear_odd_tables(spark, rows):
    docs = with_clashes(docs_of(spark, rows))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert n == 4 or out.columns == docs.columns
        out.count()
