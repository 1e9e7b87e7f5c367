"""64-bit ids beside nulls come out of every operator as they went in."""

import pytest

from factorloom.llm import bpe, exact_dedup, html_text, line_dedup, lm_score, mixing, quality, queries, simhash, token_counts
from tests.llm.util import BIG, docs_of

IDS = [BIG, BIG + 1, None, -BIG, 7]
ROWS = [(i, f"text number {n} of some {'more ' * n}words\nline {n}", f"s{n % 2}") for n, i in enumerate(IDS)]
RUNS = {
    "op1": lambda spark, d: token_counts.token_counts(d, queries.tokenizer_file("piece_bpe_32k.model")),
    "op2": lambda spark, d: line_dedup.dedup_lines(d).select("row.doc_id"),
    "op3": lambda spark, d: lm_score.lm_scores(d),
    "op4": lambda spark, d: exact_dedup.exact_dedup(d),
    "op5": lambda spark, d: mixing.plan_mix(d).select("row.doc_id"),
    "op6": lambda spark, d: quality.score_quality(d, spark.createDataFrame([(BIG, 1, 0), (BIG + 1, 0, 0)], "doc_id long, quality int, toxic int")),
    "op7": lambda spark, d: bpe.bpe_codes(d, queries.tokenizer_file("word_bpe_49k.json")),
    "op9": lambda spark, d: simhash.simhash_components(d),
    "near-dedup stage": lambda spark, d: simhash.drop_near_copies(d),
    "line stage": lambda spark, d: line_dedup.without_repeats(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_ids_survive(spark, name):
    docs = docs_of(spark, ROWS).coalesce(1)
    got = RUNS[name](spark, docs).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, IDS))
    if name == "op4":
        assert all(r.kept and r.keep_id == r.doc_id for r in got)
    if name == "op9":
        assert all(r.component_id == r.doc_id for r in got)


def test_page_ids_survive(spark):
    pages = spark.createDataFrame([(i, "https://h.example/", f"<p>x{n}</p>") for n, i in enumerate(IDS)], "page_id long, url string, html string").coalesce(1)
    got = {(r.page_id, r.text) for r in html_text.extract_pages(pages).collect()}
    assert got == {(i, f"x{n}") for n, i in enumerate(IDS)}


def test_near_dedup_of_ids_with_several_texts(spark):
    same = "one two three four five six seven eight"
    rows = [(3, same), (5, same), (5, "quite other words are in here now and stay"), (None, "null ids one two three four"), (None, "null ids one two three four"), (None, None), (9, "")]
    got = [(r.doc_id, r.text) for r in simhash.drop_near_copies(docs_of(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(3, same), (5, rows[2][1]), (None, "null ids one two three four"), (9, "")]))
