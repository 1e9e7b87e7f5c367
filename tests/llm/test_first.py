"""Token counts, exact dedup, mixing and BPE on fixtures and on the smallest tables."""

import hashlib
import random

from factorloom.llm import bpe, exact_dedup, mixing, queries, token_counts
from tests.conftest import SF
from tests.llm.util import ODD, docs_of, duck, same, with_clashes

PIECES, WORDS = queries.tokenizer_file("piece_bpe_32k.model"), queries.tokenizer_file("word_bpe_49k.json")


def test_token_counts_equal_a_unigram_library(spark):
    from tokenizers import Tokenizer, models

    scores = token_counts.piece_scores(PIECES)
    vocab = [("<unk>", 0.0), *[(f"<0x{b:02X}>", -1e9) for b in range(256)], *scores.items()]
    known = {w for w, _ in vocab}
    # the library's penalty starts from the least score, so bytes get that score and can't be reached as text
    least = min(scores.values())
    vocab = [(w, least if w not in scores else s) for w, s in vocab]
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    trie = token_counts.CountTrie(scores)
    words = sorted({w for d in docs for w in d.text.split()})
    rng = random.Random(3)
    words = rng.sample(words, min(3000, len(words))) + ["你好吗", "ΣΑΣ", "🙂🙂x", "é" * 9, "q", "zzzzzzzz" * 40]
    odd = 0
    for w in words:
        got, want = trie[token_counts.SPACE_MARK + w], len(library.encode(token_counts.SPACE_MARK + w).ids)
        odd += got != want
        if got != want:  # only ties of equal score may differ, and ours is never longer
            assert got <= want
    assert odd <= len(words) // 200 and known


def test_token_counts_of_documents(spark):
    """Every document's count against the same recurrence written out for each word apart, over every piece length."""
    scores = token_counts.piece_scores(PIECES)
    unknown, longest, counted = min(scores.values()) - token_counts.UNKNOWN_PENALTY, max(map(len, scores)), {}

    def count(word):
        if word not in counted:
            best = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                ways = [(best[end - n][0] + scores[word[end - n : end]], -best[end - n][1] - 1) for n in range(1, min(end, longest) + 1) if word[end - n : end] in scores]
                if word[end - 1] not in scores:
                    ways.append((best[end - 1][0] + unknown, -best[end - 1][1] - len(word[end - 1].encode())))
                top = max(ways)
                best.append((top[0], -top[1]))
            counted[word] = best[-1][1]
        return counted[word]

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_chars) for r in token_counts.token_counts(docs.repartition(5), PIECES).collect()}
    want = {}
    for d in docs.collect():
        words = ["▁" + w.decode() for w in (d.text or "").encode().split()]
        want[d.doc_id] = (len(words), sum(map(count, words)), len(d.text or ""))
    assert got == want


def test_token_counts_odd(spark):
    got = {(r.doc_id, r.n_words) for r in token_counts.token_counts(with_clashes(docs_of(spark, ODD)), PIECES).collect()}
    assert {(2, 0), (3, 0), (4, 0), (5, 1), (None, 6), (8, 30_000), (9, 1)} <= got
    assert token_counts.token_counts(docs_of(spark, []), PIECES).count() == 0


def test_cuckoo_index_against_a_dict():
    rng = random.Random(1)
    index, real = exact_dedup.CuckooIndex(4), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(20_000):
        k = rng.choice(keys)
        if rng.random() < 0.3:
            assert index.delete(k) == (real.pop(k, None) is not None)
        else:
            index.insert(k, step)
            real[k] = step
        assert index.size == len(real)
    assert dict(index.items()) == real and all(index.get(k) == real.get(k) for k in keys)
    assert index.resizes > 3


def test_exact_dedup(spark):
    for docs in (docs_of(spark, ODD), docs_of(spark, []), with_clashes(docs_of(spark, ODD)), spark.read.parquet(f"{SF}/documents.parquet")):
        got = exact_dedup.exact_dedup(docs)
        same(got.toPandas(), duck(queries.ORACLE_SQL["op4_exact_dedup"], documents=docs))


def test_exact_dedup_full_index_and_withdrawal(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_LIVE", 3)
    docs = docs_of(spark, [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(60)])
    same(exact_dedup.exact_dedup(docs).toPandas(), duck(queries.ORACLE_SQL["op4_exact_dedup"], documents=docs))
    gone = spark.createDataFrame([(2,), (5,)], "doc_id long")
    left = exact_dedup.exact_dedup(docs, gone).toPandas()
    assert len(left) == 58 and not set(left["keep_id"]) & {2, 5}


def mixed(docs):
    from pyspark.sql import functions as F

    first = F.round(F.get("copies", F.lit(0))["position"], 6)
    return mixing.plan_mix(docs).select("row.doc_id", "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("passes"), first.alias("position"))


def test_mixing(spark):
    rows = [(i, "w " * (i % 37), f"src{i % 5}" if i % 11 else None) for i in range(400)] + [(900, "w " * 9000, "big"), (None, "a b", "src1"), (900, None, "big"), (3, "w " * 3, "src3"), (3, "w " * 3, "src3"), (70, "", "empty")]
    for docs in (docs_of(spark, rows), with_clashes(docs_of(spark, rows)), docs_of(spark, []), docs_of(spark, ODD), spark.read.parquet(f"{SF}/documents.parquet")):
        got = mixed(docs).toPandas()
        same(got, duck(queries.ORACLE_SQL["op5_mixing"], documents=docs))
    plan = mixing.plan_mix(docs_of(spark, rows)).toPandas()
    assert (plan["taken"] <= 3 * plan["size"]).all() and abs(plan["taken"].sum() - plan["size"].sum()) <= 10
    for _, part in plan.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 1
    for r in plan.itertuples():
        assert sum(c["words"] for c in r.copies) == r.taken and all(0 <= c["position"] <= 1 for c in r.copies)


def test_mixing_buckets_do_not_change_results(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    got = mixed(docs).toPandas()
    same(got, duck(queries.ORACLE_SQL["op5_mixing"], documents=docs))


def test_training_order_follows_the_ramp(spark):
    docs = docs_of(spark, [(i, "w " * 5, f"s{i % 3}") for i in range(3000)])
    plan = mixing.plan_mix(docs, keep=tuple(docs.columns))
    order = [r.source for r in mixing.training_order(plan).collect()]
    half = len(order) // 2
    assert order[:half].count("s0") > order[half:].count("s0") and order[:half].count("s2") < order[half:].count("s2")


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    library.no_padding()
    rows = [*ODD, (20, "<|startoftext|>a<|endoftext|><|endoftext|> <|x|>"), (21, "İstanbul ǅ ﬁ Å Å a\x1cb\x85c d​e"), (22, "don't DON'T 'S 's'd"), (23, "\x00\x7f\xad")]
    own = bpe.WordBpe(WORDS)
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [r[1] or "" for r in rows]
    for text in docs:
        want = library.encode(text, add_special_tokens=False).ids
        ids, decoded = own.encode(text)
        assert list(memoryview(ids).cast("I")) == want
        assert decoded == library.decode(want, skip_special_tokens=False)
    got = bpe.bpe_codes(with_clashes(docs_of(spark, rows)), WORDS, keep_ids=True).collect()
    assert len(got) == len(rows) and bpe.bpe_codes(docs_of(spark, []), WORDS).count() == 0
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {0}
    for w in ("thequickbrown" * 20, "aab" * 50, "ééé" * 9):
        assert own.parts(w) == own.long_parts(w)


def test_order_survives_many_files(spark, tmp_path):
    docs = docs_of(spark, [(i, "w " * (5 + i % 7), f"s{i % 3}") for i in range(3000)])
    order = mixing.training_order(mixing.plan_mix(docs, keep=tuple(docs.columns)))
    want = [r.doc_id for r in order.collect()]
    order.repartitionByRange(16, "doc_id").limit(1).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        order.write.parquet(f"{tmp_path}/ordered")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    back = mixing.with_place(spark.read.parquet(f"{tmp_path}/ordered"), "place").repartition(5)
    assert len({r.f for r in spark.read.parquet(f"{tmp_path}/ordered").selectExpr("input_file_name() f").collect()}) > 8
    assert [r.doc_id for r in back.orderBy("place").collect()] == want and sorted(r.place for r in back.collect()) == list(range(len(want)))
    assert {r.place for r in mixing.with_place(docs, "place").collect()} == {None}


def test_mixing_query_inverts_and_sorts(spark):
    plan = queries.op5_mixing(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" in plan.upper() and plan.lstrip().startswith("Sort")
