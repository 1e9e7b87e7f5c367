"""Line dedup against comparing every pair of suffixes."""

import random

import pytest

from factorloom.llm import line_dedup, queries
from tests.conftest import SF
from tests.llm.util import ODD, docs_of, duck, same, with_clashes

BLANK = " \t\n\x0b\x0c\r"


def slow(rows, least):
    """New texts by doc: every line inside a run that an earlier suffix starts with, if long enough."""
    rows = sorted({(r[0], r[1]) for r in rows}, key=lambda r: -1 if r[0] is None else r[0])
    seqs = []
    for _, t in rows:
        seqs.append([(i, x.strip(BLANK)) for i, x in enumerate((t or "").split("\n")) if x.strip(BLANK)])
    words = lambda s: len([w for w in s.translate({9: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w])
    starts = {}
    dead = [set() for _ in rows]
    for d, seq in enumerate(seqs):
        for s in range(len(seq)):
            best = 0
            for e, t in starts.get(seq[s][1], []):
                n = 0
                while s + n < len(seq) and t + n < len(seqs[e]) and seq[s + n][1] == seqs[e][t + n][1]:
                    n += 1
                best = max(best, n)
            if sum(words(x) for _, x in seq[s : s + best]) >= least:
                dead[d].update(i for i, _ in seq[s : s + best])
            starts.setdefault(seq[s][1], []).append((d, s))
    return {r: (None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in dead[d]), len(dead[d])) for d, r in enumerate(rows)}


def check(spark, rows, least):
    got = line_dedup.dedup_lines(with_clashes(docs_of(spark, rows)), least).collect()
    want = slow(rows, least)
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_deleted) == want[r.row.doc_id, r.row.text], r.row.doc_id


@pytest.mark.parametrize("least", [10, 3, 1])
def test_random_runs(spark, least):
    rng = random.Random(least)
    pool = [" ".join("w%d" % rng.randrange(50) for _ in range(rng.randrange(1, 6))) for _ in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    rows += [(100, "x y z " * 5 + "\n" + "tail one"), (101, "\n" + "x y z " * 5 + "\ntail one\r\nown"), (102, None), (103, ""), (102, "second text of one id and more words than ten in it")]
    check(spark, rows, least)


def test_given_documents_and_odd_rows(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 10)
    check(spark, ODD, 10)
    check(spark, [], 10)


def test_query_deletes_short_runs(spark, tmp_path):
    rows = [(1, "Contact us\nown one"), (2, "own two\n\nContact us\nAll rights"), (3, "Contact us\nAll rights\n*"), (4, "*"), (None, "All rights")]
    rows += [(i, "\n".join(f"l{x}" for x in range(40))) for i in (7, 8)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_deleted) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: v for (i, _), v in slow(rows, 1).items()}
    assert got[2] == ("own two\n", 2) and got[3] == ("*", 2) and got[4] == ("", 1) and got[8] == ("", 40)


def test_query_doubles_to_longest_repeat(spark, tmp_path, monkeypatch):
    """The query's lines go by intervals of up to the longest repeat; without intervals none goes."""
    rows = [(1, "\n".join(f"l{x}" for x in range(40))), (2, "own\n" + "\n\n".join(f" l{x}" for x in range(3, 40))), (3, "l5\nl6\nl7\nl8\nl30\nl31\nelse"), (None, "l39")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    seen, make = [], line_dedup.suffix_reaches

    def reaches(levels, ranks=0):
        seen.append(make(levels, ranks))
        return seen[-1]

    monkeypatch.setattr(line_dedup, "suffix_reaches", reaches)
    got = {r.doc_id: r.n_deleted for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 37, 3: 6, None: 0}
    reach = {(r.doc_id, r.pos): r.reach for r in seen[0].collect()}
    # 37 lines are alike: 32 of them at the first, a half of what is left at each later one
    assert [reach[2, p] for p in (1, 6, 7, 21, 22, 30, 36, 37)] == [32, 32, 16, 16, 16, 8, 2, 1]
    assert [reach[3, p] for p in range(6)] == [4, 2, 2, 1, 2, 1] and reach[1, 39] == 1 and (1, 5) not in reach
    monkeypatch.setattr(line_dedup, "suffix_reaches", lambda levels, ranks=0: make(levels, ranks).where("false"))
    assert not any(r.n_deleted for r in queries.op2_line_dedup(spark, str(tmp_path)).collect())


def test_stage(spark):
    line = "one two three four five six seven eight nine ten eleven"
    docs = docs_of(spark, [(1, line), (2, f"own\n{line}"), (3, line), (4, ""), (5, None)])
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.without_repeats(docs).collect()}
    assert got == {1: (line, len(line)), 2: ("own", 3), 4: ("", 0), 5: (None, 0)}
    assert line_dedup.without_repeats(docs).columns == docs.columns


def test_query_equals_sql(spark, tmp_path):
    rows = [r for r in ODD if r != (5, "One")] + [(20, "One\n\n \x0bThe cat sat on the mat.\x0c\r\nend\n"), (21, "\n\n"), (22, "end")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (SF, str(tmp_path)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        same(queries.op2_line_dedup(spark, folder).toPandas(), duck(queries.ORACLE_SQL["op2_line_dedup"], documents=docs))
