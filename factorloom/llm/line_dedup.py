"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

Lines get ids in sorted order of their hashes; the suffixes of each document's line sequence are then
ranked by their first 1, 2, 4, ... lines, each level from pairs of ranks of the level before, until no
pair repeats: the longest repeat of all documents ends it. Only the distinct pairs are sorted, and a
pair seen once has no rank: nothing longer that starts there can repeat. Suffixes of a rank share a
prefix of m lines: they form one interval of the array whose longest common prefix is at least m. In
each interval the first suffix stays, the prefix is deleted from the others. The greatest such m is a
suffix's reach; a run of n lines is covered by the reaches of its first line and of later ones.

A repeated run counts if it has at least min_words words, 1 unless given. A reach of min_words lines has
them, since blank lines are passed over. Shorter runs with enough words are found by the shortest
long-enough windows that start at, or end at, one of their lines; two overlapping ranks name a window.
At 1 every reach counts and there are no such windows. The pipeline's stage asks for STAGE_WORDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.words import SPACE
from factorloom.session import Scratch, free_name

STAGE_WORDS = 10
_BLANK = " \t\n\x0b\x0c\r"
_DOC = ["doc_id", "k"]


def _key() -> Column:
    """Tells rows of one doc_id with unlike texts apart."""
    return F.xxhash64("doc_id", "text").alias("k")


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, k, pos, at, a, b, words): the lines of docs(doc_id, text) that aren't blank.

    at: number of the line in its text, pos: without blank lines; a, b: two hashes of the line without
    white space at its ends. Rows alike in doc_id and text are one document here.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.struct(F.btrim(x, F.lit(_BLANK)).alias("t"), i.alias("at")))
    rows = docs.select("doc_id", _key(), F.posexplode(F.filter(lines, lambda x: x["t"] != "")).alias("pos", "l"))
    return rows.select(
        *_DOC, "pos", F.col("l.at").alias("at"), F.xxhash64("l.t").alias("a"), F.xxhash64(F.lit(1), "l.t").alias("b"), F.size(F.split("l.t", SPACE)).alias("words")
    )


def suffix_levels(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Of each level j (doc_id, k, pos, r, later): the suffixes whose first 2^j lines occur more than once; level 0 has at and words too.

    r names the interval of suffixes that share these lines, in their order; later: it has a suffix
    before this one in order of doc_id (null first), k, line. The last level is that of the longest repeat.
    """
    place, levels = F.struct(*_DOC, "pos"), []
    rows, by, more = lines, ["a", "b"], ["at", "words"]
    while True:
        found = rows.groupBy(*by).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        found = scratch.keep(found.orderBy(*by).withColumn("_r", F.monotonically_increasing_id()))  # written, so that ranks stay as they are
        if levels and found.isEmpty():
            return levels
        rows = scratch.keep(rows.join(found, by).select(*_DOC, "pos", *more, F.col("_r").alias("r"), (place != F.col("first")).alias("later")))
        levels.append(rows)
        ahead = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(1 << len(levels) - 1, 1 << len(levels) - 1)
        rows, by, more = scratch.keep(rows.select(*_DOC, "pos", "r", F.first("r").over(ahead).alias("next")).where("next is not null")), ["r", "next"], []


def suffix_reaches(levels: list[DataFrame], ranks: int = 0) -> DataFrame:
    """(doc_id, k, pos, at, words, reach): suffixes by the longest prefix of 1, 2, 4, ... lines that an earlier suffix has, null for none.

    With ranks, r0, r1, ... of as many levels too; without, suffixes of no reach are left out.
    """
    every = None
    for j, rows in enumerate(levels):
        own = {c: F.col(c) if j == 0 else F.lit(None).cast("int") for c in ("at", "words")} | {"level": F.lit(j)}
        part = (rows if ranks else rows.where("later")).withColumns(own)
        every = part if every is None else every.unionByName(part)
    made = [F.max(F.when(F.col("level") == j, F.col("r"))).alias(f"r{j}") for j in range(ranks)]
    reach = F.max(F.when(F.col("later"), F.pow(F.lit(2), F.col("level")).cast("int")))
    return every.groupBy(*_DOC, "pos").agg(F.max("at").alias("at"), F.max("words").alias("words"), reach.alias("reach"), *made)


def _windows(rows: DataFrame, levels: int, min_words: int) -> DataFrame:
    """(doc_id, k, start, m, x, y, ats): shortest windows of min_words words from each line on and up to each line.

    m: lines in the window; x, y: ranks that together name its lines; ats: the lines' numbers. rows of
    suffix_reaches with so many levels of ranks.
    """
    rows = rows.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(*_DOC).orderBy("pos")))
    inside = Window.partitionBy(*_DOC, "run").orderBy("pos")
    rows = rows.withColumn("upto", F.sum("words").over(inside))

    def ids(m: int, first: int) -> tuple[Column, Column]:
        """Ranks of the window of m lines that starts `first` lines from here."""
        level = min(m.bit_length() - 1, levels - 1)
        at = lambda shift: F.lead(f"r{level}", shift).over(inside) if shift >= 0 else F.lag(f"r{level}", -shift).over(inside)
        return at(first), at(first + m - (1 << level))

    def pick(ends_here: bool) -> Column:
        step = F.lag if ends_here else F.lead
        chain = None
        for m in range(min_words, 0, -1):
            far = lambda c: step(c, m - 1).over(inside) if m > 1 else F.col(c)  # noqa: B023, E731
            words = F.col("upto") - far("upto") + far("words") if ends_here else far("upto") - F.col("upto") + F.col("words")
            first = 1 - m if ends_here else 0
            x, y = ids(m, first)
            ats = F.array(*[(F.lead("at", first + i) if first + i >= 0 else F.lag("at", -first - i)).over(inside) for i in range(m)])
            made = F.struct((F.col("pos") + first).alias("start"), F.lit(m).alias("m"), x.alias("x"), y.alias("y"), ats.alias("ats"))
            chain = F.when(words >= min_words, made) if chain is None else F.when(words >= min_words, made).otherwise(chain)
        return chain

    found = rows.select(*_DOC, F.array(pick(False), pick(True)).alias("both"))
    found = found.select(*_DOC, F.explode("both").alias("w")).where("w is not null")
    return found.select(*_DOC, "w.*").where("x is not null and y is not null").dropDuplicates([*_DOC, "start", "m"])


def repeated_lines(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """(doc_id, k, dead): numbers of the lines of each document that lie in a later copy of a repeated run.

    Later means after the first copy in order of doc_id (null first), k, line. One row per document
    that has such lines.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = scratch.keep(line_table(docs).dropDuplicates([*_DOC, "pos"]))
    levels = suffix_levels(lines, scratch)
    ranks = min(min_words.bit_length(), len(levels)) if min_words > 1 else 0
    rows = suffix_reaches(levels, ranks)
    rows = scratch.keep(rows) if ranks else rows
    upto = F.max(F.when(F.col("reach") >= min_words, F.col("pos") + F.col("reach"))).over(Window.partitionBy(*_DOC).orderBy("pos"))
    dead = rows.withColumn("upto", upto).where("pos < upto").select(*_DOC, "at")
    if ranks:
        windows = scratch.keep(_windows(rows, ranks, min_words))
        place = F.struct(*_DOC, "start")
        firsts = windows.groupBy("m", "x", "y").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = windows.join(firsts, ["m", "x", "y"]).where(place != F.col("first"))
        dead = dead.unionByName(later.select(*_DOC, F.explode("ats").alias("at"))).distinct()
    return dead.groupBy(*_DOC).agg(F.collect_list("at").alias("dead"))


def dedup_lines(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """(row, text, n_lines, n_deleted) for each row of docs(doc_id, text): row is the struct of its columns, text what is left.

    Null and empty texts stay as they are and have no lines; blank lines count as lines and are never
    deleted. Rows alike in doc_id and text get the same text. Columns of any name pass through in row.
    """
    dead = repeated_lines(docs.select("doc_id", "text"), min_words).select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "dead")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), _key())
    rows = rows.join(dead, (F.col("k") == F.col("_k")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    lines = F.split(F.col("row")["text"], "\n", -1)
    rows = rows.withColumn("lines", lines).withColumn("n", F.when(F.coalesce(F.length(F.col("row")["text"]), F.lit(0)) == 0, 0).otherwise(F.size("lines")))
    kept = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("dead"))
    text = F.when(F.col("dead").isNull(), F.col("row")["text"]).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return rows.select("row", text.alias("text"), F.col("n").cast("long").alias("n_lines"), F.coalesce(F.size("dead"), F.lit(0)).cast("long").alias("n_deleted"))


def without_repeats(docs: DataFrame, min_words: int = STAGE_WORDS) -> DataFrame:
    """docs with the columns they have, text (and n_chars where there is one) without later copies.

    A document that consisted of later copies alone, blank lines aside, is left out.
    """
    found = dedup_lines(docs, min_words)
    found = found.where((F.col("n_deleted") == 0) | (F.btrim("text", F.lit(_BLANK)) != ""))
    text, chars = free_name(docs, "new_text"), free_name(docs, "new_chars")
    flat = found.select("row.*", F.col("text").alias(text), F.when(F.col("n_deleted") > 0, F.length("text")).alias(chars))
    new = {"text": F.col(text), "n_chars": F.coalesce(F.col(chars).cast("long"), F.col("n_chars")) if "n_chars" in docs.columns else None}
    return flat.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])
