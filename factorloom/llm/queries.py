"""The thin opN_ queries over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import bpe, embedding_dedup, exact_dedup, html_text, line_dedup, lm_score, mixing, quality, simhash, token_counts
from factorloom.session import table


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizers keep a file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, all of it; one of fewer files than cores is dealt out first, so that a small file isn't one task."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() <= 2 * cores and 2 * len(df.inputFiles()) < cores
    return df.repartition(cores) if few else df


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(whole(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(whole(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "text", "n_lines", "n_deleted")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.lm_scores(whole(spark, sf_dir, "documents"))
    return scores.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(whole(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(whole(spark, sf_dir, "documents"))
    first = F.get("copies", F.lit(0))["position"]
    found = plan.select("row.doc_id", "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("passes"), F.round(first, 6).alias("position"))
    return found.orderBy("position", "doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(whole(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_codes(whole(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(whole(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(whole(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(whole(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_html": op8_html,
    "op9_simhash": op9_simhash,
    "op10_embeddings": op10_embeddings,
}

_NO_SPACE = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

#: Characters that op2 strips from lines: space, tab, line feed, vertical tab, form feed, carriage return.
_STRIPPED = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: CRC-32 (reflected polynomial 0xEDB88320) over the bits of doc_id as text, lowest bit of each byte first.
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(strlen(coalesce(doc_id::VARCHAR, ''))), lambda i:
            list_transform(range(8), lambda j: (ascii(substr(coalesce(doc_id::VARCHAR, ''), (i + 1)::BIGINT, 1))::BIGINT >> j) & 1))),
            lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"""

ORACLE_SQL = {
    # of rows that share a doc_id, this takes any order; the operator tells them apart by a hash of the text
    "op2_line_dedup": rf"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d WHERE text <> ''),
        t AS (SELECT *, trim(line, {_STRIPPED}) AS body FROM l),
        r AS (SELECT *, body <> '' AND row_number() OVER (PARTITION BY body ORDER BY doc_id ASC NULLS FIRST, place) > 1 AS dead FROM t),
        k AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dead), '') AS text, count(*) AS n_lines,
                     count(*) FILTER (dead) AS n_deleted FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(k.text, d.text) AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted
        FROM d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id""",
    # ' ' stands for the end of a text and a line feed for its start: no word holds either
    "op3_lm_score": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC32} % 5 = 1 AS held_out, regexp_extract_all(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        t AS (SELECT r, held_out, unnest(list_append(words, ' ')) AS w, unnest(list_prepend(chr(10), words)) AS h FROM d),
        ones AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
        befores AS (SELECT h, count(*) AS c FROM t WHERE NOT held_out GROUP BY h),
        twos AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY h, w),
        n AS (SELECT coalesce(sum(c), 0)::BIGINT AS tokens, count(*) AS distinct_words FROM ones),
        p AS (SELECT r, ones.c IS NOT NULL AS known, (coalesce(ones.c, 0) + 0.5::DOUBLE) / (tokens + 0.5::DOUBLE * (distinct_words + 1)) AS base,
                     coalesce(twos.c, 0) AS seen, coalesce(befores.c, 0) AS before
              FROM t CROSS JOIN n LEFT JOIN ones ON t.w = ones.w LEFT JOIN befores ON t.h = befores.h LEFT JOIN twos ON t.h = twos.h AND t.w = twos.w),
        s AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, fsum(log10(base)) AS base_score,
                     fsum(log10((seen + {lm_score.MU}::DOUBLE * base) / (before + {lm_score.MU}::DOUBLE))) AS score FROM p GROUP BY r)
        SELECT doc_id, held_out, n_tokens, n_known, tokens AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score
        FROM d JOIN s ON d.r = s.r CROSS JOIN n""",
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_NO_SPACE}) AS text_sha256 FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k""",
    "op5_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size,
                     ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
        r AS (SELECT *, (3 * source_size)::DOUBLE AS cap, 3 * source_size / weight AS ratio FROM s),
        l AS (SELECT *, ratio < (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM r),
        t AS (SELECT source, source_size, (weight - 2) / 4 AS ramp, round(CASE WHEN capped THEN cap ELSE least(cap, weight * (sum(source_size) OVER ()
                     - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END, 6) AS target FROM l),
        o AS (SELECT doc_id, size, source_size, target, ramp, round(target)::BIGINT AS goal, coalesce(sum(size) OVER (PARTITION BY d.source
                     ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE goal // source_size END AS whole FROM o),
        q AS (SELECT *, greatest(0, least(size, goal - whole * source_size - start)) AS part, start / greatest(goal, 1) AS done FROM p)
        SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken, (CASE WHEN size > 0 THEN whole ELSE 0 END + (part > 0)::INT)::BIGINT AS passes,
               CASE WHEN whole * size + part > 0 THEN round(2 * done / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * done)), 6) END AS position FROM q""",
    "op10_embeddings": """
        WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL
                             AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
              WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
        r(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.v, l.b FROM r JOIN l ON r.c = l.a),
        m AS (SELECT v, min(c) AS c FROM r GROUP BY v), d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT v AS vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, v = c AS kept FROM m LEFT JOIN d ON d.a = m.v""",
}
