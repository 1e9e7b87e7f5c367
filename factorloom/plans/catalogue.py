"""The registered queries over factor graphs, each with the SQL that it must equal where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.factors import BY_NAME
from factorloom.operators import compaction, gibbs, graph, relational
from factorloom.plans import groundings as ground
from factorloom.schema import GibbsConfig
from factorloom.session import Scratch, table
from factorloom.sources import binary, text

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own or the given name."""

    def add(function):
        QUERIES[name or function.__name__] = function
        if sql:
            ORACLE[name or function.__name__] = sql
        return function

    return add


def six(column: str):
    """Rounded to six places and never a negative zero, for exact comparison."""
    return (F.round(column, 6) + 0.0).alias(column)


def _weights(n: int, times: int, by: int, less: int, over: float, fixed: int = 0) -> str:
    return f"SELECT range AS wid, range = {fixed} AS is_fixed, ((range * {times}) % {by} - {less}) / {over}::DOUBLE AS w FROM range({n})"


def _uniform(seed: int, *parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


DOC = f"""
    dw AS ({_weights(9, 7, 9, 4, 8.0)}),
    dv AS (SELECT d.doc_id AS vid, l.doc_id IS NOT NULL AS is_evid, coalesce(l.quality, 0)::BIGINT AS init, lang, n_chars FROM documents d LEFT JOIN labels l USING (doc_id)),
    df AS (SELECT vid * 2 AS fid, vid, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 4 END::BIGINT AS wid, 1.0::DOUBLE AS feature FROM dv
           UNION ALL SELECT vid * 2 + 1, vid, CASE WHEN n_chars < 500 THEN 5 WHEN n_chars < 2000 THEN 6 WHEN n_chars < 8000 THEN 7 ELSE 8 END, ln(1.0::DOUBLE + n_chars) / 8 FROM dv),
    dp AS (SELECT vid, sum(w * feature) AS pot FROM df JOIN dw USING (wid) GROUP BY vid)"""
SEG = f"""
    sw AS ({_weights(125, 13, 17, 8, 6.0, -1)}),
    sv AS (SELECT c_custkey AS vid, c_acctbal > 0 AS is_evid, c_custkey % 5 AS init, c_nationkey FROM customer),
    sf AS (SELECT vid * 5 + v AS fid, vid, v AS dense, c_nationkey * 5 + v AS wid FROM sv, (SELECT range AS v FROM range(5))),
    sp AS (SELECT vid, dense, w AS pot FROM sf JOIN sw USING (wid)),
    sq AS (SELECT vid, dense, pot, exp(pot) / sum(exp(pot)) OVER (PARTITION BY vid) AS prob FROM sp)"""
SOFT = """
    tv AS (SELECT doc_id AS vid, CASE WHEN quality = 1 AND toxic = 0 THEN 0.9 WHEN quality = 1 THEN 0.6 ELSE 0.1 END::DOUBLE AS good FROM labels),
    td AS (SELECT vid, 0::BIGINT AS dense, round(1 - good, 6) AS truthiness FROM tv UNION ALL SELECT vid, 1, good FROM tv)"""
CONV = f"""
    cw AS ({_weights(7, 5, 7, 3, 2.0, -1)}),
    cv AS (SELECT conv_id, turn, conv_id * 16 + turn AS vid, conv_id % 2 = 0 AS is_evid, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 3 ELSE 5 END::BIGINT AS value FROM conversations),
    cd AS (SELECT vid, turn, v AS value, (CASE WHEN turn = 0 THEN (v - 1) // 2 ELSE (v - 3) // 2 END)::BIGINT AS dense FROM cv, (SELECT unnest([1, 3, 5])::BIGINT AS v) WHERE turn = 0 OR v > 1),
    ce AS (SELECT vid * 8 + (value - 1) // 2 AS fid, 0 AS pos, vid, value AS equal_to, 4 + (value - 1) // 2 AS wid FROM cd
           UNION ALL SELECT a.vid * 8 + 4 + (x - 3) + (y - 3) // 2, p, CASE p WHEN 0 THEN a.vid ELSE b.vid END, CASE p WHEN 0 THEN x ELSE y END, (x - 3) + (y - 3) // 2
           FROM cv a JOIN cv b ON b.vid = a.vid + 1 AND a.turn < 15, (SELECT unnest([3, 5])::BIGINT AS x), (SELECT unnest([3, 5])::BIGINT AS y), (SELECT unnest([0, 1]) AS p)),
    cx AS (SELECT e.*, d.dense AS equal_dense FROM ce e LEFT JOIN cd d ON e.vid = d.vid AND e.equal_to = d.value)"""
ORD = f"""
    ow AS ({_weights(10, 3, 10, 4, 4.0)}),
    top AS (SELECT max(o_orderkey) + 1 AS n FROM orders),
    ov AS (SELECT o_orderkey AS vid, o_orderstatus <> 'P' AS is_evid, (o_orderpriority LIKE '1%')::BIGINT AS now FROM orders
           UNION ALL SELECT n + c_custkey, c_custkey % 3 = 0, (c_acctbal > 5000)::BIGINT FROM customer, top),
    op AS (SELECT o_orderkey AS o, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o2, n + o_custkey AS c FROM orders, top),
    os AS (SELECT o, o2, c, o % 10 AS wid, a.now = 1 AS s1, b.now = 1 AS s2, h.now = 1 AS s3 FROM op JOIN ov a ON a.vid = o JOIN ov b ON b.vid = o2 JOIN ov h ON h.vid = c WHERE o2 IS NOT NULL)"""


def _value(func: str, a: str = "s1", b: str = "s2", h: str = "s3") -> str:
    rules = f"((NOT {a} OR {h})::INT + (NOT {b} OR {h})::INT)"
    return {
        "imply_natural": f"CASE WHEN NOT ({a} AND {b}) THEN 0 WHEN {h} THEN 1 ELSE -1 END", "or": f"CASE WHEN {a} OR {b} OR {h} THEN 1 ELSE -1 END",
        "and": f"CASE WHEN {a} AND {b} AND {h} THEN 1 ELSE -1 END", "istrue": f"CASE WHEN {a} AND {b} AND {h} THEN 1 ELSE -1 END",
        "equal": f"CASE WHEN {a} = {b} AND {b} = {h} THEN 1 ELSE -1 END", "linear": rules, "ratio": f"log2(1 + {rules})", "logical": f"({rules} > 0)::INT",
        "and_categorical": f"({a} AND {b} AND {h})::INT", "imply_mln": f"(NOT ({a} AND {b}) OR {h})::INT",
    }[func]


def _mixed(*sat: str) -> str:
    return "CASE o % 7 " + " ".join(f"WHEN {i} THEN {_value(f, *sat)}" for i, f in enumerate(ground.MIXED)) + " END"


# Loading: sizes, checks, encoding


@query("""WITH """ + CONV + """, f AS (SELECT fid, count(*) AS n FROM ce GROUP BY fid)
    SELECT (SELECT count(*) FROM cv) AS n_variables, (SELECT count(*) FROM cv WHERE NOT is_evid) AS n_query, (SELECT count(*) FROM cv WHERE is_evid) AS n_evidence,
           (SELECT sum(CASE WHEN turn = 0 THEN 3 ELSE 2 END)::BIGINT FROM cv) AS n_values, (SELECT count(*) FROM f) AS n_factors, (SELECT count(*) FROM ce) AS n_edges, 7::BIGINT AS n_weights""")  # fmt: skip
def graph_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.descriptor(ground.conversations_graph(spark, sf_dir))


@query("""WITH """ + CONV + """, f AS (SELECT DISTINCT fid FROM ce),
    b(name, n) AS (SELECT 'variable_ids', (count(*) <> max(vid) + 1 OR min(vid) <> 0)::BIGINT FROM cv UNION ALL SELECT 'weight_ids', 0
        UNION ALL SELECT 'factor_ids', (count(*) <> max(fid) + 1 OR min(fid) <> 0)::BIGINT FROM f UNION ALL SELECT 'dangling_variable', count(*) FROM ce WHERE vid NOT IN (SELECT vid FROM cv)
        UNION ALL SELECT 'dangling_weight', count(*) FROM ce WHERE wid NOT IN (SELECT wid FROM cw) UNION ALL SELECT unnest(['arity', 'variable_type', 'edge_value', 'domain_shape', 'truthiness']), 0)
    SELECT name AS "check", n::BIGINT AS n FROM b""")  # fmt: skip
def safety_check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.violations(ground.conversations_graph(spark, sf_dir))


@query("SELECT r_regionkey::BIGINT + 1 AS num_weights, r_regionkey::BIGINT * 2 AS num_variables, 0::BIGINT AS num_factors, 8::BIGINT AS num_edges FROM region")
def meta_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.parse_meta(table(spark, sf_dir, "region").select(F.format_string("%d,%d,none,8,w.bin,v.bin", F.col("r_regionkey") + 1, F.col("r_regionkey") * 2).alias("value")))


@query("SELECT n_nationkey::BIGINT AS k, unnest([n_nationkey, n_regionkey, 7])::BIGINT AS item FROM nation")
def pgarray_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("{%d,%d,7}", F.col("n_nationkey"), F.col("n_regionkey"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.explode(text.array_fields(line)).alias("item"))


@query("""SELECT l_orderkey AS vid0, l_partkey AS vid1, l_suppkey % 5 AS eq0, l_linenumber::BIGINT AS eq1, l_suppkey AS wid, l_quantity AS feature_value FROM lineitem""")
def factor_tsv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    lines = li.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey")], (F.col("l_suppkey") % 5).cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("string")).alias("value"))
    parsed = text.parse_factors(lines, 12, [0, 0])
    at = lambda i, name: F.get("vifs", F.lit(i))[name]
    return parsed.select(at(0, "vid").alias("vid0"), at(1, "vid").alias("vid1"), at(0, "equal_to").alias("eq0"), at(1, "equal_to").alias("eq1"), "wid", "feature_value")


@query("WITH " + CONV + " SELECT vid, dense, value, 0.0::DOUBLE AS truthiness FROM cd")
def domain_dense_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.domain_values(ground.conversations_graph(spark, sf_dir))


@query("WITH " + SEG + " SELECT vid, dense, dense AS value, 0.0::DOUBLE AS truthiness FROM sf")
def default_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.domain_values(ground.segments_graph(spark, sf_dir))


@query("WITH " + CONV + " SELECT cv.vid, CASE WHEN is_evid THEN cd.dense ELSE 0 END::BIGINT AS dense FROM cv JOIN cd ON cv.vid = cd.vid AND cv.value = cd.value")
def initial_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.initial_assignment(ground.conversations_graph(spark, sf_dir))


@query("WITH " + CONV + " SELECT fid::BIGINT AS fid, pos, vid, equal_to, equal_dense FROM cx")
def edges_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(ground.conversations_graph(spark, sf_dir)).select("fid", "pos", "vid", "equal_to", "equal_dense")


@query("WITH " + CONV + " SELECT DISTINCT vid, equal_dense AS dense, fid::BIGINT AS fid FROM cx")
def value_factor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.value_factor_index(ground.conversations_graph(spark, sf_dir))


@query("WITH " + DOC + ", n AS (SELECT count(*) // 7 + 1 AS s FROM dv) SELECT (vid // s)::BIGINT AS shard, count(*) AS n, min(vid) AS lo, max(vid) AS hi FROM dv, n GROUP BY 1")
def range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.range_shards(ground.documents_graph(spark, sf_dir).variables, 7)


@query("WITH " + DOC + " SELECT vid FROM dv WHERE is_evid")
def trainable_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trainable(ground.documents_graph(spark, sf_dir))


# Potentials, conditionals, draws


def _potential(func: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = ground.orders_graph(spark, sf_dir, func)
        return relational.factor_potentials(g, ground.observed(g)).select("fid", six("value"))

    return run


for _func in BY_NAME:
    query(f"WITH {ORD} SELECT o AS fid, round(({_value(_func)})::DOUBLE, 6) + 0.0::DOUBLE AS value FROM os", f"potential_{_func}")(_potential(_func))


@query("WITH " + ORD + """, one AS (""" + " UNION ALL ".join(
    f"SELECT {v} AS vid, p AS dense, w * ({_mixed(*[('(p = 1)' if i == k else f's{i + 1}') for i in range(3)])}) AS x FROM os JOIN ow USING (wid), (SELECT unnest([0, 1])::BIGINT AS p)"
    for k, v in enumerate(("o", "o2", "c"))) + """), sums AS (SELECT vid, dense, sum(x) AS pot FROM one GROUP BY ALL)
    SELECT vid, p AS dense, round(coalesce(pot, 0)::DOUBLE, 6) + 0.0::DOUBLE AS pot FROM (SELECT vid, unnest([0, 1])::BIGINT AS p FROM ov) v LEFT JOIN sums USING (vid) WHERE pot IS NULL OR sums.dense = p""")  # fmt: skip
def weighted_potential_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.orders_graph(spark, sf_dir)
    return relational.weighted_potentials(g, ground.observed(g), ground.as_w(g.weights)).select("vid", "dense", six("pot"))


@query("WITH " + CONV + """, s AS (SELECT cv.vid, cd.dense AS now FROM cv JOIN cd ON cv.vid = cd.vid AND cv.value = cd.value),
    o AS (SELECT x.vid, x.equal_dense AS dense, x.wid, coalesce(bool_and(t.now = y.equal_dense), true) AS others
          FROM cx x LEFT JOIN cx y ON x.fid = y.fid AND x.pos <> y.pos LEFT JOIN s t ON t.vid = y.vid GROUP BY x.vid, x.equal_dense, x.wid, x.fid)
    SELECT cd.vid, cd.dense, round(coalesce(sum(CASE WHEN others THEN w ELSE 0 END), 0)::DOUBLE, 6) + 0.0::DOUBLE AS pot
    FROM cd LEFT JOIN o ON cd.vid = o.vid AND cd.dense = o.dense LEFT JOIN cw USING (wid) GROUP BY cd.vid, cd.dense""")  # fmt: skip
def weighted_potential_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.conversations_graph(spark, sf_dir)
    return relational.weighted_potentials(g, ground.observed(g), ground.as_w(g.weights)).select("vid", "dense", six("pot"))


@query("WITH " + DOC + " SELECT vid, round(1 / (1 + exp(-2 * pot)), 6) + 0.0::DOUBLE AS prob FROM dp")
def cond_prob_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.documents_graph(spark, sf_dir)
    return relational.conditional(g, graph.initial_assignment(g), ground.as_w(g.weights)).where("dense = 1").select("vid", six("prob"))


@query("WITH " + SEG + " SELECT vid, dense, round(prob, 6) + 0.0::DOUBLE AS prob FROM sq")
def cond_prob_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.segments_graph(spark, sf_dir)
    return relational.conditional(g, graph.initial_assignment(g), ground.as_w(g.weights)).select("vid", "dense", six("prob"))


DRAWN = ", dd AS (SELECT vid, CASE WHEN " + _uniform(3, "'0'", "vid") + " * (1 + exp(-2 * pot)) < 1 THEN 1 ELSE 0 END::BIGINT AS dense FROM dp)"


@query("WITH " + DOC + DRAWN + " SELECT vid, dense FROM dd")
def draw_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.documents_graph(spark, sf_dir)
    return relational.draw_booleans(g, graph.initial_assignment(g), ground.as_w(g.weights), seed=3)


@query("WITH " + SEG + f", c AS (SELECT *, sum(prob) OVER (PARTITION BY vid ORDER BY dense) AS upto, {_uniform(5, chr(39) + '0' + chr(39), 'vid')} AS u FROM sq) "
       "SELECT vid, coalesce(min(CASE WHEN upto >= u THEN dense END), max(dense))::BIGINT AS dense FROM c GROUP BY vid")  # fmt: skip
def draw_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.segments_graph(spark, sf_dir)
    return relational.draw_categorical(g, graph.initial_assignment(g), ground.as_w(g.weights), seed=5)


@query("WITH " + SOFT + f", c AS (SELECT *, sum(truthiness) OVER (PARTITION BY vid ORDER BY dense) AS upto, {_uniform(7, chr(39) + '0' + chr(39), 'vid')} AS u FROM td) "
       "SELECT vid, coalesce(min(CASE WHEN upto >= u THEN dense END), 0)::BIGINT AS dense FROM c GROUP BY vid")  # fmt: skip
def draw_soft_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.draw_soft_evidence(ground.soft_documents_graph(spark, sf_dir), seed=7)


@query("WITH " + DOC + DRAWN + " SELECT vid, CASE WHEN is_evid THEN init ELSE dense END::BIGINT AS dense, CASE WHEN is_evid THEN 'hard' ELSE 'gibbs' END AS how FROM dv JOIN dd USING (vid)")
def evid_chain_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.documents_graph(spark, sf_dir)
    return relational.evidence_chain(g, graph.initial_assignment(g), ground.as_w(g.weights), seed=3)


# Learning steps

GRADIENT = DOC + DRAWN + """, gr AS (SELECT df.vid, df.fid, wid, 1.0::DOUBLE AS scale, (2 * dense - 1) * feature - (2 * init - 1) * feature AS g, is_evid
    FROM df JOIN dd USING (vid) JOIN dv USING (vid) JOIN dw USING (wid) WHERE NOT is_fixed)"""


def _document_gradients(spark: SparkSession, sf_dir: str, learn_non_evidence: bool = False):
    g = ground.documents_graph(spark, sf_dir)
    start = graph.initial_assignment(g)
    free = Scratch(spark, "free").keep(relational.draw_booleans(g, start, ground.as_w(g.weights), seed=3))  # read by touches and gradients
    return g, relational.gradients(g, free, start, relational.sgd_touches(g, free, learn_non_evidence=learn_non_evidence))


@query("WITH " + GRADIENT + " SELECT vid, fid, wid, scale, round(g, 6) + 0.0::DOUBLE AS g FROM gr WHERE is_evid")
def factor_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_gradients(spark, sf_dir)[1].select("vid", "fid", "wid", "scale", six("g"))


@query("WITH " + GRADIENT + " SELECT vid, fid, wid, scale, round(g, 6) + 0.0::DOUBLE AS g FROM gr")
def learn_non_evidence_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_gradients(spark, sf_dir, learn_non_evidence=True)[1].select("vid", "fid", "wid", "scale", six("g"))


@query("WITH " + SEG + """, d AS (SELECT vid, init, (vid * 7 + 3) % 5 AS drawn FROM sv WHERE is_evid)
    SELECT vid, vid * 5 + init AS fid, init::BIGINT AS evidence_value, 1.0::DOUBLE AS scale FROM d UNION ALL SELECT vid, vid * 5 + drawn, init, 1.0 FROM d WHERE drawn <> init""")  # fmt: skip
def sgd_categorical_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.segments_graph(spark, sf_dir)
    return relational.sgd_touches(g, g.variables.select("vid", ((F.col("vid") * 7 + 3) % 5).alias("dense")))


@query("WITH " + SOFT + """ SELECT vid, vid * 2 + dense AS fid, dense AS evidence_value, truthiness AS scale FROM td WHERE truthiness > 1e-6
    UNION ALL SELECT vid, vid * 2 + vid % 2, dense, truthiness FROM td WHERE truthiness > 1e-6 AND dense <> vid % 2""")  # fmt: skip
def sgd_noise_aware_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.soft_documents_graph(spark, sf_dir)
    return relational.sgd_touches(g, g.variables.select("vid", (F.col("vid") % 2).alias("dense")), noise_aware=True)


def _updated(update):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g, found = _document_gradients(spark, sf_dir)
        one = found.groupBy("wid").agg(F.avg("g").alias("g")).join(ground.as_w(g.weights), "wid")
        return one.select("wid", update(F.col("w"), F.col("g"), 0.1, 0.01).alias("w")).select("wid", six("w"))

    return run


_ONE = "WITH " + GRADIENT + ", one AS (SELECT wid, avg(g) AS g, any_value(w) AS w FROM gr JOIN dw USING (wid) WHERE is_evid GROUP BY wid) "
query(_ONE + "SELECT wid, round(w / (1 + 0.01::DOUBLE * 0.1::DOUBLE) - 0.1::DOUBLE * g, 6) + 0.0::DOUBLE AS w FROM one", "weight_update_l2")(_updated(relational.update_l2))
query(_ONE + "SELECT wid, round(w + CASE WHEN w < 0 THEN 0.01::DOUBLE ELSE 0 END - 0.1::DOUBLE * g, 6) + 0.0::DOUBLE AS w FROM one", "weight_update_l1")(_updated(relational.update_l1))


def _copies(spark: SparkSession, sf_dir: str):
    w = ground.documents_graph(spark, sf_dir).weights
    return w, w.select("wid", "init_value", F.explode(F.array(*map(F.lit, range(3)))).alias("copy")).select("copy", "wid", (F.col("init_value") + F.col("copy") * 0.5 * F.col("wid")).alias("w"))


COPIES = DOC + ", cp AS (SELECT copy, wid, is_fixed, w + copy * 0.5::DOUBLE * wid AS w FROM dw, (SELECT unnest([0, 1, 2]) AS copy)), av AS (SELECT wid, avg(w) AS m FROM cp GROUP BY wid)"


@query("WITH " + COPIES + " SELECT wid, round(m, 6) + 0.0::DOUBLE AS w FROM av")
def weights_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.average_weights(_copies(spark, sf_dir)[1]).select("wid", six("w"))


@query("WITH " + COPIES + " SELECT copy, wid, round(CASE WHEN is_fixed THEN w ELSE m END, 6) + 0.0::DOUBLE AS w FROM cp JOIN av USING (wid)")
def weights_broadcast_nonfixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, copies = _copies(spark, sf_dir)
    return relational.broadcast_nonfixed(copies, relational.average_weights(copies), weights).select("copy", "wid", six("w"))


@query("WITH " + COPIES + " SELECT round(max(abs(m - w)) / 0.1::DOUBLE, 6) AS lmax, round(sqrt(sum((m - w) * (m - w))) / 0.1::DOUBLE, 6) AS l2 FROM av JOIN dw USING (wid)")
def weight_delta_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, copies = _copies(spark, sf_dir)
    return relational.delta_norms(ground.as_w(weights), relational.average_weights(copies), 0.1).select(F.round("lmax", 6).alias("lmax"), F.round("l2", 6).alias("l2"))


@query("WITH " + DOC + " SELECT wid, w FROM dw ORDER BY wid LIMIT 10")
def weights_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.snippet(ground.as_w(ground.documents_graph(spark, sf_dir).weights), "wid")


# Results of sampling: tallies made from a column stand for those of a run

TALLY = DOC + """, ta AS (SELECT vid, 1::BIGINT AS dense, sum(n_chars % (20 + 7 * c))::BIGINT AS n FROM dv, (SELECT unnest([0, 1]) AS c) GROUP BY vid),
    ma AS (SELECT vid, 1::BIGINT AS value, round(n / 47::DOUBLE, 6) AS prob FROM ta JOIN dv USING (vid) WHERE NOT is_evid)"""


def _tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return docs.select("copy", F.col("doc_id").alias("vid"), F.lit(1).cast("bigint").alias("dense"), (F.col("n_chars") % (20 + 7 * F.col("copy"))).alias("n"))


@query("WITH " + TALLY + " SELECT vid, dense, n FROM ta")
def tally_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.merge_tallies(_tallies(spark, sf_dir))


@query("WITH " + TALLY + " SELECT vid, value, prob FROM ma")
def marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.documents_graph(spark, sf_dir)
    of = g.variables.select("vid", F.lit(47).cast("bigint").alias("n"))
    return relational.marginals(g, tally_merge(spark, sf_dir), of).select("vid", "value", six("prob"))


@query("WITH " + TALLY + " SELECT b AS bin, count(prob)::BIGINT AS n FROM (SELECT range AS b FROM range(10)) LEFT JOIN ma ON b = least(floor(prob * 10), 9) GROUP BY b")
def calibration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.calibration(marginals(spark, sf_dir))


@query("WITH " + TALLY + " SELECT vid, value, prob FROM ma ORDER BY vid LIMIT 10")
def marginals_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.snippet(marginals(spark, sf_dir), "vid", "value")


# Structure and compaction


@query("WITH " + ORD + """, k AS (SELECT c, min(o) AS least FROM os GROUP BY c)
    SELECT ov.vid, coalesce(x.least, ov.vid) AS component FROM ov LEFT JOIN (SELECT o AS vid, least FROM os JOIN k USING (c) UNION SELECT o2, least FROM os JOIN k USING (c) UNION SELECT c, least FROM k) x USING (vid)""")  # fmt: skip
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gibbs.component_of(ground.orders_graph(spark, sf_dir))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("vid"), (F.col("l_returnflag") == "R").cast("bigint").alias("value"))


@query("SELECT l_suppkey AS vid, round(avg((l_returnflag = 'R')::INT), 6) AS mean FROM lineitem GROUP BY 1")
def sample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.sample_means(_samples(spark, sf_dir)).select("vid", six("mean"))


@query("""WITH m AS (SELECT l_suppkey AS vid, avg((l_returnflag = 'R')::INT) AS p FROM lineitem GROUP BY 1)
    SELECT vid AS vid_i, vid AS vid_j, round(CASE WHEN p > 0.99 THEN 10 WHEN p < 0.01 THEN -10 ELSE ln(p / (1 - p)) END, 6) + 0.0::DOUBLE AS weight FROM m""")  # fmt: skip
def logit_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "component bigint, vid_i bigint, vid_j bigint, weight double")
    return compaction.compact_weights(compaction.sample_means(_samples(spark, sf_dir)), none).select("vid_i", "vid_j", six("weight"))


# Runs that SQL can't express; tests hold them against closed forms and enumeration


@query()
def gibbs_learn_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.documents_graph(spark, sf_dir)
    _, tallies, of = gibbs.run_gibbs(g, GibbsConfig(n_learning_epoch=10, n_inference_epoch=50, reg_param=0.0), gibbs.block_count(g))
    return relational.marginals(g, tallies, of)


@query()
def gibbs_noise_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.soft_documents_graph(spark, sf_dir)
    weights, _, _ = gibbs.run_gibbs(g, GibbsConfig(n_learning_epoch=10, n_inference_epoch=1, noise_aware=True), gibbs.block_count(g))
    return weights


@query()
def chromatic_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.conversations_graph(spark, sf_dir)
    return gibbs.chromatic_sweep(g, graph.initial_assignment(g), ground.as_w(g.weights), gibbs.colouring(g), seed=1, epoch=0)


@query("WITH " + CONV + " SELECT fid::BIGINT AS fid, pos, vid, equal_to, wid FROM ce")
def binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground.conversations_graph(spark, sf_dir)
    path = _folder(spark)
    numbered = g.factors.select("func", "arity", "vifs", F.col("fid").alias("wid"), F.col("wid").cast("double").alias("feature_value"))
    binary.write_binary(numbered, "factors", path)
    back = binary.read_binary(spark, "factors", path)
    return back.select(F.col("wid").alias("fid"), F.explode("vifs").alias("e"), F.col("feature_value").cast("bigint").alias("wid")).select("fid", "e.pos", "e.vid", "e.equal_to", "wid")


@query("""WITH x AS (SELECT l_orderkey AS s, l_suppkey AS vid, max((l_returnflag = 'R')::INT) AS v FROM lineitem GROUP BY ALL),
    n AS (SELECT count(DISTINCT s) AS n FROM x), k AS (SELECT s_suppkey AS vid, s_nationkey::BIGINT AS component, sum(v) / any_value(n) AS mean FROM x JOIN supplier ON s_suppkey = vid, n GROUP BY ALL),
    b AS (SELECT a.vid AS vid_i, b.vid AS vid_j, sum(a.v * b.v) AS s FROM x a JOIN x b USING (s) GROUP BY ALL)
    SELECT i.component, i.vid AS vid_i, j.vid AS vid_j, round(coalesce(s, 0) / n - i.mean * j.mean, 6) + 0.0::DOUBLE AS cov
    FROM k i JOIN k j ON i.component = j.component AND i.vid <= j.vid LEFT JOIN b ON b.vid_i = i.vid AND b.vid_j = j.vid, n""")  # fmt: skip
def component_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.covariances(*_returns(spark, sf_dir)).select("component", "vid_i", "vid_j", six("cov"))


def _returns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(samples, components): whether an order had a supplier's part returned, suppliers by nation."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vid"), F.col("s_nationkey").cast("bigint").alias("component"))
    return _samples(spark, sf_dir).groupBy("sample", "vid").agg(F.max("value").alias("value")), suppliers


@query()
def sinco_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse covariances of returned parts within each nation's suppliers."""
    return compaction.sample_inverses(*_returns(spark, sf_dir), lambdas=(0.5, 0.1))


# Files: what is written comes back, and text sinks give the very lines


def _folder(spark: SparkSession) -> str:
    return Scratch(spark, "files").root


def _binary_back(kind: str, rows):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        binary.write_binary(rows(spark, sf_dir), kind, path)
        return binary.read_binary(spark, kind, path)

    return run


def _text_back(write, read, rows):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        write(rows(spark, sf_dir), path)
        return read(spark, path)

    return run


def _lines(write, rows):
    return _text_back(write, lambda spark, path: spark.read.text(path), rows)


def _seg(part: str):
    return lambda spark, sf_dir: getattr(ground.segments_graph(spark, sf_dir), part)


def _conv(part: str):
    return lambda spark, sf_dir: getattr(ground.conversations_graph(spark, sf_dir), part)


SW = "WITH " + SEG + " SELECT wid, is_fixed, w AS init_value FROM sw"
SV = "WITH " + SEG + " SELECT vid, is_evid::TINYINT AS role, init::BIGINT AS init_value, 1::SMALLINT AS dtype, 5::BIGINT AS cardinality FROM sv"
CD = "WITH " + CONV + " SELECT vid, count(*) OVER (PARTITION BY vid) AS cardinality, value, 0.0::DOUBLE AS truthiness FROM cd"
CF = "WITH " + CONV + """, w AS (SELECT fid, wid, list(vid ORDER BY pos) AS vids, list(equal_to ORDER BY pos) AS eqs FROM ce GROUP BY ALL)"""
flat_domains = lambda run: lambda spark, sf_dir: run(spark, sf_dir).select("vid", "cardinality", F.explode("vals").alias("v")).select("vid", "cardinality", "v.value", "v.truthiness")

query(SW, "weights_binary")(_binary_back("weights", _seg("weights")))
query(SV, "variables_binary")(_binary_back("variables", _seg("variables")))
query(CD, "domains_binary")(flat_domains(_binary_back("domains", _conv("domains"))))
query(SW, "weights_text")(_text_back(text.write_weights, text.read_weights, _seg("weights")))
query(SV, "variables_text")(_text_back(text.write_variables, text.read_variables, _seg("variables")))
query(CD, "domains_text")(flat_domains(_text_back(text.write_domains, text.read_domains, _conv("domains"))))
_TAB = "concat_ws(chr(9), {})".format
query("WITH " + SEG + f" SELECT {_TAB('wid, is_fixed::INT, w')} AS value FROM sw", "weights_sink")(_lines(text.write_weights, _seg("weights")))
query("WITH " + SEG + f" SELECT {_TAB('vid, is_evid::INT, init, 1, 5')} AS value FROM sv", "variables_sink")(_lines(text.write_variables, _seg("variables")))
query("WITH " + CONV + ", l AS (SELECT vid, list(value ORDER BY dense) AS v FROM cd GROUP BY vid) SELECT concat_ws(chr(9), vid, len(v), '{' || list_aggregate(v, 'string_agg', ',') || '}', "
      "'{' || list_aggregate(list_transform(v, lambda x: '0.0'), 'string_agg', ',') || '}') AS value FROM l", "domains_sink")(_lines(text.write_domains, _conv("domains")))  # fmt: skip
query(CF + " SELECT concat_ws(chr(9), list_aggregate(vids, 'string_agg', chr(9)), list_aggregate(eqs, 'string_agg', chr(9)), wid, '1.0') AS value FROM w", "factors_sink")(
    lambda spark, sf_dir: _lines(text.write_factors, _conv("factors"))(spark, sf_dir).select("value")
)


@query(SW + " UNION ALL " + SW[SW.index("SELECT wid, is_fixed") :])
def multi_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [_folder(spark), _folder(spark)]
    for path in paths:
        binary.write_binary(ground.segments_graph(spark, sf_dir).weights, "weights", path)
    return binary.read_binary(spark, "weights", paths)


@query("WITH " + CONV + " SELECT count(*)::VARCHAR AS value FROM ce UNION ALL SELECT count(*)::VARCHAR FROM cv")
def count_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.cli import write_count

    g, path = ground.conversations_graph(spark, sf_dir), _folder(spark)
    write_count(g.factors, "factor", f"{path}/factors")
    write_count(g.variables, "variable", f"{path}/variables")
    return spark.read.text([f"{path}/factors", f"{path}/variables"])


@query("WITH " + CONV + " SELECT concat_ws(',', 7, (SELECT count(*) FROM cv), (SELECT count(DISTINCT fid) FROM ce), (SELECT count(*) FROM ce)) AS value")
def meta_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    text.write_meta(ground.conversations_graph(spark, sf_dir), path)
    return spark.read.text(path)


@query("WITH " + SEG + f" SELECT {_TAB('wid, is_fixed::INT, w')} AS value FROM sw UNION ALL SELECT {_TAB('vid, is_evid::INT, init, 1, 5')} FROM sv")
def bin2text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, path = ground.segments_graph(spark, sf_dir), _folder(spark)
    binary.write_binary(g.weights, "weights", f"{path}/w.bin")
    binary.write_binary(g.variables, "variables", f"{path}/v.bin")
    text.write_weights(binary.read_binary(spark, "weights", f"{path}/w.bin"), f"{path}/w")
    text.write_variables(binary.read_binary(spark, "variables", f"{path}/v.bin"), f"{path}/v")
    return spark.read.text([f"{path}/w", f"{path}/v"])


@query("WITH " + DOC + r" SELECT concat_ws(' ', wid, regexp_replace(printf('%.6f', w), '\.?0+$', '')) AS value FROM dw UNION ALL SELECT concat_ws(' ', vid, 1, regexp_replace(printf('%.6f', (n_chars % 64) / 64.0::DOUBLE), '\.?0+$', '')) FROM dv")
def result_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned weights and marginals as files, from values with few binary places."""
    path = _folder(spark)
    probs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vid"), F.lit(1).cast("bigint").alias("value"), (F.col("n_chars") % 64 / 64.0).alias("prob"))
    text.write_results(ground.as_w(ground.documents_graph(spark, sf_dir).weights), probs, path)
    return spark.read.text([f"{path}/inference_result.out.weights.text", f"{path}/inference_result.out.text"])


@query("SELECT min(s_suppkey) OVER (PARTITION BY s_nationkey)::BIGINT AS component, s_suppkey::BIGINT AS vid FROM supplier")
def components_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    lines = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(F.col("s_suppkey").cast("string")), " ").alias("value"))
    lines.select("value").write.text(path)
    return text.read_components(spark, path)


@query("SELECT r_regionkey::BIGINT AS sample, n_nationkey::BIGINT AS vid, ((n_nationkey + r_regionkey) % 2)::BIGINT AS value FROM nation, region")
def samples_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, nation = _folder(spark), table(spark, sf_dir, "nation")
    for i in range(5):
        nation.select(F.concat_ws(" ", F.col("n_nationkey").cast("string"), ((F.col("n_nationkey") + i) % 2).cast("string")).alias("value")).write.text(f"{path}/{i}")
    return text.read_samples(spark, [f"{path}/{i}" for i in range(5)])


# Whole runs against closed forms: what the run should give, and whether it came within the tolerance of a draw's error


def _near(found: str, tolerance: Column | float, digits: int = 6) -> list[Column]:
    """(exact, near): the closed form in column exact, and whether the run's value lies within the tolerance of it."""
    return [(F.round("exact", digits) + 0.0).alias("exact"), (F.abs(F.col(found) - F.col("exact")) <= tolerance).alias("near")]


@query("WITH " + SEG + " SELECT vid, dense AS value, round(prob, 6) + 0.0::DOUBLE AS exact, true AS near FROM sq JOIN sv USING (vid) WHERE NOT is_evid")
def gibbs_infer_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginals of variables without neighbours after 4,000 epochs in two copies and three blocks, to 0.06."""
    g = ground.segments_graph(spark, sf_dir)
    _, tallies, of = gibbs.run_gibbs(g, GibbsConfig(n_inference_epoch=8000, burn_in=5, n_datacopy=2), n_blocks=3)
    exact = relational.conditional(g, graph.initial_assignment(g), ground.as_w(g.weights)).select("vid", F.col("dense").alias("value"), F.col("prob").alias("exact"))
    return relational.marginals(g, tallies, of).join(exact, ["vid", "value"]).select("vid", "value", *_near("prob", 0.06))


@query("""WITH v AS (SELECT c_nationkey::BIGINT AS nation, unnest([0, 1, 2, 3, 4])::BIGINT AS value FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 0)),
    n AS (SELECT c_nationkey AS nation, c_custkey % 5 AS value, count(*) AS k FROM customer WHERE c_acctbal > 0 GROUP BY ALL)
    SELECT nation, value, round(coalesce(k, 0) / sum(coalesce(k, 0)) OVER (PARTITION BY nation), 6) + 0.0::DOUBLE AS exact, true AS near FROM v LEFT JOIN n USING (nation, value)""")  # fmt: skip
def gibbs_learn_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights per nation and segment learnt without penalty: their softmax is the share of each segment in the evidence, to 0.08."""
    g = ground.segments_graph(spark, sf_dir)
    blank = graph.FactorGraph(g.weights.withColumn("init_value", F.lit(0.0)), g.variables, g.factors)
    weights, _, _ = gibbs.run_gibbs(blank, GibbsConfig(n_learning_epoch=400, alpha=0.1, diminish=0.985, reg_param=0.0), n_blocks=1)
    p = relational.conditional(graph.FactorGraph(weights.selectExpr("wid", "false as is_fixed", "w as init_value"), g.variables, g.factors), graph.initial_assignment(g), weights)
    c = table(spark, sf_dir, "customer")
    good = c.where("c_acctbal > 0")
    each = c.select(F.col("c_custkey").alias("vid"), F.col("c_nationkey").cast("bigint").alias("nation"))
    learned = p.join(each, "vid").groupBy("nation", F.col("dense").alias("value")).agg(F.avg("prob").alias("prob"))
    n = good.groupBy(F.col("c_nationkey").cast("bigint").alias("nation"), (F.col("c_custkey") % 5).alias("value")).agg(F.count("*").alias("k"))
    total = good.groupBy(F.col("c_nationkey").cast("bigint").alias("nation")).agg(F.count("*").alias("all"))
    rows = learned.join(total, "nation").join(n, ["nation", "value"], "left").withColumn("exact", F.coalesce("k", F.lit(0)) / F.col("all"))
    return rows.select("nation", "value", *_near("prob", 0.08))


_P0 = "1 / (1 + exp(2 * pot))"  # of value 0, whose potential is the negative of the other's


@query("WITH " + DOC + f", s AS (SELECT vid, unnest([0, 1, 2]) AS epoch, pot FROM dp JOIN dv USING (vid) WHERE NOT is_evid) SELECT vid, CASE WHEN {_P0} >= {_uniform(1, 'epoch', chr(39) + '0' + chr(39), chr(39) + '0' + chr(39), chr(39) + 'evid' + chr(39), 'vid')} "
       "THEN 0 ELSE 1 END::BIGINT AS dense, count(*) AS n FROM s GROUP BY ALL")  # fmt: skip
def swept_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies of three epochs of sweeps by joins."""
    from factorloom.operators.sweeps import Sweeps

    g = ground.documents_graph(spark, sf_dir)
    return Sweeps(g, GibbsConfig()).infer(ground.as_w(g.weights), 3)[0]


@query("WITH " + DOC + f", s AS (SELECT vid, init, CASE WHEN {_P0} >= {_uniform(1, chr(39) + '0' + chr(39), chr(39) + '0' + chr(39), chr(39) + '0' + chr(39), chr(39) + 'free' + chr(39), 'vid')} "
       """THEN 0 ELSE 1 END AS free FROM dp JOIN dv USING (vid) WHERE is_evid), t AS (SELECT wid, count(*) AS times, sum(2 * (free - init) * feature) AS g, sum(feature * feature) AS m
       FROM df JOIN s USING (vid) GROUP BY wid) SELECT wid, round(CASE WHEN m IS NULL OR is_fixed THEN w ELSE w * exp(-times * 0.0001::DOUBLE) - (1 - exp(-0.01::DOUBLE * m)) / m * g END, 5) + 0.0::DOUBLE AS w
       FROM dw LEFT JOIN t USING (wid)""")  # fmt: skip
def swept_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after one epoch of learning by joins."""
    from factorloom.operators.sweeps import Sweeps

    g = ground.documents_graph(spark, sf_dir)
    return Sweeps(g, GibbsConfig()).learn_epoch(ground.as_w(g.weights), 0.01, 0).select("wid", (F.round("w", 5) + 0.0).alias("w"))


@query("WITH " + DOC + f" SELECT vid, CASE WHEN is_evid THEN init WHEN {_P0} >= {_uniform(1, chr(39) + '0' + chr(39), chr(39) + '0' + chr(39), 'vid')} THEN 0 ELSE 1 END::BIGINT AS dense FROM dv JOIN dp USING (vid)")
def chromatic_sweep_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sweep of variables without neighbours, which are all of one colour."""
    g = ground.documents_graph(spark, sf_dir)
    return gibbs.chromatic_sweep(g, graph.initial_assignment(g), ground.as_w(g.weights), gibbs.colouring(g), seed=1, epoch=0)


@query("WITH " + COPIES + ", d AS (SELECT copy, wid, w, (wid + copy + 1) * 0.5::DOUBLE AS n, w + copy * 0.1::DOUBLE + 0.2::DOUBLE AS z FROM dw, (SELECT unnest([0, 1, 2]) AS copy)), "
       "p AS (SELECT wid, any_value(w) AS w, sum(n) AS n, sum(n * (z - w) / (1 - exp(-0.1::DOUBLE * n))) AS s FROM d GROUP BY wid) SELECT wid, round(w + (1 - exp(-0.1::DOUBLE * n)) * s / n, 6) + 0.0::DOUBLE AS w FROM p")  # fmt: skip
def weights_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of three blocks of unlike evidence put together."""
    from factorloom.operators.sweeps import pooled_weights

    before = ground.as_w(ground.documents_graph(spark, sf_dir).weights)
    blocks = before.withColumn("block", F.explode(F.array(*map(F.lit, range(3)))))
    learned = blocks.select(F.lit(0).alias("copy"), F.col("block").cast("bigint").alias("block"), "wid", (F.col("w") + F.col("block") * 0.1 + 0.2).alias("w"), ((F.col("wid") + F.col("block") + 1) * 0.5).alias("n"))
    return pooled_weights(before, learned, 0.1).select("wid", six("w"))


SUP = """WITH x AS (SELECT l_orderkey AS s, l_suppkey AS vid, max((l_returnflag = 'R')::INT) AS v FROM lineitem GROUP BY ALL), n AS (SELECT count(DISTINCT s) AS n FROM x)"""


@query(SUP + """ SELECT s_nationkey::BIGINT AS component, vid AS vid_i, vid AS vid_j, round(25 / (sum(v) / any_value(n) - (sum(v) / any_value(n)) * (sum(v) / any_value(n)) + 10), 6) AS weight
    FROM x JOIN supplier ON s_suppkey = vid, n GROUP BY ALL""")  # fmt: skip
def sinco_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse covariances over the whole path of penalties, whose last is above every covariance of zeros and ones: a diagonal."""
    return compaction.sample_inverses(*_returns(spark, sf_dir)).select("component", "vid_i", "vid_j", six("weight"))


PAIRS = """WITH o AS (SELECT o_orderkey AS s, o_orderkey % 7 AS c, (o_orderstatus = 'F')::INT AS x, (o_orderstatus = 'F' OR o_orderkey % 3 = 0)::INT AS y FROM orders), n AS (SELECT count(*) AS n FROM o),
    m AS (SELECT c, sum(x) / any_value(n) AS mx, sum(y) / any_value(n) AS my, sum(x * y) / any_value(n) AS xy FROM o, n GROUP BY c),
    a AS (SELECT c, mx - mx * mx + 0.01::DOUBLE AS p, my - my * my + 0.01::DOUBLE AS q, xy - mx * my - 0.01::DOUBLE AS r FROM m)"""


def _order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    done = F.col("o_orderstatus") == "F"
    x, y = done.cast("bigint"), (done | (F.col("o_orderkey") % 3 == 0)).cast("bigint")
    pair = F.array(F.struct((F.col("o_orderkey") % 7 * 2).alias("vid"), x.alias("value")), F.struct((F.col("o_orderkey") % 7 * 2 + 1).alias("vid"), y.alias("value")))
    return o.select(F.col("o_orderkey").alias("sample"), F.explode(pair).alias("v")).select("sample", "v.vid", "v.value")


def _pair_inverses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The solver's inverse covariances of components of two, and their closed form (vid_i, vid_j, exact)."""
    s = _order_samples(spark, sf_dir)
    cov = compaction.covariances(s, s.select("vid").distinct().withColumn("component", F.floor(F.col("vid") / 2)))
    cov = Scratch(spark, "pairs").keep(cov)
    wide = cov.groupBy("component").agg(*[F.max(F.when((F.col("vid_i") % 2 == i) & (F.col("vid_j") % 2 == j), F.col("cov"))).alias(n) for i, j, n in ((0, 0, "p"), (1, 1, "q"), (0, 1, "r"))])
    wide = wide.selectExpr("component", "p + 0.01D as p", "q + 0.01D as q", "r - 0.01D as r")
    own = F.when(F.col("vid_i") != F.col("vid_j"), -F.col("r")).when(F.col("vid_i") % 2 == 0, F.col("q")).otherwise(F.col("p"))
    exact = cov.join(wide, "component").select("vid_i", "vid_j", (own * 25 / (F.col("p") * F.col("q") - F.col("r") * F.col("r"))).alias("exact"))
    return compaction.inverse_covariances(cov, lambdas=(0.5, 0.1, 0.01)), exact


@query(PAIRS + """ SELECT (2 * c)::BIGINT AS vid_i, (2 * c + k)::BIGINT AS vid_j, round(CASE k WHEN 0 THEN q ELSE -r END * 25 / (p * q - r * r), 6) AS exact, true AS near FROM a, (SELECT unnest([0, 1]) AS k)
    UNION ALL SELECT 2 * c + 1, 2 * c + 1, round(p * 25 / (p * q - r * r), 6), true FROM a""")  # fmt: skip
def sinco_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of two variables, whose inverse has a closed form: exact, and whether the solver's entry is within a hundredth of it."""
    got, exact = _pair_inverses(spark, sf_dir)
    return got.join(exact, ["vid_i", "vid_j"], "full").select("vid_i", "vid_j", *_near("weight", 0.01 * F.abs("exact")))


@query(PAIRS + """, d AS (SELECT 2 * o_orderkey % 14 AS v, avg((o_orderstatus = 'F')::INT) AS m FROM orders GROUP BY 1 UNION ALL SELECT 2 * o_orderkey % 14 + 1, avg((o_orderstatus = 'F' OR o_orderkey % 3 = 0)::INT) FROM orders GROUP BY 1)
    SELECT v::BIGINT AS vid_i, v::BIGINT AS vid_j, round(CASE WHEN m > 0.99 THEN 10 WHEN m < 0.01 THEN -10 ELSE ln(m / (1 - m)) END, 6) + 0.0::DOUBLE AS exact, true AS near FROM d
    UNION ALL SELECT 2 * c, 2 * c + 1, round(-r * 25 / (p * q - r * r), 6), true FROM a""")  # fmt: skip
def compact_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compacted graph end to end: logits on the diagonal, and beside it the closed form and whether the solver's entry is within a hundredth."""
    got, exact = _pair_inverses(spark, sf_dir)
    found = compaction.compact_weights(compaction.sample_means(_order_samples(spark, sf_dir)), got)
    found = found.join(exact.where("vid_i <> vid_j"), ["vid_i", "vid_j"], "full").withColumn("exact", F.coalesce("exact", "weight"))
    return found.select("vid_i", "vid_j", *_near("weight", 0.01 * F.abs("exact")))


@query("SELECT concat_ws(' ', n_nationkey, n_nationkey + 1, (n_regionkey - 2) / 4.0::DOUBLE) AS value FROM nation")
def compact_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, n = _folder(spark), table(spark, sf_dir, "nation")
    text.write_compact(n.select(F.col("n_nationkey").alias("vid_i"), (F.col("n_nationkey") + 1).alias("vid_j"), ((F.col("n_regionkey") - 2) / 4.0).alias("weight")), path)
    return spark.read.text(path)


@query("WITH " + DOC + " SELECT name AS \"check\", n::BIGINT AS n FROM (VALUES ('variable_ids', 1), ('weight_ids', 1), ('factor_ids', 1), ('arity', 1), ('variable_type', 1), ('edge_value', 1)) t(name, n) "
       "UNION ALL SELECT 'dangling_variable', count(*) FROM df WHERE vid % 10 = 3 UNION ALL SELECT 'dangling_weight', count(*) FROM df WHERE wid = 8")  # fmt: skip
def safety_check_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph broken on purpose: every rule reports it."""
    g = ground.documents_graph(spark, sf_dir)
    least = F.col("fid") == 0
    broken = g.factors.withColumn("arity", F.when(least, 2).otherwise(F.col("arity")).cast("bigint"))
    vifs = F.transform("vifs", lambda e: F.struct(e["pos"].alias("pos"), e["vid"].alias("vid"), F.when(least, 7).otherwise(e["equal_to"]).cast("bigint").alias("equal_to")))
    broken = broken.withColumn("vifs", vifs).withColumn("fid", F.col("fid") + 5)
    variables = g.variables.where("vid % 10 <> 3").withColumn("dtype", F.when(F.col("vid") == 4, 9).otherwise(F.col("dtype")).cast("smallint"))
    return graph.violations(graph.FactorGraph(g.weights.where("wid <> 8").unionByName(g.weights.where("wid = 0")), variables, broken))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
