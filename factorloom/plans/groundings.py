"""Factor graphs grounded from the given tables by projections and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.operators.graph import FactorGraph
from factorloom.schema import FUNCTIONS
from factorloom.session import table

LANGS = ("en", "de", "fr", "es")
MIXED = ("imply_natural", "imply_mln", "linear", "ratio", "logical", "or", "and")


def weight_table(spark: SparkSession, n: int, times: int, by: int, less: int, over: float, fixed: int = 0) -> DataFrame:
    """(wid, is_fixed, init_value): ((wid * times) mod by - less) / over, weight `fixed` being fixed."""
    value = (F.col("id") * times % by - less) / F.lit(float(over))
    return spark.range(n).select(F.col("id").alias("wid"), (F.col("id") == fixed).alias("is_fixed"), value.alias("init_value"))


def as_w(weights: DataFrame) -> DataFrame:
    return weights.select("wid", F.col("init_value").alias("w"))


def _vifs(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("pos"), v.cast("bigint").alias("vid"), e.cast("bigint").alias("equal_to")) for i, (v, e) in enumerate(pairs)])


def _factor(fid: Column, func: str, pairs: list, wid: Column, feature: Column | None = None) -> list[Column]:
    return [
        fid.cast("bigint").alias("fid"), F.lit(FUNCTIONS[func]).cast("smallint").alias("func"), F.lit(len(pairs)).cast("bigint").alias("arity"),
        _vifs(*pairs).alias("vifs"), wid.cast("bigint").alias("wid"), (F.lit(1.0) if feature is None else feature).alias("feature_value"),
    ]


def _variable(vid: Column, role: Column, init: Column, dtype: int, card: Column) -> list[Column]:
    return [
        vid.cast("bigint").alias("vid"), role.cast("tinyint").alias("role"), init.cast("bigint").alias("init_value"),
        F.lit(dtype).cast("smallint").alias("dtype"), card.cast("bigint").alias("cardinality"),
    ]


def lang_no(lang: Column) -> Column:
    chain = F.when(lang == LANGS[0], 0)
    for i, name in enumerate(LANGS[1:], 1):
        chain = chain.when(lang == name, i)
    return chain.otherwise(len(LANGS))


def documents_graph(spark: SparkSession, sf_dir: str) -> FactorGraph:
    """Is a document good? Evidence from labels; one factor for its language and one for its length."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left")
    variables = rows.select(*_variable(F.col("doc_id"), F.col("quality").isNotNull().cast("int"), F.coalesce("quality", F.lit(0)), 0, F.lit(2)))
    bucket = F.when(F.col("n_chars") < 500, 5).when(F.col("n_chars") < 2000, 6).when(F.col("n_chars") < 8000, 7).otherwise(8)
    one = [(F.col("doc_id"), F.lit(1))]
    by_lang = docs.select(*_factor(F.col("doc_id") * 2, "istrue", one, lang_no(F.col("lang"))))
    by_length = docs.select(*_factor(F.col("doc_id") * 2 + 1, "istrue", one, bucket, F.ln(1.0 + F.col("n_chars")) / 8))
    return FactorGraph(weight_table(spark, 9, 7, 9, 4, 8.0), variables, by_lang.unionByName(by_length))


def soft_documents_graph(spark: SparkSession, sf_dir: str) -> FactorGraph:
    """The same question as a categorical variable with soft evidence, a factor per value and language."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    variables = docs.select(*_variable(F.col("doc_id"), F.lit(0), F.lit(0), 1, F.lit(2)))
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0.9).when(F.col("quality") == 1, 0.6).otherwise(0.1)
    pair = F.array(*[F.struct(F.lit(v).cast("bigint").alias("value"), t.alias("truthiness")) for v, t in ((0, F.round(1 - good, 6)), (1, good))])
    domains = labels.select(F.col("doc_id").alias("vid"), F.lit(2).cast("bigint").alias("cardinality"), pair.alias("vals"))
    each = docs.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    factors = each.select(*_factor(F.col("doc_id") * 2 + F.col("v"), "and_categorical", [(F.col("doc_id"), F.col("v"))], lang_no(F.col("lang")) * 2 + F.col("v")))
    return FactorGraph(weight_table(spark, 10, 3, 10, 4, 5.0, fixed=-1), variables, factors, domains)


def segments_graph(spark: SparkSession, sf_dir: str) -> FactorGraph:
    """A customer's segment of five, no domains given; a factor per nation and value. Evidence where the balance is positive."""
    c = table(spark, sf_dir, "customer")
    variables = c.select(*_variable(F.col("c_custkey"), (F.col("c_acctbal") > 0).cast("int"), F.col("c_custkey") % 5, 1, F.lit(5)))
    each = c.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(4))))
    factors = each.select(*_factor(F.col("c_custkey") * 5 + F.col("v"), "and_categorical", [(F.col("c_custkey"), F.col("v"))], F.col("c_nationkey") * 5 + F.col("v")))
    return FactorGraph(weight_table(spark, 125, 13, 17, 8, 6.0, fixed=-1), variables, factors)


def conversations_graph(spark: SparkSession, sf_dir: str) -> FactorGraph:
    """The role of each turn with sparse domains; factors on a turn and on neighbouring turns. Even conversations are evidence."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("vid", F.col("conv_id") * 16 + F.col("turn"))
    value = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 3).otherwise(5)
    first = F.col("turn") == 0
    variables = t.select(*_variable(F.col("vid"), (F.col("conv_id") % 2 == 0).cast("int"), value, 1, F.when(first, 3).otherwise(2)))
    item = lambda v: F.struct(F.lit(v).cast("bigint").alias("value"), F.lit(0.0).alias("truthiness"))
    domains = t.select("vid", F.when(first, 3).otherwise(2).cast("bigint").alias("cardinality"), F.when(first, F.array(item(1), item(3), item(5))).otherwise(F.array(item(3), item(5))).alias("vals"))
    unary = t.withColumn("v", F.explode(F.when(first, F.array(F.lit(1), F.lit(3), F.lit(5))).otherwise(F.array(F.lit(3), F.lit(5)))))
    unary = unary.select(*_factor(F.col("vid") * 8 + (F.col("v") - 1) / 2, "and_categorical", [(F.col("vid"), F.col("v"))], 4 + (F.col("v") - 1) / 2))
    after = t.select(F.col("vid").alias("next"))
    pairs = t.join(after, F.col("next") == F.col("vid") + 1).where(F.col("turn") < 15).withColumn("a", F.explode(F.array(F.lit(3), F.lit(5)))).withColumn("b", F.explode(F.array(F.lit(3), F.lit(5))))
    combo = (F.col("a") - 3) + (F.col("b") - 3) / 2
    pairs = pairs.select(*_factor(F.col("vid") * 8 + 4 + combo, "and_categorical", [(F.col("vid"), F.col("a")), (F.col("next"), F.col("b"))], combo))
    return FactorGraph(weight_table(spark, 7, 5, 7, 3, 2.0, fixed=-1), variables, unary.unionByName(pairs), domains)


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, o2, c): an order, the customer's next one, and the customer's vid after all orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    top = orders.agg((F.max("o_orderkey") + 1).alias("top"))
    return orders.withColumn("o2", nxt).where("o2 is not null").join(top).select(F.col("o_orderkey").alias("o"), "o2", (F.col("top") + F.col("o_custkey")).alias("c"))


def orders_graph(spark: SparkSession, sf_dir: str, func: str | None = None) -> FactorGraph:
    """Urgent orders and rich customers, three variables a factor; func None takes functions in turn. Pending orders and customers are queries."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    urgent = F.col("o_orderpriority").startswith("1").cast("int")
    top = orders.agg((F.max("o_orderkey") + 1).alias("top"))
    of_orders = orders.select(*_variable(F.col("o_orderkey"), (F.col("o_orderstatus") != "P").cast("int"), urgent, 0, F.lit(2)))
    of_customers = customers.join(top).select(*_variable(F.col("top") + F.col("c_custkey"), (F.col("c_custkey") % 3 == 0).cast("int"), (F.col("c_acctbal") > 5000).cast("int"), 0, F.lit(2)))
    pairs = order_pairs(spark, sf_dir)
    where = [(F.col("o"), F.lit(1)), (F.col("o2"), F.lit(1)), (F.col("c"), F.lit(1))]
    factors = pairs.select(*_factor(F.col("o"), func or "and", where, F.col("o") % 10))
    if func is None:
        code = F.element_at(F.array(*[F.lit(FUNCTIONS[f]) for f in MIXED]), (F.col("fid") % len(MIXED) + 1).cast("int"))
        factors = factors.withColumn("func", code.cast("smallint"))
    return FactorGraph(weight_table(spark, 10, 3, 10, 4, 4.0), of_orders.unionByName(of_customers), factors)


def observed(graph: FactorGraph) -> DataFrame:
    """(vid, dense) with every variable at the value that the table has, evidence or not."""
    from factorloom.operators.graph import initial_assignment

    every = FactorGraph(graph.weights, graph.variables.withColumn("role", F.lit(1).cast("tinyint")), graph.factors, graph.domains)
    return initial_assignment(every)
