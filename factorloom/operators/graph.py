"""The factor graph as DataFrames: encoding of values, edges, the value-to-factor index, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.schema import CATEGORICAL, DOMAINS, TRUTH_EPSILON


@dataclass(frozen=True)
class FactorGraph:
    """weights(wid, is_fixed, init_value), variables(vid, role, init_value, dtype, cardinality),
    factors(fid, func, arity, vifs, wid, feature_value), domains(vid, cardinality, vals) or None."""

    weights: DataFrame
    variables: DataFrame
    factors: DataFrame
    domains: DataFrame | None = None

    def all_domains(self) -> DataFrame:
        if self.domains is not None:
            return self.domains
        return self.variables.sparkSession.createDataFrame([], DOMAINS)


def evidence(variables: DataFrame) -> DataFrame:
    """Adds is_evid: roles of one and over are evidence, observations too."""
    return variables.withColumn("is_evid", F.col("role") >= 1)


def default_domain(cardinality: Column) -> Column:
    """Values 0 .. cardinality - 1 without truthiness."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), cardinality - 1), lambda v: F.struct(v.alias("value"), F.lit(0.0).alias("truthiness")))


def domain_values(graph: FactorGraph) -> DataFrame:
    """(vid, dense, value, truthiness): values of each categorical variable, numbered in the order of its domain."""
    categorical = graph.variables.where(F.col("dtype") == CATEGORICAL).select("vid", "cardinality")
    given = graph.all_domains().select("vid", "vals")
    whole = categorical.join(given, "vid", "left").withColumn("vals", F.coalesce("vals", default_domain(F.col("cardinality"))))
    rows = whole.select("vid", F.posexplode("vals").alias("dense", "v"))
    return rows.select("vid", F.col("dense").cast("bigint").alias("dense"), F.col("v.value").alias("value"), F.col("v.truthiness").alias("truthiness"))


def all_values(graph: FactorGraph) -> DataFrame:
    """domain_values and the values 0 and 1 of booleans, which have no truthiness."""
    boolean = graph.variables.where(F.col("dtype") != CATEGORICAL).select("vid", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("dense"))
    return domain_values(graph).unionByName(boolean.select("vid", "dense", F.col("dense").alias("value"), F.lit(0.0).alias("truthiness")))


def dense_of(rows: DataFrame, graph: FactorGraph, value: str) -> DataFrame:
    """Adds dense to rows(vid, <value>); null where a domain lacks the value.

    Without given domains every value is its own number and nothing is joined (`violations` reports
    values beyond a cardinality); else it is an equi-join on (vid, value).
    """
    if graph.domains is None:
        return rows.withColumn("dense", F.when(F.col(value) >= 0, F.col(value)))
    lookup = all_values(graph).select("vid", F.col("value").alias(value), "dense")
    return rows.join(lookup, ["vid", value], "left")


def initial_assignment(graph: FactorGraph) -> DataFrame:
    """(vid, dense): evidence at its value, all others at dense 0."""
    known = dense_of(evidence(graph.variables).select("vid", "is_evid", "init_value"), graph, "init_value")
    checked = F.when(F.col("dense").isNull(), F.raise_error(F.concat(F.lit("evidence outside the domain of variable "), F.col("vid").cast("string"))).cast("bigint"))
    return known.select("vid", F.when(~F.col("is_evid"), 0).otherwise(checked.otherwise(F.col("dense"))).cast("bigint").alias("dense"))


def edges(graph: FactorGraph) -> DataFrame:
    """(fid, pos, vid, equal_to, equal_dense): one row per factor and position."""
    flat = graph.factors.select("fid", F.explode("vifs").alias("e")).select("fid", "e.pos", "e.vid", "e.equal_to")
    return dense_of(flat, graph, "equal_to").withColumnRenamed("dense", "equal_dense")


def value_factor_index(graph: FactorGraph) -> DataFrame:
    """Distinct (vid, dense, fid): factors of each variable-value; booleans keep all of theirs at dense 0."""
    kinds = graph.variables.select("vid", "dtype")
    at = F.when(F.col("dtype") == CATEGORICAL, F.col("equal_dense")).otherwise(F.lit(0).cast("bigint"))
    return edges(graph).join(kinds, "vid").select("vid", at.alias("dense"), "fid").distinct()


def descriptor(graph: FactorGraph) -> DataFrame:
    """One row of counts: variables (query, evidence), factors, edges, weights, values."""
    v = evidence(graph.variables).agg(
        F.count("*").alias("n_variables"), F.count_if(~F.col("is_evid")).alias("n_query"), F.count_if("is_evid").alias("n_evidence"),
        F.coalesce(F.sum(F.when(F.col("dtype") == CATEGORICAL, F.col("cardinality")).otherwise(1)), F.lit(0)).alias("n_values"),
    )
    f = graph.factors.agg(F.count("*").alias("n_factors"), F.coalesce(F.sum("arity"), F.lit(0)).alias("n_edges"))
    return v.join(f).join(graph.weights.agg(F.count("*").alias("n_weights")))


def violations(graph: FactorGraph) -> DataFrame:
    """(check, n): how many rows break each rule; ids must be 0 .. n-1 once each, references must exist."""
    spark = graph.variables.sparkSession

    def ids(df: DataFrame, key: str, name: str) -> DataFrame:
        counts = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        bad = (F.col("n") != F.col("d")) | ((F.col("n") > 0) & ((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)))
        return counts.select(F.lit(f"{name}_ids").alias("check"), bad.cast("bigint").alias("n"))

    flat = graph.factors.select("fid", F.explode("vifs").alias("e")).select(F.col("e.vid").alias("vid"), F.col("e.equal_to").alias("equal_to"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    found = [
        ids(graph.variables, "vid", "variable"), ids(graph.weights, "wid", "weight"), ids(graph.factors, "fid", "factor"),
        count(flat.join(graph.variables.select("vid"), "vid", "left_anti"), "dangling_variable"),
        count(graph.factors.join(graph.weights.select("wid"), "wid", "left_anti"), "dangling_weight"),
        count(graph.factors.where((F.col("arity") < 1) | (F.size("vifs") != F.col("arity"))), "arity"),
        count(graph.variables.where(~F.col("dtype").isin(0, 1)), "variable_type"),
    ]
    if graph.domains is None:
        beyond = flat.join(graph.variables.select("vid", "cardinality"), "vid").where((F.col("equal_to") < 0) | (F.col("equal_to") >= F.col("cardinality")))
        found.append(count(beyond, "edge_value"))
    else:
        known = dense_of(flat, graph, "equal_to").join(graph.variables.select("vid"), "vid", "left_semi")
        found.append(count(known.where("dense is null"), "edge_value"))
        vals = graph.domains.join(graph.variables.select("vid", "dtype", F.col("cardinality").alias("c")), "vid")
        wrong = (F.col("dtype") != CATEGORICAL) | (F.col("cardinality") != F.col("c")) | (F.size("vals") != F.col("c"))
        found.append(count(vals.where(wrong), "domain_shape"))
        found.append(count(graph.domains.where(F.exists("vals", lambda v: (v["truthiness"] < 0) | (v["truthiness"] > 1))), "truthiness"))
    out = spark.createDataFrame([], "check string, n bigint")
    for part in found:
        out = out.unionByName(part)
    return out


def trainable(graph: FactorGraph, noise_aware: bool = False, learn_non_evidence: bool = False) -> DataFrame:
    """vids whose factors learn: all, those with soft evidence, or those with evidence."""
    if learn_non_evidence:
        return graph.variables.select("vid")
    if not noise_aware:
        return evidence(graph.variables).where("is_evid").select("vid")
    total = domain_values(graph).groupBy("vid").agg(F.sum("truthiness").alias("t"))
    return total.where(F.abs("t") > TRUTH_EPSILON).select("vid")


def range_shards(variables: DataFrame, shards: int) -> DataFrame:
    """(shard, n, lo, hi) of contiguous vid ranges of n div shards + 1 variables; the last ones may be empty."""
    size = variables.agg((F.floor(F.count("*") / shards) + 1).alias("size"))
    return variables.select("vid").join(size).withColumn("shard", F.floor(F.col("vid") / F.col("size"))).groupBy("shard").agg(
        F.count("*").alias("n"), F.min("vid").alias("lo"), F.max("vid").alias("hi")
    )
