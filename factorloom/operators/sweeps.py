"""Gibbs sweeps and learning as joins and aggregates, for components that no task can hold.

Variables of a colour share no factor, so a sweep takes colour after colour and draws all variables of
one at once. Factors are written once, in a folder per colour that they touch, with their positions;
a step joins those positions with the variables' state, sums weighted factor values by variable and
value, and draws from the sums. Learning sums the gradients of a colour's visits by weight. Each step
ends in a written table, so lineage stays short and a lost executor costs a reread.

The visits of a colour happen at one standing weight. n visits of step s move a weight by
(1 - exp(-s * n)) times their mean gradient: for small s * n that is the sum of their steps, and for large
ones what visits one by one would come to, which a plain sum would overshoot. n counts a visit by its
scale times the square of its feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.draws import draw_by_cdf, softmax, uniform
from factorloom.functions.factors import factor_value
from factorloom.operators.graph import FactorGraph, domain_values, edges, evidence, initial_assignment
from factorloom.schema import CATEGORICAL, TRUTH_EPSILON, GibbsConfig
from factorloom.session import Scratch


def colouring(graph: FactorGraph, seed: int = 1, max_rounds: int = 400) -> DataFrame:
    """(vid, colour) so that no factor joins two variables of a colour.

    Each round colours the variables whose hash is the least among their uncoloured neighbours.
    """
    scratch = Scratch(graph.variables.sparkSession, "colouring")
    flat = edges(graph).select("fid", "vid")
    near = flat.alias("a").join(flat.alias("b"), "fid").where("a.vid <> b.vid").select(F.col("a.vid").alias("vid"), F.col("b.vid").alias("other")).distinct()
    near, left, done = scratch.keep(near), graph.variables.select("vid", F.xxhash64(F.lit(seed), "vid").alias("h")), None
    for colour in range(max_rounds):
        rival = near.join(left.select(F.col("vid").alias("other"), F.col("h").alias("oh")), "other").groupBy("vid").agg(F.min("oh").alias("oh"))
        now = scratch.keep(left.join(rival, "vid", "left").where("oh is null or h < oh").select("vid", F.lit(colour).alias("colour")))
        done = now if done is None else scratch.keep(done.unionByName(now))
        left = scratch.keep(left.join(now, "vid", "left_anti"))
        if left.isEmpty():
            return done
    raise RuntimeError("colouring did not finish")


def pooled_weights(before: DataFrame, learned: DataFrame, step: float) -> DataFrame:
    """(wid, w) from before(wid, w) and learned(copy, block, wid, w, n), what blocks made of it in visits of weight n.

    Copies of a block are averaged. Blocks see unlike evidence: what block b moved a weight by is
    (1 - exp(-step * n_b)) times a mean gradient; the mean gradients are averaged by n_b, and the move is
    that of all visits together. So the fixed point is that of one chain, whatever the blocks.
    """
    each = learned.groupBy("block", "wid").agg(F.avg("w").alias("w"), F.avg("n").alias("n")).where("n > 0")
    share = lambda n: -F.expm1(-F.lit(step) * n)
    moved = each.join(before.withColumnRenamed("w", "old"), "wid").groupBy("wid").agg(
        F.sum(F.col("n") * (F.col("w") - F.col("old")) / share(F.col("n"))).alias("d"), F.sum("n").alias("n")
    )
    return before.join(moved, "wid", "left").select("wid", (F.col("w") + F.coalesce(share(F.col("n")) * F.col("d") / F.col("n"), F.lit(0.0))).alias("w"))


class Sweeps:
    """The state of both chains of every copy, and the factors by colour."""

    def __init__(self, graph: FactorGraph, config: GibbsConfig):
        self.spark = graph.variables.sparkSession
        self.graph, self.config, self.scratch = graph, config, Scratch(self.spark, "sweeps")
        colours = self.scratch.keep(colouring(graph, config.seed))
        self.colours = [r.colour for r in colours.select("colour").distinct().orderBy("colour").collect()]
        truth = domain_values(graph).groupBy("vid").agg(F.transform(F.sort_array(F.collect_list(F.struct("dense", "truthiness"))), lambda x: x["truthiness"]).alias("truth"))
        start = initial_assignment(graph).withColumnRenamed("dense", "init")
        is_cat = F.col("dtype") == CATEGORICAL
        known = evidence(graph.variables).join(start, "vid").join(truth, "vid", "left").join(colours, "vid")
        copies = F.explode(F.sequence(F.lit(0), F.lit(max(1, config.n_datacopy) - 1)))
        truth = F.coalesce("truth", F.array(F.lit(0.0), F.lit(0.0)))
        soft = F.aggregate("truth", F.lit(0.0), lambda a, x: a + x) > TRUTH_EPSILON
        known = known.select("vid", "colour", "is_evid", is_cat.alias("is_cat"), F.when(is_cat, F.col("cardinality")).otherwise(2).alias("card"), "init", truth.alias("truth"))
        self.state = self.scratch.keep(known.withColumn("soft", soft).withColumn("copy", copies).withColumn("free", F.col("init")).withColumn("evid", F.col("init")))
        at = edges(graph).join(colours, "vid").groupBy("fid").agg(
            F.sort_array(F.collect_list(F.struct("pos", "vid", "equal_dense"))).alias("at"), F.collect_set("colour").alias("colours")
        )
        facts = graph.factors.select("fid", "func", "wid", "feature_value").join(at, "fid").join(graph.weights.select("wid", "is_fixed"), "wid")
        facts = facts.withColumn("colour", F.explode("colours")).drop("colours")
        path = f"{self.scratch.root}/factors"
        facts.write.partitionBy("colour").parquet(path)
        self.facts = self.spark.read.parquet(path)

    def _put(self, state: DataFrame) -> None:
        old, self.state = self.state, self.scratch.keep(state)
        self.scratch.drop(old)

    def _rows(self, colour: int) -> DataFrame:
        """(copy, fid, func, wid, is_fixed, feature_value, vid, dense, at): factors of a colour once for each value slot of its variables."""
        carried = ["func", "wid", "is_fixed", "feature_value"]
        flat = self.facts.where(F.col("colour") == colour).select("fid", *carried, F.explode("at").alias("e")).select("fid", *carried, "e.pos", "e.vid", "e.equal_dense")
        state = self.state.select("copy", "vid", "is_cat", "free", "evid", (F.col("colour") == colour).alias("turn"))
        position = F.struct("pos", "vid", "equal_dense", "is_cat", "free", "evid", "turn")
        rows = flat.join(state, "vid").groupBy("copy", "fid").agg(F.sort_array(F.collect_list(position)).alias("at"), *[F.first(c).alias(c) for c in carried])
        slots = F.array_distinct(F.transform(F.filter("at", lambda e: e["turn"]), lambda e: F.struct(e["vid"].alias("vid"), F.when(e["is_cat"], e["equal_dense"]).alias("dense"))))
        return rows.withColumn("slot", F.explode(slots)).select("copy", "fid", *carried, "at", F.col("slot.vid").alias("vid"), F.col("slot.dense").alias("dense"))

    @staticmethod
    def _value(chain: str, value: Column) -> Column:
        """Function value times feature on a chain with the row's variable at value."""
        sat = F.transform("at", lambda e: F.when(e["vid"] == F.col("vid"), value).otherwise(e[chain]) == e["equal_dense"])
        return factor_value(F.col("func"), sat) * F.col("feature_value")

    def _draw(self, rows: DataFrame, weights: DataFrame, colour: int, epoch: int, chains: list[str], turn: DataFrame) -> DataFrame:
        """(copy, vid, chain, drawn) of the variables of turn from their conditionals; rows of _rows, weights(copy, wid, w)."""
        both = F.when(F.col("dense").isNull(), F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).otherwise(F.array("dense"))
        each = rows.join(weights, ["copy", "wid"]).withColumn("proposal", F.explode(both))
        pots = [each.select("copy", "vid", F.lit(c).alias("chain"), F.col("proposal").alias("dense"), (self._value(c, F.col("proposal")) * F.col("w")).alias("pot")) for c in chains]
        # values that no factor sees come in as zeros, which no sum minds
        none = turn.withColumn("chain", F.explode(F.array(*map(F.lit, chains))))
        none = none.select("copy", "vid", "chain", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("card") - 1)).alias("dense"), F.lit(0.0).alias("pot"))
        for p in pots:
            none = none.unionByName(p)
        by = ["copy", "vid", "chain"]
        sums = none.join(turn.select("copy", "vid"), ["copy", "vid"], "left_semi").groupBy(*by, "dense").agg(F.sum("pot").alias("pot"))
        u = uniform(self.config.seed, F.lit(epoch), F.lit(colour), F.col("copy"), F.col("chain"), F.col("vid"))
        return draw_by_cdf(softmax(sums, by), "prob", u, by=by).withColumnRenamed("dense", "drawn")

    def _moved(self, drawn: DataFrame) -> DataFrame:
        """The state with what was drawn in place."""
        wide = drawn.groupBy("copy", "vid").agg(*[F.max(F.when(F.col("chain") == c, F.col("drawn"))).alias(f"_{c}") for c in ("free", "evid")])
        rows = self.state.join(wide, ["copy", "vid"], "left")
        return rows.withColumn("free", F.coalesce("_free", "free")).withColumn("evid", F.coalesce("_evid", "evid")).drop("_free", "_evid")

    def learn_epoch(self, weights: DataFrame, step: float, epoch: int) -> DataFrame:
        """(copy, wid, w, n): weights(wid, w) after one epoch of visits to every variable, apart for each copy."""
        config, copies = self.config, self.state.select("copy").distinct()
        now = self.scratch.keep(copies.crossJoin(weights.select("wid", "w")).withColumn("n", F.lit(0.0)))  # a row per copy and weight
        for colour in self.colours:
            rows = self.scratch.keep(self._rows(colour))
            turn = self.state.where(F.col("colour") == colour)
            loose = F.lit(True) if config.noise_aware else ~F.col("is_evid")
            soft = F.col("soft") if config.noise_aware else F.lit(False)
            w = now.select("copy", "wid", "w")
            drawn = self._draw(rows, w, colour, epoch, ["free", "evid"], turn).join(turn.select("copy", "vid", loose.alias("loose"), soft.alias("soft")), ["copy", "vid"])
            drawn = drawn.where("chain = 'free' or (loose and not soft)").drop("loose", "soft")
            if config.noise_aware:
                given = turn.where("soft").select("copy", "vid", F.posexplode("truth").alias("dense", "truthiness"))
                u = uniform(config.seed, F.lit(epoch), F.lit(colour), F.col("copy"), F.lit("soft"), F.col("vid"))
                given = draw_by_cdf(given.withColumn("dense", F.col("dense").cast("bigint")), "truthiness", u, "zero", ["copy", "vid"])
                drawn = drawn.unionByName(given.select("copy", "vid", F.lit("evid").alias("chain"), F.col("dense").alias("drawn")))
            self._put(self._moved(drawn))
            then = self._learned(rows, now, colour, step)
            old, now = now, self.scratch.keep(then)
            self.scratch.drop(old)
            self.scratch.drop(rows)
        return now

    def _learned(self, rows: DataFrame, weights: DataFrame, colour: int, step: float) -> DataFrame:
        """(copy, wid, w, n) after the visits to the trainable variables of a colour, whose new values are in the state."""
        config = self.config
        trained = F.lit(True) if config.learn_non_evidence else F.col("soft") if config.noise_aware else F.col("is_evid")
        seen = self.state.where(F.col("colour") == colour).where(trained)
        if config.noise_aware:
            values = F.filter(F.transform("truth", lambda t, i: F.struct(i.cast("bigint").alias("value"), t.alias("scale"))), lambda x: x["scale"] > TRUTH_EPSILON)
            target = F.when(F.col("is_cat"), values).otherwise(F.array(F.struct(F.col("init").alias("value"), F.lit(1.0).alias("scale"))))
        else:
            target = F.array(F.struct(F.col("init").alias("value"), F.lit(1.0).alias("scale")))
        seen = seen.select("copy", "vid", F.col("free").alias("at_free"), F.explode(target).alias("t")).select("copy", "vid", "at_free", "t.value", "t.scale")
        each = rows.where(~F.col("is_fixed")).join(seen, ["copy", "vid"])
        # a categorical value's factors are touched for the evidence value and, where the free chain is elsewhere, for its value
        hit = F.when(F.col("dense").isNull(), 1).otherwise((F.col("dense") == F.col("value")).cast("int") + ((F.col("dense") == F.col("at_free")) & (F.col("at_free") != F.col("value"))).cast("int"))
        g = self._value("free", F.col("at_free")) - self._value("evid", F.col("value"))
        touched = each.withColumn("times", hit * F.col("scale")).where("times > 0").select("copy", "wid", "times", (g * F.col("times")).alias("g"), (F.col("times") * F.col("feature_value") * F.col("feature_value")).alias("n"))
        sums = touched.groupBy("copy", "wid").agg(F.sum("g").alias("g"), F.sum("n").alias("m"), F.sum("times").alias("times"))
        rate = F.when(F.col("m") > 0, -F.expm1(-F.lit(step) * F.col("m")) / F.col("m")).otherwise(F.lit(0.0))
        w, times = F.col("w"), F.coalesce("times", F.lit(0.0))
        shrunk = w + config.reg_param * times * (w < 0).cast("int") if config.regularization == "l1" else w * F.exp(-times * F.lit(config.reg_param * step))
        moved = F.when(F.col("m").isNull(), w).otherwise(shrunk - rate * F.col("g"))
        return weights.join(sums, ["copy", "wid"], "left").select("copy", "wid", moved.alias("w"), (F.col("n") + F.coalesce("m", F.lit(0.0))).alias("n"))

    def infer(self, weights: DataFrame, epochs: int, first_epoch: int = 0) -> tuple[DataFrame, DataFrame]:
        """(tallies(vid, dense, n), nsamples(vid, n)) of the evidence chain with weights(wid, w)."""
        config, root = self.config, f"{self.scratch.root}/drawn"
        loose = F.lit(True) if config.sample_evidence else ~F.col("is_evid")
        w = self.scratch.keep(self.state.select("copy").distinct().crossJoin(weights.select("wid", "w")))  # a row per copy and weight
        for epoch in range(config.burn_in + epochs):
            for colour in self.colours:
                turn = self.state.where((F.col("colour") == colour) & loose)
                self._put(self._moved(self._draw(self._rows(colour), w, colour, first_epoch + epoch, ["evid"], turn)))
            if epoch >= config.burn_in:
                self.state.where(loose).groupBy("vid", F.col("evid").alias("dense")).agg(F.count("*").alias("n")).write.parquet(f"{root}/epoch={epoch}")
        if not epochs:
            none = self.spark.createDataFrame([], "vid bigint, dense bigint, n bigint")
            return none, none.select("vid", "n")
        tallies = self.spark.read.parquet(root).groupBy("vid", "dense").agg(F.sum("n").alias("n"))
        return tallies, tallies.groupBy("vid").agg(F.sum("n").alias("n"))
