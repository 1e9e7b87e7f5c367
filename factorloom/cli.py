"""Command line: gibbs (learn and infer), text2bin and bin2text, over Spark.

python -m factorloom.cli gibbs -m META -v VARIABLES -f FACTORS -w WEIGHTS [--domains D] -o OUT -l N -i N ...
python -m factorloom.cli text2bin KIND INPUT OUTPUT COUNT [FUNC ARITY EQUAL_TO ...]
python -m factorloom.cli bin2text -m META -v ... -f ... -w ... [--domains D] -o OUT
"""

from __future__ import annotations

import argparse
import math
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factorloom.operators import gibbs, graph, relational
from factorloom.operators.graph import FactorGraph
from factorloom.schema import GibbsConfig
from factorloom.session import Scratch
from factorloom.sources import binary, text

MODES = ("gibbs", "text2bin", "bin2text")


def _files(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("-m", "--fg_meta", required=True)
    for flags in (("-v", "--variables"), ("-f", "--factors"), ("-w", "--weights")):
        parser.add_argument(*flags, action="append", required=True)
    parser.add_argument("--domains", action="append", default=[])
    parser.add_argument("-o", "--outputFile", required=True)


def parser() -> argparse.ArgumentParser:
    """The options of each mode; of repeated single values the last wins."""
    top = argparse.ArgumentParser(prog="factorloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    modes = top.add_subparsers(dest="mode", required=True)
    g = modes.add_parser("gibbs")
    _files(g)
    g.add_argument("-l", "--n_learning_epoch", type=int, required=True)
    g.add_argument("-i", "--n_inference_epoch", type=int, required=True)
    g.add_argument("--burn_in", type=int, default=0)
    g.add_argument("-c", "--n_datacopy", type=int, default=0, help="copies of the graph; 0: one for each executor")
    g.add_argument("-t", "--n_threads", type=int, default=0, help="blocks that each copy is dealt into, so tasks at once; 0: as its size asks")
    g.add_argument("-a", "--alpha", type=float, default=0.01)
    g.add_argument("-p", "--stepsize", type=float, default=0.01)
    g.add_argument("-d", "--diminish", type=float, default=0.95)
    g.add_argument("-b", "--reg_param", type=float, default=0.01)
    g.add_argument("--regularization", default="l2")
    for flag in ("sample_evidence", "learn_non_evidence", "noise_aware"):
        g.add_argument(f"--{flag}", action="store_true")
    g.add_argument("-q", "--quiet", action="store_true")
    t = modes.add_parser("text2bin")
    t.add_argument("kind", choices=("variable", "weight", "factor", "domain"))
    t.add_argument("input")
    t.add_argument("output")
    t.add_argument("count")
    t.add_argument("function", nargs="*", type=int, help="for factors: function code, arity and the value that each position asks for")
    _files(modes.add_parser("bin2text"))
    return top


def load(spark: SparkSession, options: argparse.Namespace) -> FactorGraph:
    """The graph of binary files; its checks must find nothing."""
    domains = binary.read_binary(spark, "domains", options.domains) if options.domains else None
    found = FactorGraph(*(binary.read_binary(spark, kind, getattr(options, kind)) for kind in ("weights", "variables", "factors")), domains)
    scratch = Scratch(spark, "graph")
    found = FactorGraph(*(scratch.keep(df) for df in (found.weights, found.variables, found.factors)), scratch.keep(domains) if domains is not None else None)
    bad = graph.violations(found).where("n > 0").collect()
    sizes, meta = graph.descriptor(found).first(), text.read_meta(spark, options.fg_meta).first()
    bad += [(name, sizes[name]) for name in ("n_weights", "n_variables", "n_factors", "n_edges") if sizes[name] != meta[name.replace("n_", "num_")]]
    if bad:
        raise ValueError(f"the graph breaks rules: {bad}")
    return found


def executors(spark: SparkSession) -> int:
    """Executors of the application, the driver left out unless it is alone."""
    return max(1, len(spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()) - 1)


def run_gibbs(spark: SparkSession, o: argparse.Namespace) -> None:
    began, found = time.monotonic(), load(spark, o)
    names = GibbsConfig.__dataclass_fields__.keys() & vars(o).keys()
    config = GibbsConfig(**{n: getattr(o, n) for n in names} | {"n_datacopy": o.n_datacopy or executors(spark)})
    blocks, report = o.n_threads or gibbs.block_count(found), []
    weights, tallies, of = gibbs.run_gibbs(found, config, blocks, report=report)
    probs = relational.marginals(found, tallies, of, config.sample_evidence) if config.n_inference_epoch else None
    text.write_results(weights, probs, o.outputFile)
    if not o.quiet:
        print(config, *graph.descriptor(found).collect(), sep="\n")
        for epochs, step, lmax, l2 in report:
            print(f"LEARNING EPOCH {epochs}: stepsize = {step:.6g}, lmax = {lmax:.6g}, l2 = {l2:.6g}")
        for r in relational.snippet(weights, "wid").collect():
            print(f"   {r.wid} {r.w:.6g}")
        if probs is not None:
            for r in relational.snippet(probs, "vid", "value").collect():
                print(f"   {r.vid} {r.value} {r.prob:.6g}")
            for r in relational.calibration(probs).orderBy("bin").collect():
                print(f"PROB BIN {r.bin / 10:g}~{(r.bin + 1) / 10:g}  -->  # {r.n}")
        epochs = config.n_learning_epoch + config.n_inference_epoch
        seconds = time.monotonic() - began
        print(f"{found.variables.count() * max(1, epochs) / max(seconds, math.ulp(1)):.0f} variables a second over {epochs} epochs")


def run_text2bin(spark: SparkSession, o: argparse.Namespace) -> None:
    """Writes a folder of binary files and beside it the number of records, for factors that of edges."""
    if o.kind == "factor":
        func, arity, *equal_to = o.function
        if len(equal_to) != arity:
            raise ValueError(f"{arity} values are needed, not {len(equal_to)}")
        rows = text.read_factors(spark, [(o.input, func, equal_to)])
        rows = Scratch(spark, "text2bin").keep(rows)
    else:
        rows = {"variable": text.read_variables, "weight": text.read_weights, "domain": text.read_domains}[o.kind](spark, o.input)
    binary.write_binary(rows, f"{o.kind}s", o.output)
    write_count(rows, o.kind, o.count)


def write_count(rows, kind: str, path: str) -> None:
    """The count that a graph's metadata wants: of edges for factors, else of records."""
    n = F.coalesce(F.sum("arity"), F.lit(0)) if kind == "factor" else F.count("*")
    rows.agg(n.cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def run_bin2text(spark: SparkSession, o: argparse.Namespace) -> None:
    found = load(spark, o)
    text.write_meta(found, f"{o.outputFile}/graph.meta")
    text.write_weights(found.weights, f"{o.outputFile}/weights")
    text.write_variables(found.variables, f"{o.outputFile}/variables")
    text.write_factors(found.factors, f"{o.outputFile}/factors")
    if found.domains is not None:
        text.write_domains(found.domains, f"{o.outputFile}/domains")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName(f"factorloom {o.mode}").getOrCreate()
    {"gibbs": run_gibbs, "text2bin": run_text2bin, "bin2text": run_bin2text}[o.mode](spark, o)
    return 0


if __name__ == "__main__":
    sys.exit(main())
