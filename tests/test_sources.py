"""Text and binary graph files: golden bytes, round trips, malformed fields, the command line."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from factorloom import cli
from factorloom.operators import graph
from factorloom.plans import groundings
from factorloom.sources import binary, text
from tests.conftest import SF


def write(path, *lines):
    path.write_text("".join(x + "\n" for x in lines))
    return str(path)


def raw(folder):
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{folder}/*.bin")))


def test_golden_bytes(spark, tmp_path):
    w = text.read_weights(spark, write(tmp_path / "w.tsv", "0\t1 3"))
    binary.write_binary(w, "weights", str(tmp_path / "w"))
    assert raw(tmp_path / "w") == bytes.fromhex("0000000000000000" "01" "4008000000000000")
    v = text.read_variables(spark, write(tmp_path / "v.tsv", *[f"{i}\t0\t0\t0\t2" for i in range(10)]))
    binary.write_binary(v.coalesce(1), "variables", str(tmp_path / "v"))
    one = lambda i: i.to_bytes(8, "big") + b"\0" + bytes(8) + bytes(2) + (2).to_bytes(8, "big")
    assert raw(tmp_path / "v") == b"".join(map(one, range(10))) and len(raw(tmp_path / "v")) == 270
    f = text.read_factors(spark, [(write(tmp_path / "f.tsv", *[f"{i}\t0\t1" for i in range(4)]), 2, [1])])
    binary.write_binary(f.coalesce(1), "factors", str(tmp_path / "f"))
    assert len(raw(tmp_path / "f")) == 168 and raw(tmp_path / "f")[:10] == bytes.fromhex("0002" "0000000000000001")
    assert binary.encode("domains", next(iter(text.read_domains(spark, write(tmp_path / "d.tsv", "2\t3\t{1,3,5}\t{0,0.5,1}")).collect()))) == (
        (2).to_bytes(8, "big") + (3).to_bytes(8, "big") + bytes.fromhex("0000000000000001" "0000000000000000" "0000000000000003" "3fe0000000000000" "0000000000000005" "3ff0000000000000")
    )


def test_fields(spark, tmp_path):
    assert text.read_meta(spark, write(tmp_path / "m", "1,18,x7,36,w.bin,v.bin")).first() == (1, 18, 0, 36)
    lines = spark.createDataFrame([("5\t6\tjunk\t-2.5e1x",), ("1\t2\t3",), ("",)], "value string")
    got = text.parse_factors(lines, 1, [1, 0]).collect()
    assert [(r.wid, r.feature_value, [tuple(v) for v in r.vifs]) for r in got] == [(0, -25.0, [(0, 5, 1), (1, 6, 0)]), (3, 0.0, [(0, 1, 1), (1, 2, 0)])]
    for bad in ("0\t1\t5\t{0}", "0\t2\t{5}\t{0}"):
        with pytest.raises(Exception, match="not an array|domain size"):
            text.read_domains(spark, write(tmp_path / "bad", bad)).collect()
    assert spark.range(1).select(text.array_fields(F.lit("{}"))).first()[0] == []


def test_dense_ids(spark):
    got = sorted(r.n for r in text.dense_ids(spark.range(1000).repartition(7), "n").collect())
    assert got == list(range(1000))


def plain(df):
    return sorted(map(repr, df.collect()))


def test_round_trips(spark, tmp_path):
    g = groundings.conversations_graph(spark, SF)
    for kind, df in (("weights", g.weights), ("variables", g.variables), ("domains", g.domains)):
        binary.write_binary(df, kind, str(tmp_path / kind))
        assert plain(binary.read_binary(spark, kind, str(tmp_path / kind)).select(df.columns)) == plain(df)
    text.write_variables(g.variables, str(tmp_path / "tv"))
    assert plain(text.read_variables(spark, str(tmp_path / "tv"))) == plain(g.variables)
    text.write_domains(g.domains, str(tmp_path / "td"))
    assert plain(text.read_domains(spark, str(tmp_path / "td"))) == plain(g.domains)
    text.write_weights(g.weights, str(tmp_path / "tw"))
    assert plain(text.read_weights(spark, str(tmp_path / "tw"))) == plain(g.weights)
    for f in (g.factors, groundings.orders_graph(spark, SF).factors):
        folder = tmp_path / f"tf{random.random()}"
        back = text.read_factors(spark, text.write_factors(f, str(folder)))
        assert plain(back.drop("fid")) == plain(f.select(back.drop("fid").columns))


def test_files_are_cut_into_splits(spark, tmp_path):
    g = groundings.orders_graph(spark, SF)
    binary.write_binary(g.factors.coalesce(1), "factors", str(tmp_path / "one"))
    files = binary._files(spark, [str(tmp_path / "one")])
    assert len(files) == 1 and files[0][1] % 74 == 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.input.fileinputformat.split.maxsize", "20000")
    try:
        back = binary._fixed(spark, "factors", [files[0][0]], 3)
        assert back.rdd.getNumPartitions() >= files[0][1] // 20000
        assert plain(binary.read_binary(spark, "factors", str(tmp_path / "one")).drop("fid")) == plain(g.factors.drop("fid"))
    finally:
        conf.unset("mapreduce.input.fileinputformat.split.maxsize")
    mixed = g.factors.limit(5).unionByName(groundings.conversations_graph(spark, SF).factors).unionByName(groundings.documents_graph(spark, SF).factors)
    binary.write_binary(mixed.coalesce(1), "factors", str(tmp_path / "mixed"))
    binary.write_binary(g.factors.limit(7).coalesce(1), "factors", str(tmp_path / "mixed2"))
    both = binary.read_binary(spark, "factors", [str(tmp_path / "mixed"), str(tmp_path / "mixed2")])
    assert plain(both.drop("fid")) == plain(mixed.unionByName(g.factors.limit(7)).drop("fid")) and both.agg(F.max("fid")).first()[0] == both.count() - 1
    assert binary.read_binary(spark, "weights", str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        binary.read_binary(spark, "weights", str(tmp_path / "nowhere"))


def test_command_line(spark, tmp_path):
    v = write(tmp_path / "v.tsv", *[f"{i}\t{int(i < 9)}\t{int(i < 8)}\t0\t2" for i in range(18)])
    f, w = write(tmp_path / "f.tsv", *[f"{i}\t0\t1" for i in range(18)]), write(tmp_path / "w.tsv", "0 0 0")
    m = write(tmp_path / "graph.meta", "1,18,18,18")
    p = lambda x: str(tmp_path / x)
    cli.main(["text2bin", "variable", v, p("v.bin"), p("v.n")], spark)
    cli.main(["text2bin", "weight", w, p("w.bin"), p("w.n")], spark)
    cli.main(["text2bin", "factor", f, p("f.bin"), p("f.n"), "4", "1", "1"], spark)
    assert spark.read.text(p("f.n")).first()[0] == "18" and spark.read.text(p("v.n")).first()[0] == "18"
    files = ["-m", m, "-v", p("v.bin"), "-f", p("f.bin"), "-w", p("w.bin")]
    cli.main(["gibbs", *files, "-o", p("out"), "-l", "800", "-i", "10", "-l", "1000", "-i", "1000", "--alpha", "0.1", "--diminish", "0.995", "--sample_evidence", "--reg_param", "0"], spark)
    weight = spark.read.text(p("out/inference_result.out.weights.text")).first()[0].split(" ")
    probs = [r.value.split(" ") for r in spark.read.text(p("out/inference_result.out.text")).collect()]
    assert weight[0] == "0" and abs(float(weight[1]) - 1.04) < 0.15 and len(probs) == 18 and all(x[1] == "1" and abs(float(x[2]) - 0.89) < 0.06 for x in probs)
    cli.main(["bin2text", *files, "-o", p("text")], spark)
    assert spark.read.text(p("text/graph.meta")).first()[0] == "1,18,18,18"
    with pytest.raises(SystemExit):
        cli.main(["other"], spark)
    with pytest.raises(ValueError, match="breaks rules"):
        cli.main(["bin2text", "-m", write(tmp_path / "wrong.meta", "2,18,18,18"), *files[2:], "-o", p("text2")], spark)


def test_truth_tables(spark):
    from factorloom.functions.factors import BY_NAME

    tables = {  # fixed values: body.., head -> value
        (True,): {"and": 1, "or": 1, "equal": 1, "istrue": 1, "imply_natural": 1, "linear": 1, "ratio": 1, "logical": 1, "and_categorical": 1, "imply_mln": 1},
        (False,): {"and": -1, "or": -1, "equal": 1, "istrue": -1, "imply_natural": -1, "linear": 0, "ratio": 0, "logical": 0, "and_categorical": 0, "imply_mln": 0},
        (True, True): {"and": 1, "or": 1, "equal": 1, "imply_natural": 1, "linear": 1, "ratio": 1, "logical": 1, "imply_mln": 1},
        (True, False): {"and": -1, "or": 1, "equal": -1, "imply_natural": -1, "linear": 0, "ratio": 0, "logical": 0, "imply_mln": 0},
        (False, True): {"and": -1, "or": 1, "equal": -1, "imply_natural": 0, "linear": 1, "ratio": 1, "logical": 1, "imply_mln": 1, "and_categorical": 0},
        (False, False): {"and": -1, "or": -1, "equal": 1, "imply_natural": 0, "linear": 1, "ratio": 1, "logical": 1, "imply_mln": 1},
        (True, False, True): {"imply_natural": 0, "imply_mln": 1, "linear": 2, "ratio": 1.584962500721156, "logical": 1},
        (True, True, True): {"imply_natural": 1, "imply_mln": 1, "linear": 2, "ratio": 1.584962500721156, "logical": 1},
        (True, True, False): {"imply_natural": -1, "imply_mln": 0, "linear": 0, "ratio": 0, "logical": 0},
    }
    for sat, want in tables.items():
        got = spark.range(1).select(*[BY_NAME[n](F.array(*map(F.lit, sat))).alias(n) for n in want]).first().asDict()
        assert got == pytest.approx(want), sat
    with pytest.raises(Exception, match="unknown factor function"):
        from factorloom.functions.factors import factor_value

        spark.range(1).select(factor_value(F.lit(5), F.array(F.lit(True)))).collect()
    assert graph.range_shards(spark.range(10).withColumnRenamed("id", "vid"), 4).count() == 4


def test_compaction(spark):
    import numpy as np

    from factorloom.operators import compaction

    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 4)) @ np.array([[1, 0.8, 0, 0], [0, 0.6, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    a, k, lam = np.cov(x.T), 1.0, 0.1
    c = compaction.sparse_inverse(a, np.full((4, 4), lam), k, tol=1e-12)
    w = np.linalg.inv(c)
    # optimality: where C isn't zero the slope is met, elsewhere it is inside the penalty
    slope = k * w - a
    assert (np.abs(slope[c == 0]) <= lam + 1e-4).all() and np.allclose(slope[c != 0], lam * np.sign(c[c != 0]), atol=1e-4)
    assert c[0, 1] != 0 and c[0, 2] == 0
    zero = compaction.sparse_inverse(np.zeros((3, 3)), np.full((3, 3), 50.0), 25.0)
    assert np.allclose(zero, np.eye(3) * 0.5)
    got = compaction.clamped_logit(F.col("p"))
    assert [round(r[0], 4) for r in spark.createDataFrame([(0.5,), (0.995,), (0.001,), (0.9,)], "p double").select(got).collect()] == [0.0, 10.0, -10.0, 2.1972]
    samples = spark.createDataFrame([(s, v, int((s + v) % 2 == 0 or v == 2)) for s in range(20) for v in range(3)], "sample bigint, vid bigint, value bigint")
    parts = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "vid bigint, component bigint")
    cov = {(r.vid_i, r.vid_j): round(r.cov, 6) for r in compaction.covariances(samples, parts).collect()}
    assert cov == {(0, 0): 0.25, (0, 1): -0.25, (1, 1): 0.25, (2, 2): 0.0}


def test_compaction_splits_components(spark):
    import numpy as np

    from factorloom.operators import compaction

    rng = np.random.default_rng(1)
    n, k, lam = 12, 1.0, 0.15
    x = rng.standard_normal((20_000, n))
    x[:, 4] += x[:, 7]
    x[:, 9] += 0.7 * x[:, 4] - x[:, 2]
    x[:, 1] += x[:, 0]
    a = np.cov(x.T)
    rows = [(3, i + 50, j + 50, float(a[i, j])) for i in range(n) for j in range(i, n)]
    cov = spark.createDataFrame(rows, "component long, vid_i long, vid_j long, cov double")
    sizes = sorted(r["count"] for r in compaction.penalty_parts(cov, lam).groupBy("part").count().collect())
    assert sizes == [2, 4]
    whole = compaction.sparse_inverse(a, np.full_like(a, lam), k, tol=1e-12)
    got = compaction.inverse_covariances(cov, (0.5, lam), k).collect()
    c = np.zeros((n, n))
    for r in got:
        c[r.vid_i - 50, r.vid_j - 50] = c[r.vid_j - 50, r.vid_i - 50] = r.weight
    assert np.allclose(c, whole, atol=2e-3) and all(r.component == 3 for r in got) and len(got) == len({(r.vid_i, r.vid_j) for r in got})
    assert compaction.inverse_covariances(cov.limit(0), (0.5, lam), k).count() == 0


def test_wide_parts_by_joins(spark):
    import numpy as np

    from factorloom.operators import compaction

    a = np.array([[1.0, 0.7, 0, 0, 0], [0.7, 1.5, 0, 0, 0], [0, 0, 2.0, -0.6, 0.4], [0, 0, -0.6, 1.0, 0], [0, 0, 0.4, 0, 1.0]])
    cov = spark.createDataFrame([(1, i, j, float(a[i, j])) for i in range(5) for j in range(i, 5)], "component long, vid_i long, vid_j long, cov double")
    got = {(r.vid_i, r.vid_j): r.weight for r in compaction.inverse_covariances(cov, (0.3,), 1.0, max_part=1).collect()}
    c = compaction.sparse_inverse(a, np.full_like(a, 0.3), 1.0)
    want = {(i, j): c[i, j] for i in range(5) for j in range(i, 5) if abs(c[i, j]) > 1e-12}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 5e-3 for p in want) and (2, 3) in got


def test_covariances_by_tiles(spark, monkeypatch):
    import numpy as np

    from factorloom.operators import compaction

    monkeypatch.setattr(compaction, "TILE", 2)
    monkeypatch.setattr(compaction, "CHUNK", 3)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (17, 9)).astype(float)
    rows = [(s, v, float(x[s, v])) for s in range(17) for v in range(9) if x[s, v] or (s + v) % 2]
    samples = spark.createDataFrame(rows, "sample long, vid long, value double")
    parts = spark.createDataFrame([(v, v // 7) for v in range(9)], "vid long, component long")
    got = {(r.component, r.vid_i, r.vid_j): r.cov for r in compaction.covariances(samples, parts).collect()}
    a = x.T @ x / 17 - np.outer(x.mean(0), x.mean(0))
    want = {(i // 7, i, j): a[i, j] for i in range(9) for j in range(i, 9) if i // 7 == j // 7}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    assert compaction.covariances(samples.limit(0), parts).count() == compaction.covariances(samples, parts.limit(0)).count() == 0


def test_covariances_of_sparse_samples(spark, monkeypatch):
    """Samples of few variables don't cost a matrix for every pair of tiles and chunk of samples."""
    import numpy as np

    from factorloom.operators import compaction

    monkeypatch.setattr(compaction, "TILE", 2)
    products = compaction._products

    def dense(rows):
        if rows["sample"].nunique() != 1:
            raise AssertionError("a sparse sample in a matrix")
        return products(rows)

    monkeypatch.setattr(compaction, "_products", dense)
    monkeypatch.setattr(compaction, "MAX_NARROW", 3, raising=False)
    x = np.zeros((50, 8))
    x[np.arange(50), np.arange(50) % 8] = 1.0
    x[np.arange(50), np.arange(50) * 3 % 8] = 2.0
    x[7] = np.arange(8) - 3  # the only sample with more than three values
    rows = [(s, v, float(x[s, v])) for s in range(50) for v in range(8)]
    samples = spark.createDataFrame(rows, "sample long, vid long, value double")
    parts = spark.createDataFrame([(v, 0) for v in range(8)], "vid long, component long")
    got = {(r.vid_i, r.vid_j): r.cov for r in compaction.covariances(samples, parts).collect()}
    a = x.T @ x / 50 - np.outer(x.mean(0), x.mean(0))
    assert got.keys() == {(i, j) for i in range(8) for j in range(i, 8)} and all(abs(got[p] - a[p]) < 1e-12 for p in got)


def test_inverses_of_samples(spark, monkeypatch):
    """The same as by all covariances; pairs are made of variables only that can have one over the last penalty."""
    import numpy as np

    from factorloom.operators import compaction

    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8)) * np.array([1, 1, 0.1, 0.05, 1, 0, 0.2, 3])
    x[:, 1] += x[:, 0]
    samples = spark.createDataFrame([(s, v, float(x[s, v])) for s in range(200) for v in range(8)], "sample long, vid long, value double")
    parts = spark.createDataFrame([(v, v // 7) for v in range(8)], "vid long, component long")
    asked, made = [], compaction.covariances
    want = {(r.component, r.vid_i, r.vid_j): r.weight for r in compaction.inverse_covariances(made(samples, parts), (0.5, 0.4), 1.0).collect()}
    monkeypatch.setattr(compaction, "covariances", lambda s, c: asked.append(sorted(r.vid for r in c.collect())) or made(s, c))
    got = {(r.component, r.vid_i, r.vid_j): r.weight for r in compaction.sample_inverses(samples, parts, (0.5, 0.4), 1.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want) and (0, 0, 1) in got
    assert asked == [[0, 1, 4, 7]]
    assert len(compaction.sample_inverses(samples, parts, (20, 10), 1.0).collect()) == 8 and len(asked) == 1


def test_compaction_files(spark, tmp_path):
    parts = text.read_components(spark, write(tmp_path / "c", "3 1 2", "9"))
    assert sorted(map(tuple, parts.collect())) == [(1, 1), (1, 2), (1, 3), (9, 9)]
    samples = text.read_samples(spark, [write(tmp_path / "s0", "1 0", "2 1"), write(tmp_path / "s1", "1 1", "2 1")])
    assert sorted(map(tuple, samples.collect())) == [(0, 1, 0), (0, 2, 1), (1, 1, 1), (1, 2, 1)]
    text.write_compact(samples.selectExpr("vid as vid_i", "vid as vid_j", "avg(value) over (partition by vid) as weight").distinct(), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1 1 0.5", "2 2 1.0"]
