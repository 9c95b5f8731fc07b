"""Operators on small inputs: the scoring rules one by one, ranks in blocks, samples, parsers, sources."""

import json
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.functions import parse as P
from vocalith.functions import text as T
from vocalith.operators import evaluate, hashing, learn, model, ranks, sampling, shapes
from vocalith.operators.verdict import arbitrate, thresholds
from vocalith.plans import pipelines
from vocalith.sources import catalogs, git, jsonl, modules
from vocalith.streaming import scorer


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


# ---- scoring


def counts(spark, d):
    return spark.createDataFrame(list(d.items()), "token string, n long")


def bpe(spark, texts, own, generic):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = model.bpe_scores(df, "k", T.word_tokens(F.col("text")), counts(spark, own), counts(spark, generic))
    return [r["bpe"] for r in got.orderBy("k").collect()]


def test_bpe(spark):
    own, gen = {"alpha": 90, "beta": 10}, {"alpha": 5, "gamma": 95}
    got = bpe(spark, ["", "a b", "alpha", "alpha gamma gamma", "alpha delta"], own, gen)
    s = lambda g, o: np.log(g / 100 + 1e-7) - np.log(o / 100 + 1e-7)
    assert got == pytest.approx([0.0, s(0, 0), s(5, 90), s(95, 0), max(s(5, 90), s(0, 0))])
    assert bpe(spark, ["alpha"], {}, {}) == pytest.approx([0.0])


def test_callee_weights(spark):
    known = model.attested(spark.createDataFrame([("a.x",), ("log.debug",)], "callee string"))
    calls = spark.createDataFrame([(1, "a.b"), (1, "a.b"), (2, "z.b"), (3, "z.a"), (3, "y.a"), (3, "x.a"), (4, "a.x")], "k int, callee string")
    got = {r["k"]: r["contribution"] for r in model.contributions(model.resolve(calls, "k", known), "k").collect()}
    assert got == {1: 4.0, 2: 2.0, 3: 5.0, 4: 0.0}


def test_cluster_weights(spark):
    known = model.attested(spark.createDataFrame([("f",), ("g",), ("h",)], "callee string"))
    by = spark.createDataFrame([(0, "f", 9), (0, "g", 2)], "cluster_id int, callee string, n_files long")
    sizes = spark.createDataFrame([(0, 10), (1, 3)], "cluster_id int, size long")
    calls = spark.createDataFrame([(1, 0, "f"), (2, 0, "g"), (3, 0, "h"), (4, 0, "new"), (5, None, "h")], "k int, cluster_id int, callee string")
    w = lambda tau: {r["k"]: r["w"] for r in model.cluster_weights(calls, "k", known, by, sizes, tau=tau).collect()}
    assert w(2) == {1: 0.0, 2: 5.0, 3: 5.0, 4: 2.0, 5: 0.0}
    assert w(0)[2] == 0.0


@pytest.mark.parametrize("imports, tokens, extra, limit, reason", [(1, 7.5, 0, 3, "bpe"), (1, 3.0, 0.5, 3, "call_receiver"), (1, 2.0, 0.5, 3, "import"), (0, 2.0, 2.0, 3, "call_receiver"), (0, 3.5, 5.0, 3, "bpe"), (0, 3.0, 0, 3, "none"), (2, 6.0, 0, 3, "import"), (0, 0.1, 0.0, -1.0, "bpe")])
def test_arbitration(spark, imports, tokens, extra, limit, reason):
    assert one(spark, arbitrate(F.lit(imports), F.lit(float(tokens)), F.lit(float(extra)), F.lit(float(limit)))) == reason


def test_nearest_cluster(spark):
    bags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z"), (3, "a")], "k int, callee string")
    clusters = spark.createDataFrame([(0, "q"), (1, "a"), (1, "b"), (1, "c"), (2, "a")], "cluster_id int, callee string")
    assert {r["k"]: r["cluster_id"] for r in model.nearest_cluster(bags, "k", clusters).collect()} == {1: 1, 2: 0, 3: 2}


def test_alpha_zero_switches_callees_off(spark):
    files = spark.createDataFrame([(1, "c", "known(1)"), (2, "c", "known(2)")], "entry_id int, corpus string, text string")
    m = pipelines.fit(files, files)
    hunk = spark.createDataFrame([(9, "c", "odd.call(1)")], "entry_id int, corpus string, text string")
    assert pipelines.stages(hunk, m, alpha=0.0).first()["contribution"] == 0.0
    assert pipelines.stages(hunk, m).first()["contribution"] == 2.0


def test_calibration_with_a_small_pool_is_its_maximum(spark):
    files = spark.createDataFrame([(i, "c", f"name{i} shared") for i in range(8)], "entry_id int, corpus string, text string")
    m = pipelines.fit(files, files)
    best = pipelines.stages(files, m, alpha=0.0).agg(F.max("bpe")).first()[0]
    assert pipelines.calibrate(files, m, 100, 7).first()[0] == pytest.approx(best)


def test_settings():
    text = pipelines.config({"python": 3.5}, 100, 7)
    assert pipelines.read_config(text) == {"python": 3.5}
    with pytest.raises(ValueError, match="version"):
        pipelines.read_config(json.dumps({"version": 1, "threshold": 2}))


# ---- ranks, measures, samples


@pytest.mark.parametrize("block", (3, 20000))
def test_quantiles(spark, block):
    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.integers(0, 9, 200)] + [("b", float(x)) for x in rng.standard_normal(301)] + [("c", 1.0), ("d", None), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["x"], r["y"]) for r in ranks.quantiles(df, ["g"], "v", {"x": 0.33, "y": 0.9}, block).collect()}
    for g in "abc":
        v = [x for k, x in rows if k == g and x == x]
        assert got[g] == pytest.approx(tuple(np.quantile(v, [0.33, 0.9])))
    assert "d" not in got
    every = ranks.quantiles(df, [], "v", {"x": 0.5}, block).first()["x"]
    assert every == pytest.approx(np.quantile([x for _, x in rows if x is not None and x == x], 0.5))


def test_thresholds(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 10)], "g string, s double")
    t = lambda **k: thresholds(df, ["g"], "s", **k).first()["t"]
    assert (t(), t(mode="percentile", pct=50), t(mode="iqr")) == (10.0, 3.0, 7.0)


def test_auc(spark):
    rows = [(0.1, False), (0.4, False), (0.4, True), (0.8, True), (None, True)]
    assert evaluate.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", F.col("y")).first()["auc"] == pytest.approx(0.875)
    assert evaluate.auc(spark.createDataFrame([(0.1, True)], "s double, y boolean"), "s", F.col("y")).first()["auc"] == 0.0


def test_stability(spark):
    s = lambda rows: evaluate.stability(spark.createDataFrame(rows, "k int, i int"), "k", "i").first()["jaccard"]
    assert s([(0, 1), (0, 2), (1, 2), (1, 3)]) == pytest.approx(1 / 3, abs=1e-6)
    assert s([(0, 1)]) == 1.0


def test_samples_repeat(spark):
    df = spark.range(100)
    a, b = (sorted(r["id"] for r in sampling.sample(df, "id", 10, k).collect()) for k in (1, 2))
    assert a == sorted(r["id"] for r in sampling.sample(df.repartition(7), "id", 10, 1).collect()) and a != b


def test_minhash(spark):
    import hashlib

    a, b = hashing.parameters(4, 0)
    words = ["x", "yy", "zéz"]
    h = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little") % hashing.PRIME for w in words]
    df = spark.createDataFrame([(words,), ([],)], "bag array<string>")
    got = [r["s"] for r in df.select(hashing.signature(F.col("bag"), 4).alias("s")).collect()]
    assert got == [[min((p * x + q) % hashing.PRIME for x in h) for p, q in zip(a, b)], [0] * 4]


def test_kmeans_of_one_row(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0])], "k int, v array<double>")
    assert learn.kmeans(df, "v", 8).first()["cluster_id"] == 0


def test_mahalanobis(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 3))
    df = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "k int, g int, v array<double>")
    got = learn.mahalanobis(df, "g", "v").orderBy("k").toPandas().d2.to_numpy()
    inv = np.linalg.pinv(np.cov(x.T, bias=True) + 1e-3 * np.eye(3))
    assert np.allclose(got, [(r - x.mean(0)) @ inv @ (r - x.mean(0)) for r in x])


def test_shapes(spark):
    base = shapes.baselines(spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 1.0)], "cluster_id int, value double"))
    sizes = spark.createDataFrame([(0, 10), (1, 10)], "cluster_id int, size long")
    h = spark.createDataFrame([(1, 0, 2.0), (2, 0, 4.0), (3, 1, 9.0), (4, 0, 0.0), (5, 0, None)], "k int, cluster_id int, value double")
    sd = np.std([1, 2, 3])
    both = {r["k"]: r["s"] for r in shapes.score(h, base, sizes).collect()}
    assert both == pytest.approx({1: 0.0, 2: 2 / sd - 1, 3: 0.0, 4: 2 / sd - 1, 5: 0.0})
    assert {r["k"]: r["s"] for r in shapes.score(h, base, sizes, shapes.below).collect()}[2] == 0.0
    with pytest.raises(ValueError, match="already"):
        shapes.register("namespace_jsd")(None)


# ---- parsers and text


def test_python_parsers():
    text = '"""Doc\nlong."""\nimport os.path, sys\nfrom a.b import c\nfrom . import d\n@deco\ndef f(x):\n    # note\n    if x:\n        return g.h(x)\n    try:\n        k()()\n    except E:\n        raise V(1)\nclass C:\n    pass\n'
    assert P.python_imports(text) == ["os", "sys", "a"]
    assert [s[0] for s in P.import_spans(text, "python")] == ["os", "sys", "a"]
    assert sorted(map(str, P.python_callees(text))) == ["None", "V", "g.h", "k"]
    assert P.sampleable(text, "python") == [(7, 14), (15, 16)]
    assert P.prose_lines(text, "python") == [1, 2, 8]
    assert P.handler_counts(text, "python") == (0, 1) and P.guards(text, "python") == 1.0
    assert P.python_imports("import (") == [] and P.prose_lines("x = (", "python") == [] and P.fragment("x = (", "python") and not P.fragment("x = 1", "python")
    assert P.shape(text, "python")[:2] == (1, 1)


def test_typescript_parsers():
    text = "import a from 'x/y';\nimport './side';\nconst z = require(\"q\"); // note f(1)\n/* long\n comment */\nexport function f(a: T) {\n  if (a) { return g.h('k(')(); }\n  throw new Error(`t`);\n}\nexport const arrow = (x) => {\n  return x.y(1).z();\n};\n"
    assert P.typescript_imports(text) == ["x/y", "q"]
    assert [(s, n) for s, n, _, _ in P.import_spans(text, "typescript")] == [("x/y", 1), ("q", 3)]
    assert "g.h" in P.typescript_callees(text) and "Error" in P.typescript_callees(text) and "<call>.z" in P.typescript_callees(text)
    assert P.sampleable(text, "typescript") == [(6, 9), (10, 12)]
    assert P.prose_lines(text, "typescript") == [3, 4, 5]
    assert not P.fragment(text, "typescript") and P.fragment("}", "typescript")


def test_data_ratio():
    assert P.data_ratio("X = [\n1,\n2,\n'a',\n]\n", "python") == 1.0
    assert P.data_ratio("X = [f(1), g(2)]\ny = 1\n", "python") == 0.0
    assert P.data_ratio("export const X = {\n  a: 1,\n  b: 'two',\n} as const;\n", "typescript") == 1.0
    assert P.data_ratio("", "python") == 0.0


def test_lines(spark):
    df = spark.createDataFrame([("a\nb\n",), ("a\r\nb",), ("",), ("\n",), ("a\n\n",)], "t string")
    assert [r["x"] for r in df.select(T.lines(F.col("t")).alias("x")).collect()] == [["a", "b"], ["a", "b"], [], [""], ["a", ""]]


def test_paths(spark):
    p = ["src/test_x.py", "src/tests/a.py", "src/a.test.ts", "src/a.config.ts", ".eslintrc.js", "src/a.py", "testing/a.py", "src/conftest.py", "__tests__/a.ts"]
    df = spark.createDataFrame([(x,) for x in p], "p string")
    assert [r["x"] for r in df.select(T.excluded(F.col("p")).alias("x")).collect()] == [True] * 5 + [False] + [True] * 3
    assert [r["x"] for r in df.select(T.glob(F.col("p"), "src/*.py").alias("x")).collect()] == [True, True, False, False, False, True, False, True, False]


def test_generated(spark):
    df = spark.createDataFrame([("# DO NOT EDIT\nx", "python"), ('"""generated by me"""', "python"), ("\n" * 15 + "# generated by protoc", "python"), ("\n" * 25 + "# generated by x", "python"), ("// @generated\n", "typescript")], "t string, lang string")
    assert [r["x"] for r in df.select(T.generated(T.lines(F.col("t")), F.col("lang")).alias("x")).collect()] == [True, False, True, False, True]


def test_layout(spark):
    assert one(spark, T.overflow(F.array(*[F.lit(x) for x in "abcde"]))) == "a, b, c (+2 more)"
    assert one(spark, T.frequency(F.lit(3200))) == "3,200×"
    assert one(spark, T.rarity(F.lit(0), F.lit(12), "repo", "names")) == "never seen in repo"
    assert one(spark, T.severity(F.lit(4.5), F.lit(3.0))) == "foreign"


# ---- sources and sinks


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", ".")
    (tmp_path / "a.py").write_text("one\ntwo\n")
    run("add", "."), run("commit", "-qm", "1")
    (tmp_path / "a.py").write_text("one\nTWO\nthree\n")
    (tmp_path / "b.md").write_text("no code")
    run("add", "."), run("commit", "-qm", "2")
    (tmp_path / "a.py").write_text("ONE\nTWO\nthree\n")
    (tmp_path / "new.ts").write_text("x\ny")
    (tmp_path / "empty.ts").write_text("")
    spark.dataSource.register(git.GitHunks)
    read = lambda m, **o: [(r["path"], r["hunk_start"], r["hunk_end"], bytes(r["content"])) for r in spark.read.format("git_hunks").option("mode", m).options(**o).load(str(tmp_path)).collect()]
    assert read("commits") == [("a.py", 1, 3, b"one\nTWO\nthree\n")] == read("range", range="HEAD")
    assert read("workdir") == [("a.py", 0, 1, b"ONE\nTWO\nthree\n")]
    assert read("untracked") == [("new.ts", 0, 2, b"x\ny")]
    assert read("staged") == []
    run("add", "a.py")
    assert read("staged") == [("a.py", 0, 1, b"ONE\nTWO\nthree\n")] and read("workdir") == []


def test_json_lines(spark, tmp_path):
    with pytest.raises(jsonl.NothingWritten):
        jsonl.write(spark.createDataFrame([], "commit_sha string"), str(tmp_path / "none"))
    p = tmp_path / "x.jsonl"
    p.write_text('{"commit_sha": "a", "hunk_start_line": 1}\n\nbroken\n{"commit_sha": "b"}\n')
    assert [r["commit_sha"] for r in jsonl.read(spark, str(p)).orderBy("commit_sha").collect()] == ["a", "b"]


def test_catalogs(spark, tmp_path):
    c = {"corpus": "c", "language": "python", "fixtures": [{"id": "f", "file": "a.py", "category": "k", "hunk_start_line": 1, "hunk_end_line": 2}]}
    (tmp_path / "c.json").write_text(json.dumps(c))
    assert catalogs.fixtures(spark, [str(tmp_path / "c.json")]).first()["id"] == "f"
    c["fixtures"][0]["host_file"] = "h.py"
    (tmp_path / "c.json").write_text(json.dumps(c))
    with pytest.raises(ValueError, match="together"):
        catalogs.fixtures(spark, [str(tmp_path / "c.json")])
    (tmp_path / "t.json").write_text(json.dumps({"targets": [{"name": "n", "url": "u", "prs": [{"pr": 1, "sha": "s"}]}]}))
    assert catalogs.targets(spark, str(tmp_path / "t.json")).first()["prs"][0]["pr"] == 1


def test_modules_survive_broken_files(spark):
    got = {(r["spec"], r["kind"]) for r in modules.resolve(spark, ["{", '{"name": "a"}'], ["no json"]).collect()}
    assert got == {("a", "exact")}


def test_stream_goes_through_batches(spark, tmp_path):
    spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(40)], "k long, g string").repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k long, g string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = scorer.run_once(scorer.running_sample(s, "g", "k", 3), "update", lambda b, n: b.withColumn("n", F.lit(n))).toPandas()
    for g, x in got.groupby("g"):
        last = x[x.n == x.n.max()].h.tolist()
        all_of = [r["h"] for r in spark.read.parquet(str(tmp_path / "in")).where(F.col("g") == g).select(F.concat(F.md5(F.concat(F.lit("0:"), F.col("k").cast("string"))), F.lit(":"), F.col("k").cast("string")).alias("h")).collect()]
        assert sorted(last) == sorted(all_of)[:3]
