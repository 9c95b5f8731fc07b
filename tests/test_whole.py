"""Queries that must cover the whole job: nothing after a cap, in a second half or past a prefix may be lost."""

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from vocalith.functions import parse as P
from vocalith.plans import catalog, pipelines
from vocalith.sources.tables import code


def test_every_hit_has_its_place(spark, duck):
    got = catalog.QUERIES["srt11_output_order_whole"](spark, DATA).collect()
    hits = duck.sql("SELECT count(DISTINCT row_id) FROM feature_rows WHERE NOT isnan(features.bpe_score) AND features.bpe_score >= 3").fetchall()[0][0]
    assert hits > 200 and sorted(r["place"] for r in got) == list(range(1, hits + 1))
    first = {tuple(r) for r in catalog.QUERIES["srt11_output_order"](spark, DATA).select("row_id", "place").collect()}
    assert first == {(r["row_id"], r["place"]) for r in got if r["place"] <= 200}


def test_all_stages_reach_the_verdict(spark):
    files = spark.createDataFrame([(1, "c", "import os\nknown(1)", "python"), (2, "c", "import a from 'left-pad'", "typescript")], "entry_id int, corpus string, text string, lang string")
    m = pipelines.fit(files, files, parsed=True)
    texts = [
        ("import os\nimport torch\nimport torch.nn", "python", False),
        ("import os", "python", False),
        ("import x from 'vue'", "typescript", False),
        ("import y from '@app/x'", "typescript", False),
        ("X = [1, 2, 3, 4, 5, 6]", "python", False),
        ("known(1)", "python", True),
        ("odd.call(1", "python", False),
        ("odd.call(1)", "python", False),
    ]
    h = spark.createDataFrame([(i, "c", *t) for i, t in enumerate(texts)], "entry_id int, corpus string, text string, lang string, atypical_file boolean")
    prefixes = spark.createDataFrame([("@app/",)], "prefix string")
    v = pipelines.verdicts(pipelines.guarded(pipelines.stages(h, m), h, m, prefixes), F.lit(0.5))
    got = {r["entry_id"]: (r["import_score"], r["contribution"], r["reason"], r["flagged"], round(r["score"], 6)) for r in v.collect()}
    assert got[0] == (1.0, 0.0, "import", True, 1.0) and got[2] == (1.0, 0.0, "import", True, 1.0)
    assert got[1] == got[3] == (0.0, 0.0, "none", False, 0.0)
    assert got[4] == (0.0, 0.0, "atypical", False, 0.0) and got[5] == (0.0, 0.0, "atypical_file", False, 0.0)
    assert got[6] == (0.0, 0.0, "none", False, 0.0) and got[7] == (0.0, 2.0, "call_receiver", True, 2.0)


def test_cut_texts_have_no_contribution(spark):
    cut = {r["entry_id"] for r in code(spark, DATA).collect() if P.fragment(r["text"], r["lang"])}
    plain, got = ({r["entry_id"]: r for r in catalog.QUERIES[n](spark, DATA).collect()} for n in ("pip1_score_hunk", "pip1_score_hunk_parsed"))
    assert plain.keys() == got.keys() and cut & got.keys()
    for k, r in got.items():
        assert r["contribution"] == (0.0 if k in cut else plain[k]["contribution"])


def test_covariance_is_of_all_dimensions(spark, duck):
    got = {(r["label"], r["i"], r["j"]): (r["cov"], r["inverse"]) for r in catalog.QUERIES["agg29_covariance_whole"](spark, DATA).collect()}
    rows = duck.sql("SELECT label, embedding FROM embeddings").fetchall()
    labels = {k for k, _ in rows}
    assert len(got) == 2080 * len(labels)
    for k in labels:
        full = np.cov(np.array([v for g, v in rows if g == k], float), rowvar=False, bias=True) + 0.001 * np.eye(64)
        inv = np.linalg.inv(full)
        for i, j in ((1, 1), (1, 8), (9, 9), (3, 64), (64, 64)):
            assert got[k, i, j] == pytest.approx((full[i - 1, j - 1], inv[i - 1, j - 1]), rel=1e-4, abs=2e-6)


def test_foreign_specifiers_of_even_documents_are_found(spark, tmp_path):
    texts = ["see app.one\nand b.two", "b.two here", "then\n xb.tw net.x app.one q.r", "q.r app.only"]
    d = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    run = lambda n: {tuple(r) for r in catalog.QUERIES[n](spark, d).collect()}
    assert run("jn1_foreign_exact_whole") == {(2, "xb.tw"), (2, "net.x"), (3, "app.only")}
    assert run("jn2_foreign_prefix_whole") == {(2, "xb.tw"), (3, "app.only")}
    assert run("evd2_imports_whole") == {(2, "xb.tw, net.x", 2, 2, 6, 3, "app.one, b.two, q.r"), (3, "app.only", 1, 5, 12, 3, "app.one, b.two, q.r")}


def test_parse_errors_after_the_fifth_line_are_seen(spark, tmp_path):
    good = "\n".join(["def f():", *[f"    a{i} = {i}" for i in range(3)], "    return [", "        1,", "    ]"])
    bad = "\n".join([*[f"a{i} = {i}" for i in range(5)], "x = ("])
    d = str(tmp_path)
    rows = [(1, "a.py", "c", good), (2, "b.py", "c", bad)]
    spark.createDataFrame(rows, "entry_id long, file string, scope string, hunk_content string").select("*", F.lit("train").alias("set"), F.lit(1).alias("hunk_start_line"), F.lit(2).alias("hunk_end_line")).write.parquet(f"{d}/manifest_entries.parquet")
    assert {tuple(r) for r in catalog.QUERIES["flt11_fragments"](spark, d).collect()} == {(1, False), (2, True)}


def test_feature_rows_of_any_spelling_are_counted(spark, duck):
    n = duck.sql("SELECT count(DISTINCT row_id) FROM feature_rows").fetchall()[0][0]
    got = catalog.QUERIES["snk5_feature_json_whole"](spark, DATA).collect()
    names = {x for (x,) in duck.sql("SELECT name FROM targets").fetchall()}
    assert sum(r["n"] for r in got) == n and {r["corpus"] for r in got} <= names
