"""Composite operators: fitting a corpus, scoring fragments, calibrating thresholds, checking and reporting.

A model is a set of tables (`Model`); scoring joins fragments with them, so nothing is fitted again when fragments are checked.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..operators import hashing, learn, sampling
from ..operators import model as M
from ..operators.verdict import arbitrate, thresholds
from ..session import cut


@dataclass
class Model:
    """own, generic: (token, n); known: (callee, root); by_cluster: (cluster_id, callee, n_files); sizes: (cluster_id, size); modules:
    (spec), what the files import by parser, without which foreign imports can't be told."""

    own: DataFrame
    generic: DataFrame
    known: DataFrame
    by_cluster: DataFrame
    sizes: DataFrame
    modules: DataFrame | None = None

    def write(self, path: str) -> None:
        for name in ("own", "generic", "known", "by_cluster", "sizes", *(["modules"] if self.modules is not None else [])):
            getattr(self, name).write.mode("error").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str, modules: bool = False) -> Model:  # noqa: ANN001
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in ("own", "generic", "known", "by_cluster", "sizes", *(["modules"] if modules else []))])


def imports(df: DataFrame, key: str) -> DataFrame:
    """df(key, text, lang) -> (key, spec): what each text imports, each once; nothing of Python that does not parse."""
    found = P.column(lambda t, g: P.python_imports(t) if g == "python" else P.typescript_imports(t), "array<string>")
    return df.select(key, F.explode(found("text", "lang")).alias("spec"))


def clustered(files: DataFrame, k: int = 8, permutations: int = 128) -> DataFrame:
    """files(entry_id, text, ...) with cluster_id: at most k clusters of the signatures of what the files call; files that call nothing
    have the signature of zeros."""
    sig = hashing.signature(F.array_distinct(T.callees(F.col("text"))), permutations)
    s = files.select("entry_id", F.transform(sig, lambda x: x / F.lit(float(hashing.PRIME))).alias("sig"))
    return files.join(learn.kmeans(s, "sig", k).select("entry_id", F.col("cluster_id").cast("int").alias("cluster_id")), "entry_id")


def fit(files: DataFrame, generic_text: DataFrame, cluster: str = "corpus", parsed: bool = False) -> Model:
    """files(entry_id, corpus, text) of the corpus, with lang if parsed, for its modules; generic_text(text) of the baseline."""
    tokens = T.word_tokens(F.col("text"))
    calls = files.select("entry_id", F.col(cluster).alias("cluster_id"), F.explode(F.array_distinct(T.callees(F.col("text")))).alias("callee"))
    by = calls.groupBy("cluster_id", "callee").agg(F.count(F.lit(1)).alias("n_files"))
    sizes = files.groupBy(F.col(cluster).alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))
    modules = imports(files, "entry_id").select("spec").distinct() if parsed else None
    return Model(M.token_counts(files, tokens), M.token_counts(generic_text, tokens), M.attested(calls), by, sizes, modules)


def stages(hunks: DataFrame, m: Model, routing: str = "none", alpha: float = 2.0, root_bonus: float = 2.0, beta: float = 5.0, tau: int = 0, cap: float = 5.0) -> DataFrame:
    """hunks(entry_id, corpus, text) -> (entry_id, import_score, bpe, contribution). routing none ignores clusters, static takes the
    corpus as the cluster, nearest the cluster whose callees are most like the text's (of a model fitted on `clustered` files). alpha of 0 or less switches the callee stage off."""
    tokens = T.word_tokens(F.col("text"))
    bpe = M.bpe_scores(hunks, "entry_id", tokens, m.own, m.generic)
    calls = hunks.select("entry_id", F.col("corpus").alias("cluster_id"), F.explode(F.array_distinct(T.callees(F.col("text")))).alias("callee"))
    if routing == "nearest":
        bags = calls.select("entry_id", "callee")
        calls = bags.join(M.nearest_cluster(bags, "entry_id", m.by_cluster.select("cluster_id", "callee")).select("entry_id", "cluster_id"), "entry_id")
    if alpha <= 0 and routing == "none":
        part = None
    elif routing == "none":
        part = M.contributions(M.resolve(calls, "entry_id", m.known, alpha, root_bonus), "entry_id", cap)
    else:
        part = M.contributions(M.cluster_weights(calls, "entry_id", m.known, m.by_cluster, m.sizes, beta, tau), "entry_id", cap)
    out = bpe if part is None else bpe.join(part, "entry_id", "left")
    contribution = F.lit(0.0) if part is None else F.coalesce("contribution", F.lit(0.0))
    return out.select("entry_id", F.lit(0.0).alias("import_score"), "bpe", contribution.alias("contribution"))


def blanked(hunks: DataFrame) -> DataFrame:
    """hunks(text, lang, ...) with the lines of prose emptied, so that comments and docstrings have no surprise."""
    return hunks.withColumn("text", P.column(P.blank_prose, "string")("text", "lang"))


def guarded(scored: DataFrame, hunks: DataFrame, m: Model, prefixes: DataFrame | None = None, typical: bool = True) -> DataFrame:
    """The output of stages with what needs a parser, for hunks(entry_id, text, lang, and atypical_file if known): import_score is
    the number of imports foreign to the model's modules and to prefixes(prefix), a text that does not stand on its own has no
    contribution, and what is atypical has no scores but that as its barred reason. With typicality off a header that says that
    the text is generated bars it instead."""
    if m.modules is None:
        raise ValueError("foreign imports need a model that was fitted with its modules")
    own = imports(hunks, "entry_id")
    foreign = own.join(m.modules, "spec", "left_anti") if prefixes is None else M.foreign(own, m.modules, prefixes)
    n = foreign.groupBy("entry_id").agg(F.count(F.lit(1)).cast("double").alias("_foreign"))
    cut_text = P.column(P.fragment, "boolean")("text", "lang").alias("_fragment")
    if typical:
        names = ("literal_ratio", "control_density", "entropy", "distinct_ratio", "n_leaves")
        shape = P.struct_column(P.typicality, names, "literal_ratio double, control_density double, entropy double, distinct_ratio double, n_leaves int")
        of_file = F.coalesce("atypical_file", F.lit(False)) if "atypical_file" in hunks.columns else F.lit(False)
        h = hunks.select("entry_id", shape("text", "lang").alias("_t"), cut_text, of_file.alias("_file"))
        h = h.select("entry_id", "_fragment", F.when((F.col("_t.n_leaves") >= 5) & (F.col("_t.literal_ratio") > 0.8), "atypical").when(F.col("_file"), "atypical_file").alias("barred"))
    else:
        h = hunks.select("entry_id", cut_text, F.when(T.generated(T.lines(F.col("text")), F.col("lang")), "auto_generated").alias("barred"))
    j = scored.drop("import_score").join(h, "entry_id").join(n, "entry_id", "left")
    zero = lambda c: F.when(F.col("barred").isNotNull(), 0.0).otherwise(c)
    contribution = F.when(F.col("_fragment"), 0.0).otherwise(F.col("contribution"))
    return j.select("entry_id", zero(F.coalesce("_foreign", F.lit(0.0))).alias("import_score"), zero(F.col("bpe")).alias("bpe"), zero(contribution).alias("contribution"), "barred")


def verdicts(scored: DataFrame, limit) -> DataFrame:  # noqa: ANN001
    """scored(entry_id, import_score, bpe, contribution, and barred if guarded) with reason, flagged and score."""
    barred = F.col("barred") if "barred" in scored.columns else F.lit(None).cast("string")
    reason = F.coalesce(barred, arbitrate(F.col("import_score"), F.col("bpe"), F.col("contribution"), limit))
    out = scored.withColumn("reason", reason)
    score = F.when(F.col("reason") == "call_receiver", F.col("bpe") + F.col("contribution")).when(F.col("reason") == "import", F.col("import_score")).otherwise(F.col("bpe"))
    return out.withColumn("flagged", (F.col("reason") != "none") & barred.isNull()).withColumn("score", score)


def calibrate(pool: DataFrame, m: Model, n: int, seeds: int, mode: str = "max", pct: float = 95.0) -> DataFrame:
    """One row (threshold): the median over seeds of the threshold of each seed's sample of n fragments. Every fragment is scored
    once; seeds are rows, not a loop. Calibration leaves the callee weights out, as the terms that normal code shares."""
    scored = stages(pool, m, alpha=0.0)
    h = F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("entry_id").cast("string")))
    drawn = cut(sampling.top(scored.select("*", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")), ["seed"], n, h, F.col("entry_id")).drop("place"))  # n rows a seed
    per = thresholds(drawn.select("seed", (F.col("bpe") + F.col("contribution")).alias("score")), ["seed"], "score", mode, pct)
    return per.agg(F.coalesce(F.median("t"), F.lit(0.0)).alias("threshold"))


CONFIG_VERSION = 2


def config(thresholds: dict[str, float], n_cal: int, seeds: int) -> str:
    """The settings of each language as JSON, version 2."""
    langs = {k: {"threshold": v, "call_receiver_alpha": 2.0, "call_receiver_cap": 5, "call_receiver_root_bonus": 2.0, "calibration": {"n_cal": n_cal, "n_seeds": seeds}} for k, v in sorted(thresholds.items())}
    return json.dumps({"version": CONFIG_VERSION, "languages": langs}, sort_keys=True)


def read_config(text: str) -> dict[str, float]:
    """The threshold of each language; another version is refused."""
    c = json.loads(text)
    if c.get("version") != CONFIG_VERSION or not isinstance(c.get("languages"), dict):
        raise ValueError(f"settings of version {c.get('version')} can't be read: version {CONFIG_VERSION} is needed")
    return {k: float(v["threshold"]) for k, v in c["languages"].items()}


def _cell(x, digits: int = 4):  # noqa: ANN001, ANN202
    """A number of a report, with so many decimals; a dash where there is none."""
    scale = float(10**digits)
    return F.coalesce((F.floor(F.round(x, 9) * scale + 0.5) / scale).cast(f"decimal(30,{digits})").cast("string"), F.lit("-"))


def report(corpora: DataFrame, scored: DataFrame, top: int = 5) -> DataFrame:
    """(section, corpus, line): the report's sections as lines of markdown tables. corpora(corpus, auc, recall, fp, threshold);
    scored(row_id, corpus, is_break, category, difficulty, scorer_reason, bpe_score, fixture_id, flagged)."""
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    of = lambda name, df, *cells: df.select(F.lit(name).alias("section"), "corpus", row(*cells).alias("line"))
    hits = F.sum(F.col("flagged").cast("int"))
    breaks, controls = scored.where("is_break"), scored.where("is_break = false")
    ends = scored.groupBy("corpus").agg(
        F.min(F.when(F.col("is_break"), F.col("bpe_score"))).alias("lo"), F.max(F.when(~F.col("is_break"), F.col("bpe_score"))).alias("hi"),
        F.count_if(F.col("is_break")).alias("n_fix"), F.count_if(~F.col("is_break")).alias("n_ctrl"),
    )
    head = of("headline", corpora.join(ends, "corpus"), text("corpus"), *[_cell(F.col(c)) for c in ("auc", "recall", "fp")], _cell(F.col("lo") - F.col("hi"), 3), text("n_fix"), text("n_ctrl"), _cell(F.col("threshold"), 3))
    by = lambda k: breaks.where(F.col(k).isNotNull()).groupBy("corpus", k).agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"), F.avg("bpe_score").alias("mean"), F.min("bpe_score").alias("lo"), F.max("bpe_score").alias("hi"))
    kinds = [of(k, by(k), text(k), text("n"), text("hits"), *[_cell(F.col(c), 3) for c in ("mean", "lo", "hi")]) for k in ("category", "difficulty")]
    spread = [of("distribution", part.groupBy("corpus").agg(*[F.percentile("bpe_score", q).alias(f"q{i}") for i, q in enumerate((0.0, 0.25, 0.5, 0.75, 0.95, 1.0))]), F.lit(name), *[_cell(F.col(f"q{i}"), 3) for i in range(6)]) for name, part in (("breaks", breaks), ("controls", controls))]
    stages = of("stages", scored.groupBy("corpus", F.coalesce("scorer_reason", F.lit("none")).alias("reason")).agg(F.count_if(F.col("is_break")).alias("b"), F.count_if(~F.col("is_break")).alias("c")), text("reason"), text("b"), text("c"))
    missed = of("missed", breaks.where(~F.col("flagged")), text("row_id"), text("fixture_id"), text("category"), _cell(F.col("bpe_score"), 3))
    best = sampling.top(controls.where("bpe_score is not null"), ["corpus"], top, -F.col("bpe_score"), F.col("row_id"))
    out = head
    for part in (*kinds, *spread, stages, missed, of("top_controls", best, text("row_id"), _cell(F.col("bpe_score"), 3))):
        out = out.unionByName(part)
    return out


HEADS = {"headline": "corpus | auc | recall | false positives | gap | fixtures | controls | threshold", "category": "category | n | hits | mean | min | max", "difficulty": "difficulty | n | hits | mean | min | max", "distribution": "rows | min | p25 | median | p75 | p95 | max", "stages": "reason | breaks | controls", "missed": "row | fixture | category | score", "top_controls": "row | score"}


def markdown(lines: DataFrame) -> DataFrame:
    """(place, line): a report's lines in order, each section of a corpus below its heading."""
    heads = lines.select("section", "corpus").distinct()
    at = F.create_map(*[F.lit(x) for i, k in enumerate(HEADS) for x in (k, i)])
    names = F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv])
    top = heads.select("section", "corpus", F.lit(0).alias("kind"), F.concat(F.lit("## "), "corpus", F.lit(": "), "section", F.lit("\n\n| "), F.try_element_at(names, "section"), F.lit(" |")).alias("line"))
    return lines.select("section", "corpus", F.lit(1).alias("kind"), "line").unionByName(top).withColumn("place", F.try_element_at(at, "section")).orderBy("corpus", "place", "kind", "line").select("corpus", "line")
