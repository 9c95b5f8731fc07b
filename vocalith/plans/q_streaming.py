"""Queries of streams, run over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import table
from ..sources.tables import CODE_SQL
from ..streaming import scorer
from . import pipelines as P
from .q_aggregates import BPE
from .q_pipelines import _held, _model
from .registry import query


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.[p]arquet")  # a pattern, as a stream of a single file needs one


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str1_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type, with a watermark."""
    e = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = scorer.run_once(scorer.windowed_counts(e, "ts", "event_type"), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {BPE} SELECT entry_id, round(bpe, 6) AS bpe FROM bpe")
def str2_stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Fragments scored batch by batch against the model's tables."""
    m = _model(spark, d)
    m.own, m.generic = m.own.persist(), m.generic.persist()
    ids = _held(spark, d).select("entry_id")
    each = lambda b, _: P.stages(b.dropDuplicates(["entry_id"]), m, alpha=0.0).select("entry_id", F.round("bpe", 6).alias("bpe"))
    s = _stream(spark, d, "manifest_entries").where("entry_id is not null and hunk_content is not null and file is not null").select("entry_id", F.col("scope").alias("corpus"), F.col("hunk_content").alias("text"))
    got = scorer.run_once(s, "append", each)
    return got.join(ids, "entry_id", "left_semi").dropDuplicates(["entry_id"])


@query("SELECT event_type, k AS event_id FROM (SELECT event_type, event_id AS k, row_number() OVER (PARTITION BY event_type ORDER BY md5('0:' || event_id), event_id) AS r FROM events) WHERE r <= 20")
def str3_running_sample(spark: SparkSession, d: str) -> DataFrame:
    """A running sample of twenty events of each type."""
    got = scorer.run_once(scorer.running_sample(_stream(spark, d, "events").where("event_type is not null"), "event_type", "event_id", 20), "update", lambda b, n: b.withColumn("number", F.lit(n)))
    last = got.withColumn("last", F.max("number").over(W.partitionBy("event_type"))).where("number = last")  # twenty rows a type and batch
    return last.select("event_type", F.substring_index("h", ":", -1).cast("long").alias("event_id"))


@query(f"WITH {CODE_SQL} SELECT lang, count(*) AS n FROM code GROUP BY lang")
def str4_batch_union(spark: SparkSession, d: str) -> DataFrame:
    """Files by language, counted on the stream of entries, each entry once."""
    from ..functions.text import SCORE_LANGUAGE, language
    from ..sources.tables import clean_path

    s = _stream(spark, d, "manifest_entries").where("entry_id is not null and hunk_content is not null and file is not null").dropDuplicates(["entry_id"])
    g = s.select(language(clean_path(F.col("file")), SCORE_LANGUAGE).alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return scorer.run_once(g, "complete")
