"""Streams: fragments scored as they arrive, flag rates over time, running samples.

The reference operators are batch ones; these apply the same tables to streams. Every query runs with a checkpoint in the shared
folder, so that it goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path


def run_once(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote. In complete mode the last state is kept, else the rows of
    all batches. `each` is applied to a batch before it is written."""
    spark = stream.sparkSession
    out, check = shared_path(spark, "stream"), shared_path(spark, "stream-check")

    def write(batch: DataFrame, number: int) -> None:
        rows = each(batch, number) if each else batch
        # a batch that is repeated after a failure replaces its own part
        rows.write.mode("overwrite").parquet(out + "/all" if mode == "complete" else f"{out}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out + ("/all" if mode == "complete" else ""))
    return got.drop("batch") if "batch" in got.columns and mode != "complete" else got


def windowed_counts(events: DataFrame, ts: str, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by, n, total): counts and sums of value by tumbling window, late rows waited for."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, size), by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def running_sample(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """For each value of `by`, the n rows seen so far that come first by a hash of the key. The state is n hashes, whatever
    arrives; each batch gives the values that changed, whole."""

    def update(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held = list(state.get[0]) if state.exists else []
        for b in batches:
            held = sorted(set(held) | set(b["h"]))[:n]
        state.update((held,))
        yield pd.DataFrame({by: [group[0]] * len(held), "h": held})

    hashed = rows.select(by, F.concat(F.md5(F.concat(F.lit("0:"), F.col(key).cast("string"))), F.lit(":"), F.col(key).cast("string")).alias("h"))
    return hashed.groupBy(by).applyInPandasWithState(update, f"{by} string, h string", "held array<string>", "update", "NoTimeout")
