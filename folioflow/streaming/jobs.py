"""Streaming jobs (T4, T5) and an extension over timed events.

The windowed rollup has no counterpart in batch document processing; it is an extension for event logs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def usage_ledger(calls: DataFrame) -> DataFrame:
    """T4: running totals of each model as calls arrive: one row a model and micro-batch (stateful, keyed by model)."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, i, o = state.get if state.exists else (0, 0, 0)
        for b in batches:
            n, i, o = n + len(b), i + int(b["input_tokens"].sum()), o + int(b["output_tokens"].sum())
        state.update((n, i, o))
        yield pd.DataFrame({"model": [key[0]], "calls": [n], "input_tokens": [i], "output_tokens": [o]})

    return calls.groupBy("model").applyInPandasWithState(add, "model string, calls bigint, input_tokens bigint, output_tokens bigint", "calls bigint, input_tokens bigint, output_tokens bigint", "update", GroupStateTimeout.NoTimeout)


def ingest(files: DataFrame, process, target: str, checkpoint: str):
    """New contents are processed once and their rows appended; a repeated content within the watermark-free state is dropped by its hash.

    ``process`` maps a batch DataFrame to result rows. Each micro-batch writes its own folder, so a replayed batch overwrites itself.
    """
    fresh = files.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def skip_done(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Documents whose content and settings key have no complete result yet."""
    return wanted.join(done.where("complete").select(*key), key, "left_anti")


def event_windows(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling windows by event type with a watermark; the same plan runs over batch rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
