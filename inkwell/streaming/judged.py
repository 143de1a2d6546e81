"""Judged rows as a stream: windowed quality and usage, sessions, consensus with state.

The transformations are the same for a stream and a table.  A watermark bounds the state;
what is later than it is dropped by Spark, as its option says.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from inkwell.functions import labels as L


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_labels(judged: DataFrame, time: str = "judged_at", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each label in tumbling windows."""
    x = judged.select(F.col(time).alias("t"), L.normalized(F.col("tp_fp_label")).alias("label"), "total_tokens")
    if judged.isStreaming:
        x = x.withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", late)
    by = x.groupBy(F.window("t", size).alias("w"), "label")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("tokens")).select(F.col("w.start").alias("window_start"), "label", "n", "tokens")


def sliding_values(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    x = events.withWatermark("ts", late) if events.isStreaming else events
    by = x.groupBy(F.window("ts", size, step).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    by = x.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def running_consensus(votes: DataFrame, quiet: str = "1 hour") -> DataFrame:
    """``unit_id, label, votes``: the majority of a unit's votes so far, state kept between batches.

    ``votes``: unit_id, label, voted_at.  A unit's state ends when the watermark passes
    ``quiet`` after its last vote.
    """
    ms = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = dict(zip(*state.get, strict=True)) if state.exists else {}
        last = 0
        if state.hasTimedOut:
            state.remove()
            return
        for f in frames:
            for label, n in f["label"].value_counts().items():
                counts[label] = counts.get(label, 0) + int(n)
            last = max(last, int(f["voted_at"].max().timestamp() * 1000))
        state.update((list(counts), list(counts.values())))
        state.setTimeoutTimestamp(max(last + ms, state.getCurrentWatermarkMs() + 1))
        rank = {**L.SEVERITY}
        best = max(counts, key=lambda l: (counts[l], rank.get(l, 0)))
        yield pd.DataFrame({"unit_id": [key[0]], "label": [best], "votes": [sum(counts.values())]})

    grouped = votes.withWatermark("voted_at", quiet).groupBy("unit_id")
    return grouped.applyInPandasWithState(update, "unit_id string, label string, votes long", "labels array<string>, counts array<long>", "update", GroupStateTimeout.EventTimeTimeout)
