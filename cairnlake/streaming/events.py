"""Structured streams over the events: deduplication, windows and per-key state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnlake.session import shared_dir

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, data_dir: str) -> DataFrame:
    """The events as a stream of files; the pattern also matches a folder of that name."""
    path = f"{data_dir}/events.parquet*"
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str, horizon: str) -> DataFrame:
    """Each key once; state is kept for the horizon."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, width: str, late: str) -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("hour"), "event_type", "n")


def superseding(events: DataFrame, seconds: int, late: str = "1 day") -> DataFrame:
    """Per user and batch: events seen, and how many came within `seconds` after the user's latest one before. The state is the time of the
    latest; it goes once the watermark says that nothing can follow it closely. An event older than the latest, from a batch that
    comes late, is seen but follows nothing."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = np.sort(np.concatenate([b["micros"].to_numpy() for b in batches]))
        before = np.concatenate([[times[0] - (seconds + 1) * 1_000_000 if last is None else last], times[:-1]])
        before = np.maximum.accumulate(before)
        hits = int(np.sum((times >= before) & (times - before <= seconds * 1_000_000)))
        newest = int(max(times[-1], before[0]))
        ends = newest // 1000 + seconds * 1000 + 1
        state.update((newest,))
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        yield pd.DataFrame({"user_id": [key[0]], "superseded": [hits], "seen": [len(times)]})
    e = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("micros"))
    return e.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, superseded bigint, seen bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote. Each micro-batch writes its own folder, so one that is repeated
    after a failure replaces itself; in complete mode the last one holds."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
