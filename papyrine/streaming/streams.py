"""Structured Streaming forms: tailing logs, TTL cache state, trace buffers, resumable ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG_SCHEMA = "asctime string, levelname string, name string, message string, trace_id string"


def tail_logs(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Line records of a folder as they arrive; the checkpoint keeps the place, broken lines are dropped."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    j = raw.select(F.from_json("value", LOG_SCHEMA).alias("j")).where("j.message is not null").select("j.*")
    return j.select(F.coalesce(F.try_to_timestamp("asctime", F.lit("yyyy-MM-dd HH:mm:ss,SSS")), F.try_to_timestamp("asctime")).alias("at"), F.upper("levelname").alias("level"), F.col("name").alias("component"), "message", "trace_id")


def tail_parquet(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by time window; later rows than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def first_by_key(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark: resumable ingestion."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def ttl_cache(requests: DataFrame, key: str, at: str, ttl_s: int = 300) -> DataFrame:
    """(key, at, hit): whether a request finds an entry no older than the time to live; state expires by event time."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for t in rows["at"]:
            s = t.timestamp()
            hit = last is not None and s - last <= ttl_s
            out.append((k[0], t, hit))
            last = s if not hit else last
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + ttl_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at", "hit"])

    kind = dict(requests.dtypes)[key]
    r = requests.select(F.col(key).alias("key"), F.col(at).alias("at")).withWatermark("at", f"{ttl_s} seconds")
    return r.groupBy("key").applyInPandasWithState(step, f"key {kind}, at timestamp, hit boolean", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_memory(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there and gives the result as a table (for bounded results and tests)."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
