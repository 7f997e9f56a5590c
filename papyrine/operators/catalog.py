"""Collections, state logs, caches, versions: what a service keeps, as tables."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEEP_VERSIONS = 3


def latest_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key: an upsert read from its log."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def with_counts(collections: DataFrame, members: DataFrame, key: str = "collection_id") -> DataFrame:
    """Collections with their number of members, none counting 0."""
    n = members.groupBy(key).agg(F.count("*").alias("document_count"))
    return collections.join(n, collections["id"] == n[key], "left").drop(n[key]).withColumn("document_count", F.coalesce("document_count", F.lit(0).cast("long")))


def fetch(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def not_yet(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done: the resume filter."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def delete_cascade(members: DataFrame, collections: DataFrame, deleted: DataFrame, key: str = "doc_id", group: str = "collection_id") -> tuple[DataFrame, DataFrame]:
    """(members left, collections left): collections that a deletion empties go with it."""
    left = members.join(deleted.select(key).distinct(), key, "left_anti")
    had = members.select(F.col(group).alias("id")).distinct().withColumn("_had", F.lit(1))
    has = left.select(F.col(group).alias("id")).distinct().withColumn("_has", F.lit(1))
    kept = collections.join(had, "id", "left").join(has, "id", "left").where("_had is null or _has is not null").drop("_had", "_has")
    return left, kept


def compaction_steps(queue: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """The next entries of a deletion queue (key, status, priority, enqueued_at)."""
    return queue.where("status = 'pending'").orderBy(F.col("priority").desc(), "enqueued_at", key).limit(limit)


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def cache_lookup(entries: DataFrame, queries: DataFrame, now, ttl_s: int = 300, threshold: float = 0.92) -> DataFrame:
    """(qid, key, score): the best live entry (key, embedding, stored_at) of each query at the threshold."""
    from papyrine.operators.dense import cosine_top_k

    live = entries.where(F.unix_timestamp(now) - F.unix_timestamp("stored_at") <= ttl_s)
    return cosine_top_k(live, queries, 1, key="key").where(F.round("score", 6) >= threshold).select("qid", "key", "score")


def live_entries(accesses: DataFrame, now, ttl_s: int, size: int, key: str = "key", at: str = "at") -> DataFrame:
    """(key, last_access): entries within their time to live, the ``size`` last used."""
    last = accesses.groupBy(key).agg(F.max(at).alias("last_access"))
    return last.where(F.unix_timestamp(now) - F.unix_timestamp("last_access") <= ttl_s).orderBy(F.col("last_access").desc(), key).limit(size)


def trace_buffer(events: DataFrame, trace: str, at: str, order: str, most: int = 200, age_s: int | None = 600, now=None) -> DataFrame:
    """The last ``most`` events of each trace, none older than ``age_s``."""
    rows = events if age_s is None or now is None else events.where(F.unix_timestamp(now) - F.unix_timestamp(at) <= age_s)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(trace).orderBy(F.col(at).desc(), F.col(order).desc()))).where(F.col("_n") <= most).drop("_n")


def migrate_ids(chunks: DataFrame, new_id) -> tuple[DataFrame, DataFrame]:
    """(plan, clashes): old and new ids that differ, and new ids that more than one row would get."""
    p = chunks.withColumn("new_id", new_id)
    clash = p.groupBy("new_id").agg(F.count("*").alias("n")).where("n > 1")
    return p.where(F.col("id") != F.col("new_id")).select("id", "new_id"), clash


def publish(df: DataFrame, root: str, now: float | None = None) -> str:
    """Writes a new version, checks its number of rows, moves the pointer and drops versions beyond KEEP_VERSIONS."""
    version = f"v{int((now or time.time()) * 1000):015d}"
    path = f"{root}/{version}"
    df.write.parquet(path)
    if df.sparkSession.read.parquet(path).count() != df.count():
        raise RuntimeError(f"{path} does not hold all rows")
    _point(df.sparkSession, root, version)
    fs, Path = _fs(df.sparkSession, root)
    for old in versions(df.sparkSession, root)[:-KEEP_VERSIONS]:
        fs.delete(Path(f"{root}/{old}"), True)
    return version


def _fs(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _point(spark: SparkSession, root: str, version: str) -> None:
    fs, path = _fs(spark, root)
    out = fs.create(path(f"{root}/current.json.tmp"), True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    fs.delete(path(f"{root}/current.json"), False)
    fs.rename(path(f"{root}/current.json.tmp"), path(f"{root}/current.json"))


def versions(spark: SparkSession, root: str) -> list[str]:
    fs, path = _fs(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(path(root)) if s.getPath().getName().startswith("v"))


def current_version(spark: SparkSession, root: str) -> str:
    return json.loads(spark.read.text(f"{root}/current.json").first()[0])["version"]


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, current_version(spark, root)))


def rollback(spark: SparkSession, root: str) -> str:
    """Points to the version before the current one."""
    all_versions = versions(spark, root)
    now = current_version(spark, root)
    before = [v for v in all_versions if v < now]
    if not before:
        raise RuntimeError("there is no earlier version")
    _point(spark, root, before[-1])
    return before[-1]
