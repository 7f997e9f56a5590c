"""State of a service as logs of events: the last event of a key counts, and a table is what its log leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators.catalog import latest_wins

# States of a file being ingested, and what may follow each.
NEXT = {"queued": ["processing"], "processing": ["succeeded", "failed"], "failed": ["queued", "processing"], "succeeded": ["queued"]}


def ingestion_states(events: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, status, attempts, first_at, updated_at) from events (key, status, at, seq): attempts are the times that processing began."""
    last = F.max_by("status", F.struct("at", "seq"))
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("status"), F.sum((F.col("status") == "processing").cast("long")).alias("attempts"), F.min("at").alias("first_at"), F.max("at").alias("updated_at"))


def allowed(before, after):
    """Whether a state may follow another; anything may come first."""
    moves = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return before.isNull() | F.array_contains(F.element_at(moves, before), after)


def latest_run(files: DataFrame) -> DataFrame:
    """(run_id, status, n): counts of the run begun last, of files (run_id, started_at, status)."""
    last = files.agg(F.max(F.struct("started_at", "run_id")).alias("m")).select("m.run_id")
    return files.join(F.broadcast(last), "run_id").groupBy("run_id", "status").agg(F.count("*").alias("n"))


def apply_changes(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A table after a log of changes (key, op, at, seq, fields): create, update and delete.

    The last delete of a key takes it away unless it was created after; of each field the last value that is not null counts.
    """
    order = F.struct("at", "seq")
    c = changes.withColumn("_o", order)
    gone = c.groupBy(key).agg(F.max(F.when(F.col("op") == "delete", F.col("_o"))).alias("_d"), F.max(F.when(F.col("op") == "create", F.col("_o"))).alias("_c"))
    live = c.join(gone, key).where(F.col("_d").isNull() | (F.col("_o") > F.col("_d"))).where("op != 'delete'")
    new = live.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_o"))).alias(f"_n_{f}") for f in fields])
    kept = rows.select(key, *fields).join(gone, key, "left").where("_d is null or _c > _d").select(key, *[F.when(F.col("_d").isNull(), F.col(f)).alias(f) for f in fields])
    made = gone.where("_c is not null and (_d is null or _c > _d)").select(key)
    every = kept.join(made, key, "full").join(new, key, "left")
    return every.select(key, *[F.coalesce(f"_n_{f}", f).alias(f) for f in fields])


def compacted(rows: DataFrame, queue: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows left, queue after): pending deletions are carried out; an entry whose key the table does not hold has failed."""
    pending = queue.where("status = 'pending'").select(key).distinct()
    left = rows.join(pending, key, "left_anti")
    held = rows.select(key).distinct().withColumn("_held", F.lit(True))
    done = F.when(F.col("status") != "pending", F.col("status")).when(F.col("_held"), "completed").otherwise("failed")
    return left, queue.join(held, key, "left").withColumn("status", done).drop("_held")


def pending_deep(fast: DataFrame, deep: DataFrame, key: str = "file_hash") -> DataFrame:
    """Files that the fast phase of ingestion has indexed and the deep phase has not, the oldest first within a task."""
    return fast.join(deep.select(key).distinct(), key, "left_anti")


def health(rows: DataFrame, key: str, checks: dict) -> DataFrame:
    """(check, n, bad, status): rows that break each condition of ``checks``, and repeated keys; 'ok', 'warning' or, from a hundredth on, 'critical'."""
    counted = rows.agg(F.count("*").alias("n"), *[F.sum((~F.coalesce(ok, F.lit(False))).cast("long")).alias(name) for name, ok in checks.items()])
    twice = rows.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated_keys"))
    every = counted.crossJoin(twice)
    each = every.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(k, F.lit(0)).alias("bad")) for k in [*checks, "repeated_keys"]])).alias("x")).select("x.check", "n", "x.bad")
    return each.withColumn("status", F.when(F.col("bad") == 0, "ok").when(F.col("bad") < 0.01 * F.col("n"), "warning").otherwise("critical"))


def save_map(mapping: DataFrame, path: str, key: str = "doc_id", files: int = 16) -> None:
    """A deduplication map (key, canonical) clustered by key, so that look-ups read few row groups."""
    mapping.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def promoted(results: DataFrame, spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Results (qid, key, rnk) with each key replaced by what stands for it in a saved map, the best rank of each kept."""
    m = spark.read.parquet(path).select(key, "canonical")
    named = results.join(m, key, "left").select("qid", F.coalesce("canonical", key).alias(key), "rnk")
    return named.groupBy("qid", key).agg(F.min("rnk").alias("rnk"))


def save_scaffold_run(scaffolds: DataFrame, path: str, run_id: str) -> None:
    """A run of scaffolds: the scaffolds, and the chunks they stand for, under the run's name."""
    scaffolds.drop("chunk_ids").withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{path}/{run_id}/scaffolds")
    scaffolds.select("scaffold_id", F.explode("chunk_ids").alias("chunk_id")).write.mode("overwrite").parquet(f"{path}/{run_id}/members")


def load_scaffold_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    s, m = (spark.read.parquet(f"{path}/{run_id}/{x}") for x in ("scaffolds", "members"))
    return s.join(m.groupBy("scaffold_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids")), "scaffold_id")


def conversation_log(events: DataFrame) -> DataFrame:
    """(id, title, messages, updated_at) of conversations that a log of events (id, op, title, at, seq) leaves: create, rename, message, delete."""
    state = latest_wins(events.where("op = 'delete'").select("id", "at", "seq"), ["id"], ["at", "seq"]).select("id", F.struct("at", "seq").alias("_d"))
    live = events.withColumn("_o", F.struct("at", "seq")).join(state, "id", "left").where(F.col("_d").isNull() | (F.col("_o") > F.col("_d")))
    g = live.groupBy("id").agg(F.max(F.when(F.col("op") == "create", F.col("_o"))).alias("_c"), F.max_by("title", F.when(F.col("title").isNotNull(), F.col("_o"))).alias("title"), F.sum((F.col("op") == "message").cast("long")).alias("messages"), F.max("at").alias("updated_at"))
    return g.where("_c is not null").drop("_c")
