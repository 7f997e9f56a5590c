"""Sinks: parquet and line records, resumable appends, upserts, manifests, index and vector stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators.catalog import latest_wins, not_yet
from papyrine.operators.sparse import index_tables


def append_new(df: DataFrame, path: str, key: str = "file_path") -> DataFrame:
    """Appends rows whose key the table does not hold yet; returns those."""
    try:
        df = not_yet(df, df.sparkSession.read.parquet(path), key)
    except Exception as x:
        if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER_SCHEMA" not in str(x):
            raise
    df.write.mode("append").parquet(path)
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    """Line records; the commit protocol makes them appear at once."""
    df.write.mode("overwrite").json(path)


def write_manifest(spark: SparkSession, path: str, **facts) -> None:
    spark.createDataFrame([{k: str(v) for k, v in facts.items()}]).coalesce(1).write.mode("overwrite").json(path)


def save_index(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", files: int = 16) -> None:
    """The sparse index as tables; postings are clustered by term, so a query reads few row groups."""
    for name, t in index_tables(documents, key, text).items():
        (t.repartitionByRange(files, "term").sortWithinPartitions("term") if name in ("tf", "df") else t).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("tf", "df", "dl", "stats")}


def upsert(new: DataFrame, path: str, out: str, key: str = "id", at: str = "updated_at") -> None:
    """Old and new rows merged into ``out``, the last of each key."""
    old = new.sparkSession.read.parquet(path)
    latest_wins(old.unionByName(new, allowMissingColumns=True), [key], [F.col(at)]).write.mode("overwrite").parquet(out)


def save_vectors(df: DataFrame, path: str, key: str = "id", files: int = 16) -> None:
    """Vectors clustered by key for look-ups."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def vectors_by_id(spark: SparkSession, path: str, wanted: DataFrame, key: str = "id") -> DataFrame:
    return spark.read.parquet(path).join(wanted.select(key).distinct(), key, "left_semi")


def export_audit(df: DataFrame, path: str, form: str = "csv") -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if form == "csv" else w.json(path)


def response_lines(results: DataFrame) -> DataFrame:
    """(qid, seq, line): a source event for each result and a done event, as line records."""
    s = results.select("qid", F.col("rnk").alias("seq"), F.to_json(F.struct(F.lit("source").alias("type"), "doc_id", "score")).alias("line"))
    d = results.groupBy("qid").agg((F.max("rnk") + 1).alias("seq"), F.count("*").alias("n")).select("qid", "seq", F.to_json(F.struct(F.lit("done").alias("type"), "n")).alias("line"))
    return s.unionByName(d)
