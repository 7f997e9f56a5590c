"""Partition layout and lineage helpers shared by the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors share; it goes when the application ends.

    Where the setting is missing, a session in one process gets a temporary folder. On a
    cluster such a folder would be another one on every machine, so that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="papyrine-checkpoint-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    at = (context.applicationId, found)
    if at not in _folders:
        _folders[at] = f"{found.rstrip('/')}/papyrine-{context.applicationId}"
        fs, path = _files(spark, _folders[at])
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _folders[at]


def _files(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, so later plans start from files.

    A written table survives the loss of executors and, unlike a checkpoint, keeps
    only encoded columns, which later steps can prune.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*written: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing reads any more; what was made of them must itself be written."""
    for df in written:
        fs, path = _files(df.sparkSession, df._written)
        fs.delete(path, True)


#: Plan nodes behind which counting partitions would run something, or whose partitions were chosen.
_SETTLED = ("Repartition", "RepartitionByExpression", "RebalancePartitions", "Aggregate", "Join", "Window", "Sort", "Distinct", "Deduplicate", "GlobalLimit", "LocalLimit", "Offset", "Union", "Except", "Intersect", "CoGroup")


def _nodes(plan) -> list[str]:
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p.nodeName())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartitions a scan with fewer partitions than cores; larger inputs pass without a shuffle.

    Only scans are looked at: to count the partitions behind a shuffle, adaptive execution
    would have to run it.
    """
    if set(_nodes(df._jdf.queryExecution().optimizedPlan())) & set(_SETTLED):
        return df
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
