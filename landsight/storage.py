"""Tables in the folder that driver and executors share: how loops cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``stored`` has written and nobody has deleted, oldest first.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if all of Spark is this one process, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        where = f"file://{tempfile.mkdtemp(prefix='landsight-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again."""
    path = f"{shared_folder(df.sparkSession)}/landsight-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._landsight_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if path in _written:
        _written.remove(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_landsight_path", None):
            _delete(df.sparkSession, path)


def written() -> list[str]:
    """The folders that ``stored`` has written so far and that still stand."""
    return [*_written]


def forget_others(spark: SparkSession, before: list[str], *kept: DataFrame) -> None:
    """Deletes what ``stored`` has written since ``before``, but for the tables that are kept: what a finished step leaves."""
    held = {*before, *(getattr(df, "_landsight_path", None) for df in kept)}
    for path in written():
        if path not in held:
            _delete(spark, path)
