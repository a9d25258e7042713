"""What the training-data operators share: Arrow batch bounds, tables in the shared folder, whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import forget, stored

__all__ = ["bounded_batches", "forget", "read", "sendable", "stored", "text_of"]

#: Rows and bytes that one Arrow batch may hold: what bounds a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


#: Rows of a few numbers that a broadcast may hold.
SENT_ROWS = 1_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(col: str) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sendable(keys: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """A stored table of keys for a join with texts: broadcast if it is small, so that no text is shuffled, else joined by merging."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys.hint("merge")
