"""Daily update of camera networks as a stream, and the same in batch.

Block values arrive late by up to the archive's horizon. Repeats are dropped within the watermark, values of a day are
their median, and each micro-batch renews the days that it touches in the history table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.base import c

LATENESS = "85 days"


def deduplicated(frames: DataFrame, keys: list[str], ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """One row per key, on a stream within the watermark, in batch over all."""
    if frames.isStreaming:
        return frames.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)
    return frames.dropDuplicates(keys)


def daily_medians(frames: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """(keys, date, n, value): the median of each day's values."""
    day = F.window(c(ts), "1 day").alias("w") if frames.isStreaming else F.date_trunc("day", c(ts)).alias("w")
    out = frames.groupBy(*keys, day).agg(F.count(value).alias("n"), F.percentile(c(value), F.lit(0.5)).alias(value))
    date = F.col("w.start") if frames.isStreaming else F.col("w")
    return out.select(*keys, date.cast("date").alias("date"), "n", value)


def missing_days(wanted: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Days of each camera that its history lacks, gaps inside it included."""
    return wanted.join(history.select(*keys, "date").distinct(), [*keys, "date"], "left_anti")


def update(frames: DataFrame, keys: list[str], value: str, table: str, checkpoint: str, ts: str = "ts", lateness: str = LATENESS) -> StreamingQuery:
    """Runs the stream over all that is there and ends; days go to a Parquet table, appended once they are complete."""
    days = daily_medians(deduplicated(frames, [*keys, ts], ts, lateness), keys, value, ts)
    return days.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(frames: DataFrame, keys: list[str], value: str, table: str, checkpoint: str, ts: str = "ts") -> StreamingQuery:
    """Like ``update`` but days are there as soon as they have a value, and follow late ones whenever they come.

    ``table``/values keeps the values of every micro-batch in a folder of its own (a repeated batch overwrites it), by
    date. The days that a batch touches are computed again from all their values and replace those in ``table``/days.
    """
    spark = frames.sparkSession
    schema = T.StructType([*frames.select(*keys, ts, value).schema.fields, T.StructField("date", T.DateType())])

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.select(*keys, ts, value).withColumn("date", c(ts).cast("date"))
        own.write.mode("overwrite").partitionBy("date").parquet(f"{table}/values/batch={number}")
        every = spark.read.schema(schema).option("basePath", f"{table}/values").parquet(f"{table}/values")
        touched = own.select("date").distinct()
        days = daily_medians(every.join(touched, "date", "left_semi").drop("date").dropDuplicates([*keys, ts]), keys, value, ts)
        days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{table}/days")

    return frames.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
