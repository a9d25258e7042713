"""The driver's tables in the roles of the domain, as DataFrames and as the same relations in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.terrain import Grid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that says the same."""
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor series: a camera's values in time."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cam"), F.col("event_type").alias("view"), "event_id", "ts", "value")


SERIES = "(SELECT user_id AS cam, event_type AS view, event_id, ts, value FROM events)"


def view_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each view and day; the calendar is stretched so that every fifth day is missing."""
    day = F.col("ts").cast("date")
    s = series(spark, sf_dir).withColumn("date", F.date_add(day, F.floor((F.dayofmonth(day) - 1) / 4).cast("int")))
    return s.groupBy("view", "date").agg(F.round(F.avg("value"), 6).alias("value"))


VIEW_DAYS = "(SELECT event_type AS view, ts::DATE + CAST((day(ts) - 1) // 4 AS INTEGER) AS date, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field samples over years."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 4).alias("cam"), F.concat(F.lit("s"), F.col("o_custkey") % 20).alias("site"), F.col("o_orderpriority").alias("species"),
                    F.col("o_orderdate").cast("date").alias("date"), F.round(F.col("o_totalprice") / 1000, 3).alias("lfmc"), (F.col("o_custkey") % 97).cast("double").alias("x"), F.col("o_orderkey").alias("id"))


SAMPLES = ("(SELECT o_custkey % 4 AS cam, 's' || (o_custkey % 20) AS site, o_orderpriority AS species, o_orderdate::DATE AS date, "
           "round(o_totalprice / 1000, 3) AS lfmc, CAST(o_custkey % 97 AS DOUBLE) AS x, o_orderkey AS id FROM orders)")  # fmt: skip


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block colours: a vector is a frame of 8 x 8 blocks, its label the view, a frame every third day."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("view"), F.col("embedding").alias("e"))
    e = e.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63))))
    at = lambda k: F.lit(100.0) + F.lit(60.0) * F.get("e", (F.col("p") + k) % 64).cast("double")
    ts = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("frame") * 3 % 1461).cast("int"))
    return e.select("frame", "view", ts.alias("date"), F.floor(F.col("p") / 8).cast("int").alias("br"), (F.col("p") % 8).cast("int").alias("bc"), at(0).alias("r"), at(1).alias("g"), at(2).alias("b"), ((F.col("frame") + F.col("p")) % 11 != 0).alias("valid"))


BLOCKS = ("(SELECT vec_id AS frame, label AS view, DATE '2020-01-01' + CAST(vec_id * 3 % 1461 AS INTEGER) AS date, CAST(p // 8 AS INTEGER) AS br, CAST(p % 8 AS INTEGER) AS bc, "
          "100 + 60 * CAST(embedding[p + 1] AS DOUBLE) AS r, 100 + 60 * CAST(embedding[(p + 1) % 64 + 1] AS DOUBLE) AS g, "
          "100 + 60 * CAST(embedding[(p + 2) % 64 + 1] AS DOUBLE) AS b, (vec_id + p) % 11 <> 0 AS valid FROM embeddings CROSS JOIN range(64) AS t(p))")  # fmt: skip

#: Columns of the terrain.
COLS = 38


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    """Cells of 3 arc seconds, as many rows as the customers fill."""
    last = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 0
    return Grid(38.0, -1 / 1200, -120.0, 1 / 1200, last // COLS + 1, COLS)


LAST_ROW = "(SELECT max(c_custkey) // 38 FROM customer)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain: a customer is a cell, its height the account balance; what the last row lacks is at sea level."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    every = spark.range(grid(spark, sf_dir).rows * COLS).join(c, "id", "left")
    return every.select(F.floor(F.col("id") / COLS).cast("int").alias("row"), (F.col("id") % COLS).cast("int").alias("col"), (F.coalesce("c_acctbal", F.lit(0.0)) / 400).alias("z"))


CELLS = f"(SELECT CAST(k // 38 AS INTEGER) AS row, CAST(k % 38 AS INTEGER) AS col, coalesce(c_acctbal, 0) / 400 AS z FROM (SELECT unnest(range(({LAST_ROW} + 1) * 38)) AS k) LEFT JOIN customer ON c_custkey = k)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires: customers spread over a few degrees."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("fire"), (F.lit(36.0) + k * 37 % 1000 / F.lit(500.0)).alias("lat"), (F.lit(-121.0) + k * 61 % 1000 / F.lit(500.0)).alias("lon"), F.abs("c_acctbal").alias("acres"), F.col("c_mktsegment").alias("county"))


PLACES = "(SELECT c_custkey AS fire, 36 + c_custkey * 37 % 1000 / CAST(500 AS DOUBLE) AS lat, -121 + c_custkey * 61 % 1000 / CAST(500 AS DOUBLE) AS lon, abs(c_acctbal) AS acres, c_mktsegment AS county FROM customer)"


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera sites: suppliers spread over a few degrees."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("site"), (F.lit(36.0) + k * 71 % 100 / F.lit(50.0)).alias("lat"), (F.lit(-121.0) + k * 29 % 100 / F.lit(50.0)).alias("lon"), F.col("s_acctbal").alias("elev"))


CAMERAS = "(SELECT s_suppkey AS site, 36 + s_suppkey * 71 % 100 / CAST(50 AS DOUBLE) AS lat, -121 + s_suppkey * 29 % 100 / CAST(50 AS DOUBLE) AS lon, s_acctbal AS elev FROM supplier)"


def masts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites on the terrain, a supplier each."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("site"), (F.lit(38.0) - (k * 5 % 31 + 6.25) / F.lit(1200.0)).alias("lat"), (F.lit(-120.0) + (k * 6 % 31 + 3.75) / F.lit(1200.0)).alias("lon"))


MASTS = "(SELECT s_suppkey AS site, 38 - (s_suppkey * 5 % 31 + 6.25::DOUBLE) / 1200 AS lat, -120 + (s_suppkey * 6 % 31 + 3.75::DOUBLE) / 1200 AS lon FROM supplier)"
