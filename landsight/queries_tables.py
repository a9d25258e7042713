"""Queries on tables: joins by key, ranking within groups, eligibility, display scales, coerced samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .fixtures import MASTS, PLACES, SAMPLES, SERIES, masts, places, query, samples, series, table
from .functions import geo
from .functions.base import d, first_min, rounded
from .operators import joins
from .sources import tables


@query(f"""WITH a AS (SELECT site, date, avg(lfmc) AS v FROM {SAMPLES} WHERE species < '3' GROUP BY ALL), b AS (SELECT site, date, avg(x) AS x FROM {SAMPLES} WHERE species >= '3' GROUP BY ALL),
f AS (SELECT site, date, v, x FROM a FULL JOIN b USING (site, date))
SELECT site, date, round(v, 6) + 0.0 AS v, round(x, 6) + 0.0 AS x, v IS NOT NULL AND x IS NOT NULL AS inner_row FROM f""")
def j1_j2_j4_outer_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series as one wide table by date: a union and one aggregate instead of a chain of full joins."""
    s = samples(spark, sf_dir)
    low = F.col("species") < "3"
    wide = s.groupBy("site", "date").agg(F.avg(F.when(low, F.col("lfmc"))).alias("v"), F.avg(F.when(~low, F.col("x"))).alias("x"))
    both = F.col("v").isNotNull() & F.col("x").isNotNull()
    return wide.select("site", "date", rounded("v", 6).alias("v"), rounded("x", 6).alias("x"), both.alias("inner_row"))


@query("""SELECT o_orderkey AS id, c_mktsegment AS kind, n_name AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def j5_j6_j11_dictionary_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return both.join(gone, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("n_name").alias("place"))


@query(f"""WITH r AS (SELECT county, fire, acres, row_number() OVER (PARTITION BY county ORDER BY acres DESC, fire) AS n FROM {PLACES})
SELECT county, array_to_string(list(fire ORDER BY n) FILTER (WHERE n <= 3), ',') AS top3, max(CASE WHEN n = 1 AND acres > 0 THEN fire END) AS biggest, count(*) AS fires FROM r GROUP BY county""")
def l3_l4_l5_top_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest of each group by a bounded array, so that no group is sorted whole."""
    p = places(spark, sf_dir).withColumn("n", F.row_number().over(W.Window.partitionBy("county").orderBy(F.desc("acres"), "fire")))
    top = F.sort_array(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "fire"))))
    out = p.groupBy("county").agg(top.alias("t"), F.max(F.when((F.col("n") == 1) & (F.col("acres") > 0), F.col("fire"))).alias("biggest"), F.count("*").alias("fires"))
    return out.select("county", F.array_join(F.transform("t", lambda x: x["fire"].cast("string")), ",").alias("top3"), "biggest", "fires")


@query(f"""WITH u AS (SELECT site || ' | ' || species AS unit, count(*) AS n, count(DISTINCT year(date)) AS years FROM {SAMPLES} GROUP BY 1)
SELECT unit, n, years, CAST(row_number() OVER (ORDER BY n DESC, unit) AS INTEGER) AS place FROM u WHERE n >= 10 AND years >= 4 ORDER BY place LIMIT 20""")
def l9_l11_m6_eligible_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = samples(spark, sf_dir).groupBy(F.concat_ws(" | ", "site", "species").alias("unit")).agg(F.count("*").alias("n"), F.count_distinct(F.year("date")).alias("years"))
    top = u.where((F.col("n") >= 10) & (F.col("years") >= 4)).orderBy(F.desc("n"), "unit").limit(20)  # a report of twenty
    return top.withColumn("place", F.row_number().over(W.Window.orderBy(F.desc("n"), "unit")))


@query(f"""WITH y AS (SELECT *, year(date) AS year FROM {SAMPLES}), h AS (SELECT id, species, x, year FROM y WHERE year = 1997),
e AS (SELECT species, min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_pop(x) AS s FROM y WHERE year <> 1997 GROUP BY species)
SELECT id, round((least(greatest(x, lo), hi) - m) / s, 6) + 0.0 AS x FROM h JOIN e USING (species)""")
def m3_clipped_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out predictors clipped to the training range, then standardised by the training rows."""
    y = samples(spark, sf_dir).withColumn("year", F.year("date"))
    e = y.where("year <> 1997").groupBy("species").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    h = y.where("year = 1997").join(e, "species")
    return h.select("id", rounded((F.least(F.greatest("x", "lo"), "hi") - F.col("m")) / F.col("s"), 6).alias("x"))


@query(f"""WITH s AS (SELECT cam, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM {SERIES} GROUP BY cam)
SELECT event_id, round(coalesce((least(greatest(value, lo), hi) - lo) / nullif(hi - lo, 0), 0), 6) + 0.0 AS shade FROM {SERIES} JOIN s USING (cam)""")
def js_clip_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    e = s.groupBy("cam").agg(F.percentile("value", F.lit(0.01)).alias("lo"), F.percentile("value", F.lit(0.99)).alias("hi"))
    shade = F.try_divide(F.least(F.greatest("value", "lo"), "hi") - F.col("lo"), F.col("hi") - F.col("lo"))
    return s.join(e, "cam").select("event_id", rounded(F.coalesce(shade, d(0)), 6).alias("shade"))


@query(f"""WITH e AS (SELECT site, id, abs(lfmc - x) AS e FROM {SAMPLES} WHERE month(date) BETWEEN 4 AND 6), m AS (SELECT site, list(e ORDER BY e)[count(*) // 2 + 1] AS mid FROM e GROUP BY site)
SELECT site, arg_min(id, (round(abs(e - mid), 9), id)) AS typical FROM e JOIN m USING (site) GROUP BY site""")
def js_typical_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spring sample whose error is nearest the upper median."""
    e = samples(spark, sf_dir).where(F.month("date").between(4, 6)).select("site", "id", F.abs(F.col("lfmc") - F.col("x")).alias("e"))
    n = e.withColumn("n", F.row_number().over(W.Window.partitionBy("site").orderBy("e"))).withColumn("m", F.count("*").over(W.Window.partitionBy("site")))
    mid = n.where(F.col("n") == F.floor(F.col("m") / 2) + 1).select("site", F.col("e").alias("mid"))
    return e.join(mid, "site").groupBy("site").agg(first_min("id", F.round(F.abs(F.col("e") - F.col("mid")), 9), "id").alias("typical"))


@query("""SELECT o_orderkey AS id, TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS lfmc, o_orderdate::DATE AS date FROM orders
WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0""")
def s7_coerced_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("o_orderkey"), tables.SAMPLE_COLUMNS
    raw = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, "France").otherwise("USA").alias("Country"), F.lit("s").alias(name["site"]), F.lit("37.5").alias(name["lat"]), F.lit("-120").alias(name["lon"]),
        F.when(k % 5 == 0, "2020-02-30").when(k % 2 == 0, F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd")).otherwise(F.col("o_orderdate").cast("date").cast("string")).alias(name["date"]),
        F.when(k % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias(name["lfmc"]), F.lit("x").alias(name["species"]))
    return tables.samples(raw).select("id", "lfmc", "date")


@query(f"""SELECT c_custkey AS id, c_custkey % 150 IN (4, 9, 17, 29, 66, 68, 72) AS vegetation, c_custkey % 150 = 2 AS sky, round(2 * (50.5::DOUBLE * (1 + 0.08::DOUBLE * pow(radians(50.5), 2))), 6) + 0.0 AS hfov,
round(CAST(768 AS DOUBLE) / radians(50.5), 6) + 0.0 AS focal FROM customer""")
def p15_p29_lens_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lens of a camera, and a label table of pixel classes joined to labels."""
    cam = geo.Camera(1536, 1024, 0.0, hfov=101.0, k1=0.08)
    kinds = spark.createDataFrame([(k, k in (4, 9, 17, 29, 66, 68, 72), k == 2) for k in range(150)], "label long, vegetation boolean, sky boolean")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 150).alias("label"))
    return c.join(F.broadcast(kinds), "label").select("id", "vegetation", "sky", rounded(cam.effective_hfov, 6).alias("hfov"), rounded(cam.focal, 6).alias("focal"))  # 150 labels


@query(f"""WITH m AS (SELECT site, lat, lon FROM {MASTS}), p AS (SELECT fire, lat, lon, acres FROM {PLACES})
SELECT fire, CAST(floor((lat - 36) / 0.25::DOUBLE) AS INTEGER) AS tile_row, CAST(floor((lon + 121) / 0.25::DOUBLE) AS INTEGER) AS tile_col, (SELECT count(*) FROM m) AS masts FROM p""")
def s18_tile_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = joins.cell_of(F.col("lat"), F.col("lon"), 36.0, 0.25, -121.0, 0.25)
    p = places(spark, sf_dir).select("fire", r.alias("tile_row"), c.alias("tile_col"))
    return p.crossJoin(masts(spark, sf_dir).agg(F.count("*").alias("masts")))  # one row
