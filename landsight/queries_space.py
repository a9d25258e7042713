"""Queries on places: joins, sets, terrain, coverage, siting, registration, satellite points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .fixtures import BLOCKS, CAMERAS, CELLS, LAST_ROW, MASTS, PLACES, SERIES, blocks, cameras, cells, grid, masts, places, query, series, table
from .functions.base import rounded
from .operators import joins, registration, siting, terrain
from .plans import network
from .sources import tables

KY = "110540.0::DOUBLE"
DROP = lambda x: f"({x}) * ({x}) / (2 * 6371000.0::DOUBLE) * 0.87::DOUBLE"
PLACE = lambda lat, lon: (f"(({lat}) - 38) * -1200 - 0.5::DOUBLE", f"(({lon}) + 120) * 1200 - 0.5::DOUBLE")


def clipped(x: str, most: int | str) -> str:
    return f"greatest(0, least({most}, CAST(round_even({x}, 0) AS INTEGER)))"


def bilinear(points: str, key: str) -> str:
    """SQL of (key, z): heights of points (key, lat, lon) between four cells."""
    y, x = PLACE("lat", "lon")
    return f"""(SELECT {key}, sum(w * z) AS z FROM (
  SELECT {key}, (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w,
    greatest(0, least({LAST_ROW}, CAST(floor(y) AS INTEGER) + i)) AS row, greatest(0, least(37, CAST(floor(x) AS INTEGER) + j)) AS col
  FROM (SELECT {key}, greatest(0, least({LAST_ROW}, {y})) AS y, greatest(0, least(37, {x})) AS x FROM {points}), (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j)) p
  JOIN {CELLS} c USING (row, col) GROUP BY {key})"""


OBSERVERS = f"(SELECT m.site, m.lat, m.lon, b.z + 10 AS h_obs FROM {MASTS} m JOIN {bilinear(MASTS, 'site')} b USING (site))"


def rays_sql(n_az: int, steps: int, step: float) -> str:
    y, x = PLACE("la", "lo")
    return f"""(SELECT site, az, dist, CAST(floor((la - 38) * -1200) AS INTEGER) AS row, CAST(floor((lo + 120) * 1200) AS INTEGER) AS col, ang,
  coalesce(ang >= max(ang) OVER (PARTITION BY site, az ORDER BY dist ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS visible FROM (
  SELECT s.*, (c.z - {DROP('dist')} - h_obs) / dist AS ang FROM (
    SELECT site, az, h_obs, k * {step}::DOUBLE AS dist, lat + k * {step}::DOUBLE * cos(radians(az * {360 / n_az}::DOUBLE)) / {KY} AS la,
      lon + k * {step}::DOUBLE * sin(radians(az * {360 / n_az}::DOUBLE)) / (111320 * cos(radians(lat))) AS lo
    FROM {OBSERVERS}, range({n_az}) AS a(az), range(1, {steps + 1}) AS b(k)) s
  JOIN {CELLS} c ON c.row = {clipped(y, LAST_ROW)} AND c.col = {clipped(x, 37)}))"""


RAYS = rays_sql(72, 40, 40.0)
VIEWS = f"(SELECT site, row, col, min(dist) AS dist FROM {RAYS} WHERE visible AND row BETWEEN 0 AND {LAST_ROW} AND col BETWEEN 0 AND 37 GROUP BY ALL)"
HOW = {"r_max": 1600.0, "n_az": 72, "step_m": 40.0}


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return terrain.viewshed(terrain.observers(masts(spark, sf_dir), c, grid(spark, sf_dir)), c, grid(spark, sf_dir), **HOW)


@query(f"SELECT site, az, round(dist, 3) AS dist, row, col, round(ang, 9) + 0.0 AS ang, visible FROM {RAYS}")
def g1_j10_j14_w9_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    r = terrain.rays(terrain.observers(masts(spark, sf_dir), c, grid(spark, sf_dir)), c, grid(spark, sf_dir), **HOW)
    return r.select("site", "az", F.round("dist", 3).alias("dist"), "row", "col", rounded("ang", 9).alias("ang"), "visible")


@query(f"SELECT site, row, col, round(dist, 3) AS dist FROM {VIEWS}")
def g2_u6_viewshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).select("site", "row", "col", F.round("dist", 3).alias("dist"))


@query(f"SELECT row, col, least(count(*), 255) AS n, least(count(*) FILTER (WHERE dist <= 800), 255) AS near FROM {VIEWS} GROUP BY row, col")
def g6_a16_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = terrain.coverage(views(spark, sf_dir), near_m=800.0)
    return v.select("row", "col", v["n"].cast("bigint").alias("n"), v["near"].cast("bigint").alias("near"))


@query(f"""WITH s AS (SELECT * FROM {OBSERVERS}), o AS (SELECT a.site * 10 + b.site - a.site AS pair, a.lat, a.lon, a.h_obs, b.lat AS lat2, b.lon AS lon2, b.h_obs + 5 AS z_top FROM s a JOIN s b ON b.site BETWEEN a.site AND a.site + 3),
m AS (SELECT *, {KY} AS ky, 111320 * cos(radians((lat + lat2) / 2)) AS kx FROM o), p AS (SELECT *, sqrt(pow((lat2 - lat) * ky, 2) + pow((lon2 - lon) * kx, 2)) AS d FROM m),
r AS (SELECT *, k * 30.0::DOUBLE / d AS t FROM p, range(1, 400) AS q(k) WHERE d >= 1 AND k <= ceil((d - 15) / 30.0::DOUBLE) - 1),
x AS (SELECT r.pair, c.z - {DROP('t * d')} < h_obs + (z_top - {DROP('d')} - h_obs) * t AS under FROM r JOIN {CELLS} c
  ON c.row = {clipped(PLACE('lat + t * (lat2 - lat)', 'lon')[0], LAST_ROW)} AND c.col = {clipped(PLACE('lat', 'lon + t * (lon2 - lon)')[1], 37)}),
f AS (SELECT pair, bool_and(under) AS free FROM x GROUP BY pair)
SELECT p.pair, CASE WHEN d < 1 THEN true ELSE coalesce(free, true) END AS visible FROM p LEFT JOIN f USING (pair)""")
def g3_sees_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    o = terrain.observers(masts(spark, sf_dir), c, grid(spark, sf_dir))
    b = o.select(F.col("site").alias("s2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), (F.col("h_obs") + 5).alias("z_top"))
    p = o.withColumn("s2", F.explode(F.sequence(F.col("site"), F.col("site") + 3))).join(b, "s2").withColumn("pair", F.col("site") * 10 + F.col("s2") - F.col("site"))  # each site with itself and the next three
    return terrain.sees(p, c, grid(spark, sf_dir), step_m=30.0)


@query(f"SELECT site, round(z, 6) + 0.0 AS ground FROM {bilinear(MASTS, 'site')}")
def p18_bilinear_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.sample_bilinear(masts(spark, sf_dir), cells(spark, sf_dir), grid(spark, sf_dir), "site", out="g").where("g is not null").select("site", rounded("g", 6).alias("ground"))


@query(f"""WITH g AS (SELECT row, col, (coalesce(lead(z) OVER x, z) - coalesce(lag(z) OVER x, z)) / (CASE WHEN lead(z) OVER x IS NULL OR lag(z) OVER x IS NULL THEN 1 ELSE 2 END * (111320 * cos(radians(38)) / 1200)) AS gx,
(coalesce(lead(z) OVER y, z) - coalesce(lag(z) OVER y, z)) / (CASE WHEN lead(z) OVER y IS NULL OR lag(z) OVER y IS NULL THEN 1 ELSE 2 END * ({KY} / 1200)) AS gy FROM {CELLS}
WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row))
SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) + 0.0 AS slope, round(fmod(degrees(atan2(-gx, gy)) + 360, 360), 6) + 0.0 AS aspect FROM g""")
def p19_g17_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.slopes(cells(spark, sf_dir), grid(spark, sf_dir), 38.0).select("row", "col", rounded("slope", 6).alias("slope"), rounded("aspect", 6).alias("aspect"))


def pano(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    s = terrain.observers(masts(spark, sf_dir), c, grid(spark, sf_dir)).select("site", "lat", "lon", F.col("h_obs").alias("height"))
    return terrain.panorama(s, c, grid(spark, sf_dir), az_lo=0.0, az_hi=90.0, az_step=5.0, max_d=1260.0, step_d=40.0)


PANO_POINTS = f"""(SELECT site * 100000 + a * 100 + k AS id, site, a, k, h_obs, 60 + k * 40.0::DOUBLE AS dist, lat + (60 + k * 40.0::DOUBLE) * cos(radians(a * 5.0::DOUBLE)) / {KY} AS lat,
  lon + (60 + k * 40.0::DOUBLE) * sin(radians(a * 5.0::DOUBLE)) / (111320 * cos(radians(lat))) AS lon FROM {OBSERVERS}, range(19) AS q(a), range(30) AS r(k))"""
PANO = f"(SELECT site, a AS az_idx, k AS d_idx, dist, degrees(atan2(b.z - {DROP('dist')} - h_obs, dist)) AS ang FROM {PANO_POINTS} p JOIN {bilinear(PANO_POINTS, 'id')} b USING (id))"


@query(f"""SELECT site, CAST(az_idx AS INTEGER) AS az_idx, CAST(d_idx AS INTEGER) AS d_idx, round(ang, 6) + 0.0 AS ang,
round(max(ang) OVER (PARTITION BY site, az_idx ORDER BY d_idx ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS cummax FROM {PANO}""")
def g11_w10_panorama(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pano(spark, sf_dir).select("site", "az_idx", "d_idx", rounded("ang", 6).alias("ang"), rounded("cummax", 6).alias("cummax"))


@query(f"""WITH p AS (SELECT *, max(ang) OVER (PARTITION BY site, az_idx ORDER BY d_idx ROWS UNBOUNDED PRECEDING) AS cummax FROM {PANO}),
x AS (SELECT DISTINCT site, a AS az_idx, CAST(e AS DOUBLE) - 10 AS el FROM {PANO_POINTS}, range(0, 14) AS t(e)),
h AS (SELECT x.site, x.az_idx, x.el, arg_min(p.dist, p.d_idx) AS dist FROM x JOIN p ON p.site = x.site AND p.az_idx = x.az_idx AND p.cummax >= x.el GROUP BY ALL)
SELECT x.site, CAST(x.az_idx AS DOUBLE) AS u, x.el AS v, round(h.dist, 3) AS dist FROM x LEFT JOIN h USING (site, az_idx, el)""")
def g16_j13_ground_of_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masts(spark, sf_dir).select("site", F.explode(F.sequence(F.lit(0), F.lit(18))).alias("k")).select("site", F.col("k").cast("double").alias("u"), (F.col("k") * 5.0).alias("az"), F.explode(F.sequence(F.lit(-10), F.lit(3))).alias("el"))
    rows = rows.withColumn("el", F.col("el").cast("double"))
    rows = rows.withColumn("v", F.col("el"))
    return terrain.ground_of_pixels(rows.select("site", "u", "v", "az", "el"), pano(spark, sf_dir), 0.0, 5.0).select("site", "u", "v", F.round("dist", 3).alias("dist"))


@query(f"SELECT arg_min(row, (-z, row, col)) AS row, arg_min(col, (-z, row, col)) AS col, round(max(z), 6) + 0.0 AS z FROM {CELLS} GROUP BY row // 7, col // 6")
def a21_hilltops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.hilltops(cells(spark, sf_dir), 7, 6).select("row", "col", rounded("z", 6).alias("z"))


@query(f"SELECT CAST(row // 5 AS INTEGER) AS row, CAST(col // 5 AS INTEGER) AS col, round(avg(z), 10) + 0.0 AS z FROM {CELLS} GROUP BY 1, 2")
def a22_coarse_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.coarsened(cells(spark, sf_dir), 5).select("row", "col", rounded("z", 10).alias("z"))


@query(f"""WITH t AS (SELECT row, col, k, CAST(floor(z / 4) AS INTEGER) + k AS z FROM {CELLS}, (VALUES (0), (1)) AS i(k) WHERE (row + col + k) % 3 <> 0),
m AS (SELECT row, col, arg_max(z, k) AS z FROM t WHERE z <> 0 GROUP BY row, col), n AS (SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, z, count(*) AS n FROM m GROUP BY ALL)
SELECT row, col, arg_min(z, (-n, z)) AS z FROM n GROUP BY row, col""")
def s18_s19_mosaic_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cells(spark, sf_dir).withColumn("item", F.explode(F.array(F.lit(0), F.lit(1)))).where((F.col("row") + F.col("col") + F.col("item")) % 3 != 0)
    t = t.withColumn("z", F.floor(F.col("z") / 4).cast("int") + F.col("item"))
    return terrain.coarsened(terrain.mosaic(t), 4, how="mode")


@query(f"SELECT fire, site, round(dist, 3) + 0.0 AS dist FROM (SELECT fire, site, sqrt(pow((c.lat - p.lat) * {KY}, 2) + pow((c.lon - p.lon) * (111320 * cos(radians(p.lat))), 2)) AS dist FROM {PLACES} p, {CAMERAS} c) WHERE dist <= 30000")
def j8_within_30km(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = joins.within(places(spark, sf_dir).select("fire", "lat", "lon"), cameras(spark, sf_dir).select("site", "lat", "lon"), 30_000.0, digits=3)
    return w.select(F.col("l_fire").alias("fire"), F.col("r_site").alias("site"), "dist")


@query("""WITH e AS (SELECT event_id AS id, user_id % 50 AS cam, CAST(floor(epoch(ts)) AS BIGINT) AS stamp, event_type FROM events), t AS (SELECT id, cam, stamp AS target FROM e WHERE event_type = 'purchase')
SELECT t.id, arg_min(s.stamp, (abs(s.stamp - t.target), s.stamp)) AS nearest FROM t JOIN e s ON s.cam = t.cam AND s.event_type <> 'purchase' AND abs(s.stamp - t.target) <= 7200 GROUP BY t.id""")
def j7_s10_nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("cam"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    t = e.where("event_type = 'purchase'").select("id", "cam", F.col("at").alias("target"))
    return joins.nearest_in_time(t, e.where("event_type <> 'purchase'"), ["cam"], tolerance=7200).select("id", "nearest")


SQUARES = [(k, 36.0 + k * 0.5, 36.45 + k * 0.5, -121.0 + k * 0.2, -120.0 + k * 0.1) for k in range(4)]
CORNERS = ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for k, a, b, c, e in SQUARES)


@query(f"SELECT fire, k AS polygon FROM {PLACES} p JOIN (VALUES {CORNERS}) AS s(k, a, b, c, e) ON p.lat >= a AND p.lat < b AND p.lon >= c AND p.lon < e")
def p12_s20_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = []
    for k, a, b, c, e in SQUARES:
        ring = [(c, a), (e, a), (e, b), (c, b)]
        sides += [(k, *ring[i], *ring[(i + 1) % 4]) for i in range(4)]
    edges = spark.createDataFrame(sides, "polygon int, x1 double, y1 double, x2 double, y2 double")
    return joins.inside_polygons(places(spark, sf_dir).select("fire", F.col("lon").alias("x"), F.col("lat").alias("y")), edges, "fire", "polygon")


@query(f"""WITH r AS (SELECT CAST(floor((lat - 36) / 0.05::DOUBLE) AS INTEGER) AS row, CAST(floor((lon + 121) / 0.05::DOUBLE) AS INTEGER) AS col, fire FROM {PLACES})
SELECT r.fire, round(c.z, 6) + 0.0 AS z FROM r JOIN {CELLS} c USING (row, col)""")
def j9_point_to_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = joins.cell_of(F.col("lat"), F.col("lon"), 36.0, 0.05, -121.0, 0.05)
    return places(spark, sf_dir).select("fire", r.alias("row"), c.alias("col")).join(cells(spark, sf_dir), ["row", "col"]).select("fire", rounded("z", 6).alias("z"))


DESCRIPTORS = "(SELECT label // 2 AS pair, label % 2 AS side, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


@query(f"""WITH x AS (SELECT a.pair, a.id AS a, b.id AS b, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda q: pow(q[1] - q[2], 2)))) AS dist FROM {DESCRIPTORS} a JOIN {DESCRIPTORS} b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
r AS (SELECT *, row_number() OVER w AS n, lead(dist) OVER w AS second FROM x WINDOW w AS (PARTITION BY pair, a ORDER BY dist, b))
SELECT CAST(pair AS INTEGER) AS pair, a, b, round(dist, 6) + 0.0 AS dist FROM r WHERE n = 1 AND dist < 0.95 * second""")
def t2_ratio_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("label") / 2).cast("int").alias("pair"), (F.col("label") % 2).alias("side"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    m = joins.affine_ratio_matches(e.where("side = 0"), e.where("side = 1"), 0.95)
    return m.select("pair", "a", "b", rounded("dist", 6).alias("dist"))


@query(f"""WITH f AS (SELECT view, cam % 7 AS seg, event_id AS id, value FROM {SERIES}),
p AS (SELECT a.view, a.seg AS a, b.seg AS b, a.id * 64 + b.id % 64 AS id, CAST(floor(a.value + b.value) AS INTEGER) AS inliers FROM f a JOIN f b ON a.view = b.view AND a.seg < b.seg AND a.id // 64 = b.id // 64)
SELECT view, a, b, max(inliers) AS inliers, arg_min(id, (-inliers, id)) AS best FROM p GROUP BY view, a, b""")
def j12_t4_best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a view linked by their best pair of frames; frames of the same 64 events are matched."""
    f = series(spark, sf_dir).select("view", F.struct("view", (F.col("cam") % 7).alias("seg")).alias("s"), F.col("event_id").alias("id"), "value", F.floor(F.col("event_id") / 64).alias("m"))
    a, b = (f.select("view", "m", *(F.col(x).alias(f"{x}{n}") for x in ("s", "id", "value"))) for n in (1, 2))
    id_ = F.col("id1") * 64 + F.col("id2") % 64
    p = a.join(b, ["view", "m"]).select(F.col("s1").alias("a"), F.col("s2").alias("b"), F.floor(F.col("value1") + F.col("value2")).cast("int").alias("inliers"), F.array(id_.cast("double")).alias("t"), id_.alias("id"))
    return registration.best_links(p).select("a.view", F.col("a.seg").alias("a"), F.col("b.seg").alias("b"), "inliers", F.get("t", F.lit(0)).cast("bigint").alias("best"))


CAMS = "(SELECT fire, acres, fire % 4 AS cams, fire % 3 AS cams_near, CASE WHEN acres >= 10 THEN fire % 5 END AS smoke100, CASE WHEN acres >= 10 THEN fire % 7 END AS smoke300, county FROM " + PLACES + ")"


def seen_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = lambda k: F.when(F.col("acres") >= 10, F.col("fire") % k)
    return places(spark, sf_dir).select("fire", "acres", (F.col("fire") % 4).alias("cams"), (F.col("fire") % 3).alias("cams_near"), big(5).alias("smoke100"), big(7).alias("smoke300"), "county")


@query(f"""SELECT l AS label, count(*) AS n, round(avg(CAST(cams >= 1 AS INTEGER)), 6) + 0.0 AS seen, round(avg(CAST(cams >= 2 AS INTEGER)), 6) + 0.0 AS seen2, round(avg(CAST(cams_near >= 1 AS INTEGER)), 6) + 0.0 AS near,
round(sum(acres), 3) + 0.0 AS acres, round(coalesce(sum(acres) FILTER (WHERE cams = 0), 0), 3) + 0.0 AS acres_unseen,
CASE WHEN count(*) = count(smoke300) THEN round(avg(CAST(smoke100 >= 1 AS INTEGER)), 6) + 0.0 END AS smoke100, CASE WHEN count(*) = count(smoke300) THEN round(coalesce(sum(acres) FILTER (WHERE smoke300 = 0), 0), 3) + 0.0 END AS acres_nosmoke
FROM {CAMS}, (VALUES ('all', 0), ('10+ acres', 10), ('100+ acres', 100), ('1,000+ acres', 1000), ('10,000+ acres', 10000)) AS s(l, least_acres) WHERE acres >= least_acres GROUP BY l""")
def a18_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = network.severity_rollup(seen_fires(spark, sf_dir))
    return r.select("label", "n", *(rounded(x, 6).alias(x) for x in ("seen", "seen2", "near")), *(rounded(x, 3).alias(x) for x in ("acres", "acres_unseen")), rounded("smoke100", 6).alias("smoke100"), rounded("acres_nosmoke", 3).alias("acres_nosmoke"))


@query(f"""SELECT county, count(*) AS n, round(avg(CAST(cams >= 1 AS INTEGER)), 6) + 0.0 AS seen, round(sum(acres), 3) + 0.0 AS acres, round(coalesce(sum(acres) FILTER (WHERE cams = 0), 0), 3) + 0.0 AS acres_unseen
FROM {CAMS} GROUP BY county HAVING count(*) >= 100 ORDER BY acres_unseen DESC, county LIMIT 3""")
def a19_l2_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = network.county_rollup(seen_fires(spark, sf_dir), 100, 3)
    return r.select("county", "n", rounded("seen", 6).alias("seen"), rounded("acres", 3).alias("acres"), rounded("acres_unseen", 3).alias("acres_unseen"))


@query(f"SELECT fire, round(f.acres, 3) AS acres FROM {CAMS} f WHERE cams = 0 ORDER BY f.acres DESC, fire LIMIT 12")
def l2_largest_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_fires(spark, sf_dir).where("cams = 0").orderBy(F.desc("acres"), "fire").limit(12).select("fire", F.round("acres", 3).alias("acres"))


@query(f"""WITH v AS (SELECT c.row, c.col, c.z, coalesce(n, 0) AS n, coalesce(near, 0) AS near, {KY} * 111320 * cos(radians(38 - (c.row + 0.5) / 1200)) / 1200 / 1200 / 1e6 AS a FROM {CELLS} c
  LEFT JOIN (SELECT row, col, count(*) AS n, count(*) FILTER (WHERE dist <= 800) AS near FROM {VIEWS} GROUP BY ALL) USING (row, col))
SELECT round(sum(a) FILTER (WHERE z > 0), 6) + 0.0 AS land_km2, round(sum(a) FILTER (WHERE z > 10), 6) + 0.0 AS wild_km2, round(coalesce(sum(a) FILTER (WHERE z > 10 AND n >= 1), 0) / sum(a) FILTER (WHERE z > 10), 6) + 0.0 AS wild_seen,
round(coalesce(sum(a) FILTER (WHERE z > 10 AND n >= 2), 0) / sum(a) FILTER (WHERE z > 10), 6) + 0.0 AS wild_seen2, round(coalesce(sum(a) FILTER (WHERE z > 10 AND near >= 1), 0) / sum(a) FILTER (WHERE z > 10), 6) + 0.0 AS wild_near FROM v""")
def a17_coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = terrain.coverage(views(spark, sf_dir), near_m=800.0)
    c = cells(spark, sf_dir).join(n, ["row", "col"], "left").fillna(0, ["n", "near"])
    s = network.coverage_stats(c, grid(spark, sf_dir), F.col("z") > 10, F.col("z") > 0)
    return s.select(*(rounded(x, 6).alias(x) for x in ("land_km2", "wild_km2", "wild_seen", "wild_seen2", "wild_near")))


@query(f"SELECT 1 AS pick, site, CAST(n AS DOUBLE) AS gain FROM (SELECT site, count(*) AS n FROM {VIEWS} GROUP BY site ORDER BY n DESC, site LIMIT 1)")
def g7_first_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir).withColumn("target", F.col("row") * 38 + F.col("col"))
    return siting.greedy_cover(v, 1)


def greedy_sql(views: str, picks: int, stop_at_zero: bool) -> str:
    """SQL of greedy picks of sites by the weight of targets that no earlier pick covers: two steps a pick. views: site, target, w."""
    steps = [f"c0 AS MATERIALIZED (SELECT DISTINCT site, target, w FROM ({views}))", "s AS (SELECT DISTINCT site FROM c0)"]
    for n in range(1, picks + 1):
        taken = " UNION ALL ".join(f"SELECT site FROM p{k}" for k in range(1, n)) or "SELECT NULL WHERE false"
        gains = f"SELECT s.site, coalesce(round(sum(w), 9), 0) AS gain FROM s LEFT JOIN c{n - 1} USING (site) WHERE s.site NOT IN ({taken}) GROUP BY s.site"
        steps.append(f"p{n} AS MATERIALIZED (SELECT {n} AS pick, site, CAST(gain AS DOUBLE) AS gain FROM ({gains}) {'WHERE gain > 0' if stop_at_zero else ''} ORDER BY gain DESC, site LIMIT 1)")
        steps.append(f"c{n} AS MATERIALIZED (SELECT * FROM c{n - 1} WHERE target NOT IN (SELECT target FROM c{n - 1} JOIN p{n} USING (site)))")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT * FROM p{n}" for n in range(1, picks + 1))


@query(greedy_sql(f"SELECT site, row * 38 + col AS target, 1.0::DOUBLE AS w FROM {VIEWS}", 5, True))
def g7_greedy_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five picks in a loop."""
    v = views(spark, sf_dir).withColumn("target", F.col("row") * 38 + F.col("col"))
    return siting.greedy_cover(v, 5)


WITHIN = f"SELECT site, fire AS target, round(acres, 2) AS w FROM (SELECT fire, acres, site, sqrt(pow((c.lat - p.lat) * {KY}, 2) + pow((c.lon - p.lon) * (111320 * cos(radians(p.lat))), 2)) AS dist FROM {PLACES} p, {CAMERAS} c) WHERE dist <= 30000"


@query(greedy_sql(WITHIN, 5, False))
def g8_g9_weighted_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires within reach of each site, by acres, without stopping at no gain."""
    w = joins.within(places(spark, sf_dir), cameras(spark, sf_dir), 30_000.0)
    w = w.select(F.col("r_site").alias("site"), F.col("l_fire").alias("target"), F.round("l_acres", 2).alias("w"))
    return siting.greedy_cover(w, 5, weight="w", stop_at_zero=False)


@query(f"""WITH RECURSIVE b AS (SELECT row, col, row * 38 + col AS id FROM {CELLS} WHERE z > 9), e AS (SELECT a.id AS u, c.id AS v FROM b a JOIN b c ON abs(a.row - c.row) + abs(a.col - c.col) = 1),
r(id, seen) AS (SELECT id, id FROM b UNION SELECT e.v, r.seen FROM r JOIN e ON e.u = r.id) SELECT b.row, b.col, CAST(min(r.seen) AS BIGINT) AS label FROM r JOIN b USING (id) GROUP BY b.row, b.col""")
def g10_l3_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return siting.blobs(cells(spark, sf_dir).where("z > 9"), 38)


@query(f"""WITH a AS (SELECT DISTINCT target, site FROM (SELECT site, row * 38 + col AS target FROM {VIEWS})), s AS (SELECT target FROM a WHERE site = 1), t AS (SELECT target FROM a WHERE site = 2)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM s UNION SELECT * FROM t) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM s INTERSECT SELECT * FROM t)
UNION ALL SELECT 'first only', count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM t) UNION ALL SELECT 'sites', count(DISTINCT site) FROM a""")
def u1_u2_u3_u4_u7_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views(spark, sf_dir).select("site", (F.col("row") * 38 + F.col("col")).alias("target"))
    s, t = (a.where(F.col("site") == k).select("target") for k in (1, 2))
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    out = count("union", s.union(t).distinct())
    for name, df in (("both", s.intersect(t)), ("first only", s.exceptAll(t)), ("sites", a.select("site").distinct())):
        out = out.unionByName(count(name, df))
    return out


@query(f"""WITH k AS (SELECT cam, event_id, row_number() OVER (PARTITION BY cam, ts::DATE ORDER BY ts DESC, event_id DESC) AS down, row_number() OVER (PARTITION BY cam, ts::DATE ORDER BY ts, event_id) AS up FROM {SERIES})
SELECT cam, event_id, down = 1 AS last, up = 1 AS first FROM k WHERE down = 1 OR up = 1""")
def u8_l1_first_last_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.timeseries import last_of_day

    s = series(spark, sf_dir)
    last = last_of_day(s, ["cam"], order="event_id").select("cam", "event_id", F.lit(True).alias("last"))
    opening = W.Window.partitionBy("cam", F.col("ts").cast("date")).orderBy("ts", "event_id")
    first = s.withColumn("n", F.row_number().over(opening)).where("n = 1").select("cam", "event_id", F.lit(True).alias("first"))
    return last.join(first, ["cam", "event_id"], "full").select("cam", "event_id", F.coalesce("last", F.lit(False)).alias("last"), F.coalesce("first", F.lit(False)).alias("first"))


@query(f"""WITH p AS (SELECT site AS point, CAST(site * 5 % 37 + 1 AS INTEGER) AS row, CAST(site * 7 % 36 + 1 AS INTEGER) AS col FROM {MASTS}),
x AS (SELECT p.point, CASE WHEN (c.row + c.col) % 5 = 0 THEN NULL ELSE floor(c.z * 100) * 0.0001::DOUBLE END AS b1, CASE WHEN c.row % 4 = 0 THEN 0 ELSE 1 END AS q FROM p JOIN {CELLS} c ON c.row BETWEEN p.row - 1 AND p.row + 1 AND c.col BETWEEN p.col - 1 AND p.col + 1)
SELECT point, DATE '2024-01-01' AS date, round(avg(b1), 8) + 0.0 AS b1, round(avg(CASE WHEN q = 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS qa_full FROM x GROUP BY point""")
def s11_point_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("site")
    p = masts(spark, sf_dir).select(k.alias("point"), (k * 5 % 37 + 1).cast("int").alias("row"), (k * 7 % 36 + 1).cast("int").alias("col"))
    c = cells(spark, sf_dir).withColumn("date", F.lit("2024-01-01").cast("date")).withColumn("b1", F.when((F.col("row") + F.col("col")) % 5 == 0, 32767).otherwise(F.floor(F.col("z") * 100)))
    c = c.withColumn("q", F.when(F.col("row") % 4 == 0, 0).otherwise(1))
    w = tables.point_windows(p, c.drop("z"), ["b1"])
    return w.select("point", "date", rounded("b1", 8).alias("b1"), rounded("qa_full", 6).alias("qa_full"))


@query(f"SELECT view, date, max(event_id) AS item FROM (SELECT view, ts::DATE AS date, event_id FROM {SERIES}) WHERE dayofyear(date) % 8 = 1 GROUP BY ALL")
def s12_satellite_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).select("view", F.col("ts").cast("date").alias("date"), F.col("event_id").alias("item"))
    return tables.satellite_items(s, ["view"]).select("view", "date", "item")


@query(f"SELECT 'h' || CAST(floor(lon) AS INTEGER) AS tile, count(*) AS n, array_to_string(list(fire ORDER BY fire), ',') AS points FROM {PLACES} WHERE lat < 37.5 GROUP BY 1")
def s13_points_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).withColumnRenamed("fire", "point")
    t = tables.by_tile(p, F.when(F.col("lat") < 37.5, F.concat(F.lit("h"), F.floor("lon").cast("string"))))
    return t.select("tile", "n", F.array_join(F.transform("points", lambda x: x.cast("string")), ",").alias("points"))


@query(f"SELECT view, frame, count(*) FILTER (WHERE valid) AS n, round(avg(g) FILTER (WHERE valid AND (br, bc) IN (SELECT (br, bc) FROM {BLOCKS} WHERE frame = 0 AND r > 100)), 6) + 0.0 AS g FROM {BLOCKS} GROUP BY ALL")
def j5_a2_region_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    veg = b.where((F.col("frame") == 0) & (F.col("r") > 100)).select("br", "bc")
    mean = b.where("valid").join(veg, ["br", "bc"], "left_semi").groupBy("frame").agg(rounded(F.avg("g"), 6).alias("g"))
    return b.groupBy("view", "frame").agg(F.count_if("valid").alias("n")).join(mean, "frame", "left").select("view", "frame", "n", "g")
