"""Queries on columns: colour, geometry, encodings, times in names, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import BLOCKS, CAMERAS, PLACES, SAMPLES, SERIES, blocks, cameras, places, query, samples, series, table
from .functions import colour, encode, frames, geo
from .functions.base import d, rounded
from .operators import modelling, regions, registration
from .plans import network
from .sources import photos, tables


@query(f"SELECT frame, br, bc, round(g / nullif(r + g + b, 0), 8) + 0.0 AS gcc, round((g - r) / nullif(g + r, 0), 8) + 0.0 AS grvi FROM {BLOCKS}")
def p1_p2_colour_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return b.select("frame", "br", "bc", rounded(colour.gcc("r", "g", "b"), 8).alias("gcc"), rounded(colour.grvi("r", "g"), 8).alias("grvi"))


@query(f"""SELECT frame, br, bc, round((b - r) / (b + r), 8) + 0.0 AS ndvi, round((b - g) / (b + g), 8) + 0.0 AS ndii,
round((g / 1.5 - (0.3 * r + 0.59 * g + 0.11 * b) / 2 - r / 2) / (g / 1.5 - (0.3 * r + 0.59 * g + 0.11 * b) / 2 + r / 2), 6) + 0.0 AS camera_ndvi FROM {BLOCKS}""")
def p3_p4_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = colour.camera_ndvi("r", "g", "b", "g", F.lit(4.0), F.lit(2.25))
    return blocks(spark, sf_dir).select("frame", "br", "bc", rounded(colour.normalised_difference("b", "r"), 8).alias("ndvi"), rounded(colour.normalised_difference("b", "g"), 8).alias("ndii"), rounded(near, 6).alias("camera_ndvi"))


@query(f"""SELECT event_id, value > 40 AND value < 225 AND value * 2 > 40 AND value / 3 > 20 AND value / 1000 < 0.2 AS ok,
round(value * 2 / 500 + value / 100 + value / 2 / 80, 9) + 0.0 AS clarity FROM {SERIES}""")
def p5_frame_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return series(spark, sf_dir).select("event_id", frames.usable_frame(v, v * 2, v / 3, v / 1000).alias("ok"), rounded(frames.clarity(v * 2, v, v / 2), 9).alias("clarity"))


@query(f"""WITH t AS (SELECT id, CAST(dayofyear(date) AS DOUBLE) / CAST(365.25 AS DOUBLE) * (2 * pi()) AS t FROM {SAMPLES})
SELECT id, round(sin(t), 9) + 0.0 AS s1, round(cos(t), 9) + 0.0 AS c1, round(sin(2 * t), 9) + 0.0 AS s2, round(cos(2 * t), 9) + 0.0 AS c2 FROM t""")
def p6_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("id", *(rounded(x, 9).alias(n) for x, n in zip(frames.season("date"), ("s1", "c1", "s2", "c2"))))


HAVERSINE = "2 * 6371 * asin(sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2)))"


@query(f"SELECT fire, site, round({HAVERSINE}, 5) + 0.0 AS km FROM {PLACES} p JOIN {CAMERAS} c ON p.fire % 50 = c.site % 50")
def p7_great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = places(spark, sf_dir).alias("p"), cameras(spark, sf_dir).alias("c")
    km = geo.haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("c.lat"), F.col("c.lon"))
    return p.join(c, F.col("p.fire") % 50 == F.col("c.site") % 50).select("fire", "site", rounded(km, 5).alias("km"))


@query(f"""SELECT fire, round(lat + acres * cos(radians(fire % 360)) / 110540, 9) + 0.0 AS lat2, round(lon + acres * sin(radians(fire % 360)) / (111320 * cos(radians(lat))), 9) + 0.0 AS lon2,
round(acres * acres / (2 * 6371000.0::DOUBLE) * 0.87::DOUBLE, 6) + 0.0 AS fall, round(110540.0::DOUBLE * 111320 * cos(radians(lat)) * 0.0001 / 1e6, 6) + 0.0 AS km2 FROM {PLACES}""")
def p8_p9_p10_p27_geodesy(spark: SparkSession, sf_dir: str) -> DataFrame:
    la, lo = geo.destination(F.col("lat"), F.col("lon"), (F.col("fire") % 360).cast("double"), F.col("acres"))
    return places(spark, sf_dir).select("fire", rounded(la, 9).alias("lat2"), rounded(lo, 9).alias("lon2"), rounded(geo.drop_m(F.col("acres")), 6).alias("fall"), rounded(geo.cell_km2(F.col("lat"), 0.01), 6).alias("km2"))


@query(f"""WITH k AS (SELECT (sin(radians(33)) + sin(radians(45))) / 2 AS n), q AS (SELECT n, pow(cos(radians(33)), 2) + 2 * n * sin(radians(33)) AS c FROM k)
SELECT fire, round(sqrt(c - 2 * n * sin(radians(lat))) / n * sin(n * radians(lon + 112)), 9) + 0.0 AS x,
round(sqrt(c - 2 * n * sin(radians(40))) / n - sqrt(c - 2 * n * sin(radians(lat))) / n * cos(n * radians(lon + 112)), 9) + 0.0 AS y FROM {PLACES}, q""")
def p11_albers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    return places(spark, sf_dir).select("fire", rounded(x, 9).alias("x"), rounded(y, 9).alias("y"))


PIXELS = "(SELECT c_custkey AS id, CAST(c_custkey % 1536 AS DOUBLE) AS u, CAST(c_custkey * 7 % 1024 AS DOUBLE) AS v FROM customer)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k % 1536).cast("double").alias("u"), (k * 7 % 1024).cast("double").alias("v"))


LENS = geo.Camera(1536, 1024, 91.3, -2.0, 1.1, 101.0, 0.08)


@query(f"""WITH p AS (SELECT id, u - 768 AS x, 512 - v AS y, 768 / radians(50.5) AS f FROM {PIXELS}),
r AS (SELECT id, sqrt(x * x + y * y) / f AS r, atan2(y, x) + radians(1.1) AS phi FROM p), t AS (SELECT id, r * (1 + 0.08 * r * r) AS t, phi FROM r),
w AS (SELECT id, sin(t) * cos(phi) AS e, cos(t) * cos(radians(-2)) - sin(t) * sin(phi) * sin(radians(-2)) AS n, cos(t) * sin(radians(-2)) + sin(t) * sin(phi) * cos(radians(-2)) AS z FROM t)
SELECT id, round(fmod(degrees(atan2(e, n)) + 91.3 + 360, 360), 6) + 0.0 AS az, round(degrees(asin(z)), 6) + 0.0 AS el FROM w""")
def p13_pixel_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    az, el = LENS.direction(F.col("u"), F.col("v"))
    return pixels(spark, sf_dir).select("id", rounded(az, 6).alias("az"), rounded(el, 6).alias("el"))


@query(f"SELECT id, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM {PIXELS}")
def p14_direction_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to directions and back."""
    az, el = LENS.direction(F.col("u"), F.col("v"))
    p = pixels(spark, sf_dir).select("id", az.alias("az"), el.alias("el"))
    u, v = LENS.pixel(F.col("az"), F.col("el"))
    return p.select("id", rounded(u, 6).alias("u"), rounded(v, 6).alias("v"))


@query(f"""WITH a AS (SELECT fire, fmod(acres, 360) AS az FROM {PLACES}) SELECT fire, round(fmod(az - 200 + 180 + 360, 360) - 180 + 200, 6) + 0.0 AS near200,
['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][1 + CAST(round_even(az / 45, 0) AS INTEGER) % 8] AS wind,
round(CASE WHEN az < 90 THEN 10 + az * 20 / 90 WHEN az < 180 THEN 30 + (az - 90) * 40 / 90 ELSE 70 + (az - 180) * 30 / 180 END, 6) + 0.0 AS bearing FROM a""")
def p16_p33_p34_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    az = F.col("az")
    a = places(spark, sf_dir).select("fire", (F.col("acres") % 360).alias("az"))
    return a.select("fire", rounded(geo.unwrap(az, d(200)), 6).alias("near200"), geo.circular_wind(az).alias("wind"), rounded(geo.lerp_ticks(az, [0, 90, 180, 360], [10, 30, 70, 100]), 6).alias("bearing"))


@query(f"""WITH n AS (SELECT fire, ['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'][1 + fire % 16] AS w, fire % 16 * 22.5::DOUBLE AS az, lat, lon FROM {PLACES})
SELECT fire, w, az, round(lat + 1000 * cos(radians(az)) / 110540, 9) + 0.0 AS lat2, round(lon + 1000 * sin(radians(az)) / (111320 * cos(radians(lat))), 9) + 0.0 AS lon2 FROM n""")
def p32_wind_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, geo.WINDS_16)), (F.col("fire") % 16 + 1).cast("int"))
    p = places(spark, sf_dir).withColumn("w", name).withColumn("az", geo.wind_azimuth(F.col("w")))
    la, lo = geo.destination(F.col("lat"), F.col("lon"), F.col("az"), d(1000))
    return p.select("fire", "w", "az", rounded(la, 9).alias("lat2"), rounded(lo, 9).alias("lon2"))


@query(f"""WITH t AS (SELECT fire, cos(lat) AS a, -sin(lat) AS b, lon AS x, sin(lat) AS c, acres AS y FROM {PLACES})
SELECT fire, round(a * a + b * c, 6) + 0.0 AS xx, round(a * x + b * y + x, 4) + 0.0 AS x0, round(c * x + a * y + y, 4) + 0.0 AS y0, 0.0::DOUBLE AS zero FROM t""")
def p20_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn and shift twice, and with its inverse."""
    a, s = F.cos("lat"), F.sin("lat")
    t = (a, -s, F.col("lon"), s, a, F.col("acres"))
    twice, none = geo.compose(t, t), geo.compose(t, geo.invert(t))
    return places(spark, sf_dir).select("fire", rounded(twice[0], 6).alias("xx"), rounded(twice[2], 4).alias("x0"), rounded(twice[5], 4).alias("y0"), rounded(none[2], 6).alias("zero"))


@query(f"""SELECT CAST(round_even(lat / 0.002::DOUBLE, 0) AS BIGINT) AS ky, CAST(round_even(lon / 0.002::DOUBLE, 0) AS BIGINT) AS kx, round(avg(lat), 8) + 0.0 AS lat, round(quantile_cont(elev, 0.5), 4) + 0.0 AS elev, count(*) AS n,
array_to_string(list(site ORDER BY site), ',') AS ids, arg_min('c' || (site % 3), site) AS county FROM {CAMERAS} GROUP BY 1, 2""")
def a20_p21_camera_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cameras(spark, sf_dir).select(F.col("site").alias("id"), F.lit("x").alias("name"), "lat", "lon", "elev", F.lit(0.0).alias("az"), F.lit(60.0).alias("fov"), F.concat(F.lit("c"), F.col("site") % 3).alias("county"), F.lit("s").alias("sponsor"))
    s = tables.camera_sites(c)
    return s.select("ky", "kx", rounded("lat", 8).alias("lat"), rounded("elev", 4).alias("elev"), "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "county")


@query("""SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CASE WHEN round_even(least(127, greatest(-128, x::DOUBLE * 500)), 0) = -128 THEN NULL
ELSE CAST(round_even(least(127, greatest(-128, x::DOUBLE * 500)), 0) AS INTEGER) END AS VARCHAR)), ',') AS steps FROM embeddings""")
def p22_quantised_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded to text and decoded again, as whole steps."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", encode.quantised(F.transform("embedding", lambda x: x.cast("double"))).alias("code"))
    return e.select("vec_id", F.array_join(F.transform(encode.dequantised(F.col("code")), lambda v: F.rint(v * 500).cast("int").cast("string")), ",").alias("steps"))


@query(f"""SELECT fire, CASE WHEN a < 0 OR a >= 26 THEN NULL WHEN a < 10 THEN 0 WHEN a < 15 THEN 1 WHEN a < 20 THEN 2 ELSE 3 END AS bin,
CASE WHEN abs((b - a) / a * 100) < 0.5 THEN 'the same error as' ELSE CAST(round_even(abs((b - a) / a * 100), 0) AS BIGINT) || CASE WHEN b < a THEN '% less error than' ELSE '% more error than' END END AS phrase
FROM (SELECT fire, fmod(acres, 30) + 0.01 AS a, fmod(acres, 29) + 0.01 AS b FROM {PLACES})""")
def p24_p28_bins_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).select("fire", (F.col("acres") % 30 + 0.01).alias("a"), (F.col("acres") % 29 + 0.01).alias("b"))
    return p.select("fire", encode.binned(F.col("a"), [0, 10, 15, 20, 26]).alias("bin"), encode.change_phrase(F.col("a"), F.col("b")).alias("phrase"))


@query("""SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 'CZU ' || upper(n_name[1]) || lower(n_name[2:]) WHEN 1 THEN 'McKinney ' || upper(n_name[1]) || lower(n_name[2:])
WHEN 2 THEN 'Mc ' || upper(n_name[1]) || lower(n_name[2:]) ELSE upper(n_name[1]) || lower(n_name[2:]) END AS name FROM nation""")
def p25_fire_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.element_at(F.array(*map(F.lit, ("czu  ", "MCKINNEY ", "mc ", ""))), F.col("n_nationkey") % 4 + 1)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), encode.fire_name(F.concat(start, "n_name")).alias("name"))


REGION_ROWS = ", ".join(f"({k}, '{n}', {la}, {lo})" for k, (n, la, lo) in enumerate(geo.REGIONS))


@query(f"""SELECT fire, arg_min(name, (pow(r.lat::DOUBLE - p.lat, 2) + pow((r.lon::DOUBLE - p.lon) * 0.8::DOUBLE, 2), k)) AS region
FROM {PLACES} p, (VALUES {REGION_ROWS}) AS r(k, name, lat, lon) GROUP BY fire""")
def p26_region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select("fire", geo.region_name(F.col("lat"), F.col("lon")).alias("region"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('second', ts) END AS t FROM events""")
def s2_photo_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    names = [F.date_format(ts, "'cam_'yyyyMMdd'T'HHmmss'.jpg'"), F.date_format(ts, "'a/2011-01-01/x-'yyyy_MM_dd_HHmm'.png'"), F.date_format(ts, "yyyy-MM-dd'.jpg'"), F.concat(F.lit("img"), F.unix_timestamp(ts).cast("string"), F.lit(".jpg")), F.lit("no time 99999999.jpg")]
    path = F.element_at(F.array(*names), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", encode.photo_time(path).alias("t"))


@query("""SELECT event_id, date_trunc('minute', ts) AS t, 'site_IR_' || strftime(ts, '%Y_%m_%d_%H%M%S') || '.jpg' AS twin, CAST(event_id % 977 AS INTEGER) AS e, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events""")
def s8_s9_s17_names_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.date_format(F.col("ts").cast("timestamp"), "'site_'yyyy_MM_dd_HHmmss'.jpg'")
    meta = F.concat(F.lit("zone=1\nexposure="), (F.col("event_id") % 977).cast("string"), F.lit("\nx=2"))
    script = F.from_json(frames.javascript_json(F.concat(F.lit("var a = "), F.col("props"), F.lit(";"))), "k int")
    return table(spark, sf_dir, "events").select("event_id", frames.path_date(path).alias("t"), frames.infrared_twin(path).alias("twin"), frames.exposure(meta).alias("e"), script["k"].alias("k"))


@query(f"""WITH t AS (SELECT frame, br AS y, bc AS x, r, (br + bc + frame) % 13 > 0 OR br > 3 AS covered FROM {BLOCKS})
SELECT frame, CAST(y // 4 AS INTEGER) AS br, CAST(x // 4 AS INTEGER) AS bc, round(avg(r) FILTER (WHERE covered), 8) + 0.0 AS r, count(*) FILTER (WHERE covered) AS n,
count(*) FILTER (WHERE covered) > 0.95 * 16 AS valid FROM t GROUP BY 1, 2, 3""")
def a1_block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of four by four pixels of every frame."""
    px = blocks(spark, sf_dir).withColumn("covered", ((F.col("br") + F.col("bc") + F.col("frame")) % 13 > 0) | (F.col("br") > 3))
    px = px.select("frame", F.col("br").alias("y"), F.col("bc").alias("x"), "r", "covered")
    return regions.block_means(px, ["frame"], ["r"], 4, 0.95, 8, 8).select("frame", "br", "bc", rounded("r", 8).alias("r"), "n", "valid")


@query(f"SELECT view, br, bc, round(avg(CAST(valid AS INTEGER)), 8) + 0.0 AS cover, round(quantile_cont(g, 0.9), 8) + 0.0 AS q90, round(median(r) FILTER (WHERE valid), 8) + 0.0 AS mid FROM {BLOCKS} GROUP BY ALL")
def a2_a4_a6_block_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).groupBy("view", "br", "bc")
    return b.agg(rounded(F.avg(F.col("valid").cast("int")), 8).alias("cover"), rounded(F.percentile("g", F.lit(0.9)), 8).alias("q90"), rounded(F.percentile(F.when(F.col("valid"), F.col("r")), F.lit(0.5)), 8).alias("mid"))


STATS = f"(SELECT view, br, bc, round(quantile_cont(g, 0.95) - quantile_cont(g, 0.05), 8) AS amp, round(avg(CAST(valid AS DOUBLE)), 8) AS cover, bc / 10.0::DOUBLE AS bad_frac, 1 - br / 20.0::DOUBLE AS veg_frac FROM {BLOCKS} GROUP BY ALL)"


@query(f"""WITH s AS (SELECT *, cover > 0.85 AND veg_frac > 0.6 AND bad_frac < 0.2 AND br >= 8 * 0.45 AS strict, cover > 0.85 AND bad_frac < 0.4 AND br >= 8 * 0.3 AS loose FROM {STATS}),
c AS (SELECT *, CASE WHEN count(*) FILTER (WHERE strict) OVER (PARTITION BY view) < 10 THEN loose ELSE strict END AS cand FROM s),
v AS (SELECT *, cand AND amp >= quantile_cont(amp, 0.5) FILTER (WHERE cand) OVER (PARTITION BY view) AS veg, quantile_cont(amp, 0.3) FILTER (WHERE cover > 0.85) OVER (PARTITION BY view) AS low FROM c),
g AS (SELECT *, cover > 0.85 AND br >= 8 * 0.3 AND NOT coalesce(veg, false) AS ground FROM v), r AS (SELECT *, ground AND amp <= low AS ref FROM g)
SELECT view, br, bc, coalesce(veg, false) AS veg, CASE WHEN count(*) FILTER (WHERE ref) OVER (PARTITION BY view) < 5 THEN ground ELSE ref END AS ref FROM r""")
def a7_choose_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = blocks(spark, sf_dir).groupBy("view", "br", "bc").agg(
        F.round(F.percentile("g", F.lit(0.95)) - F.percentile("g", F.lit(0.05)), 8).alias("amp"), F.round(F.avg(F.col("valid").cast("double")), 8).alias("cover"))
    g = g.withColumn("bad_frac", F.col("bc") / d(10)).withColumn("veg_frac", 1 - F.col("br") / d(20))
    return regions.choose_regions(g, ["view"], 8).select("view", "br", "bc", "veg", "ref")


@query(f"""WITH b AS (SELECT view, frame, date, quantile_cont(ln(r / g), 0.5) AS lr, quantile_cont(ln(b / g), 0.5) AS lb FROM {BLOCKS} WHERE valid AND br < 2 GROUP BY ALL),
t AS (SELECT view, frame, quantile_cont(lr, 0.5) OVER w AS lr, quantile_cont(lb, 0.5) OVER w AS lb FROM b WINDOW w AS (PARTITION BY view ORDER BY date::TIMESTAMP RANGE BETWEEN INTERVAL 61 DAY - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW)),
d AS (SELECT view, frame, lr - quantile_cont(lr, 0.5) OVER (PARTITION BY view) AS lr, lb - quantile_cont(lb, 0.5) OVER (PARTITION BY view) AS lb FROM t)
SELECT x.view, x.frame, x.br, x.bc, round(x.r * exp(-d.lr), 6) + 0.0 AS r, round(x.b * exp(-d.lb), 6) + 0.0 AS b FROM {BLOCKS} x JOIN d USING (view, frame)""")
def a23_white_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).withColumnRenamed("date", "ts")
    ref = b.where("br < 2").select("view", "br", "bc").distinct()
    return regions.white_balanced(b, ref, ["view"]).select("view", "frame", "br", "bc", rounded("r", 6).alias("r"), rounded("b", 6).alias("b"))


@query(f"""WITH s AS (SELECT cam, site || ' | ' || species AS unit, date, avg(lfmc) AS lfmc FROM {SAMPLES} WHERE lfmc BETWEEN 20 AND 400 AND date <= DATE '2000-06-30' GROUP BY ALL),
f AS (SELECT cam, date, avg(x) AS x FROM {SAMPLES} GROUP BY ALL)
SELECT s.cam, s.unit, s.date, round(s.lfmc, 6) + 0.0 AS lfmc, round(f.x, 6) + 0.0 AS x, CAST(year(s.date) AS INTEGER) AS year FROM s LEFT JOIN f USING (cam, date) QUALIFY count(*) OVER (PARTITION BY cam, unit) >= 15""")
def a8_a9_j3_p30_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    values = s.select("cam", "date", F.lit("x").alias("metric"), F.col("x").alias("value"))
    rows = network.sample_rows(s.withColumn("lat", d(0)).withColumn("lon", d(0)), values, ["x"], until="2000-06-30")
    return rows.select("cam", "unit", "date", rounded("lfmc", 6).alias("lfmc"), rounded("x", 6).alias("x"), "year")


PRED = f"(SELECT cam, species, year(date) AS year, lfmc, lfmc * 0.6 + x AS pred, lfmc * 0.2 + 70 AS clim FROM {SAMPLES})"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("cam", "species", F.year("date").alias("year"), "lfmc", (F.col("lfmc") * 0.6 + F.col("x")).alias("pred"), (F.col("lfmc") * 0.2 + 70).alias("clim"))


@query(f"""WITH y AS (SELECT cam, year, avg(pow(pred - lfmc, 2)) AS m, avg(pow(clim - lfmc, 2)) AS c FROM {PRED} GROUP BY ALL), b AS (SELECT cam, count(*) FILTER (WHERE m < c - 1e-9) AS beat FROM y GROUP BY cam)
SELECT cam, count(*) AS n, count(DISTINCT year) AS years, round(sqrt(avg(pow(pred - lfmc, 2))), 6) + 0.0 AS rmse, round(avg(abs(pred - lfmc)), 6) + 0.0 AS mae,
round(1 - sum(pow(pred - lfmc, 2)) / (var_pop(lfmc) * count(*)), 6) + 0.0 AS r2, round(corr(lfmc - clim, pred - clim), 6) + 0.0 AS anomaly_r,
round(avg(CAST((pred < 80) = (lfmc < 80) AS DOUBLE)), 6) + 0.0 AS below80, any_value(beat) AS years_beat_season FROM {PRED} JOIN b USING (cam) GROUP BY cam""")
def a10_a28_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modelling.metrics(predictions(spark, sf_dir), ["cam"])
    return m.select("cam", "n", "years", *(rounded(x, 6).alias(x) for x in ("rmse", "mae", "r2", "anomaly_r", "below80")), "years_beat_season")


@query(f"""WITH p AS (UNPIVOT {PRED} ON pred, clim INTO NAME set VALUE v)
SELECT set, species, count(*) AS n, round(sqrt(avg(pow(v - lfmc, 2))), 6) + 0.0 AS rmse FROM p GROUP BY ALL""")
def a11_pooled_by_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).unpivot(["cam", "species", "year", "lfmc"], ["pred", "clim"], "set", "v")
    return p.groupBy("set", "species").agg(F.count("*").alias("n"), rounded(F.sqrt(F.avg(F.pow(F.col("v") - F.col("lfmc"), 2))), 6).alias("rmse"))


SKILL = f"(SELECT species, year, count(*) AS n, 1 - sqrt(avg(pow(pred - lfmc, 2))) / nullif(sqrt(avg(pow(clim - lfmc, 2))), 0) AS skill FROM {PRED} GROUP BY ALL HAVING count(*) >= 15)"


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("e", F.col("pred") - F.col("lfmc")).withColumn("b", F.col("clim") - F.col("lfmc"))
    return modelling.skill(p, ["species", "year"], "e", "b")


@query(f"SELECT species, CAST(year AS INTEGER) AS year, n, round(skill, 6) + 0.0 AS skill FROM {SKILL}")
def a12_unit_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills(spark, sf_dir).select("species", "year", "n", rounded("skill", 6).alias("skill"))


@query(f"""WITH r AS (SELECT rank() OVER (ORDER BY skill) + (count(*) OVER (PARTITION BY skill) - 1) / 2.0 AS a, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS b FROM {SKILL})
SELECT count(*) AS n, round(corr(a, b), 6) + 0.0 AS rho FROM r""")
def a13_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.spearman(skills(spark, sf_dir), "skill", "n").select("n", rounded("rho", 6).alias("rho"))


@query(f"""WITH s AS (SELECT count(*) FILTER (WHERE skill > 0.1) AS wins, count(*) AS n FROM {SKILL}), k AS (SELECT unnest(range(0, n + 1)) AS k, n, wins FROM s)
SELECT CAST(any_value(wins) AS INTEGER) AS wins, CAST(any_value(n) AS INTEGER) AS n, round(sum(CASE WHEN k >= wins THEN exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) END), 8) + 0.0 AS p FROM k""")
def a14_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.sign_test(skills(spark, sf_dir), F.col("skill") > 0.1).select("wins", "n", rounded("p", 8).alias("p"))


@query(f"SELECT cam, avg(lfmc) FILTER (WHERE year = 1995) IS NOT NULL AS has, round(avg(lfmc) FILTER (WHERE year = 1996), 6) + 0.0 AS y1996, round(avg(lfmc) FILTER (WHERE year = 1997), 6) + 0.0 AS y1997 FROM {PRED} GROUP BY cam")
def a15_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).groupBy("cam").pivot("year", [1995, 1996, 1997]).agg(F.avg("lfmc"))
    return p.select("cam", F.col("1995").isNotNull().alias("has"), rounded("1996", 6).alias("y1996"), rounded("1997", 6).alias("y1997"))


@query(f"""WITH r AS (SELECT cam, abs(pred - lfmc) AS a, row_number() OVER (PARTITION BY cam ORDER BY abs(pred - lfmc)) AS n, count(*) OVER (PARTITION BY cam) AS m FROM {PRED})
SELECT cam, round(avg(a), 6) + 0.0 AS loss FROM r WHERE n <= greatest(1, floor(m * 0.8)) GROUP BY cam""")
def a24_g13_trimmed_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("e", F.col("pred") - F.col("lfmc"))
    return modelling.smallest_share(p, ["cam"], "e").select("cam", rounded("loss", 6).alias("loss"))


@query(f"""WITH s AS (SELECT lfmc - avg(lfmc) OVER (PARTITION BY site) AS y, x - avg(x) OVER (PARTITION BY site) AS x FROM {SAMPLES})
SELECT count(*) AS n, round(regr_slope(y, x), 6) + 0.0 AS slope, round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 1)), 6) + 0.0 AS sd, round(corr(x, y), 6) + 0.0 AS r FROM s""")
def a25_slope_of_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.timeseries import departures

    s = modelling.slope(departures(samples(spark, sf_dir), "site", ["lfmc", "x"]), "x", "lfmc")
    return s.select("n", *(rounded(x, 6).alias(x) for x in ("slope", "sd", "r")))


@query(f"SELECT round(quantile_cont(skill, 0.5), 6) + 0.0 AS mid, count(*) FILTER (WHERE skill > 0) AS better FROM {SKILL}")
def a29_median_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills(spark, sf_dir).agg(rounded(F.percentile("skill", F.lit(0.5)), 6).alias("mid"), F.count_if(F.col("skill") > 0).alias("better"))


@query(f"""WITH r AS (SELECT cam, frame, row_number() OVER (PARTITION BY cam ORDER BY clarity DESC, frame) AS n, count(*) OVER (PARTITION BY cam) AS m FROM (SELECT cam, event_id AS frame, value AS clarity FROM {SERIES}))
SELECT cam, frame FROM r WHERE n <= 6 OR ((n - 7) % greatest(1, (m - 6) // 4) = 0 AND (n - 7) // greatest(1, (m - 6) // 4) < 4)""")
def l6_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).select("cam", F.col("event_id").alias("frame"), F.col("value").alias("clarity"))
    return registration.representatives(s, ["cam"]).select("cam", "frame")


@query(f"SELECT cam, arg_min(event_id, (-value, event_id)) AS anchor FROM {SERIES} GROUP BY cam")
def l10_clearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.clearest(series(spark, sf_dir), ["cam"], "event_id", "value", "event_id")


@query(f"SELECT cam, event_id FROM (SELECT cam, event_id, row_number() OVER (PARTITION BY cam ORDER BY event_id) AS n FROM {SERIES}) WHERE n % 3 = 1")
def l8_every_third(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.every_kth(series(spark, sf_dir), ["cam"], "event_id", 3).select("cam", "event_id")


@query(f"""WITH m AS (SELECT view, date, value, file, count(DISTINCT date) OVER (PARTITION BY view, file) AS n FROM (SELECT view, ts::DATE AS date, value, 'f' || (event_id % 3) AS file FROM {SERIES}) WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'),
t AS (SELECT view, arg_min(file, (-n, file)) AS file, max(n) AS n FROM m GROUP BY view)
SELECT s.view, s.file, count(*) AS n FROM (SELECT view, 'f' || (event_id % 3) AS file FROM {SERIES}) s JOIN t USING (view, file) WHERE t.n >= 5 GROUP BY ALL""")
def s23_fullest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).select("view", F.col("ts").cast("date").alias("date"), "value", F.concat(F.lit("f"), F.col("event_id") % 3).alias("file"))
    return tables.fullest_file(s, ["view"], "2024-01-05", "2024-01-25", 5).groupBy("view", "file").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT cam % 20 AS site, event_id, ts FROM {SERIES}), s AS (SELECT fire % 25 AS site, DATE '2024-01-01' + CAST(fire % 28 + 20 AS INTEGER) AS date FROM {PLACES}),
j AS (SELECT site, min(date) - 10 AS a, least(max(date), DATE '2024-01-22') AS z FROM s GROUP BY site)
SELECT p.site, p.event_id FROM p JOIN j USING (site) WHERE p.ts::DATE BETWEEN j.a AND j.z""")
def s16_photo_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = series(spark, sf_dir).select((F.col("cam") % 20).alias("site"), "event_id", "ts")
    s = places(spark, sf_dir).select((F.col("fire") % 25).alias("site"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("fire") % 28 + 20).cast("int")).alias("date"))
    return photos.jobs(p, s, days_before=10, until="2024-01-22").select("site", "event_id")
