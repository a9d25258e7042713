"""Queries on series: windows, daily series, change, incremental updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import BLOCKS, SAMPLES, SERIES, VIEW_DAYS, blocks, query, samples, series, view_days
from .functions.base import rounded
from .operators import modelling, timeseries
from .plans import network
from .streaming import daily as live


def frame(days: int) -> str:
    return f"RANGE BETWEEN INTERVAL {days} DAY - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW"


CLEAR = f"""(SELECT *, coalesce(count(value) OVER w >= 5 AND value >= 0.8 * quantile_cont(value, 0.8) OVER w, false) AS clear
  FROM {SERIES} WINDOW w AS (PARTITION BY cam ORDER BY ts {frame(90)}))"""


@query(f"SELECT cam, event_id, CAST(clear AS INTEGER) AS clear FROM {CLEAR}")
def w1_clear_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.clear_flags(series(spark, sf_dir), ["cam"], "value").select("cam", "event_id", F.col("clear").cast("int").alias("clear"))


@query(f"""WITH p AS (SELECT *, quantile_cont(value, 0.9) OVER (PARTITION BY cam ORDER BY ts {frame(7)}) AS top FROM {SERIES})
SELECT cam, event_id, round(avg(top) OVER (PARTITION BY cam ORDER BY ts {frame(15)}), 9) + 0.0 AS smooth FROM p""")
def w2_causal_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.causal_smooth(series(spark, sf_dir), ["cam"], "value").select("cam", "event_id", rounded("smooth", 9).alias("smooth"))


def daily_sql(keys: str, flagged: str, least: int) -> str:
    return f"""last AS (SELECT *, ts::DATE AS date, row_number() OVER (PARTITION BY {keys}, ts::DATE ORDER BY ts DESC, event_id DESC) AS n FROM {flagged}),
kept AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS days FROM last WHERE n = 1 AND clear AND value IS NOT NULL),
top AS (SELECT {keys}, date, quantile_cont(value, 0.9) OVER (PARTITION BY {keys} ORDER BY date::TIMESTAMP {frame(7)}) AS top FROM kept WHERE days >= {least}),
smooth AS (SELECT {keys}, date, avg(top) OVER (PARTITION BY {keys} ORDER BY date::TIMESTAMP {frame(15)}) AS value FROM top),
ends AS (SELECT {keys}, min(date) AS a, max(date) AS z FROM smooth GROUP BY {keys}),
every AS (SELECT {keys}, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS date FROM ends),
daily AS (SELECT {keys}, date, last_value(value IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS value
  FROM every LEFT JOIN smooth USING ({keys}, date))"""


@query(f"WITH {daily_sql('cam', CLEAR, 3)} SELECT cam, date, round(value, 6) + 0.0 AS value FROM daily")
def w3_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = timeseries.clear_flags(series(spark, sf_dir), ["cam"], "value")
    return timeseries.daily(flagged, ["cam"], "value", order="event_id", least_days=3).select("cam", "date", rounded("value", 6).alias("value"))


@query(f"""WITH one AS (SELECT * FROM {SERIES} QUALIFY row_number() OVER (PARTITION BY cam, view, ts ORDER BY event_id) = 1),
seen AS (SELECT *, coalesce(count(value) OVER w >= 5 AND value >= 0.8 * quantile_cont(value, 0.8) OVER w, false) AS clear
  FROM one WINDOW w AS (PARTITION BY cam, view ORDER BY ts {frame(90)})),
{daily_sql('cam, view', 'seen', 5)},
z AS (SELECT cam, date, (value - avg(value) OVER (PARTITION BY cam, view)) / nullif(stddev_samp(value) OVER (PARTITION BY cam, view), 0) AS z FROM daily)
SELECT cam, date, round(avg(z), 5) + 0.0 AS z FROM z WHERE z IS NOT NULL GROUP BY cam, date""")
def pipeline_daily_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    one = timeseries.W.Window.partitionBy("cam", "view", "ts").orderBy("event_id")
    s = s.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    out = network.daily_index(s, edge="value", value="value", order="event_id", least_days=5)
    return out.select("cam", "date", rounded("z", 5).alias("z"))


@query(f"""WITH d AS (SELECT cam, event_id, quantile_cont(value, 0.5) OVER (PARTITION BY cam ORDER BY ts {frame(61)}) AS m FROM {SERIES})
SELECT cam, event_id, round(m - quantile_cont(m, 0.5) OVER (PARTITION BY cam), 6) + 0.0 AS drift FROM d""")
def w4_cast_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.drift(series(spark, sf_dir), ["cam"], ["value"]).select("cam", "event_id", rounded("value_drift", 6).alias("drift"))


@query(f"SELECT cam, event_id, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) + 0.0 AS z FROM {SERIES} WINDOW w AS (PARTITION BY cam)")
def w5_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.zscore(series(spark, sf_dir), ["cam"], "value").select("cam", "event_id", rounded("z", 6).alias("z"))


@query(f"""WITH b AS (SELECT view, br, bc, g / (r + g + b) AS v, (date - min(date) OVER (PARTITION BY view, br, bc)) // 7 AS bin FROM {BLOCKS} WHERE valid),
m AS (SELECT view, br, bc, bin, quantile_cont(v, 0.5) AS m FROM b GROUP BY ALL),
e AS (SELECT view, br, bc, unnest(range(0, max(bin) + 1)) AS bin FROM m GROUP BY view, br, bc),
s AS (SELECT e.view, e.br, e.bc, quantile_cont(m, 0.5) OVER (PARTITION BY e.view, e.br, e.bc ORDER BY e.bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s
  FROM e LEFT JOIN m ON m.view = e.view AND m.br = e.br AND m.bc = e.bc AND m.bin = e.bin)
SELECT view, br, bc, round(quantile_cont(s, 0.95) - quantile_cont(s, 0.05), 8) + 0.0 AS amp FROM s GROUP BY ALL""")
def w6_a5_seasonal_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).where("valid").withColumn("v", F.col("g") / (F.col("r") + F.col("g") + F.col("b")))
    return timeseries.weekly_amplitude(b, ["view", "br", "bc"], "v").select("view", "br", "bc", rounded("amp", 8).alias("amp"))


@query(f"""WITH m AS (SELECT view, date, quantile_cont(value, 0.5) OVER (PARTITION BY view ORDER BY date::TIMESTAMP {frame(17)}) AS v FROM {VIEW_DAYS}),
e AS (SELECT view, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM m GROUP BY view)
SELECT view, date, round(last_value(v IGNORE NULLS) OVER (PARTITION BY view ORDER BY date ROWS BETWEEN 16 PRECEDING AND CURRENT ROW), 6) + 0.0 AS value
FROM e LEFT JOIN m USING (view, date)""")
def w7_satellite_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.satellite_daily(view_days(spark, sf_dir), ["view"], "value").select("view", "date", rounded("value", 6).alias("value"))


@query(f"""WITH RECURSIVE s AS (SELECT view, ts, avg(value) AS tx, avg(value * 0.5) AS ty FROM {SERIES} GROUP BY view, ts),
w AS (SELECT view, ts, CASE WHEN count(*) OVER b >= 7 THEN quantile_cont(tx, 0.5) OVER b END AS bx, CASE WHEN count(*) OVER b >= 7 THEN quantile_cont(ty, 0.5) OVER b END AS by_,
  CASE WHEN count(*) OVER a >= 7 THEN quantile_cont(tx, 0.5) OVER a END AS ax, CASE WHEN count(*) OVER a >= 7 THEN quantile_cont(ty, 0.5) OVER a END AS ay FROM s
  WINDOW b AS (PARTITION BY view ORDER BY ts ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), a AS (PARTITION BY view ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING)),
j AS (SELECT view, ts, sqrt(pow(ax - bx, 2) + pow(ay - by_, 2)) AS jump FROM w),
m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY view ORDER BY ts) AS n FROM j WHERE jump > 30),
r(view, n, ts, jump, kept) AS (SELECT view, n, ts, jump, 1 FROM m WHERE n = 1 UNION ALL
  SELECT m.view, m.n, CASE WHEN near AND m.jump <= r.jump THEN r.ts ELSE m.ts END, CASE WHEN near AND m.jump <= r.jump THEN r.jump ELSE m.jump END, CASE WHEN near THEN kept ELSE kept + 1 END
  FROM r JOIN m ON m.view = r.view AND m.n = r.n + 1, LATERAL (SELECT epoch_us(m.ts) - epoch_us(r.ts) < 4 * 86400000000 AS near))
SELECT view, arg_max(ts, n) AS ts, round(arg_max(jump, n), 6) + 0.0 AS jump FROM r GROUP BY view, kept""")
def w8_sustained_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential by nature: the gap is measured from the move that is kept."""
    s = series(spark, sf_dir).select("view", "ts", F.col("value").alias("tx"), (F.col("value") * 0.5).alias("ty"))
    s = s.groupBy("view", "ts").agg(F.avg("tx").alias("tx"), F.avg("ty").alias("ty"))
    return timeseries.sustained_moves(s, ["view"], gap_days=4).select("view", "ts", rounded("jump", 6).alias("jump"))


@query(f"""WITH d AS {VIEW_DAYS}, e AS (SELECT view, unnest(generate_series(min(date), max(date) + 5, INTERVAL 1 DAY))::DATE AS date FROM d GROUP BY view),
n AS (SELECT view, date, value, row_number() OVER (PARTITION BY view ORDER BY date) AS n FROM e LEFT JOIN d USING (view, date)),
k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pn, last_value(value IGNORE NULLS) OVER b AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER a AS nn, first_value(value IGNORE NULLS) OVER a AS nv FROM n
  WINDOW b AS (PARTITION BY view ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY view ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT view, date, round(CASE WHEN value IS NOT NULL THEN value WHEN n - pn <= 3 THEN CASE WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (n - pn) / (nn - pn) END END, 6) + 0.0 AS filled FROM k""")
def w11_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view_days(spark, sf_dir)
    ends = v.groupBy("view").agg(F.min("date").alias("a"), F.date_add(F.max("date"), 5).alias("z"))
    days = ends.select("view", F.explode(F.sequence("a", "z")).alias("date")).join(v, ["view", "date"], "left")
    return timeseries.interpolated(days, ["view"], "value", limit=3).select("view", "date", rounded("filled", 6).alias("filled"))


@query(f"""WITH d AS (SELECT species, date, avg(lfmc) AS v FROM {SAMPLES} GROUP BY ALL),
e AS (SELECT species, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM d GROUP BY species),
y AS (SELECT species, year(date) AS year, date, v, count(*) OVER p AS n, count(v) OVER p AS c FROM e LEFT JOIN d USING (species, date)
  WHERE strftime(date, '%m%d') BETWEEN '0201' AND '1031' WINDOW p AS (PARTITION BY species, year(date))),
r AS (SELECT *, row_number() OVER (PARTITION BY species, year ORDER BY date) AS k FROM y WHERE n >= 100 AND c >= 0.6 * n),
q AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS pn, last_value(v IGNORE NULLS) OVER b AS pv,
  first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER a AS nn, first_value(v IGNORE NULLS) OVER a AS nv FROM r
  WINDOW b AS (PARTITION BY species, year ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY species, year ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT species, year, date, CASE WHEN v IS NOT NULL THEN v WHEN k - pn <= 20 THEN CASE WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (k - pn) / (nn - pn) END END AS v FROM q),
t AS (SELECT species, year, max(v) AS peak, arg_min(date, (-v, date)) AS day FROM f WHERE strftime(date, '%m%d') <= '0715' AND v IS NOT NULL GROUP BY ALL),
g AS (SELECT f.*, t.peak, min(f.v) OVER (PARTITION BY f.species, f.year) AS low FROM f JOIN t ON f.species = t.species AND f.year = t.year AND f.date >= t.day)
SELECT species, CAST(year AS INTEGER) AS year, CAST(min(dayofyear(date)) AS INTEGER) AS doy FROM g WHERE peak > low AND v < (peak + low) / 2 GROUP BY species, year""")
def w11_halfway_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir).groupBy("species", "date").agg(F.avg("lfmc").alias("v"))
    return timeseries.halfway_day(timeseries.densified(d, ["species"], "v"), ["species"], "v")


@query(f"""WITH d AS (SELECT site, date, round(avg(lfmc), 3) AS v FROM {SAMPLES} GROUP BY ALL),
y AS (SELECT *, year(date) AS year, count(*) FILTER (WHERE month(date) BETWEEN 4 AND 9) OVER (PARTITION BY site, year(date)) AS n FROM d),
t AS (SELECT site, year, max(v) AS peak, arg_min(date, (-v, date)) AS day FROM y WHERE n >= 4 AND month(date) BETWEEN 3 AND 7 GROUP BY ALL),
a AS (SELECT y.*, lag(v) OVER o AS pv, lag(date) OVER o AS pd FROM y JOIN t ON y.site = t.site AND y.year = t.year AND y.date >= t.day AND t.peak >= 150
  WINDOW o AS (PARTITION BY y.site, y.year ORDER BY date)),
f AS (SELECT site, year, min(date) AS date, arg_min(pd, date) AS pd, arg_min(v, date) AS v, arg_min(pv, date) AS pv FROM a WHERE v < 150 AND pv IS NOT NULL GROUP BY ALL)
SELECT site, CAST(year AS INTEGER) AS year, CAST(dayofyear(pd + CAST(floor((date - pd) * ((pv - 150) / (pv - v)) + 1e-9) AS INTEGER)) AS INTEGER) AS doy FROM f WHERE date - pd <= 45""")
def w12_drydown_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples(spark, sf_dir).groupBy("site", "date").agg(F.round(F.avg("lfmc"), 3).alias("lfmc"))
    return timeseries.drydown_day(d, ["site"], 150.0)


@query(f"""WITH d AS {VIEW_DAYS}, e AS (SELECT view, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM d GROUP BY view),
s AS (SELECT view, date, CASE WHEN count(value) OVER w >= 2 THEN quantile_cont(value, 0.5) OVER w END AS shown FROM e LEFT JOIN d USING (view, date)
  WINDOW w AS (PARTITION BY view ORDER BY date ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
l AS (SELECT *, quantile_cont(shown, 0.02) OVER (PARTITION BY view) AS low, quantile_cont(shown, 0.98) OVER (PARTITION BY view) AS high FROM s)
SELECT view, date, round(shown, 6) + 0.0 AS shown, CASE WHEN shown IS NULL THEN '.' ELSE
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_', 1 + CAST(round_even((least(greatest(shown, low), high) - low) / (high - low) * 63, 0) AS INTEGER), 1) END AS code FROM l""")
def w13_p23_display_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.encode import level

    s = timeseries.display_series(view_days(spark, sf_dir), ["view"], "value")
    return s.select("view", "date", rounded("shown", 6).alias("shown"), level(F.col("shown"), F.col("low"), F.col("high")).alias("code"))


@query(f"SELECT id, round(lfmc - avg(lfmc) OVER w, 6) + 0.0 AS lfmc, round(x - avg(x) OVER w, 6) + 0.0 AS x FROM {SAMPLES} WINDOW w AS (PARTITION BY site)")
def w14_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.departures(samples(spark, sf_dir), "site", ["lfmc", "x"]).select("id", rounded("lfmc", 6).alias("lfmc"), rounded("x", 6).alias("x"))


@query(f"""WITH a AS (SELECT site, year(date) AS year, sum(lfmc) AS s, count(*) AS n FROM {SAMPLES} GROUP BY ALL)
SELECT site, CAST(year AS INTEGER) AS year, round((sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0), 8) + 0.0 AS clim FROM a WINDOW w AS (PARTITION BY site)""")
def w16_other_years_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = samples(spark, sf_dir).groupBy("site", F.year("date").alias("year")).agg(F.sum("lfmc").alias("s"), F.count("*").alias("n"))
    w = timeseries.W.Window.partitionBy("site")
    return a.select("site", "year", rounded(F.try_divide(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n")), 8).alias("clim"))


@query(f"""WITH e AS (SELECT view, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM {VIEW_DAYS} GROUP BY view),
d AS (SELECT view, date, last_value(value IGNORE NULLS) OVER (PARTITION BY view ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS level FROM e LEFT JOIN {VIEW_DAYS} v USING (view, date))
SELECT view, date, round(level, 6) + 0.0 AS level, round(level - lag(level, 10) OVER (PARTITION BY view ORDER BY date), 6) + 0.0 AS change FROM d""")
def p31_level_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = timeseries.densified(view_days(spark, sf_dir), ["view"], "value", fill=21)
    return timeseries.change(d, ["view"], "value", days=10).select("view", "date", rounded("value", 6).alias("level"), rounded("change", 6).alias("change"))


@query(f"""WITH d AS (SELECT *, max(date) OVER (PARTITION BY view) - date < 15 AS inside, row_number() OVER (PARTITION BY view ORDER BY date DESC) AS down FROM {VIEW_DAYS}),
u AS (SELECT *, count(*) FILTER (WHERE inside) OVER (PARTITION BY view ORDER BY date ROWS UNBOUNDED PRECEDING) AS up FROM d)
SELECT view, round(quantile_cont(value, 0.5) FILTER (WHERE down <= 7) - quantile_cont(value, 0.5) FILTER (WHERE inside AND up <= 4), 6) + 0.0 AS change FROM u GROUP BY view""")
def a27_recent_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.recent_change(view_days(spark, sf_dir), ["view"], "value", first=4, days=15).select("view", rounded("change", 6).alias("change"))


@query(f"""WITH d AS (SELECT DISTINCT cam, ts::DATE AS date FROM {SERIES}), b AS (SELECT *, CASE WHEN date - lag(date) OVER w >= 4 THEN 1 ELSE 0 END AS b FROM d WINDOW w AS (PARTITION BY cam ORDER BY date)),
p AS (SELECT cam, date, sum(b) OVER (PARTITION BY cam ORDER BY date ROWS UNBOUNDED PRECEDING) AS piece FROM b)
SELECT cam, CAST(piece AS BIGINT) AS piece, min(date) AS a, max(date) AS z FROM p GROUP BY cam, piece""")
def js_line_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series(spark, sf_dir).select("cam", F.col("ts").cast("date").alias("date")).distinct()
    return timeseries.islands(d, ["cam"]).groupBy("cam", F.col("piece").cast("bigint").alias("piece")).agg(F.min("date").alias("a"), F.max("date").alias("z"))


@query(f"SELECT cam, ts::DATE AS date, count(value) AS n, round(quantile_cont(value, 0.5), 6) + 0.0 AS value FROM {SERIES} GROUP BY cam, ts::DATE")
def a26_live_daily_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = live.daily_medians(live.deduplicated(series(spark, sf_dir), ["cam", "ts"]), ["cam"], "value")
    return d.select("cam", "date", "n", rounded("value", 6).alias("value"))


@query(f"""WITH d AS (SELECT DISTINCT cam, ts::DATE AS date FROM {SERIES}), w AS (SELECT DISTINCT c.cam, t.date FROM (SELECT DISTINCT cam FROM d) c CROSS JOIN (SELECT DISTINCT date FROM d WHERE day(date) < 8) t)
SELECT * FROM w EXCEPT SELECT * FROM d""")
def s14_j6_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series(spark, sf_dir).select("cam", F.col("ts").cast("date").alias("date"))
    week = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-07").cast("date"))
    wanted = d.select("cam").distinct().select("cam", F.explode(week).alias("date"))
    return live.missing_days(wanted, d, ["cam"])


@query()
def m2_loyo_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression with its penalty chosen by leave-one-out error: tested against brute force."""
    from .functions.frames import season

    s = samples(spark, sf_dir).withColumn("year", F.year("date")).withColumns(dict(zip(modelling.SEASON, season("date")))).withColumn("site", F.col("species"))
    return modelling.loyo(s, ["x"], ["cam"]).select("cam", "id", rounded("pred", 4).alias("pred"), rounded("clim", 4).alias("clim"))
