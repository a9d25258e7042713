"""From frames to comparable daily series; from sites and terrain to coverage; from series and samples to skill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import c, ratio
from ..functions.colour import gcc, grvi
from ..operators import modelling, regions, siting, terrain, timeseries


def daily_index(frames: DataFrame, cam: str = "cam", view: str = "view", ts: str = "ts", edge: str = "edge_corr", value: str = "index", order: str | None = None, least_days: int = 30) -> DataFrame:
    """(cam, date, z): haze screened, causally smoothed, standardised per view and averaged over a camera's views."""
    keys = [cam, view]
    flagged = timeseries.clear_flags(frames, keys, edge, ts)
    days = timeseries.daily(flagged, keys, value, ts, "clear", order, least_days)
    return timeseries.combined(timeseries.zscore(days, keys, value).where("z is not null"), [cam], "z")


def block_stats(blocks: DataFrame, keys: list[str], frame_ok: str = "clear", fractions: DataFrame | None = None) -> DataFrame:
    """(keys, br, bc, amp, cover, veg_frac, bad_frac): what regions are chosen by.

    fractions: keys, br, bc, veg_frac, bad_frac (``regions.block_fractions``); without them every block counts as vegetation.
    """
    at = [*keys, "br", "bc"]
    green = F.when(F.col("valid"), gcc("r", "g", "b"))
    cover = blocks.groupBy(*at).agg(F.avg(F.col("valid").cast("double")).alias("cover"))
    good = blocks.where(c(frame_ok)).withColumn("__g", green).withColumn("date", F.col("ts").cast("date"))
    amp = timeseries.weekly_amplitude(good.where("__g is not null"), at, "__g")
    stats = cover.join(amp, at, "left")
    if fractions is None:
        return stats.withColumn("veg_frac", F.lit(1.0)).withColumn("bad_frac", F.lit(0.0))
    return stats.join(fractions.select(*at, "veg_frac", "bad_frac"), at, "left").fillna(0.0, ["veg_frac", "bad_frac"])


def view_series(blocks: DataFrame, frames: DataFrame, keys: list[str], grid_rows: int, least_days: int = 30, fractions: DataFrame | None = None, **screen: object) -> DataFrame:
    """(keys, date, metric, value): daily grvi, grvi_wb and gcc_wb of each view's vegetation.

    blocks: keys, frame, ts, br, bc, r, g, b, valid; frames: keys, frame, ts, edge_corr.
    """
    flags = timeseries.clear_flags(frames, keys, "edge_corr", "ts", **screen).select(*keys, "frame", "clear")
    b = blocks.join(flags, [*keys, "frame"])
    chosen = regions.choose_regions(block_stats(b, keys, fractions=fractions), keys, grid_rows)
    veg = chosen.where("veg").select(*keys, "br", "bc")
    ref = chosen.where("ref").select(*keys, "br", "bc")
    white = regions.white_balanced(b, ref, keys)
    parts = []
    for name, df, index in (("grvi", b, grvi("r", "g")), ("grvi_wb", white, grvi("r", "g")), ("gcc_wb", white, gcc("r", "g", "b"))):
        mean = df.where("valid").join(veg, [*keys, "br", "bc"], "left_semi").groupBy(*keys, "frame", "ts", "clear").agg(F.avg(index).alias("value"))
        parts.append(timeseries.daily(mean, keys, "value", "ts", "clear", "frame", least_days).withColumn("metric", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def coverage_stats(cells: DataFrame, grid: terrain.Grid, wild: Column, land: Column) -> DataFrame:
    """Areas and shares of land and wildland that sites see. cells: row, col, n, near and what the conditions read."""
    from ..functions.geo import cell_km2

    lat, _ = grid.centre(F.col("row"), F.col("col"))
    a = cells.withColumn("__a", cell_km2(lat, abs(grid.dlat)))
    area = lambda cond: F.sum(F.when(cond, F.col("__a")).otherwise(0.0))
    s = a.agg(area(land).alias("land_km2"), area(wild).alias("wild_km2"), area(wild & (F.col("n") >= 1)).alias("wild_seen_km2"), area(wild & (F.col("n") >= 2)).alias("wild_seen2_km2"),
              area(wild & (F.col("near") >= 1)).alias("wild_near_km2"), area(land & (F.col("n") >= 1)).alias("land_seen_km2"))
    share = lambda x: ratio(F.col(x), F.col("wild_km2"))
    return s.select("*", share("wild_seen_km2").alias("wild_seen"), share("wild_seen2_km2").alias("wild_seen2"), share("wild_near_km2").alias("wild_near"))


SEVERITIES = [("all", 0.0), ("10+ acres", 10.0), ("100+ acres", 100.0), ("1,000+ acres", 1000.0), ("10,000+ acres", 10000.0)]


def severity_rollup(fires: DataFrame) -> DataFrame:
    """Overlapping classes by least acres: counts, shares seen, acres unseen, and smoke shares where all are computed.

    fires: acres, cams, cams_near, smoke100, smoke300 (NULL where not computed). Five thresholds: one pass, rows times five.
    """
    levels = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.lit(x).alias("least")) for n, x in SEVERITIES)))
    f = fires.withColumn("__l", levels).where(F.col("acres") >= F.col("__l.least"))
    share = lambda cond: F.avg(cond.cast("double"))
    known = F.count_if(F.col("smoke300").isNull()) == 0
    smoke = [(share(F.col("smoke100") >= 1), "smoke100"), (share(F.col("smoke300") >= 1), "smoke300_share"), (share(F.col("smoke300") >= 2), "smoke300_2"), (F.sum(F.when(F.col("smoke300") == 0, F.col("acres")).otherwise(0.0)), "acres_nosmoke")]
    return f.groupBy(F.col("__l.label").alias("label")).agg(
        F.count("*").alias("n"), share(F.col("cams") >= 1).alias("seen"), share(F.col("cams") >= 2).alias("seen2"), share(F.col("cams_near") >= 1).alias("near"),
        F.sum("acres").alias("acres"), F.sum(F.when(F.col("cams") == 0, F.col("acres")).otherwise(0.0)).alias("acres_unseen"),
        *(F.when(known, x).alias(n) for x, n in smoke))


def county_rollup(fires: DataFrame, least: int = 100, most: int = 15) -> DataFrame:
    """Counties with enough fires by acres unseen."""
    g = fires.where("county is not null").groupBy("county").agg(
        F.count("*").alias("n"), F.avg((F.col("cams") >= 1).cast("double")).alias("seen"), F.sum("acres").alias("acres"),
        F.sum(F.when(F.col("cams") == 0, F.col("acres")).otherwise(0.0)).alias("acres_unseen"))
    return g.where(F.col("n") >= least).orderBy(F.desc("acres_unseen"), "county").limit(most)


def blind_spots(coarse: DataFrame, cols: int, fires: DataFrame, most: int = 8) -> DataFrame:
    """The largest four-neighbour groups of blind coarse cells: size, centre, fires inside and the biggest of them.

    coarse: row, col; fires: row, col (coarse), name, acres.
    """
    lab = siting.blobs(coarse, cols)
    top = lab.groupBy("label").agg(F.count("*").alias("cells"), F.avg("row").alias("row"), F.avg("col").alias("col")).orderBy(F.desc("cells"), "label").limit(most)
    inside = fires.join(lab, ["row", "col"]).groupBy("label").agg(F.count("*").alias("ignitions"), F.sum("acres").alias("acres"), F.max(F.struct("acres", "name")).alias("m"))
    out = top.join(inside, "label", "left")
    big = F.when(F.col("m.acres") > 0, F.col("m.name"))
    return out.select("label", "cells", "row", "col", F.coalesce("ignitions", F.lit(0)).alias("ignitions"), F.coalesce("acres", F.lit(0.0)).alias("acres"), big.alias("biggest"))


def network_coverage(sites: DataFrame, cells: DataFrame, grid: terrain.Grid, mast_m: float = 10.0, **how: object) -> DataFrame:
    """(row, col, n, near) of all sites with masts over terrain."""
    return terrain.coverage(terrain.viewshed(terrain.observers(sites, cells, grid, mast_m=mast_m), cells, grid, **how))


def choose_sites(cells: DataFrame, grid: terrain.Grid, candidates: DataFrame, existing: DataFrame | None = None, k: int = 10, mast_m: float = 10.0, **how: object) -> DataFrame:
    """(pick, site, gain, km2): greedy sites by newly seen cells. candidates, existing: site, lat, lon; cells may hold ``target``."""
    from ..functions.geo import cell_km2

    def views(sites: DataFrame) -> DataFrame:
        seen = terrain.viewshed(terrain.observers(sites, cells, grid, mast_m=mast_m), cells, grid, **how)
        return seen.join(cells.where("target"), ["row", "col"], "left_semi") if "target" in cells.columns else seen

    v = views(candidates)
    if existing is not None:
        v = v.join(views(existing).select("row", "col").distinct(), ["row", "col"], "left_anti")
    v = v.withColumn("target", F.col("row").cast("bigint") * grid.cols + F.col("col"))
    middle = F.lit(grid.lat0 + grid.dlat * grid.rows / 2)
    return siting.greedy_cover(v, k).withColumn("km2", F.round(F.col("gain") * cell_km2(middle, abs(grid.dlat)), 2))


def smoke_views(fires: DataFrame, sites: DataFrame, cells: DataFrame, grid: terrain.Grid, heights: tuple[int, ...] = (100, 300), reach_m: float = 30_000.0, step_m: float = 60.0) -> DataFrame:
    """(fire, height, n): how many sites within reach see a smoke column so high. fires: fire, lat, lon; sites: site, lat, lon, h_obs."""
    from ..operators.joins import within

    f = terrain.sample_nearest(fires.select("fire", "lat", "lon"), cells, grid)
    p = within(f, sites.select("site", "lat", "lon", "h_obs"), reach_m).withColumn("height", F.explode(F.array(*map(F.lit, heights))))
    p = p.select(F.struct("l_fire", "r_site", "height").alias("pair"), F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"), F.col("r_h_obs").alias("h_obs"),
                 F.col("l_lat").alias("lat2"), F.col("l_lon").alias("lon2"), (F.col("l_z") + F.col("height")).alias("z_top"))
    seen = terrain.sees(p, cells, grid, r_max=reach_m, step_m=step_m)
    hits = seen.groupBy(F.col("pair.l_fire").alias("fire"), F.col("pair.height").alias("height")).agg(F.count_if("visible").alias("n"))
    every = fires.select("fire", F.explode(F.array(*map(F.lit, heights))).alias("height"))
    return every.join(hits, ["fire", "height"], "left").select("fire", "height", F.coalesce("n", F.lit(0)).alias("n"))


def sample_rows(samples: DataFrame, series: DataFrame, metrics: list[str], least: int = 15, until: str = "2023-06-30") -> DataFrame:
    """Evaluation rows: plausible daily means of a unit's samples with the series' values of the day and the season.

    samples: cam, site, species, date, lfmc, lat, lon; series: cam, date, metric, value. Units with few samples go.
    """
    from pyspark.sql import window as W

    from ..functions.frames import plausible_moisture, season

    s = samples.where(plausible_moisture("lfmc") & (F.col("date") <= F.lit(until).cast("date"))).withColumn("unit", F.concat_ws(" | ", "site", "species"))
    s = s.groupBy("cam", "unit", "site", "species", "date").agg(F.avg("lfmc").alias("lfmc"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    wide = series.groupBy("cam", "date").pivot("metric", metrics).agg(F.avg("value"))
    s = s.join(wide, ["cam", "date"], "left").withColumn("year", F.year("date"))
    s = s.withColumns(dict(zip(modelling.SEASON, season("date"))))
    return s.withColumn("__n", F.count("*").over(W.Window.partitionBy("cam", "unit"))).where(F.col("__n") >= least).drop("__n")
