"""Rasters, rays, viewsheds, lines of sight, panoramas, slopes. A raster is rows of (row, col, z) and a grid.

Rays are exploded as rows and joined to the raster by cell, so rays and raster are both spread; one window per ray
keeps the running horizon. Spark takes exploded rows for as small as what they came from, so pixels, panoramas and
bilinear samples are joined by merging, never broadcast; elsewhere Spark's own size check decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.base import c, d
from ..functions.geo import destination, drop_m, metres_per_degree


@dataclass(frozen=True)
class Grid:
    """Origin and step in degrees (dlat below zero) and size of a raster. Cell centres are half a step in."""

    lat0: float
    dlat: float
    lon0: float
    dlon: float
    rows: int
    cols: int

    def place(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Row and column as real numbers: whole at cell centres."""
        return (lat - d(self.lat0)) / d(self.dlat) - 0.5, (lon - d(self.lon0)) / d(self.dlon) - 0.5

    def cell(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """The cell that holds a point, perhaps outside the raster."""
        return F.floor((lat - d(self.lat0)) / d(self.dlat)).cast("int"), F.floor((lon - d(self.lon0)) / d(self.dlon)).cast("int")

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return d(self.lat0) + (row + 0.5) * d(self.dlat), d(self.lon0) + (col + 0.5) * d(self.dlon)

    def clipped(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.greatest(F.lit(0), F.least(F.lit(self.rows - 1), row)), F.greatest(F.lit(0), F.least(F.lit(self.cols - 1), col))

    def step_m(self, lat: Column) -> Column:
        ky, kx = metres_per_degree(lat)
        return F.least(F.abs(d(self.dlat)) * ky, F.abs(d(self.dlon)) * kx)


def sample_nearest(points: DataFrame, cells: DataFrame, grid: Grid, lat: str = "lat", lon: str = "lon", out: str = "z", value: str = "z") -> DataFrame:
    """Adds the value of the nearest cell, the edge's beyond the edge."""
    r, k = grid.place(c(lat), c(lon))
    r, k = grid.clipped(F.rint(r).cast("int"), F.rint(k).cast("int"))
    own = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), c(value).alias(out))
    return points.withColumn("__r", r).withColumn("__c", k).join(own, ["__r", "__c"], "left").drop("__r", "__c")


def sample_bilinear(points: DataFrame, cells: DataFrame, grid: Grid, key: str, lat: str = "lat", lon: str = "lon", out: str = "z", value: str = "z") -> DataFrame:
    """(points, out): interpolated between the four cells around; beyond the edge, along it. ``key`` names a point."""
    r, k = grid.place(c(lat), c(lon))
    r, k = F.greatest(d(0), F.least(d(grid.rows - 1), r)), F.greatest(d(0), F.least(d(grid.cols - 1), k))
    p = points.select(key, r.alias("__y"), k.alias("__x"))
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("q")
    p = p.select("*", corners)
    y, x = F.floor("__y").cast("int"), F.floor("__x").cast("int")
    fy, fx = F.col("__y") - y, F.col("__x") - x
    weight = F.when(F.col("q.i") == 1, fy).otherwise(1 - fy) * F.when(F.col("q.j") == 1, fx).otherwise(1 - fx)
    rr, cc = grid.clipped(y + F.col("q.i"), x + F.col("q.j"))
    p = p.select(key, weight.alias("w"), rr.alias("row"), cc.alias("col")).hint("merge").join(cells.select("row", "col", c(value).alias("v")), ["row", "col"])
    return points.hint("merge").join(p.groupBy(key).agg(F.sum(F.col("w") * F.col("v")).alias(out)), key, "left")


def observers(sites: DataFrame, cells: DataFrame, grid: Grid, key: str = "site", mast_m: float = 10.0) -> DataFrame:
    """Adds h_obs: ground (bilinear) and mast. Sites where the raster has no ground are left out."""
    return sample_bilinear(sites, cells, grid, key, out="__g").where("__g is not null").withColumn("h_obs", F.col("__g") + d(mast_m)).drop("__g")


def rays(sites: DataFrame, cells: DataFrame, grid: Grid, key: str = "site", r_max: float = 30_000.0, n_az: int = 3600, step_m: float | None = None, corners: bool = False, outside_z: float | None = None) -> DataFrame:
    """(key, az, dist, lat, lon, row, col, ang, visible) of every ray sample. sites: key, lat, lon, h_obs.

    A sample is visible if its angle is at least that of all before it on its ray. With ``corners`` the raster is read
    and reported by the nearest cell corner instead of centre. Off the raster the edge goes on, or is ``outside_z``.
    Samples on cells that the raster lacks are left out.
    """
    step = d(step_m) if step_m else grid.step_m(F.col("lat")) / 2
    s = sites.withColumn("__step", step).withColumn("__k", F.explode(F.sequence(F.lit(1), F.ceil((d(r_max) - F.col("__step") * 1e-9) / F.col("__step")).cast("int"))))
    s = s.withColumn("az", F.explode(F.sequence(F.lit(0), F.lit(n_az - 1)))).withColumn("dist", F.col("__k") * F.col("__step"))
    la, lo = destination(F.col("lat"), F.col("lon"), F.col("az") * d(360.0 / n_az), F.col("dist"))
    s = s.select(key, "az", "dist", "h_obs", la.alias("lat"), lo.alias("lon"))
    half = 0.5 if corners else 0.0
    r, k = (F.rint(x + half).cast("int") for x in grid.place(F.col("lat"), F.col("lon")))
    row, col = (r, k) if corners else grid.cell(F.col("lat"), F.col("lon"))
    s = s.withColumn("__off", ~(r.between(0, grid.rows - 1) & k.between(0, grid.cols - 1)))
    r, k = grid.clipped(r, k)
    s = s.withColumn("__r", r).withColumn("__c", k).join(cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "z"), ["__r", "__c"])
    if outside_z is not None:
        s = s.withColumn("z", F.when(F.col("__off"), d(outside_z)).otherwise(F.col("z")))
    s = s.withColumn("ang", (F.col("z") - drop_m(F.col("dist")) - F.col("h_obs")) / F.col("dist"))
    before = F.max("ang").over(W.Window.partitionBy(key, "az").orderBy("dist").rowsBetween(W.Window.unboundedPreceding, -1))
    return s.select(key, "az", "dist", "lat", "lon", row.alias("row"), col.alias("col"), "ang", F.coalesce(F.col("ang") >= before, F.lit(True)).alias("visible"))


def viewshed(sites: DataFrame, cells: DataFrame, grid: Grid, key: str = "site", **how: object) -> DataFrame:
    """(key, row, col, dist): the cells that each site sees, with the nearest visible sample's distance."""
    seen = rays(sites, cells, grid, key, **how).where("visible").where(F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1))
    return seen.groupBy(key, "row", "col").agg(F.min("dist").alias("dist"))


def coverage(views: DataFrame, near_m: float = 10_000.0, most: int = 255) -> DataFrame:
    """(row, col, n, near): how many sites see a cell, and how many of those within ``near_m``; counts saturate."""
    near = F.sum(F.when(F.col("dist") <= near_m, 1).otherwise(0))
    return views.groupBy("row", "col").agg(F.least(F.count("*"), F.lit(most)).alias("n"), F.least(near, F.lit(most)).alias("near"))


def sees(pairs: DataFrame, cells: DataFrame, grid: Grid, key: str = "pair", r_max: float | None = None, step_m: float | None = None) -> DataFrame:
    """(key, visible): line of sight from (lat, lon, h_obs) to (lat2, lon2, z_top) of each pair.

    Under a metre apart: visible without a range, else not; farther than ``r_max``: not. All samples strictly between
    must lie under the straight line, both bent by curvature.
    """
    p = pairs.select(key, "lat", "lon", "h_obs", "lat2", "lon2", "z_top")
    ky, kx = metres_per_degree((F.col("lat") + F.col("lat2")) / 2)
    p = p.withColumn("__d", F.hypot((F.col("lat2") - F.col("lat")) * ky, (F.col("lon2") - F.col("lon")) * kx))
    p = p.withColumn("__s", d(step_m) if step_m else F.least(F.abs(d(grid.dlat)) * ky, F.abs(d(grid.dlon)) * kx) / 2)
    last = F.ceil((F.col("__d") - F.col("__s") / 2) / F.col("__s")).cast("int") - 1
    ray = p.where("__d >= 1").withColumn("__k", F.explode(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))))
    t = F.col("__k") * F.col("__s") / F.col("__d")
    ray = ray.withColumn("__t", t).withColumn("__la", F.col("lat") + F.col("__t") * (F.col("lat2") - F.col("lat"))).withColumn("__lo", F.col("lon") + F.col("__t") * (F.col("lon2") - F.col("lon")))
    ray = sample_nearest(ray, cells, grid, "__la", "__lo", "__z")
    line = F.col("h_obs") + (F.col("z_top") - drop_m(F.col("__d")) - F.col("h_obs")) * F.col("__t")
    free = ray.groupBy(key).agg(F.bool_and(F.col("__z") - drop_m(F.col("__t") * F.col("__d")) < line).alias("free"))
    near = F.lit(r_max is None)
    out = F.when(F.col("__d") < 1, near).when(F.col("__d") > (r_max or float("inf")), F.lit(False)).otherwise(F.coalesce("free", F.lit(True)))
    return p.select(key, "__d").join(free, key, "left").select(key, out.alias("visible"))


def panorama(sites: DataFrame, cells: DataFrame, grid: Grid, key: str = "site", az_lo: float = 0.0, az_hi: float = 360.0, az_step: float = 0.05, max_d: float = 32_000.0, step_d: float = 30.0) -> DataFrame:
    """(key, az_idx, d_idx, az, dist, lat, lon, ang, cummax): elevation angles of ground seen from (lat, lon, height)."""
    n_az, n_d = int((az_hi + 1e-9 - az_lo) / az_step) + 1, -int(-(max_d - 60.0) // step_d)
    s = sites.withColumn("az_idx", F.explode(F.sequence(F.lit(0), F.lit(n_az - 1)))).withColumn("d_idx", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))))
    s = s.withColumn("az", d(az_lo) + F.col("az_idx") * d(az_step)).withColumn("dist", d(60.0) + F.col("d_idx") * d(step_d))
    la, lo = destination(F.col("lat"), F.col("lon"), F.col("az"), F.col("dist"))
    s = s.withColumns({"__id": F.struct(key, "az_idx", "d_idx"), "lat": la, "lon": lo})
    s = sample_bilinear(s, cells, grid, "__id", out="__h")
    s = s.withColumn("ang", F.degrees(F.atan2(F.col("__h") - drop_m(F.col("dist")) - F.col("height"), F.col("dist"))))
    w = W.Window.partitionBy(key, "az_idx").orderBy("d_idx")
    return s.withColumn("cummax", F.max("ang").over(w.rowsBetween(W.Window.unboundedPreceding, 0))).select(key, "az_idx", "d_idx", "az", "dist", "lat", "lon", "ang", "cummax")


def skyline(pano: DataFrame, key: str = "site") -> DataFrame:
    """(key, az_idx, az, el): the highest ground angle of each azimuth."""
    return pano.groupBy(key, "az_idx", "az").agg(F.max("ang").alias("el"))


def ground_of_pixels(pixels: DataFrame, pano: DataFrame, az_lo: float, az_step: float, key: str = "site") -> DataFrame:
    """(pixels, dist, lat, lon): the first ground of a pixel's azimuth whose running angle reaches its elevation; NULL: sky.

    pixels: key, u, v, az, el, with azimuths unwrapped to the panorama.
    """
    n = pano.groupBy(key).agg(F.max("az_idx").alias("__n"))
    p = pixels.hint("merge").join(n, key)
    p = p.withColumn("az_idx", F.greatest(F.lit(0), F.least(F.col("__n"), F.rint((F.col("az") - d(az_lo)) / d(az_step)).cast("int")))).drop("__n")
    hits = p.select(key, "u", "v", "az_idx", "el").hint("merge").join(pano.select(key, "az_idx", "d_idx", "dist", "lat", "lon", "cummax"), [key, "az_idx"]).where("cummax >= el")
    first = hits.groupBy(key, "u", "v").agg(F.min_by(F.struct("dist", "lat", "lon"), F.col("d_idx")).alias("h"))
    return p.drop("az_idx").hint("merge").join(first, [key, "u", "v"], "left").select(*pixels.columns, "h.dist", "h.lat", "h.lon")


def slopes(cells: DataFrame, grid: Grid, lat: float) -> DataFrame:
    """(row, col, slope, aspect, gx, gy): degrees of slope and the bearing it faces, by central differences."""
    ky, kx = metres_per_degree(d(lat))
    dy, dx = F.abs(d(grid.dlat)) * ky, d(grid.dlon) * kx

    def gradient(by: str, along: str, step: Column) -> Column:
        w = W.Window.partitionBy(by).orderBy(along)
        back, ahead = F.lag("z").over(w), F.lead("z").over(w)
        n = F.when(back.isNull() | ahead.isNull(), 1).otherwise(2)
        return (F.coalesce(ahead, F.col("z")) - F.coalesce(back, F.col("z"))) / (n * step)

    g = cells.withColumn("gx", gradient("row", "col", dx)).withColumn("gy", gradient("col", "row", dy))
    north = -F.col("gy")
    aspect = F.pmod(F.degrees(F.atan2(-F.col("gx"), -north)) + 360, d(360))
    return g.select("row", "col", F.degrees(F.atan(F.hypot("gx", north))).alias("slope"), aspect.alias("aspect"), "gx", "gy")


def hilltops(cells: DataFrame, block_rows: int, block_cols: int, whole_blocks: bool = False, rows: int = 0, cols: int = 0) -> DataFrame:
    """(row, col, z): the highest cell of each block, the first in row order on a tie. NULL cells are masked out."""
    b = cells.where("z is not null")
    if whole_blocks:
        b = b.where((F.col("row") < rows // block_rows * block_rows) & (F.col("col") < cols // block_cols * block_cols))
    b = b.groupBy(F.floor(F.col("row") / block_rows).alias("br"), F.floor(F.col("col") / block_cols).alias("bc"))
    return b.agg(F.max(F.struct("z", (-F.col("row")).alias("r"), (-F.col("col")).alias("k"))).alias("m")).select((-F.col("m.r")).alias("row"), (-F.col("m.k")).alias("col"), "m.z")


def mosaic(tiles: DataFrame, nodata: float = 0.0) -> DataFrame:
    """(row, col, z): overlapping tiles as one raster; the later item wins, cells without data are skipped. tiles: item, row, col, z."""
    return tiles.where(F.col("z") != nodata).groupBy("row", "col").agg(F.max_by("z", "item").alias("z"))


def coarsened(cells: DataFrame, k: int, value: str = "z", how: str = "avg") -> DataFrame:
    """(row, col, value): k by k cells as one, by mean or by the commonest value (the least among equals)."""
    at = [F.floor(F.col(x) / k).cast("int").alias(x) for x in ("row", "col")]
    if how == "mode":
        n = cells.groupBy(*at, c(value).alias(value)).agg(F.count("*").alias("__n"))
        return n.groupBy("row", "col").agg(F.min(F.struct((-F.col("__n")).alias("n"), value)).alias("m")).select("row", "col", F.col(f"m.{value}"))
    return cells.groupBy(*at).agg(F.avg(value).alias(value))
