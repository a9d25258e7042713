"""Samples, satellite points, rasters, camera and fire lists, region series; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.base import c
from ..functions.frames import reflectance
from ..functions.geo import snapped

# Column names of the public field sample table.
SAMPLE_COLUMNS = {
    "site": "Site name", "lat": "Latitude (WGS84, EPSG:4326)", "lon": "Longitude (WGS84, EPSG:4326)",
    "date": "Sampling date (YYYYMMDD)", "lfmc": "LFMC value (%)", "species": "Species collected",
}


def samples(raw: DataFrame, country: str | None = "USA") -> DataFrame:
    """Field samples with usable place, date and moisture; numbers and dates that do not parse are NULL and go."""
    own = raw.where(F.col("Country") == country) if country else raw
    col = {k: F.col(f"`{v}`") for k, v in SAMPLE_COLUMNS.items()}
    text = col["date"].cast("string")
    out = own.withColumn("site", col["site"]).withColumn("species", col["species"])
    for k in ("lat", "lon", "lfmc"):
        out = out.withColumn(k, col[k].cast("string").try_cast("double"))
    day = F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(F.substr(text, F.lit(1), F.lit(8)), "yyyyMMdd"), F.try_to_date(F.substr(text, F.lit(1), F.lit(10)), "yyyy-MM-dd"))
    return out.withColumn("date", day).dropna(subset=["lat", "lon", "date", "lfmc"])


def point_windows(points: DataFrame, cells: DataFrame, bands: list[str], quality: str = "q") -> DataFrame:
    """(point, date, bands, qa_full): means of 3x3 cells around points without fill values, and the share of full quality.

    points: point, row, col; cells: date, row, col, bands, q as stored.
    """
    near = [F.struct((F.col("row") + i).alias("r"), (F.col("col") + j).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    p = points.select("point", F.explode(F.array(*near)).alias("n")).select("point", F.col("n.r").alias("row"), F.col("n.k").alias("col"))
    both = p.join(cells, ["row", "col"])
    return both.groupBy("point", "date").agg(*(F.avg(reflectance(b)).alias(b) for b in bands), F.avg((c(quality) == 0).cast("double")).alias("qa_full"))


def satellite_items(items: DataFrame, keys: list[str], date: str = "date", order: str = "item", every: int = 8) -> DataFrame:
    """One item a date (the last in order), of every eighth day of the year from the first."""
    days = items.where(F.dayofyear(date) % every == 1)
    w = W.Window.partitionBy(*keys, date).orderBy(F.desc(order))
    return days.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def satellite_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows (tile, date, site, values) of a JSONL log of items; bad lines and errors are left out."""
    raw = spark.read.schema(f"tile string, date string, error string, pts map<string, struct<{schema}>>, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = raw.where("error is null and pts is not null").select("tile", F.try_to_date("date").alias("date"), F.explode("pts").alias("site", "v"))
    return rows.select("tile", "date", "site", "v.*")


def by_tile(points: DataFrame, tile: Column) -> DataFrame:
    """(tile, n, points): points grouped by their tile; those without one are dropped."""
    return points.withColumn("tile", tile).where("tile is not null").groupBy("tile").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("point")).alias("points"))


def tiles_around(tiles: DataFrame, lat: float, lon: float, metres: float, prefer: str | None = None) -> DataFrame:
    """Raster tiles (id, lat_lo, lat_hi, lon_lo, lon_hi) that meet the square around a point; the preferred ids if any."""
    from math import cos, radians

    y, x = metres / 110_540.0, metres / (111_320.0 * cos(radians(lat)))
    hit = tiles.where((F.col("lat_hi") >= lat - y) & (F.col("lat_lo") <= lat + y) & (F.col("lon_hi") >= lon - x) & (F.col("lon_lo") <= lon + x))
    if prefer:
        ok = F.contains("id", F.lit(prefer))
        hit = hit.crossJoin(hit.agg(F.max(ok).alias("__any"))).where(ok | ~F.col("__any")).drop("__any")  # one row
    return hit


def camera_table(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, and other columns as text) of camera CSV files; rows whose place is no number are left out."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.withColumn("lat", F.col("lat").try_cast("double")).withColumn("lon", F.col("lon").try_cast("double")).dropna(subset=["lat", "lon"])


def camera_features(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """(id, name, state, county, sponsor, lon, lat, elev, az, fov) of a GeoJSON camera list, of one state if given; those without a place are left out."""
    prop = "id string, name string, state string, county string, sponsor string, az_current double, fov double"
    raw = spark.read.schema(f"features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<{prop}>>>").option("multiLine", "true").json(path)
    f = raw.select(F.explode("features").alias("f"))
    at = lambda k: F.get("f.geometry.coordinates", F.lit(k))
    p = F.col("f.properties")
    out = f.select(p["id"].alias("id"), p["name"].alias("name"), p["state"].alias("state"), p["county"].alias("county"), p["sponsor"].alias("sponsor"),
                   at(0).alias("lon"), at(1).alias("lat"), at(2).alias("elev"), p["az_current"].alias("az"), p["fov"].alias("fov"))
    return out.where(F.col("lon").isNotNull() & ((F.col("state") == state) if state else F.lit(True)))


def camera_sites(cameras: DataFrame, step: float = 0.002, order: str = "id") -> DataFrame:
    """Cameras at one place as a site: mean place, median known elevation, ids, names and aims in order, first county."""
    keys = [snapped(c("lat"), step).alias("ky"), snapped(c("lon"), step).alias("kx")]
    listed = F.sort_array(F.collect_list(F.struct(c(order).alias("o"), "id", "name", "az", "fov")))
    g = cameras.groupBy(*keys).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.percentile("elev", F.lit(0.5)).alias("elev"), F.count("*").alias("n"),
                                   listed.alias("l"), F.min_by("county", order).alias("county"), F.min_by("sponsor", order).alias("sponsor"))
    aims = F.transform("l", lambda x: F.struct(x["az"].alias("az"), x["fov"].alias("fov")))
    return g.select("ky", "kx", "lat", "lon", "elev", "n", F.col("l.id").alias("ids"), F.col("l.name").alias("names"), aims.alias("aims"), "county", "sponsor")


def incident_pages(spark: SparkSession, path: str) -> DataFrame:
    """(attributes, geometry) of the pages of a feature service that lie as JSON files, for ``fires``. ``fetch.pages`` gets them."""
    fields = "OBJECTID: bigint, IncidentName: string, FireDiscoveryDateTime: bigint, IncidentSize: double, InitialLatitude: double, InitialLongitude: double, POOCounty: string"
    schema = f"features array<struct<attributes: struct<{fields}>, geometry: struct<x: double, y: double>>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("features").alias("f")).select("f.attributes", "f.geometry")


def fires(pages: DataFrame) -> DataFrame:
    """Incidents of paged feature lists: place from the geometry, else the initial one; dates from milliseconds; NULLs go.

    pages: attributes and geometry structs (FireDiscoveryDateTime, IncidentSize, InitialLatitude, ..., x, y).
    """
    a, g = "attributes", "geometry"
    out = pages.select(f"{a}.*", F.coalesce(f"{g}.x", f"{a}.InitialLongitude").alias("lon"), F.coalesce(f"{g}.y", f"{a}.InitialLatitude").alias("lat"))
    return out.withColumn("date", F.timestamp_millis("FireDiscoveryDateTime").cast("timestamp_ntz")).dropna(subset=["lon", "lat", "date"])


def curated_series(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of curated region tables, which have # comment lines, with ``file``."""
    return spark.read.schema(schema).option("comment", "#").option("header", "true").csv(path).withColumn("file", F.col("_metadata.file_name"))


def fullest_file(rows: DataFrame, keys: list[str], start: str, end: str, least: int = 30) -> DataFrame:
    """The rows of the file with most days in a time, the first by name among equals; none under ``least`` days."""
    inside = c("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    n = rows.where(inside).groupBy(*keys, "file").agg(F.count_distinct("date").alias("n"))
    w = W.Window.partitionBy(*keys).orderBy(F.desc("n"), "file")
    top = n.withColumn("__r", F.row_number().over(w)).where((F.col("__r") == 1) & (F.col("n") >= least)).select(*keys, "file")
    return rows.join(top, [*keys, "file"], "left_semi")


def write_daily(series: DataFrame, path: str) -> None:
    """Daily series as CSV, numbers to five places, one column a metric."""
    wide = series.groupBy("cam", "date").pivot("metric").agg(F.first("value"))
    shown = [F.round(n, 5).alias(n) for n in wide.columns if n not in ("cam", "date")]
    wide.select("cam", "date", *shown).write.partitionBy("cam").mode("overwrite").option("header", "true").csv(path)


def write_sites(picks: DataFrame, path: str) -> None:
    """Chosen sites as CSV: places to five decimals."""
    picks.select(F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.round("elev", 1).alias("elev"), "new_cells", F.round("new_km2", 2).alias("new_km2")).write.mode("overwrite").option("header", "true").csv(path)


def write_log(rows: DataFrame, path: str) -> None:
    """Quality records and daily histories as JSON lines, appended."""
    rows.write.mode("append").json(path)


def write_raster(cells: DataFrame, path: str, tile: int = 512) -> None:
    """Raster cells as Parquet, one folder a tile row, so a window reads few files."""
    cells.withColumn("tile", F.floor(F.col("row") / tile).cast("int")).write.partitionBy("tile").mode("overwrite").parquet(path)


def class_labels(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, label) of model labels: the first name of each line."""
    return lines.select(F.col("id"), F.trim(F.split(column, ",")[0]).alias("label"))
