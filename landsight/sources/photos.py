"""Photo archives and what their file names, lists and metadata say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import c
from ..functions.encode import photo_time
from ..functions.frames import exposure, infrared_twin, javascript_json, path_date
from .exif import exif_time

PHOTOS = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[pP][pP][mM],[nN][pP][yY]}"


def photo_folder(spark: SparkSession, folder: str, pattern: str = PHOTOS) -> DataFrame:
    """binaryFile rows of a folder's own photos with ``ts``, without undated ones, ordered by time and path.

    The time is that of the name, else the one noted inside the file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).withColumn("__named", photo_time(F.col("path")))
    noted = exif_time(F.when(F.col("__named").isNull(), F.col("content")))
    return files.withColumn("ts", F.coalesce("__named", noted)).drop("__named").where("ts is not null").orderBy("ts", "path")


def midday_paths(lists: DataFrame, line: str = "value") -> DataFrame:
    """(site columns, path, ts) of the .jpg lines of camera lists."""
    path = F.trim(line)
    return lists.where(path.endswith(".jpg")).withColumn("path", path).withColumn("ts", path_date("path")).drop(line)


def frame_stamps(lists: DataFrame, line: str = "value") -> DataFrame:
    """Adds ``at``, the Unix time in frame names like 1700000000.jpg; other names are left out."""
    names = lists.withColumn("__name", F.explode(F.split(F.trim(line), r"\s+")))
    at = F.regexp_extract("__name", r"^(\d+)\.jpg$", 1)
    return names.where(at != "").withColumn("at", at.cast("bigint")).drop("__name", line)


def site_script(text: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of a JSON object that stands inside a script."""
    return text.select(F.from_json(javascript_json(column), schema).alias("o")).select("o.*")


def jobs(paths: DataFrame, samples: DataFrame, site: str = "site", days_before: int = 90, until: str = "2023-06-30") -> DataFrame:
    """Paths of the time of a site's samples: from so many days before the first to the last, or ``until`` if earlier."""
    span = samples.groupBy(site).agg(F.date_sub(F.min("date"), days_before).alias("__a"), F.least(F.max("date"), F.lit(until).cast("date")).alias("__z"))
    return paths.join(span, site).where(c("ts").cast("date").between(F.col("__a"), F.col("__z"))).drop("__a", "__z")


def infrared_pairs(colour: DataFrame, infrared: DataFrame, site: str = "site") -> DataFrame:
    """Adds ``ir_path`` to colour frames: the twin by name, else the first infrared frame of that day."""
    names = infrared.select(site, F.col("path").alias("__twin")).distinct()
    days = infrared.groupBy(site, F.col("ts").cast("date").alias("__day")).agg(F.min("path").alias("__any"))
    out = colour.withColumn("__twin", infrared_twin("path")).withColumn("__day", F.col("ts").cast("date"))
    out = out.join(names.withColumn("__has", F.lit(True)), [site, "__twin"], "left").join(days, [site, "__day"], "left")
    return out.withColumn("ir_path", F.when(F.col("__has"), F.col("__twin")).otherwise(F.col("__any"))).drop("__twin", "__day", "__has", "__any")


def exposures(meta: DataFrame, text: str = "value") -> DataFrame:
    """Adds ``exposure`` from metadata texts; NULL where none is noted."""
    return meta.withColumn("exposure", exposure(text))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not yet in a sink: resumable fetches and appends."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
