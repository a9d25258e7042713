"""Frame quality, season terms, satellite screening, dates and identifiers of sources."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import c, d


def usable_frame(mean: Column | str, sharpness: Column | str, std: Column | str, saturated: Column | str, least_std: float = 20.0) -> Column:
    """Whether a frame is neither dark nor bright, blurred, flat or saturated."""
    return (c(mean) > 40) & (c(mean) < 225) & (c(sharpness) > 40) & (c(std) > least_std) & (c(saturated) < 0.2)


def clarity(sharpness: Column | str, sky: Column | str, ground: Column | str) -> Column:
    """Score of how clear a frame is."""
    return c(sharpness) / d(500) + c(sky) / d(100) + c(ground) / d(80)


def season(date: Column | str) -> tuple[Column, Column, Column, Column]:
    """Sine and cosine of the day of the year, once and twice around."""
    t = F.dayofyear(c(date)).cast("double") / d(365.25) * d(2 * pi)
    return F.sin(t), F.cos(t), F.sin(2 * t), F.cos(2 * t)


def plausible_moisture(x: Column | str) -> Column:
    """Live fuel moisture from 20 to 400 percent."""
    return c(x).between(20, 400)


def reflectance(raw: Column | str) -> Column:
    """A stored satellite value as reflectance; the fill value is NULL."""
    return F.when(c(raw) != 32767, c(raw) * d(1e-4))


def path_date(path: Column | str) -> Column:
    """The time in a camera archive's file name (..._YYYY_MM_DD_HHMM...); NULL without one."""
    text = F.regexp_replace(F.regexp_extract(c(path), r"_(\d{4}_\d{2}_\d{2}_\d{4})", 1), "_", "")
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")


def infrared_twin(path: Column | str) -> Column:
    """Name of the infrared twin of a colour frame: _IR_ goes in before the date."""
    return F.regexp_replace(c(path), r"_(\d{4}_\d{2}_\d{2}_)", "_IR_$1")


def exposure(meta: Column | str) -> Column:
    """The exposure noted on a line of its own in a frame's metadata."""
    return F.nullif(F.regexp_extract(c(meta), r"(?m)^exposure=(\d+)", 1), F.lit("")).cast("int")


def javascript_json(text: Column | str) -> Column:
    """The JSON object inside a script: from the first brace to the last."""
    return F.regexp_extract(c(text), r"(?s)(\{.*\})", 1)
