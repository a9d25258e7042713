"""Colour indices of block means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import c, d, ratio


def gcc(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Green chromatic coordinate; NULL for black."""
    return ratio(c(g), c(r) + c(g) + c(b))


def grvi(r: Column | str, g: Column | str) -> Column:
    """Green-red vegetation index; NULL where both are zero."""
    return ratio(c(g) - c(r), c(g) + c(r))


def normalised_difference(a: Column | str, b: Column | str) -> Column:
    """(a - b) / (a + b): NDVI of near infrared and red, NDII of near and short-wave infrared."""
    return ratio(c(a) - c(b), c(a) + c(b))


def camera_ndvi(r: Column | str, g: Column | str, b: Column | str, ir: Column | str, e_rgb: Column | str, e_ir: Column | str) -> Column:
    """NDVI of a camera with an infrared twin frame: both brought to equal exposure, visible light taken off infrared."""
    scale = F.sqrt(c(e_rgb))
    red, green, blue = (ratio(c(x), scale) for x in (r, g, b))
    luma = d(0.3) * red + d(0.59) * green + d(0.11) * blue
    near = ratio(c(ir), F.sqrt(c(e_ir))) - luma
    return ratio(near - red, near + red)


def balanced(r: Column | str, b: Column | str, log_rg: Column | str, log_bg: Column | str) -> tuple[Column, Column]:
    """Red and blue with a cast taken off: logs of the cast's red/green and blue/green ratios."""
    return c(r) * F.exp(-c(log_rg)), c(b) * F.exp(-c(log_bg))
