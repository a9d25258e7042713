"""Small helpers that the rest builds on: missing values, rounding, ordered extremes, left-open time frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_M = 6_371_000.0
DAY_S = 86_400


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def d(x: float) -> Column:
    """A double literal (decimal literals lose precision in trigonometry)."""
    return F.lit(float(x))


def missing_nan(x: Column | str) -> Column:
    """NaN as NULL: what every frame that comes from numpy or pandas goes through."""
    return F.when(~F.isnan(c(x)), c(x))


def clean_nan(df: DataFrame) -> DataFrame:
    """All float columns with NaN as NULL."""
    return df.select(*(missing_nan(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in df.schema))


def rounded(x: Column | str, places: int) -> Column:
    """Rounded half up, never negative zero."""
    return F.round(c(x), places) + d(0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def fused(a: Column, b: Column, s: Column) -> Column:
    """a * b + s in one rounding: the errors of product and sum are added last; two roundings where that overflows."""
    def halves(x: Column) -> tuple[Column, Column]:
        high = x * d(134217729) - (x * d(134217729) - x)
        return high, x - high

    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    t = p + s
    off = (p - (t - (t - p))) + (s - (t - p)) + (al * bl - (((p - ah * bh) - al * bh) - ah * bl))
    return F.when(F.isnan(t + off), t).otherwise(t + off)


def with_quantile(df: DataFrame, values: str, q: float, out: str) -> DataFrame:
    """Adds the interpolated quantile of a column of sorted arrays, to the last bit that of SQL's quantile_cont (DuckDB, fused)."""
    at = (F.size(values) - 1) * d(q)
    ends = df.withColumns({"__lo": F.get(values, F.floor(at).cast("int")), "__hi": F.get(values, F.ceil(at).cast("int")), "__part": at - F.floor(at)})
    between = fused(F.col("__lo"), 1 - F.col("__part"), F.col("__hi") * F.col("__part"))
    return ends.withColumn(out, F.when(F.col("__part") == 0, F.col("__lo")).otherwise(between)).drop("__lo", "__hi", "__part")


def first_max(value: Column | str, by: Column | str, order: Column | str) -> Column:
    """The value at the largest ``by``; the least ``order`` among equals."""
    return F.max_by(c(value), F.struct(c(by).alias("k"), (-c(order)).alias("o")))


def first_min(value: Column | str, by: Column | str, order: Column | str) -> Column:
    """The value at the smallest ``by``; the least ``order`` among equals."""
    return F.min_by(c(value), F.struct(c(by).alias("k"), c(order).alias("o")))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp or date without time zone."""
    return F.unix_micros(c(ts).cast("timestamp"))


def trailing(days: int) -> tuple[int, int]:
    """Bounds of a left-open trailing frame (t - days, t] over an ordering by ``micros``."""
    return -(days * DAY_S * 1_000_000) + 1, 0
