"""Ordered and windowed operators on sensor series.

Every window is partitioned by the series' key and left-open in time. Exact quantiles in time frames are exact
``percentile``; a series has one row a timestamp where ties would matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.base import c, micros, ratio, trailing, with_quantile


def by_time(keys: list[str], ts: str = "ts") -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(micros(ts))


def clear_flags(df: DataFrame, keys: list[str], value: str, ts: str = "ts", days: int = 90, q: float = 0.8, share: float = 0.8, least: int = 5, out: str = "clear") -> DataFrame:
    """Adds a flag: the value reaches ``share`` of the trailing quantile; false with fewer than ``least`` values.

    A value may be just that share, so the quantile is that of the SQL to the last bit, which ``percentile`` is not.
    """
    w = by_time(keys, ts).rangeBetween(*trailing(days))
    seen = df.withColumn("__seen", F.sort_array(F.collect_list(c(value).cast("double")).over(w)))
    top = with_quantile(seen, "__seen", q, "__top")
    return top.withColumn(out, F.coalesce((F.size("__seen") >= least) & (c(value) >= F.lit(share) * F.col("__top")), F.lit(False))).drop("__seen", "__top")


def causal_smooth(df: DataFrame, keys: list[str], value: str, ts: str = "ts", q: float = 0.9, quantile_days: int = 7, mean_days: int = 15, out: str = "smooth") -> DataFrame:
    """Adds the trailing mean of the trailing quantile: depends on nothing later than the row."""
    w = by_time(keys, ts)
    top = df.withColumn("__top", F.percentile(c(value), F.lit(q)).over(w.rangeBetween(*trailing(quantile_days))))
    return top.withColumn(out, F.avg("__top").over(w.rangeBetween(*trailing(mean_days)))).drop("__top")


def last_of_day(df: DataFrame, keys: list[str], ts: str = "ts", order: str | None = None) -> DataFrame:
    """One row a day: the last by time, then by ``order``. Adds ``date``."""
    last = [micros(ts).desc(), *([c(order).desc()] if order else [])]
    w = W.Window.partitionBy(*keys, "date").orderBy(*last)
    return df.withColumn("date", c(ts).cast("date")).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def calendar(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Every day from a key's first to its last."""
    ends = df.groupBy(*keys).agg(F.min(date).alias("__a"), F.max(date).alias("__z"))
    return ends.select(*keys, F.explode(F.sequence("__a", "__z")).alias(date))


def densified(df: DataFrame, keys: list[str], value: str, date: str = "date", fill: int = 0) -> DataFrame:
    """A row for every day; the value carried on over at most ``fill`` missing days."""
    days = calendar(df, keys, date).join(df.select(*keys, date, value), [*keys, date], "left")
    if not fill:
        return days
    w = W.Window.partitionBy(*keys).orderBy(date).rowsBetween(-fill, 0)
    return days.withColumn(value, F.last(value, ignorenulls=True).over(w))


def daily(df: DataFrame, keys: list[str], value: str, ts: str = "ts", clear: str = "clear", order: str | None = None, least_days: int = 30, fill: int = 21) -> DataFrame:
    """(keys, date, value): causal daily series of clear frames; keys with fewer than ``least_days`` clear days have none."""
    days = last_of_day(df, keys, ts, order).where(c(clear) & c(value).isNotNull())
    days = days.withColumn("__days", F.count("*").over(W.Window.partitionBy(*keys))).where(F.col("__days") >= least_days)
    smooth = causal_smooth(days, keys, value, "date", out="__smooth").select(*keys, "date", F.col("__smooth").alias(value))
    return densified(smooth, keys, value, fill=fill)


def zscore(df: DataFrame, keys: list[str], value: str, out: str = "z") -> DataFrame:
    """Adds the value in sample standard deviations from the key's mean; NULL where all are equal."""
    w = W.Window.partitionBy(*keys)
    return df.withColumn(out, ratio(c(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)))


def combined(df: DataFrame, keys: list[str], value: str, date: str = "date") -> DataFrame:
    """One series of several views: the mean of those that have the day."""
    return df.groupBy(*keys, date).agg(F.avg(value).alias(value))


def drift(df: DataFrame, keys: list[str], values: list[str], ts: str = "ts", days: int = 61) -> DataFrame:
    """Adds to each of ``values`` (as <value>_drift) its trailing median less the key's median of all."""
    w = by_time(keys, ts).rangeBetween(*trailing(days))
    every = W.Window.partitionBy(*keys)
    for v in values:
        df = df.withColumn(f"{v}_drift", F.percentile(c(v), F.lit(0.5)).over(w))
    for v in values:
        df = df.withColumn(f"{v}_drift", F.col(f"{v}_drift") - F.percentile(F.col(f"{v}_drift"), F.lit(0.5)).over(every))
    return df


def weekly_amplitude(df: DataFrame, keys: list[str], value: str, date: str = "date", days: int = 7, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(keys, amp): spread of quantiles of the centred 3-bin median of medians of bins counted from the key's first day."""
    start = F.min(date).over(W.Window.partitionBy(*keys))
    bins = df.withColumn("__bin", F.floor(F.date_diff(c(date), start) / days).cast("int"))
    med = bins.groupBy(*keys, "__bin").agg(F.percentile(c(value), F.lit(0.5)).alias("__med"))
    ends = med.groupBy(*keys).agg(F.max("__bin").alias("__z"))
    every = ends.select(*keys, F.explode(F.sequence(F.lit(0), "__z")).alias("__bin")).join(med, [*keys, "__bin"], "left")
    w = W.Window.partitionBy(*keys).orderBy("__bin").rowsBetween(-1, 1)
    smooth = every.withColumn("__mid", F.percentile("__med", F.lit(0.5)).over(w))
    return smooth.groupBy(*keys).agg((F.percentile("__mid", F.lit(high)) - F.percentile("__mid", F.lit(low))).alias("amp"))


def change(df: DataFrame, keys: list[str], value: str, date: str = "date", days: int = 30, out: str = "change") -> DataFrame:
    """Adds the value less that of so many rows before, on a series with a row for every day."""
    return df.withColumn(out, c(value) - F.lag(value, days).over(W.Window.partitionBy(*keys).orderBy(date)))


def satellite_daily(df: DataFrame, keys: list[str], value: str, date: str = "date", days: int = 17, fill: int = 16) -> DataFrame:
    """(keys, date, value): trailing medians of satellite dates, carried on over at most ``fill`` days."""
    w = by_time(keys, date).rangeBetween(*trailing(days))
    first = df.groupBy(*keys, date).agg(F.avg(value).alias(value))
    return densified(first.withColumn(value, F.percentile(c(value), F.lit(0.5)).over(w)), keys, value, date, fill)


def sustained_moves(df: DataFrame, keys: list[str], ts: str = "ts", x: str = "tx", y: str = "ty", window: int = 15, least_px: float = 30.0, gap_days: int = 60) -> DataFrame:
    """(keys, ts, jump): where the median offset jumps and stays; of moves nearer than the gap to the kept one, the larger."""
    w = by_time(keys, ts)
    least = window // 2
    med = lambda v, a, b: F.when(F.count(v).over(w.rowsBetween(a, b)) >= least, F.percentile(c(v), F.lit(0.5)).over(w.rowsBetween(a, b)))
    at = df.select(*keys, ts, *(med(v, 1 - window, 0).alias(f"b{v}") for v in (x, y)), *(med(v, 0, window - 1).alias(f"a{v}") for v in (x, y)))
    at = at.select(*keys, ts, F.hypot(*(F.lead(f"a{v}").over(by_time(keys, ts)) - F.col(f"b{v}") for v in (x, y))).alias("jump")).where(F.col("jump") > least_px)
    found = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(ts, "jump"))).alias("__m"))
    kind = found.schema["__m"].dataType.simpleString()

    def step(kept: Column, move: Column) -> Column:
        last = F.element_at(kept, -1)
        near = F.floor((micros(move[ts]) - micros(last[ts])) / (86_400 * 1_000_000)) < gap_days
        swap = F.when(move["jump"] > last["jump"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(move))).otherwise(kept)
        return F.when(F.size(kept) == 0, F.array(move)).when(near, swap).otherwise(F.concat(kept, F.array(move)))

    kept = F.aggregate("__m", F.array().cast(kind), lambda a, m: F.when(F.size(a) == 0, F.array(m)).otherwise(step(a, m)))
    return found.select(*keys, F.explode(kept).alias("__k")).select(*keys, f"__k.{ts}", "__k.jump")


def interpolated(df: DataFrame, keys: list[str], value: str, date: str = "date", limit: int = 20, out: str = "filled") -> DataFrame:
    """Adds the value with gaps filled linearly over at most ``limit`` rows after a value; a last value carries on."""
    back = W.Window.partitionBy(*keys).orderBy(date).rowsBetween(W.Window.unboundedPreceding, 0)
    ahead = W.Window.partitionBy(*keys).orderBy(date).rowsBetween(0, W.Window.unboundedFollowing)
    n = df.withColumn("__n", F.row_number().over(W.Window.partitionBy(*keys).orderBy(date)))
    at = F.when(c(value).isNotNull(), F.col("__n"))
    n = n.withColumn("__pn", F.last(at, True).over(back)).withColumn("__pv", F.last(value, True).over(back))
    n = n.withColumn("__nn", F.first(at, True).over(ahead)).withColumn("__nv", F.first(value, True).over(ahead))
    line = F.col("__pv") + (F.col("__nv") - F.col("__pv")) * (F.col("__n") - F.col("__pn")) / (F.col("__nn") - F.col("__pn"))
    filled = F.when(c(value).isNotNull(), c(value)).when(F.col("__n") - F.col("__pn") <= limit, F.when(F.col("__nv").isNull(), F.col("__pv")).otherwise(line))
    return n.withColumn(out, filled).drop("__n", "__pn", "__pv", "__nn", "__nv")


def halfway_day(df: DataFrame, keys: list[str], value: str, date: str = "date", least_rows: int = 100, cover: float = 0.6, limit: int = 20) -> DataFrame:
    """(keys, year, doy): first day that a daily series is under the middle of its spring peak and the low that follows."""
    y = df.withColumn("year", F.year(date)).where(F.date_format(date, "MMdd").between("0201", "1031"))
    k = [*keys, "year"]
    per = W.Window.partitionBy(*k)
    y = y.withColumn("__n", F.count("*").over(per)).withColumn("__c", F.count(value).over(per)).where((F.col("__n") >= least_rows) & (F.col("__c") >= F.lit(cover) * F.col("__n")))
    y = interpolated(y, k, value, date, limit, "__v")
    spring = F.date_format(date, "MMdd") <= "0715"
    y = y.withColumn("__top", F.max(F.when(spring, F.struct(F.col("__v").alias("v"), (-F.dayofyear(date)).alias("o")))).over(per)).where(F.dayofyear(date) >= -F.col("__top.o"))
    y = y.withColumn("__low", F.min("__v").over(per)).where(F.col("__top.v") > F.col("__low"))
    below = y.where(F.col("__v") < (F.col("__top.v") + F.col("__low")) / 2)
    return below.groupBy(*k).agg(F.min(F.dayofyear(date)).alias("doy"))


def drydown_day(df: DataFrame, keys: list[str], threshold: float, value: str = "lfmc", date: str = "date", least: int = 4, gap_days: int = 45) -> DataFrame:
    """(keys, year, doy): when samples first cross below a threshold after the spring high, linear in time; none over a long gap."""
    y = df.withColumn("year", F.year(date)).withColumn("__t", F.date_diff(c(date), F.lit("1970-01-01").cast("date")))
    k = [*keys, "year"]
    per = W.Window.partitionBy(*k)
    month = F.month(date)
    y = y.withColumn("__n", F.sum(F.when(month.between(4, 9), 1).otherwise(0)).over(per)).where(F.col("__n") >= least)
    y = y.withColumn("__top", F.max(F.when(month.between(3, 7), F.struct(c(value).alias("v"), (-F.col("__t")).alias("o")))).over(per))
    y = y.where((F.col("__t") >= -F.col("__top.o")) & (F.col("__top.v") >= threshold))
    order = per.orderBy("__t")
    y = y.withColumn("__pv", F.lag(value).over(order)).withColumn("__pt", F.lag("__t").over(order)).where((c(value) < threshold) & F.col("__pv").isNotNull())
    first = y.groupBy(*k).agg(F.min_by(F.struct("__t", "__pt", "__pv", c(value).alias("v")), F.col("__t")).alias("f")).where(F.col("f.__t") - F.col("f.__pt") <= gap_days)
    share = (F.col("f.__pv") - threshold) / (F.col("f.__pv") - F.col("f.v"))
    day = F.floor(F.col("f.__pt") + (F.col("f.__t") - F.col("f.__pt")) * share).cast("int")
    return first.select(*k, F.dayofyear(F.date_from_unix_date(day)).alias("doy"))


def display_series(df: DataFrame, keys: list[str], value: str, date: str = "date", half: int = 4, least: int = 2) -> DataFrame:
    """Adds ``shown``, the centred median of 2 * half + 1 days (NULL with fewer than ``least``), and its 2-98 % range."""
    days = densified(df.groupBy(*keys, date).agg(F.percentile(c(value), F.lit(0.5)).alias(value)), keys, value, date)
    w = W.Window.partitionBy(*keys).orderBy(date).rowsBetween(-half, half)
    per = W.Window.partitionBy(*keys)
    days = days.withColumn("shown", F.when(F.count(value).over(w) >= least, F.percentile(c(value), F.lit(0.5)).over(w)))
    return days.withColumn("low", F.percentile("shown", F.lit(0.02)).over(per)).withColumn("high", F.percentile("shown", F.lit(0.98)).over(per))


def islands(df: DataFrame, keys: list[str], date: str = "date", gap_days: int = 4, out: str = "piece") -> DataFrame:
    """Adds the number of the piece of a line that breaks at gaps of so many days."""
    w = W.Window.partitionBy(*keys).orderBy(date)
    broken = F.when(F.date_diff(c(date), F.lag(date).over(w)) >= gap_days, 1).otherwise(0)
    return df.withColumn("__b", broken).withColumn(out, F.sum("__b").over(w)).drop("__b")


def departures(df: DataFrame, unit: str, values: list[str]) -> DataFrame:
    """Each value less its unit's mean."""
    w = W.Window.partitionBy(unit)
    return df.withColumns({v: c(v) - F.avg(v).over(w) for v in values})


def recent_change(df: DataFrame, keys: list[str], value: str, date: str = "date", last: int = 7, first: int = 14, days: int = 90) -> DataFrame:
    """(keys, change): median of the last records less that of the first records of so many days up to the last one."""
    per = W.Window.partitionBy(*keys)
    r = df.withColumn("__in", F.date_diff(F.max(date).over(per), c(date)) < days).withColumn("__down", F.row_number().over(per.orderBy(F.desc(date))))
    r = r.withColumn("__up", F.sum(F.when(F.col("__in"), 1).otherwise(0)).over(per.orderBy(date).rowsBetween(W.Window.unboundedPreceding, 0)))
    half = lambda ok: F.percentile(F.when(ok, c(value)), F.lit(0.5))
    return r.groupBy(*keys).agg((half(F.col("__down") <= last) - half(F.col("__in") & (F.col("__up") <= first))).alias("change"))
