"""Block means, white balance, and the choice of vegetation and reference blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import c, ratio
from ..functions.colour import balanced
from .timeseries import drift


def block_means(px: DataFrame, keys: list[str], values: list[str], block: int = 24, cover: float = 0.9, height: int | None = None, width: int | None = None) -> DataFrame:
    """(keys, br, bc, values, n, valid): means over covered pixels; valid with enough of them. Ragged edges are dropped.

    px: keys, y, x, values, covered.
    """
    for side, size in (("y", height), ("x", width)):
        px = px.where(c(side) < size // block * block) if size else px
    at = [F.floor(F.col("y") / block).cast("int").alias("br"), F.floor(F.col("x") / block).cast("int").alias("bc")]
    on = lambda v: F.when(F.col("covered"), c(v))
    n = F.sum(F.when(F.col("covered"), 1).otherwise(0))
    return px.groupBy(*keys, *at).agg(*(F.avg(on(v)).alias(v) for v in values), n.alias("n"), (n > cover * block * block).alias("valid"))


def block_fractions(px: DataFrame, keys: list[str], block: int = 24) -> DataFrame:
    """(keys, br, bc, veg_frac, bad_frac): shares of vegetation and of what is no ground in the blocks of labelled pixels.

    px: keys, y, x, veg, bad (booleans, of a view's anchor frame).
    """
    at = [F.floor(F.col("y") / block).cast("int").alias("br"), F.floor(F.col("x") / block).cast("int").alias("bc")]
    return px.groupBy(*keys, *at).agg(*(F.avg(F.col(n).cast("double")).alias(f"{n}_frac") for n in ("veg", "bad")))


def white_balanced(blocks: DataFrame, ref: DataFrame, keys: list[str], frame: str = "frame", ts: str = "ts", days: int = 61) -> DataFrame:
    """Blocks with lasting colour casts taken off red and blue.

    The cast of a frame is the median log ratio of red and of blue to green over the valid reference blocks; what is
    taken off is its trailing median less the view's own median. ref: keys, br, bc.
    """
    logs = [F.ln(ratio(c(v), F.col("g"))).alias(f"l{v}") for v in ("r", "b")]
    casts = blocks.where("valid").join(ref, [*keys, "br", "bc"], "left_semi").select(*keys, frame, ts, *logs)
    casts = casts.groupBy(*keys, frame, ts).agg(*(F.percentile(f"l{v}", F.lit(0.5)).alias(f"l{v}") for v in ("r", "b")))
    casts = drift(casts, keys, ["lr", "lb"], ts, days).select(*keys, frame, "lr_drift", "lb_drift")
    out = blocks.join(casts, [*keys, frame], "left")
    red, blue = balanced("r", "b", F.coalesce("lr_drift", F.lit(0.0)), F.coalesce("lb_drift", F.lit(0.0)))
    return out.withColumn("r", red).withColumn("b", blue).drop("lr_drift", "lb_drift")


def choose_regions(stats: DataFrame, keys: list[str], rows: int, lower: float = 0.45, cover: float = 0.85, q: float = 0.5) -> DataFrame:
    """Adds veg and ref flags to blocks. stats: keys, br, bc, amp, cover, veg_frac, bad_frac.

    Candidates are well covered, mostly vegetation and low in the frame; with fewer than ten of them the filter is
    relaxed. Vegetation swings as much as the candidates' quantile; references are the steadiest other ground, or all
    of it if they are fewer than five.
    """
    from pyspark.sql import window as W

    per = W.Window.partitionBy(*keys)
    covered = F.col("cover") > cover
    strict = covered & (F.col("veg_frac") > 0.6) & (F.col("bad_frac") < 0.2) & (F.col("br") >= rows * lower)
    loose = covered & (F.col("bad_frac") < 0.4) & (F.col("br") >= rows * 0.3)
    s = stats.withColumn("__few", F.sum(F.when(strict, 1).otherwise(0)).over(per) < 10)
    s = s.withColumn("__cand", F.when(F.col("__few"), loose).otherwise(strict))
    s = s.withColumn("__cut", F.coalesce(F.percentile(F.when(F.col("__cand"), F.col("amp")), F.lit(q)).over(per), F.lit(0.0)))
    s = s.withColumn("veg", F.coalesce(F.col("__cand") & (F.col("amp") >= F.col("__cut")), F.lit(False)))
    s = s.withColumn("__low", F.percentile(F.when(covered, F.col("amp")), F.lit(0.3)).over(per))
    s = s.withColumn("__ground", covered & (F.col("br") >= rows * 0.3) & ~F.col("veg"))
    s = s.withColumn("ref", F.coalesce(F.col("__ground") & (F.col("amp") <= F.col("__low")), F.lit(False)))
    s = s.withColumn("ref", F.when(F.sum(F.when(F.col("ref"), 1).otherwise(0)).over(per) < 5, F.col("__ground")).otherwise(F.col("ref")))
    return s.drop("__few", "__cand", "__cut", "__low", "__ground")
