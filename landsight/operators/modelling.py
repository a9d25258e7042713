"""Skill of predictors: leave-one-year-out ridge regression, metrics, pooled tests."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions.base import c, ratio
from ..storage import stored
from .siting import binomial_tail

SEASON = ["doy_s1", "doy_c1", "doy_s2", "doy_c2"]
# Fixed value: the penalties that are tried.
ALPHAS = np.logspace(-2, 3, 20)
#: Rows of a group that a task scores together.
TOGETHER = 1 << 16


def ridge_loo(x: np.ndarray, y: np.ndarray, alphas: np.ndarray = ALPHAS) -> tuple[np.ndarray, float, float]:
    """Coefficients, intercept and penalty of the ridge regression of least leave-one-out error; the intercept is free.

    All penalties share one eigendecomposition; the left-out residual is e / (1 - h) with the intercept's 1/n in h.
    """
    n, mx, my = len(y), x.mean(0), y.mean()
    xc, yc = x - mx, y - my
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    uy, best = u.T @ yc, None
    for a in alphas:
        f = s**2 / (s**2 + a)
        e = yc - u @ (f * uy)
        loo = e / (1 - (u**2) @ f - 1 / n)
        score = float((loo**2).mean())
        if best is None or score < best[0]:
            best = (score, a)
    a = best[1]
    coef = vt.T @ (s / (s**2 + a) * uy)
    return coef, float(my - mx @ coef), float(a)


class Moments:
    """Counts, means and co-moments of a group's rows by year and site, and the ridge regressions of its held-out years.

    Variables: the season's terms, the predictors, the target. A site's row of a design is a linear function of a few
    numbers (one, the season's terms, the predictors), so what a fit, its predictions and its left-out residuals need of
    the rows is small, however many they are.
    """

    def __init__(self, cells: pd.DataFrame, season_per_site: bool, least: int) -> None:
        wide = lambda x: np.array([*cells[x]], float).reshape(len(cells), -1)
        self.n, self.mean, self.lo, self.hi = cells["__n"].to_numpy(float), wide("__mean"), wide("__lo"), wide("__hi")
        k = self.mean.shape[1]
        i, j = np.triu_indices(k)
        self.co = np.zeros((len(cells), k, k))
        self.co[:, i, j] = self.co[:, j, i] = wide("__co")
        self.year, self.site = cells["__year"].to_numpy(object), cells["__site"].to_numpy(object)
        self.sites = sorted({s for s in self.site if s is not None})
        self.per_site, self.least, self.feats = season_per_site, least, k - len(SEASON) - 1

    def held(self) -> list[str]:
        """The years that have enough rows outside."""
        return [y for y in sorted({y for y in self.year if y is not None}) if self.n[self.year != y].sum() >= self.least]

    def fit(self, held: str, with_feats: bool) -> Ridge:
        keep, last = self.year != held, len(SEASON)
        used = [*range(last + self.feats * with_feats), self.mean.shape[1] - 1]
        n, mean, co = self.n[keep], self.mean[keep][:, used], self.co[keep][:, used][:, :, used]
        total, feats = n.sum(), len(used) - last - 1
        middle, scale = n @ mean / total, np.ones(len(used))
        own = slice(last, last + feats)
        lo, hi = self.lo[keep, :feats].min(0), self.hi[keep, :feats].max(0)
        middle[:last] = 0
        off = mean - middle
        spread = np.sqrt(n @ (np.einsum("cii->ci", co) + off**2) / total)
        scale[own] = np.where((lo == hi) | (spread[own] == 0), 1, spread[own])
        off, co = off / scale, co / scale[:, None] / scale
        # Sums of products of one and the variables, by row of cells.
        sums = np.empty((len(n), len(used) + 1, len(used) + 1))
        sums[:, 0, 0], sums[:, 0, 1:], sums[:, 1:, 0] = n, n[:, None] * off, n[:, None] * off
        sums[:, 1:, 1:] = n[:, None, None] * (co + off[:, :, None] * off[:, None])
        size = feats + len(self.sites) * (1 + last) if self.per_site else feats + len(self.sites) + last
        gram, to_target, first = np.zeros((size, size)), np.zeros(size), np.zeros(size)
        for s in {*self.site[keep]}:
            w, (rows, cols) = sums[self.site[keep] == s].sum(0), self._columns(s, feats)
            gram[np.ix_(rows, rows)] += w[:-1, :-1][np.ix_(cols, cols)]
            to_target[rows] += w[cols, -1]
            first[rows] += w[cols, 0]
        first /= total
        values, vectors = np.linalg.eigh(gram - total * np.outer(first, first))
        return Ridge(self, feats, total, middle[own], scale[own], lo, hi, middle[-1], first, np.maximum(values, 0), vectors, vectors.T @ to_target)

    def _columns(self, site: str | None, feats: int) -> tuple[list[int], list[int]]:
        """Which columns of the design a site's row fills, and with which of its numbers."""
        last = len(SEASON)
        rows, cols = [*range(feats)], [*range(1 + last, 1 + last + feats)]
        if site is not None:
            k = self.sites.index(site)
            rows, cols = (rows + [feats + k * (1 + last) + r for r in range(1 + last)], cols + [*range(1 + last)]) if self.per_site else ([*rows, feats + k], [*cols, 0])
        return (rows, cols) if self.per_site else (rows + [feats + len(self.sites) + r for r in range(last)], cols + [*range(1, 1 + last)])


@dataclass
class Ridge:
    """The ridge regressions of all penalties for a held-out year, in the eigenvectors of the centred design."""

    moments: Moments
    feats: int
    n: float
    middle: np.ndarray
    scale: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    target: float
    first: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    to_target: np.ndarray

    def of_site(self, site: str | None) -> np.ndarray:
        """A site's numbers to the eigenvectors' coordinates."""
        rows, cols = self.moments._columns(site, self.feats)
        to = np.zeros((len(self.first), 1 + len(SEASON) + self.feats))
        to[rows, cols] = 1
        to[:, 0] -= self.first
        return self.vectors.T @ to

    def weights(self, site: str | None, alphas: np.ndarray = ALPHAS) -> np.ndarray:
        """What a site's numbers are multiplied by to predict how far the target is from its mean, a row for each penalty."""
        return (self.to_target / (self.values + alphas[:, None])) @ self.of_site(site)

    def errors(self, site: str | None, x: np.ndarray, alphas: np.ndarray = ALPHAS) -> np.ndarray:
        """Sums of squared left-out residuals of a site's training rows for each penalty. x: season, predictors, target."""
        last = len(SEASON)
        z = np.hstack([np.ones((len(x), 1)), x[:, :last], (x[:, last : last + self.feats] - self.middle) / self.scale])
        to = self.of_site(site)
        i, j = np.triu_indices(z.shape[1])
        square = np.einsum("pi,ap,pj->aij", to, 1 / (self.values + alphas[:, None]), to, optimize=True)
        hat = (z[:, i] * z[:, j]) @ (square[:, i, j] * np.where(i == j, 1, 2)).T
        e = x[:, -1:] - self.target - z @ self.weights(site, alphas).T
        return ((e / (1 - hat - 1 / self.n)) ** 2).sum(0)


def dealt(rows: DataFrame, cells: DataFrame, group: list[str], together: int) -> tuple[DataFrame, DataFrame]:
    """rows and cells by group and ``__chunk``: a group's rows in chunks of about ``together``, each with all cells of the group."""
    chunks = cells.groupBy(*group).agg(F.ceil(F.sum("__n") / together).cast("int").alias("__chunks"))
    some = rows.withColumn("__at", F.monotonically_increasing_id()).join(chunks, group).withColumn("__chunk", F.pmod(F.xxhash64("__at"), "__chunks").cast("int"))
    return some.drop("__at", "__chunks"), cells.join(chunks, group).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1))).drop("__chunks")


def loyo(df: DataFrame, feats: list[str], group: list[str], site: str = "site", year: str = "year", target: str = "lfmc", least: int = 30, season_per_site: bool = True, together: int = TOGETHER) -> DataFrame:
    """df's complete rows with ``pred`` and ``clim``, each year predicted from a group's other years.

    The regressions come from the moments of a group's years and sites, and their penalties from the left-out residuals of
    all rows, which are scored in chunks of about ``together``; so no task holds a group (a camera), whose samples may be
    millions. What is held of a group at once is a row for each of its years and sites. Years with fewer than ``least``
    training rows have no predictions and are left out.
    """
    feats = [f for f in feats if not (season_per_site and f in SEASON)]
    rows = df.dropna(subset=[*feats, target, *SEASON])
    named = [F.col(f"`{g}`") for g in group]
    values = [F.col(f"`{x}`").cast("double") for x in [*SEASON, *feats, target]]
    place = [F.col(f"`{year}`").cast("string").alias("__year"), F.col(f"`{site}`").cast("string").alias("__site")]
    slim = rows.select(*named, *place, *(v.alias(f"__v{k}") for k, v in enumerate(values)))
    v = [f"__v{k}" for k in range(len(values))]
    own = v[len(SEASON) : -1]
    doubles = lambda x: F.array(*x).cast("array<double>")
    cells = slim.groupBy(*named, "__year", "__site").agg(
        F.count("*").alias("__n"), doubles(F.avg(x) for x in v).alias("__mean"), doubles(F.covar_pop(x, y) for k, x in enumerate(v) for y in v[k:]).alias("__co"),
        doubles(F.min(x) for x in own).alias("__lo"), doubles(F.max(x) for x in own).alias("__hi"))
    cells = cells.select(*(F.col(f"`{x}`").alias(x) for x in cells.columns))  # else its keys are those of the rows, which it meets again
    keys = [rows.schema[g] for g in group]

    def scored(key: tuple, pdf: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out, moments = [], Moments(cells, season_per_site, least)
        x, years = pdf[v].to_numpy(float), pdf["__year"].to_numpy(object)
        at = pdf.groupby(pdf["__site"].to_numpy(object), dropna=False).indices
        for held in moments.held() if len(pdf) else []:
            sums = []
            for fit in (moments.fit(held, True), moments.fit(held, False)):
                each = [fit.errors(None if pd.isna(s) else s, x[k[years[k] != held]]) for s, k in at.items()]
                sums.append(np.sum(each, 0))
            out.append((*key[: len(group)], held, *sums))
        return pd.DataFrame(out, columns=[*group, "__year", "__pred", "__clim"])

    def chosen(key: tuple, scores: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out, moments = [], Moments(cells, season_per_site, least)
        for held, mine in scores.groupby("__year"):
            parts = []
            for name, fit in (("__pred", moments.fit(held, True)), ("__clim", moments.fit(held, False))):
                best = int(np.argmin([math.fsum(a) for a in zip(*mine[name])]))
                parts.append((fit, ALPHAS[best : best + 1]))
            for s in moments.site[moments.year == held]:
                pred, clim = (fit.weights(s, alpha)[0] for fit, alpha in parts)
                fit, last = parts[0][0], len(SEASON)
                out.append((*key, held, s, fit.target, pred[: 1 + last], pred[1 + last :] / fit.scale, fit.middle, fit.lo, fit.hi, clim))
        return pd.DataFrame(out, columns=[*group, "__year", "__site", "__free", "__base", "__w", "__middle", "__low", "__high", "__season"])

    chunks, sent = dealt(slim, cells, group, together)
    schema = T.StructType([*keys, T.StructField("__year", T.StringType()), *(T.StructField(x, T.ArrayType(T.DoubleType())) for x in ("__pred", "__clim"))])
    scores = chunks.groupBy(*named, "__chunk").cogroup(sent.groupBy(*named, "__chunk")).applyInPandas(scored, schema)
    schema = T.StructType([*keys, T.StructField("__year", T.StringType()), T.StructField("__site", T.StringType()), T.StructField("__free", T.DoubleType()),
                           *(T.StructField(x, T.ArrayType(T.DoubleType())) for x in ("__base", "__w", "__middle", "__low", "__high", "__season"))])
    fits = scores.groupBy(*named).cogroup(cells.groupBy(*named)).applyInPandas(chosen, schema)
    fits = fits.select(*(F.col(f"`{g}`").alias(f"__g{k}") for k, g in enumerate(group)), *(x for x in fits.columns if x not in group))

    def season(w: str) -> Column:
        return reduce(lambda s, k: s + F.get(w, F.lit(k + 1)) * values[k], range(len(SEASON)), F.col("__free") + F.get(w, F.lit(0)))

    def with_predictors(s: Column, k: int) -> Column:
        at = lambda x: F.get(x, F.lit(k))
        return s + at("__w") * (F.least(F.greatest(values[len(SEASON) + k], at("__low")), at("__high")) - at("__middle"))

    same = [F.col(f"`{g}`") == F.col(f"__g{k}") for k, g in enumerate(group)]
    met = rows.join(fits, reduce(Column.__and__, [*same, place[0] == F.col("__year"), place[1].eqNullSafe(F.col("__site"))]))
    return met.select(*(F.col(f"`{x}`") for x in rows.columns), reduce(with_predictors, range(len(feats)), season("__base")).alias("pred"), season("__season").alias("clim"))


def metrics(pred: DataFrame, group: list[str], target: str = "lfmc", year: str = "year", critical: float = 80.0) -> DataFrame:
    """n, years, rmse, mae, r2, anomaly_r, below80 and years_beat_season of each group's predictions."""
    t, p, q = c(target), F.col("pred"), F.col("clim")
    per = pred.groupBy(*group, year).agg(F.avg((p - t) * (p - t)).alias("m"), F.avg((q - t) * (q - t)).alias("mc"))
    beat = per.groupBy(*group).agg(F.sum(F.when(F.col("m") < F.col("mc") - 1e-9, 1).otherwise(0)).alias("years_beat_season"))
    sse, agree = F.sum((p - t) * (p - t)), (p < critical) == (t < critical)
    flat = (F.stddev_pop(p - q) <= 1e-9) | (F.stddev_pop(t - q) <= 1e-9)
    main = pred.groupBy(*group).agg(
        F.count("*").alias("n"), F.count_distinct(year).alias("years"), F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"), F.avg(F.abs(p - t)).alias("mae"),
        (1 - ratio(sse, F.var_pop(t) * F.count("*"))).alias("r2"), F.when(flat, F.lit(0.0)).otherwise(ratio(F.covar_pop(t - q, p - q), F.stddev_pop(t - q) * F.stddev_pop(p - q))).alias("anomaly_r"),
        F.avg(agree.cast("double")).alias("below80"))
    return main.join(beat, group) if group else main.crossJoin(beat)


def mean_ranks(values: DataFrame, x: str) -> DataFrame:
    """(x, rank): of each value the mean rank of its rows. Values are dealt in ranges, so no task sorts them all."""
    n = values.groupBy(x).agg(F.count("*").alias("__eq"))
    ranges = stored(n.repartitionByRange(F.col(x)).withColumn("__part", F.spark_partition_id()), "ranges")
    before = lambda w: F.coalesce(F.sum("__eq").over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranges.groupBy("__part").agg(F.sum("__eq").alias("__eq"))
    parts = parts.select("__part", before(W.Window.orderBy("__part")).alias("__first"))  # a row a range
    own = ranges.withColumn("__lt", before(W.Window.partitionBy("__part").orderBy(x))).join(parts, "__part")
    return own.select(x, (F.col("__first") + F.col("__lt") + (F.col("__eq") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str, least: int = 6) -> DataFrame:
    """(n, rho): rank correlation with mean ranks on ties; NULL with fewer than ``least`` rows.

    The values are stored first: means worked out twice may differ in their last bits, and then would not meet their ranks.
    """
    def rank(x: str) -> Column:
        return F.col(f"__rank_{x}")

    out = stored(df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna(), "pairs")
    for x in ("a", "b"):
        out = out.join(mean_ranks(out.select(x), x).withColumnRenamed("rank", f"__rank_{x}"), x)
    return out.agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.corr(rank("a"), rank("b"))).alias("rho"))


def skill(df: DataFrame, group: list[str], error: str, base: str, least: int = 15) -> DataFrame:
    """(group, n, skill): one less the ratio of root mean square errors, of groups with enough rows. error, base: errors."""
    rms = lambda x: F.sqrt(F.avg(c(x) * c(x)))
    return df.groupBy(*group).agg(F.count("*").alias("n"), (1 - ratio(rms(error), rms(base))).alias("skill")).where(F.col("n") >= least)


def sign_test(df: DataFrame, better: Column) -> DataFrame:
    """(wins, n, p): how many rows are better, and the one-sided chance of that at even odds."""
    s = df.agg(F.sum(F.when(better, 1).otherwise(0)).cast("int").alias("wins"), F.count("*").cast("int").alias("n"))
    return s.withColumn("p", F.when(F.col("n") > 0, binomial_tail(F.col("wins"), F.col("n"))).otherwise(F.lit(1.0)))


def compare(df: DataFrame, sets: dict[str, list[str]], group: list[str], **how: object) -> DataFrame:
    """Metrics of several predictor sets on the rows that have all of their predictors. Adds ``set``."""
    every = sorted({f for s in sets.values() for f in s} | set(SEASON))
    rows = df.dropna(subset=every)
    parts = [metrics(loyo(rows, f, group, **how), group).withColumn("set", F.lit(name)) for name, f in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The predictor sets of the study; the season's terms come with every set.
STUDY_SETS = {
    "season": [], "camera_auto": ["auto_g", "auto_d"], "camera_auto_wb": ["autowb_g", "autowb_d"], "sat_visible_view": ["sv_gcc", "sv_gcc_d"],
    "sat_ir_view": ["sv_ndvi", "sv_ndii", "sv_ndvi_d", "sv_ndii_d"], "sat_ir_site": ["ss_ndvi", "ss_ndii", "ss_ndvi_d", "ss_ndii_d"],
    "camera_plus_sat_ir": ["auto_g", "auto_d", "sv_ndvi", "sv_ndii", "sv_ndvi_d", "sv_ndii_d"],
}
HAND, NIR, NIR_HAND = ["hand_g", "hand_d"], ["nir_g", "nir_d"], ["nirh_g", "nirh_d"]
#: Comparisons: the sets that are scored on common rows, and of what column a camera needs how many values.
COMPARISONS = {
    "main": (STUDY_SETS, None, 0),
    "hand": ({"season": [], "camera_auto": STUDY_SETS["camera_auto"], "camera_hand": HAND}, "hand_g", 1),
    "nir": ({"season": [], "camera_auto_wb": STUDY_SETS["camera_auto_wb"], "camera_ndvi": NIR, "sat_ir_view": STUDY_SETS["sat_ir_view"], "sat_ir_site": STUDY_SETS["sat_ir_site"],
             "camera_ndvi_plus_rgb": [*NIR, *STUDY_SETS["camera_auto_wb"]]}, "nir_g", 30),
    "nir_hand": ({"season": [], "camera_ndvi": NIR, "camera_ndvi_hand": NIR_HAND}, "nirh_g", 30),
    "camera_only": ({"season": [], "camera_auto": STUDY_SETS["camera_auto"]}, None, 0),
}


def study(df: DataFrame, group: list[str], comparisons: dict[str, tuple[dict[str, list[str]], str | None, int]] = COMPARISONS, **how: object) -> DataFrame:
    """(comparison, set, group, metrics) of all comparisons. Columns that df lacks are NULL, and sets with them score nothing."""
    wanted = {f for sets, _, _ in comparisons.values() for own in sets.values() for f in own}
    rows = df.withColumns({f: F.lit(None).cast("double") for f in sorted(wanted - set(df.columns))})
    parts = []
    for name, (sets, column, least) in comparisons.items():
        own = rows
        if column:
            own = rows.withColumn("__n", F.count(column).over(W.Window.partitionBy(*group))).where(F.col("__n") >= least).drop("__n")
        parts.append(compare(own, sets, group, **how).withColumn("comparison", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def smallest_share(df: DataFrame, keys: list[str], value: str, keep: float = 0.8, out: str = "loss") -> DataFrame:
    """(keys, loss): mean of the smallest share of absolute values, one at least."""
    per = W.Window.partitionBy(*keys)
    r = df.withColumn("__a", F.abs(c(value))).withColumn("__n", F.row_number().over(per.orderBy("__a"))).withColumn("__m", F.count("*").over(per))
    return r.where(F.col("__n") <= F.greatest(F.lit(1), F.floor(F.col("__m") * keep))).groupBy(*keys).agg(F.avg("__a").alias(out))


def slope(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, sd, r): least squares of y on x with the residuals' sample deviation."""
    s = df.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.corr(x, y).alias("r"))
    return s.select("n", "slope", F.sqrt((F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 1)).alias("sd"), "r")
