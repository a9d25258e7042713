"""Camera pose and lens from skylines: a distributed coarse grid, then a bounded coordinate search per camera."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import d
from ..functions.geo import Camera
from ..storage import stored
from .modelling import smallest_share


def residuals(rows: DataFrame, skyline: DataFrame, keys: list[str], az_lo: float, az_step: float, camera: Camera) -> DataFrame:
    """(rows, residual): elevation of each skyline pixel (u, v) less the terrain's skyline at its azimuth.

    skyline: site, az_idx, el; rows: site and the camera's columns. Between azimuths the skyline is linear, beyond its
    ends constant.
    """
    n = skyline.groupBy("site").agg(F.max("az_idx").alias("__n"))
    az, el = camera.direction(F.col("u"), F.col("v"))
    p = rows.withColumn("__el", el).withColumn("__az", az).join(n, "site")
    middle = d(az_lo) + F.col("__n") * d(az_step / 2)
    p = p.withColumn("__x", F.greatest(d(0), F.least(F.col("__n").cast("double"), (F.pmod(F.col("__az") - middle + 180, d(360)) - 180 + middle - d(az_lo)) / d(az_step))))
    p = p.withColumn("__i", F.least(F.floor("__x").cast("int"), F.col("__n") - 1))
    a = skyline.select("site", F.col("az_idx").alias("__i"), F.col("el").alias("__a"))
    b = skyline.select("site", (F.col("az_idx") - 1).alias("__i"), F.col("el").alias("__b"))
    p = p.join(a, ["site", "__i"]).join(b, ["site", "__i"])
    ground = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__x") - F.col("__i"))
    return p.select(*keys, (F.col("__el") - ground).alias("residual"))


def coarse_poses(rows: DataFrame, skyline: DataFrame, poses: DataFrame, az_lo: float, az_step: float, lens: list[tuple[float, float]] | None = None, yaw_half: int = 15, pitch: tuple[int, int] = (-10, 6), keep: float = 0.8) -> DataFrame:
    """(site, hfov, k1, yaw, pitch, loss): the best pose of a grid for each site and lens.

    rows: site, u, v; poses: site, width, height, yaw0, hfov, k1. Every combination is scored as rows of one job.
    """
    grid = poses.withColumn("dy", F.explode(F.sequence(F.lit(-yaw_half), F.lit(yaw_half)))).withColumn("pitch", F.explode(F.sequence(F.lit(pitch[0]), F.lit(pitch[1])))).withColumn("pitch", F.col("pitch").cast("double"))
    if lens:
        pairs = F.explode(F.array(*(F.struct(d(h).alias("h"), d(k).alias("k")) for h, k in lens)))
        grid = grid.withColumn("__l", pairs).withColumn("hfov", F.col("__l.h")).withColumn("k1", F.col("__l.k")).drop("__l")
    grid = grid.withColumn("yaw", F.col("yaw0") + F.col("dy"))
    cam = Camera(*(F.col(x) for x in ("width", "height", "yaw", "pitch")), 0.0, F.col("hfov"), F.col("k1"))
    keys = ["site", "hfov", "k1", "yaw", "pitch"]
    scored = smallest_share(residuals(rows.join(grid, "site"), skyline, keys, az_lo, az_step, cam), keys, "residual", keep)
    best = scored.groupBy("site", "hfov", "k1").agg(F.min(F.struct("loss", "yaw", "pitch")).alias("m"))
    return best.select("site", "hfov", "k1", "m.yaw", "m.pitch", "m.loss")


def direction(p: np.ndarray, width: float, height: float, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Azimuth and elevation of pixels for (yaw, pitch, roll, hfov, k1), as ``functions.geo.Camera.direction``."""
    yaw, pitch, roll, hfov, k1 = p
    f = width / 2 / np.radians(hfov / 2)
    x, y = u - width / 2, height / 2 - v
    r = np.hypot(x, y) / f
    theta, turn = r * (1 + k1 * r * r), np.arctan2(y, x) + np.radians(roll)
    right, up, ahead, t = np.sin(theta) * np.cos(turn), np.sin(theta) * np.sin(turn), np.cos(theta), np.radians(pitch)
    north, z = ahead * np.cos(t) - up * np.sin(t), ahead * np.sin(t) + up * np.cos(t)
    return (np.degrees(np.arctan2(right, north)) + yaw) % 360, np.degrees(np.arctan2(z, np.hypot(right, north)))


def trimmed(r: np.ndarray, keep: float = 0.8) -> float:
    a = np.sort(np.abs(r))
    return float(a[: max(1, int(len(a) * keep))].mean()) if len(a) else 0.0


def pattern_search(loss: object, x: np.ndarray, low: np.ndarray, high: np.ndarray, step: np.ndarray, least: float = 1e-4) -> tuple[np.ndarray, float]:
    """Bounded minimum by coordinate steps that double on success and halve on failure, with moves along the last gain."""
    x, best = np.clip(x, low, high), loss(np.clip(x, low, high))
    while step.max() > least:
        start, moved = x.copy(), False
        for k in range(len(x)):
            for sign in (1, -1):
                t = x.copy()
                t[k] = np.clip(t[k] + sign * step[k], low[k], high[k])
                if (v := loss(t)) < best:
                    x, best, moved = t, v, True
                    break
        t = np.clip(2 * x - start, low, high)
        if moved and (v := loss(t)) < best:
            x, best = t, v
        if not moved:
            step = step / 2
    return x, best


def fitted_poses(rows: DataFrame, skyline: DataFrame, starts: DataFrame, az_lo: float, az_step: float) -> DataFrame:
    """(site, yaw, pitch, roll, hfov, k1, loss): pose of each site refined from its start with the lens held.

    One task per site, with its skyline pixels and its panorama's skyline: thousands of rows.
    """
    sky = skyline.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("az_idx", "el"))).alias("s"))
    px = rows.groupBy("site").agg(F.collect_list(F.struct(F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))).alias("p"))
    both = starts.join(px, "site").join(sky, "site")

    def fit(parts: object) -> object:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                u, v = (np.array([q[k] for q in r.p]) for k in ("u", "v"))
                el = np.array([q["el"] for q in r.s])
                az = az_lo + az_step * np.arange(len(el))
                mid = (az[0] + az[-1]) / 2

                def loss(p: np.ndarray) -> float:
                    a, e = direction((*p, r.hfov, r.k1), r.width, r.height, u, v)
                    return trimmed(e - np.interp((a - mid + 180) % 360 - 180 + mid, az, el))

                x0 = np.array([r.yaw, r.pitch, 0.0])
                x, best = pattern_search(loss, x0, np.array([r.yaw - 20, -15.0, -6.0]), np.array([r.yaw + 20, 10.0, 6.0]), np.array([0.5, 0.5, 0.5]))
                out.append((r.site, *map(float, x), r.hfov, r.k1, best))
            yield pd.DataFrame(out, columns=["site", "yaw", "pitch", "roll", "hfov", "k1", "loss"])

    kind = starts.schema["site"].dataType.simpleString()
    return both.mapInPandas(fit, f"site {kind}, yaw double, pitch double, roll double, hfov double, k1 double, loss double")


def shared_lens(rows: DataFrame, skyline: DataFrame, poses: DataFrame, az_lo: float, az_step: float, hfovs: list[float], k1s: list[float], refine: int = 0, limits: tuple = ((85.0, 125.0), (-0.1, 0.25))) -> DataFrame:
    """Poses of all sites under the one lens of least total loss: the best of a grid, then ``refine`` rounds around it.

    Every site and lens is a row of one job. A refining round tries the lenses a step away each way, goes to the best, and
    halves its steps, half the grid's at first, when none is better. ``limits`` of both hold for the lenses that it tries.
    """
    lenses = [(h, k) for h in hfovs for k in k1s]
    best = coarse_poses(rows, skyline, poses, az_lo, az_step, lenses)
    sizes = poses.select("site", "width", "height")

    def under(starts: DataFrame) -> tuple[DataFrame, tuple[float, float, float]]:
        """Fitted poses and (total loss, hfov, k1) of the best lens among the starts'."""
        fitted = stored(fitted_poses(rows, skyline, starts.join(sizes, "site"), az_lo, az_step), "poses")
        total = fitted.groupBy("hfov", "k1").agg(F.round(F.sum("loss"), 9).alias("total"))
        return fitted, tuple(total.agg(F.min(F.struct("total", "hfov", "k1")).alias("m")).select("m.*").first())

    fitted, top = under(best)
    gaps = [[b - a for a, b in zip(x, x[1:])] for x in (sorted(hfovs), sorted(k1s))]
    step = [min(g, default=d0) / 2 for g, d0 in zip(gaps, (2.0, 0.04))]
    own = lambda frame, lens: frame.where((F.col("hfov") == lens[1]) & (F.col("k1") == lens[2]))
    chosen = own(fitted, top)
    for _ in range(refine):
        around = [(top[1] + i * step[0], top[2] + j * step[1]) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]
        around = [lens for lens in around if lens == tuple(top[1:]) or all(low <= x <= high for x, (low, high) in zip(lens, limits))]
        pairs = F.explode(F.array(*(F.struct(d(h).alias("h"), d(k).alias("k")) for h, k in around)))
        starts = chosen.select("site", "yaw", "pitch", "loss").withColumn("__l", pairs).select("site", "yaw", "pitch", "loss", F.col("__l.h").alias("hfov"), F.col("__l.k").alias("k1"))
        fitted, found = under(starts)
        if found[1:] == top[1:]:
            step = [x / 2 for x in step]
        top = found
        chosen = own(fitted, top)
    return chosen
