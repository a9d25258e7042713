"""From a camera's photos to block colours in comparable views: screen, track, link, choose views, warp, measure.

Every step is a table. Pictures are decoded twice, to look at them and to measure them; between, only their features travel,
and at the end a view's frames meet its anchor picture in bounded groups. Cameras most of whose frames fit no view are
measured in place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.base import micros
from ..functions.frames import clarity, usable_frame
from ..operators import images, registration
from ..storage import stored

WIDTH, HEIGHT, BLOCK = 768, 576, 24
#: Frames that are measured together against their view's anchor.
FRAMES_TOGETHER = 32
Features = Callable[[np.ndarray], "tuple[np.ndarray, np.ndarray]"]
_SCREEN = ["mean", "lap", "std", "sat", "sky_sat", "ground_sat"]


def looked(files: DataFrame, features: Features, width: int, height: int, **screen: float) -> DataFrame:
    """(cam, ts, ok, clarity, points, descriptors) of each photo; features of usable ones only. files: cam, ts, content."""
    kind = files.schema["ts"].dataType.simpleString()

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for cam, ts, content in pdf[["cam", "ts", "content"]].itertuples(index=False):
                img = images.decode(content)
                if img is None:
                    out.append((cam, ts, *[None] * (len(_SCREEN) + 2)))
                    continue
                small = images.resized(img, width, height)
                points, descriptors = features(small)
                out.append((cam, ts, *images.screened(small).values(), points.tolist(), descriptors.tolist()))
            yield pd.DataFrame(out, columns=["cam", "ts", *_SCREEN, "points", "descriptors"]).astype(dict.fromkeys(_SCREEN, float))

    seen = files.select("cam", "ts", "content").mapInPandas(rows, f"cam string, ts {kind}, {', '.join(n + ' double' for n in _SCREEN)}, points array<array<double>>, descriptors array<array<double>>")
    ok = F.coalesce(usable_frame("mean", "lap", "std", "sat", **screen), F.lit(False)) & ~F.isnan(F.coalesce("mean", F.lit(float("nan"))))
    picked = [F.when(ok, F.col(n)).alias(n) for n in ("points", "descriptors")]
    return seen.select("cam", "ts", ok.alias("ok"), F.when(ok, clarity("lap", "sky_sat", "ground_sat")).otherwise(0.0).alias("clarity"), *picked)


def _features_of(row: pd.Series) -> object | None:
    return (np.array([*row["points"]]), np.array([*row["descriptors"]])) if row["ok"] and row["points"] is not None else None


def limits_of(frames: DataFrame) -> DataFrame:
    """(cam, least_size, least_frames, least_days): what segments and views need, less for short archives."""
    n, days = F.count_if("ok"), F.floor((F.max(micros("ts")) - F.min(micros("ts"))) / 86_400_000_000)
    part = lambda x, k, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(x / k))).cast("int")
    return frames.groupBy("cam").agg(part(n, 20, 3, 20).alias("least_size"), part(n, 10, 5, 60).alias("least_frames"), F.least(F.lit(300), F.floor(days / 2)).cast("int").alias("least_days"))


def linked(tracked: DataFrame, frames: DataFrame, limits: DataFrame, match: registration.Match) -> DataFrame:
    """(cam, a, b, inliers, t): segments of a camera by the best match of their representatives. Ten a segment at most."""
    big = tracked.where("seg >= 0").groupBy("cam", "seg").count().join(limits, "cam").where("count >= least_size").select("cam", "seg")
    keys = tracked.where("key").join(frames.select("cam", "ts", "clarity", "points", "descriptors"), ["cam", "ts"]).join(big, ["cam", "seg"], "left_semi")
    few = registration.representatives(keys, ["cam", "seg"], order="ts").select("cam", "seg", "ts", "t", "points", "descriptors")
    one, two = (few.select("cam", *(F.col(c).alias(f"{c}_{n}") for c in ("seg", "ts", "t", "points", "descriptors"))) for n in ("a", "b"))
    pairs = one.join(two, "cam").where("seg_a < seg_b")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                t, n = match(*((np.array([*p]), np.array([*q])) for p, q in ((r.points_a, r.descriptors_a), (r.points_b, r.descriptors_b))))
                if t is not None:
                    from_a, to_b = (np.asarray(x, float).reshape(2, 3) for x in (r.t_a, r.t_b))
                    whole = registration.chained(registration.chained(registration.inverse(from_a), t), to_b)
                    out.append((r.cam, r.seg_a, r.seg_b, n, whole.ravel().tolist(), r.id))
            yield pd.DataFrame(out, columns=["cam", "a", "b", "inliers", "t", "id"])

    numbered = pairs.withColumn("id", F.xxhash64("ts_a", "ts_b"))
    found = numbered.mapInPandas(rows, "cam string, a int, b int, inliers int, t array<double>, id bigint")
    named = found.select(*(F.struct("cam", F.col(x).alias("seg")).alias(x) for x in ("a", "b")), "inliers", "t", "id")
    return registration.best_links(named).select("a.cam", F.col("a.seg").alias("a"), F.col("b.seg").alias("b"), "inliers", "t")


def placed(frames: DataFrame, tracked: DataFrame, views: DataFrame) -> DataFrame:
    """(cam, ts, mode, view, seg, t, anchor): every frame that is measured, its transform to its view, whether it is the view's anchor.

    A view's anchor is the frame that opened its anchor segment; in place it is the clearest usable frame.
    """
    whole = registration.to_view(tracked, views).join(frames.select("cam", "ts", "ok", "clarity"), ["cam", "ts"])
    whole = whole.join(registration.measuring_mode(whole), "cam").join(views.select("cam", "seg", F.col("anchor").alias("__seg")), ["cam", "seg"], "left")
    opens = (F.col("seg") == F.col("__seg")) & F.col("key") & (F.col("inliers") == registration.OPENS)
    first = F.row_number().over(W.Window.partitionBy("cam", "ok").orderBy(F.desc("clarity"), "ts")) == 1
    still = F.col("mode") == "in_place"
    same = F.array(*(F.lit(float(x)) for x in registration.IDENTITY.ravel()))
    out = whole.withColumn("anchor", F.when(still, first & F.col("ok")).otherwise(F.coalesce(opens, F.lit(False))))
    out = out.select("cam", "ts", "mode", F.when(still, F.when(F.col("ok"), 0)).otherwise(F.col("view")).alias("view"), "seg", F.when(still, F.when(F.col("ok"), same)).otherwise(F.col("to_view")).alias("t"), "anchor")
    return out.where("t is not null")


def measured(files: DataFrame, places: DataFrame, width: int, height: int, block: int) -> DataFrame:
    """(cam, view, seg, ts, edge_corr, tx, ty, br, bc, r, g, b, valid) of every placed frame, warped into its view."""
    kind = files.schema["ts"].dataType.simpleString()
    number = F.row_number().over(W.Window.partitionBy("cam", "view").orderBy("ts")) - 1
    own = places.withColumn("part", F.floor(number / FRAMES_TOGETHER).cast("int"))
    parts = own.groupBy("cam", "view").agg(F.max("part").alias("last"))
    contents = files.select("cam", "ts", "content")
    new = lambda *names: [F.col(n).alias(n) for n in names]  # noqa: E731  both sides come from the same tables
    frames = own.join(contents, ["cam", "ts"]).select(*new("cam", "view", "part", "seg", "ts", "t", "content"))
    anchors = places.where("anchor").join(contents, ["cam", "ts"]).join(parts, ["cam", "view"]).select(*new("cam", "view", "content"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part"))
    names = ["cam", "view", "seg", "ts", "edge_corr", "tx", "ty", "br", "bc", "r", "g", "b", "valid"]

    def one(frames: pd.DataFrame, anchor: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(frames) and len(anchor):
            against = images.edges(images.resized(images.decode(anchor["content"].iloc[0]), width, height))
            for r in frames.itertuples():
                t = np.asarray(r.t, float).reshape(2, 3)
                seen = images.warped(images.resized(images.decode(r.content), width, height), t)
                cover = seen[..., 0] >= 0
                agreement = images.edge_agreement(np.where(cover[..., None], seen, 0.0), against, cover)
                means, valid = images.mean_blocks(seen, cover, block)
                for i, j in np.ndindex(valid.shape):
                    out.append((r.cam, r.view, r.seg, r.ts, agreement, t[0, 2], t[1, 2], i, j, *means[i, j].tolist(), bool(valid[i, j])))
        return pd.DataFrame(out, columns=names)

    schema = f"cam string, view int, seg int, ts {kind}, edge_corr double, tx double, ty double, br int, bc int, r double, g double, b double, valid boolean"
    colours = [F.nanvl(F.col(x), F.lit(None).cast("double")).alias(x) for x in ("r", "g", "b")]
    return frames.groupBy("cam", "view", "part").cogroup(anchors.groupBy("cam", "view", "part")).applyInPandas(one, schema).select(*names[:9], *colours, "valid")


def archive(files: DataFrame, features: Features = images.corner_features, match: registration.Match | None = None, width: int = WIDTH, height: int = HEIGHT, block: int = BLOCK,
            tracking: dict | None = None, screen: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames (cam, ts, mode, view, seg, t, anchor), views (cam, view, seg, t, frames, span_days, anchor) and blocks of photo archives.

    files: cam string, ts, content. Photos that cannot be read or used have no place. blocks: as ``measured`` says, with a
    frame number by time within the camera.
    """
    match = match or registration.PointMatcher()
    frames = stored(looked(files, features, width, height, **(screen or {})), "looked")
    tracked = stored(registration.track_cameras(frames, _features_of, match, **(tracking or {})), "tracked")
    limits = limits_of(frames)
    views = stored(registration.group_views(tracked.where("t is not null"), linked(tracked, frames, limits, match), limits=limits), "views")
    places = stored(placed(frames, tracked, views), "places")
    blocks = measured(files, places, width, height, block)
    order = places.select("cam", "ts", (F.row_number().over(W.Window.partitionBy("cam").orderBy("ts")) - 1).alias("frame"))
    return places, views, blocks.join(order, ["cam", "ts"])
