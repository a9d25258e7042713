"""Camera model, terrain, lines of sight, siting, components, calibration."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landsight.functions import geo
from landsight.functions.base import d
from landsight.operators import calibration, joins, siting, terrain
from landsight.plans import network


@pytest.mark.parametrize("k1", [0.0, 0.08, -0.05])
def test_pixel_round_trip(spark, k1):
    cam = geo.Camera(1536, 1024, 91.3, -2.0, 1.1, 101.0, k1)
    p = spark.range(25).crossJoin(spark.range(17).withColumnRenamed("id", "j")).select((F.col("id") * 64.0).alias("u"), (F.col("j") * 64.0).alias("v"))
    az, el = cam.direction(F.col("u"), F.col("v"))
    p = p.select("u", "v", az.alias("az"), el.alias("el"))
    u, v = cam.pixel(F.col("az"), F.col("el"))
    worst = p.select(F.max(F.greatest(F.abs(u - F.col("u")), F.abs(v - F.col("v"))))).first()[0]
    assert worst < 1e-6


def test_camera_axis_and_edges(spark):
    cam = geo.Camera(1000, 800, 250.0, -3.5)
    az, el = cam.direction(d(500), d(400))
    flat = geo.Camera(1000, 800, 0.0)
    edge, _ = flat.direction(d(1000), d(400))
    got = spark.range(1).select(az, el, edge, flat.effective_hfov).first()
    assert np.allclose(got, [250, -3.5, 50, 100])


GRID = terrain.Grid(37.0, -1 / 1200, -120.0, 1 / 1200, 120, 120)


def ridge(spark, height=400):
    return spark.range(120 * 120).select((F.col("id") / 120).cast("int").alias("row"), (F.col("id") % 120).cast("int").alias("col")).withColumn("z", F.when(F.col("col").between(60, 62), d(height)).otherwise(d(0)))


def site(spark, row, col, name=1):
    return spark.createDataFrame([(name, 37 - (row + 0.5) / 1200, -120 + (col + 0.5) / 1200)], "site int, lat double, lon double")


def test_ridge_hides_ground_and_smoke_clears_it(spark):
    c = ridge(spark)
    o = terrain.observers(site(spark, 60, 30), c, GRID)
    seen = {(r["row"], r["col"]) for r in terrain.viewshed(o, c, GRID, r_max=9000.0, n_az=720).collect()}
    assert (60, 45) in seen and (60, 60) in seen and (60, 80) not in seen
    pairs = o.crossJoin(site(spark, 60, 90, 2).select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2")))
    pairs = pairs.withColumn("z_top", F.explode(F.array(d(2), d(2000)))).withColumn("pair", F.col("z_top"))
    got = {r["pair"]: r["visible"] for r in terrain.sees(pairs, c, GRID).collect()}
    assert got == {2.0: False, 2000.0: True}
    assert terrain.sees(pairs, c, GRID, r_max=100.0).where("visible").count() == 0


def test_corner_grids_and_outside(spark):
    c = ridge(spark)
    o = terrain.observers(site(spark, 60, 30), c, GRID)
    r = terrain.rays(o, c, GRID, r_max=9000.0, n_az=8, step_m=45.0, corners=True, outside_z=-1e4)
    assert r.where("visible and not (row between 0 and 119 and col between 0 and 119)").count() == 0
    assert r.where("visible and col = 60").count() > 0


def test_siting_finds_the_hidden_valley(spark):
    c = ridge(spark, 600).withColumn("z", F.when((F.abs(F.col("row") - 60) < 2) & (F.abs(F.col("col") - 100) < 2), d(120)).otherwise(F.col("z")))
    cands = site(spark, 60, 100, 7).union(site(spark, 20, 20, 8)).union(site(spark, 100, 10, 9))
    picks = network.choose_sites(c, GRID, cands, site(spark, 60, 30), 2, r_max=9000.0, n_az=360).orderBy("pick").collect()
    assert picks[0]["site"] == 7 and picks[0]["km2"] > 5


def plain_greedy(covers, weight, k, stop):
    left, out = set().union(*covers.values()), []
    rest = dict(covers)
    for n in range(k):
        gains = {s: round(sum(weight[t] for t in c & left), 9) for s, c in (covers if stop else rest).items()}
        best = min(gains, key=lambda s: (-gains[s], s))
        if stop and gains[best] <= 0:
            break
        out.append((n + 1, best, gains[best]))
        left -= covers[best]
        rest.pop(best, None)
    return out


@pytest.mark.parametrize("stop", [True, False])
def test_greedy_equals_a_plain_loop(spark, stop):
    rng = np.random.default_rng(5)
    covers = {s: set(rng.choice(40, 6, replace=False).tolist()) for s in range(15)}
    weight = {t: float(t % 5) for t in range(40)}
    v = spark.createDataFrame([(s, t, weight[t]) for s, c in covers.items() for t in c], "site int, target int, w double")
    got = [tuple(r) for r in siting.greedy_cover(v, 8, weight="w", stop_at_zero=stop).orderBy("pick").collect()]
    assert got == plain_greedy(covers, weight, 8, stop)


def test_exploded_pixels_and_samples_are_not_broadcast(spark):
    few = spark.range(3).select(F.col("id").cast("int").alias("site"))
    many = few.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("*", F.col("u").alias("v"), F.col("u").alias("az"), d(1).alias("el"))
    pano = few.select("site", F.lit(0).alias("az_idx"), F.lit(0).alias("d_idx"), *(d(2).alias(x) for x in ("dist", "lat", "lon", "cummax")))
    cells = spark.range(4).select((F.col("id") / 2).cast("int").alias("row"), (F.col("id") % 2).cast("int").alias("col"), d(5).alias("z"))
    points = many.select(F.struct("site", "u").alias("k"), d(0.2).alias("lat"), d(0.2).alias("lon"))
    for df in (terrain.ground_of_pixels(many, pano, 0.0, 90.0), terrain.sample_bilinear(points, cells, terrain.Grid(1.0, -0.5, 0.0, 0.5, 2, 2), "k")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 30


def test_rows_of_one_place_take_one_distance(spark, monkeypatch):
    taken = spark.sparkContext.accumulator(0)

    def counted(*_):
        taken.add(1)
        return 7.0

    monkeypatch.setattr(joins, "planar_m", lambda *x: F.udf(counted, "double").asNondeterministic()(*x))
    here = spark.range(200).select("id", d(36).alias("lat"), d(-120).alias("lon"))
    assert joins.within(here, here, 100.0).where("dist = 7").count() == 200 * 200
    assert 0 < taken.value < 10


def test_pairs_of_one_place_are_dealt_to_all_tasks_and_none_is_lost(spark, monkeypatch):
    monkeypatch.setattr(joins, "PACK", 20, raising=False)
    rng = np.random.default_rng(6)
    at = [(36.0, -120.0)] * 300 + [(float(x), float(y)) for x, y in zip(36 + rng.integers(0, 9, 90) / 10, -120 + rng.integers(0, 9, 90) / 10)] + [(None, -120.0)] * 5
    rows = [(k, *x) for k, x in enumerate(at)] + [(0, 36.0, -120.0)] * 3  # a row may occur again
    side = spark.createDataFrame(rows, "id long, lat double, lon double")
    got = joins.within(side, side, 15_000.0, digits=3).withColumn("task", F.spark_partition_id()).collect()
    near = lambda a, b: math.hypot((b[1] - a[1]) * 110540, (b[2] - a[2]) * 111320 * math.cos(math.radians(a[1])))
    held = [r for r in rows if r[1] is not None]
    want = [(*a, *b, round(near(a, b), 3)) for a in held for b in held if near(a, b) <= 15_000]
    assert sorted(r[:7] for r in map(tuple, got)) == sorted(want)
    most = max(Counter(r["task"] for r in got).values())
    assert most < len(got) / 2


def test_ratio_matches_meet_in_blocks_and_equal_a_plain_loop(spark, monkeypatch):
    for name, n in (("SIDE_A", 7), ("SIDE_B", 5)):
        monkeypatch.setattr(joins, name, n, raising=False)
    rng = np.random.default_rng(4)
    rows = [(g, k, [float(x) for x in rng.integers(0, 4, 3)]) for g in range(3) for k in range((30, 17, 1)[g])] + [(0, 99, None), (0, 98, [1.0, 2.0])]
    a, b = (spark.createDataFrame(x, "pair int, id long, v array<double>") for x in (rows, [(g, k + 100, v) for g, k, v in rows[::-1]]))
    want = []
    for g, k, v in rows:
        near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w))), m + 100) for h, m, w in rows if h == g and w and v)[:2]
        want += [(g, k, near[0][1], near[0][0])] if len(near) == 2 and near[0][0] < 0.9 * near[1][0] else []
    got = joins.affine_ratio_matches(a, b, 0.9)
    assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_greedy_takes_the_least_of_equal_sites_whatever_the_order_of_rows(spark):
    rng = np.random.default_rng(8)
    weight = rng.integers(0, 10**7, 300) / 100
    v = spark.createDataFrame([(s, int(t), float(weight[t])) for s in range(40) for t in rng.permutation(300)], "site int, target int, w double").repartition(7)
    got = [tuple(r) for r in siting.greedy_cover(v, 2, weight="w", stop_at_zero=False).orderBy("pick").collect()]
    assert got == [(1, 0, round(math.fsum(weight), 2)), (2, 1, 0.0)]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [*range(61), 100, 101, 200]], "node long")
    got = {r["node"]: r["label"] for r in siting.components(e, nodes).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100 and got[200] == 200


def test_blind_spots(spark):
    c = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (5, 5)], "row int, col int")
    f = spark.createDataFrame([(0, 1, "a", 5.0), (1, 1, "b", 9.0), (5, 5, "z", 0.0)], "row int, col int, name string, acres double")
    got = [tuple(r) for r in network.blind_spots(c, 10, f).orderBy("label").collect()]
    assert got == [(0, 3, 1 / 3, 2 / 3, 2, 14.0, "b"), (55, 1, 5.0, 5.0, 1, 0.0, None)]


def test_smoke_views_and_coverage(spark):
    c = ridge(spark)
    sites = terrain.observers(site(spark, 60, 30), c, GRID)
    fire = site(spark, 60, 90).withColumnRenamed("site", "fire").union(site(spark, 60, 40, 2))
    got = {(r["fire"], r["height"]): r["n"] for r in network.smoke_views(fire, sites, c, GRID, (100, 3000)).collect()}
    assert got == {(1, 100): 0, (1, 3000): 1, (2, 100): 1, (2, 3000): 1}
    n = network.network_coverage(site(spark, 60, 30), c, GRID, r_max=9000.0, n_az=360)
    assert n.where("row = 60 and col = 80").count() == 0 and n.agg(F.max("n")).first()[0] == 1


def test_candidates_near_unseen(spark):
    tops = spark.createDataFrame([(0, 0, 1.0), (50, 50, 2.0)], "row int, col int, z double")
    unseen = spark.createDataFrame([(r, k, 1.0) for r in range(8) for k in range(8)], "row int, col int, w double")
    assert [r["row"] for r in siting.candidates_near(tops, unseen, 10, 60.0).collect()] == [0]


def test_inside_polygon_with_hole_like_notch(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    edges = spark.createDataFrame([(1, *map(float, ring[k]), *map(float, ring[(k + 1) % 5])) for k in range(5)], "polygon_id int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 2.0, 0.5), (2, 2.0, 2.0), (3, 0.2, 2.0), (4, 9.0, 1.0)], "point_id int, x double, y double")
    assert {r["point_id"] for r in joins.inside_polygons(pts, edges).collect()} == {1, 3}


def test_points_in_many_polygons_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rings = {k: [(cx + r * np.cos(t), cy + r * np.sin(t)) for t, r in zip(np.sort(rng.uniform(0, 2 * np.pi, 7)), rng.uniform(0.1, 1.2, 7))] for k, (cx, cy) in enumerate(rng.uniform(-3, 3, (12, 2)))}
    pts = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-4, 4, (300, 2)))]
    sides = [(k, *map(float, a), *map(float, b)) for k, ring in rings.items() for a, b in zip(ring, ring[1:] + ring[:1])]
    want = set()
    for p, x, y in pts:
        for k in rings:
            crossings = sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for q, x1, y1, x2, y2 in sides if q == k)
            want |= {(p, k)} if crossings % 2 else set()
    edges = spark.createDataFrame(sides, "polygon_id int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame(pts, "point_id int, x double, y double")
    for cell in (0.25, 3.0):
        assert {tuple(r) for r in joins.inside_polygons(points, edges, cell=cell).collect()} == want and len(want) > 20


def test_mean_ranks_equal_pandas(spark):
    from landsight.operators import modelling

    v = np.random.default_rng(3).integers(0, 40, 500).astype(float)
    got = {r["x"]: r["rank"] for r in modelling.mean_ranks(spark.createDataFrame([(x,) for x in v.tolist()], "x double"), "x").collect()}
    assert got == dict(zip(v.tolist(), pd.Series(v).rank().tolist()))


def test_pose_is_recovered_from_the_skyline(spark):
    az_lo, step, n = 60.0, 0.1, 701
    az = az_lo + step * np.arange(n)
    el = 2 + 1.5 * np.sin(np.radians(az * 9)) + 0.8 * np.cos(np.radians(az * 23)) + 0.02 * (az - 95)
    sky = spark.createDataFrame(pd.DataFrame({"site": 1, "az_idx": np.arange(n), "el": el}))
    true = (95.3, -1.2, 0.7, 60.0, 0.0)
    rows = []
    for u in range(20, 620, 6):
        v = np.arange(0, 480, 0.25)
        a, e = calibration.direction(true, 640, 480, np.full(len(v), float(u)), v)
        under = np.flatnonzero(e < np.interp(a, az, el))
        rows.append((1, float(u), float(v[under[0]])))
    px = spark.createDataFrame(rows, "site int, u double, v double")
    poses = spark.createDataFrame([(1, 640.0, 480.0, 93.0, 60.0, 0.0)], "site int, width double, height double, yaw0 double, hfov double, k1 double")
    best = calibration.coarse_poses(px, sky, poses, az_lo, step, yaw_half=6, pitch=(-4, 2))
    got = calibration.fitted_poses(px, sky, best.join(poses.select("site", "width", "height"), "site"), az_lo, step).first()
    assert abs(got["yaw"] - 95.3) < 0.2 and abs(got["pitch"] + 1.2) < 0.2 and abs(got["roll"] - 0.7) < 0.3 and got["loss"] < 0.05
    lens = calibration.shared_lens(px, sky, poses, az_lo, step, [54.0, 60.0, 66.0], [0.0]).collect()
    assert len(lens) == 1 and lens[0]["hfov"] == 60.0
    finer = calibration.shared_lens(px, sky, poses, az_lo, step, [54.0, 63.0], [0.0], refine=4, limits=((50.0, 70.0), (-0.1, 0.1))).first()
    assert abs(finer["hfov"] - 60) <= 1.5 and finer["loss"] <= lens[0]["loss"] + 0.05
