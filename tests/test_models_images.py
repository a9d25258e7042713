"""Ridge skill, registration, pixels, sources."""

import datetime as dt
import json
import math
import random
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from landsight.functions import encode, frames
from landsight.operators import images, modelling, registration
from landsight.sources import photos, tables
from landsight.sources import blocks, exif, fetch

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


def test_ridge_penalty_equals_brute_force():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6))
    x[:, 4] = (np.arange(40) % 2).astype(float)
    x[:, 5] = 1 - x[:, 4]
    y = x @ rng.normal(size=6) + rng.normal(size=40)

    def fit(a, b, alpha):
        m, n = a.mean(0), b.mean()
        w = np.linalg.solve((a - m).T @ (a - m) + alpha * np.eye(a.shape[1]), (a - m).T @ (b - n))
        return w, n - m @ w

    scores = []
    for alpha in modelling.ALPHAS:
        e = []
        for k in range(40):
            keep = np.arange(40) != k
            w, c = fit(x[keep], y[keep], alpha)
            e.append(y[k] - x[k] @ w - c)
        scores.append(np.mean(np.square(e)))
    coef, free, alpha = modelling.ridge_loo(x, y)
    assert alpha == modelling.ALPHAS[int(np.argmin(scores))]
    w, c = fit(x, y, alpha)
    assert np.allclose(coef, w) and np.isclose(free, c)


def sample_frame(spark, scramble=False):
    rng = np.random.default_rng(3)
    rows = []
    for year in range(2005, 2015):
        for s, off in (("a", 0.0), ("b", 10.0)):
            for k in range(20):
                day = dt.date(year, 2, 1) + dt.timedelta(days=14 * k)
                wet = rng.normal(0, 15)
                rows.append((1, s, day, year, wet + rng.normal(0, 5), 100 + off + 20 * np.cos(day.timetuple().tm_yday / 365.25 * 2 * np.pi) + wet))
    if scramble:
        rows = [(*r[:5], rng.normal(100, 90)) if r[3] == 2010 else r for r in rows]
    df = spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in rows], "cam int, site string, date date, year int, x double, lfmc double")
    return df.withColumns(dict(zip(modelling.SEASON, frames.season("date"))))


def test_held_out_year_does_not_leak_and_predictor_helps(spark):
    a, b = (modelling.loyo(sample_frame(spark, s), ["x"], ["cam"]) for s in (False, True))
    pa, pb = (x.where("year = 2010").orderBy("site", "date").toPandas()["pred"] for x in (a, b))
    assert np.allclose(pa, pb)
    m = modelling.metrics(a, ["cam"]).first()
    assert m["anomaly_r"] > 0.5 and m["years_beat_season"] >= 8 and m["years"] == 10
    sets = modelling.compare(sample_frame(spark), {"x": ["x"], "none": []}, ["cam"]).collect()
    got = {r["set"]: r["rmse"] for r in sets}
    assert got["x"] < got["none"]


def plain_loyo(pdf, feats, per_site):
    """{id: (pred, clim)} with each held-out year's training rows in one table."""
    out = {}
    for _, own in pdf.groupby("cam"):
        for held in own["year"].dropna().unique():
            train, test = own[own["year"] != held], own[own["year"] == held]
            if len(train) < 30:
                continue
            both = []
            for used in ([f for f in feats if not (per_site and f in modelling.SEASON)], []):
                a, b = train[used].to_numpy(float), test[used].to_numpy(float)
                if used:
                    b = np.clip(b, a.min(0), a.max(0))
                    sd = np.where(a.std(0) == 0, 1, a.std(0))
                    a, b = (a - a.mean(0)) / sd, (b - a.mean(0)) / sd
                for s in sorted(own["site"].dropna().unique()):
                    for h in [None, *(modelling.SEASON if per_site else [])]:
                        a, b = (np.column_stack([x, (t["site"] == s) * (t[h] if h else 1.0)]) for x, t in ((a, train), (b, test)))
                if not per_site:
                    a, b = np.hstack([a, train[modelling.SEASON]]), np.hstack([b, test[modelling.SEASON]])
                coef, free, _ = modelling.ridge_loo(a, train["lfmc"].to_numpy(float))
                both.append(b @ coef + free)
            out |= {i: (p, q) for i, p, q in zip(test["id"], *both)}
    return out


@pytest.mark.parametrize(("feats", "per_site"), [(["x", "z"], True), (["x", "doy_s1"], False), ([], True)])
def test_years_predicted_from_moments_and_chunks_equal_whole_tables(spark, feats, per_site):
    rng = random.Random(4)
    rows = []
    for k in range(700):
        year, day = rng.randint(2010, 2014), dt.date(2011, 1, 1) + dt.timedelta(days=rng.randint(0, 360))
        x, site = rng.gauss(1e4, 3) + (year == 2012) * 20, "new" if year == 2013 and rng.random() < 0.3 else rng.choice(["a", "b"])
        rows.append((k, rng.choice([1, 1, 1, 2, 2, None]), None if k % 31 == 0 else site, None if k % 29 == 0 else year, day, x, 7.1 if year != 2014 else 8.0, 100 + 2 * x + 20 * math.cos(day.timetuple().tm_yday / 58) + rng.gauss(0, 5)))
    rows += [(1000 + k, 3, "a", 2010 + k % 2, dt.date(2011, 1, 1 + k), 1.0, 1.0, 1.0) for k in range(20)]  # too few
    rows += [(2000, 1, "a", 2010, dt.date(2011, 1, 1), None, 1.0, 1.0), (2001, 1, "a", 2010, dt.date(2011, 1, 1), 1.0, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "id int, cam int, site string, year int, date date, x double, z double, lfmc double")
    df = df.withColumns(dict(zip(modelling.SEASON, frames.season("date"))))
    want = plain_loyo(df.toPandas().dropna(subset=[*feats, "lfmc"]), feats, per_site)
    got = modelling.loyo(df, feats, ["cam"], season_per_site=per_site, together=40)
    assert got.columns == [*df.columns, "pred", "clim"]
    got = {r["id"]: (r["pred"], r["clim"]) for r in got.collect()}
    assert len(want) > 500 and got.keys() == want.keys()
    assert all(np.allclose(got[i], want[i], rtol=1e-7, atol=1e-6) for i in want)
    assert modelling.loyo(df.limit(0), feats, ["cam"], season_per_site=per_site).count() == 0


def test_no_task_is_given_all_rows_of_a_camera(spark):
    rows = spark.range(0, 20_000, 1, 3).select(F.lit(1).alias("cam"), F.lit("a").alias("site"), F.lit(2000).alias("year"))
    cells = rows.groupBy("cam", "site", "year").agg(F.count("*").alias("__n"))
    chunks, sent = modelling.dealt(rows, cells.select(*(F.col(x).alias(x) for x in cells.columns)), ["cam"], 1000)
    sizes = [r["count"] for r in chunks.groupBy("cam", "__chunk").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 20 and max(sizes) < 1300
    assert sent.groupBy("cam", "__chunk").agg(F.sum("__n").alias("n")).where("n = 20000").count() == 20


def test_spearman_of_values_that_come_out_otherwise_when_worked_out_again(spark):
    noisy = F.udf(lambda k: k + random.random() / 1e6, "double").asNondeterministic()
    got = modelling.spearman(spark.range(20).select(noisy("id").alias("a"), (-F.col("id")).alias("b")), "a", "b").first()
    assert got["n"] == 20 and np.isclose(got["rho"], -1)


def test_published_sign_test(spark):
    df = spark.createDataFrame([(k < 15,) for k in range(21)], "w boolean")
    got = modelling.sign_test(df, F.col("w")).first()
    assert got["wins"] == 15 and got["n"] == 21 and round(got["p"], 4) == 0.0392


def scene(seed, shift=(0.0, 0.0), n=80):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, 500, (n, 2)) + shift, rng.normal(size=(n, 8))


def test_tracker_follows_drift_and_starts_a_segment_at_a_new_aim():
    seen = [(scene(1, (k * 3.0, k * 1.0)), 1.0) for k in range(12)] + [(None, 0.0)] + [(scene(2, (k * 2.0, 0.0)), 2.0) for k in range(12)]
    tracker = registration.track(seen, registration.PointMatcher())
    assert [p.segment for p in tracker.places] == [0] * 12 + [-1] + [1] * 12 and len(tracker.segments) == 2
    for k in range(12):
        assert np.abs(tracker.places[k].t[:, 2] + [k * 3.0, k * 1.0]).max() < 1e-6


def counted_match(weights):
    """A matcher of named frames that knows how many points each pair shares."""
    return lambda a, b: (registration.IDENTITY, weights.get((a, b), 0)) if weights.get((a, b), 0) else (None, 0)


def test_tracker_transitions():
    def places(frames, weights, **policy):
        tracker = registration.track(frames, counted_match(weights), **policy)
        return [(p.segment, p.inliers) for p in tracker.places], [[k.frame for k in s] for s in tracker.segments]

    # A weak match of a clear frame becomes a keyframe, that of a dull one does not; strong ones never do.
    got = places([("a", 2.0), ("b", 2.0), ("c", 1.0), ("d", 2.0)], {("b", "a"): 100, ("c", "a"): 100, ("d", "b"): 500, ("d", "a"): 40})
    assert got == ([(0, 999), (0, 100), (0, 100), (0, 500)], [[0, 1]])
    # Too few inliers lose a frame, and a match ends the row of lost ones.
    got = places([("a", 1.0), ("x", 1.0), ("y", 1.0), ("z", 1.0), ("b", 1.0), ("u", 1.0)], {("x", "a"): 34, ("b", "a"): 35})
    assert got == ([(0, 999), (-1, 0), (-1, 0), (-1, 0), (0, 35), (-1, 0)], [[0]])
    # The fourth lost frame opens a segment at the clearest, which the others may join.
    got = places([("a", 1.0), ("x", 1.0), ("y", 3.0), (None, 9.0), ("z", 1.0), ("w", 2.0), ("v", 1.0)], {("x", "y"): 50, ("z", "y"): 20, ("w", "y"): 60, ("v", "y"): 170})
    assert got == ([(0, 999), (1, 50), (1, 999), (-1, 0), (-1, 0), (1, 60), (1, 170)], [[0], [2]])
    # A frame that matches none of the newest is tried against the older keyframes.
    names = [f"k{i}" for i in range(8)]
    chain = {(b, a): 100 for a, b in zip(names, names[1:])}
    got = places([(n, 2.0) for n in [*names, "late"]], chain | {("late", "k2"): 90})
    assert got[0][-1] == (0, 90) and got[1] == [[*range(9)]]


def test_groups_take_the_strongest_links():
    shift = lambda x: np.array([[1.0, 0, x], [0, 1.0, 0]])
    links = {(0, 1): (90, shift(1)), (1, 2): (80, shift(10)), (0, 2): (31, shift(999)), (3, 4): (30, shift(5)), (4, 5): (29, shift(0)), (2, 9): (99, shift(0))}
    got = [{s: t[0, 2] for s, t in g.items()} for g in registration.spanning_groups({0: 5, 1: 9, 2: 7, 3: 6, 4: 8, 5: 1}, links)]
    assert got == [{1: 0.0, 0: 1.0, 2: -10.0}, {4: 0.0, 3: 5.0}, {5: 0.0}]


def test_tracking_and_views_per_camera(spark):
    rows = [(c, dt.datetime(2020, 1, 1) + dt.timedelta(days=20 * k), 1.0, 10 * c + (k >= 14)) for c in (1, 2) for k in range(28)]
    f = spark.createDataFrame(rows, "cam int, ts timestamp, clarity double, seed int")
    tracked = registration.track_cameras(f, lambda r: scene(r["seed"]), registration.PointMatcher())
    links = spark.createDataFrame([], "cam int, a int, b int, inliers int, t array<double>")
    views = registration.group_views(tracked, links, least_size=3, least_frames=5, least_days=200)
    got = {(r["cam"], r["view"], r["frames"], r["span_days"]) for r in views.collect()}
    assert got == {(c, v, 14, 260) for c in (1, 2) for v in (0, 1)}
    whole = registration.to_view(tracked, views).withColumn("ok", F.lit(True))
    assert whole.where("view is null").count() == 0
    assert {r["mode"] for r in registration.measuring_mode(whole).collect()} == {"registered"}


def test_linked_segments_become_one_view(spark):
    f = spark.createDataFrame([(1, dt.datetime(2020, 1, 1) + dt.timedelta(days=k), k // 100, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]) for k in range(300)], "cam int, ts timestamp, seg int, t array<double>")
    links = spark.createDataFrame([(1, 0, 1, 50, [1.0, 0.0, 5.0, 0.0, 1.0, 2.0]), (1, 1, 2, 10, [1.0, 0.0, 9.0, 0.0, 1.0, 9.0])], "cam int, a int, b int, inliers int, t array<double>")
    got = {r["seg"]: r["t"] for r in registration.group_views(f, links, least_days=100).collect()}
    assert got == {0: [1, 0, 0, 0, 1, 0], 1: [1, 0, -5, 0, 1, -2]}


def test_pixels():
    flat = np.full((96, 96, 3), (80, 120, 60), np.uint8)
    assert np.allclose(images.resized(flat, 4, 4), (80, 120, 60)) and images.edges(flat).max() < 1e-9
    ramp = np.arange(100.0).reshape(10, 10)
    assert np.allclose(images.resized(ramp, 5, 5), ramp.reshape(5, 2, 5, 2).mean((1, 3)))
    rng = np.random.default_rng(0)
    a = rng.normal(size=(128, 160))
    dx, dy, share = images.phase_shift(a, np.roll(a, (3, 7), (0, 1)))
    assert abs(dx - 7) < 0.5 and abs(dy - 3) < 0.5 and images.accepted_shift(dx, dy, share)
    t = np.array([[1.0, 0, 4], [0, 1.0, 2]])
    w = images.warped(a, t)
    assert np.allclose(w[10:50, 10:50], a[8:48, 6:46]) and (w[:2] == -1).all()
    sky = np.zeros((100, 200), bool)
    sky[:40] = True
    sky[20:25, 50:60] = False
    rows = images.skyline_rows(sky)
    assert (rows[10:-10] == 40).all() and np.isnan(rows[:10]).all()
    gray = np.full((100, 200), 200.0)
    gray[43:] = 90.0
    gray[:, 150:] = np.where(np.arange(100)[:, None] < 43, 200.0, 10.0)
    sky[:, 60] = True
    lit = images.skyline_rows(sky, gray)
    assert np.isin(lit[10:150][np.arange(10, 150) != 60], (42, 43)).all() and np.isnan(lit[150:]).all() and np.isnan(lit[60])
    speckled = rng.uniform(0, 255, (96, 96, 3))
    small = images.resized(speckled, 512, 384)
    got = images.screened(speckled)
    assert np.isclose(got["std"], images.grey(small)[172:].std()) and 0 < got["sky_sat"] < 255 and got["lap"] > 0 and images.screened(np.zeros((96, 96, 3)))["ground_sat"] == 0
    noise = rng.uniform(0, 255, (96, 96, 3))
    mask = np.ones((96, 96), bool)
    assert np.isclose(images.edge_agreement(noise, images.edges(speckled), mask), np.corrcoef(images.edges(noise)[38:].ravel(), images.edges(speckled)[38:].ravel())[0, 1])
    assert images.edge_agreement(noise, images.edges(noise), mask) > 0.999 and images.edge_agreement(noise, images.edges(noise), np.arange(96)[:, None] < mask * 40) == 0.0
    assert images.edge_agreement(flat, images.edges(flat), np.ones((96, 96), bool)) == 0.0
    assert images.decode(b"not a picture") is None and images.decode(None) is None


def test_photo_folder_and_blocks(spark, tmp_path):
    for name, colour in (("cam_20200102T101500.ppm", (80, 120, 60)), ("cam_2020-01-01_0900.ppm", (10, 20, 30)), ("undated.ppm", (0, 0, 0)), ("bad_20200103.jpg", None)):
        body = b"P6\n48 48\n255\n" + bytes(colour) * (48 * 48) if colour else b"broken"
        (tmp_path / name).write_bytes(body)
    f = photos.photo_folder(spark, str(tmp_path))
    assert [r["ts"] for r in f.collect()] == [dt.datetime(2020, 1, 1, 9), dt.datetime(2020, 1, 2, 10, 15), dt.datetime(2020, 1, 3)]
    b = images.block_colours(f, 48, 48, 24).collect()
    assert sum(not r["ok"] for r in b) == 1 and sum(r["ok"] and r["g"] == 120.0 for r in b) == 4
    assert images.screened_frames(f).where("ok").count() == 2


@pytest.mark.parametrize("name, want", [
    ("a/2019/x_2020-02-30.jpg", None), ("x_19800101-x_20210304_050607.jpg", dt.datetime(2021, 3, 4, 5, 6, 7)), ("x_20210304_0506_99.jpg", dt.datetime(2021, 3, 4, 5, 6)),
    ("1700000000.jpg", dt.datetime(2023, 11, 14, 22, 13, 20)), ("nothing.jpg", None), (None, None),
])
def test_photo_times(spark, name, want):
    assert spark.createDataFrame([(name,)], "p string").select(encode.photo_time("p")).first()[0] == want


def test_quantised_values(spark):
    v = [-0.2, -0.031, 0.0, 0.05, 0.24, float("nan"), None, 9.0]
    got = spark.createDataFrame([(v,)], "v array<double>").select(encode.quantised(F.col("v")).alias("c")).select(encode.dequantised(F.col("c"))).first()[0]
    assert all(abs(a - b) <= 1 / 500 for a, b in zip(v[:5], got)) and got[5:] == [None, None, 127 / 500]


def test_sources(spark, tmp_path):
    feat = lambda i, lon, st="CA": {"geometry": {"coordinates": [lon, 37.0001, 100.0]}, "properties": {"id": i, "name": i, "state": st, "county": "X", "az_current": 1.0, "fov": 60.0}}
    (tmp_path / "cams.json").write_text(json.dumps({"features": [feat("b", -120.0), feat("a", -120.0), feat("c", None), feat("d", -110.0, "NV")]}))
    sites = tables.camera_sites(tables.camera_features(spark, str(tmp_path / "cams.json")).where("state = 'CA'")).collect()
    assert len(sites) == 1 and sites[0]["ids"] == ["a", "b"] and sites[0]["elev"] == 100.0
    (tmp_path / "log.jsonl").write_text('{"tile": "h1", "date": "2020-01-01", "pts": {"s": {"b1": 0.5}}}\n{broken\n{"tile": "h1", "date": "2020-01-09", "error": "x"}\n')
    assert [tuple(r) for r in tables.satellite_log(spark, str(tmp_path / "log.jsonl"), "b1: double").collect()] == [("h1", dt.date(2020, 1, 1), "s", 0.5)]
    (tmp_path / "roi.csv").write_text("# a\n# b\ndate,gcc\n2020-01-01,0.4\n")
    assert tables.curated_series(spark, str(tmp_path / "roi.csv"), "date date, gcc double").select("gcc").collect() == [(0.4,)]
    raw = spark.createDataFrame([("USA", "s", "37.5", "-120", "20200131", "88.5", "x"), ("USA", "s", "bad", "-120", "20200131", "88.5", "x"), ("France", "s", "1", "1", "20200131", "1", "x")], "Country string, " + ", ".join(f"`{c}` string" for c in tables.SAMPLE_COLUMNS.values()))
    assert [(r["lat"], r["date"], r["lfmc"]) for r in tables.samples(raw).collect()] == [(37.5, dt.date(2020, 1, 31), 88.5)]
    fires = spark.createDataFrame([((1577836800000, 5.0, 37.0, -120.0), None), ((None, 5.0, 37.0, -120.0), (1.0, 2.0))], "attributes struct<FireDiscoveryDateTime: bigint, IncidentSize: double, InitialLatitude: double, InitialLongitude: double>, geometry struct<x: double, y: double>")
    assert [(r["lat"], r["lon"], r["date"]) for r in tables.fires(fires).collect()] == [(37.0, -120.0, dt.datetime(2020, 1, 1))]
    lines = spark.createDataFrame([("x_2020_01_02_101500.jpg ",), ("readme.txt",)], "value string")
    assert [r["ts"] for r in photos.midday_paths(lines).collect()] == [dt.datetime(2020, 1, 2, 10, 15)]
    assert [r["at"] for r in photos.frame_stamps(spark.createDataFrame([("5.jpg 7.jpg x.jpg",)], "value string")).collect()] == [5, 7]
    colour = spark.createDataFrame([("s", "s_2020_01_02_1015.jpg", dt.datetime(2020, 1, 2, 10)), ("s", "s_2020_01_03_1015.jpg", dt.datetime(2020, 1, 3, 10)), ("s", "s_2020_01_04_1015.jpg", dt.datetime(2020, 1, 4, 10))], "site string, path string, ts timestamp")
    ir = spark.createDataFrame([("s", "s_IR_2020_01_02_1015.jpg", dt.datetime(2020, 1, 2, 10)), ("s", "s_IR_2020_01_03_1115.jpg", dt.datetime(2020, 1, 3, 11))], "site string, path string, ts timestamp")
    assert [r["ir_path"] for r in photos.infrared_pairs(colour, ir).orderBy("path").collect()] == ["s_IR_2020_01_02_1015.jpg", "s_IR_2020_01_03_1115.jpg", None]
    t = spark.createDataFrame([("a30", 36.0, 38.0, -121.0, -119.0), ("b10", 36.0, 38.0, -121.0, -119.0), ("c", 0.0, 1.0, 0.0, 1.0)], "id string, lat_lo double, lat_hi double, lon_lo double, lon_hi double")
    assert [r["id"] for r in tables.tiles_around(t, 37.0, -120.0, 1000.0, "10").collect()] == ["b10"]
    assert [r["label"] for r in tables.class_labels(spark.createDataFrame([(1, "tree, plant")], "id int, value string")).collect()] == ["tree"]


def test_sinks_and_block_cubes(spark, tmp_path):
    rows = spark.createDataFrame([("c", dt.date(2020, 1, 1), "grvi", 0.1234567), ("c", dt.date(2020, 1, 1), "gcc", None)], "cam string, date date, metric string, value double")
    tables.write_daily(rows, str(tmp_path / "daily"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "daily")).select("grvi").first()[0] == "0.12346"
    tables.write_log(rows, str(tmp_path / "log"))
    tables.write_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    tables.write_raster(spark.createDataFrame([(600, 1, 2.0)], "row int, col int, z double"), str(tmp_path / "raster"))
    assert spark.read.parquet(str(tmp_path / "raster")).where("tile = 1").count() == 1
    tables.write_sites(spark.createDataFrame([(37.1234567, -120.0, 10.04, 5, 1.005)], "lat double, lon double, elev double, new_cells int, new_km2 double"), str(tmp_path / "sites"))
    rgb = np.full((2, 2, 3, 3), 5.0, np.float32)
    rgb[0, 0, 0] = np.nan
    (tmp_path / "cubes").mkdir()
    np.savez(tmp_path / "cubes" / "cam1_blocks.npz", rgb=rgb, valid=np.ones((2, 2, 3), bool), dates=np.array(["2020-01-01T10:00:00", "2020-01-02T10:00:00"]), edge_corr=np.array([0.5, 0.6]))
    got = blocks.read_cubes(spark, str(tmp_path / "cubes"))
    assert got.count() == 12 and got.where("r is null").count() == 1 and got.select("view").distinct().collect() == [(0,)]
    assert {(r["cam"], r["frame"], r["ts"], r["edge_corr"]) for r in got.collect()} == {("cam1", k, dt.datetime(2020, 1, 1 + k, 10), (0.5, 0.6)[k]) for k in (0, 1)}
    blocks.write_cubes(got, f"file://{tmp_path}/written")
    again = blocks.read_cubes(spark, str(tmp_path / "written"))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)


def jpeg_with(entries, inner=(), order="<"):
    """A JPEG's start with text tags in the first directory and in the one that the first points to."""
    import struct

    def folder(tags, at, pointer=None):
        n = len(tags) + (pointer is not None)
        rows, texts, free = b"", b"", at + 2 + 12 * n + 4
        for tag, text in tags:
            data = text.encode() + b"\0"
            rows += struct.pack(order + "HHII", tag, 2, len(data), free + len(texts))
            texts += data
        if pointer is not None:
            rows += struct.pack(order + "HHII", exif.EXIF_FOLDER, 4, 1, free + len(texts))
        return struct.pack(order + "H", n) + rows + struct.pack(order + "I", 0) + texts

    first = folder(entries, 8, 0 if inner else None)
    tiff = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + first + (folder(inner, 8 + len(first)) if inner else b"")
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_times_inside_files(spark, tmp_path):
    early, late = "2011:02:03 04:05:06", "2012:01:01 00:00:00"
    for order in "<>":
        assert exif.taken_at(jpeg_with([(306, late)], [(36867, early)], order)) == dt.datetime(2011, 2, 3, 4, 5, 6)
        assert exif.taken_at(jpeg_with([(306, late)], order=order)) == dt.datetime(2012, 1, 1)
    for broken in (None, b"", b"\xff\xd8", b"abc", jpeg_with([(306, "no time")]), jpeg_with([(306, late)])[:40], jpeg_with([])):
        assert exif.taken_at(broken) is None
    (tmp_path / "inner").mkdir()
    for name, content in (("a.JpG", jpeg_with([(306, late)])), ("b_20200102.jpg", jpeg_with([(306, late)])), ("c.jpg", b"no"), ("inner/d_20200102.jpg", b"x")):
        (tmp_path / name).write_bytes(content)
    got = [(r["path"].rsplit("/", 1)[-1], r["ts"]) for r in photos.photo_folder(spark, str(tmp_path)).collect()]
    assert got == [("a.JpG", dt.datetime(2012, 1, 1)), ("b_20200102.jpg", dt.datetime(2020, 1, 2))]


def test_fetch_and_lists(spark, tmp_path):
    calls, waits = [], []

    def page_at(start):
        calls.append(start)
        if len(calls) in (1, 2, 4):
            raise OSError("busy")
        n = 2 if start < 4 else 1
        return {"features": [{"attributes": {"OBJECTID": start + k, "FireDiscoveryDateTime": 1577836800000, "IncidentSize": 1.0, "InitialLatitude": 37.0, "InitialLongitude": -120.0}, "geometry": None} for k in range(n)], "exceededTransferLimit": start < 4}

    for k, page in enumerate(fetch.pages(page_at, sleep=waits.append)):
        (tmp_path / f"page{k}.json").write_text(json.dumps(page))
    assert calls == [0, 0, 0, 2, 2, 4] and waits == [2.0, 4.0, 2.0]
    assert sorted(r["OBJECTID"] for r in tables.fires(tables.incident_pages(spark, str(tmp_path / "page*.json"))).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(OSError):
        fetch.retried(lambda: (_ for _ in ()).throw(OSError()), sleep=waits.append)
    (tmp_path / "cams.csv").write_text("lat,lon,name\n37.5,-120,a\nbad,1,b\n,2,c\n")
    assert [tuple(r) for r in tables.camera_table(spark, str(tmp_path / "cams.csv")).collect()] == [(37.5, -120.0, "a")]


def small_world(seed=3):
    rng = np.random.default_rng(seed)
    coarse = images.resized(rng.uniform(30, 220, (40, 52, 3)), 416, 320)
    for _ in range(140):
        y, x, h, w = rng.integers(0, 300), rng.integers(0, 390), rng.integers(4, 22), rng.integers(4, 22)
        coarse[y : y + h, x : x + w] = rng.uniform(0, 255, 3)
    return coarse


def as_ppm(img):
    a = np.clip(np.rint(img), 0, 255).astype(np.uint8)
    return f"P6\n{a.shape[1]} {a.shape[0]}\n255\n".encode() + a.tobytes()


def test_archive_from_photos_to_blocks(spark, tmp_path):
    from landsight.plans import archive

    rows = []
    for cam, seed in (("one", 3), ("two", 4)):
        world = small_world(seed)
        for k in range(16):
            dy, dx = 40 + k // 2, 50 + k
            rows.append((cam, dt.datetime(2016, 1, 1) + dt.timedelta(days=25 * k), as_ppm(world[dy : dy + 192, dx : dx + 256])))
    rows.append(("one", dt.datetime(2016, 1, 2), b"broken"))
    files = spark.createDataFrame(rows, "cam string, ts timestamp_ntz, content binary")
    places, views, measured = archive.archive(files, width=256, height=192, screen={"least_std": 10.0})
    got = places.orderBy("cam", "ts").collect()
    assert {r["mode"] for r in got} == {"registered"} and len(got) >= 28 and {(r["cam"], r["view"]) for r in views.collect()} == {("one", 0), ("two", 0)}
    for r in got:
        k = (r["ts"] - dt.datetime(2016, 1, 1)).days // 25
        t = np.array(r["t"]).reshape(2, 3)
        assert np.allclose(t[:, :2], np.eye(2), atol=0.005) and np.allclose(t @ [128, 96, 1], [128 + k, 96 + k // 2], atol=0.6)
    assert sum(r["anchor"] for r in got) == 2
    cells = measured.toPandas()
    assert (cells.groupby(["cam", "ts"]).size() == 8 * 10).all() and cells.edge_corr.min() > 0.8
    inner = cells[(cells.br == 4) & (cells.bc == 5)]
    assert inner.valid.all() and inner.groupby("cam").g.std().max() < 1.5 and (~cells[cells.bc == 0].valid).any()
    blocks.write_cubes(measured.select(*(f.split()[0] for f in blocks.SCHEMA.split(", "))), f"file://{tmp_path}/cubes")
    assert blocks.read_cubes(spark, str(tmp_path / "cubes")).count() == len(cells)


def test_archive_without_a_view_is_measured_in_place(spark):
    from landsight.plans import archive

    rows = [("c", dt.datetime(2016, 1, 1) + dt.timedelta(days=25 * k), as_ppm(small_world(seed=10 + k)[:192, :256])) for k in range(8)]
    places, _, measured = archive.archive(spark.createDataFrame(rows, "cam string, ts timestamp_ntz, content binary"), width=256, height=192, screen={"least_std": 10.0})
    got = places.collect()
    assert {r["mode"] for r in got} == {"in_place"} and len(got) == 8 and sum(r["anchor"] for r in got) == 1
    assert measured.where("valid").select("ts").distinct().count() == 8


def test_infrared_blocks_and_fractions(spark):
    from landsight.operators import regions
    from landsight.plans import network

    ir = np.zeros((48, 72, 3))
    ir[:, 24:48] = 90.0
    rows = [("a", 1, as_ppm(ir), [1.0, 0.0, 24.0, 0.0, 1.0, 0.0]), ("a", 2, b"broken", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]), ("a", 3, as_ppm(ir), None)]
    got = images.infrared_blocks(spark.createDataFrame(rows, "cam string, frame int, content binary, t array<double>"), ["cam", "frame"], 72, 48).collect()
    assert {(r["frame"], r["br"], r["bc"], r["ir"], r["valid"]) for r in got} == {(1, i, j, v, ok) for i in (0, 1) for j, v, ok in ((0, None, False), (1, 0.0, True), (2, 90.0, True))}
    px = spark.createDataFrame([(0, y, x, x < 24, y >= 36) for y in range(48) for x in range(48)], "view int, y int, x int, veg boolean, bad boolean")
    f = regions.block_fractions(px, ["view"])
    assert {tuple(r) for r in f.collect()} == {(0, i, j, float(j == 0), 0.5 * i) for i in (0, 1) for j in (0, 1)}
    b = spark.createDataFrame([(0, k, dt.datetime(2020, 1, 1) + dt.timedelta(days=k), i, j, 50.0, 60.0, 40.0, True, True) for k in range(40) for i in (0, 1) for j in (0, 1, 2)], "view int, frame int, ts timestamp, br int, bc int, r double, g double, b double, valid boolean, clear boolean")
    stats = {(r["br"], r["bc"]): (r["veg_frac"], r["bad_frac"]) for r in network.block_stats(b, ["view"], fractions=f).collect()}
    assert stats == {(i, j): ((float(j == 0), 0.5 * i) if j < 2 else (0.0, 0.0)) for i in (0, 1) for j in (0, 1, 2)}
    assert {(r["veg_frac"], r["bad_frac"]) for r in network.block_stats(b, ["view"]).collect()} == {(1.0, 0.0)}


def test_study_comparisons(spark):
    df = sample_frame(spark).withColumn("cam", F.when(F.col("site") == "a", 1).otherwise(2))
    df = df.withColumn("auto_g", F.col("x")).withColumn("nir_g", F.when((F.col("cam") == 1) | (F.dayofyear("date") < 60), F.col("x")))
    sets = {"main": ({"season": [], "camera": ["auto_g"]}, None, 0), "nir": ({"season": [], "ndvi": ["nir_g"]}, "nir_g", 150), "hand": ({"hand": ["hand_g"]}, "hand_g", 1)}
    got = {(r["comparison"], r["set"], r["cam"]): r["n"] for r in modelling.study(df, ["cam"], sets).collect()}
    assert got == {("main", s, c): 200 for s in ("season", "camera") for c in (1, 2)} | {("nir", s, 1): 200 for s in ("season", "ndvi")}
    assert set(modelling.COMPARISONS) == {"main", "hand", "nir", "nir_hand", "camera_only"} and len(modelling.STUDY_SETS) == 7
