"""Trackers and stereo: plain folds, streams against replay, and scenes whose answer is known."""

import math
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import DATA
from pyspark.sql import Window
from pyspark.sql import functions as F

from stereoloom.operators import camera_tracks, stereo, tracking
from stereoloom.plans import queries_tracks, scenes


@pytest.fixture(scope="module")
def frames(spark):
    return queries_tracks.frames_with_features(spark, DATA).filter("scan_id < 6").cache()


def correlation(a, b):
    a, b = [x - sum(a) / len(a) for x in a], [x - sum(b) / len(b) for x in b]
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n > 1e-9 else 0.0


def tracks_by_fold(rows, reciprocal=False, anchors=(), recent=4, least=3):
    """The tracker's rules feature by feature, all frames kept, looking only at those that may still match."""
    def world(f, x):
        p = np.array(f["pose"]).reshape(4, 4)
        e = [(x["u"] - f["cx"]) / f["fx"] * x["depth"], (f["cy"] - x["v"]) / f["fy"] * x["depth"], -x["depth"]]
        return p[:3, :3] @ e + p[:3, 3]

    def place(f, w):
        p = np.array(f["pose"]).reshape(4, 4)
        e = p[:3, :3].T @ (w - p[:3, 3])
        if e[2] >= -1e-4:
            return None
        u, v = f["cx"] - f["fx"] * e[0] / e[2], f["cy"] + f["fy"] * e[1] / e[2]
        return (u, v) if -28 <= u < f["width"] + 28 and -28 <= v < f["height"] + 28 else None

    def best(x, at, others):
        s = sorted(((correlation(x["patch"], y["patch"]), -i) for i, y in enumerate(others) if (y["u"] - at[0]) ** 2 + (y["v"] - at[1]) ** 2 <= 784), reverse=True)
        if not s or s[0][0] < 0.7 or (len(s) > 1 and s[1][0] > 0 and s[1][0] / s[0][0] > 0.9):
            return None
        return others[-s[0][1]]

    kept, done, count = [], [], 0
    for f in rows:
        f = f.asDict() | {"features": [x.asDict() | {"track": None, "frame": f.frame_id} for x in f.features]}
        if not f["features"]:
            continue
        given = set()
        for old in kept:
            for x in old["features"]:
                at = place(f, world(old, x))
                y = best(x, at, [y for y in f["features"] if y["track"] is None]) if at else None
                if y is None:
                    continue
                if reciprocal:
                    if x["track"] in given or np.linalg.norm(world(f, y) - world(old, x)) >= max(0.08, 0.04 * x["depth"]):
                        continue
                    back = place(old, world(f, y))
                    if back is None or best(y, back, old["features"]) is not x:
                        continue
                if x["track"] is None:
                    x["track"], count = count, count + 1
                y["track"] = x["track"]
                given.add(x["track"])
        kept.append(f)
        done.append(f)
        loose = [k for k in kept if k["frame_id"] not in anchors]
        if len(loose) > recent:
            kept.remove(loose[0])
    found = [(x["frame"], x["track"], x["id"]) for f in done for x in f["features"] if x["track"] is not None]
    size = {t: sum(1 for _, o, _ in found if o == t) for _, t, _ in found}
    return sorted(x for x in found if size[x[1]] >= least)


@pytest.mark.parametrize("options", [{}, {"reciprocal": True}, {"reciprocal": True, "anchors": frozenset([0, 12])}], ids=["plain", "reciprocal", "anchors"])
def test_feature_tracker_equals_a_plain_fold(spark, frames, options):
    some = frames.filter("scan_id < 2")
    rows = some.orderBy("frame_id").collect()
    want = sorted((s, *x) for s in (0, 1) for x in tracks_by_fold([r for r in rows if r.scan_id == s], **options))
    got = sorted((r.scan_id, r.frame_id, r.track_id, r.feature_id) for r in tracking.feature_tracker(some, **options).collect())
    assert got == want and len(got) > 500


def test_feature_tracks_follow_points_of_the_scene(spark, frames):
    """A track's features are one place of the plane: their world points lie within a few centimetres."""
    found = tracking.feature_tracker(frames, reciprocal=True).join(frames.select("scan_id", "frame_id", "pose", "fx", "fy", "cx", "cy"), ["scan_id", "frame_id"]).collect()
    places = {}
    for r in found:
        p = np.array(r.pose).reshape(4, 4)
        places.setdefault((r.scan_id, r.track_id), []).append(p[:3, :3] @ [(r.u - r.cx) / r.fx * r.depth, (r.cy - r.v) / r.fy * r.depth, -r.depth] + p[:3, 3])
    spread = [np.linalg.norm(np.array(x) - np.mean(x, axis=0), axis=1).max() for x in places.values()]
    assert len(spread) > 200 and np.mean(np.array(spread) < 0.06) > 0.9


def test_feature_tracker_bounds_and_odd_rows(spark, frames):
    some = frames.filter("scan_id = 0")
    whole = tracking.feature_tracker(some)
    few = tracking.feature_tracker(some, least=1, per_frame=10)
    assert few.groupBy("frame_id").count().agg(F.max("count")).first()[0] <= 10
    last = tracking.feature_tracker(some, least=1, per_scan=25)
    assert last.count() == 25 and last.agg(F.min("frame_id")).first()[0] > whole.agg(F.min("frame_id")).first()[0]
    assert tracking.feature_tracker(some.withColumn("features", F.lit(None).cast(some.schema["features"].dataType))).count() == 0
    assert tracking.feature_tracker(some.limit(0)).count() == 0
    report = tracking.tracker_report(some).collect()
    assert all(r.looked == r.hidden + r.none + r.low + r.ambiguous + r.refused + r.matched for r in report) and sum(r.matched for r in report) > 100


def test_feature_tracker_stream_equals_replay_over_a_restart(spark, frames, tmp_path):
    """Files arrive one a trigger; the query is stopped in the middle and goes on from its checkpoint."""
    own = frames.filter("scan_id < 3").orderBy("frame_id")
    rows = own.collect()
    schema = own.schema
    source, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    os.makedirs(source)

    def arrive(numbers):
        for k in numbers:  # frame k of each scan
            some = spark.createDataFrame([r for r in rows if r.frame_id % queries_tracks.FRAMES == k], schema).toArrow()
            pq.write_table(some, source / f"{k:03d}.parquet")
            os.utime(source / f"{k:03d}.parquet", (1_000_000 + k, 1_000_000 + k))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        tracking.feature_tracker_stream(stream, reciprocal=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    arrive(range(5))
    run()
    arrive(range(5, queries_tracks.FRAMES))
    run()
    key = lambda df: sorted((r.scan_id, r.frame_id, r.track_id, r.feature_id, r.u) for r in df.collect())
    got = key(spark.read.parquet(out))
    assert got == key(tracking.feature_tracker(own, least=1, reciprocal=True)) and len(got) > 500


def drift(df, views):
    """Spread in metres of a track's places on the known plane."""
    d = scenes.true_depth(df.join(views.drop("luma"), ["scan_id", "frame_id"]))
    ray = [(F.col("u") - F.col("cx")) / F.col("fx"), (F.col("cy") - F.col("v")) / F.col("fy"), F.lit(-1.0)]
    world = [sum((F.col("pose")[4 * r + c] * ray[c] for c in (1, 2)), F.col("pose")[4 * r] * ray[0]) * F.col("truth") + F.col("pose")[4 * r + 3] for r in range(3)]
    d = d.select("scan_id", "track_id", *[w.alias(c) for w, c in zip(world, "xyz")])
    return d.groupBy("scan_id", "track_id").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("spread"), F.count("*").alias("n"))


def test_camera_tracks_stay_and_what_moves_by_itself_goes(spark):
    views = queries_tracks.camera_views(spark, DATA).filter("scan_id < 8").cache()
    found = drift(camera_tracks.camera_tracks(views), views).agg(F.count("*").alias("n"), F.avg((F.col("spread") < 0.02).cast("int")).alias("good"), F.avg("n").alias("length")).first()
    assert found.n > 1000 and found.good > 0.98 and found.length > 5
    loose = camera_tracks.camera_tracks(views, rules=camera_tracks.TrackRules(off_line=1e9))
    moved = drift(loose, views).filter("spread >= 0.02").count()
    kept = drift(camera_tracks.camera_tracks(views), views).filter("spread >= 0.02").count()
    assert moved > 3 * max(kept, 1)  # the line of sight takes what follows the visitor
    r = camera_tracks.camera_track_report(views).agg(*[F.sum(c).alias(c) for c in ("followed", "way_back", "off_line", "new")]).first()
    assert r.off_line > 0 and r.followed > 5 * r.off_line


def test_most_tracks_of_a_still_scene_go_on(spark):
    """Without a visitor nine of ten followed tracks pass all gates."""
    views = scenes.views(spark, DATA, 12, 160, 120, step=0.02, fine=4.0).filter("scan_id < 4")
    r = camera_tracks.camera_track_report(views).agg(*[F.sum(c).alias(c) for c in ("followed", "way_back", "unlike", "off_line")]).first()
    assert r.followed / (r.followed + r.way_back + r.unlike + r.off_line) >= 0.9


def test_windows_are_the_bilinear_values_inside_and_beyond_the_edge():
    r = np.random.default_rng(3)
    image, at, reach = r.random((24, 31)), np.concatenate([r.uniform(-12, 40, (60, 2)), r.uniform(7, 15, (20, 2)), [[7, 7], [22.999, 15.999], [30, 23]]]), 7
    du, dv = np.meshgrid(np.arange(-reach, reach + 1), np.arange(-reach, reach + 1))
    u, v = np.clip(at[:, 0, None, None] + du, 0, 31 - 1.001), np.clip(at[:, 1, None, None] + dv, 0, 24 - 1.001)
    i, j = v.astype(int), u.astype(int)
    a, b = u - j, v - i
    plain = (image[i, j] * (1 - a) + image[i, j + 1] * a) * (1 - b) + (image[i + 1, j] * (1 - a) + image[i + 1, j + 1] * a) * b
    for some in (slice(None), slice(60, 81), slice(0, 0)):
        assert np.allclose(camera_tracks._around(image, at[some], reach), plain[some], rtol=0, atol=1e-12)


def test_points_are_followed_through_a_known_shift():
    random = np.random.default_rng(3)
    s, t = np.meshgrid(np.arange(160) / 40.0, np.arange(120) / 40.0)
    e = random.normal(size=72) / 8
    a, b = scenes.texture(e, s, t, 3.0) / 8 + 0.5, scenes.texture(e, s - 3.3 / 40, t + 2.6 / 40, 3.0) / 8 + 0.5
    at = camera_tracks.corners(a, set(), camera_tracks.TrackRules())
    to, ok = camera_tracks.followed(camera_tracks.pyramid(a, 3), camera_tracks.pyramid(b, 3), at, at, camera_tracks.TrackRules())
    assert ok.mean() > 0.8 and np.median(np.abs(to[ok] - at[ok] - [3.3, -2.6])) < 0.05


def test_camera_tracks_of_bad_images_and_empty_tables(spark):
    views = queries_tracks.camera_views(spark, DATA).filter("scan_id = 0")
    cut = views.withColumn("luma", F.when(F.col("frame_id") != 5, F.col("luma")))
    got = camera_tracks.camera_tracks(cut, least=1)
    ends = {r.track_id for r in got.filter("frame_id < 5").collect()} & {r.track_id for r in got.filter("frame_id > 5").collect()}
    assert not ends and got.filter("frame_id = 5").count() == 0 and got.count() > 0
    assert camera_tracks.camera_tracks(views.limit(0)).count() == 0


def test_stereo_finds_slanted_planes(spark):
    _, pairs = queries_tracks.stereo_views(spark, DATA)
    views = scenes.views(spark, DATA, 4, 64, 48).filter("scan_id < 6").cache()
    maps = stereo.depth_maps(views, pairs).cache()
    checked = stereo.confirmed(maps, views, pairs)
    for df, share in ((maps, 0.85), (checked, 0.97)):
        e = F.abs(F.col("depth") / F.col("truth") - 1)
        r = scenes.true_depth(df.join(views.drop("luma"), ["scan_id", "frame_id"])).agg(F.count("*").alias("n"), F.percentile(e, F.lit(0.5)).alias("middle"), F.avg((e < 0.01).cast("int")).alias("good")).first()
        assert r.n > 3000 and r.middle < 0.005 and r.good > share
    again = stereo.depth_maps(views.repartition(3), pairs)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, maps.collect()))


def test_stereo_normals_match_the_plane(spark):
    views, pairs = queries_tracks.stereo_views(spark, DATA)
    views = views.filter("scan_id < 3").cache()
    rows = stereo.depth_maps(views, pairs).join(views.select("scan_id", "frame_id", "pose", "normal"), ["scan_id", "frame_id"]).collect()
    off = []
    for r in rows:
        turn = np.array(r.pose).reshape(4, 4)[:3, :3] @ np.diag([1, -1, -1])
        off.append(np.degrees(np.arccos(np.clip(abs((turn @ [r.nx, r.ny, r.nz]) @ r.normal), -1, 1))))
    assert np.median(off) < 10


def test_stereo_needs_two_sources_with_a_baseline(spark):
    views, pairs = queries_tracks.stereo_views(spark, DATA)
    views = views.filter("scan_id = 0").cache()
    assert stereo.depth_maps(views, pairs.filter("abs(frame_id - source_id) = 1 and frame_id = 0")).count() == 0
    assert stereo.depth_maps(views.withColumn("luma", F.lit(None).cast("binary")), pairs).count() == 0
    assert stereo.depth_maps(views.limit(0), pairs).count() == 0
    same = views.withColumn("pose", F.first("pose").over(Window.partitionBy("scan_id").orderBy("frame_id")))
    assert stereo.depth_maps(same, pairs).count() == 0


def test_costs_are_those_of_a_plain_warp(spark):
    """Every sample of a window is sent through the plane by itself; views pass as Arrow rows, without a pandas frame for each."""
    rows = scenes.views(spark, DATA, 4, 48, 36).filter("scan_id = 1").orderBy("frame_id").collect()
    view, *others = [stereo.View.of(r.asDict()) for r in rows]
    sweep = stereo.PlaneSweep(view, others, stereo.StereoRules(rounds=0), 1)
    at = np.flatnonzero(sweep.active)[::7]
    depth, normal = np.linspace(1.2, 3.0, len(at)), np.tile([0.1, -0.05, -0.99], (len(at), 1))
    got, seen = sweep.costs(at, depth, normal), 0
    for k, (p, d) in enumerate(zip(at, depth, strict=True)):
        for s, o in enumerate(others):
            u, v = sweep.u[p] + stereo.REACH[:, 0], sweep.v[p] + stereo.REACH[:, 1]
            ray = view.rays(u.astype(float), v.astype(float))
            far = (normal[k] @ sweep.ray[p]) * d / (ray @ normal[k])
            eye = ((ray * far[:, None]) @ view.axes.T + view.centre - o.centre) @ o.axes
            x, y = o.fx * eye[:, 0] / eye[:, 2] + o.cx, o.fy * eye[:, 1] / eye[:, 2] + o.cy
            if x.min() < 0 or y.min() < 0 or x.max() >= o.luma.shape[1] - 1 or y.max() >= o.luma.shape[0] - 1:
                assert got[k, s] == stereo.INVALID
                continue
            i, j = y.astype(int), x.astype(int)
            a, b = x - j, y - i
            value = (o.luma[i, j] * (1 - a) + o.luma[i, j + 1] * a) * (1 - b) + (o.luma[i + 1, j] * (1 - a) + o.luma[i + 1, j + 1] * a) * b
            w, own = sweep.weight[p], view.luma[v, u]
            mean, other = (w * own).sum() / w.sum(), (w * value).sum() / w.sum()
            same = (w * (own - mean) * (value - other)).sum() / np.sqrt((w * (own - mean) ** 2).sum() * (w * (value - other) ** 2).sum())
            assert abs(got[k, s] - (1 - same)) < 1e-6
            seen += 1
    assert seen > 80
    assert "MapInPandas" not in stereo.depth_maps(*queries_tracks.stereo_views(spark, DATA))._jdf.queryExecution().executedPlan().toString()


def test_ways_back_are_looked_for_once_a_pair_of_frames(frames, monkeypatch):
    """Not once a match: a frame and each kept one ask twice for what is near."""
    asked, near = [], tracking._nearby
    monkeypatch.setattr(tracking, "_nearby", lambda *a: asked.append(1) or near(*a))
    fold, rows = tracking.TrackFold(reciprocal=True), [r.asDict(recursive=True) for r in frames.filter("scan_id = 0").orderBy("frame_id").collect()]
    for row in rows:
        fold.add(tracking.TrackedFrame.of(row))
    assert fold.next_track > 20 and len(asked) <= 2 * tracking.RECENT * len(rows)


def test_points_beside_the_other_camera_confirm_nothing(spark):
    """A point nearly in the plane of the other camera's centre is seen far outside any integer's range there."""
    pose = lambda z: [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, z, 0.0, 0.0, 0.0, 1.0]
    views = spark.createDataFrame([(0, 0, pose(0.0), 40.0, 40.0, 24.0, 18.0), (0, 1, pose(-1.9999999999999), 40.0, 40.0, 24.0, 18.0)], "scan_id long, frame_id long, pose array<double>, fx double, fy double, cx double, cy double")
    maps = spark.createDataFrame([(0, f, 9, 9, 2.0) for f in (0, 1)], "scan_id long, frame_id long, u int, v int, depth double")
    pairs = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "scan_id long, frame_id long, source_id long")
    assert stereo.confirmed(maps, views, pairs, least=1).count() == 0
