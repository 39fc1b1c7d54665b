"""Plans and results that must hold on larger tables than the test ones."""

import functools

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from stereoloom import catalog
from stereoloom.operators import fusion, stereo


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_of_neighbour_frames_meet_without_a_broadcast(spark):
    """A small file of vectors gives 64 pixels a vector: many times what the planner takes the side for."""
    p = plan(catalog.queries()["j23_depth_cross_check"](spark, DATA))
    assert "Broadcast" not in p and "SortMergeJoin" in p


def test_room_images_are_drawn_once(spark):
    """The refinement reads its frames for their order and for the fit; the drawing must not run again for each."""
    p = plan(catalog.queries()["c11_surface_refinement"](spark, DATA))
    assert "FlatMapGroupsInPandas" not in p and p.count("Scan parquet") == 2


def test_stereo_views_are_drawn_once(spark):
    assert "FlatMapGroupsInPandas" not in plan(catalog.queries()["c17_depth_maps"](spark, DATA))


def test_costs_of_one_view_are_those_of_all():
    """Windows that leave a view, or lie behind it, are told by their corners; one view asked for gives that view's column."""
    r = np.random.default_rng(0)

    def view(x, size):
        pose = np.eye(4)
        pose[0, 3] = x
        return stereo.View(r.random(size), 40.0, 42.0, size[1] / 2 + 10 * x, size[0] / 2 + x, pose)

    m = stereo.PlaneSweep(view(0.0, (36, 48)), [view(0.2, (36, 48)), view(-0.2, (30, 40)), view(2.5, (36, 48))], stereo.StereoRules(), 1)
    at = r.integers(0, len(m.u), 500)
    depth, normal = r.uniform(0.2, 6, 500), r.normal(size=(500, 3)) - [0, 0, 2]
    normal /= np.linalg.norm(normal, axis=1, keepdims=True)
    every = m.costs(at, depth, normal)
    assert all((m.costs(at, depth, normal, only=s)[:, 0] == every[:, s]).all() for s in range(3))
    for n, k in enumerate(at):
        offset, along = normal[n] @ m.ray[k] * depth[n], m.rays[k] @ normal[n]
        for s, other in enumerate(m.others):
            inside = offset < -1e-6 and (along < -1e-9).all()
            if inside:
                x = (m.rays[k] * (offset / along)[:, None]) @ (other.axes.T @ m.view.axes).T + other.axes.T @ (m.view.centre - other.centre)
                u, v = other.fx * x[:, 0] / x[:, 2] + other.cx, other.fy * x[:, 1] / x[:, 2] + other.cy
                inside = ((x[:, 2] > 1e-6) & (u >= 0) & (v >= 0) & (u < other.luma.shape[1] - 1) & (v < other.luma.shape[0] - 1)).all()
            if not inside:
                assert every[n, s] == stereo.INVALID
                continue
            i, j = v.astype(int), u.astype(int)
            a, b, l = u - j, v - i, other.luma
            value = (l[i, j] * (1 - a) + l[i, j + 1] * a) * (1 - b) + (l[i + 1, j] * (1 - a) + l[i + 1, j + 1] * a) * b
            w, c = m.weight[k] / m.total[k], m.view.luma[m.v[k] + stereo.REACH[:, 1], m.u[k] + stereo.REACH[:, 0]]
            off, own = value - w @ value, c - w @ c
            assert abs(every[n, s] - (1 - (w * off) @ own / np.sqrt((w @ off**2) * (w @ own**2)))) < 1e-6


def test_depth_maps_are_dealt_by_number(spark):
    """The exchange before the search is one that the planner may not size by bytes."""
    p = plan(catalog.queries()["c17_depth_maps"](spark, DATA))
    assert "REPARTITION_BY_NUM" in p[p.index("MapInPandas") :].split("Join")[0]


def test_tiles_that_all_overlap_are_not_all_met(spark):
    """Copies, ties, points on borders, in corners of a tile, far off and not finite get what a look at every tile gives; where tiles lie close few points need that look."""
    r = np.random.default_rng(3)
    lattice = [(i, 0.1 * (i % 5), 0.1 * (i // 5 % 5), 0.1 * (i // 25)) for i in range(50)]
    tiles = spark.createDataFrame([*lattice, (90, 0.0, 0.0, 0.0), (91, 7.0, 7.0, 7.0), (92, None, 1.0, 1.0)], "tile_id long, ox double, oy double, oz double")
    places = [*(r.uniform(-0.3, 0.7, (300, 3)).tolist()), [0.05, 0.05, 0.05], [0.15, 0.1, 0.05], [7.14, 7.14, 7.14], [7.15, 7.0, 7.0], [6.85, 7.0, 7.0], [9e9, 0.0, 0.0], [float("nan"), 0.0, 0.0], [None, 0.0, 0.0]]
    points = spark.createDataFrame([(str(i % 2), i, *p) for i, p in enumerate(places)], "scan_id string, ordinal long, x double, y double, z double")
    names = ("scan_id", "ordinal", "tile_id", "ox", "oy", "oz")
    got = {r[:2]: r[2:] for r in fusion.tile_of(points, tiles, 0.3).select(*names).collect()}
    want = {r[:2]: r[2:] for r in fusion._tile_by_cells(points, tiles, 0.3).select(*names).collect()}
    assert len(got) == len(places) and {k: v for k, v in got.items() if v[0] is not None} == want


def test_few_points_meet_every_tile_of_their_cells(spark, monkeypatch):
    r = np.random.default_rng(4)
    cloud = spark.createDataFrame([("s", i, *map(float, x)) for i, x in enumerate(r.normal(0, 0.12, (1500, 3)))], "scan_id string, ordinal long, x double, y double, z double")
    tiles = cloud.select(F.col("ordinal").alias("tile_id"), *[(F.col(c) + 0.001).alias(f"o{c}") for c in "xyz"])
    whole, met = fusion._tile_by_cells, []
    monkeypatch.setattr(fusion, "_tile_by_cells", lambda points, *rest: met.append(points.count()) or whole(points, *rest))
    assert fusion.tile_of(cloud, tiles, 0.3).filter("tile_id is not null").count() == 1500
    assert met and met[0] < 20


def test_last_scene_of_few_vectors_is_complete(spark, tmp_path):
    """Scenes of one to eight vectors still have points to solve and tracks to hold out; whole scenes stay a point a vector."""
    from stereoloom.plans import scenes

    e = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(80)
    vectors = [r.embedding for r in e.orderBy("vec_id").collect()]
    sizes = [1, 2, 3, 4, 5, 7, 8, 72]
    rows = [(72 * s + i, vectors[(7 * s + i) % len(vectors)], 0) for s, n in enumerate(sizes) for i in range(n)]
    spark.createDataFrame(rows, e.schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = {r.scan_id: r.tracks for r in scenes.disturbed_tracks(spark, str(tmp_path)).groupBy("scan_id").agg(F.collect_set("track_id").alias("tracks")).collect()}
    assert sorted(seen[7]) == list(range(504, 576)) and all(len(seen[s]) >= min(21 * n, 72) for s, n in enumerate(sizes))
    got = catalog.queries()["c10_noisy_adjustment"](spark, str(tmp_path)).collect()
    assert sorted(r.scan_id for r in got) == list(range(8)) and all(r.accepted and r.better and r.near_noise for r in got)


def test_matches_of_a_crowded_frame_stay_in_their_task(spark):
    """Pairs of points of one frame grow with its square: only the best of each point may leave a task. Copies, ties and unsound rows as in a plain search."""
    from stereoloom.operators import spatial

    for name in ("j9_feature_match", "j10_reciprocal_match"):
        p = plan(catalog.queries()[name](spark, DATA))
        assert "FlatMapCoGroupsInPandas" in p and "Join" not in p
    r = np.random.default_rng(5)
    rows = []
    for i in range(160):
        patch = r.normal(size=4)
        patch = (patch / np.linalg.norm(patch)).round(3).tolist()
        if i >= 80:
            patch = rows[i - 80][4]  # a copy, so that correlations are equal
        rows.append((int(i % 3), i, float(r.uniform(-3, 3)), float(r.uniform(-3, 3)), patch))
    rows += [(0, 900, 0.0, 0.0, None), (0, 901, float("inf"), 0.0, [1.0, 0.0, 0.0, 0.0]), (0, 902, float("nan"), 0.0, [1.0, 0.0, 0.0, 0.0]), (0, 903, 0.0, 0.0, [None, 1.0, 0.0, 0.0]), (None, 904, 0.0, 0.0, [1.0, 0.0, 0.0, 0.0])]
    own = spark.createDataFrame(rows, "frame_id int, id int, u double, v double, patch array<double>")
    good = [x for x in rows if x[1] < 900]
    for mutual in (True, False):
        got = {(x.a, x.b): (x.ncc, x.second) for x in spatial._best_matches(own.filter("id % 2 = 0"), own.filter("id % 2 = 1"), "frame_id", ("u", "v"), 1.0, mutual).collect()}
        score = {(a[1], b[1]): functools.reduce(lambda s, xy: s + xy[0] * xy[1], zip(a[4], b[4], strict=True), 0.0) for a in good for b in good if a[1] % 2 == 0 and b[1] % 2 == 1 and a[0] == b[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 1}
        want = {}
        for a in {k[0] for k in score}:
            of_a = sorted((-s, k[1]) for k, s in score.items() if k[0] == a)
            b = of_a[0][1]
            if not mutual or min((-s, k[0]) for k, s in score.items() if k[1] == b)[1] == a:
                want[a, b] = (-of_a[0][0], -of_a[1][0] if len(of_a) > 1 else -1.0)
        assert got == want and len(want) > 10


def test_greedy_choices_need_no_python_group_a_frame(spark):
    """A frame's candidates are few and frames many: a Python group for each of them costs far more than the choice."""
    for name in ("j5_reference_views", "j13_source_views"):
        assert "InPandas" not in plan(catalog.queries()[name](spark, DATA))


def test_all_trials_at_once_find_what_one_after_another_finds():
    from stereoloom.operators import kernels

    for seed in range(12):
        r = np.random.default_rng(seed)
        a = r.uniform(-1, 1, (60, 3)) * (1.0 if seed % 3 else [1.0, 0.01, 0.01])  # some sets are nearly in line
        b = a + [0.05, 0.0, 0.02] + np.where(np.arange(60)[:, None] % 3 == 0, r.normal(0, 0.5, (60, 3)), r.normal(0, 0.008, (60, 3)))
        fit, best, random = np.flatnonzero(np.arange(60) % 5 > 0), np.empty(0, int), np.random.default_rng(seed)
        for _ in range(64):
            three = random.choice(fit, 3, replace=False)
            around = b[three] - b[three].mean(0)
            if max(np.linalg.norm(np.cross(around[i], around[j])) for i, j in ((0, 1), (0, 2), (1, 2))) > 0.01:
                hit = fit[kernels._apart(a[fit], b[fit], kernels.horn(a[three], b[three])) < 0.025]
                best = hit if len(hit) > len(best) else best
        assert (fit[kernels._most_inliers(a, b, fit, np.random.default_rng(seed), 64, 0.025)] == best).all()


def test_tracker_holds_few_frames_as_objects(spark, monkeypatch):
    """A batch of thousands of frames is read a few at a time; the rows are those of the whole batch."""
    import pyarrow as pa

    from stereoloom.operators import tracking

    whole = pa.RecordBatch.from_pylist([{"frame_id": i, "features": [{"id": i, "patch": bytes(81)}] * 3} for i in range(50)])

    class Seen:
        num_rows, sizes = 50, []

        def slice(self, at, n):
            self.sizes.append(n)
            return whole.slice(at, n)

    assert list(tracking._rows_of(Seen())) == whole.to_pylist() and max(Seen.sizes) == tracking.FEW
    frames = spark.createDataFrame([], f"scan_id long, {tracking.FRAME}")
    assert "MapInArrow" in plan(tracking.tracker_report(frames)) and "MapInPandas" not in plan(tracking.tracker_report(frames))


def test_machines_are_fed_only_what_they_read(spark):
    """Columns that a machine does not look at are neither shuffled nor turned into Python objects; rows are the same without the rule."""
    from stereoloom.streaming import state

    class Whole(state.MotionEstimator):
        READS = ()

    own = spark.createDataFrame([(i % 2, i * 0.03 + (i > 40), float(i % 7), float(i % 5), 0.0, 0.1 * i, "wide") for i in range(80)], "scan_id int, timestamp double, x double, y double, z double, yaw double, unread string")
    narrow, whole = (state.replay(own, m) for m in (state.MotionEstimator, Whole))
    assert "unread" not in narrow._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0] and sorted(narrow.collect()) == sorted(whole.collect())


def test_scans_of_few_points_meet_without_copies(spark, monkeypatch):
    """A small scan needs no row for each neighbouring cell; both ways give all pairs, also at the rim, of copies and beside points off the grid."""
    from stereoloom.operators import spatial

    r = np.random.default_rng(6)
    rows = [(s, i, *map(float, p)) for s, n in ((0, 3), (1, 40), (2, 90)) for i, p in enumerate(r.normal(0, 0.4, (n, 3)))]
    rows += [(1, 50, *rows[5][2:]), (1, 51, 0.0, 0.0, 0.0), (1, 52, 0.25, 0.0, 0.0), (1, 53, float("nan"), 0.0, 0.0), (1, 54, 1e12, 0.0, 0.0), (1, 55, None, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0), (None, 2, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "scan_id int, id int, x double, y double, z double")
    sound = [x for x in rows if x[0] is not None and x[2] is not None and abs(x[2]) < 1e9]
    want = {(p[0], p[1], q[1], p[2], q[2]) for p in sound for q in sound if p[0] == q[0] and p[1] < q[1] and sum((a - b) ** 2 for a, b in zip(p[2:], q[2:], strict=True)) <= 0.0625}
    for few in (512, 50, 2):
        monkeypatch.setattr(spatial, "FEW", few)
        out = spatial.near_pairs(df, 0.25, ("x",))
        assert ("Generate" in plan(out)) == (few < 512)
        assert sorted((x.scan_id, x.a, x.b, x.a_x, x.b_x) for x in out.collect()) == sorted(want)
    assert (1, 51, 52) in {w[:3] for w in want}


def test_prepared_records_need_no_flag_of_all(spark):
    """Whether all records are corrected is not asked, so the merge runs once and meets no other row."""
    from stereoloom.operators import spatial

    raw = spark.createDataFrame([(i, float(i)) for i in range(6)], "id int, v double")
    out = spatial.corrected_records(raw, raw.filter("id > 3").withColumn("v", F.lit(-1.0)), ["v"])
    assert plan(out).count("Join") == 1 and sorted(out.collect()) == [(i, -1.0 if i > 3 else float(i), i > 3) for i in range(6)]
