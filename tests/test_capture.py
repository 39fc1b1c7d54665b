"""Sequential and NumPy oracles, adversarial rows, metamorphic checks of the capture operators."""

import math
import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from stereoloom.functions import capture as cp
from stereoloom.functions import geometry as g
from stereoloom.functions import voxels as vx
from stereoloom.operators import fusion, graph, kernels, metrics, raster, sampling, sequence, spatial, splats
from stereoloom.plans import adapters as ad
from stereoloom.plans import pipelines as pl


def points(spark, rows):
    return spark.createDataFrame(rows, "scan_id string, ordinal long, x double, y double, z double, score double")


def cloud(n, seed=3, spread=1.0, scan="a"):
    r = random.Random(seed)
    return [(scan, i, r.uniform(-spread, spread), r.uniform(-spread, spread), r.uniform(-spread, spread), r.uniform(0.01, 3)) for i in range(n)]


def test_voxel_keys_at_edges(spark):
    rows = [("a", i, v, 0.0, -0.05, 1.0) for i, v in enumerate([-0.1, 0.0, 0.1, -1e-9, 104857.5, 104857.7, -104857.6, float("nan"), float("inf")])]
    rows.append(("a", 9, None, 0.0, 0.0, 1.0))
    got = {r.ordinal: (r.key, r.i) for r in points(spark, rows).select("ordinal", vx.voxel_key("x", "y", "z", 0.1).alias("key"), vx.cell_index("x", 0.1).alias("i")).collect()}
    for o, v in enumerate([-0.1, 0.0, 0.1, -1e-9]):
        assert got[o][1] == math.floor(np.float32(np.float32(v) / np.float32(0.1)))
    assert got[5] == (None, None) and got[7] == (None, None) and got[8] == (None, None) and got[9] == (None, None)
    back = points(spark, rows[:4]).select("ordinal", *[c.alias(n) for c, n in zip(vx.unpack3(vx.voxel_key("x", "y", "z", 0.1)), "ijk", strict=True)]).collect()
    assert all(r.k == -1 and r.j == 0 for r in back)


def test_neighbours_at_the_rim_stay_in_the_grid(spark):
    rim = spark.range(1).select(vx.pack3(F.lit(vx.HALF - 1), F.lit(0), F.lit(-vx.HALF)).alias("key"), vx.pack3(F.lit(3), F.lit(4), F.lit(-5)).alias("inner"))
    r = rim.select(F.size(vx.neighbour_keys("key", centre=False)).alias("rim"), F.size(vx.neighbour_keys("inner", centre=False)).alias("inner"), F.size(F.array_distinct(vx.neighbour_keys("inner"))).alias("all")).first()
    assert (r.rim, r.inner, r.all) == (2 * 3 * 2 - 1, 26, 27)


def fold(rows, cap=8.0):
    x, w = 0.0, 0.0
    for v, s in rows:
        s = max(s, 0.01)
        x += (v - x) * s / (w + s)
        w = min(w + s, cap)
    return x, w


def test_exact_fusion_follows_arrival_order(spark):
    r = random.Random(5)
    rows = [("a", i, r.uniform(0, 0.1), 0.05, 0.05, r.uniform(0.5, 3)) for i in range(40)]
    random.Random(1).shuffle(rows)
    c = fusion.fuse_exact(points(spark, rows), 0.1).collect()
    x, w = fold([(p[2], p[5]) for p in sorted(rows, key=lambda p: p[1])])
    assert len(c) == 1 and c[0].mx == pytest.approx(x) and c[0].weight == pytest.approx(w) == 8.0


def test_fusions_agree_below_the_cap_and_on_any_partitioning(spark):
    rows = cloud(300)
    p = points(spark, rows)
    a = {r.key: r for r in fusion.fuse_exact(p.repartition(5), 0.5, cap=1e9).collect()}
    b = {r.key: r for r in fusion.fuse(p.repartition(3), 0.5).collect()}
    assert a.keys() == b.keys() and all(a[k].mx == pytest.approx(b[k].mx) for k in a)


def test_measured_samples_displace_inferred_ones(spark):
    p = points(spark, [(s, i, abs(x), abs(y), abs(z), w) for s, i, x, y, z, w in cloud(50, spread=0.01)]).withColumn("measured", F.col("ordinal") % 10 == 0)
    assert fusion.fuse(p, 1.0).agg(F.sum("samples")).first()[0] == 5
    assert fusion.fuse(p.withColumn("measured", F.lit(False)), 1.0).agg(F.sum("samples")).first()[0] == 50


def test_capacity_reduction_and_stratified_best_meet_their_limits(spark):
    p = points(spark, cloud(500))
    cells, size = fusion.reduce_to(fusion.fuse(p, 0.1), 0.1, 60)
    assert cells.count() <= 60 and size > 0.1
    best = sampling.stratified_best(p, 0.1, 40)
    assert best.count() <= 40
    assert sampling.stratified_best(p, 0.1, 1000).count() == 500


def test_empty_tables_give_empty_results(spark):
    p = points(spark, [])
    frames = ad.frames(spark, DATA).limit(0)
    for df in (fusion.fuse(p, 0.1), fusion.fuse_exact(p, 0.1), fusion.isolated_removed(fusion.fuse(p, 0.1)), sampling.best_per_cell(p, 0.1), sampling.stride_sample(p, 5, ["ordinal"]), spatial.radius_join(p, p, 0.1),
               spatial.neighbour_frames(frames), sequence.cumulative_travel(frames), metrics.trajectory(frames), graph.cell_components(fusion.fuse(p, 0.1)), metrics.plane_fit(p, ["scan_id"])):
        assert df.count() == 0


def test_radius_join_equals_brute_force_and_survives_a_rigid_move(spark):
    rows = cloud(200)
    p = points(spark, rows)
    got = {(r.a, r.b) for r in spatial.radius_join(p, p, 0.3).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if math.dist(a[2:5], b[2:5]) <= 0.3}
    c, s = math.cos(0.7), math.sin(0.7)
    moved = points(spark, [(k, o, c * x - s * z + 5, y - 3, s * x + c * z, w) for k, o, x, y, z, w in rows])
    assert abs(spatial.radius_join(moved, moved, 0.3).count() - len(got)) <= 2  # pairs at the rim


def test_nearest_equals_brute_force_with_far_points(spark):
    rows = cloud(60) + [("a", 60, 9.0, 9.0, 9.0, 1.0)]
    p = points(spark, rows)
    got = {(r.a, r.rank): r.b for r in spatial.nearest(p, p, 2, 0.2, rings=8, same_table=True).collect()}
    for a in rows:
        order = sorted((math.dist(a[2:5], b[2:5]), b[1]) for b in rows if b[1] != a[1])
        assert got[a[1], 1] == order[0][1] and got[a[1], 2] == order[1][1]


def test_greedy_set_equals_the_sequential_scan(spark):
    r = random.Random(8)
    for n, m in ((1, 0), (40, 30), (60, 300)):
        edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)} if n > 1 else set()
        near = {i: set() for i in range(n)}
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        order = list(range(n))
        r.shuffle(order)
        kept = set()
        for i in order:
            if not near[i] & kept:
                kept.add(i)
        nodes = spark.createDataFrame([(i, order.index(i)) for i in range(n)], "id long, rank long")
        got = graph.greedy_independent(nodes, spark.createDataFrame(list(edges), "a long, b long"))
        assert {x.id for x in got.filter("kept").collect()} == kept


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)], "a long, b long")
    nodes = spark.range(0, 64).select(F.col("id").alias("node"))
    got = {r.node: r.component for r in graph.connected_components(edges, nodes).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == i for i in (61, 62, 63))


def test_quaternion_branches_and_inverse(spark):
    r = np.random.default_rng(0)
    vectors = [*r.normal(size=(60, 3)), np.zeros(3), np.array([np.pi, 0, 0]), np.array([0, np.pi, 0]), np.array([0, 0, np.pi])]
    rows = []
    for i, v in enumerate(vectors):
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = kernels.rotation(v), r.normal(size=3)
        rows.append((i, m.reshape(-1).tolist()))
    df = spark.createDataFrame(rows, "id int, pose array<double>")
    out = df.select("id", "pose", g.quaternion("pose").alias("q"), g.rigid_inverse("pose").alias("inv"), g.is_rigid("pose").alias("ok")).collect()
    for row in out:
        q = np.array([row.q.w, row.q.x, row.q.y, row.q.z])
        assert q[0] >= 0 and np.linalg.norm(q) == pytest.approx(1, abs=1e-6) and row.ok
        w, x, y, z = q
        back = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        assert np.allclose(back, np.array(row.pose).reshape(4, 4)[:3, :3], atol=1e-6)
        assert np.allclose(np.array(row.pose).reshape(4, 4) @ np.array(row.inv).reshape(4, 4), np.eye(4), atol=1e-9)
    bad = spark.createDataFrame([(0, [1.0] * 15), (1, [float("nan")] * 16), (2, None), (3, [2.0 if i % 5 == 0 else 0.0 for i in range(16)])], "id int, pose array<double>")
    assert not any(x[0] for x in bad.select(g.is_rigid("pose")).collect())


def test_projection_undoes_unprojection(spark):
    p = ad.poses(spark, DATA).limit(50)
    k = g.Camera.of("intrinsics")
    x, y, z = g.unproject(k, "pose", F.lit(100.0), F.lit(60.0), F.lit(1.5))
    back = p.select("*", x.alias("x"), y.alias("y"), z.alias("z")).select(g.project(k, "pose", (F.col("x"), F.col("y"), F.col("z"))).alias("p")).collect()
    assert all(r.p.u == pytest.approx(100) and r.p.v == pytest.approx(60) and r.p.z == pytest.approx(1.5) for r in back)


def test_normals_survive_the_code(spark):
    r = np.random.default_rng(1).normal(size=(200, 3))
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(r)] + [(200, 0.0, 0.0, 0.0)], "i int, x double, y double, z double")
    out = {q.i: q for q in df.select("i", "x", "y", "z", vx.oct_encode("x", "y", "z").alias("c"), vx.oct_decode(vx.oct_encode("x", "y", "z")).alias("d")).collect()}
    assert out[200].c == 0 and out[200].d is None
    assert all(out[i].d.x * v[0] + out[i].d.y * v[1] + out[i].d.z * v[2] > 0.998 for i, v in enumerate(r))


def test_hash_rank_is_splitmix(spark):
    def split(x):
        m = (1 << 64) - 1
        x = (x + 0x9E3779B97F4A7C15) & m
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        x ^= x >> 31
        return x - (1 << 64) if x >> 63 else x

    assert all(r[1] == split(r[0]) for r in spark.range(50).select("id", cp.hash_rank("id")).collect())


def test_view_span_follows_the_fold(spark):
    r = np.random.default_rng(4).normal(size=(30, 3))
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    a, b, low = None, None, 1.0
    for v in r:
        if a is None:
            a = v
            continue
        to_a, to_b = float(a @ v), float(b @ v) if b is not None else 2.0
        if to_a < low and to_a <= to_b:
            b, low = v, to_a
        elif to_b < low:
            a, low = v, to_b
    df = spark.createDataFrame([("s", 1, i, *map(float, v)) for i, v in enumerate(r)], "scan_id string, key long, ordinal long, dx double, dy double, dz double")
    out = fusion.view_span(df, ["scan_id", "key"]).first()
    assert out["views"] == 30 and out["span"] == pytest.approx(math.degrees(math.acos(low)))


def test_blur_rejections_stay_within_their_share(spark):
    own = ad.frames(spark, DATA).withColumns({"exposure_blur": F.lit(99.0), "sharpness": F.abs("dx")})
    out = pl.blur_verdicts(own, 2.0, 120.0, drop=0.0).groupBy("scan_id").agg(F.count("*").alias("n"), F.sum((F.col("verdict") != "keep").cast("int")).alias("bad")).collect()
    assert any(r.bad for r in out) and all(r.bad <= math.floor(r.n * 0.3) for r in out)


def test_selection_is_independent_and_dominating(spark):
    own = ad.frames(spark, DATA).withColumns({"detail": F.abs("dx"), "verdict": F.lit("keep")})
    edges = {(r.scan_id, r.a, r.b) for r in spatial.near_duplicate_views(own, 1.5, 60.0, 0.2).collect()}
    out = pl.training_selection(own, 1.5, 60.0, 0.2).collect()
    kept = {(r.scan_id, r.id) for r in out if r.selected}
    near = {}
    for s, a, b in edges:
        near.setdefault((s, a), set()).add((s, b))
        near.setdefault((s, b), set()).add((s, a))
    assert edges and not any((s, a) in kept and (s, b) in kept for s, a, b in edges)
    assert all(near[r.scan_id, r.id] & kept for r in out if not r.selected)
    assert all((r.scan_id, r.replacement) in kept for r in out if not r.selected)


def test_wide_pairs_are_each_frames_nearest_to_the_ideal(spark):
    fr = ad.frames(spark, DATA).filter("scan_id < 6")
    rows = fr.select("scan_id", "id", "timestamp", "x", "y", "z", "dx", "dy", "dz").collect()
    want = set()
    for a in rows:
        c = [(abs(math.dist(a[3:6], b[3:6]) - 0.45), b.id) for b in rows if b.scan_id == a.scan_id and b.id != a.id and abs(b.timestamp - a.timestamp) >= 1.5 and 0.25 <= math.dist(a[3:6], b[3:6]) <= 0.8 and sum(p * q for p, q in zip(a[6:], b[6:], strict=True)) > 0.8]
        if c:
            want.add((a.scan_id, min(a.id, min(c)[1]), max(a.id, min(c)[1])))
    got = {(r.scan_id, r.a, r.b) for r in spatial.pair_selection(fr, most=10_000).filter("kind = 'wide'").collect()}
    assert got == want


def plane_samples(spark, slope=0.0, size=12):
    rows = [("s", 0, u, v, 1.0 + slope * u, 2) for u in range(size) for v in range(size)]
    return spark.createDataFrame(rows, "scan_id string, frame_id int, u int, v int, z double, conf int")


def test_depth_acceptance_on_planes_and_bad_neighbours(spark):
    k = g.Camera(*[F.lit(v) for v in (20.0, 20.0, 6.0, 6.0, 12, 12)])
    flat = raster.accepted(plane_samples(spark), k).collect()
    assert len(flat) == 100 and all(r.nz == pytest.approx(1) for r in flat)
    p = np.array([(5 - 6) / 20, -(5 - 6) / 20, -1.0])
    one = next(r for r in flat if r.u == 5 and r.v == 5)
    assert one.weight == pytest.approx((p[2] / np.linalg.norm(p)) ** 2)
    holed = plane_samples(spark).withColumn("conf", F.when((F.col("u") == 5) & (F.col("v") == 5), 0).otherwise(2))
    assert raster.accepted(holed, k).count() == 95
    nan = plane_samples(spark).withColumn("z", F.when(F.col("u") == 5, F.lit(float("nan"))).otherwise(F.col("z")))
    assert raster.accepted(nan, k).count() == 70


def test_raster_lookup_classifies(spark):
    identity = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    views = spark.createDataFrame([("s", 0, identity, (20.0, 20.0, 6.0, 6.0, 12, 12))], "scan_id string, view_id int, pose array<double>, intrinsics struct<fx:double,fy:double,cx:double,cy:double,width:int,height:int>")
    pts = spark.createDataFrame([("s", 0, 0.01, 0.01, -1.0, 0), ("s", 1, 0.01, 0.01, -2.0, 0), ("s", 2, 0.01, 0.01, -0.5, 0), ("s", 3, 0.0, 0.0, 1.0, 0), ("s", 4, 9.0, 0.0, -1.0, 0)], "scan_id string, ordinal long, x double, y double, z double, view_id int")
    out = {r.ordinal: r for r in raster.raster_lookup(pts, views, plane_samples(spark)).collect()}
    assert [out[i].state for i in range(5)] == ["supported", "occluded", "contradicted", "unobserved", "unobserved"]
    assert raster.consistent(raster.raster_lookup(pts, views, plane_samples(spark)), 1).count() == 1
    kept, applied = raster.visibility_validated(pts, raster.raster_lookup(pts, views, plane_samples(spark)), refute=1, most=0.5)
    assert applied and kept.count() == 4
    kept, applied = raster.visibility_validated(pts, raster.raster_lookup(pts, views, plane_samples(spark)), refute=1)
    assert not applied and kept.count() == 5


def test_signed_distance_finds_the_plane(spark):
    rows = [("s", f, f * 100 + i, (i % 10) * 0.05 + 0.01, (i // 10) * 0.05 + 0.01, 0.37, 0.0, 0.0, 1.0, 1.0) for f in range(3) for i in range(100)]
    p = spark.createDataFrame(rows, "scan_id string, frame_id int, ordinal long, x double, y double, z double, nx double, ny double, nz double, score double")
    out = fusion.tsdf_crossings(fusion.tsdf_integrate(p, 0.05), 0.05).filter("axis = 2").collect()
    assert len(out) >= 80 and all(abs(r.z - 0.37) < 0.05 for r in out)
    surface, taken = pl.tsdf_surface(p, p.filter("frame_id = 0").select("scan_id", "x", "y", "z"), 0.05)
    assert taken and surface.count() >= 80


def test_plane_fit_and_thickness(spark):
    r = np.random.default_rng(2)
    rows = [("s", i, float(r.uniform(0, 1)), float(r.uniform(0, 1)), float(r.normal(0, 0.01)), 1.0) for i in range(400)]
    p = points(spark, rows)
    fit = metrics.plane_fit(p, ["scan_id"]).first()
    assert abs(fit.nz) > 0.99 and fit.rms == pytest.approx(0.01, rel=0.2)
    thick = metrics.patch_thickness(p, p.limit(5), 0.3).collect()
    assert thick and all(0.015 < t.thickness < 0.04 for t in thick)


def test_triangulation_recovers_points(spark):
    r = np.random.default_rng(3)
    rows = []
    for track in range(6):
        target = r.uniform(-1, 1, 3)
        for _ in range(4):
            o = r.uniform(2, 4, 3)
            d = (target - o) / np.linalg.norm(target - o)
            rows.append((track, *map(float, o), *map(float, d), *map(float, target)))
    rows += [(9, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)] * 3
    df = spark.createDataFrame(rows, "track_id int, ox double, oy double, oz double, dx double, dy double, dz double, tx double, ty double, tz double")
    out = {x.track_id: x for x in metrics.triangulate(df).collect()}
    truth = {x[0]: x[7:] for x in rows}
    assert sorted(out) == list(range(6)) and all(math.dist((v.px, v.py, v.pz), truth[k]) < 1e-6 for k, v in out.items())


def test_allotment_respects_caps_and_total(spark):
    df = spark.createDataFrame([(i, float(i + 1), 3) for i in range(10)], "k int, share double, most int")
    free = metrics.allot(df, 55, "k").collect()
    assert [x.allotted for x in sorted(free)] == list(range(1, 11))
    capped = metrics.allot(df, 25, "k", "most").collect()
    assert sum(x.allotted for x in capped) == 25 and max(x.allotted for x in capped) == 3
    assert sum(x.allotted for x in metrics.allot(df, 99, "k", "most").collect()) == 30


def test_kmeans_and_codebook(spark):
    rows = [(i, float(i % 3 * 10) + i * 1e-3, 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "row long, x double, y double")
    out, centres = graph.kmeans(df, 3, 5, ["x", "y"])
    assert len({(r.row % 3, r.cluster) for r in out.collect()}) == 3 and len(centres) == 3
    book = graph.codebook(df, "x", 3, 10)
    assert [round(b) for b in book] == [0, 10, 20]
    assert graph.codebook(df.limit(0), "x", 3) == []


def test_quantised_means_come_back(spark):
    s = ad.points(spark, DATA)
    q = splats.dequantised_means(splats.quantised_means(s).withColumnsRenamed({"x": "ox", "y": "oy", "z": "oz"}))
    assert q.agg(F.max(F.abs(F.col("x") - F.col("ox")))).first()[0] < 1e-4


def test_floor_plan_of_a_room_turned_by_31_degrees(spark):
    c, s = math.cos(math.radians(31)), math.sin(math.radians(31))
    rows, n = [], 0
    for i in range(80):
        for h in range(20):
            for x, z in ((i * 0.05, 0.0), (i * 0.05, 3.0), (0.0, i * 0.0375), (4.0, i * 0.0375)):
                rows.append(("r", n, c * x - s * z, h * 0.1, s * x + c * z, 1.0))
                n += 1
    plan = pl.floor_plan(points(spark, rows), 0.05, 0.0, 2.0).collect()
    long = [r for r in plan if r.last - r.first > 40]
    assert len({r.component for r in long}) <= 4 and {r.direction for r in long} == {"horizontal", "vertical"}
    assert metrics.wall_angle(points(spark, rows), 0.05).first().angle * 0.5 is not None


def test_motion_recovered_by_kernels(spark):
    r = np.random.default_rng(6)
    a = r.uniform(-1, 1, (40, 3))
    m, t = kernels.rotation(np.array([0.01, -0.02, 0.015])), np.array([0.02, 0.01, -0.03])
    b = a @ m.T + t
    got, shift = kernels.horn(a, b)
    assert np.allclose(got, m, atol=1e-9) and np.allclose(shift, t, atol=1e-9)
    many = r.uniform(-1, 1, (140, 3))  # enough that three quarters of those held out are good ones
    noisy = [(1, *map(float, p), *map(float, p @ m.T + t + (0 if i % 7 else 1))) for i, p in enumerate(many)]
    out = kernels.revisit_verification(spark.createDataFrame(noisy, "pair_id long, x double, y double, z double, rx double, ry double, rz double")).first()
    assert out.accepted and np.allclose(out.motion[9:], t, atol=1e-3)
    n = r.normal(size=(40, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    icp = kernels.plane_icp(spark.createDataFrame([(1, *map(float, p), *map(float, q), *map(float, k)) for p, q, k in zip(a, b, n, strict=True)], "window_id long, x double, y double, z double, rx double, ry double, rz double, nx double, ny double, nz double")).first()
    assert icp.accepted and np.allclose(icp.motion[9:], t, atol=1e-4)


def test_bundle_adjustment_repairs_a_shifted_pose(spark):
    r = np.random.default_rng(7)
    pts = np.c_[r.uniform(-1, 1, (40, 2)), r.uniform(-5, -4, 40)]
    true = [np.zeros(6), np.array([0.0, 0.02, 0.0, 0.2, 0.0, 0.0]), np.array([0.0, -0.02, 0.0, -0.2, 0.0, 0.0])]
    rows = []
    for f, pose in enumerate(true):
        cam = pts @ kernels.rotation(pose[:3]).T + pose[3:]
        given = pose + (np.array([0, 0, 0, 0.05, 0, 0]) if f else 0)
        for t, c in enumerate(cam):
            rows.append(("s", f, t, float(300 * c[0] / -c[2] + 160), float(120 - 300 * c[1] / -c[2]), given.tolist(), *map(float, pts[t]), 300.0, 300.0, 160.0, 120.0))
    df = spark.createDataFrame(rows, "scan_id string, frame_id long, track_id long, u double, v double, pose array<double>, px double, py double, pz double, fx double, fy double, cx double, cy double")
    out = {x.frame_id: x for x in kernels.bundle_adjustment(df).collect()}
    assert out[1].accepted and out[1].after < 0.2 * out[1].before and abs(out[1].pose[3] - 0.2) < 1e-3


def test_pose_graph_spreads_a_loop(spark):
    fr = spark.createDataFrame([("s", i) for i in range(11)], "scan_id string, id long")
    lo = spark.createDataFrame([("s", 0, 10, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "scan_id string, a long, b long, c0 double, c1 double, c2 double, c3 double, c4 double, c5 double")
    c = [x.c0 for x in sorted(kernels.pose_graph(fr, lo).collect())]
    # ten links of weight 100 in a row against one loop of weight 200
    assert c[0] == 0 and c[10] == pytest.approx(200 / 210, abs=1e-3) and np.allclose(np.diff(c), np.diff(c)[0], atol=1e-3)


def test_pose_graph_equals_a_dense_solve_and_fills_gaps(spark):
    r = np.random.default_rng(3)
    rows = [("s", i, float(i) + 0.3 * (i % 3), i not in (0, 4, 5, 12)) for i in range(13)]
    loops = [("s", 1, 9, *map(float, r.normal(0, 0.05, 6))), ("s", 3, 11, *map(float, r.normal(0, 0.05, 6))), ("s", 2, 5, *[9.0] * 6)]
    fr = spark.createDataFrame(rows, "scan_id string, id long, timestamp double, usable boolean")
    lo = spark.createDataFrame(loops, "scan_id string, a long, b long, " + ", ".join(f"c{i} double" for i in range(6)))
    got = {x.id: np.array([x[f"c{i}"] for i in range(6)]) for x in kernels.pose_graph(fr, lo).collect()}
    use = [x[1] for x in rows if x[3]]
    h, g = 0.002 * np.eye(len(use)), np.zeros((len(use), 6))
    for a, b, w, want in [(i, i + 1, 100, np.zeros(6)) for i in range(len(use) - 1)] + [(use.index(x[1]), use.index(x[2]), 200, np.array(x[3:])) for x in loops[:2]]:
        for p, q in ((a, b), (b, a)):
            h[p, p] += w
            h[p, q] -= w
        g[b] += w * want
        g[a] -= w * want
    want = np.zeros((len(use), 6))
    want[1:] = np.linalg.solve(h[1:, 1:], g[1:])
    assert all(np.allclose(got[i], want[k], atol=1e-6) for k, i in enumerate(use))
    assert np.allclose(got[0], got[1]) and np.allclose(got[12], got[11])
    f = (rows[4][2] - rows[3][2]) / (rows[6][2] - rows[3][2])
    a, b = got[3], got[6]
    assert np.allclose(got[4][3:], (1 - f) * a[3:] + f * b[3:]) and np.allclose(kernels.rotation(got[4][:3]), kernels.rotation(a[:3]) @ kernels.rotation(f * kernels.rotation_vector(kernels.rotation(a[:3]).T @ kernels.rotation(b[:3]))))


def test_revisits_are_rejected_by_each_rule(spark):
    r = np.random.default_rng(2)
    pts = r.uniform(-1, 1, (200, 3))
    moved = pts + [0.03, 0.0, 0.0]
    far = pts + r.uniform(0.5, 1, pts.shape)
    blend = lambda share: np.where((np.arange(200) % 10 < share * 10)[:, None], far, moved)
    cases = [moved, moved[:39], pts + [0.004, 0, 0], blend(0.2), blend(0.5), far]
    rows = [(k, *map(float, p), *map(float, q)) for k, case in enumerate(cases) for p, q in zip(pts, case, strict=False)]
    out = {x.pair_id: x for x in kernels.revisit_verification(spark.createDataFrame(rows, "pair_id long, x double, y double, z double, rx double, ry double, rz double")).collect()}
    assert [out[k].accepted for k in range(6)] == [True, False, False, True, False, False]
    assert np.allclose(out[0].motion, [1, 0, 0, 0, 1, 0, 0, 0, 1, 0.03, 0, 0], atol=1e-6) and out[5].motion[9:] == [0, 0, 0]


def test_bundle_adjustment_solves_points_with_poses(spark):
    """Points start beside their places; the joint solve reaches the errors of the images alone."""
    r = np.random.default_rng(5)
    pts = np.c_[r.uniform(-1, 1, (60, 2)), r.uniform(-5, -3, 60)]
    true = [np.array([0, 0.03 * f, 0.01 * f, 0.25 * f, 0.05 * f, 0]) for f in range(5)]
    start = pts + r.normal(0, 0.05, pts.shape)
    rows = []
    for f, pose in enumerate(true):
        cam = pts @ kernels.rotation(pose[:3]).T + pose[3:]
        given = pose + (r.normal(0, 0.02, 6) if f else 0)
        for t, c in enumerate(cam):
            wrong = 80.0 if (f, t) in ((1, 3), (2, 7), (3, 30)) else 0.0
            rows.append(("s", f, t, float(300 * c[0] / -c[2] + 160) + wrong, float(120 - 300 * c[1] / -c[2]), given.tolist(), *map(float, start[t]), 300.0, 300.0, 160.0, 120.0))
    df = spark.createDataFrame(rows, "scan_id string, frame_id long, track_id long, u double, v double, pose array<double>, px double, py double, pz double, fx double, fy double, cx double, cy double")
    out = {x.frame_id: x for x in kernels.bundle_adjustment(df).collect()}
    assert out[1].accepted and out[1].after < 0.1 < 1 < out[1].before
    assert all(np.allclose(out[f].pose[:3], true[f][:3], atol=0.01) for f in range(5)) and out[0].pose == [0.0] * 6


def test_tracking_follows_a_shift():
    r = np.random.default_rng(9)
    big = np.kron(r.integers(0, 255, (20, 20)), np.ones((4, 4)))
    for _ in range(3):
        big = (np.roll(big, 1, 0) + np.roll(big, 1, 1) + big) / 3
    a, b = big[4:68, 4:68], big[2:66, 1:65]
    to, ok = kernels.lucas_kanade(a, b, np.array([[30.0, 30.0], [20.0, 40.0]]))
    assert ok.all() and np.allclose(to - [[30, 30], [20, 40]], [[3, 2], [3, 2]], atol=0.2)


def test_rpe_pairs_across_empty_buckets(spark):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate([0.0, 0.1, 7.5, 7.6, 9.0])], "scan_id string, id long, travel double")
    assert sorted((r.i, r.j) for r in sequence.rpe_pairs(df, 1.0).collect()) == [(0, 2), (1, 2), (2, 4), (3, 4)]


def test_frames_that_are_not_valid_are_rejected(spark):
    k = (300.0, 300.0, 240, 180)
    ok = [1.0] * 16
    rows = [("s", 1, ok, k, "a.jpg"), ("s", 2, ok[:15], k, "b.jpg"), ("s", 3, [float("nan")] * 16, k, "c.jpg"), ("s", 4, ok, k, "../d.jpg"), ("s", 5, ok, k, "e.jpg"), ("s", 5, ok, k, "f.jpg"), ("s", 6, ok, k, "g.jpg"), ("s", 7, ok, k, "g.jpg"), ("s", 8, ok, (0.0, 300.0, 240, 180), "h.jpg"), ("s", 9, None, k, "i.jpg"), ("s", 10, ok, k, None)]
    df = spark.createDataFrame(rows, "scan_id string, id int, transform array<double>, intrinsics struct<fx:double,fy:double,width:int,height:int>, imageFile string")
    assert [r.id for r in pl.valid_frames(df).collect()] == [1]
