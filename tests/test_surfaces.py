"""Surface refinement in rooms with known poses, motion limits, and the guard over corrected poses."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from stereoloom.operators import kernels, surfaces
from stereoloom.plans import queries_tracks


def moved(a, b):
    a, b = (np.array(x).reshape(4, 4) for x in (a, b))
    return np.linalg.norm(a[:3, 3] - b[:3, 3]), np.linalg.norm(kernels.rotation_vector(a[:3, :3] @ b[:3, :3].T))


def test_frames_of_a_corner_find_their_true_poses(spark):
    frames = queries_tracks.room_frames(spark, DATA).filter("scan_id < 8").cache()
    found = surfaces.surface_refinement(frames)
    rows = found.join(frames.select("scan_id", "frame_id", F.col("pose").alias("given"), "truth"), ["scan_id", "frame_id"]).collect()
    assert len(rows) == frames.count()
    taken = [r for r in rows if r.status == "validated"]
    assert len(taken) >= 0.9 * sum(r.status != "anchor" for r in rows)
    was, now = (np.array([moved(getattr(r, c), r.truth) for r in taken]) for c in ("given", "pose"))
    assert now[:, 0].mean() < 0.1 * was[:, 0].mean() and now[:, 1].mean() < 0.2 * was[:, 1].mean()
    assert all(r.pose == r.given for r in rows if r.status != "validated")
    assert all(r.after < 0.95 * r.before for r in taken)


@pytest.mark.parametrize("walls", [1, 2])
def test_open_directions_are_refused(spark, walls):
    """One wall lets a frame slide in two directions, a wall and a floor along their edge."""
    found = surfaces.surface_refinement(queries_tracks.room_frames(spark, DATA, walls).filter("scan_id < 3"))
    assert {r.status for r in found.collect()} == {"anchor", "degenerate"}


def test_images_that_disagree_more_than_before_refuse(spark):
    """Depth asks for the true pose, but the frame's luma is drawn to fit the given one."""
    frames = queries_tracks.room_frames(spark, DATA).filter("scan_id = 0").orderBy("frame_id").collect()
    rules = surfaces.SurfaceRules()
    first, last = (surfaces.DepthFrame(frames[i].asDict(), rules).with_normals() for i in (0, 8))
    source = surfaces.DepthFrame(frames[3].asDict(), rules)
    pose, status, *_ = surfaces.surface_aligned(source, [first, last], rules)
    assert status == "validated"
    # the images as the given pose would see them: the anchors' luma along the uncorrected lines of sight
    world = source.local.reshape(-1, 3) @ source.pose[:3, :3].T + source.pose[:3, 3]
    source.luma = first.held(world, np.tile([0.0, 0.0, 1.0], (len(world), 1)))[1].reshape(source.luma.shape)
    assert surfaces.surface_aligned(source, [first], rules)[1] == "imageHoldoutRejected"
    assert surfaces.surface_aligned(source, [], rules)[1] == "insufficientOverlap"


def test_far_frames_are_no_corrections(spark):
    frames = queries_tracks.room_frames(spark, DATA).filter("scan_id = 0").orderBy("frame_id").collect()
    rules = surfaces.SurfaceRules()
    anchors = [surfaces.DepthFrame(frames[i].asDict(), rules).with_normals() for i in (0, 8)]
    source = surfaces.DepthFrame(frames[3].asDict() | {"pose": frames[3].truth}, rules)
    source.pose[:3, 3] += [0.04, 0.02, 0.0]
    assert surfaces.surface_aligned(source, anchors, rules)[1] == "excessiveCorrection"


def test_surface_refinement_of_odd_rows(spark):
    frames = queries_tracks.room_frames(spark, DATA).filter("scan_id = 0")
    cut = frames.withColumn("depth", F.when(F.col("frame_id") != 2, F.col("depth")))
    assert surfaces.surface_refinement(cut).count() == 8
    assert surfaces.surface_refinement(frames.limit(0)).count() == 0
    two = surfaces.surface_refinement(frames.filter("frame_id < 2")).collect()
    assert [r.status for r in two] == ["anchor", "anchor"]


def test_revisits_that_move_far_are_no_corrections(spark):
    r = np.random.default_rng(1)
    rows = []
    for pair, (shift, degrees) in enumerate([(0.05, 0.0), (0.14, 0.0), (0.2, 0.0), (0.0, 4.5), (0.0, 5.5)]):
        p = r.uniform(-1, 1, (80, 3))
        q = p @ kernels.rotation(np.array([0.0, 0.0, np.radians(degrees)])).T + [shift, 0.0, 0.0]
        rows += [(pair, *map(float, a), *map(float, b)) for a, b in zip(p, q, strict=True)]
    got = kernels.revisit_verification(spark.createDataFrame(rows, "pair_id long, x double, y double, z double, rx double, ry double, rz double"))
    assert {x.pair_id: x.accepted for x in got.collect()} == {0: True, 1: True, 2: False, 3: True, 4: False}


def test_corrections_stand_or_fall_as_a_whole(spark):
    poses = [(s, i, 1.0, 0.0, 0.0, 0.0, 0.5 * i, 0.0, 1.0) for s in "abcd" for i in range(5)]
    own = spark.createDataFrame(poses, "scan_id string, id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    turn = {"a": 0.0, "b": 0.0, "c": np.radians(6.0), "d": 0.0}
    shift = {"a": lambda i: 0.01 * i, "b": lambda i: 0.05 * i, "c": lambda i: 0.0, "d": lambda i: 0.03 if i == 3 else 0.0}
    corrections = spark.createDataFrame([(s, i, 0.0, float(turn[s]), 0.0, 0.0, shift[s](i), 0.0) for s in "abcd" for i in range(1, 5)], "scan_id string, id long, c0 double, c1 double, c2 double, c3 double, c4 double, c5 double")
    got = kernels.corrected_poses(own, corrections).orderBy("scan_id", "id").collect()
    assert {r.scan_id: r.status for r in got} == {"a": "corrected", "b": "excessiveCorrection", "c": "excessiveCorrection", "d": "odometryChanged"}
    assert [round(r.ty, 6) for r in got if r.scan_id == "a"] == [0.0, 0.01, 0.02, 0.03, 0.04] and all(r.ty == 0.0 for r in got if r.scan_id != "a")


def test_corrected_poses_equal_matrices(spark):
    r = np.random.default_rng(5)
    rows, moves = [], []
    for i in range(6):
        q = r.normal(size=4)
        rows.append((1, i, *map(float, q / np.linalg.norm(q)), *map(float, r.normal(size=3))))
        moves.append((1, i, *map(float, r.normal(size=6) * 1e-3)))
    names = "scan_id long, id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double"
    got = kernels.corrected_poses(spark.createDataFrame(rows, names), spark.createDataFrame(moves, "scan_id long, id long, " + ", ".join(f"c{i} double" for i in range(6)))).orderBy("id").collect()
    for row, move, x in zip(rows, moves, got, strict=True):
        w, a, b, c = row[2:6]
        before = np.array([[1 - 2 * (b * b + c * c), 2 * (a * b - w * c), 2 * (a * c + w * b)], [2 * (a * b + w * c), 1 - 2 * (a * a + c * c), 2 * (b * c - w * a)], [2 * (a * c - w * b), 2 * (b * c + w * a), 1 - 2 * (a * a + b * b)]])
        want = kernels.rotation(np.array(move[2:5])) @ before
        w, a, b, c = x.qw, x.qx, x.qy, x.qz
        after = np.array([[1 - 2 * (b * b + c * c), 2 * (a * b - w * c), 2 * (a * c + w * b)], [2 * (a * b + w * c), 1 - 2 * (a * a + c * c), 2 * (b * c - w * a)], [2 * (a * c - w * b), 2 * (b * c + w * a), 1 - 2 * (a * a + b * b)]])
        assert x.status == "corrected" and np.abs(after - want).max() < 1e-9
        assert np.abs(kernels.rotation(np.array(move[2:5])) @ row[6:9] + move[5:8] - [x.tx, x.ty, x.tz]).max() < 1e-12
