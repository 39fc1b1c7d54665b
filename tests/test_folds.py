"""Folds in segments against the plain fold, hot cells, and plans without gathered cells; solvers against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereoloom.operators import fusion, kernels


def folded(rows, cap):
    """Rows (x, w) in order: each moves the mean by its share; the old weight counts at most ``cap``."""
    mean = weight = 0.0
    for x, w in rows:
        old = min(weight, cap)
        mean += (x - mean) * w / (old + w)
        weight += w
    return mean, weight


@pytest.mark.parametrize("segment", [1, 7, 64, 1 << 16])
def test_segments_equal_the_plain_fold(spark, segment):
    r = np.random.default_rng(segment)
    rows = [(int(k), int(o), float(x), float(w)) for k, o, x, w in zip(r.choice([1, 1, 1, 2, 3], 900), r.permutation(2000)[:900], r.normal(size=900), r.choice([0.01, 0.3, 1.0, 9.0], 900, p=[0.3, 0.4, 0.25, 0.05]), strict=True)]
    df = spark.createDataFrame([*rows, (None, 5, 1.0, 2.0), (None, 6, 2.0, 2.0)], "k long, o long, x double, w double")
    got = {x.k: x for x in fusion.capped_means(df, ["k"], "o", ("x",), "w", 8.0, segment=segment).collect()}
    for k in (1, 2, 3):
        own = [(x, w) for _, x, w in sorted((o, x, w) for kk, o, x, w in rows if kk == k)]
        mean, weight = folded(own, 8.0)
        assert got[k].x == pytest.approx(mean, abs=1e-9) and got[k].weight == pytest.approx(weight) and got[k].samples == len(own)
    assert got[None].x == pytest.approx(1.5) and len(got) == 4


def test_measured_samples_take_precedence_over_segments(spark):
    rows = [("s", i, 0.01, 0.01, 0.01 + 0.0001 * i, 0.5, i % 50 == 0) for i in range(400)] + [("s", i, 1.01, 0.01, 0.02, 0.001, False) for i in range(400, 420)]
    got = {round(r.mx): r for r in fusion.fuse_exact(spark.createDataFrame(rows, "scan_id string, ordinal long, x double, y double, z double, score double, measured boolean"), 0.5, segment=16).collect()}
    mean, _ = folded([(r[4], r[5]) for r in rows[:400] if r[6]], 8.0)
    assert got[0].samples == 8 and got[0].mz == pytest.approx(mean, abs=1e-9)
    assert got[1].samples == 20 and got[1].weight == pytest.approx(0.2) and got[1].best_score == 0.001


def test_a_cell_of_a_million_samples(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("s").alias("scan_id"), F.col("id").alias("ordinal"), *[F.lit(0.1).alias(c) for c in "xy"], (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10_000.0).alias("z"), F.lit(1.0).alias("score"))
    got = fusion.fuse_exact(df, 1.0).collect()
    last = [r.z for r in df.filter(F.col("ordinal") >= n - 400).orderBy("ordinal").collect()]
    mean = 0.05
    for z in last:  # what came before has lost its say: (8 / 9) ** 400
        mean += (z - mean) / 9.0
    assert len(got) == 1 and got[0].samples == n and got[0].mz == pytest.approx(mean, abs=1e-9) and got[0].weight == 8.0


def test_exact_folds_gather_no_cell(spark):
    points = spark.createDataFrame([("s", 1, 0, 0.1, 0.1, 0.1, 0.0, 0.0, 1.0, 1.0)], "scan_id string, ordinal long, frame_id long, x double, y double, z double, nx double, ny double, nz double, score double")
    for df in (fusion.fuse_exact(points, 0.1), fusion.tsdf_integrate(points, 0.1)):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() >= 1
    assert fusion.fuse_exact(points.limit(0), 0.1).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 8, 17, 100])
def test_block_tridiagonal_equals_a_dense_solve(n):
    r = np.random.default_rng(n)
    diagonal = np.array([m @ m.T + 20 * np.eye(6) for m in r.normal(size=(n, 6, 6))])
    upper = r.normal(size=(n - 1, 6, 6))
    whole = np.zeros((6 * n, 6 * n))
    for i in range(n):
        whole[6 * i : 6 * i + 6, 6 * i : 6 * i + 6] = diagonal[i]
        if i + 1 < n:
            whole[6 * i : 6 * i + 6, 6 * i + 6 : 6 * i + 12], whole[6 * i + 6 : 6 * i + 12, 6 * i : 6 * i + 6] = upper[i], upper[i].T
    b = r.normal(size=(n, 6))
    assert np.abs(kernels.BlockTridiagonal(diagonal, upper).solve(b).reshape(-1) - np.linalg.solve(whole, b.reshape(-1))).max() < 1e-9


def chain_of_frames(n, per_frame, span, seed=1, outliers=0.05):
    """Poses along a line, tracks over ``span`` frames with noise and outliers, a disturbed start."""
    r = np.random.default_rng(seed)
    poses = np.zeros((n, 6))
    poses[1:, :3], poses[:, 3] = 0.02 * r.normal(size=(n - 1, 3)), -0.1 * np.arange(n)
    first = r.integers(0, max(1, n - span + 1), n * per_frame // span)
    points = np.stack([0.1 * (first + span / 2) + r.uniform(-1, 1, len(first)), r.uniform(-1, 1, len(first)), r.uniform(-3.8, -2.2, len(first))], axis=1)
    obs = np.array([(f, t, 0, 0) for t, f0 in enumerate(first) for f in range(f0, min(n, f0 + span))], float)
    k = np.array([500.0, 500.0, 320.0, 240.0])
    obs[:, 2:] += kernels._residuals(points, poses, obs, k)
    obs[:, 2:] += 0.3 * r.normal(size=(len(obs), 2))
    bad = r.random(len(obs)) < outliers
    obs[bad, 2:] += 40 * r.normal(size=(bad.sum(), 2))
    start = poses.copy()
    start[1:, :3] += 0.004 * r.normal(size=(n - 1, 3))
    start[1:, 3:] += 0.01 * r.normal(size=(n - 1, 3))
    return poses, start, points + 0.02 * r.normal(size=points.shape), obs, k


@pytest.mark.parametrize("motion", [None, kernels.MotionPrior(0.01, 0.2)], ids=["images", "motion"])
def test_pose_step_equals_the_dense_reduced_system(motion):
    _, start, given, obs, k = chain_of_frames(12, 80, 5)
    n, base = len(start), kernels._residuals(given, start, obs, k)
    frame, track, jp, jx = kernels._jacobians(given, start, obs, k, base)
    w, tp, tx, e = kernels._robust(base, 2.0)[0][:, None, None], np.swapaxes(jp, 1, 2), np.swapaxes(jx, 1, 2), base[:, :, None]
    u, v = kernels._gathered(frame, tp @ (w * jp), n) + 1e-4 * np.eye(6), np.linalg.inv(kernels._gathered(track, tx @ (w * jx), len(given)) + 1e-4 * np.eye(3))
    gp, gx, cross = kernels._gathered(frame, (tp @ (w * e))[:, :, 0], n), kernels._gathered(track, (tx @ (w * e))[:, :, 0], len(given)), tp @ (w * jx)
    upper = np.zeros((n - 1, 6, 6))
    if motion:
        gradient, diagonal, upper = kernels._Chain(start, np.arange(n) * 0.1, motion).blocks(start + 1e-3)
        gp, u = gp + gradient, u + diagonal
    dense, right = np.zeros((n, 6, n, 6)), gp.copy()
    dense[np.arange(n), :, np.arange(n), :] = u
    for i in range(n - 1):
        dense[i, :, i + 1, :] += upper[i]
        dense[i + 1, :, i, :] += upper[i].T
    for t in range(len(given)):
        for a in np.flatnonzero(track == t):
            right[frame[a]] -= cross[a] @ v[t] @ gx[t]
            for b in np.flatnonzero(track == t):
                dense[frame[a], :, frame[b], :] -= cross[a] @ v[t] @ cross[b].T
    want = -np.linalg.solve(dense[1:, :, 1:, :].reshape(6 * (n - 1), -1), right[1:].reshape(-1)).reshape(-1, 6)
    assert np.abs(kernels._pose_step(u, v, cross, frame, track, gp, gx, upper) - want).max() < 1e-7


def test_motion_prior_gradient_and_improvement():
    poses, start, given, obs, k = chain_of_frames(12, 80, 5)
    chain = kernels._Chain(start, np.arange(12) * 0.1, kernels.MotionPrior(0.01, 0.2))
    at, gradient = start + 1e-3, chain.blocks(start + 1e-3)[0]
    for f, d in ((0, 0), (3, 1), (5, 4), (11, 3)):
        moved = at.copy()
        moved[f, d] += 1e-6
        assert (chain.cost(moved) - chain.cost(at)) / 1e-6 == pytest.approx(gradient[f, d], rel=1e-2, abs=1.0)
    after = kernels._adjusted(start, given, obs, k, 20, 2.0, 1e-4, chain)
    assert np.abs(after - poses).mean() < 0.8 * np.abs(start - poses).mean()


def test_two_thousand_frames_in_bounded_memory():
    """The dense reduced system alone would take over a gigabyte."""
    import tracemalloc

    poses, start, given, obs, k = chain_of_frames(2000, 12, 6)
    tracemalloc.start()
    chain = kernels._Chain(start, np.arange(2000) * 0.1, kernels.MotionPrior(0.01, 0.2))
    after = kernels._adjusted(start, given, obs, k, 1, 2.0, 1e-4, chain)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and np.isfinite(after).all() and not np.array_equal(after, start)


def test_times_between_frames_bound_the_motion_prior():
    _, start, *_ = chain_of_frames(4, 40, 3)
    assert kernels._Chain(start, np.array([0.0, 0.4, 1.0, 1.1]), kernels.MotionPrior()).at.tolist() == [0, 2]
