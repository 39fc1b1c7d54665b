"""Numeric kernels per scan, pair or window: NumPy inside grouped functions.

Each group is one capture session, frame pair or window, whose size a capture
bounds; nothing here gathers a whole table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rotation(v: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector (Rodrigues)."""
    t = float(np.linalg.norm(v))
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    if t < 1e-12:
        return np.eye(3) + k
    k = k / t
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k


def rotation_vector(r: np.ndarray) -> np.ndarray:
    c = np.clip((np.trace(r) - 1) / 2, -1, 1)
    t = float(np.arccos(c))
    if t < 1e-9:
        return np.zeros(3)
    if np.pi - t < 1e-6:
        axis = np.sqrt(np.maximum(np.diag(r) + 1, 0) / 2)
        i = int(axis.argmax())
        axis = (r[i] + np.eye(3)[i]) / (2 * axis[i])
        return axis / np.linalg.norm(axis) * t
    return np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / (2 * np.sin(t)) * t


def rotations(v: np.ndarray) -> np.ndarray:
    """Rotation matrices of many rotation vectors."""
    t = np.linalg.norm(v, axis=-1)
    small = t < 1e-12
    safe = np.where(small, 1.0, t)
    k = np.zeros((*v.shape[:-1], 3, 3))
    k[..., 0, 1], k[..., 0, 2], k[..., 1, 0], k[..., 1, 2], k[..., 2, 0], k[..., 2, 1] = -v[..., 2], v[..., 1], v[..., 2], -v[..., 0], -v[..., 1], v[..., 0]
    a, b = np.where(small, 1.0, np.sin(t) / safe), np.where(small, 0.0, (1 - np.cos(t)) / safe**2)
    return np.eye(3) + a[..., None, None] * k + b[..., None, None] * (k @ k)


class BlockTridiagonal:
    """Solver of a symmetric positive system of blocks that couple neighbours only.

    Every second block is eliminated at a time, so a factor and a solution are
    some array operations for each halving instead of a step for each block.
    """

    def __init__(self, diagonal: np.ndarray, upper: np.ndarray):
        self.levels, self.n = [], len(diagonal)
        while len(diagonal) > 1:
            odd = np.arange(1, len(diagonal), 2)
            inverse = np.linalg.inv(diagonal[odd])
            left = upper[odd - 1]
            has_right = odd + 1 < len(diagonal)
            right = upper[odd[has_right]]
            lower = np.swapaxes(left, 1, 2)
            kept = diagonal[0::2].copy()
            kept[: len(odd)] -= left @ inverse @ lower
            kept[1 : 1 + len(right)] -= np.swapaxes(right, 1, 2) @ inverse[has_right] @ right
            self.levels.append((inverse, left, right))
            diagonal, upper = kept, -left[has_right] @ inverse[has_right] @ right
        self.last = np.linalg.inv(diagonal) if len(diagonal) else diagonal

    def solve(self, b: np.ndarray) -> np.ndarray:
        """The solution for one right side (n, size)."""
        times = lambda m, x: (m @ x[..., None])[..., 0]
        back = lambda m, x: (np.swapaxes(m, 1, 2) @ x[..., None])[..., 0]
        sides = []
        for inverse, left, right in self.levels:
            sides.append(b)
            own = times(inverse, b[1::2])
            b = b[0::2].copy()
            b[: len(own)] -= times(left, own)
            b[1 : 1 + len(right)] -= back(right, own[: len(right)])
        x = times(self.last, b) if self.n else b
        for (inverse, left, right), b in zip(self.levels[::-1], sides[::-1], strict=True):
            odd = b[1::2] - back(left, x[: len(left)])
            odd[: len(right)] -= times(right, x[1 : 1 + len(right)])
            whole = np.empty_like(b)
            whole[0::2], whole[1::2] = x, times(inverse, odd)
            x = whole
        return x


def horn(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rigid motion that takes points a to b in the least squares: largest eigenvector of Horn's 4x4 matrix."""
    ca, cb = a.mean(0), b.mean(0)
    s = (a - ca).T @ (b - cb)
    d = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
    n = np.empty((4, 4))
    n[0, 0], n[0, 1:], n[1:, 0] = np.trace(s), d, d
    n[1:, 1:] = s + s.T - np.trace(s) * np.eye(3)
    w, x, y, z = np.linalg.eigh(n)[1][:, -1]
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    return r, cb - r @ ca


def pose_comparison(pairs: DataFrame) -> DataFrame:
    """Absolute trajectory error after alignment, per scan: pairs (scan_id, id, x, y, z, rx, ry, rz) of estimate and reference.

    The sums that Horn's method needs are aggregated by Spark; only 15
    numbers a scan reach the eigen-solver, and residuals are again columns.
    """
    a, b = ["x", "y", "z"], ["rx", "ry", "rz"]
    sums = pairs.groupBy("scan_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in a + b], *[F.covar_pop(p, q).alias(f"s_{p}_{q}") for p in a for q in b])

    @F.pandas_udf("array<double>")
    def motion(rows: pd.DataFrame) -> pd.Series:
        out = []
        for row in rows.itertuples(index=False):
            v = row._asdict()
            s = np.array([[v[f"s_{p}_{q}"] for q in b] for p in a])
            d = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
            n = np.block([[np.array([[np.trace(s)]]), d[None, :]], [d[:, None], s + s.T - np.trace(s) * np.eye(3)]])
            w, x, y, z = np.linalg.eigh(n)[1][:, -1]
            r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
            t = np.array([v[f"m_{q}"] for q in b]) - r @ np.array([v[f"m_{p}"] for p in a])
            out.append([*r.reshape(-1), *t])
        return pd.Series(out)

    fitted = sums.withColumn("m", motion(F.struct(*[c for c in sums.columns if c[1:2] == "_"]))).select("scan_id", "m")
    m = lambda i: F.col("m")[i]
    moved = [m(3 * r) * F.col("x") + m(3 * r + 1) * F.col("y") + m(3 * r + 2) * F.col("z") + m(9 + r) for r in range(3)]
    e2 = sum(((p - F.col(q)) ** 2 for p, q in zip(moved[1:], b[1:], strict=True)), (moved[0] - F.col("rx")) ** 2)
    own = pairs.join(fitted, "scan_id").withColumn("e", F.sqrt(e2))
    return own.groupBy("scan_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.percentile("e", F.lit(0.5)).alias("median"), F.max("e").alias("largest"))


def revisit_verification(matches: DataFrame, trials: int = 64, inlier: float = 0.025, least_matches: int = 40, least: int = 24, share: float = 0.6, holdout: int = 5, close: float = 0.04,
                         most_shift: float = 0.15, most_degrees: float = 5.0) -> DataFrame:
    """Rigid motion of each revisit pair by RANSAC over 3-D matches (pair_id, x, y, z, rx, ry, rz), refitted on the inliers.

    A pair needs ``least_matches``. Every ``holdout``-th match, from the first
    in order of place, only judges. Of the others ``least`` and a ``share``
    must lie within ``inlier``; the held-out matches must have been over 5 mm
    apart (median) and come within ``inlier`` and under 0.8 of that, three
    quarters of them within ``close``. A motion of over ``most_shift`` metres or
    ``most_degrees`` is no correction but a wrong place. Trials are seeded by the pair; a
    rejected pair keeps the identity.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "z", "rx", "ry", "rz"])
        a, b = pdf[["x", "y", "z"]].to_numpy(), pdf[["rx", "ry", "rz"]].to_numpy()
        held = np.arange(len(a)) % holdout == 0
        fit, best = np.flatnonzero(~held), np.empty(0, dtype=int)
        motion, ok = (np.eye(3), np.zeros(3)), False
        if len(a) >= least_matches:
            random = np.random.default_rng(int(pdf.pair_id.iloc[0]))
            best = fit[_most_inliers(a, b, fit, random, trials, inlier)]
            if len(best) >= least and len(best) >= share * len(fit):
                found = horn(a[best], b[best])
                before, after = _apart(a[held], b[held], motion), _apart(a[held], b[held], found)
                was, now = np.median(before), np.median(after)
                small = np.linalg.norm(found[1]) <= most_shift and np.degrees(np.linalg.norm(rotation_vector(found[0]))) <= most_degrees
                ok = bool(small and was > 0.005 and now < inlier and now < 0.8 * was and (after < close).mean() >= 0.75)
                motion = found if ok else motion
        return pd.DataFrame({"pair_id": [pdf.pair_id.iloc[0]], "inliers": [len(best)], "accepted": [ok], "motion": [[*motion[0].reshape(-1), *motion[1]]]})

    return matches.groupBy("pair_id").applyInPandas(solve, "pair_id long, inliers int, accepted boolean, motion array<double>")


def _apart(a: np.ndarray, b: np.ndarray, motion: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.linalg.norm(a @ motion[0].T + motion[1] - b, axis=1)


def _most_inliers(a, b, fit, random, trials: int, inlier: float, least_area: float = 0.01) -> np.ndarray:
    """Which of ``fit`` lie within ``inlier`` under the best of the motions of three matches each, the first of equal ones; threes nearly in line give none. All trials at once."""
    three = np.stack([random.choice(fit, 3, replace=False) for _ in range(trials)])
    p, q = a[three], b[three]
    around = q - q.mean(axis=1, keepdims=True)
    area = np.max([np.linalg.norm(np.cross(around[:, i], around[:, j]), axis=1) for i, j in ((0, 1), (0, 2), (1, 2))], axis=0)
    turn, shift = _horns(p, q)
    near = np.linalg.norm(a[fit] @ np.swapaxes(turn, 1, 2) + shift[:, None] - b[fit], axis=2) < inlier
    near[~(area > least_area)] = False
    return near[near.sum(axis=1).argmax()]


def _horns(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``horn`` of many sets of points (n, points, 3)."""
    ca, cb = a.mean(1), b.mean(1)
    s = np.swapaxes(a - ca[:, None], 1, 2) @ (b - cb[:, None])
    trace = np.trace(s, axis1=1, axis2=2)
    d = np.stack([s[:, 1, 2] - s[:, 2, 1], s[:, 2, 0] - s[:, 0, 2], s[:, 0, 1] - s[:, 1, 0]], axis=1)
    n = np.empty((len(a), 4, 4))
    n[:, 0, 0], n[:, 0, 1:], n[:, 1:, 0] = trace, d, d
    n[:, 1:, 1:] = s + np.swapaxes(s, 1, 2) - trace[:, None, None] * np.eye(3)
    w, x, y, z = np.linalg.eigh(n)[1][:, :, -1].T
    r = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=1).reshape(-1, 3, 3)
    return r, cb - (r @ ca[:, :, None])[:, :, 0]


def conjugate_gradients(apply, right: np.ndarray, rounds: int = 200, tolerance: float = 1e-10, nearly=None) -> np.ndarray:
    """Solution of a symmetric positive system given as a function; ``nearly`` solves a system like it and saves rounds.

    Ends when the squared residual (weighed by ``nearly``) falls below ``tolerance``.
    """
    x = np.zeros_like(right)
    r = right - apply(x)
    z = nearly(r) if nearly else r
    p, rz = z.copy(), float((r * z).sum())
    for _ in range(rounds):
        if rz < tolerance:
            break
        ap = apply(p)
        alpha = rz / float((p * ap).sum())
        x += alpha * p
        r -= alpha * ap
        z = nearly(r) if nearly else r
        new = float((r * z).sum())
        p = z + new / rz * p
        rz = new
    return x


def pose_graph(frames: DataFrame, loops: DataFrame, chain_weight: float = 100.0, loop_weight: float = 200.0, damping: float = 0.002) -> DataFrame:
    """Six-axis corrections (rotation vector, shift) of a scan's frames from loop edges (scan_id, a, b, c0..c5).

    Neighbours in time should move alike, the ends of a loop as it says (b
    relative to a), and everything little; the first frame stays. frames:
    scan_id, id, and if they are there timestamp (else the id orders) and
    usable: frames that are not usable take no part and get what lies between
    their usable neighbours, turns by slerp, shifts linear; before the first
    and after the last the nearest one's.
    """

    def solve(key, fr: pd.DataFrame, lo: pd.DataFrame) -> pd.DataFrame:
        fr = fr.assign(t=fr.timestamp if "timestamp" in fr else fr.id).sort_values(["t", "id"])
        base = fr[fr.usable.fillna(False).astype(bool)] if "usable" in fr else fr
        at = {v: i for i, v in enumerate(base.id.tolist())}
        lo = lo[lo.a.isin(at) & lo.b.isin(at)]
        a, b = np.array([at[v] for v in lo.a], dtype=int), np.array([at[v] for v in lo.b], dtype=int)
        want = lo[[f"c{i}" for i in range(6)]].to_numpy(dtype=float).reshape(-1, 6)
        n = len(base)
        a, b = np.concatenate([np.arange(max(n - 1, 0)), a]), np.concatenate([np.arange(1, max(n, 1)), b])
        want = np.concatenate([np.zeros((max(n - 1, 0), 6)), want])
        w = np.where(np.arange(len(a)) < n - 1, chain_weight, loop_weight)[:, None]
        free = np.ones((n, 1))
        free[:1] = 0.0

        def spread(pull):
            out = np.zeros((n, 6))
            np.add.at(out, b, pull)
            np.add.at(out, a, -pull)
            return out * free

        x = conjugate_gradients(lambda x: spread(w * (x[b] - x[a])) + damping * x, spread(w * want), 2 * n + 50) if len(lo) else np.zeros((n, 6))
        c = _between(base.t.to_numpy(dtype=float), x, fr.t.to_numpy(dtype=float))
        return pd.DataFrame({"scan_id": [key[0]] * len(fr), "id": fr.id.to_numpy()} | {f"c{i}": c[:, i] for i in range(6)})

    kind = frames.schema["scan_id"].dataType.simpleString()
    loops = loops.toDF(*loops.columns)  # new column identities, in case both come from one table
    return frames.groupBy("scan_id").cogroup(loops.groupBy("scan_id")).applyInPandas(solve, f"scan_id {kind}, id long, " + ", ".join(f"c{i} double" for i in range(6)))


def corrected_poses(poses: DataFrame, corrections: DataFrame, most_shift: float = 0.15, most_degrees: float = 5.0, step_shift: float = 0.02, step_turn: float = 0.01) -> DataFrame:
    """C13's guard: (scan_id, id, qw..qz, tx, ty, tz, status) of poses moved by their corrections, a scan as a whole or not at all.

    poses: scan_id, id, qw, qx, qy, qz, tx, ty, tz (camera to world);
    corrections: scan_id, id, c0..c5 as ``pose_graph`` gives them, applied from
    the left. A scan keeps its poses with status ``excessiveCorrection`` if a
    centre moves over ``most_shift`` or a frame turns over ``most_degrees``, and
    with ``odometryChanged`` if the motion between neighbours (by id) changes
    by ``step_shift`` metres or ``step_turn`` radians. Frames without a
    correction stay as they are. All of it is expressions and windows.
    """
    q, t, d = ("qw", "qx", "qy", "qz"), ("tx", "ty", "tz"), ("dw", "dx", "dy", "dz")
    own = poses.select("scan_id", "id", *q, *t).join(corrections.select("scan_id", "id", *[f"c{i}" for i in range(6)]), ["scan_id", "id"], "left").na.fill(0.0, [f"c{i}" for i in range(6)])
    own = own.withColumn("turn", F.sqrt(F.col("c0") ** 2 + F.col("c1") ** 2 + F.col("c2") ** 2))
    half = F.when(F.col("turn") > 1e-12, F.sin(F.col("turn") / 2) / F.col("turn")).otherwise(0.5)
    own = own.withColumns({"dw": F.cos(F.col("turn") / 2)} | {n: F.col(f"c{i}") * half for i, n in enumerate(d[1:])})
    columns = lambda names, by="": [F.col(by + n) for n in names]
    moved = _turned(columns(d), columns(t))
    own = own.withColumns({f"n{a}": b for a, b in zip(q, _quaternion_product(columns(d), columns(q)), strict=True)} | {f"n{n}": m + F.col(f"c{i + 3}") for i, (n, m) in enumerate(zip(t, moved, strict=True))})
    before = Window.partitionBy("scan_id").orderBy("id")
    names = (*q, *t, *[f"n{n}" for n in (*q, *t)])
    own = own.withColumns({f"l{n}": F.lag(n).over(before) for n in names})

    def step(kind):
        back = [F.col(f"l{kind}qw"), *[-F.col(f"l{kind}{n}") for n in q[1:]]]
        return _turned(back, [F.col(kind + n) - F.col(f"l{kind}{n}") for n in t]), _quaternion_product(back, columns(q, kind))

    (s0, r0), (s1, r1) = step(""), step("n")
    own = own.withColumns({f"s{i}": a - b for i, (a, b) in enumerate(zip(s1, s0, strict=True))} | {f"r{i}": x for i, x in enumerate(r0)} | {f"u{i}": x for i, x in enumerate(r1)})
    cosine = sum((F.col(f"r{i}") * F.col(f"u{i}") for i in range(1, 4)), F.col("r0") * F.col("u0"))
    length = lambda xs: F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))
    far = (length([F.col(f"n{n}") - F.col(n) for n in t]) > most_shift) | (F.degrees("turn") > most_degrees)
    bent = (length([F.col(f"s{i}") for i in range(3)]) >= step_shift) | (2 * F.acos(F.least(F.abs(cosine), F.lit(1.0))) >= step_turn)
    whole = Window.partitionBy("scan_id")
    judged = own.withColumn("status", F.when(F.max(far).over(whole), "excessiveCorrection").when(F.coalesce(F.max(bent).over(whole), F.lit(False)), "odometryChanged").otherwise("corrected"))
    return judged.select("scan_id", "id", *[F.when(F.col("status") == "corrected", F.col(f"n{n}")).otherwise(F.col(n)).alias(n) for n in (*q, *t)], "status")


def _quaternion_product(a, b):
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return [aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw]


def _turned(q, v):
    """A vector turned by a unit quaternion."""
    w, x, y, z = q
    c = [2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])]
    return [v[0] + w * c[0] + y * c[2] - z * c[1], v[1] + w * c[1] + z * c[0] - x * c[2], v[2] + w * c[2] + x * c[1] - y * c[0]]


def _between(times: np.ndarray, x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Corrections at the ``wanted`` times from those at the ascending ``times``."""
    out = np.zeros((len(wanted), 6))
    if not len(times):
        return out
    for i, t in enumerate(wanted):
        b = min(int(np.searchsorted(times, t)), len(times) - 1)
        if times[b] == t or b == 0:
            out[i] = x[b]
            continue
        a = b - 1
        f = min(1.0, (t - times[a]) / (times[b] - times[a]))
        ra, rb = rotation(x[a, :3]), rotation(x[b, :3])
        out[i, :3] = rotation_vector(ra @ rotation(f * rotation_vector(ra.T @ rb)))
        out[i, 3:] = (1 - f) * x[a, 3:] + f * x[b, 3:]
    return out


def _residuals(points, poses, obs, k):
    """Pixel errors of observations (frame, track, u, v) under world-to-camera rotation vectors and shifts (GL axes)."""
    r = rotations(poses[:, :3])
    cam = np.einsum("nij,nj->ni", r[obs[:, 0].astype(int)], points[obs[:, 1].astype(int)]) + poses[obs[:, 0].astype(int), 3:]
    z = np.where(np.abs(cam[:, 2]) > 1e-9, -cam[:, 2], 1e-9)
    return np.stack([k[0] * cam[:, 0] / z + k[2] - obs[:, 2], k[3] - k[1] * cam[:, 1] / z - obs[:, 3]], axis=1)


def _jacobians(points, poses, obs, k, base):
    """How the pixel errors change with each observation's pose (n, 2, 6) and point (n, 2, 3)."""
    frame, track = obs[:, 0].astype(int), obs[:, 1].astype(int)
    jp, jx = np.empty((len(obs), 2, 6)), np.empty((len(obs), 2, 3))
    for d in range(6):
        moved = poses.copy()
        moved[:, d] += 1e-6
        jp[:, :, d] = (_residuals(points, moved, obs, k) - base) / 1e-6
    for d in range(3):
        moved = points.copy()
        moved[:, d] += 1e-6
        jx[:, :, d] = (_residuals(moved, poses, obs, k) - base) / 1e-6
    return frame, track, jp, jx


def _gathered(index, values, n):
    """Sums of ``values`` by index, a column at a time."""
    flat = values.reshape(len(values), -1)
    out = np.stack([np.bincount(index, flat[:, c], n) for c in range(flat.shape[1])], axis=1) if len(values) else np.zeros((n, flat.shape[1]))
    return out.reshape(n, *values.shape[1:])


def _robust(e, huber):
    """Huber weights of pixel errors, and their cost."""
    size = np.linalg.norm(e, axis=1)
    cost = np.where(size <= huber, size**2 / 2, huber * (size - huber / 2)).sum()
    return np.minimum(1.0, huber / np.maximum(size, 1e-9)), float(cost)


def _solved_points(points, poses, obs, k, huber, prior, rounds=8):
    """Places of the tracks under given poses, each by itself."""
    start, points = points, points.copy()
    for _ in range(rounds):
        base = _residuals(points, poses, obs, k)
        _, track, _, jx = _jacobians(points, poses, obs, k, base)
        w = _robust(base, huber)[0][:, None, None]
        h = _gathered(track, np.swapaxes(jx, 1, 2) @ (w * jx), len(points)) + prior * np.eye(3)
        g = _gathered(track, (np.swapaxes(jx, 1, 2) @ (w * base[:, :, None]))[:, :, 0], len(points)) + prior * (points - start)
        points = points - np.linalg.solve(h, g[:, :, None])[:, :, 0]
    return points


@dataclass(frozen=True)
class MotionPrior:
    """How far the motion between neighbouring frames, and each frame by itself, may stray from the input's: standard deviations, and the longest gap in seconds that still counts."""

    metres: float = 0.0003
    degrees: float = 0.01
    longest_gap: float = 0.5
    frame_metres: float = 0.05
    frame_degrees: float = 1.0


def bundle_adjustment(observations: DataFrame, rounds: int = 30, huber: float = 2.0, prior: float = 1e-4, improve: float = 0.03, holdout: int = 5, motion: MotionPrior | None = None) -> DataFrame:
    """Poses and points of each scan solved together by damped Gauss-Newton with Huber weights; points are eliminated in each step.

    The reduced system of the poses is never formed: conjugate gradients need
    only its product with a vector, which goes through the observations, and
    a block-tridiagonal system (each frame's own block and the motion between
    neighbours) makes them short. So memory follows the observations, not the
    square of the frames.

    A weak pull to the start holds what the images leave open (scale), the
    first frame holds place and direction; with ``motion`` each frame's move
    from the one before is held to the input's. observations: scan_id,
    frame_id, track_id, u, v, pose (6 numbers, world to camera: rotation
    vector and shift), px, py, pz (track's start), fx, fy, cx, cy, and for
    ``motion`` timestamp. Frames are in order of frame_id. Tracks of remainder
    ``holdout - 1`` take no part; their points are solved anew under the old
    and the new poses, and the result stands if their median error falls by
    ``improve``, else the input poses come back.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_id", "track_id", "u", "v"])
        frames, fi = np.unique(pdf.frame_id, return_inverse=True)
        tracks, ti = np.unique(pdf.track_id, return_inverse=True)
        first = np.unique(fi, return_index=True)[1]
        start = np.stack([np.asarray(pdf.pose.iloc[i], dtype=float) for i in first])
        given = pdf[["px", "py", "pz"]].to_numpy(dtype=float)[np.unique(ti, return_index=True)[1]]
        obs = np.stack([fi, ti, pdf.u, pdf.v], axis=1).astype(float)
        k = pdf[["fx", "fy", "cx", "cy"]].iloc[0].to_numpy(dtype=float)
        test = tracks[ti] % holdout == holdout - 1

        def judged(poses):
            if not test.any():
                return np.inf
            points = _solved_points(given, poses, obs[test], k, huber, prior)
            return float(np.median(np.linalg.norm(_residuals(points, poses, obs[test], k), axis=1)))

        chain = _Chain(start, pdf.timestamp.to_numpy(dtype=float)[first], motion) if motion else None
        poses = _adjusted(start, given, obs[~test], k, rounds, huber, prior, chain)
        before, after = judged(start), judged(poses)
        ok = bool(np.isfinite(poses).all() and after <= (1 - improve) * before and np.isfinite(before))
        out = poses if ok else start
        return pd.DataFrame({"scan_id": [pdf.scan_id.iloc[0]] * len(frames), "frame_id": frames.astype(np.int64), "pose": list(out), "accepted": ok, "before": before, "after": after})

    kind = observations.schema["scan_id"].dataType.simpleString()
    return observations.groupBy("scan_id").applyInPandas(solve, f"scan_id {kind}, frame_id long, pose array<double>, accepted boolean, before double, after double")


class _Chain:
    """The motion prior as residuals of neighbouring poses: turn and shift from frame to frame against the input's, in standard deviations."""

    def __init__(self, start: np.ndarray, times: np.ndarray, motion: MotionPrior):
        gap = np.diff(times)
        self.at = np.flatnonzero((gap >= 0) & (gap <= motion.longest_gap))
        self.scale = 1 / np.array([np.radians(motion.degrees)] * 3 + [motion.metres] * 3)
        self.turn, self.shift = self._relative(start)
        self.start, self.pull = start, 1 / np.array([np.radians(motion.frame_degrees)] * 3 + [motion.frame_metres] * 3) ** 2

    def _relative(self, poses):
        a, b = poses[self.at], poses[self.at + 1]
        turn = rotations(b[:, :3]) @ np.swapaxes(rotations(a[:, :3]), 1, 2)
        return turn, b[:, 3:] - (turn @ a[:, 3:, None])[:, :, 0]

    def residuals(self, poses: np.ndarray) -> np.ndarray:
        turn, shift = self._relative(poses)
        d = turn @ np.swapaxes(self.turn, 1, 2)
        # for the small turns that the prior allows, the skew part is the rotation vector
        w = np.stack([d[:, 2, 1] - d[:, 1, 2], d[:, 0, 2] - d[:, 2, 0], d[:, 1, 0] - d[:, 0, 1]], axis=1) / 2
        return np.concatenate([w, shift - self.shift], axis=1) * self.scale

    def cost(self, poses: np.ndarray) -> float:
        return float((self.residuals(poses) ** 2).sum() + (self.pull * (poses - self.start) ** 2).sum()) / 2

    def blocks(self, poses: np.ndarray):
        """Gradient (n, 6), diagonal blocks (n, 6, 6) and couplings to the next frame (n - 1, 6, 6)."""
        base, n = self.residuals(poses), len(poses)
        jacobian = np.zeros((2, len(self.at), 6, 6))
        for d in range(6):
            for side in (0, 1):  # every second frame moves at a time, so that a link sees one end move
                for parity in (0, 1):
                    moved = poses.copy()
                    own = (self.at + side) % 2 == parity
                    moved[(self.at + side)[own], d] += 1e-6
                    jacobian[side, own, :, d] = ((self.residuals(moved) - base) / 1e-6)[own]
        ja, jb = jacobian
        ta, tb = np.swapaxes(ja, 1, 2), np.swapaxes(jb, 1, 2)
        gradient, diagonal, upper = np.zeros((n, 6)), np.zeros((n, 6, 6)), np.zeros((max(n - 1, 0), 6, 6))
        gradient[self.at] += (ta @ base[:, :, None])[:, :, 0]
        gradient[self.at + 1] += (tb @ base[:, :, None])[:, :, 0]
        diagonal[self.at] += ta @ ja
        diagonal[self.at + 1] += tb @ jb
        upper[self.at] = ta @ jb
        return gradient + self.pull * (poses - self.start), diagonal + np.diag(self.pull), upper


def _pose_step(u, v_inverse, cross, frame, track, gp, gx, upper, rounds=1000, tolerance=1e-22):
    """Step of the free poses (all but the first) of the reduced system, by conjugate gradients over the observations."""
    n = len(u)
    seen = _gathered(frame, cross @ v_inverse[track] @ np.swapaxes(cross, 1, 2), n)
    turned = np.swapaxes(cross, 1, 2)

    def apply(x):
        full = np.concatenate([np.zeros((1, 6)), x])
        pulled = (v_inverse @ _gathered(track, (turned @ full[frame][:, :, None])[:, :, 0], len(v_inverse))[:, :, None])[:, :, 0]
        out = (u @ full[:, :, None])[:, :, 0] - _gathered(frame, (cross @ pulled[track][:, :, None])[:, :, 0], n)
        out[:-1] += (upper @ full[1:, :, None])[:, :, 0]
        out[1:] += (np.swapaxes(upper, 1, 2) @ full[:-1, :, None])[:, :, 0]
        return out[1:]

    right = gp - _gathered(frame, (cross @ (v_inverse @ gx[:, :, None])[track])[:, :, 0], n)
    nearly = BlockTridiagonal((u - seen)[1:], upper[1:])
    size = float((right[1:] * nearly.solve(right[1:])).sum())
    return -conjugate_gradients(apply, right[1:], rounds, max(tolerance * size, 1e-300), nearly.solve)


def _adjusted(start, given, obs, k, rounds, huber, prior, chain=None):
    """The joint solve: normal equations of poses and points, points eliminated track by track."""
    poses, points, damping, n = start.copy(), given.copy(), 1e-6, len(start)

    def cost(poses, points):
        own = _robust(_residuals(points, poses, obs, k), huber)[1] + prior / 2 * float(((poses - start) ** 2).sum() + ((points - given) ** 2).sum())
        return own + (chain.cost(poses) if chain else 0.0)

    now = cost(poses, points)
    for _ in range(rounds if len(obs) and n > 1 else 0):
        base = _residuals(points, poses, obs, k)
        frame, track, jp, jx = _jacobians(points, poses, obs, k, base)
        w = _robust(base, huber)[0][:, None, None]
        tp, tx, e = np.swapaxes(jp, 1, 2), np.swapaxes(jx, 1, 2), base[:, :, None]
        u = _gathered(frame, tp @ (w * jp), n) + (prior + damping) * np.eye(6)
        v = np.linalg.inv(_gathered(track, tx @ (w * jx), len(points)) + (prior + damping) * np.eye(3))
        gp = _gathered(frame, (tp @ (w * e))[:, :, 0], n) + prior * (poses - start)
        gx = _gathered(track, (tx @ (w * e))[:, :, 0], len(points)) + prior * (points - given)
        cross, upper = tp @ (w * jx), np.zeros((n - 1, 6, 6))
        if chain:
            gradient, diagonal, upper = chain.blocks(poses)
            gp, u = gp + gradient, u + diagonal
        step = np.zeros_like(poses)
        step[1:] = _pose_step(u, v, cross, frame, track, gp, gx, upper)
        pull = gx + _gathered(track, (np.swapaxes(cross, 1, 2) @ step[frame][:, :, None])[:, :, 0], len(points))
        moved = points - (v @ pull[:, :, None])[:, :, 0]
        then = cost(poses + step, moved)
        if then < now:
            done = now - then <= 1e-12 * max(now, 1e-12)
            poses, points, now, damping = poses + step, moved, then, max(damping / 4, 1e-9)
            if done:
                break
        else:
            damping *= 16
            if damping > 1e6:
                break
    return poses


def plane_icp(matches: DataFrame, rounds: int = 10, holdout: int = 5) -> DataFrame:
    """C11: point-to-plane motion of each window from matched points and target normals; every ``holdout``-th match only judges.

    matches: window_id, x, y, z, rx, ry, rz, nx, ny, nz. Rejected motions are
    the identity.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, n = (pdf[c].to_numpy(dtype=float) for c in (["x", "y", "z"], ["rx", "ry", "rz"], ["nx", "ny", "nz"]))
        test = np.arange(len(p)) % holdout == holdout - 1
        r, t = np.eye(3), np.zeros(3)
        for _ in range(rounds):
            m = p[~test] @ r.T + t
            j = np.concatenate([np.cross(m, n[~test]), n[~test]], axis=1)
            e = ((m - q[~test]) * n[~test]).sum(1)
            step = -np.linalg.solve(j.T @ j + 1e-9 * np.eye(6), j.T @ e)
            d = rotation(step[:3])
            r, t = d @ r, d @ t + step[3:]
        err = lambda r, t: float(np.sqrt((((p[test] @ r.T + t - q[test]) * n[test]).sum(1) ** 2).mean())) if test.any() else np.inf
        before, after = err(np.eye(3), np.zeros(3)), err(r, t)
        ok = bool(after < before)
        if not ok:
            r, t = np.eye(3), np.zeros(3)
        return pd.DataFrame({"window_id": [pdf.window_id.iloc[0]], "accepted": [ok], "before": [before], "after": [after], "motion": [[*r.reshape(-1), *t]]})

    return matches.groupBy("window_id").applyInPandas(solve, "window_id long, accepted boolean, before double, after double, motion array<double>")


def photometric_gate(samples: DataFrame, least_pairs: int = 3, gain: float = 0.0, worse: float = 0.05, share: float = 0.2) -> DataFrame:
    """C14: whether new poses of a scan are photometrically no worse: NCC before and after on the same samples of each pair.

    samples: scan_id, pair_id, reference, before, after, gradient; the 30 per
    cent strongest gradients of a pair count. Accepted if the median change
    reaches ``gain`` and at most ``share`` of pairs lose ``worse`` or more.
    All of it is aggregates.
    """
    cut = samples.groupBy("scan_id", "pair_id").agg(F.percentile("gradient", F.lit(0.7)).alias("cut"))
    strong = samples.join(cut, ["scan_id", "pair_id"]).filter("gradient >= cut")
    pair = strong.groupBy("scan_id", "pair_id").agg(F.corr("reference", "before").alias("b"), F.corr("reference", "after").alias("a"), F.count("*").alias("n")).withColumn("change", F.col("a") - F.col("b"))
    out = pair.filter("change is not null").groupBy("scan_id").agg(F.count("*").alias("pairs"), F.percentile("change", F.lit(0.5)).alias("change"), F.avg((F.col("change") <= -worse).cast("int")).alias("lost"))
    return out.withColumn("accepted", (F.col("pairs") >= least_pairs) & (F.col("change") >= gain) & (F.col("lost") <= share))


def staged_refinement(stages: list, gate, frames: DataFrame) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """Each (name, refine) in order on what the last accepted one gave; ``gate(before, after)`` decides.

    The driver sees one verdict a stage; tables stay distributed.
    """
    log = []
    for name, refine in stages:
        candidate = refine(frames)
        ok = bool(gate(frames, candidate))
        log.append((name, ok))
        if ok:
            frames = candidate
    return frames, log


def lucas_kanade(a: np.ndarray, b: np.ndarray, at: np.ndarray, size: int = 4, levels: int = 3, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Positions in image b of points (u, v) of image a, coarse to fine, and whether each converged inside."""
    pyramid = [(a.astype(float), b.astype(float))]
    for _ in range(levels - 1):
        pyramid.append(tuple(m[: m.shape[0] // 2 * 2, : m.shape[1] // 2 * 2].reshape(m.shape[0] // 2, 2, m.shape[1] // 2, 2).mean((1, 3)) for m in pyramid[-1]))
    reach = np.arange(-size, size + 1)
    du, dv = np.meshgrid(reach, reach)

    def sample(image, u, v):
        u, v = np.clip(u, 0, image.shape[1] - 1.001), np.clip(v, 0, image.shape[0] - 1.001)
        i, j = v.astype(int), u.astype(int)
        fu, fv = u - j, v - i
        return image[i, j] * (1 - fu) * (1 - fv) + image[i, j + 1] * fu * (1 - fv) + image[i + 1, j] * (1 - fu) * fv + image[i + 1, j + 1] * fu * fv

    flow, ok = np.zeros((len(at), 2)), np.ones(len(at), dtype=bool)
    for level in range(levels - 1, -1, -1):
        ia, ib = pyramid[level]
        gv, gu = np.gradient(ia)
        base = at / 2**level
        flow *= 2 if level < levels - 1 else 1
        for n, (u, v) in enumerate(base):
            pu, pv = u + du, v + dv
            t, gx, gy = sample(ia, pu, pv), sample(gu, pu, pv), sample(gv, pu, pv)
            h = np.array([[(gx * gx).sum(), (gx * gy).sum()], [(gx * gy).sum(), (gy * gy).sum()]])
            if np.linalg.det(h) < 1e-6:
                ok[n] = False
                continue
            for _ in range(rounds):
                e = sample(ib, pu + flow[n, 0], pv + flow[n, 1]) - t
                step = -np.linalg.solve(h, [(gx * e).sum(), (gy * e).sum()])
                flow[n] += step
                if np.abs(step).max() < 1e-3:
                    break
    to = at + flow
    inside = (to[:, 0] >= 0) & (to[:, 1] >= 0) & (to[:, 0] < b.shape[1]) & (to[:, 1] < b.shape[0])
    return to, ok & inside


def tracked(pairs: DataFrame, forward_backward: float = 1.0) -> DataFrame:
    """Image pairs (pair_id, width, height, luma_a, luma_b, points array<struct<id,u,v>>) to tracked points whose way back ends within a pixel."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                a, b = (np.frombuffer(x, dtype=np.uint8).reshape(row.height, row.width) for x in (row.luma_a, row.luma_b))
                at = np.array([[p["u"], p["v"]] for p in row.points], dtype=float).reshape(-1, 2)
                to, ok = lucas_kanade(a, b, at)
                back, ok2 = lucas_kanade(b, a, to)
                good = ok & ok2 & (np.linalg.norm(back - at, axis=1) <= forward_backward)
                yield pd.DataFrame({"pair_id": row.pair_id, "id": [p["id"] for p, g in zip(row.points, good, strict=True) if g], "u": to[good, 0], "v": to[good, 1]})

    return pairs.mapInPandas(run, "pair_id long, id long, u double, v double")


def feature_tracks(matches: DataFrame, features: DataFrame) -> DataFrame:
    """Track of each feature: features that matches join across frames are one track, named by its least feature.

    features: scan_id, feature_id, frame_id; matches: feature ids a, b of one
    scan. Tracks with two features in a frame are split off: only each
    frame's first feature stays.
    """
    from stereoloom.operators.graph import connected_components

    named = connected_components(matches.select("a", "b"), features.select(F.col("feature_id").alias("node")))
    own = features.join(named.select(F.col("node").alias("feature_id"), F.col("component").alias("track_id")), "feature_id")
    first = F.row_number().over(Window.partitionBy("track_id", "frame_id").orderBy("feature_id"))
    return own.withColumn("n", first).filter("n = 1").drop("n")


def plane_warp_match(templates: DataFrame, reach: int = 6, least: float = 0.8) -> DataFrame:
    """Where a template (pair_id, id, size, patch bytes) fits best in a search window (window bytes of (size + 2 * reach)**2): offset and correlation."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                t = np.frombuffer(row.patch, dtype=np.uint8).reshape(row.size, row.size).astype(float)
                w = np.frombuffer(row.window, dtype=np.uint8).reshape(row.size + 2 * reach, row.size + 2 * reach).astype(float)
                views = np.lib.stride_tricks.sliding_window_view(w, (row.size, row.size)).reshape(-1, row.size * row.size)
                views = views - views.mean(1, keepdims=True)
                flat = t.reshape(-1) - t.mean()
                norm = np.linalg.norm(views, axis=1) * np.linalg.norm(flat)
                ncc = np.where(norm > 0, views @ flat / np.where(norm > 0, norm, 1), -1)
                best = int(ncc.argmax())
                if ncc[best] >= least:
                    out.append((row.pair_id, row.id, best % (2 * reach + 1) - reach, best // (2 * reach + 1) - reach, float(ncc[best])))
            yield pd.DataFrame(out, columns=["pair_id", "id", "du", "dv", "ncc"])

    return templates.withColumn("size", F.col("size").cast("int")).mapInPandas(run, "pair_id long, id long, du int, dv int, ncc double")
