"""Local surface refinement: each frame between two anchors is fitted to their depth images.

Correspondences are looked for anew in every step, by projection into the
anchors, where each pixel with a stable normal is a small surface. The frames
between two anchors come to one task behind them, so that normals are made once
a window; a task holds three frames at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stereoloom.operators.kernels import rotation, rotation_vector

DEPTH_FRAME = ("pose", "fx", "fy", "cx", "cy", "width", "height", "depth", "luma")


@dataclass(frozen=True)
class SurfaceRules:
    """Limits in metres, radians and shares."""

    every: int = 8
    near: float = 0.2
    far: float = 4.5
    apart: float = 0.08
    samples: int = 1800
    least_fit: int = 160
    least_held: int = 80
    rounds: int = 5
    robust: float = 0.015
    step_turn: float = 0.035
    step_shift: float = 0.05
    most_shift: float = 0.03
    most_turn: float = np.radians(1.5)
    #: Least eigenvalue of the normals' mean second moment; noise alone gives a wall some ten-thousandths.
    least_spread: float = 0.005
    lost: float = 0.05
    gain: float = 0.95


class DepthFrame:
    """Depth and luma on one grid with a pinhole camera in GL axes; pixels without a usable depth are NaN."""

    def __init__(self, row, rules: SurfaceRules):
        shape = (row["height"], row["width"])
        depth = np.frombuffer(row["depth"], np.float32).reshape(shape).astype(float)
        self.depth = np.where(np.isfinite(depth) & (depth > rules.near) & (depth < rules.far), depth, np.nan)
        self.luma = np.frombuffer(row["luma"], np.uint8).reshape(shape) / 255.0
        self.fx, self.fy, self.cx, self.cy = row["fx"], row["fy"], row["cx"], row["cy"]
        self.pose, self.rules = np.array(row["pose"], float).reshape(4, 4), rules
        v, u = np.mgrid[: shape[0], : shape[1]]
        self.local = np.stack([(u - self.cx) / self.fx * self.depth, (self.cy - v) / self.fy * self.depth, -self.depth], axis=-1)

    def with_normals(self) -> DepthFrame:
        """Unit normals in camera axes where both diagonals of the four neighbours agree on the plane, else NaN."""
        q, self.normal = self.local, np.full(self.local.shape, np.nan)
        left, right, top, below, here = q[1:-1, :-2], q[1:-1, 2:], q[:-2, 1:-1], q[2:, 1:-1], q[1:-1, 1:-1]
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
            n = unit(np.cross(right - left, below - top))
            same = (unit(np.cross(right - here, below - here)) * unit(np.cross(here - left, here - top))).sum(-1) > 0.98
            flat = np.maximum(np.abs(((left - here) * n).sum(-1)), np.abs(((top - here) * n).sum(-1))) < 0.01
            smooth = np.maximum(np.abs(left - right)[..., 2], np.abs(top - below)[..., 2]) < np.maximum(0.08, 0.15 * -here[..., 2])
        self.normal[1:-1, 1:-1] = np.where((same & flat & smooth)[..., None], n, np.nan)
        return self

    def seen(self, world: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pixel places and depths of world points; NaN outside the image."""
        eye = (world - self.pose[:3, 3]) @ self.pose[:3, :3]
        z = np.where(-eye[:, 2] > self.rules.near, -eye[:, 2], np.nan)
        u, v = self.fx * eye[:, 0] / z + self.cx, self.cy - self.fy * eye[:, 1] / z
        height, width = self.depth.shape
        inside = (u >= 1) & (v >= 1) & (u < width - 2) & (v < height - 2)
        return np.where(inside, u, np.nan), np.where(inside, v, np.nan), z

    def surfels(self, world: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The surface point and normal (world axes) at each point's nearest pixel, and which points have one within 10 cm of depth."""
        u, v, z = self.seen(world)
        ok = np.isfinite(u)
        i, j = np.where(ok, np.round(v), 0).astype(int), np.where(ok, np.round(u), 0).astype(int)
        point, normal = self.local[i, j], self.normal[i, j]
        ok &= np.isfinite(normal).all(axis=1) & (np.abs(z + point[:, 2]) < 0.10)
        return point @ self.pose[:3, :3].T + self.pose[:3, 3], normal @ self.pose[:3, :3].T, ok

    def held(self, world: np.ndarray, normal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance along a fixed normal to the depth measured on each point's line of sight, and the luma there; NaN where no depth lies within 8 cm."""
        u, v, z = self.seen(world)
        ok = np.isfinite(u)
        i, j = np.where(ok, v, 0).astype(int), np.where(ok, u, 0).astype(int)
        a, b = u - j, v - i
        d = (self.depth[i, j] * (1 - a) + self.depth[i, j + 1] * a) * (1 - b) + (self.depth[i + 1, j] * (1 - a) + self.depth[i + 1, j + 1] * a) * b
        off = ((world - self.pose[:3, 3]) * normal).sum(axis=1) * (1 - d / z)
        near = ok & (np.abs(z - d) < self.rules.apart)
        i, j = np.where(ok, np.round(v), 0).astype(int), np.where(ok, np.round(u), 0).astype(int)
        return np.where(near, off, np.nan), self.luma[i, j]


def surface_aligned(source: DepthFrame, anchors: list[DepthFrame], rules: SurfaceRules = SurfaceRules()) -> tuple[np.ndarray, str, float, float]:
    """Pose of a frame by point-to-plane steps against its anchors, why it was taken or not, and the held-out error before and after.

    Every fifth sample only judges: on the same held-out pairs the error must
    fall by a twentieth, few pairs may be lost, and the images must not
    disagree more than before. A geometry that leaves a direction open
    (one wall) is refused, not damped.
    """
    step = max(2, int(np.sqrt(source.depth.size / rules.samples)))
    rows, columns = np.meshgrid(np.arange(2, source.depth.shape[0] - 2, step), np.arange(2, source.depth.shape[1] - 2, step), indexing="ij")
    local, shade = source.local[rows, columns].reshape(-1, 3), source.luma[rows, columns].reshape(-1)
    good = np.isfinite(local).all(axis=1)
    local, shade = local[good], shade[good]
    judge = np.arange(len(local)) % 5 == 0
    world = lambda pose, of: local[of] @ pose[:3, :3].T + pose[:3, 3]
    pose, before = source.pose.copy(), []
    for anchor in anchors:
        p = world(pose, judge)
        _, normal, ok = anchor.surfels(p)
        off, there = anchor.held(p, normal)
        own = np.flatnonzero(ok & (np.abs(off) < rules.apart))
        before.append((anchor, own, normal[own], off[own], np.abs(shade[judge][own] - there[own])))
    if sum(len(b[1]) for b in before) < rules.least_held:
        return source.pose, "insufficientOverlap", 0.0, 0.0
    for _ in range(rules.rounds):
        p, jacobian, error = world(pose, ~judge), [], []
        for anchor in anchors:
            point, normal, ok = anchor.surfels(p)
            off = ((p - point) * normal).sum(axis=1)
            own = ok & (np.abs(off) < rules.apart)
            jacobian.append(np.concatenate([np.cross(p[own] - pose[:3, 3], normal[own]), normal[own]], axis=1))
            error.append(off[own])
        j, e = np.concatenate(jacobian), np.concatenate(error)
        if len(e) < rules.least_fit:
            return source.pose, "insufficientOverlap", 0.0, 0.0
        w = np.minimum(1.0, rules.robust / np.maximum(np.abs(e), 1e-4))
        h, g = j.T @ (w[:, None] * j), j.T @ (w * e)
        scale = np.sqrt(np.diag(h))
        spread = np.linalg.eigvalsh(j[:, 3:].T @ j[:, 3:] / len(j))[0]
        if spread < rules.least_spread or scale.min() <= 1e-5 or np.linalg.eigvalsh(h / np.outer(scale, scale))[0] <= 1e-3:
            return source.pose, "degenerate", 0.0, 0.0
        x = -np.linalg.solve(h, g)
        turn, shift = np.linalg.norm(x[:3]), np.linalg.norm(x[3:])
        if turn >= rules.step_turn or shift >= rules.step_shift:
            return source.pose, "excessiveCorrection", 0.0, 0.0
        pose[:3, :3], pose[:3, 3] = rotation(x[:3]) @ pose[:3, :3], pose[:3, 3] + x[3:]
        whole = np.linalg.norm(rotation_vector(pose[:3, :3] @ source.pose[:3, :3].T))
        if np.linalg.norm(pose[:3, 3] - source.pose[:3, 3]) > rules.most_shift or whole > rules.most_turn:
            return source.pose, "excessiveCorrection", 0.0, 0.0
        if turn < 1e-4 and shift < 1e-4:
            break
    was, now, was_image, now_image, lost = [], [], 0.0, 0.0, 0
    for anchor, own, normal, off, image in before:
        new, there = anchor.held(world(pose, judge)[own], normal)
        gone = ~np.isfinite(new)
        lost += int(gone.sum())
        was.append(off)
        now.append(np.where(gone, np.maximum(0.03, np.abs(off)), new))  # a lost pair cannot win
        was_image += image.sum()
        now_image += np.where(gone, image + 0.02, np.abs(shade[judge][own] - there)).sum()
    n = sum(map(len, was))
    first, last = (float(np.sqrt((np.concatenate(x) ** 2).mean())) for x in (was, now))
    if lost > rules.lost * n:
        return source.pose, "lostHoldout", first, last
    if first <= 0.001 or last >= rules.gain * first:
        return source.pose, "holdoutRejected", first, last
    if now_image > 1.02 * was_image + 0.002 * n:
        return source.pose, "imageHoldoutRejected", first, last
    return pose, "validated", first, last


def surface_refinement(frames: DataFrame, order: str = "timestamp", rules: SurfaceRules = SurfaceRules()) -> DataFrame:
    """C11: (scan_id, frame_id, pose, status, before, after) of every frame; anchors and refused frames keep their pose.

    frames: scan_id, frame_id, ``order``, pose (16 numbers), fx, fy, cx, cy,
    width, height, depth (float32 bytes) and luma (bytes). Frames with both
    rasters whole are numbered in order (ties by frame_id) within a scan;
    every ``rules.every``-th and the last are anchors. Others are left out.
    ``frames`` is read twice, once for its order alone.
    """
    size = F.col("width") * F.col("height")
    whole = frames.filter((F.octet_length("depth") == 4 * size) & (F.octet_length("luma") == size))
    in_order = Window.partitionBy("scan_id").orderBy(order, "frame_id")
    places = whole.select("scan_id", "frame_id", order).withColumn("n", F.row_number().over(in_order) - 1).withColumn("last", F.count("*").over(Window.partitionBy("scan_id")) - 1)
    first = (F.expr(f"n div {rules.every}") * rules.every).cast("long")
    anchor = (F.col("n") % rules.every == 0) | (F.col("n") == F.col("last"))
    closes = (F.col("n") % rules.every == 0) & (F.col("n") > 0)
    # a frame's own window, and the one before that it closes as an anchor
    windows = F.when(closes, F.array(F.struct(first.alias("window"), F.lit(True).alias("own")), F.struct((first - rules.every).alias("window"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(first.alias("window"), F.lit(True).alias("own"))))
    places = places.select("scan_id", "frame_id", "n", anchor.alias("anchor"), F.explode(windows).alias("w"))
    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or few bytes with much work would end in one task
    rows = whole.select("scan_id", "frame_id", *DEPTH_FRAME).join(places, ["scan_id", "frame_id"]).select("scan_id", "frame_id", *DEPTH_FRAME, "n", "anchor", "w.window", "w.own")
    rows = rows.repartition(tasks, "scan_id", "window").sortWithinPartitions("scan_id", "window", F.desc("anchor"), "n", "frame_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window, anchors = None, []
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if window != (row["scan_id"], row["window"]):
                    window, anchors = (row["scan_id"], row["window"]), []
                if row["anchor"]:
                    anchors.append(row)
                    if row["own"]:
                        out.append((row["scan_id"], row["frame_id"], row["pose"], "anchor", 0.0, 0.0))
                    continue
                anchors = [a if isinstance(a, DepthFrame) else DepthFrame(a, rules).with_normals() for a in anchors]
                pose, status, before, after = surface_aligned(DepthFrame(row, rules), anchors, rules)
                out.append((row["scan_id"], row["frame_id"], pose.reshape(-1).tolist(), status, before, after))
            yield pd.DataFrame(out, columns=["scan_id", "frame_id", "pose", "status", "before", "after"])

    kind, frame = (frames.schema[c].dataType.simpleString() for c in ("scan_id", "frame_id"))
    return rows.mapInPandas(run, f"scan_id {kind}, frame_id {frame}, pose array<double>, status string, before double, after double")
