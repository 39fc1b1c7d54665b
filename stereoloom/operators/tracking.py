"""Feature tracks over a scan's frames in order: a fold whose state is a handful of frames.

A frame's features are looked for where known poses put the features of the
kept frames (the last few, and fixed anchors). Only kept frames can still gain
observations, so a frame's rows leave when it does and the state stays small
however long a scan is. ``feature_tracker`` folds sorted rows of a table,
``feature_tracker_stream`` keeps the same state in a map in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RADIUS = 28.0
LEAST_NCC = 0.70
RATIO = 0.9
RECENT = 4
ANCHORS = 4
PER_FRAME = 2400
PER_SCAN = 200_000
#: Frames that are Python objects at one time, in a task.
FEW = 8

FRAME = "frame_id long, pose array<double>, fx double, fy double, cx double, cy double, width int, height int, features array<struct<id:long,u:double,v:double,depth:double,patch:binary>>, last boolean"
_KEPT = "seq long, pose binary, camera binary, id binary, u binary, v binary, depth binary, patch binary, track binary"
_OBSERVED = "frame_id long, track_id long, feature_id long, u double, v double, depth double"


def unit_patches(patches: list[bytes]) -> np.ndarray:
    """Patches without their mean and of unit length, so that a product of two is their correlation; flat ones are zero."""
    if not len(patches):
        return np.zeros((0, 1), np.float32)
    p = np.frombuffer(b"".join(patches), np.uint8).reshape(len(patches), -1).astype(np.float32)
    p = p - p.mean(axis=1, keepdims=True)
    size = np.linalg.norm(p, axis=1, keepdims=True)
    return np.where(size > 1e-6, p / np.where(size > 1e-6, size, 1), 0).astype(np.float32)


@dataclass
class TrackedFrame:
    """One frame's features by column; ``world`` are their places under the frame's own pose, ``track`` is -1 where none is known yet."""

    frame_id: int
    pose: np.ndarray  # camera to world, looking along -z, y up
    camera: np.ndarray  # fx, fy, cx, cy, width, height
    id: np.ndarray
    u: np.ndarray
    v: np.ndarray
    depth: np.ndarray
    patch: np.ndarray
    track: np.ndarray = field(default=None)
    seq: int = 0

    def __post_init__(self):
        fx, fy, cx, cy = self.camera[:4]
        eye = np.stack([(self.u - cx) / fx * self.depth, (cy - self.v) / fy * self.depth, -self.depth], axis=1)
        self.world = eye @ self.pose[:3, :3].T + self.pose[:3, 3]
        if self.track is None:
            self.track = np.full(len(self.id), -1, np.int64)

    @classmethod
    def of(cls, row) -> TrackedFrame:
        f = row["features"] if row["features"] is not None else []
        column = lambda name, kind: np.array([x[name] for x in f], dtype=kind)
        camera = np.array([row[c] for c in ("fx", "fy", "cx", "cy", "width", "height")], dtype=float)
        return cls(int(row["frame_id"]), np.array(row["pose"], dtype=float).reshape(4, 4), camera, column("id", np.int64), column("u", float), column("v", float), column("depth", float), unit_patches([x["patch"] for x in f]))

    def seen_by(self, world: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Image places of world points, and which lie before the camera and no further outside than the search reaches."""
        fx, fy, cx, cy, width, height = self.camera
        eye = (world - self.pose[:3, 3]) @ self.pose[:3, :3]
        front = eye[:, 2] < -1e-4
        far = np.where(front, -eye[:, 2], 1.0)
        at = np.stack([cx + fx * eye[:, 0] / far, cy - fy * eye[:, 1] / far], axis=1)
        inside = (at >= -RADIUS).all(axis=1) & (at[:, 0] < width + RADIUS) & (at[:, 1] < height + RADIUS)
        return at, front & inside


def _nearby(at: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (place, feature) within the search radius, by cells of its size; ordered by place, then feature."""
    wide = 1 << 20
    cell = lambda x: np.floor(x / RADIUS).astype(np.int64) + (wide >> 1)
    fc, ac = cell(features), cell(at)
    order = np.argsort(fc[:, 0] * wide + fc[:, 1], kind="stable")
    keys = (fc[:, 0] * wide + fc[:, 1])[order]
    left, right = [], []
    for dx in (-1, 0, 1):  # a row of three cells is one range of keys
        low = (ac[:, 0] + dx) * wide + ac[:, 1] - 1
        a, b = np.searchsorted(keys, low, "left"), np.searchsorted(keys, low + 2, "right")
        n = b - a
        left.append(np.repeat(np.arange(len(at)), n))
        right.append(order[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
    i, j = np.concatenate(left), np.concatenate(right)
    near = ((at[i] - features[j]) ** 2).sum(axis=1) <= RADIUS**2
    i, j = i[near], j[near]
    order = np.lexsort((j, i))
    return i[order], j[order]


def _top_two(to: list[int], scores: list[float], taken: list[bool] | None = None) -> tuple[int, float, float]:
    """The first of the best that are not taken (-1: none is free), its score and the next one's; candidates are few, so that plain lists are faster than arrays."""
    hit, best, second = -1, -1.0, -1.0
    for k, s in zip(to, scores, strict=True):
        if taken is not None and taken[k]:
            continue
        if hit < 0 or s > best:
            hit, best, second = k, s, best if hit >= 0 else -1.0
        elif s > second:
            second = s
    return hit, best, second


def _clear(best: float, second: float) -> bool:
    return best >= LEAST_NCC and not (second > 0 and second / best > RATIO)


def _candidates(at: np.ndarray, visible: np.ndarray, patch: np.ndarray, seen: TrackedFrame) -> tuple[list, list, list, list]:
    """The visible places, and for the k-th of them candidates ``cuts[k]`` to ``cuts[k + 1]``: features near it and their correlations."""
    rows = np.flatnonzero(visible)
    i, j = _nearby(at[rows], np.stack([seen.u, seen.v], axis=1))
    score = np.einsum("ij,ij->i", patch[rows[i]], seen.patch[j]) if len(i) else np.empty(0)
    return np.searchsorted(i, np.arange(len(rows) + 1)).tolist(), rows.tolist(), j.tolist(), score.tolist()


class TrackFold:
    """The state between frames, and what one more frame does to it.

    ``counts`` of the last frame: features looked for, out of view, without a
    feature near, of low correlation, ambiguous, refused by the way back, matched.
    """

    def __init__(self, anchors: frozenset = frozenset(), reciprocal: bool = False, recent: int = RECENT, per_frame: int = PER_FRAME):
        self.anchors, self.reciprocal, self.recent, self.per_frame = frozenset(sorted(anchors)[:ANCHORS]), reciprocal, max(1, recent), per_frame
        self.kept: list[TrackedFrame] = []
        self.next_track = self.frames = 0
        self.counts = dict.fromkeys(("looked", "hidden", "none", "low", "ambiguous", "refused", "matched"), 0)

    def add(self, new: TrackedFrame) -> list[TrackedFrame]:
        """Match a frame with the kept ones, oldest first; returns the frames that leave. A frame without features changes nothing."""
        self.counts = dict.fromkeys(self.counts, 0)
        if not len(new.id):
            return []
        given: set[int] = set()
        for old in self.kept:
            self._match(old, new, given)
        new.seq, self.frames = self.frames, self.frames + 1
        self.kept.append(new)
        loose = [f for f in self.kept if f.frame_id not in self.anchors]
        if len(loose) <= self.recent:
            return []
        self.kept = [f for f in self.kept if f is not loose[0]]
        return [loose[0]]

    def _match(self, old: TrackedFrame, new: TrackedFrame, given: set[int]) -> None:
        n = self.counts
        at, visible = new.seen_by(old.world)
        n["looked"] += len(visible)
        n["hidden"] += int((~visible).sum())
        cuts, rows, j, score = _candidates(at, visible, old.patch, new)
        taken = (new.track >= 0).tolist()
        back = self._ways_back(old, new) if self.reciprocal else None
        for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True):
            hit, best, second = _top_two(j[a:b], score[a:b], taken)
            if hit < 0:
                n["none"] += 1
                continue
            if not _clear(best, second):
                n["low" if best < LEAST_NCC else "ambiguous"] += 1
                continue
            if self.reciprocal and (back[hit] != r or int(old.track[r]) in given or np.linalg.norm(new.world[hit] - old.world[r]) >= max(0.08, 0.04 * old.depth[r])):
                n["refused"] += 1
                continue
            if old.track[r] < 0:
                old.track[r] = self.next_track
                self.next_track += 1
            new.track[hit] = old.track[r]
            taken[hit] = True
            given.add(int(old.track[r]))
            n["matched"] += 1

    @staticmethod
    def _ways_back(old: TrackedFrame, new: TrackedFrame) -> list[int]:
        """For each feature of the new frame the old one's feature that is clearly the best where the old pose puts it, or -1. What is taken does not count."""
        cuts, rows, j, score = _candidates(*old.seen_by(new.world), new.patch, old)
        out = [-1] * len(new.id)
        for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True):
            hit, best, second = _top_two(j[a:b], score[a:b])
            if hit >= 0 and _clear(best, second):
                out[r] = hit
        return out

    def rest(self) -> list[TrackedFrame]:
        out, self.kept = self.kept, []
        return out

    def observations(self, left: list[TrackedFrame]) -> pd.DataFrame:
        """Rows of frames that leave: their features with a track; of more than ``per_frame`` those whose track hashes least, so that frames keep the same tracks."""
        parts = []
        for f in left:
            own = np.flatnonzero(f.track >= 0)
            code = (f.track[own].astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
            own = own[np.argsort(code, kind="stable")][: self.per_frame]
            parts.append(pd.DataFrame({"frame_id": f.frame_id, "track_id": f.track[own], "feature_id": f.id[own], "u": f.u[own], "v": f.v[own], "depth": f.depth[own], "seq": f.seq}))
        names = ["frame_id", "track_id", "feature_id", "u", "v", "depth", "seq"]
        return pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame(columns=names)


def _folded(frames: DataFrame, order: str, report: bool, **options):
    """Rows come by scan and order; one batch of frames and a fold's kept frames are held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan, fold = None, None
        for batch in batches:
            for row in _rows_of(batch):
                if fold is None or row["scan_id"] != scan:
                    if fold is not None and not report:
                        yield fold.observations(fold.rest()).assign(scan_id=scan)
                    scan, fold = row["scan_id"], TrackFold(**options)
                left = fold.add(TrackedFrame.of(row))
                if report:
                    yield pd.DataFrame([{"scan_id": scan, "frame_id": row["frame_id"], **fold.counts}])
                elif left:
                    yield fold.observations(left).assign(scan_id=scan)
        if fold is not None and not report:
            yield fold.observations(fold.rest()).assign(scan_id=scan)

    kind = frames.schema["scan_id"].dataType.simpleString()
    schema = f"scan_id {kind}, " + ("frame_id long, looked long, hidden long, none long, low long, ambiguous long, refused long, matched long" if report else f"{_OBSERVED}, seq long")
    columns = [c.split()[0] for c in schema.split(", ")]
    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or few bytes with much work would end in one task
    rows = frames.repartition(tasks, "scan_id").sortWithinPartitions("scan_id", order)
    arrow = pa.schema([(c, _ARROW[k]) for c, k in (x.split() for x in schema.split(", "))])
    return rows.mapInArrow(lambda b: (pa.RecordBatch.from_pandas(p[columns], arrow, preserve_index=False) for p in run(b)), schema)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "smallint": pa.int16(), "tinyint": pa.int8(), "date": pa.date32(), "binary": pa.binary()}


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows as Python objects, a few at a time: a frame's features are far larger so than in the batch."""
    for at in range(0, batch.num_rows, FEW):
        yield from batch.slice(at, FEW).to_pylist()


def feature_tracker(frames: DataFrame, order: str = "frame_id", least: int = 3, per_scan: int = PER_SCAN, **options) -> DataFrame:
    """(scan_id, frame_id, track_id, feature_id, u, v, depth) of tracks with ``least`` observations or more.

    frames: scan_id and ``FRAME``'s columns, a row a frame, taken by ``order``.
    Of a scan with more than ``per_scan`` observations the last ones count, by
    frame; that is a window, so no task holds them. Frames without features
    give nothing. ``options`` are those of ``TrackFold``.
    """
    found = _folded(frames, order, False, **options)
    late = Window.partitionBy("scan_id").orderBy(F.desc("seq"), "track_id", "feature_id").rowsBetween(Window.unboundedPreceding, 0)
    long = Window.partitionBy("scan_id", "track_id")
    found = found.withColumn("n", F.count("*").over(late)).filter(F.col("n") <= per_scan).withColumn("n", F.count("*").over(long))
    return found.filter(F.col("n") >= least).drop("n", "seq")


def tracker_report(frames: DataFrame, order: str = "frame_id", **options) -> DataFrame:
    """Why features of each frame found no match: counts of what was looked for, hidden, without a candidate, low, ambiguous, refused, matched."""
    return _folded(frames, order, True, **options)


def feature_tracker_stream(frames: DataFrame, **options) -> DataFrame:
    """C9 as a streaming query: observations leave with their frame, the rest when a frame says it is the ``last``.

    The state of a scan is a map from frame to its columns, of at most
    ``RECENT`` and ``ANCHORS`` entries, and two counters. Frames of a
    micro-batch are taken by frame_id. Track length is a matter of the reader.
    """
    kind = frames.schema["scan_id"].dataType.simpleString()
    columns = ["scan_id", *[c.split()[0] for c in _OBSERVED.split(", ")]]

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getMapState("kept", "frame_id long", _KEPT)
            self.numbers = handle.getValueState("numbers", "next_track long, frames long")

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
            fold = TrackFold(**options)
            if self.numbers.exists():
                fold.next_track, fold.frames = self.numbers.get()
            fold.kept = sorted((self._frame(k[0], v) for k, v in self.kept.iterator()), key=lambda f: f.seq) if self.kept.exists() else []
            known, left = {f.frame_id for f in fold.kept}, []
            for row in pd.concat(list(rows), ignore_index=True).sort_values("frame_id").to_dict("records"):
                left += fold.add(TrackedFrame.of(row))
                if row.get("last"):
                    left += fold.rest()
            for gone in known - {f.frame_id for f in fold.kept}:
                self.kept.removeKey((gone,))
            for f in fold.kept:  # an old frame's features may have gained a track
                self.kept.updateValue((f.frame_id,), (f.seq, *[np.ascontiguousarray(x).tobytes() for x in (f.pose, f.camera, f.id, f.u, f.v, f.depth, f.patch, f.track)]))
            self.numbers.update((fold.next_track, fold.frames))
            yield fold.observations(left).assign(scan_id=key[0])[columns]

        @staticmethod
        def _frame(frame_id: int, value) -> TrackedFrame:
            seq, pose, camera, ids, u, v, depth, patch, track = value
            ids = np.frombuffer(ids, np.int64)
            number = lambda x: np.frombuffer(x, float)
            return TrackedFrame(frame_id, number(pose).reshape(4, 4), number(camera), ids, number(u), number(v), number(depth), np.frombuffer(patch, np.float32).reshape(len(ids), -1), np.frombuffer(track, np.int64).copy(), seq)

        def close(self) -> None:
            pass

    return frames.groupBy("scan_id").transformWithStateInPandas(Processor(), f"scan_id {kind}, {_OBSERVED}", "Append", "None")
