"""W7 for all landmarks of a capture at once: one clock and one bound a scan, a state an entry a landmark.

``state.LandmarkAdmission`` says when a landmark is admitted; here live what
landmarks share. ``replay`` folds a table, ``stream`` keeps the same entries
in the state store: a micro-batch reads and writes those of its own landmarks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from stereoloom.streaming.state import LandmarkAdmission

#: Seconds of capture between two looks for landmarks that have waited too long.
LOOK = 0.5
#: How long the state store keeps what no sample has touched, by the wall clock: a capture is over by then.
KEPT_MS = 24 * 3_600_000
ROW = "landmark_id long, time double, x double, y double, z double"
_SAMPLE = ("landmark_id", "time", "epoch", "x", "y", "z", "cam_x", "cam_y", "cam_z")
_RUN = "run array<struct<t:double,place:array<double>,camera:array<double>>>"


class Entries:
    """Landmarks and what is known of them; ``changed`` are the ones to write back (None: gone)."""

    def __init__(self, stored=None, size: int = 0):
        self.stored, self.size, self.changed, self.cleared = stored, size, {}, False

    def get(self, key: int):
        if key not in self.changed and self.stored is not None and not self.cleared and self.stored.containsKey((key,)):
            return self.unpack(self.stored.getValue((key,)))
        return self.changed.get(key)

    def put(self, key: int, value) -> None:
        self.size += self.get(key) is None
        self.changed[key] = value

    def drop(self, key: int) -> None:
        self.size -= self.get(key) is not None
        self.changed[key] = None

    def clear(self) -> None:
        self.changed, self.size, self.cleared = {}, 0, True

    def items(self) -> list[tuple]:
        old = [] if self.stored is None or self.cleared else [(k[0], self.unpack(v)) for k, v in self.stored.iterator()]
        return [(k, v) for k, v in {**dict(old), **self.changed}.items() if v is not None]

    def recount(self) -> None:
        """The store lets old entries go by itself, which the size does not show."""
        self.size = len(self.items())

    def write(self) -> None:
        if self.cleared:
            self.stored.clear()
        for key, value in self.changed.items():
            if value is not None:
                self.stored.updateValue((key,), self.pack(value))
            elif self.stored.containsKey((key,)):
                self.stored.removeKey((key,))

    @staticmethod
    def pack(run):
        return ([(s["t"], s["place"], s["camera"]) for s in run],)

    @staticmethod
    def unpack(value):
        return [{"t": t, "place": list(place), "camera": list(camera)} for t, place, camera in value[0]]


class Flags(Entries):
    """Landmarks that were admitted."""

    @staticmethod
    def pack(time):
        return (time,)

    @staticmethod
    def unpack(value):
        return value[0]


class ScanLandmarks:
    """Folds samples of many landmarks.

    A new epoch, or time going back, empties what is pending. An admitted
    landmark is never admitted again. Any number may wait, unless
    ``most_pending`` bounds them as a device does: then a new one is refused
    at that many, after those whose last sample is ``gap`` seconds old have
    been let go (looked for every ``LOOK`` seconds at most).
    """

    def __init__(self, pending: Entries, admitted: Entries, clock: tuple | None = None, most_pending: int | None = None, **rules):
        self.pending, self.admitted, self.most, self.rule = pending, admitted, most_pending, LandmarkAdmission(**rules)
        self.epoch, self.time, self.looked = clock or (None, None, None)

    def feed(self, e: dict) -> list[dict]:
        if self.epoch is None or e["epoch"] != self.epoch or e["time"] < self.time:
            self.pending.clear()
            self.looked = None
        self.epoch, self.time = e["epoch"], e["time"]
        key = e["landmark_id"]
        if self.admitted.get(key) is not None:
            return []
        sample = self.rule.sample(e)
        if not self.rule._usable(sample):
            return []
        run = self.pending.get(key)
        if run is None and not self._room():
            return []
        after, done = self.rule.weigh(run or [], sample)
        if not done:
            if after is not run:
                self.pending.put(key, after)
            return []
        self.pending.drop(key)
        self.admitted.put(key, sample["t"])
        return [{"landmark_id": key} | self.rule.row(sample)]

    def _room(self) -> bool:
        if self.most is None:
            return True
        if self.pending.size >= self.most and (self.looked is None or self.time - self.looked >= LOOK):
            self.looked = self.time
            for key, run in self.pending.items():
                if self.time - run[-1]["t"] >= self.rule.gap:
                    self.pending.drop(key)
            self.pending.recount()
        return self.pending.size < self.most


def _sorted(pdf: pd.DataFrame) -> Iterator[dict]:
    """Samples by time, then landmark; those without time, epoch or landmark are left out."""
    own = pdf.dropna(subset=["time", "epoch", "landmark_id"])
    own = own[np.isfinite(own["time"].to_numpy(dtype=float))].sort_values(["time", "landmark_id"], kind="stable")
    own = own.astype(dict.fromkeys(("x", "y", "z", "cam_x", "cam_y", "cam_z"), float) | {"epoch": int, "landmark_id": int})
    names = list(own.columns)
    return (dict(zip(names, row, strict=True)) for row in zip(*[own[c].tolist() for c in names], strict=True))


def _frame(rows: list[dict], scan) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")])
    out.insert(0, "scan_id", scan)
    return out


def replay(samples: DataFrame, **options) -> DataFrame:
    """Admitted landmarks of each scan: ``scan_id, landmark_id, time, x, y, z``.

    samples: scan_id, landmark_id, time, epoch, x, y, z, cam_x, cam_y, cam_z.
    Samples with a null or infinite place count for nothing; equal ones are one by the interval rule.
    A scan's samples stream by in order, and only its landmarks are held.
    """
    kind = samples.schema["scan_id"].dataType.simpleString()
    schema = f"scan_id {kind}, {ROW}"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        scan, fold = None, None
        for batch in batches:
            out = []
            for s, *values in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True):
                if fold is None or (s != scan and (s == s or scan == scan)):  # NaN is one scan
                    scan, fold = s, ScanLandmarks(Entries(), Flags(), **options)
                out += [{"scan_id": scan} | r for r in fold.feed(dict(zip(_SAMPLE, values, strict=True)))]
            yield pa.RecordBatch.from_pylist(out, schema=types)

    time, epoch, landmark = F.col("time").cast("double"), F.col("epoch"), F.col("landmark_id")
    known = time.isNotNull() & ~F.isnan(time) & (F.abs(time) < math.inf) & epoch.isNotNull() & ~F.isnan(epoch.cast("double")) & landmark.isNotNull()
    place = [F.coalesce(F.col(c).cast("double"), F.lit(math.nan)).alias(c) for c in _SAMPLE[3:]]
    own = samples.filter(known).select("scan_id", landmark.cast("long").alias("landmark_id"), time.alias("time"), epoch.cast("long").alias("epoch"), *place)
    return own.repartition("scan_id").sortWithinPartitions("scan_id", "time", "landmark_id").mapInArrow(run, schema)


def stream(samples: DataFrame, kept_ms: int = KEPT_MS, **options) -> DataFrame:
    """The same as a streaming query; micro-batches are taken in arrival order, samples within one by time.

    Pending runs and admitted landmarks are maps in the state store whose
    entries go ``kept_ms`` after their last change. That clock is the wall's,
    since device clocks of scans start anywhere; it is far longer than ``gap``,
    so it bounds the store and decides no row. Needs the RocksDB provider.
    """
    kind = samples.schema["scan_id"].dataType.simpleString()

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.pending = handle.getMapState("pending", "landmark_id long", _RUN, kept_ms)
            self.admitted = handle.getMapState("admitted", "landmark_id long", "time double", kept_ms)
            self.clock = handle.getValueState("clock", "epoch long, time double, looked double, waiting long", kept_ms)

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
            epoch, time, looked, waiting = self.clock.get() if self.clock.exists() else (None, None, None, 0)
            fold = ScanLandmarks(Entries(self.pending, waiting), Flags(self.admitted), None if epoch is None else (epoch, time, looked), **options)
            out = [r for e in _sorted(pd.concat(list(rows), ignore_index=True)) for r in fold.feed(e)]
            fold.pending.write()
            fold.admitted.write()
            if fold.epoch is not None:
                self.clock.update((int(fold.epoch), fold.time, fold.looked, fold.pending.size))
            yield _frame(out, key[0])

        def close(self) -> None:
            pass

    return samples.groupBy("scan_id").transformWithStateInPandas(Processor(), f"scan_id {kind}, {ROW}", "Append", "ProcessingTime")
