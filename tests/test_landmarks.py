"""Landmarks of whole scans: a plain fold over all landmarks, a stream that is cut off and started again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereoloom.plans import queries_streams as qs
from stereoloom.streaming import landmarks, state

SCHEMA = "scan_id long, landmark_id long, time double, epoch int, x double, y double, z double, cam_x double, cam_y double, cam_z double"


def samples(seed: int, scans: int = 2, steps: int = 90, marks: int = 25) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for scan in range(scans):
        t = 1000.0 * scan
        for i in range(steps):
            t += r.choice([0.05, 0.18, 0.2, 0.3, 2.4 if i % 30 == 0 else 0.2])
            for mark in r.sample(range(marks), 6):
                z = r.choice([-2.0] * 9 + [-7.0])
                rows.append((scan, mark, t, i // 60, r.gauss(0, 0.05 if mark % 4 == 0 else 0.01), 0.0, z, 0.01 * i, 0.0, 0.0))
    return rows


def plain(rows: list[tuple], most: int) -> list[tuple]:
    """One list of samples a landmark, all kept; the rules written out."""
    out = []
    for scan in sorted({r[0] for r in rows}):
        waiting, done, epoch, before, looked = {}, set(), None, None, -np.inf
        for _, mark, t, ep, *numbers in sorted((r for r in rows if r[0] == scan), key=lambda r: (r[2], r[1])):
            if ep != epoch or t < before:
                waiting, looked = {}, -np.inf
            epoch, before = ep, t
            p, c = np.array(numbers[:3]), np.array(numbers[3:])
            depth = np.linalg.norm(p - c)
            if mark in done or not 0.15 <= depth <= 5:
                continue
            if mark not in waiting:
                if len(waiting) >= most and t - looked >= 0.5:
                    waiting, looked = {k: v for k, v in waiting.items() if t - v[-1][0] < 2}, t
                if len(waiting) < most:
                    waiting[mark] = [(t, p, c)]
                continue
            own = waiting[mark]
            if t - own[-1][0] < 0.16:
                continue
            limit = 0.02 + 0.015 * depth
            if t - own[-1][0] > 2 or max(np.linalg.norm(p - own[0][1]), np.linalg.norm(p - own[-1][1])) > limit:
                waiting[mark] = [(t, p, c)]
                continue
            own.append((t, p, c))
            u, v = p - own[0][2], p - c
            turn = np.degrees(np.arccos(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1)))
            if len(own) >= 3 and t - own[0][0] >= 0.36 and np.linalg.norm(c - own[0][2]) >= 0.04 and turn >= 1.5:
                del waiting[mark]
                done.add(mark)
                out.append((scan, mark, t, *numbers[:3]))
    return sorted(out)


@pytest.mark.parametrize(("seed", "most"), [(1, 20_000), (2, 4), (3, 9), (4, 1)])
def test_replay_equals_a_plain_fold(spark, seed, most):
    rows = samples(seed)
    got = sorted(map(tuple, landmarks.replay(spark.createDataFrame(rows, SCHEMA).repartition(3), most_pending=most).collect()))
    assert got == plain(rows, most) and got


def test_what_is_no_sample_counts_for_nothing(spark):
    rows = samples(5, scans=1)
    odd = [(0, None, 1.0, 0, *[0.0] * 6), (0, 3, None, 0, *[0.0] * 6), (0, 3, 2.0, None, *[0.0] * 6), (0, 3, rows[0][2], 0, None, 0.0, 0.0, 0.0, 0.0, 0.0), (0, 4, rows[0][2], 0, float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + odd + rows[:50], SCHEMA).selectExpr("*", "1 AS run", "2 AS t")
    assert sorted(map(tuple, landmarks.replay(df).collect())) == plain(rows, 20_000)
    assert landmarks.replay(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Three parts of a log, a query for each, the second of which dies within its batch first; the state is all they share."""
    rows, most = samples(6), 9
    log, out, at = (str(tmp_path / n) for n in ("log", "out", "state"))
    cuts = [0, 30, 61, 10_000]
    steps = {scan: sorted({r[2] for r in rows if r[0] == scan}) for scan in (0, 1)}
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = [r for r in rows if lo <= steps[r[0]].index(r[2]) < hi]
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").json(log)
        source = state.follow(spark, log, SCHEMA, None)
        if lo == cuts[1]:
            lost = source.withColumn("epoch", F.when(F.col("time") > 1008, F.raise_error(F.lit("epoch is lost"))).otherwise(F.col("epoch")))
            with pytest.raises(Exception, match="epoch is lost"):
                state.run_available(landmarks.stream(lost, most_pending=most), out, at)
        state.run_available(landmarks.stream(source, most_pending=most), out, at)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == plain(rows, most) and got


def test_entries_of_the_store():
    class Store(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__

        def iterator(self):
            return iter(list(self.items()))

    store = Store({(1,): (5.0,), (2,): (6.0,)})
    e = landmarks.Flags(store, 2)
    e.put(3, 7.0)
    e.drop(1)
    e.drop(9)
    assert (e.size, dict(e.items())) == (2, {2: 6.0, 3: 7.0})
    e.write()
    assert store == {(2,): (6.0,), (3,): (7.0,)}
    e = landmarks.Flags(store, 2)
    e.clear()
    e.put(2, 8.0)
    assert e.get(3) is None and e.size == 1
    e.write()
    assert store == {(2,): (8.0,)}


def test_a_scan_streams_by_in_batches(spark):
    """No scan is held whole; null and NaN places, and scans without an id, count as before."""
    rows = samples(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([*rows, (0, 3, None, 0, *[0.0] * 6), (0, 3, float("nan"), 0, *[0.0] * 6), (0, 3, 1e9, 9, None, *[0.0] * 5), (None, 1, 1.0, 0, *[0.0] * 6)], SCHEMA).repartition(3)
        out = landmarks.replay(df, most_pending=12)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r[:2] for r in got] == [r[:2] for r in plain(rows, 12)] and np.allclose([r[2:] for r in got], [r[2:] for r in plain(rows, 12)]) and got


def test_the_query_turns_no_landmark_away(spark, tmp_path):
    """Over 300 landmarks wait at one time."""
    sf = str(tmp_path)
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").write.parquet(f"{sf}/embeddings.parquet")
    own = spark.range(0, 400, 1, 1).selectExpr("id AS event_id", "CAST(timestamp_seconds(1700000000 + 1000 * id) AS TIMESTAMP_NTZ) AS ts", "1L AS user_id", "'view' AS event_type", "1D AS value")
    own.write.parquet(f"{sf}/events.parquet")
    rows = [tuple(r) for r in qs.scan_samples(spark, sf).collect()]
    whole = plain(rows, 1_000_000)
    assert sorted(map(tuple, qs.w7_scan(spark, sf).collect())) == whole and len(whole) > len(plain(rows, 300))


def test_any_number_of_landmarks_may_wait(spark):
    marks = 20_003
    seen = spark.range(4 * marks).selectExpr("7L AS scan_id", f"id % {marks} AS landmark_id", f"id div {marks} * 0.3D AS time", "0 AS epoch", "0D AS x", "0D AS y", "-2D AS z", f"id div {marks} * 0.1D AS cam_x", "0D AS cam_y", "0D AS cam_z")
    assert landmarks.replay(seen).count() == marks
