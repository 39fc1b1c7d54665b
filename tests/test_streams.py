"""State machines: rules on hand-made streams, and streaming equal to replay."""

import math
import random

import numpy as np
import pytest

from stereoloom.streaming import state


def run(machine, events):
    return [r for e in events for r in machine.feed(e)]


def test_motion_resets_on_disorder_and_gaps():
    at = lambda t, x: {"timestamp": t, "x": x, "y": 0.0, "z": 0.0, "yaw": 0.0}
    out = run(state.MotionEstimator(), [at(0.0, 0.0), at(0.05, 0.05), at(0.04, 9.0), at(0.30, 9.5), at(0.34, 9.54)])
    assert [round(r["speed"], 3) for r in out] == [0.0, 1.0, 0.0, 0.0, 1.0]


def test_motion_restarts_after_a_quarter_second():
    at = lambda t, x: {"timestamp": t, "x": x, "y": 0.0, "z": 0.0, "yaw": 0.0}
    assert run(state.MotionEstimator(), [at(0.0, 0.0), at(0.24, 0.24)])[1]["speed"] == pytest.approx(1.0)
    assert run(state.MotionEstimator(), [at(0.0, 0.0), at(0.26, 0.26)])[1]["speed"] == 0.0


def test_gyro_counts_if_fresh():
    e = {"timestamp": 1.0, "x": 0.0, "y": 0.0, "z": 0.0, "yaw": 0.0, "gyro_rate": 2.0}
    assert state.MotionEstimator().feed(e | {"gyro_timestamp": 1.01})[0]["angular"] == 2.0
    assert state.MotionEstimator().feed(e | {"gyro_timestamp": 1.05})[0]["angular"] == 0.0


def test_sharpness_peak_decays_and_rests():
    e = lambda t, s, severe=False: {"timestamp": t, "sharpness": s, "severe": severe}
    out = run(state.SharpnessReference(), [e(0.0, 1.0), e(1.0, 0.5), e(2.0, 0.5, True)])
    assert out[1]["ratio"] == pytest.approx(0.5 / 0.97**15) and out[2]["ratio"] == pytest.approx(0.5 / 0.97**15)


def test_shutter_and_gate_and_continuity():
    at = lambda t, x, yaw=0.0: {"timestamp": t, "x": x, "y": 0.0, "z": 0.0, "yaw": yaw, "scale": 1.0}
    assert [r["captured"] for r in run(state.SmartShutter(), [at(0, 0), at(0.09, 1), at(0.2, 0.04), at(0.3, 0.05), at(0.5, 0.05, 0.06)])] == [True, False, False, True, True]
    n = lambda t, ok=True: {"timestamp": t, "normal": ok}
    assert [r["open"] for r in run(state.StabilityGate(), [n(0), n(0.2), n(0.4), n(0.6), n(0.7, False), n(0.8), n(1.2)])] == [False, False, False, True, False, False, False]
    assert [r["continuous"] for r in run(state.ContinuityGate(), [at(0, 0), at(0.1, 0.2), at(0.2, 2), at(0.9, 2), at(1.0, 2, 1.0)])] == [False, True, False, False, False]


def test_severe_motion_stops_the_decay_but_not_a_sharper_frame():
    e = lambda t, s, severe=False: {"timestamp": t, "sharpness": s, "severe": severe}
    out = run(state.SharpnessReference(), [e(0.0, 1.0), e(0.1, 2.0, True), e(0.2, 2.0), e(0.3, float("nan")), e(0.4, 1.0, True)])
    assert [r["ratio"] for r in out] == [1.0, 1.0, 1.0, 1.0, 0.5]


def test_shutter_near_scenes_and_without_depth_sensor():
    at = lambda t, x, depth=None, alone=False, yaw=0.0: {"timestamp": t, "x": x, "y": 0.0, "z": 0.0, "yaw": yaw, "depth": depth, "camera_only": alone}
    pair = lambda x, *a: run(state.SmartShutter(), [at(0, 0), at(1, x, *a)])[1]["captured"]
    assert [pair(0.03, 0.5), pair(0.024, 0.5), pair(0.021, 0.1), pair(0.019, 0.1), pair(0.049, 9.0), pair(0.05, 9.0)] == [True, False, True, False, False, True]
    assert [pair(0.041, 0.5, True), pair(0.039, 0.5, True), pair(0.0, None, True, 1.0), pair(0.0, None, False, 1.0)] == [True, False, False, True]


def fold(rule, events, state):
    """Outputs of a plain function (state, event) -> (state, outputs)."""
    out = []
    for e in events:
        state, rows = rule(state, e)
        out += rows
    return out


def hostile_events(seed, n=400):
    """Random walks with pauses, jumps and times that go back."""
    r = random.Random(seed)
    t = x = y = 0.0
    out = []
    for i in range(n):
        t += r.choice([0.016, 0.033, 0.05, 0.11, 0.2, 0.7]) if r.random() > 0.04 else -r.random()
        x, y = x + r.gauss(0, 0.05) + 0.03 * math.sin(i / 40), y + r.gauss(0, 0.02)
        a = r.gauss(0, 0.3)
        q = [math.cos(a / 2), math.sin(a / 2) * 0.6, math.sin(a / 2) * 0.8, 0.0]
        d = [math.cos(i / 60), math.sin(i / 60), 0.0]
        out.append({"timestamp": t, "x": x, "y": y, "z": 0.1 * x, "yaw": a, **dict(zip(("qw", "qx", "qy", "qz"), q, strict=True)), "gyro_rate": abs(r.gauss(0, 4)), "gyro_timestamp": t + r.gauss(0, 0.02), **dict(zip(("dx", "dy", "dz"), d, strict=True)), "photo": r.random() < 0.1})
    return out


@pytest.mark.parametrize("seed", range(5))
def test_motion_equals_a_plain_fold(seed):
    events = hostile_events(seed)
    got = run(state.MotionEstimator(), events)
    start, smooth = 0, 0.0
    for i, e in enumerate(events):
        t = e["timestamp"]
        if i and not (0 < t - events[i - 1]["timestamp"] <= 0.25):
            start, smooth = i, 0.0
        rate, dt = 0.0, 1 / 60
        if i > start:
            p = events[i - 1]
            dt = t - p["timestamp"]
            dot = sum(p[k] * e[k] for k in ("qw", "qx", "qy", "qz"))
            rate = 2 * math.acos(min(1.0, abs(dot))) / dt
        if abs(e["gyro_timestamp"] - t) <= 0.02:
            rate = max(rate, e["gyro_rate"])
        smooth = smooth + (rate - smooth) * (1 - math.exp(-dt / 0.045))
        old = [k for k in range(start, i) if events[k]["timestamp"] <= t - 0.08]
        first = max([start, i - 31, *(old[-1:] if old else [])])
        f = events[first]
        far = math.sqrt(sum((e[k] - f[k]) ** 2 for k in "xyz"))
        assert got[i]["speed"] == pytest.approx(far / (t - f["timestamp"]) if i > first else 0.0, abs=1e-9)
        assert got[i]["angular"] == pytest.approx(max(rate, smooth), rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("seed", range(6))
def test_revisit_guide_equals_a_plain_fold(seed):
    events = hostile_events(seed, 1500)
    for i, e in enumerate(events):  # a loop of 6 m that comes round again and again
        e["x"], e["y"] = 3 * math.cos(i / 90), 3 * math.sin(i / 90)
        if seed % 2:
            e["dx"], e["dy"] = math.cos(i / 90 + (i // 566) * 1.0), math.sin(i / 90 + (i // 566) * 1.0)
    got = run(state.RevisitGuide(), events)
    clock = travel = next_check = since_t = since_s = 0.0
    anchor = last = shown = None
    asked, now, photos, want = False, "quiet", [], []
    for e in events:
        if last is not None:
            clock += max(0.0, min(0.5, e["timestamp"] - last))
        last = e["timestamp"]
        p = (e["x"], e["y"], e["z"])
        if anchor is None or math.dist(anchor, p) > 0.05:
            travel += math.dist(anchor, p) if anchor else 0.0
            anchor = p
        if clock >= next_check:
            next_check = clock + 0.2
            if any(clock - t >= 8 and travel - s >= 2 and math.dist(q, p) < 0.8 and v[0] * e["dx"] + v[1] * e["dy"] + v[2] * e["dz"] > 0.9 for q, v, t, s in photos):
                since_t, since_s = clock, travel
                if asked:
                    shown, asked = clock + 3, False
        if shown is not None and clock < shown:
            prompt = "returned"
        else:
            shown = None
            if len(photos) >= 10 and clock - since_t >= 40 and travel - since_s >= 4:
                asked = True
            prompt = "prompt" if asked else "quiet"
        if prompt != now:
            want.append((e["timestamp"], prompt))
            now = prompt
        if e["photo"]:
            photos.append((p, (e["dx"], e["dy"], e["dz"]), clock, travel))
    assert [(r["timestamp"], r["event"]) for r in got] == want and (seed or want)


@pytest.mark.parametrize("seed", range(6))
def test_landmarks_equal_a_plain_fold(seed):
    r = random.Random(seed)
    t, events = 0.0, []
    for i in range(300):
        t += r.choice([0.05, 0.17, 0.3, 0.3, 0.5, 2.5]) if r.random() > 0.03 else -0.4
        events.append({"time": t, "epoch": i // 90, "x": r.gauss(0, 0.012), "y": 0.0, "z": -r.choice([1.5, 1.5, 1.5, 1.52, 7.0]), "cam_x": i * 0.002 + r.gauss(0, 0.02), "cam_y": 0.0, "cam_z": 0.0})
    for cut in range(0, 300, 60):  # a fresh landmark from each point on
        own = events[cut:]
        samples, epoch, before, want = [], None, None, None
        for e in own:
            if e["epoch"] != epoch or e["time"] < before:
                samples = []
            epoch, before = e["epoch"], e["time"]
            p, c = np.array([e["x"], e["y"], e["z"]]), np.array([e["cam_x"], e["cam_y"], e["cam_z"]])
            depth = np.linalg.norm(p - c)
            if not 0.15 <= depth <= 5:
                continue
            if samples and e["time"] - samples[-1][0] < 0.16:
                continue
            limit = 0.02 + 0.015 * depth
            if samples and (e["time"] - samples[-1][0] > 2 or np.linalg.norm(p - samples[0][1]) > limit or np.linalg.norm(p - samples[-1][1]) > limit):
                samples = []
            samples.append((e["time"], p, c))
            u, v = p - samples[0][2], p - c
            turn = np.degrees(np.arccos(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1)))
            if len(samples) >= 3 and e["time"] - samples[0][0] >= 0.36 and np.linalg.norm(c - samples[0][2]) >= 0.04 and turn >= 1.5:
                want = (e["time"], e["x"])
                break
        got = run(state.LandmarkAdmission(), own)
        assert [(g["time"], g["x"]) for g in got] == ([want] if want else [])


@pytest.mark.parametrize("seed", range(4))
def test_stride_equals_a_plain_fold(seed):
    r = random.Random(seed)
    events = [{"timestamp": float(i), "seconds": r.choice([0.01, 0.01, 0.01, 0.02, 0.05]) if i % 60 > 20 else 0.01, "width": r.choice([0, 256, 640]), "height": 192} for i in range(500)]
    stride, quick, phase, want = 2, 0, 0, []
    for e in events:
        used = next(k for k in range(stride, 99) if math.ceil(e["width"] / k) * math.ceil(e["height"] / k) <= 6000)
        cell = phase % (used * used)
        want.append((used, cell % used, cell // used))
        phase = (cell + 1) % (used * used)
        ms = e["seconds"] * 1000
        if ms > 35:
            stride, quick = min(6, stride + 1), 0
        elif ms < 17.5:
            quick += 1
            if quick >= 12:
                stride, quick = max(2, stride - 1), 0
        else:
            quick = 0
    assert [(g["stride"], g["x"], g["y"]) for g in run(state.AdaptiveStride(), events)] == want


def test_sharpness_replay_equals_the_machine(spark):
    from stereoloom.plans.pipelines import sharpness_replay

    r = random.Random(3)
    rows = []
    for scan in range(3):
        t = 0.0
        for i in range(200):
            t += r.choice([0.016, 0.03, 0.4]) if r.random() > 0.05 else -0.0
            rows.append((scan, i, t, r.choice([0.0, float("nan"), -1.0]) if r.random() < 0.05 else r.random(), r.random() < 0.2))
    df = spark.createDataFrame(rows, "scan_id long, id long, timestamp double, sharpness double, severe boolean")
    got = {(x.scan_id, x.id): x.ratio for x in sharpness_replay(df).collect()}
    for scan in range(3):
        m = state.SharpnessReference()
        for s, i, t, v, severe in rows:
            if s == scan:
                assert got[s, i] == pytest.approx(m.feed({"timestamp": t, "sharpness": v, "severe": severe})[0]["ratio"], abs=1e-9)
    assert len(got) == 600


def test_revisit_guide_asks_and_confirms():
    m, out = state.RevisitGuide(), []
    for i in range(1000):
        t = i * 0.1
        x = min(t, 45.0) * 0.2 if t <= 45 else max(0.0, 9.0 - (t - 45) * 0.4)
        out += m.feed({"timestamp": t, "x": x, "y": 0.0, "z": 0.0, "photo": i % 20 == 0})
    assert [r["event"] for r in out][:2] == ["prompt", "returned"] and out[2]["event"] == "quiet"
    away = state.RevisitGuide()
    assert [r["event"] for i in range(900) for r in away.feed({"timestamp": i * 0.1, "x": i * 0.02, "y": 0.0, "z": 0.0, "photo": i % 20 == 0})] == ["prompt"]


def test_landmarks_need_three_samples_baseline_and_parallax():
    e = lambda t, cx, epoch=0: {"time": t, "epoch": epoch, "x": 0.0, "y": 0.0, "z": -1.5, "cam_x": cx, "cam_y": 0.0, "cam_z": 0.0}
    assert not run(state.LandmarkAdmission(), [e(0, 0), e(1, 0.1)])
    assert len(run(state.LandmarkAdmission(), [e(0, 0), e(0.5, 0.03), e(1, 0.06), e(1.5, 0.2)])) == 1
    assert not run(state.LandmarkAdmission(), [e(0, 0), e(0.5, 0.015), e(1, 0.03)])
    assert not run(state.LandmarkAdmission(), [e(0, 0), e(0.5, 0.05), e(1, 0.1, 1)])


def test_queue_stride_and_fence():
    q = lambda k, j: {"timestamp": 0.0, "kind": k, "job": j}
    out = run(state.ConflatingQueue(), [q("submit", 1), q("submit", 2), q("submit", 3), q("done", 1), q("done", 3)])
    assert [(r["started"], r["replaced"]) for r in out] == [(1, 0), (3, 1)]
    s = lambda v: {"timestamp": 0.0, "seconds": v}
    assert run(state.AdaptiveStride(), [s(0.04)] * 9)[-1]["stride"] == 6
    assert run(state.AdaptiveStride(), [s(0.04)] * 2 + [s(0.01)] * 13)[-1]["stride"] == 3  # the frame after the twelfth quick one
    assert run(state.AdaptiveStride(), [s(0.01)] * 40)[-1]["stride"] == 2
    assert run(state.AdaptiveStride(), [s(0.01) | {"width": 640, "height": 480}])[0]["stride"] == 8
    f = lambda e: {"timestamp": 0.0, "epoch": e}
    assert [r["epoch"] for r in run(state.EpochFence(), [f(0), f(2), f(1), f(2)])] == [0, 2, 2]


@pytest.mark.parametrize("name", sorted(state.MACHINES))
def test_state_survives_json(name):
    m = state.MACHINES[name]()
    n = state.MACHINES[name]()
    n.load(m.dump())
    assert n.__dict__ == m.__dict__


def test_stream_equals_replay(spark, tmp_path):
    rows = [(s, i * 0.06 + s, i * 0.03, 0.0, 0.0, 0.0, 1.0) for s in range(3) for i in range(40)]
    schema = "scan_id long, timestamp double, x double, y double, z double, yaw double, scale double"
    df = spark.createDataFrame(rows, schema)
    source = tmp_path / "log"
    for k, (lo, hi) in enumerate(((0, 1.0), (1.0, 2.5), (2.5, 99.0))):  # batches in time order for each key
        df.filter(f"timestamp - scan_id >= {lo} and timestamp - scan_id < {hi}").coalesce(1).write.mode("append").json(str(source))
        assert k >= 0
    out = state.stream(state.follow(spark, str(source), schema, 1), state.SmartShutter)
    q = out.writeStream.format("memory").queryName("shutter").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("shutter").collect())
    assert got == sorted(tuple(r) for r in state.replay(df, state.SmartShutter).collect()) and any(r[2] for r in got)


def test_window_forms_equal_the_machines(spark):
    """W4, W6 and W14 over a table give what the live machines give, on disordered epochs, gaps and ties."""
    from stereoloom.operators import sequence

    r = random.Random(9)
    rows, t = [], 0.0
    for i in range(600):
        t += r.choice([0.0, 0.05, 0.1, 0.2, 0.3, 0.6])
        rows.append((i % 3, i, round(t, 3), r.random() < 0.9, max(0, i // 60 - (r.random() < 0.2)), i))
    df = spark.createDataFrame(rows, "scan_id long, id long, timestamp double, normal boolean, epoch int, view_id long").repartition(3)
    order = ("timestamp", "id")
    for name, got, columns in (("w4", sequence.stability_gate(df, order=order), ("scan_id", "timestamp", "open")), ("w6", sequence.previous_views(df, order=order), ("scan_id", "timestamp", "view_id", "previous_id")), ("w14", sequence.fenced(df, order=order), ("scan_id", "timestamp", "epoch"))):
        want = state.replay(df, state.MACHINES[name], order=order)
        key = lambda d, columns=columns: sorted(map(tuple, d.select(*columns).collect()))
        assert key(got) == key(want) and got.count() > 0


def test_streamed_machines_take_rows_without_a_frame_a_scan(spark, tmp_path):
    """A log of many short scans costs no pandas frame for each; nulls and disorder give what a replay gives."""
    rows = [(s, 0.1 * ((7 * i) % 20) if (s, i) != (3, 5) else None, i, (s + i) % 9 > 0) for s in range(30) for i in range(20)]
    own = spark.createDataFrame(rows, "scan_id int, timestamp double, id long, normal boolean")
    own.write.json(str(tmp_path / "log"))
    source = state.follow(spark, str(tmp_path / "log"), own.schema, None)
    streamed = state.stream(source, state.StabilityGate, order=("timestamp", "id"))
    assert ", pandas," not in streamed._jdf.queryExecution().analyzed().toString()
    state.run_available(streamed, str(tmp_path / "out"), str(tmp_path / "at"))
    key = lambda r: (r.scan_id, r.timestamp is None or r.timestamp != r.timestamp, r.timestamp or 0.0, r.open)
    got, want = (sorted(map(key, df.collect())) for df in (spark.read.parquet(str(tmp_path / "out")), state.replay(own, state.StabilityGate, order=("timestamp", "id"))))
    same = lambda x: [tuple(0.0 if v != v else v for v in r) for r in x]
    assert same(got) == same(want) and len(got) == 600
