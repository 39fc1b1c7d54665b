"""Greedy choices and hash samples of the registered queries against plain sequential forms over the collected rows."""

import math
import struct

import pytest
import xxhash
from conftest import DATA

from stereoloom import catalog
from stereoloom.plans import adapters as ad

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def scans(spark):
    out = {}
    for r in ad.frames(spark, DATA).collect():
        out.setdefault(r.scan_id, []).append(r)
    return out


def apart(a, b):
    return math.dist((a.x, a.y, a.z), (b.x, b.y, b.z))


def cos(a, b):
    return a.dx * b.dx + a.dy * b.dy + a.dz * b.dz


def test_spaced_references(spark, scans):
    got = {}
    for r in QUERIES["k21_spaced_references"](spark, DATA).collect():
        got.setdefault(r.scan_id, set()).add(r.id)
    for scan, frames in scans.items():
        kept = []
        for f in sorted(frames, key=lambda f: (f.timestamp, f.id)):
            if (not kept or f.timestamp - kept[-1].timestamp >= 0.25) and all(apart(f, k) >= 0.5 for k in kept):
                kept.append(f)
        assert got[scan] <= {k.id for k in kept} and len(got[scan]) == min(12, len(kept))
        if len(kept) <= 12:
            assert got[scan] == {k.id for k in kept}


def test_reference_views(spark, scans):
    got = {}
    for r in QUERIES["j5_reference_views"](spark, DATA).collect():
        got.setdefault((r.scan_id, r.a), {})[r.place] = r.b
    want = {}
    for scan, frames in scans.items():
        for a in frames:
            near = [b for b in frames if b.id != a.id and 0.1 <= apart(a, b) <= 1.0 and cos(a, b) >= 0.5 and abs(a.timestamp - b.timestamp) >= 0.25]
            taken = []
            for b in sorted(near, key=lambda b: (abs(apart(a, b) - 0.4), b.id)):
                if len(taken) < 4 and all(apart(b, t) >= 0.2 for t in taken):
                    taken.append(b)
            if taken:
                want[scan, a.id] = dict(enumerate(t.id for t in taken))
    assert got == want and want


def test_training_selection(spark, scans):
    got = {(r.scan_id, r.id): r for r in QUERIES["c2_training_selection"](spark, DATA).collect()}
    assert len(got) == sum(map(len, scans.values()))
    barred = 0
    for scan, frames in scans.items():
        own = sorted((f for f in frames if f.kind != "error"), key=lambda f: (-abs(f.dx), f.id))
        alike = lambda a, b: apart(a, b) <= 1.2 and cos(a, b) >= math.cos(math.radians(40)) and sum(abs(float(p) - float(q)) for p, q in zip(a.signature, b.signature, strict=True)) / len(a.signature) < 0.14
        kept = []
        for f in own:
            if not any(alike(f, k) for k in kept):
                kept.append(f)
        for f in frames:
            row = got[scan, f.id]
            if f.kind == "error":
                assert not row.selected and row.reason == "verdict:drop"
            elif f in kept:
                assert row.selected and row.reason == "selected" and row.replacement is None
            else:
                barred += 1
                best = next(k for k in kept if alike(f, k))
                assert not row.selected and row.replacement == best.id and (row.reason == "clearer view") == (abs(f.dx) < 0.65 * abs(best.dx))
    assert barred


def spark_hash(*values):
    """Spark's xxhash64 of longs (int) and ints (given as bytes of four)."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_hash_sample_and_order(spark):
    ids = [r.ordinal for r in ad.points(spark, DATA).select("ordinal").collect()]
    sample = {r.ordinal for r in QUERIES["k8_hash_sample"](spark, DATA).collect()}
    assert sample == set(sorted(ids, key=lambda i: (spark_hash(i), i))[:50])
    places = {r.ordinal: r.place for r in QUERIES["k13_random_order"](spark, DATA).collect()}
    assert places == {i: spark_hash(struct.pack("<i", 1), struct.pack("<i", 2), i) for i in ids}


def uniform(*key):
    return (((spark_hash(*key) % (1 << 64)) >> 11) + 0.5) / (1 << 53)


def test_gumbel_top_k(spark):
    rows = {r.ordinal: r.score for r in ad.points(spark, DATA).collect()}
    draws = {i: math.log(w) - math.log(-math.log(uniform(struct.pack("<i", 3), i))) for i, w in rows.items() if w > 0}
    want = sorted(draws, key=lambda i: (-draws[i], i))[:50]
    got = {r.ordinal: r.gumbel for r in QUERIES["k10_gumbel_top_k"](spark, DATA).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(draws[i], abs=2e-6) for i in want)


def test_refinement_splits_the_drawn(spark):
    rows = {r.ordinal: r for r in ad.points(spark, DATA).collect()}
    draws = {i: math.log(r.score) - math.log(-math.log(uniform(struct.pack("<i", 0), i))) for i, r in rows.items() if r.score > 0}
    drawn = set(sorted(draws, key=lambda i: (-draws[i], i))[:20])
    got = {r.row: r for r in QUERIES["sp4_refine"](spark, DATA).collect()}
    assert len(got) == len(rows) + 20
    for i, r in rows.items():
        if i in drawn:
            third = math.exp(-3.0) / 3
            assert got[2 * i].x == pytest.approx(r.x - third, abs=2e-6) and got[2 * i + 1].x == pytest.approx(r.x + third, abs=2e-6)
            assert got[2 * i].log_scale == pytest.approx(-3 + math.log(0.8), abs=2e-6)
        else:
            assert got[2 * i].x == pytest.approx(r.x, abs=2e-6) and 2 * i + 1 not in got


def test_jitter(spark):
    rows = {r.ordinal: r for r in ad.points(spark, DATA).collect()}
    for r in QUERIES["sp2_seed_jitter"](spark, DATA).collect():
        for c in "xyz":
            u, v = (uniform(struct.pack("<i", s), r.ordinal, c.encode()) for s in (0, 1))
            assert r[c] == pytest.approx(rows[r.ordinal][c] + 0.02 * math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v), abs=2e-6)
