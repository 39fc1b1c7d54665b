"""Neighbour search at each point's own scale, against all pairs."""

import numpy as np
import pytest

from stereoloom.operators import spatial

SCHEMA = "scan_id long, ordinal long, x double, y double, z double"


def table(spark, places, scan=0):
    return [(scan, i, *map(float, p)) for i, p in enumerate(places)]


def by_force(left, right, k, reach=np.inf, same=False):
    out = []
    for s, a, *p in left:
        if not np.isfinite(p).all():
            continue
        d = sorted((float(np.sqrt(((np.array(p) - q) ** 2).sum())), b) for t, b, *q in right if t == s and np.isfinite(q).all() and not (same and a == b))
        out += [(s, a, b, round(x, 9), i + 1) for i, (x, b) in enumerate(d[:k]) if x <= reach]
    return sorted(out)


def found(df):
    return sorted((r["scan_id"], r["a"], r["b"], round(r["d"], 9), r["rank"]) for r in df.collect())


def uneven(seed):
    """Points from a millimetre to kilometres apart, some at one place, some beyond the grid, some not finite."""
    r = np.random.default_rng(seed)
    dense, loose = r.normal(0, 0.002, (60, 3)) + 3, r.normal(0, 40, (40, 3))
    return np.concatenate([dense, loose, np.repeat(loose[:1], 12, axis=0), [[9e6, 0, 0], [9e6 + 1, 0, 0], [-8e6, 5, 5], [np.nan, 0, 0], [0, np.inf, 0], [0, 0, 0]]])


@pytest.mark.parametrize("k", [1, 3, 200])
def test_equals_all_pairs(spark, k):
    rows = table(spark, uneven(k)) + table(spark, [[0, 0, 0]], 1) + table(spark, [[0, 0, 0], [50, 0, 0]], 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(spatial.nearest(df, df, k, 0.1, same_table=True)) == by_force(rows, rows, k, same=True)


def test_two_tables_and_a_bound(spark):
    right = table(spark, uneven(7))
    left = table(spark, np.random.default_rng(8).normal(0, 30, (25, 3))) + table(spark, [[1, 2, 3]], 9)
    a, b = spark.createDataFrame(left, SCHEMA).selectExpr("scan_id", "ordinal AS id", "x", "y", "z", "1 AS key", "2 AS level"), spark.createDataFrame(right, SCHEMA)
    assert found(spatial.nearest(a, b, 2, 0.5, left_id="id")) == by_force(left, right, 2)
    assert found(spatial.nearest(a, b, 2, 0.5, rings=6, left_id="id")) == by_force(left, right, 2, reach=16.0)
    empty = spark.createDataFrame([], SCHEMA)
    assert spatial.nearest(a, empty, 2, 0.5, left_id="id").collect() == [] and spatial.nearest(empty, b, 2, 0.5).collect() == []


def test_no_products(spark):
    df = spark.createDataFrame(table(spark, uneven(1)), SCHEMA)
    plan = spatial.nearest(df, df, 2, 0.1, same_table=True)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("k", [1, 3, 200])
def test_scans_of_many_points_search_by_scale(spark, monkeypatch, k):
    """As the other tests, which small scans serve as one block, with cells cut into arrays of seven points."""
    monkeypatch.setattr(spatial, "FEW", 2)
    monkeypatch.setattr(spatial, "CHUNK", 7)
    test_equals_all_pairs(spark, k)
    test_two_tables_and_a_bound(spark)


def test_pairs_stay_in_their_task(spark, monkeypatch):
    """Only the best of an asker's cell are sorted and shuffled, in a given number of tasks; a small scan needs no levels of cells at all."""
    df = spark.createDataFrame(table(spark, uneven(1)), SCHEMA)
    plan = lambda: spatial.nearest(df, df, 2, 0.1, same_table=True)._jdf.queryExecution().executedPlan().toString()
    assert plan().count("Generate") == 1
    monkeypatch.setattr(spatial, "FEW", 0)
    assert "REPARTITION_BY_NUM" in plan() and "Window [row_number() windowspecdefinition(scan_id" not in plan().split("ObjectHashAggregate")[0]


def test_extrapolation_is_not_joined_back(spark):
    """Directions go with the ids, so frames are read once and pairs meet no frames again."""
    from stereoloom.operators import metrics

    rows = [(s, i, *map(float, p), 0.6, 0.0, 0.8, i % 3 == 1) for s in (0, 1) for i, p in enumerate(np.random.default_rng(s).normal(size=(20, 3)))]
    frames = spark.createDataFrame(rows, "scan_id int, id int, x double, y double, z double, dx double, dy double, dz double, holdout boolean")
    out = metrics.extrapolation(frames)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = {(r.scan_id, r.id): (r.nearest, round(r.d, 9), round(r.degrees, 3)) for r in out.collect()}
    split = lambda held: [r[:5] for r in rows if r[8] == held]
    assert got == {(s, a): (b, d, 0.0) for s, a, b, d, _ in by_force(split(True), split(False), 1)}
