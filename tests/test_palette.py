"""The palette of vectors against plain Lloyd steps."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from stereoloom.operators import graph
from stereoloom.plans import queries_tracks


def lloyd(x, centres, rounds):
    near = lambda: ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    for _ in range(rounds):
        at = near()
        for k in set(at.tolist()):
            centres[k] = x[at == k].mean(axis=0)
    return near(), centres


@pytest.mark.parametrize("entries", [1, 16, 64, 5000])
def test_palette_equals_plain_lloyd(spark, entries):
    rows = queries_tracks.harmonics(spark, DATA)
    first = rows.select("sh").distinct().orderBy(F.xxhash64("sh"), "sh").limit(entries).collect()
    got, centres = graph.palette(rows.repartition(5), "sh", entries)
    order = rows.orderBy("vec_id").collect()
    want, plain = lloyd(np.array([r.sh for r in order]), np.array([r[0] for r in first]), 3)
    assert np.abs(centres - plain).max() < 1e-9
    assert [r.entry for r in got.orderBy("vec_id").collect()] == want.tolist()


def test_palette_blocks_and_ties():
    r = np.random.default_rng(0)
    x, centres = r.normal(size=(300, 45)), r.normal(size=(70, 45))
    centres[50] = centres[3]
    want = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    for block in (1, 7, 64, 4096):
        assert graph._nearest_centres(x, centres, block).tolist() == want.tolist()


def test_palette_of_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [4.0, 4.0]), (4, None)], "id long, sh array<double>")
    got, centres = graph.palette(df, "sh", 8)
    rows = {r.id: r.entry for r in got.collect()}
    assert rows[1] == rows[2] != rows[3] and rows[4] is None and len(centres) == 2
    none, centres = graph.palette(df.limit(0), "sh", 8)
    assert none.count() == 0 and len(centres) == 0 and none.columns == got.columns
