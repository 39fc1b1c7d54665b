"""SQL functions equal the column functions; history entries are published whole or not at all."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from stereoloom.functions import voxels as vx
from stereoloom.functions.sql import register_udfs
from stereoloom.plans import adapters as ad
from stereoloom.plans import pipelines as pl


def test_sql_functions(spark):
    assert "neighbors26" in register_udfs(spark)
    p = ad.points(spark, DATA)
    p.createOrReplaceTempView("pts")
    a = {r.ordinal: r.key for r in spark.sql("SELECT ordinal, voxel_key(x, y, z, 0.1D) AS key FROM pts").collect()}
    b = {r.ordinal: r.key for r in p.select("ordinal", vx.voxel_key("x", "y", "z", 0.1).alias("key")).collect()}
    assert a == b
    key = next(iter(a.values()))
    near = {r[0] for r in spark.sql(f"SELECT * FROM neighbors26({key}L)").collect()}
    assert near == set(spark.range(1).select(vx.neighbour_keys(F.lit(key).cast("long"), centre=False)).first()[0])
    row = spark.sql(f"SELECT voxel_center({key}L, 0.1D).x AS x, voxel_shard({key}L) AS s, metric_scale(CAST(NULL AS DOUBLE)) AS m, capture_ev(0.01D, 0D) AS e").first()
    assert (row.m, row.e) == (1.0, None) and 0 <= row.s < 16
    assert "Python" not in spark.sql("SELECT voxel_key(x, y, z, 0.1D) FROM pts")._jdf.queryExecution().executedPlan().toString()


def test_sql_cameras_and_normals(spark):
    from stereoloom.functions import geometry as g

    register_udfs(spark)
    own = ad.poses(spark, DATA).select("id", "pose", "intrinsics", F.col("a").alias("nx"), F.col("b").alias("ny"), F.col("c").alias("nz"), (F.col("id") % 240).cast("double").alias("u"), (F.col("id") % 180).cast("double").alias("v"), (1 + F.col("id") % 3).cast("double").alias("z"))
    own = own.unionByName(own.limit(1).withColumns({k: F.lit(0.0) for k in ("nx", "ny", "nz")}))
    k = g.Camera.of("intrinsics")
    w = g.unproject(k, "pose", F.col("u"), F.col("v"), F.col("z"))
    own = own.select("*", *[c.alias(f"w{n}") for n, c in zip("xyz", w, strict=True)])
    own = own.select("*", g.project(k, "pose", [F.col(f"w{n}") for n in "xyz"]).alias("back"), g.project(k, "pose", [-F.col(f"w{n}") for n in "xyz"]).alias("behind"), vx.oct_encode("nx", "ny", "nz").alias("code"))
    own.createOrReplaceTempView("cams")
    lens = "intrinsics.fx, intrinsics.fy, intrinsics.cx, intrinsics.cy"
    size = "intrinsics.width, intrinsics.height, pose"
    rows = spark.sql(f"SELECT wx, wy, wz, back, behind, code, unproject(u, v, z, {lens}, pose) AS w, project(wx, wy, wz, {lens}, {size}) AS b, project(-wx, -wy, -wz, {lens}, {size}) AS h, oct_encode(nx, ny, nz) AS c, u FROM cams").collect()
    assert len(rows) == 501 and all(r.c == r.code for r in rows) and rows[-1].c == 0
    for r in rows:
        assert r.w.x == pytest.approx(r.wx) and r.w.z == pytest.approx(r.wz) and (r.b is None) == (r.back is None) and (r.h is None) == (r.behind is None)
        if r.b is not None:
            assert r.b.u == pytest.approx(r.back.u) == pytest.approx(r.u, abs=1e-6) and r.b.z == pytest.approx(r.back.z)
    assert sum(r.b is not None for r in rows) > 400


def test_entries(spark, tmp_path):
    fr = ad.frames(spark, DATA).filter("scan_id < 5").withColumns({"exposure_blur": F.lit(0.0), "sharpness": F.lit(1.0), "detail": F.abs("dx")})
    path = str(tmp_path / "entry")
    moved = lambda df: df.withColumn("x", F.col("x") + 1)
    pl.optimised_entry(fr, moved, lambda a, b: True, path)
    first = spark.read.parquet(path).agg(F.min("x")).first()[0]
    pl.optimised_entry(fr, moved, lambda a, b: False, path)
    assert spark.read.parquet(path).agg(F.min("x")).first()[0] == pytest.approx(first - 1)
    with pytest.raises(ValueError):
        pl.optimised_entry(fr.limit(0), moved, lambda a, b: True, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_desktop(spark):
    p = ad.poses(spark, DATA).limit(30)
    fr = p.select(F.lit("s").alias("scan_id"), "id", F.col("id").cast("double").alias("timestamp"), F.lit(1.0).alias("blur"), F.lit("f.jpg").alias("imageFile"), "pose", "intrinsics")
    out = pl.desktop_conversion(fr, 5.0, 10, portrait=True).collect()
    assert len(out) == 10 and out[0].intrinsics.width == 180 and out[0].colmap.qw >= 0
    samples = spark.createDataFrame([("s", 0, u, v, 1.0, 2 if u else 1) for u in range(4) for v in range(4)], "scan_id string, frame_id long, u int, v int, z double, conf int")
    views = p.filter("id = 0").select(F.lit("s").alias("scan_id"), F.col("id").alias("frame_id"), "pose", "intrinsics")
    assert pl.desktop_points(samples, views, 1e-3, 100).count() == 12
    assert pl.desktop_points(samples, views, 100.0, 100).count() <= 8
