"""Round trips of file formats."""

import json
import struct
import zipfile

import numpy as np
import pytest

from stereoloom.sources import colmap, ply, scans


def test_ply_round_trip_and_ranges(spark, tmp_path, monkeypatch):
    ply.register(spark)
    rows = [(i, i * 0.5, -i * 1.0, 2.0, i % 256, 1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "ordinal long, x float, y float, z float, red int, green int, blue int")
    path = str(tmp_path / "p.ply")
    df.repartition(3).drop("ordinal").write.format("ply").mode("append").option("path", path).save()
    back = spark.read.format("ply").load(path)
    assert back.schema.simpleString() == "struct<ordinal:bigint,x:float,y:float,z:float,red:int,green:int,blue:int>"
    assert sorted(tuple(r)[1:] for r in back.collect()) == sorted(r[1:] for r in rows)
    assert sorted(r.ordinal for r in back.collect()) == list(range(50))
    assert {tuple(r)[2:] for r in ply.read_binary(spark, path).collect()} == {r[1:] for r in rows}
    assert ply.strict_preview(spark, path, 10).count() == 10


def test_ply_is_written_in_place(spark, tmp_path):
    """Tasks write where ordinals say; rows come back in order, and what does not fit is refused without a trace."""
    rows = [(i * 7919 % 3001, float(i), i % 256, i - 50) for i in range(3001)]
    df = spark.createDataFrame(rows, "row long, x double, red int, n long").repartition(5)
    path = tmp_path / "p.ply"
    ply.write(df, str(path), ["row"])
    back = spark.read.format("ply").load(str(path)).orderBy("ordinal").collect()
    assert [tuple(r) for r in back] == [(k, *r[1:]) for k, r in enumerate(sorted(rows))]
    assert len(path.read_bytes()) == ply.Header(path.read_bytes()).offset + 3001 * 13
    ply.write(df.limit(0), str(tmp_path / "e.ply"), ["row"])
    assert spark.read.format("ply").load(str(tmp_path / "e.ply")).count() == 0
    put = lambda sql: spark.sql(sql).write.format("ply").mode("append").option("path", str(tmp_path / "bad.ply")).save()
    for sql in ("SELECT 0L ordinal, 256 red", "SELECT 0L ordinal, 1L << 31 n", "SELECT 0L ordinal, CAST(NULL AS INT) n", "SELECT 1L ordinal, 1 n", "SELECT explode(array(0L, 0L, 3L, 3L)) ordinal, 1 n", "SELECT 300 red", "SELECT CAST(NULL AS BIGINT) ordinal, 1 n"):
        with pytest.raises(Exception):
            put(sql)
    assert {p.name for p in tmp_path.iterdir() if "bad" in p.name and "part" not in p.name} == set()


def test_ply_ascii_short_and_broken_files(spark, tmp_path):
    a = tmp_path / "a.ply"
    a.write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    (tmp_path / "b.ply").write_bytes(b"not a cloud")
    whole = ply.encode([("x", "f4"), ("y", "f4"), ("z", "f4")], np.zeros(4, dtype="<f4,<f4,<f4"))
    (tmp_path / "c.ply").write_bytes(whole[:-5])
    out = ply.read_binary(spark, str(tmp_path / "*.ply")).groupBy("path").count().collect()
    assert sorted((r.path[-5:], r["count"]) for r in out) == [("a.ply", 2), ("c.ply", 3)]
    ply.register(spark)
    with pytest.raises(Exception):
        spark.read.format("ply").load(str(tmp_path / "b.ply")).count()


def test_colmap_binary_and_text(spark, tmp_path):
    cameras = spark.createDataFrame([("s", 1, "PINHOLE", 640, 480, [500.0, 501.0, 320.0, 240.0])], "scan_id string, camera_id long, model string, width long, height long, params array<double>")
    images = spark.createDataFrame([("s", i, 1.0, 0.0, 0.0, 0.0, float(i), 2.0, 3.0, 1, f"frame {i}.jpg") for i in (2, 1)], "scan_id string, image_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id long, name string")
    pts = spark.createDataFrame([("s", i, 1.0 * i, 2.0, 3.0, 10, 20, 30, 0.5) for i in range(3)], "scan_id string, point_id long, x double, y double, z double, r int, g int, b int, error double")
    for f in colmap.model_files(cameras, images, pts).collect():
        (tmp_path / f.name).write_bytes(f.content)
    assert colmap.read_cameras(spark, str(tmp_path / "cameras.bin")).first().params == [500.0, 501.0, 320.0, 240.0]
    assert [(r.image_id, r.tx, r.name) for r in colmap.read_images(spark, str(tmp_path / "images.bin")).collect()] == [(1, 1.0, "frame 1.jpg"), (2, 2.0, "frame 2.jpg")]
    assert colmap.read_points(spark, str(tmp_path / "points3D.bin")).count() == 3
    (tmp_path / "short.bin").write_bytes(struct.pack("<Q", 9))
    assert colmap.read_points(spark, str(tmp_path / "short.bin")).count() == 0
    for name, df in (("cameras", colmap.camera_lines(cameras)), ("images", colmap.image_lines(images)), ("points", colmap.point_lines(pts))):
        (tmp_path / f"{name}.txt").write_text("# comment\n" + "\n".join(r.value for r in df.collect()) + "\n")
    assert colmap.read_cameras_text(spark, str(tmp_path / "cameras.txt")).first().model == "PINHOLE"
    assert [(r.image_id, r.tz, r.name) for r in colmap.read_images_text(spark, str(tmp_path / "images.txt")).collect()] == [(1, 3.0, "frame 1.jpg"), (2, 3.0, "frame 2.jpg")]
    assert colmap.read_points_text(spark, str(tmp_path / "points.txt")).count() == 3


def test_scan_folder(spark, tmp_path):
    frames, cloud = scans.synthetic_orbit(spark, frames=6, points=20)
    root = tmp_path / "scan_a"
    (root / "depth").mkdir(parents=True)
    lines = [json.dumps({"id": r.id, "timestamp": r.timestamp, "transform": r.transform, "imageFile": r.imageFile}) for r in frames.collect()]
    (root / "poses.jsonl").write_text("\n".join([*lines[:3], "{broken", *lines[3:]]) + "\n")
    assert scans.read_poses(spark, str(root / "poses.jsonl")).count() == 6
    assert scans.count_bad_lines(spark, str(root / "poses.jsonl")).first().bad == 1
    (root / "meta.json").write_text(json.dumps({"app": "old", "startedAt": "2025-01-01T00:00:00Z"}))
    (root / "capture-meta.json").write_text(json.dumps({"app": "new", "startedAt": "2025-02-01T00:00:00Z"}))
    assert scans.read_sessions(spark, str(root / "capture-meta.json"), str(root / "meta.json")).first().app == "new"
    assert scans.list_scans(spark, str(tmp_path)).first().scan_id == "scan_a"
    (root / "depth" / "f_depth.bin").write_bytes(np.arange(6, dtype="<f4").tobytes())
    (root / "depth" / "f_conf.bin").write_bytes(bytes([2] * 6))
    sizes = spark.createDataFrame([("scan_a", 1, "f_depth.bin", "f_conf.bin", 3, 2), ("scan_a", 2, "f_depth.bin", "f_conf.bin", 9, 9)], "scan_id string, frame_id int, depthFile string, confidenceFile string, width int, height int")
    from stereoloom.operators.raster import depth_samples

    got = depth_samples(scans.read_rasters(spark, str(tmp_path), sizes)).collect()
    assert sorted((r.u, r.v, r.z) for r in got) == sorted((i % 3, i // 3, float(i)) for i in range(6))
    assert cloud.count() == 20


def test_documents_and_archives(spark, tmp_path):
    frames, _ = scans.synthetic_orbit(spark, frames=4)
    doc = scans.nerf_transforms(frames).first()
    (tmp_path / "transforms.json").write_text(doc.json)
    back = scans.read_nerf_transforms(spark, str(tmp_path / "transforms.json")).collect()
    assert len(back) == 4 and back[0].fl_x == 400.0 and len(back[0].transform) == 16
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "hello")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    entry = scans.zip_entries(spark, str(tmp_path / "*.zip")).collect()
    assert [(e.name, e.content) for e in entry] == [("x.txt", b"hello")]
    files = spark.createDataFrame([("s", "a", b"1"), ("s", "b", b"22")], "scan_id string, name string, content binary")
    (tmp_path / "c.zip").write_bytes(scans.zip_bundle(files, "scan_id").first().archive)
    assert zipfile.ZipFile(tmp_path / "c.zip").read("b") == b"22"
    walls = spark.createDataFrame([("s", 0.0, 0.0, 1.0, 2.0)], "scan_id string, x0 double, y0 double, x1 double, y1 double")
    assert "<line" in scans.floor_plan_svg(walls).first().svg and "LINE" in scans.floor_plan_dxf(walls).first().dxf


def test_publish_replaces_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    scans.checkpoint_model(spark.range(5), 7, path)
    scans.checkpoint_model(spark.range(3), 8, path)
    df, step = scans.load_checkpoint(spark, path)
    assert (df.count(), step) == (3, 8) and not (tmp_path / "out.partial").exists()
    scans.write_poses(spark.range(2).withColumnRenamed("id", "b").withColumn("a", ply.F.lit(1)), str(tmp_path / "poses"))
    assert spark.read.text(str(tmp_path / "poses")).first()[0].startswith('{"a":1,"b":')
    scans.write_metrics(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_scan_files_are_written_by_the_tasks(spark, tmp_path):
    """Folders, names and lines are those of Spark's writer; nothing half-written stays; a file is made without a change of its permissions."""
    rows = [(s, f"{s} line {i}\nmore" if i == 3 else f"{s} line {i}") for s in ("7", "a b", "x/y:z", "Zoë", "", None) for i in range(5)] + [("7", None)]
    df = spark.createDataFrame(rows, "scan_id string, value string").repartition(3)
    scans.write_lines(df, f"file://{tmp_path}/own")
    df.filter("value is not null").repartition("scan_id").write.partitionBy("scan_id").text(f"{tmp_path}/spark")
    lines = lambda name: {p.name: sorted(x for f in p.iterdir() if not f.name.startswith(".") for x in f.read_text().splitlines()) for p in (tmp_path / name).iterdir() if p.is_dir()}
    assert lines("own") == lines("spark") and len(lines("own")) == 5
    assert [f.name for f in (tmp_path / "own").rglob("*") if f.is_file()] == ["lines.txt"] * 5
    assert sorted(spark.read.text(f"{tmp_path}/own").select("value").collect()) == sorted(spark.read.text(f"{tmp_path}/spark").select("value").collect())
    scans.write_lines(df.limit(0), str(tmp_path / "none"))
    assert scans.read_poses(spark, str(tmp_path / "none")).count() == 0
