"""Queries over file formats: the adapter views are written out, read back, and compared with the views themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stereoloom.functions import geometry as g
from stereoloom.operators import splats
from stereoloom.plans import adapters as ad
from stereoloom.plans.durable import shared_dir
from stereoloom.plans.registry import query, r6
from stereoloom.sources import colmap, ply, scans

P = ad.CTES["points"]
FR = ad.CTES["frames"]
Q = ad.CTES["poses"]


def folder(spark, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scan_lines(df, path: str, value) -> None:
    """Lines of text in a folder for each scan, ``scan_id=...``, one file each."""
    scans.write_lines(df.select("scan_id", value.alias("value")), path)


@query("io1_scan_listing", f"WITH {P}, s AS (SELECT 'scan_id=' || scan_id AS scan_id, '{{\"id\":' || ordinal || '}}' AS line FROM points) SELECT scan_id, 1 AS files, CAST(sum(length(line) + 1) AS BIGINT) AS bytes FROM s GROUP BY scan_id")
def io1(spark, sf):
    path = folder(spark, "scans")
    scan_lines(ad.points(spark, sf), path, F.to_json(F.struct(F.col("ordinal").alias("id"))))
    return scans.list_scans(spark, path).select("scan_id", "files", "bytes")


def pose_lines(spark, sf, path: str) -> None:
    """Frames as JSON lines; one in seven is cut short and one in eleven has no id."""
    whole = F.struct(F.col("id").cast("int").alias("id"), "timestamp", F.array("x", "y", "z").alias("transform"), F.col("blur").alias("estimatedBlurPx"), F.concat(F.lit("f"), F.col("id"), F.lit(".jpg")).alias("imageFile"))
    line = F.when(F.col("id") % 7 == 0, F.lit('{"id": 1, "timesta')).when(F.col("id") % 11 == 0, F.lit('{"timestamp": 1.5}')).otherwise(F.to_json(whole))
    scan_lines(ad.frames(spark, sf), path, line)


@query("io2_read_poses", f"WITH {FR} SELECT 'scan_id=' || scan_id AS scan_id, id, round(timestamp, 3) AS timestamp, round(x, 6) AS x, round(blur, 6) AS blur, 'f' || id || '.jpg' AS image FROM frames WHERE id % 7 <> 0 AND id % 11 <> 0")
def io2(spark, sf):
    path = folder(spark, "poses")
    pose_lines(spark, sf, path)
    return scans.read_poses(spark, path).select("scan_id", F.col("id").cast("long").alias("id"), F.round("timestamp", 3).alias("timestamp"), r6(F.col("transform")[0]).alias("x"), r6(F.col("estimatedBlurPx")).alias("blur"), F.col("imageFile").alias("image"))


@query("io2_bad_pose_lines", f"WITH {FR} SELECT 'scan_id=' || scan_id AS scan_id, count(*) FILTER (id % 7 = 0 OR id % 11 = 0) AS bad FROM frames GROUP BY scan_id")
def io2_bad(spark, sf):
    path = folder(spark, "poses")
    pose_lines(spark, sf, path)
    return scans.count_bad_lines(spark, path).select(F.regexp_extract("path", r".*/(scan_[^/]+)/", 1).alias("scan_id"), "bad").groupBy("scan_id").agg(F.sum("bad").alias("bad"))


@query("io4_session_metadata", "SELECT 'scan_id=' || s AS scan_id, CASE WHEN s % 3 = 0 THEN 'new' ELSE 'old' END AS app, CAST(CASE WHEN s % 3 = 0 THEN 2 ELSE 1 END AS INT) AS version FROM (SELECT DISTINCT label AS s FROM embeddings) t")
def io4(spark, sf):
    """Each scan has a legacy file, every third a current one, which wins."""
    path = folder(spark, "sessions")
    own = ad.points(spark, sf).select("scan_id").distinct()
    scan_lines(own, f"{path}/legacy", F.lit('{"app": "old",\n "version": 1}'))
    scan_lines(own.filter(F.col("scan_id").cast("int") % 3 == 0), f"{path}/current", F.lit('{"app": "new",\n "version": 2}'))
    return scans.read_sessions(spark, f"{path}/current", f"{path}/legacy").select("scan_id", "app", "version")


@query("io12_write_poses", f"WITH {Q} SELECT id, round(tx, 9) AS tx, round(fx, 9) AS fx, 240 AS width FROM poses")
def io12(spark, sf):
    path = folder(spark, "refined")
    scans.write_poses(ad.poses(spark, sf).select("id", "pose", "intrinsics"), path)
    back = spark.read.schema("id long, intrinsics struct<fx:double,width:int>, pose array<double>").json(path)
    return back.select("id", F.round(F.col("pose")[3], 9).alias("tx"), F.round("intrinsics.fx", 9).alias("fx"), "intrinsics.width")


@query("io13_atomic_publish", f"WITH {P} SELECT scan_id, ordinal, x FROM points WHERE far")
def io13(spark, sf):
    """What is published last stands alone."""
    path = folder(spark, "published")
    own = ad.points(spark, sf).select("scan_id", "ordinal", "x", "far")
    scans.publish(own, path)
    scans.publish(own.filter("far").drop("far"), path)
    return spark.read.parquet(path)


@query("io19_checkpoint", f"WITH {P} SELECT ordinal, score, 7 AS step FROM points")
def io19(spark, sf):
    path = folder(spark, "model")
    scans.checkpoint_model(ad.points(spark, sf).select("ordinal", "score"), 7, path)
    back, step = scans.load_checkpoint(spark, path)
    return back.withColumn("step", F.lit(step))


@query("io24_metrics_csv", f"WITH {P} SELECT ordinal, scan_id, round(score, 9) AS score FROM points")
def io24(spark, sf):
    path = folder(spark, "metrics")
    scans.write_metrics(ad.points(spark, sf).select("ordinal", "scan_id", "score"), path)
    return spark.read.schema("ordinal long, scan_id string, score double").option("header", True).csv(path).withColumn("score", F.round("score", 9))


@query("io15_archives", "SELECT CAST(label AS VARCHAR) AS scan_id, 'f' || vec_id || '.txt' AS name, length('vector ' || vec_id) AS size, 'vector ' || vec_id AS content FROM embeddings")
def io15(spark, sf):
    files = ad.points(spark, sf).select("scan_id", F.format_string("f%d.txt", "ordinal").alias("name"), F.format_string("vector %d", "ordinal").cast("binary").alias("content"))
    bundles = scans.zip_bundle(files, "scan_id").select(F.col("scan_id").alias("path"), F.col("archive").alias("content"))
    return scans.entries_of(bundles).select(F.col("path").alias("scan_id"), "name", "size", F.col("content").cast("string").alias("content"))


def model(spark, sf):
    """Cameras, images and points of ten scans."""
    scan = (F.col("id") % 10).cast("string").alias("scan_id")
    images = ad.poses(spark, sf).select(scan, F.col("id").alias("image_id"), g.colmap_pose("pose").alias("p"), F.lit(1).cast("long").alias("camera_id"), F.format_string("f %d.jpg", "id").alias("name"))
    images = images.select("scan_id", "image_id", *[F.col(f"p.{c}") for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")], "camera_id", "name")
    scans = ad.poses(spark, sf).groupBy((F.col("id") % 10).alias("id")).agg(F.count("*").alias("n"))  # a camera a scan, its focal length from the scan's size
    cameras = scans.select(F.col("id").cast("string").alias("scan_id"), (F.col("id") + 1).alias("camera_id"), F.lit("PINHOLE").alias("model"), F.lit(640).cast("long").alias("width"), F.lit(480).cast("long").alias("height"), F.array((F.col("n") + 500).cast("double"), F.lit(501.5), F.lit(320.0), F.lit(240.0)).alias("params"))
    own = ad.points(spark, sf).select("scan_id", F.col("ordinal").alias("point_id"), "x", "y", "z", *[((F.col("ordinal") + i) % 256).cast("int").alias(c) for i, c in enumerate("rgb")], F.lit(0.5).alias("error"))
    return cameras, images, own


POINTS_BACK = f"WITH {P} SELECT ordinal AS point_id, x, z, CAST((ordinal + 2) % 256 AS INT) AS b FROM points"
IMAGES_BACK = f"WITH {Q} SELECT id AS image_id, 'f ' || id || '.jpg' AS name, round(sqrt(tx*tx+ty*ty+tz*tz), 6) AS away FROM poses"
CAMERAS_BACK = "SELECT vec_id % 10 + 1 AS camera_id, 'PINHOLE' AS model, CAST(count(*) + 500 AS DOUBLE) AS fx FROM embeddings GROUP BY 1"


def away(images):
    """The camera's distance from the origin does not depend on its orientation."""
    return images.select("image_id", "name", r6(F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2 + F.col("tz") ** 2)).alias("away"))


def files(spark, sf, name: str):
    return colmap.model_files(*model(spark, sf)).filter(F.col("name") == name).select(F.col("scan_id").alias("path"), "content")


@query("io9_points_back", POINTS_BACK)
def io9_points(spark, sf):
    return colmap.points_of(files(spark, sf, "points3D.bin")).select("point_id", "x", "z", "b")


@query("io9_images_back", IMAGES_BACK)
def io9_images(spark, sf):
    return away(colmap.images_of(files(spark, sf, "images.bin")))


@query("io9_cameras_back", CAMERAS_BACK)
def io9_cameras(spark, sf):
    return colmap.cameras_of(files(spark, sf, "cameras.bin")).select("camera_id", "model", F.col("params")[0].alias("fx"))


@query("io10_points_text", POINTS_BACK)
def io10_points(spark, sf):
    path = folder(spark, "points")
    colmap.point_lines(model(spark, sf)[2]).write.text(path)
    return colmap.read_points_text(spark, path).select("point_id", "x", "z", "b")


@query("io10_images_text", IMAGES_BACK)
def io10_images(spark, sf):
    path = folder(spark, "images")
    colmap.image_lines(model(spark, sf)[1]).write.text(path)
    return away(colmap.read_images_text(spark, path))


@query("io10_cameras_text", CAMERAS_BACK)
def io10_cameras(spark, sf):
    path = folder(spark, "cameras")
    colmap.camera_lines(model(spark, sf)[0]).write.text(path)
    return colmap.read_cameras_text(spark, path).select("camera_id", "model", F.col("params")[0].alias("fx"))


def cloud(spark, sf) -> str:
    """The points as one PLY file in the shared folder, which its tasks write side by side."""
    path = folder(spark, "cloud").removeprefix("file:") + ".ply"
    own = ad.points(spark, sf).select(F.col("ordinal").alias("row"), *[F.col(c).cast("float") for c in "xyz"], *[((F.col("ordinal") + i) % 256).cast("int").alias(c) for i, c in enumerate(("red", "green", "blue"))])
    ply.write(own, path, ["row"])
    return path


CLOUD = f"WITH {P} SELECT CAST(x AS FLOAT)::DOUBLE AS x, CAST(z AS FLOAT)::DOUBLE AS z, CAST((ordinal + 1) % 256 AS INT) AS green FROM points"


@query("io8_ply_round_trip", CLOUD)
def io8(spark, sf):
    return spark.read.format("ply").load(cloud(spark, sf)).select(F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"), "green")


@query("io6_ply_reader", CLOUD)
def io6(spark, sf):
    return ply.read_binary(spark, cloud(spark, sf)).select(F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"), F.col("green").cast("int").alias("green"))


@query("io7_strict_preview", f"WITH {P}, n AS (SELECT greatest(1, -(-count(*) // 100)) AS step, count(*) AS n FROM points) SELECT CAST(o AS BIGINT) AS ordinal FROM n, range(n) t(o) WHERE o % step = 0")
def io7(spark, sf):
    return ply.strict_preview(spark, cloud(spark, sf), 100).select("ordinal")


@query("io18_splat_ply", f"WITH {P} SELECT CAST(x AS FLOAT)::DOUBLE AS x, CAST(score AS FLOAT)::DOUBLE AS opacity, CAST(y AS FLOAT)::DOUBLE AS scale_1, 1.0::DOUBLE AS rot_0 FROM points")
def io18(spark, sf):
    ply.register(spark)
    path = folder(spark, "splats").removeprefix("file:") + ".ply"
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    own = ad.points(spark, sf).select(F.col("ordinal").alias("row"), F.array("x", "y", "z").alias("mean"), F.array("x", "y", "z").alias("log_scale"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("quat"), F.col("score").alias("opacity"), zeros(3).alias("sh0"), zeros(9).alias("sh_rest"))
    ply.write(ply.splat_rows(own, 1), path, ["row"])
    return spark.read.format("ply").load(path).select(*[F.col(c).cast("double").alias(c) for c in ("x", "opacity", "scale_1", "rot_0")])


@query("io17_quantised_model", f"WITH {P} SELECT ordinal AS row, round(x, 3) AS x FROM points")
def io17(spark, sf):
    """Means in two byte planes and their head in an archive, read back; steps of 1/65535 of the box do not show at a millimetre but at an edge, so places are counted from the view's own."""
    own = splats.quantised_means(ad.points(spark, sf).withColumnRenamed("ordinal", "row"))
    bundle = scans.zip_bundle(scans.sog_files(own, {}), "model")
    back = scans.read_sog(scans.entries_of(bundle.select(F.lit("m").alias("path"), F.col("archive").alias("content"))))
    near = ad.points(spark, sf).select(F.col("ordinal").alias("row"), F.col("x").alias("true"))
    return back.join(near, "row").select("row", F.round(F.when(F.abs(F.col("x") - F.col("true")) < 1e-4, F.col("true")), 3).alias("x"))
