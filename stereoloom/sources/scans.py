"""Scan folders, pose files, rasters, metadata, and their sinks."""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereoloom.functions import geometry as g
from stereoloom.functions.numeric import upper_median

FRAME = """id int, timestamp double, transform array<double>, intrinsics struct<fx:double,fy:double,cx:double,cy:double,width:int,height:int>,
exposureDuration double, exposureOffsetEV double, iso double, ambientLux double, estimatedBlurPx double, sharpness double, sharpnessRatio double, blurVerdict string,
imageFile string, depthFile string, confidenceFile string, depthWidth int, depthHeight int"""
SESSION = """app string, version int, device string, osVersion string, startedAt string, mode string, worldAlignment string, cameraConvention string, imageOrientation string,
depthFormat string, lidarAvailable boolean, lidarEnabled boolean, rgbReconstructionEnabled boolean, debugAssertionsEnabled boolean"""


#: Characters of a folder's name that Spark's writer escapes.
_ESCAPED = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _scan_of(path):
    return F.regexp_extract(path, r".*/(scan_[^/]+)/", 1)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """IO2: frames of JSON lines; lines that do not parse, or have no id, are left out."""
    rows = spark.read.schema(FRAME).option("mode", "DROPMALFORMED").json(path)
    return rows.filter("id is not null").withColumn("scan_id", _scan_of(F.col("_metadata.file_path")))


def write_lines(lines: DataFrame, path: str) -> None:
    """IO2: lines (scan_id, value) as one file in a folder for each scan, ``scan_id=...``.

    Where Python can reach the path (``file:`` and plain ones), tasks write
    the files side by side and rename each when it is whole, which spares the
    two processes a file that a local file system's permissions cost and the
    driver's renames. Other stores go through Spark's writer.
    """
    own = lines.select(F.coalesce(F.nullif(F.col("scan_id").cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("scan_id"), F.col("value").cast("string").alias("value")).filter("value is not null")
    if "://" in path.removeprefix("file://") or not path.startswith(("/", "file:")):
        own.repartition("scan_id").write.partitionBy("scan_id").text(path)
        return
    root = path.removeprefix("file://").removeprefix("file:")

    def write(batches):
        written, file, scan, done = 0, None, None, None
        part = f".{uuid.uuid4().hex}"

        def close():
            file.close()
            os.replace(file.name, done)

        try:
            for batch in batches:
                scans, values = batch.column(0), batch.column(1).to_pylist()
                ends = pc.run_end_encode(scans)
                at = 0
                for end, name in zip(ends.run_ends.to_pylist(), ends.values.to_pylist(), strict=True):
                    if name != scan:
                        if file is not None:
                            close()
                            written += 1
                        folder = f"{root}/scan_id={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', name)}"
                        os.makedirs(folder, exist_ok=True)
                        scan, done = name, f"{folder}/lines.txt"
                        file = open(f"{folder}/{part}", "w", encoding="utf-8", newline="")  # noqa: SIM115
                    file.write("\n".join(values[at:end]) + "\n")
                    at = end
            if file is not None:
                close()
                written += 1
        finally:
            if file is not None and not file.closed:
                file.close()
                os.remove(file.name)
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["files"])

    os.makedirs(root)
    own.repartition("scan_id").sortWithinPartitions("scan_id").mapInArrow(write, "files long").agg(F.sum("files")).collect()


def count_bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """IO2: lines a file that ``read_poses`` leaves out: those that do not parse and those without an id."""
    rows = spark.read.schema(FRAME + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count_if(F.col("_corrupt_record").isNotNull() | F.col("id").isNull()).alias("bad"))


def read_sessions(spark: SparkSession, current: str, legacy: str | None = None) -> DataFrame:
    """IO4: session metadata by scan; the current file's wins over the legacy one's."""
    read = lambda path, rank: spark.read.schema(SESSION).option("multiLine", True).json(path).withColumns({"scan_id": _scan_of(F.col("_metadata.file_path")), "rank": F.lit(rank)})
    both = read(current, 0) if legacy is None else read(current, 0).unionByName(read(legacy, 1))
    from pyspark.sql import Window

    w = Window.partitionBy("scan_id").orderBy("rank")
    return both.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "rank")


def list_scans(spark: SparkSession, root: str) -> DataFrame:
    """IO1: scans below a folder with files, bytes and start, newest first, then by id.

    Only names and sizes are read for the listing; scans without session
    metadata have a null start.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    own = files.withColumn("scan_id", _scan_of(F.col("path"))).filter("scan_id <> ''")
    sizes = own.groupBy("scan_id").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    metas = spark.read.schema(SESSION).option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "{capture-meta,meta}.json").json(root)
    start = metas.withColumn("scan_id", _scan_of(F.col("_metadata.file_path"))).groupBy("scan_id").agg(F.max(F.to_timestamp("startedAt")).alias("started"))
    return sizes.join(start, "scan_id", "left").orderBy(F.desc_nulls_last("started"), F.desc("scan_id"))


def read_rasters(spark: SparkSession, root: str, sizes: DataFrame) -> DataFrame:
    """IO5: depth and confidence rasters of frames (scan_id, frame_id, depthFile, confidenceFile, width, height).

    A raster whose byte count differs from its frame's size is left out; the
    size is compared before content is used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(root)
    own = files.select(_scan_of(F.col("path")).alias("scan_id"), F.element_at(F.split("path", "/"), -1).alias("file"), "length", "content")
    depth = own.withColumnsRenamed({"file": "depthFile", "length": "dl", "content": "depth"})
    conf = own.withColumnsRenamed({"file": "confidenceFile", "length": "cl", "content": "conf"})
    both = sizes.join(depth, ["scan_id", "depthFile"]).join(conf, ["scan_id", "confidenceFile"])
    return both.filter((F.col("dl") == F.col("width") * F.col("height") * 4) & (F.col("cl") == F.col("width") * F.col("height"))).select("scan_id", "frame_id", "width", "height", "depth", "conf")


def write_poses(frames: DataFrame, path: str) -> None:
    """IO12: JSON lines with sorted keys."""
    frames.select(*sorted(frames.columns)).write.json(path)


def nerf_transforms(frames: DataFrame) -> DataFrame:
    """IO11: one JSON document a scan: upper-median intrinsics at the root, per-frame camera-to-world matrices in id order."""
    k = F.col("intrinsics")
    rows = F.array(*[F.slice("transform", 4 * r + 1, 4) for r in range(4)])
    frame = F.struct("id", F.concat(F.lit("images/"), F.col("imageFile")).alias("file_path"), rows.alias("transform_matrix"))
    names = {"fl_x": "fx", "fl_y": "fy", "cx": "cx", "cy": "cy", "w": "width", "h": "height"}
    own = frames.groupBy("scan_id").agg(*[upper_median(k[v]).alias(n) for n, v in names.items()], F.array_sort(F.collect_list(frame)).alias("frames"))
    body = F.struct(F.lit("OPENCV").alias("camera_model"), *names, F.transform("frames", lambda f: F.struct(f["file_path"].alias("file_path"), f["transform_matrix"].alias("transform_matrix"))).alias("frames"))
    return own.select("scan_id", F.to_json(body).alias("json"))


def read_nerf_transforms(spark: SparkSession, path: str) -> DataFrame:
    """IO11: frames of such documents."""
    schema = "fl_x double, fl_y double, cx double, cy double, w int, h int, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("f", F.explode("frames")).select("fl_x", "fl_y", "cx", "cy", "w", "h", "f.file_path", F.flatten("f.transform_matrix").alias("transform"))


def write_metrics(df: DataFrame, path: str) -> None:
    """IO24: CSV with a header."""
    df.write.option("header", True).csv(path)


def publish(df: DataFrame, path: str) -> None:
    """IO13: Parquet written beside the target and renamed when complete, by the file system of the path."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.partial"
    df.write.mode("overwrite").parquet(staged)
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{staged} could not be renamed to {path}")


def checkpoint_model(splats: DataFrame, step: int, path: str) -> None:
    """IO19: a snapshot with its header (version, step, rows), published whole."""
    publish(splats.withColumns({"__version": F.lit(1), "__step": F.lit(step)}), path)


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    df = spark.read.parquet(path)
    head = df.select("__version", "__step").first()
    if head is None or head[0] != 1:
        raise ValueError(f"{path} is not a checkpoint of version 1")
    return df.drop("__version", "__step"), head[1]


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """IO15: entries of archive files (path, name, size, crc, content); broken archives are left out."""
    return entries_of(spark.read.format("binaryFile").load(path))


def entries_of(archives: DataFrame) -> DataFrame:
    """IO15: entries of archives (path, content)."""

    def run(batches):
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(data))
                except zipfile.BadZipFile:
                    continue
                for e in archive.infolist():
                    yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([e.filename]), pa.array([e.file_size], pa.int64()), pa.array([e.CRC], pa.int64()), pa.array([archive.read(e)], pa.binary())], names=["path", "name", "size", "crc", "content"])

    return archives.select("path", "content").mapInArrow(run, "path string, name string, size long, crc long, content binary")


def zip_bundle(files: DataFrame, key: str) -> DataFrame:
    """IO15, IO17: one stored archive for each key from (name, content) rows; a bundle is one model's files."""
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for row in pdf.sort_values("name").itertuples():
                z.writestr(zipfile.ZipInfo(row.name), row.content)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "archive": [out.getvalue()]})

    return files.select(key, "name", "content").groupBy(key).applyInPandas(pack, f"{key} {files.schema[key].dataType.simpleString()}, archive binary")


#: Splats whose quantised values lie in one file of a model.
SOG_ROWS = 1 << 16


def sog_files(quantised: DataFrame, codebooks: dict[str, list[float]], model: str = "m") -> DataFrame:
    """IO17: files (model, name, content) of a quantised model: the JSON head, and low and high bytes of the means in planes.

    A plane is raw bytes, x, y and z of one splat after the other in order of
    ``row``, ``SOG_ROWS`` splats a file (``row`` counts from 0); image codecs are left out.
    """

    def planes(part: pa.Table) -> pa.Table:
        part = part.sort_by("row")
        steps = np.stack([part.column(f"q{c}").to_numpy() for c in "xyz"], axis=1).astype("<u2")
        at = part.column("part")[0].as_py()
        return pa.table({"name": [f"means_{n}-{at:06d}" for n in "lu"], "content": pa.array([(steps & 255).astype(np.uint8).tobytes(), (steps >> 8).astype(np.uint8).tobytes()], pa.binary())})

    spark = quantised.sparkSession
    own = quantised.select("row", "qx", "qy", "qz", F.expr(f"row div {SOG_ROWS}").alias("part"))
    files = own.groupBy("part").applyInArrow(planes, "name string, content binary")
    head = spark.createDataFrame([("meta.json", bytearray(sog_metadata(quantised, codebooks).encode()))], "name string, content binary")
    return files.unionAll(head).select(F.lit(model).alias("model"), "name", "content")


def read_sog(files: DataFrame) -> DataFrame:
    """IO17: ``row, x, y, z`` of the means of one model's files (name, content); the head is read on the driver."""
    from stereoloom.operators.splats import dequantised_means

    head = json.loads(bytes(files.filter("name = 'meta.json'").first()["content"]))
    box = {f"{e}_{c}": head["means"][k][i] for e, k in (("lo", "mins"), ("hi", "maxs")) for i, c in enumerate("xyz")}

    def steps(parts: pa.Table) -> pa.Table:
        low, high = (np.frombuffer(x, dtype=np.uint8).astype(np.int32).reshape(-1, 3) for x in parts.sort_by("name").column("content").to_pylist())
        q = low + 256 * high
        first = parts.column("part")[0].as_py() * SOG_ROWS
        return pa.table({"row": pa.array(np.arange(first, first + len(q))), **{f"q{c}": pa.array(q[:, i].copy(), pa.int32()) for i, c in enumerate("xyz")}})

    own = files.filter("name like 'means%'").select("name", "content", F.substring_index("name", "-", -1).cast("long").alias("part"))
    quantised = own.groupBy("part").applyInArrow(steps, "row long, qx int, qy int, qz int")
    return dequantised_means(quantised.withColumns({k: F.lit(v) for k, v in box.items()})).select("row", "x", "y", "z")


def sog_metadata(quantised: DataFrame, codebooks: dict[str, list[float]]) -> str:
    """IO17: the JSON head of a quantised model: count, means' box, codebooks."""
    box = quantised.agg(F.count("*").alias("n"), *[F.first(f"{e}_{c}").alias(f"{e}_{c}") for e in ("lo", "hi") for c in "xyz"]).first()
    return json.dumps({"version": 1, "count": box["n"], "means": {"mins": [box[f"lo_{c}"] for c in "xyz"], "maxs": [box[f"hi_{c}"] for c in "xyz"]}, "codebooks": codebooks}, sort_keys=True)


def floor_plan_svg(walls: DataFrame) -> DataFrame:
    """IO20: one SVG a scan of wall segments (scan_id, x0, y0, x1, y1), in metres, y up."""
    line = F.format_string('<line x1="%.3f" y1="%.3f" x2="%.3f" y2="%.3f" stroke="black" stroke-width="0.05"/>', "x0", -F.col("y0"), "x1", -F.col("y1"))
    own = walls.groupBy("scan_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"), F.min(F.least("x0", "x1")).alias("x"), F.min(-F.greatest("y0", "y1")).alias("y"), (F.max(F.greatest("x0", "x1")) - F.min(F.least("x0", "x1"))).alias("w"), (F.max(F.greatest("y0", "y1")) - F.min(F.least("y0", "y1"))).alias("h"))
    return own.select("scan_id", F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="%.3f %.3f %.3f %.3f">\n%s\n</svg>', "x", "y", "w", "h", "body").alias("svg"))


def floor_plan_dxf(walls: DataFrame) -> DataFrame:
    """IO20: one DXF a scan with a LINE entity for each wall segment."""
    line = F.format_string("0\nLINE\n8\nwalls\n10\n%.4f\n20\n%.4f\n11\n%.4f\n21\n%.4f", "x0", "y0", "x1", "y1")
    own = walls.groupBy("scan_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    return own.select("scan_id", F.concat(F.lit("0\nSECTION\n2\nENTITIES\n"), "body", F.lit("\n0\nENDSEC\n0\nEOF\n")).alias("dxf"))


def orbits(scans: DataFrame, radius: float = 2.0) -> DataFrame:
    """IO23: for each scan (scan_id, frames) that many poses on a circle, looking at its centre."""
    own = scans.withColumn("id", F.explode(F.sequence(F.lit(0), (F.col("frames") - 1).cast("int")))).filter("frames > 0")
    a = F.col("id") * F.lit(2 * np.pi) / F.col("frames")
    # backward axis points from the centre to the camera, right is perpendicular in the plane
    bx, bz = F.cos(a), F.sin(a)
    pose = g.matrix([bz, 0, bx, bx * radius, 0, 1, 0, 0, -bx, 0, bz, bz * radius, 0, 0, 0, 1])
    k = F.struct(F.lit(400.0).alias("fx"), F.lit(400.0).alias("fy"), F.lit(238.5).alias("cx"), F.lit(181.25).alias("cy"), F.lit(480).alias("width"), F.lit(360).alias("height"))
    return own.select("scan_id", "id", (F.col("id") * 0.5).alias("timestamp"), pose.alias("transform"), k.alias("intrinsics"), F.format_string("frame_%05d.jpg", "id").alias("imageFile"))


def synthetic_orbit(spark: SparkSession, frames: int = 36, radius: float = 2.0, points: int = 4000, seed: int = 1, scan_id: str = "scan_orbit") -> tuple[DataFrame, DataFrame]:
    """IO23: poses on a circle looking at its centre, and points on a unit sphere; all from hashes of (seed, row)."""
    from stereoloom.functions.numeric import hash_uniform

    out = orbits(spark.range(1).select(F.lit(scan_id).alias("scan_id"), F.lit(frames).alias("frames")), radius)
    u, v = hash_uniform(F.lit(seed), "id"), hash_uniform(F.lit(seed + 1), "id")
    z, t = 2 * u - 1, 2 * F.pi() * v
    r = F.sqrt(1 - z * z)
    cloud = spark.range(points).select(F.lit(scan_id).alias("scan_id"), F.col("id").alias("ordinal"), (r * F.cos(t)).alias("x"), z.alias("y"), (r * F.sin(t)).alias("z"))
    return out, cloud
