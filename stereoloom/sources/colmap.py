"""COLMAP models: cameras, images and points in binary and text form.

Each file is one record stream without an index, so a file is decoded in one
task; models are read side by side.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Camera model numbers and parameter counts of the format.
MODELS = {0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8)}
NUMBERS = {name: (number, n) for number, (name, n) in MODELS.items()}
CAMERA = "path string, camera_id long, model string, width long, height long, params array<double>"
IMAGE = "path string, image_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id long, name string"
POINT = "path string, point_id long, x double, y double, z double, r int, g int, b int, error double"


def decode_cameras(data: bytes):
    (n,), at = struct.unpack_from("<Q", data), 8
    for _ in range(n):
        camera, model, w, h = struct.unpack_from("<iiQQ", data, at)
        at += 24
        name, k = MODELS[model]
        yield camera, name, w, h, list(struct.unpack_from(f"<{k}d", data, at))
        at += 8 * k


def encode_cameras(rows) -> bytes:
    rows = list(rows)
    out = [struct.pack("<Q", len(rows))]
    for camera, model, w, h, params in rows:
        number, k = NUMBERS[model]
        out.append(struct.pack(f"<iiQQ{k}d", camera, number, w, h, *params))
    return b"".join(out)


def decode_images(data: bytes):
    (n,), at = struct.unpack_from("<Q", data), 8
    for _ in range(n):
        image, *pose, camera = struct.unpack_from("<i7di", data, at)
        at += 64
        end = data.index(b"\0", at)
        name = data[at:end].decode()
        (marks,) = struct.unpack_from("<Q", data, end + 1)
        at = end + 9 + 24 * marks
        yield image, *pose, camera, name


def encode_images(rows) -> bytes:
    rows = list(rows)
    out = [struct.pack("<Q", len(rows))]
    for image, *pose, camera, name in rows:
        out.append(struct.pack("<i7di", image, *pose, camera) + name.encode() + b"\0" + struct.pack("<Q", 0))
    return b"".join(out)


def decode_points(data: bytes):
    (n,), at = struct.unpack_from("<Q", data), 8
    for _ in range(n):
        point, x, y, z, r, g, b, error, track = struct.unpack_from("<Q3d3BdQ", data, at)
        at += 51 + 8 * track
        yield point, x, y, z, r, g, b, error


def encode_points(rows) -> bytes:
    rows = list(rows)
    return struct.pack("<Q", len(rows)) + b"".join(struct.pack("<Q3d3BdQ", *row, 0) for row in rows)


def _decoded(files: DataFrame, decode, schema: str) -> DataFrame:
    """Records of binary model files (path, content)."""

    def run(batches):
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(where, *r) for r in decode(data)]
                except (struct.error, KeyError, ValueError):
                    continue  # a file that ends early or is of another kind
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_arrow(schema))

    return files.select("path", "content").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def cameras_of(files: DataFrame) -> DataFrame:
    return _decoded(files, decode_cameras, CAMERA)


def images_of(files: DataFrame) -> DataFrame:
    return _decoded(files, decode_images, IMAGE)


def points_of(files: DataFrame) -> DataFrame:
    return _decoded(files, decode_points, POINT)


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    return cameras_of(spark.read.format("binaryFile").load(path))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return images_of(spark.read.format("binaryFile").load(path))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return points_of(spark.read.format("binaryFile").load(path))


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter("not startswith(value, '#')")


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    w = F.split(F.trim("value"), r"\s+")
    return _text_lines(spark, path).filter("trim(value) <> ''").select("path", w[0].cast("long").alias("camera_id"), w[1].alias("model"), w[2].cast("long").alias("width"), w[3].cast("long").alias("height"), F.transform(F.slice(w, 5, 64), lambda x: x.cast("double")).alias("params"))


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    """An image's first line has ten fields and a name; its second one the marks, in threes, and is left out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.filter(F.split("value", "\n"), lambda s: ~s.startswith("#")).alias("lines"))
    line = whole.select("path", F.posexplode("lines").alias("i", "value")).filter("i % 2 = 0 and trim(value) <> ''")
    w = F.split(F.trim("value"), r"\s+")
    return line.select("path", w[0].cast("long").alias("image_id"), *[w[i + 1].cast("double").alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))], w[8].cast("long").alias("camera_id"), F.array_join(F.slice(w, 10, 1000), " ").alias("name"))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    w = F.split(F.trim("value"), r"\s+")
    return _text_lines(spark, path).filter("trim(value) <> ''").select("path", w[0].cast("long").alias("point_id"), *[w[i].cast("double").alias(n) for i, n in ((1, "x"), (2, "y"), (3, "z"))], *[w[i].cast("int").alias(n) for i, n in ((4, "r"), (5, "g"), (6, "b"))], w[7].cast("double").alias("error"))


def camera_lines(cameras: DataFrame) -> DataFrame:
    return cameras.orderBy("camera_id").select(F.concat_ws(" ", F.col("camera_id").cast("string"), "model", F.col("width").cast("string"), F.col("height").cast("string"), F.array_join(F.transform("params", lambda p: p.cast("string")), " ")).alias("value"))


def image_lines(images: DataFrame) -> DataFrame:
    """Two lines a record; the second is empty."""
    fields = [F.col(c).cast("string") for c in ("image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name")]
    return images.orderBy("image_id").select(F.concat(F.concat_ws(" ", *fields), F.lit("\n")).alias("value"))


def point_lines(points: DataFrame) -> DataFrame:
    fields = [F.col(c).cast("string") for c in ("point_id", "x", "y", "z", "r", "g", "b", "error")]
    return points.orderBy("point_id").select(F.concat_ws(" ", *fields).alias("value"))


def model_files(cameras: DataFrame, images: DataFrame, points: DataFrame) -> DataFrame:
    """IO9: (scan_id, name, content) of each scan's three binary files. A file is one stream, so a scan's rows meet in one task."""
    import pandas as pd

    def pack(columns, encode, order, name):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = pdf.sort_values(order)[columns].itertuples(index=False, name=None)
            return pd.DataFrame({"scan_id": [pdf.scan_id.iloc[0]], "name": [name], "content": [encode(rows)]})

        return run

    out = "scan_id string, name string, content binary"
    c = cameras.groupBy("scan_id").applyInPandas(pack(["camera_id", "model", "width", "height", "params"], encode_cameras, "camera_id", "cameras.bin"), out)
    i = images.groupBy("scan_id").applyInPandas(pack(["image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name"], encode_images, "image_id", "images.bin"), out)
    p = points.groupBy("scan_id").applyInPandas(pack(["point_id", "x", "y", "z", "r", "g", "b", "error"], encode_points, "point_id", "points3D.bin"), out)
    return c.unionByName(i).unionByName(p)
