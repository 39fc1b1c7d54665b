"""PLY point files: reader and writer as Spark data sources.

A row's place in a file follows from its ``ordinal``, so tasks write into one
file side by side and a task that runs again writes the same bytes there.

The reader splits a binary file into ranges of whole vertices, so one large
file is read by many tasks. Files are opened through Hadoop-style paths that
Python can reach (``file:`` and plain paths); other stores go through
``read_binary``, which lets Spark fetch the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# Scalar type names of the PLY format.
KINDS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
SPARK = {"i1": "int", "u1": "int", "i2": "int", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
ROWS_PER_PART = 1 << 20
STRICT = [("x", "f4"), ("y", "f4"), ("z", "f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")]


class Header:
    """Format, vertex count and properties, and where the vertices start."""

    def __init__(self, data: bytes):
        end = data.find(b"end_header")
        if not data.startswith(b"ply") or end < 0:
            raise ValueError("not a PLY file")
        self.offset = data.index(b"\n", end) + 1
        self.count, self.properties, self.ascii, element = 0, [], False, ""
        first = None
        for line in data[:end].decode("ascii", "replace").splitlines():
            words = line.split()
            if not words:
                continue
            if words[0] == "format":
                if words[1] not in ("ascii", "binary_little_endian"):
                    raise ValueError(f"PLY format {words[1]} is not read")
                self.ascii = words[1] == "ascii"
            elif words[0] == "element":
                element = words[1]
                first = first or element
                if element == "vertex":
                    self.count = int(words[2])
            elif words[0] == "property" and element == "vertex":
                if words[1] == "list":
                    raise ValueError("list properties of vertices are not read")
                self.properties.append((words[2], KINDS[words[1]]))
        if first != "vertex":
            raise ValueError("vertices must come first")

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, f"<{k}") for n, k in self.properties])

    def schema(self) -> str:
        return "ordinal bigint, " + ", ".join(f"`{n}` {SPARK[k]}" for n, k in self.properties)


def parse(data: bytes) -> np.ndarray:
    """All vertices as a structured array; a file that ends early gives its whole vertices."""
    h = Header(data)
    if h.ascii:
        rows = data[h.offset :].split(b"\n")[: h.count]
        return np.array([tuple(float(v) if k[0] == "f" else int(float(v)) for v, (_, k) in zip(r.split(), h.properties, strict=False)) for r in rows if len(r.split()) >= len(h.properties)], dtype=h.dtype)
    n = min(h.count, (len(data) - h.offset) // h.dtype.itemsize)
    return np.frombuffer(data, dtype=h.dtype, count=n, offset=h.offset)


def encode(columns: list[tuple[str, str]], rows: np.ndarray) -> bytes:
    """A binary little-endian file of a structured array."""
    return _head(columns, len(rows)) + rows.tobytes()


def _head(columns: list[tuple[str, str]], count: int, size: int | None = None) -> bytes:
    """The header, filled up to ``size`` bytes by a comment if that is given."""
    names = {"i1": "char", "u1": "uchar", "i2": "short", "u2": "ushort", "i4": "int", "u4": "uint", "f4": "float", "f8": "double"}
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {count}", *[f"property {names[k]} {n}" for n, k in columns], "end_header", ""]
    if size is not None:
        lines.insert(2, "comment" + " " * (size - len("\n".join(lines)) - len("comment\n")))
    return "\n".join(lines).encode()


def _placed_size(columns: list[tuple[str, str]]) -> int:
    """Bytes of a header that has room for any count."""
    return len(_head(columns, 0)) + 64


def _record(batch: pa.RecordBatch, columns: list[tuple[str, str]]) -> np.ndarray:
    """Rows of a batch as they lie in the file. Null floats are not numbers; whole numbers that do not fit, or are null, are refused."""
    out = np.empty(batch.num_rows, dtype=[(n, f"<{k}") for n, k in columns])
    for name, kind in columns:
        values = batch.column(batch.schema.get_field_index(name))
        if kind[0] == "f":
            out[name] = values.to_numpy(zero_copy_only=False)
            continue
        limit = np.iinfo(kind)
        if values.null_count:
            raise ValueError(f"{name} is null")
        numbers = values.to_numpy(zero_copy_only=False)
        if len(numbers) and not (limit.min <= numbers.min() and numbers.max() <= limit.max):
            raise ValueError(f"{name} does not fit {kind}")
        out[name] = numbers
    return out


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def _table(rows: np.ndarray, start: int) -> pa.RecordBatch:
    wide = {"u1": np.int32, "i1": np.int32, "u2": np.int32, "i2": np.int32, "u4": np.int64}
    columns = [pa.array(np.arange(start, start + len(rows), dtype=np.int64))]
    for name in rows.dtype.names:
        kind = rows.dtype[name].str[1:]
        columns.append(pa.array(np.ascontiguousarray(rows[name]).astype(wide.get(kind, rows.dtype[name]))))
    return pa.RecordBatch.from_arrays(columns, names=["ordinal", *rows.dtype.names])


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = _local(path)

    def _header(self) -> Header:
        with open(self.path, "rb") as f:
            return Header(f.read(1 << 16))

    def partitions(self):
        n = self._header().count
        return [_Range(a, min(n, a + ROWS_PER_PART)) for a in range(0, max(n, 1), ROWS_PER_PART)]

    def read(self, partition):
        h = self._header()
        if h.ascii:
            with open(self.path, "rb") as f:
                rows = parse(f.read())[partition.start : partition.stop]
        else:
            with open(self.path, "rb") as f:
                f.seek(h.offset + partition.start * h.dtype.itemsize)
                data = f.read((partition.stop - partition.start) * h.dtype.itemsize)
            rows = np.frombuffer(data[: len(data) // h.dtype.itemsize * h.dtype.itemsize], dtype=h.dtype)
        yield _table(rows, partition.start)


class _Message(WriterCommitMessage):
    def __init__(self, path: str, rows: int, last: int = -1, sums: tuple = (0, 0, 0)):
        self.path, self.rows, self.last, self.sums = path, rows, last, sums


def _kinds(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, {"float": "f4", "double": "f8", "bigint": "i4", "int": "u1" if f.name in ("red", "green", "blue") else "i4"}[f.dataType.simpleString()]) for f in schema.fields if f.name != "ordinal"]


class _PlacedWriter(DataSourceArrowWriter):
    """Rows go where their ``ordinal`` says, into one file that all tasks have open; the commit writes the header and renames. Nothing is copied."""

    def __init__(self, path: str, schema: StructType):
        import uuid

        self.path, self.columns = _local(path), _kinds(schema)
        self.target = f"{self.path}.placed-{uuid.uuid4().hex}"

    def write(self, iterator):
        import os

        rows, last, sums, start = 0, -1, np.zeros(3, dtype=np.uint64), _placed_size(self.columns)
        file = os.open(self.target, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            for batch in iterator:
                at = batch.column(batch.schema.get_field_index("ordinal"))
                if at.null_count:
                    raise ValueError("ordinal is null")
                at = at.to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(at, kind="stable")
                at, data = at[order], _record(batch, self.columns)[order]
                for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    if len(run):
                        self._put(file, data[run[0] : run[-1] + 1].tobytes(), start + int(at[run[0]]) * data.dtype.itemsize)
                rows, wide = rows + len(at), at.astype(np.uint64)
                sums += np.array([wide.sum(), (wide * wide).sum(), (wide * wide * wide).sum()], dtype=np.uint64)
                last = max(last, int(at[-1]) if len(at) else -1)
            os.fsync(file)
        finally:
            os.close(file)
        return _Message(self.target, rows, last, tuple(map(int, sums)))

    @staticmethod
    def _put(file: int, data: bytes, at: int) -> None:
        import os

        while data:
            done = os.pwrite(file, data, at)
            data, at = data[done:], at + done

    def commit(self, messages):
        import os

        messages = [m for m in messages if m]
        n, size = sum(m.rows for m in messages), _placed_size(self.columns)
        want = (n * (n - 1) // 2, n * (n - 1) * (2 * n - 1) // 6, (n * (n - 1) // 2) ** 2)
        found = [sum(m.sums[i] for m in messages) for i in range(3)]  # of ordinals, their squares and cubes modulo 2**64
        if max((m.last for m in messages), default=-1) != n - 1 or any((a - b) % 2**64 for a, b in zip(want, found, strict=True)):
            self.abort(messages)
            raise ValueError("ordinals must run from 0 without gaps")
        file = os.open(self.target, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            self._put(file, _head(self.columns, n, size), 0)
            os.ftruncate(file, size + n * np.dtype([(c, k) for c, k in self.columns]).itemsize)
            os.fsync(file)
        finally:
            os.close(file)
        os.replace(self.target, self.path)

    def abort(self, messages):
        import contextlib
        import os

        with contextlib.suppress(FileNotFoundError):
            os.remove(self.target)


class _Writer(DataSourceArrowWriter):
    """Rows without places: each task writes its part beside the target; the commit joins the parts in partition order and renames."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = _local(path), _kinds(schema)

    def write(self, iterator):
        from pyspark import TaskContext

        rows, part = 0, f"{self.path}.part-{TaskContext.get().partitionId():06d}"
        with open(part, "wb") as f:
            for batch in iterator:
                f.write(_record(batch, self.columns).tobytes())
                rows += batch.num_rows
        return _Message(part, rows)

    def commit(self, messages):
        import os
        import shutil

        messages = sorted((m for m in messages if m), key=lambda m: m.path)
        with open(f"{self.path}.partial", "wb") as out:
            out.write(_head(self.columns, sum(m.rows for m in messages)))
            for m in messages:
                with open(m.path, "rb") as f:
                    shutil.copyfileobj(f, out)
                os.remove(m.path)
        os.replace(f"{self.path}.partial", self.path)

    def abort(self, messages):
        import contextlib
        import os

        for m in messages:
            if m:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(m.path)


class PlySource(DataSource):
    """IO6, IO8: ``spark.read.format("ply").load(path)``; writing needs a folder that all tasks share.

    A table with an ``ordinal`` (0, 1, ... each once) is written in place by its tasks; ``write`` gives it one.
    """

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        with open(_local(self.options["path"]), "rb") as f:
            return Header(f.read(1 << 16)).schema()

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return (_PlacedWriter if "ordinal" in schema.names else _Writer)(self.options["path"], schema)


def write(df: DataFrame, path: str, order: list[str]) -> None:
    """IO8, IO18: one file with the columns that are not in ``order``, its rows sorted by those; tasks write side by side, the driver copies nothing.

    Ties lie in any order. Numbering range-partitions; only counts of partitions meet.
    """
    from stereoloom.operators.sampling import numbered

    register(df.sparkSession)
    placed = numbered(df, order).drop("__n", *order).withColumnRenamed("__i", "ordinal")
    placed.write.format("ply").mode("append").option("path", path).save()


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """IO6 over any store: Spark fetches whole files, NumPy decodes; one row a vertex with its file. Vertices need x, y, z; colours default to 0."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    v = parse(data)
                except (ValueError, KeyError):
                    continue
                for a in range(0, len(v), 1 << 16):
                    rows = v[a : a + (1 << 16)]
                    get = lambda *names, kind, rows=rows: np.ascontiguousarray(next((rows[n] for n in names if n in rows.dtype.names), np.zeros(len(rows)))).astype(kind)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows)), pa.array(np.arange(a, a + len(rows))), *[pa.array(get(c, kind=np.float32)) for c in "xyz"], *[pa.array(get(c, c[0], kind=np.int32)) for c in ("red", "green", "blue")]],
                        names=["path", "ordinal", "x", "y", "z", "red", "green", "blue"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, ordinal bigint, x float, y float, z float, red int, green int, blue int")


def strict_preview(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """IO7: a file of exactly x, y, z, red, green, blue; every ``ceil(count / limit)``-th vertex, without those that are not finite."""
    from stereoloom.functions.numeric import all_finite

    with open(_local(path), "rb") as f:
        h = Header(f.read(1 << 16))
    if h.properties != STRICT or h.ascii:
        raise ValueError(f"expected {STRICT}")
    step = max(1, -(-h.count // limit))
    return spark.read.format("ply").load(path).filter((F.col("ordinal") % step == 0) & all_finite("x", "y", "z"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)


def splat_properties(degree: int = 3) -> list[tuple[str, str]]:
    """IO18: property order of splat files: position, normal, zeroth harmonics, rest, opacity, scales, rotation."""
    rest = 3 * ((degree + 1) ** 2 - 1)
    names = ["x", "y", "z", "nx", "ny", "nz", *[f"f_dc_{i}" for i in range(3)], *[f"f_rest_{i}" for i in range(rest)], "opacity", *[f"scale_{i}" for i in range(3)], *[f"rot_{i}" for i in range(4)]]
    return [(n, "f4") for n in names]


def splat_rows(splats: DataFrame, degree: int = 3) -> DataFrame:
    """IO18: splats (mean, log_scale, quat, opacity, sh0, sh_rest as arrays) as one float column a property, in file order."""
    rest = 3 * ((degree + 1) ** 2 - 1)
    at = lambda a, n, name: [F.col(a)[i].cast("float").alias(f"{name}{i}") for i in range(n)]
    zero = [F.lit(0.0).cast("float").alias(n) for n in ("nx", "ny", "nz")]
    return splats.select("row", *[F.col("mean")[i].cast("float").alias(c) for i, c in enumerate("xyz")], *zero, *at("sh0", 3, "f_dc_"), *at("sh_rest", rest, "f_rest_"), F.col("opacity").cast("float"), *at("log_scale", 3, "scale_"), *at("quat", 4, "rot_"))
