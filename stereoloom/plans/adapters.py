"""Views of the star-schema and vector tables in the capture schemas, in Spark and as SQL.

They exercise the operators' shapes, not spatial truth. ``CTES`` holds the
same views for the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereoloom.functions import geometry as g


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _e(i: int):
    return F.col("embedding")[i - 1].cast("double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point cloud from vectors: scan by label."""
    return _read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("scan_id"), F.col("vec_id").alias("ordinal"), (F.col("vec_id") % 7).cast("int").alias("frame_id"),
        _e(1).alias("x"), _e(2).alias("y"), _e(3).alias("z"), (F.abs(_e(4)) + 0.01).alias("score"), (F.col("vec_id") % 3 != 0).alias("measured"), (_e(5) > 0.1).alias("far"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from events: scan by user, place and direction from the vector of the event's number modulo that of vectors, a metre on each time round."""
    v = _read(spark, sf_dir, "embeddings")
    n = max(v.count(), 1)  # read from the files' footers
    norm = F.sqrt(_e(5) * _e(5) + _e(6) * _e(6) + _e(7) * _e(7))
    v = v.select("vec_id", *[(_e(i) * 4).alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))], *[(_e(i) / norm).alias(c) for i, c in ((5, "dx"), (6, "dy"), (7, "dz"))], F.slice("embedding", 1, 16).alias("signature"))
    own = _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("scan_id"), F.col("event_id").alias("id"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000000D").alias("timestamp"),
        (F.col("value") / 10).alias("blur"), F.col("event_type").alias("kind"), (F.col("event_id") % n).alias("vec_id"), F.expr(f"event_id div {n}").alias("lap"))
    return own.join(v, "vec_id").withColumn("x", F.col("x") + F.col("lap")).drop("lap")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track observations from order lines: frame by order, track by part."""
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"), F.col("l_partkey").alias("track_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("u"), F.col("l_extendedprice").alias("v"), F.col("l_discount").alias("depth"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses from vectors: rotation by a normalised quaternion, intrinsics from further components."""
    n = F.sqrt(sum((_e(i) * _e(i) for i in range(9, 12)), _e(8) * _e(8)))
    q = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[(_e(i) / n).alias(c) for i, c in ((8, "qw"), (9, "qx"), (10, "qy"), (11, "qz"))], *[_e(i).alias(c) for i, c in ((1, "tx"), (2, "ty"), (3, "tz"), (12, "a"), (13, "b"), (14, "c"))])
    r = g.rotation_of(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz"))
    cells = [*r[0], F.col("tx"), *r[1], F.col("ty"), *r[2], F.col("tz"), 0, 0, 0, 1]
    k = F.struct((F.lit(300.0) + F.col("a") * 100).alias("fx"), (F.lit(310.0) + F.col("b") * 100).alias("fy"), F.lit(120.5).alias("cx"), F.lit(90.25).alias("cy"), F.lit(240).alias("width"), F.lit(180).alias("height"))
    return q.withColumns({"pose": g.matrix(cells), "intrinsics": k})


CTES = {
    "points": """points AS (SELECT CAST(label AS VARCHAR) AS scan_id, vec_id AS ordinal, CAST(vec_id % 7 AS INT) AS frame_id,
 CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, abs(CAST(embedding[4] AS DOUBLE)) + 0.01::DOUBLE AS score,
 vec_id % 3 <> 0 AS measured, CAST(embedding[5] AS DOUBLE) > 0.1::DOUBLE AS far FROM embeddings)""",
    "frames": """vec AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE)*4 AS x, CAST(embedding[2] AS DOUBLE)*4 AS y, CAST(embedding[3] AS DOUBLE)*4 AS z,
 CAST(embedding[5] AS DOUBLE) AS e5, CAST(embedding[6] AS DOUBLE) AS e6, CAST(embedding[7] AS DOUBLE) AS e7, embedding[1:16] AS signature FROM embeddings),
 nv AS (SELECT greatest(count(*), 1) AS n FROM embeddings),
 frames AS (SELECT user_id AS scan_id, event_id AS id, epoch_us(ts)/1000000::DOUBLE AS timestamp, value/10 AS blur, event_type AS kind, x + event_id // (SELECT n FROM nv) AS x, y, z,
 e5/sqrt(e5*e5+e6*e6+e7*e7) AS dx, e6/sqrt(e5*e5+e6*e6+e7*e7) AS dy, e7/sqrt(e5*e5+e6*e6+e7*e7) AS dz, signature FROM events JOIN vec ON event_id % (SELECT n FROM nv) = vec_id)""",
    "observations": "observations AS (SELECT l_orderkey AS frame_id, l_partkey AS track_id, l_linenumber AS line, l_quantity AS u, l_extendedprice AS v, l_discount AS depth FROM lineitem)",
    "poses": """raw AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 unit AS (SELECT id, sqrt(e[8]*e[8]+e[9]*e[9]+e[10]*e[10]+e[11]*e[11]) AS n, e FROM raw),
 q AS (SELECT id, e[8]/n AS qw, e[9]/n AS qx, e[10]/n AS qy, e[11]/n AS qz, e[1] AS tx, e[2] AS ty, e[3] AS tz, e[12] AS a, e[13] AS b, e[14] AS c FROM unit),
 poses AS (SELECT *, 1-2*(qy*qy+qz*qz) AS r00, 2*(qx*qy-qw*qz) AS r01, 2*(qx*qz+qw*qy) AS r02, 2*(qx*qy+qw*qz) AS r10, 1-2*(qx*qx+qz*qz) AS r11, 2*(qy*qz-qw*qx) AS r12,
 2*(qx*qz-qw*qy) AS r20, 2*(qy*qz+qw*qx) AS r21, 1-2*(qx*qx+qy*qy) AS r22, 300+a*100 AS fx, 310+b*100 AS fy, 120.5::DOUBLE AS cx, 90.25::DOUBLE AS cy FROM q)""",
}


def cell_sql(column: str, size: float) -> str:
    return f"CAST(floor(CAST({column} AS FLOAT) / CAST({size} AS FLOAT)) AS BIGINT)"


def key_sql(i: str, j: str, k: str) -> str:
    return f"((({i} + 1048576) << 42) | (({j} + 1048576) << 21) | ({k} + 1048576))"


def voxel_sql(size: float, columns: tuple[str, str, str] = ("x", "y", "z")) -> str:
    return key_sql(*[cell_sql(c, size) for c in columns])


def split_mix_sql(table: str, key: str) -> str:
    """CTEs that end in ``mixed``: the table's rows with h, SplitMix64's output for the key, as unsigned 64 bits."""
    word = 18446744073709551616
    times = lambda x, c: f"CAST((({x})::UHUGEINT * {c}::UHUGEINT) % {word}::UHUGEINT AS UBIGINT)"
    return f"""mx0 AS (SELECT *, CAST(({key}::HUGEINT + CASE WHEN {key} < 0 THEN {word}::HUGEINT ELSE 0 END + {0x9E3779B97F4A7C15}::HUGEINT) % {word}::HUGEINT AS UBIGINT) AS h0 FROM {table}),
 mx1 AS (SELECT *, {times('xor(h0, h0 >> 30)', 0xBF58476D1CE4E5B9)} AS h1 FROM mx0), mx2 AS (SELECT *, {times('xor(h1, h1 >> 27)', 0x94D049BB133111EB)} AS h2 FROM mx1), mixed AS (SELECT *, xor(h2, h2 >> 31) AS h FROM mx2)"""
