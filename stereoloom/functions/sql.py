"""SQL names for the scalar functions: temporary SQL functions, which Catalyst inlines, so no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

_CELL = "CAST(floor(CAST(CAST(CAST({x} AS FLOAT) AS DOUBLE) / CAST(CAST(size AS FLOAT) AS DOUBLE) AS FLOAT)) AS BIGINT)"


def _key(x: str, y: str, z: str) -> str:
    i, j, k = (_CELL.format(x=c) for c in (x, y, z))
    inside = " AND ".join(f"{c} BETWEEN -1048576 AND 1048575" for c in (i, j, k))
    return f"CASE WHEN {inside} THEN shiftleft({i} + 1048576, 42) | shiftleft({j} + 1048576, 21) | ({k} + 1048576) END"


def _octahedral() -> str:
    norm = "(abs(x) + abs(y) + abs(z))"
    px, py = f"(x / {norm})", f"(y / {norm})"
    side = lambda v: f"CASE WHEN {v} >= 0 THEN 1D ELSE -1D END"
    u, v = f"CASE WHEN z >= 0 THEN {px} ELSE (1 - abs({py})) * {side(px)} END", f"CASE WHEN z >= 0 THEN {py} ELSE (1 - abs({px})) * {side(py)} END"
    byte = lambda c: f"floor((least(greatest({c}, -1D), 1D) * 0.5D + 0.5D) * 255 + 0.5D)"
    return f"CASE WHEN {norm} > 0 AND {norm} < double('infinity') THEN CAST(greatest({byte(u)} * 256 + {byte(v)}, 1) AS INT) ELSE 0 END"


def _world(p: tuple[str, str, str]) -> str:
    """Camera-axis point to the world by a row-major pose."""
    return "named_struct(" + ", ".join(f"'{n}', " + " + ".join(f"pose[{4 * r + k}] * {c}" for k, c in enumerate(p)) + f" + pose[{4 * r + 3}]" for r, n in enumerate("xyz")) + ")"


_LENS = "fx DOUBLE, fy DOUBLE, cx DOUBLE, cy DOUBLE"
_AXES = [" + ".join(f"pose[{4 * r + k}] * ({c} - pose[{4 * r + 3}])" for r, c in enumerate("xyz")) for k in range(3)]
_SEEN = [f"fx * ({_AXES[0]}) / -({_AXES[2]}) + cx", f"cy - fy * ({_AXES[1]}) / -({_AXES[2]})"]

SCALARS = {
    "voxel_key(x DOUBLE, y DOUBLE, z DOUBLE, size DOUBLE) RETURNS BIGINT": _key("x", "y", "z"),
    "voxel_center(key BIGINT, size DOUBLE) RETURNS STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>":
        "named_struct('x', ((shiftright(key, 42) & 2097151) - 1048576 + 0.5D) * size, 'y', ((shiftright(key, 21) & 2097151) - 1048576 + 0.5D) * size, 'z', ((key & 2097151) - 1048576 + 0.5D) * size)",
    "voxel_shard(key BIGINT) RETURNS INT": "CAST((key ^ shiftright(key, 21) ^ shiftright(key, 42)) & 15 AS INT)",
    "oct_encode(x DOUBLE, y DOUBLE, z DOUBLE) RETURNS INT": _octahedral(),
    f"unproject(u DOUBLE, v DOUBLE, z DOUBLE, {_LENS}, pose ARRAY<DOUBLE>) RETURNS STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>": _world(("((u - cx) / fx * z)", "(-(v - cy) / fy * z)", "(-z)")),
    f"project(x DOUBLE, y DOUBLE, z DOUBLE, {_LENS}, width INT, height INT, pose ARRAY<DOUBLE>) RETURNS STRUCT<u: DOUBLE, v: DOUBLE, z: DOUBLE>":
        f"CASE WHEN -({_AXES[2]}) > 0 THEN CASE WHEN {_SEEN[0]} >= 0 AND {_SEEN[0]} < width AND {_SEEN[1]} >= 0 AND {_SEEN[1]} < height THEN named_struct('u', {_SEEN[0]}, 'v', {_SEEN[1]}, 'z', -({_AXES[2]})) END END",
    "blur_weight(blur DOUBLE) RETURNS DOUBLE": "1 / (1 + blur / 4)",
    "blur_risk(angular DOUBLE, speed DOUBLE, depth DOUBLE, focal DOUBLE, exposure DOUBLE) RETURNS DOUBLE": "(angular + speed / greatest(0.1D, coalesce(depth, 0.5D))) * focal * (exposure + 0.01D)",
    "capture_ev(exposure DOUBLE, iso DOUBLE) RETURNS DOUBLE": "CASE WHEN exposure > 0 AND iso > 0 THEN log2(exposure * iso) END",
    "metric_scale(z DOUBLE) RETURNS DOUBLE": "CASE WHEN z IS NULL OR isnan(z) THEN 1D ELSE least(greatest(z / 1.2D, 0.125D), 1D) END",
    "log_transform(v DOUBLE) RETURNS DOUBLE": "signum(v) * log1p(abs(v))",
    "sigmoid(v DOUBLE) RETURNS DOUBLE": "1 / (1 + exp(-v))",
}
TABLES = {
    "neighbors26(key BIGINT) RETURNS TABLE(neighbor BIGINT)": """
        SELECT key + shiftleft(a, 42) + shiftleft(b, 21) + c FROM (SELECT explode(sequence(-1L, 1L)) AS a) LATERAL VIEW explode(sequence(-1L, 1L)) t AS b LATERAL VIEW explode(sequence(-1L, 1L)) u AS c
        WHERE NOT (a = 0 AND b = 0 AND c = 0) AND (shiftright(key, 42) & 2097151) + a BETWEEN 0 AND 2097151 AND (shiftright(key, 21) & 2097151) + b BETWEEN 0 AND 2097151 AND (key & 2097151) + c BETWEEN 0 AND 2097151""",
}


def register_udfs(spark: SparkSession) -> list[str]:
    """Create all of them in the session; returns their names."""
    for head, body in (SCALARS | TABLES).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in SCALARS | TABLES]
