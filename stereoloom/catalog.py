"""All queries of the capture operators, with their SQL oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereoloom.operators import fusion, sampling
from stereoloom.plans import adapters, registry

for _part in ("points", "poses", "frames", "rasters", "streams", "files", "tracks"):
    importlib.import_module(f"stereoloom.plans.queries_{_part}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuse points to voxels, drop isolated ones, keep the best of each coarser cell, sum up by scan."""
    cells = fusion.isolated_removed(fusion.fuse(adapters.points(spark, sf_dir).drop("measured"), 0.1))
    points = cells.select("scan_id", F.col("key").alias("ordinal"), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"), F.col("weight").alias("score"), "samples")
    best = sampling.best_per_cell(points, 0.2)
    return best.groupBy("scan_id").agg(F.count("*").alias("cells"), F.sum("samples").alias("samples"), F.round(F.sum("score"), 6).alias("weight"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
