"""Distinct, sampling, top-k and ordering operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stereoloom.functions import voxels as vx
from stereoloom.functions.capture import hash_rank
from stereoloom.functions.numeric import hash_uniform
from stereoloom.plans.durable import durable


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark filters while it sorts (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def best_per_cell(points: DataFrame, size: float) -> DataFrame:
    """K1, one round: the best score of each cell, the first on a tie."""
    own = points.withColumn("key", vx.voxel_key("x", "y", "z", size)).filter("key is not null")
    return first_per(own, ["scan_id", "key"], [F.desc("score"), F.asc("ordinal")])


def stratified_best(points: DataFrame, size: float, target: int) -> DataFrame:
    """K1: best point of each cell, with cells growing until at most ``target`` points remain.

    The cell grows by the root of the excess plus two per cent, at least by
    three per cent, and ends when it is larger than all coordinates: then no
    larger one joins more. Each round is written to the shared folder.
    """
    n, reach = points.agg(F.count("*"), F.max(F.greatest(*[F.abs(c) for c in "xyz"]))).first()
    while n > target and size <= (reach or 0.0):
        size *= max(1.03, math.sqrt(n / target) * 1.02)
        points = durable(best_per_cell(points, size).drop("key"))
        n = points.count()
    return points


def first_per_voxel(points: DataFrame, size: float) -> DataFrame:
    """K2: the first point of each voxel within each frame, then over frames."""
    own = points.withColumn("key", vx.voxel_key("x", "y", "z", size)).filter("key is not null")
    in_frame = first_per(own, ["scan_id", "frame_id", "key"], [F.asc("ordinal")])
    return first_per(in_frame, ["scan_id", "key"], [F.asc("frame_id"), F.asc("ordinal")])


def thinned_seeds(points: DataFrame, size: float, limit: int, rounds: int = 8) -> DataFrame:
    """K3: the first point of each cell, cells growing by a fifth a round, then the first ``limit`` by ordinal."""
    n = points.count()
    cell = size * math.sqrt(max(1.0, n / limit))
    out = points
    for _ in range(rounds):
        own = points.withColumn("key", vx.voxel_key("x", "y", "z", cell)).filter("key is not null")
        out = durable(first_per(own, ["scan_id", "key"], [F.asc("ordinal")]).drop("key"))
        if out.count() <= limit:
            return out
        cell *= 1.2
    return out.orderBy("scan_id", "ordinal").limit(limit)


def depth_seeds(candidates: DataFrame, existing: DataFrame, cell: float, limit: int, factor: int = 8, far: float = 4.0) -> DataFrame:
    """K4: seeds in cells that no existing point has: confident samples first, then unsure ones within ``far``.

    Samples of the frames interleave: by rank in their frame, then frame. At
    most ``factor * limit`` candidates enter the thinning.
    """
    stage = F.when(F.col("conf") >= 1, 0).when((F.col("conf") == 0) & (F.col("depth") <= far), 1)
    own = candidates.withColumns({"key": vx.voxel_key("x", "y", "z", cell), "pass": stage}).filter("key is not null and pass is not null")
    taken = existing.select("scan_id", vx.voxel_key("x", "y", "z", cell).alias("key")).distinct()
    turn = F.row_number().over(Window.partitionBy("scan_id", "pass", "frame_id").orderBy("ordinal"))
    free = own.join(taken, ["scan_id", "key"], "left_anti").withColumn("turn", turn)
    order = [F.asc("pass"), F.asc("turn"), F.asc("frame_id"), F.asc("ordinal")]
    picked = first_per(free, ["scan_id", "key"], order).orderBy(*order).limit(factor * limit)
    return thinned_seeds(picked.drop("key", "pass", "turn"), cell, limit)


def numbered(df: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Row number from 0 as ``__i`` and the count as ``__n``, within keys or over the whole table.

    Over the whole table the rows are range-partitioned and only counts of
    partitions meet in one task.
    """
    if keys:
        w = Window.partitionBy(*keys)
        return df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    durable(spark.range(0))  # makes sure a checkpoint folder is set
    placed = sorted_.checkpoint().withColumns({"__p": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    running = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = placed.groupBy("__p").agg(F.count("*").alias("__c")).select("__p", F.coalesce(F.sum("__c").over(running), F.lit(0)).alias("__o"), F.sum("__c").over(whole).alias("__n"))
    return placed.join(F.broadcast(counts), "__p").withColumn("__i", F.col("__o") + F.col("__at")).drop("__p", "__at", "__o")


def stride_sample(df: DataFrame, limit: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """K5: rows at ``i * n div limit`` for i below ``limit``; all rows if there are no more."""
    i, n = F.col("__i"), F.col("__n")
    first = F.ceil(i * limit / n)  # the least index whose place is i or later
    hit = (first < limit) & (F.floor(first * n / limit) == i)
    return numbered(df, order, keys).filter((n <= limit) | hit).drop("__i", "__n")


def thin_proportionally(df: DataFrame, keep: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """K6: row i of n stays if ``(i + 1) * keep div n`` passes ``i * keep div n``."""
    i, n = F.col("__i"), F.col("__n")
    hit = F.expr(f"(__i + 1) * {keep} div __n > __i * {keep} div __n")
    return numbered(df, order, keys).filter((n <= keep) | hit).drop("__i", "__n") if keep else df.limit(0)


def cap_far(points: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """Near rows all stay; far rows are thinned to what is left of ``limit``."""
    near = points.filter("not far")
    room = max(0, limit - near.count())
    return near.unionByName(thin_proportionally(points.filter("far"), room, order))


def interval_hash_sample(df: DataFrame, keep: int, shards: int = 16) -> DataFrame:
    """K7: per shard of the key space, rows in key order fall into intervals; the least hash rank of each stays.

    Ranks compare as unsigned. ``keep`` is shared out by shard size. Rows are
    numbered over the whole table, so shards are not tasks.
    """
    own = df.withColumn("shard", vx.shard_of("key", shards))
    total = df.count()
    if total <= keep:
        return df
    sizes = own.groupBy("shard").agg(F.count("*").alias("__m"))  # a row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0)))
    ranked = numbered(own.withColumn("__h", hash_rank("key").bitwiseXOR(F.lit(-(1 << 63)))), ["shard", "key"]).join(F.broadcast(sizes), "shard")
    mine = F.greatest(F.lit(1), F.floor(F.col("__m") * keep / total))
    slots = ranked.withColumn("__slot", F.floor((F.col("__i") - F.col("__before")) * mine / F.col("__m")))
    return first_per(slots, ["shard", "__slot"], [F.asc("__h"), F.asc("key")]).drop("shard", "__h", "__i", "__n", "__slot", "__m", "__before")


def hash_sample(df: DataFrame, k: int, *key: str) -> DataFrame:
    """K rows by the hash of their key: a uniform, repeatable sample (in place of a sequential reservoir)."""
    return df.orderBy(F.xxhash64(*key), *key).limit(k)


def shuffled(df: DataFrame, seed: int, epoch: int, key: str) -> DataFrame:
    """A repeatable random order per epoch, as column ``place``."""
    return df.withColumn("place", F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key)))


def gumbel_top_k(df: DataFrame, weight: str, k: int, key: str, seed: int = 0) -> DataFrame:
    """Weighted sample without replacement: the k largest ln w - ln(-ln u)."""
    u = hash_uniform(F.lit(seed), F.col(key))
    return df.filter(F.col(weight) > 0).withColumn("gumbel", F.log(weight) - F.log(-F.log(u))).orderBy(F.desc("gumbel"), F.asc(key)).limit(k)


def capped_rejection(frames: DataFrame, share: float = 0.3) -> DataFrame:
    """Of the frames with a verdict (drop or demote) keep it on at most ``share`` of the scan, drop first, then the most severe.

    Needs scan_id, id, verdict (null: fine), severity.
    """
    w = Window.partitionBy("scan_id")
    order = w.orderBy(F.when(F.col("verdict") == "drop", 0).when(F.col("verdict") == "demote", 1).otherwise(2), F.desc("severity"), F.asc("id"))
    ranked = frames.withColumns({"__r": F.row_number().over(order), "__n": F.count("*").over(w)})
    return ranked.withColumn("verdict", F.when(F.col("__r") <= F.floor(F.col("__n") * F.lit(share)), F.coalesce("verdict", F.lit("keep"))).otherwise("keep")).drop("__r", "__n")


def evenly_spaced(frames: DataFrame, k: int, order: list[str], keys: list[str]) -> DataFrame:
    """K rows at the rounded places of an even spacing from the first to the last (half to even)."""
    own = numbered(frames, order, keys)
    n = F.col("__n")
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / max(1, k - 1)).cast("long")))
    return own.filter((n <= k) | F.array_contains(places, F.col("__i").cast("long"))).drop("__i", "__n")


def corner_per_empty_cell(corners: DataFrame, live: DataFrame, width: int, height: int, columns: int = 16, rows: int = 12, least: float = 2e-4, most: int = 192) -> DataFrame:
    """The strongest corner of each grid cell that has no live track."""
    cell = lambda d: (F.least(F.floor(F.col("v") * rows / height), F.lit(rows - 1)) * columns + F.least(F.floor(F.col("u") * columns / width), F.lit(columns - 1))).cast("int")
    own = corners.filter(F.col("response") >= least).withColumn("cell", cell(corners))
    free = own.join(live.withColumn("cell", cell(live)).select("frame_id", "cell").distinct(), ["frame_id", "cell"], "left_anti")
    best = first_per(free, ["frame_id", "cell"], [F.desc("response"), F.asc("v"), F.asc("u")])
    return best.withColumn("__r", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("response"), F.asc("cell")))).filter(F.col("__r") <= most).drop("__r")


def two_stage_pick(targets: DataFrame, radius: float = 18.0, slack: float = 2.0, key: str = "query_id") -> DataFrame:
    """Within ``radius`` of the aim, of those at most ``slack`` beyond the closest the least depth."""
    near = targets.filter(F.col("distance") <= radius)
    close = near.withColumn("__m", F.min("distance").over(Window.partitionBy(key))).filter(F.col("distance") <= F.col("__m") + slack).drop("__m")
    return first_per(close, [key], [F.asc("depth"), F.asc("distance"), F.asc("id")])


def pilot_ordinals(frames: DataFrame, limit: int) -> DataFrame:
    """Interior frames whose index is no multiple of eight, spread to ``limit``."""
    own = numbered(frames, ["id"], ["scan_id"]).filter("__i > 0 and __i < __n - 1 and __i % 8 != 0").drop("__i", "__n")
    return evenly_spaced(own, limit, ["id"], ["scan_id"])


def morton_order(points: DataFrame) -> DataFrame:
    """``morton`` code in the table's bounding box; rows are range-partitioned and sorted by it."""
    box = points.agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))])
    coded = points.join(F.broadcast(box)).withColumn("morton", vx.morton30(F.col("x"), F.col("y"), F.col("z"), tuple(F.col(f"l{a}") for a in "xyz"), tuple(F.col(f"h{a}") for a in "xyz")))
    return coded.drop(*[f"{n}{a}" for a in "xyz" for n in "lh"]).repartitionByRange("morton", "ordinal").sortWithinPartitions("morton", "ordinal")


def exclusive_scan(df: DataFrame, value: str, order: list[str], keys: list[str]) -> DataFrame:
    """Exclusive prefix sum within keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("offset", F.sum(value).over(w) - F.col(value))
