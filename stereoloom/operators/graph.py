"""Components, greedy sets and clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stereoloom.functions import voxels as vx
from stereoloom.plans.durable import durable


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node reachable. Nodes without edges are their own component; without ``nodes`` only those with edges count.

    Least labels spread along edges and then jump to their label's label, so
    rounds grow with the logarithm of a path's length; every round is durable
    and only a changed-flag reaches the driver.
    """
    both = durable(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if nodes is None:
        nodes = both.select(F.col("a").alias("node"))
    labels = durable(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        offer = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        low = labels.join(offer, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "offer").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        moved = durable(low.join(jump, "component", "left").select("node", "old", F.least("component", "far").alias("component")))
        changed = not moved.filter("component <> old").isEmpty()
        labels = moved.select("node", "component")
        if not changed:
            return labels


def cell_components(cells: DataFrame) -> DataFrame:
    """CC2: 26-connected components of occupied cells: ``scan_id, key, component``."""
    own = cells.select("scan_id", "key").distinct()
    node = F.struct("scan_id", "key")
    near = own.select("scan_id", "key", F.explode(vx.neighbour_keys("key", centre=False)).alias("other"))
    edges = near.join(own.select("scan_id", F.col("key").alias("other")), ["scan_id", "other"]).filter("key < other").select(F.struct("scan_id", "key").alias("a"), F.struct("scan_id", F.col("other").alias("key")).alias("b"))
    out = connected_components(edges, own.select(node.alias("node")))
    return out.select("node.scan_id", "node.key", F.col("component.key").alias("component"))


def component_summary(components: DataFrame, large: int = 10) -> DataFrame:
    """CC2: components of a scan, those of ``large`` cells or more, and the largest."""
    sizes = components.groupBy("scan_id", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("scan_id").agg(F.count("*").alias("components"), F.count_if(F.col("n") >= large).alias("large"), F.max("n").alias("largest"))


def run_components(runs: DataFrame, tolerance: int = 2) -> DataFrame:
    """CC1: runs (id, line, first, last) joined where they overlap, give or take ``tolerance``, on the same or the next line.

    An equi-join on the line with the overlap as residual.
    """
    a = runs.select(F.col("id").alias("a"), "first", "last", F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line"))
    b = runs.select(F.col("id").alias("b"), F.col("first").alias("f2"), F.col("last").alias("l2"), "line")
    edges = a.join(b, "line").filter((F.col("a") != F.col("b")) & (F.col("first") <= F.col("l2") + tolerance) & (F.col("f2") <= F.col("last") + tolerance))
    return connected_components(edges.select("a", "b"), runs.select(F.col("id").alias("node")))


def greedy_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: which nodes a scan in order of ``rank`` keeps, when a kept node bars its neighbours: ``id, kept``.

    Rounds settle at once every open node that no open neighbour precedes;
    the result is that of the sequential scan. ``rank`` must be unique.
    edges: a, b in either direction.
    """
    ranks = nodes.select("id", "rank")
    r = lambda n: ranks.select(F.col("id").alias(n), F.col("rank").alias(f"r{n}"))
    directed = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    before = durable(directed.join(r("a"), "a").join(r("b"), "b").filter("ra < rb").select("a", "b"))  # a precedes b
    state = durable(ranks.select("id", F.lit(None).cast("boolean").alias("kept")))
    while True:
        seen = before.join(state.select(F.col("id").alias("a"), F.col("kept").alias("ka")), "a")
        facts = seen.groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("barred"), F.bool_or(F.col("ka").isNull()).alias("waits"))
        verdict = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("barred", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)
        state = durable(state.join(facts, "id", "left").select("id", verdict.alias("kept")))
        if state.filter("kept is null").isEmpty():
            return state


def kmeans(rows: DataFrame, k: int, rounds: int, columns: list[str], key: str = "row") -> tuple[DataFrame, list[tuple]]:
    """Lloyd's algorithm from the first k distinct values in key order; an empty cluster keeps its value.

    The k centres are broadcast as literals (k is a parameter, not data); ties
    go to the lower centre. Returns (rows + cluster, centres).
    """
    first = rows.groupBy(*columns).agg(F.min(key).alias("__k")).orderBy("__k").limit(k).collect()
    centres = [tuple(float(r[c]) for c in columns) for r in first]

    def assigned(centres):
        table = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(c) for c, v in zip(columns, centre, strict=True)]) for i, centre in enumerate(centres)])
        distances = F.transform(table, lambda s: F.struct(sum(((F.col(c) - s[c]) ** 2 for c in columns[1:]), (F.col(columns[0]) - s[columns[0]]) ** 2).alias("d"), s["i"].alias("i")))
        return rows.withColumn("cluster", F.array_min(distances)["i"])

    for _ in range(rounds):
        means = assigned(centres).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns]).collect()
        for m in means:
            centres[m["cluster"]] = tuple(m[c] for c in columns)
    return assigned(centres), centres


def _nearest_centres(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    """Index of each row's nearest centre, the lower of equal ones, by matrix products over blocks of centres."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    own = (x * x).sum(axis=1)
    for k in range(0, len(centres), block):
        some = centres[k : k + block]
        d = own[:, None] - 2 * (x @ some.T) + (some * some).sum(axis=1)
        i = d.argmin(axis=1)
        near = d[np.arange(len(x)), i]
        closer = near < best
        best[closer], at[closer] = near[closer], i[closer] + k
    return at


def palette(rows: DataFrame, column: str, entries: int = 16_384, rounds: int = 3) -> tuple[DataFrame, np.ndarray]:
    """SP6: Lloyd's algorithm over vectors (array<double> ``column``, all of one length): (rows + ``entry``, centres).

    Starts from the ``entries`` distinct vectors of least hash, so it depends
    on no order; an entry without members keeps its value. The centres, whose
    size the parameters fix, are broadcast as one matrix in each round;
    assignment is a matrix product over an Arrow batch, and a task hands on
    one partial sum for each entry it met. Rows without a vector get no entry.
    """
    spark = rows.sparkSession
    vector = F.col(column)
    first = rows.filter(vector.isNotNull()).select(column).distinct().orderBy(F.xxhash64(column), column).limit(entries).collect()
    centres = np.array([r[0] for r in first], dtype=float)
    if not len(centres):
        return rows.withColumn("entry", F.lit(None).cast("int")), centres
    size = centres.shape[1]

    def matrix(batch, i):
        return np.asarray(batch.column(i).flatten(), dtype=float).reshape(batch.num_rows, size)

    def sums(held):
        def run(batches):
            total, count = np.zeros((len(held.value), size)), np.zeros(len(held.value), np.int64)
            for batch in batches:
                x = matrix(batch, 0)
                at = _nearest_centres(x, held.value)
                count += np.bincount(at, minlength=len(count))
                order = np.argsort(at, kind="stable")
                met, starts = np.unique(at[order], return_index=True)
                if len(met):
                    total[met] += np.add.reduceat(x[order], starts, axis=0)
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(count[met], pa.int64()), pa.array(list(total[met]), pa.list_(pa.float64()))], names=["entry", "n", "total"])

        return run

    own = rows.filter(vector.isNotNull()).select(column)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(centres)
        parts = own.mapInArrow(sums(held), "entry long, n long, total array<double>").groupBy("entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total"))
        centres = centres.copy()
        for r in parts.collect():  # at most a row an entry
            centres[r.entry] = np.array(r.total) / r.n
    held = spark.sparkContext.broadcast(centres)

    def labelled(batches):
        for batch in batches:
            given = batch.column(batch.schema.get_field_index(column))
            known = given.is_valid()
            at = np.zeros(batch.num_rows, np.int64)
            x = np.asarray(given.filter(known).flatten(), dtype=float).reshape(-1, size)
            mask = np.asarray(known)
            at[mask] = _nearest_centres(x, held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32(), mask=~mask)], names=[*batch.schema.names, "entry"])

    schema = StructType([*rows.schema.fields, StructField("entry", IntegerType())])
    return rows.mapInArrow(labelled, schema), centres


def codebook(rows: DataFrame, value: str, entries: int = 256, rounds: int = 10, sample_accuracy: int = 10_000) -> list[float]:
    """One-dimensional codebook: quantile start, nearest-entry assignment by the midpoints between entries, means, sorted."""
    entries = min(entries, rows.select(value).distinct().limit(entries).count())
    if not entries:
        return []
    start = rows.agg(F.percentile_approx(value, [(i + 0.5) / entries for i in range(entries)], sample_accuracy)).first()[0]
    book = sorted(set(float(x) for x in start))
    for _ in range(rounds):
        edges = F.array(*[F.lit((a + b) / 2) for a, b in zip(book, book[1:], strict=False)]) if len(book) > 1 else F.array().cast("array<double>")
        place = F.size(F.filter(edges, lambda e: e < F.col(value)))
        for r in rows.groupBy(place.alias("i")).agg(F.avg(value).alias("m")).collect():
            book[r["i"]] = r["m"]
        book.sort()
    return book


def ranked(df: DataFrame, order: list, keys: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
