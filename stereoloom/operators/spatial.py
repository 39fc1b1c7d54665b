"""Spatial, temporal and similarity joins as equi-joins on grid cells with a residual filter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stereoloom.functions import geometry as g
from stereoloom.functions import voxels as vx
from stereoloom.functions.numeric import clamp
from stereoloom.operators.sampling import first_per


def _d2(a: str, b: str) -> Column:
    dx, dy, dz = (F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in "xyz")
    return dx * dx + dy * dy + dz * dz


def _d(radius: float) -> float:
    return radius * (1 + 1e-6)  # float32 cell edges never hide a pair at the rim


#: Scans of at most so many points meet as a whole; ``nearest`` has them asked by at most 16 times as many.
FEW = 512


def near_pairs(points: DataFrame, radius: float, carry: tuple[str, ...] = (), on: str = "scan_id", id_column: str = "id") -> DataFrame:
    """Pairs of two points of one table within ``radius``, each once with a < b: ``scan_id, a, b, d`` and the columns of ``carry`` as a_..., b_....

    The points of a scan of few meet one another, a row a point. In others a
    point meets its own cell and the half of the 26 around it that follow, so
    a pair is found once; what is known of its ends goes through the one join
    with it.
    """
    own = points.select(F.col(on), F.struct(F.col(id_column).alias("id"), *dict.fromkeys(("x", "y", "z", *carry))).alias("p"), vx.voxel_key("x", "y", "z", _d(radius)).alias("own")).filter(F.col(on).isNotNull() & F.col("own").isNotNull())
    sizes = own.groupBy(on).agg((F.count("*") <= FEW).alias("few"))
    kinds = {r["few"] for r in sizes.select("few").distinct().collect()}
    of = lambda few: own if len(kinds) < 2 else own.join(sizes.filter("few" if few else "not few").hint("merge"), on, "left_semi")
    met = []
    if kinds != {False}:
        side = lambda n: of(True).select(on, F.col("p").alias(n))
        met.append(side("left").join(side("right").hint("merge"), on).filter("left.id < right.id"))
    if False in kinds:
        here = of(False).select(on, F.col("p").alias("left"), F.col("own").alias("key"))
        there = of(False).select(on, F.col("p").alias("right"), "own", F.explode(F.filter(vx.neighbour_keys("own"), lambda k: k >= F.col("own"))).alias("key"))
        half = here.join(there, [on, "key"]).filter((F.col("key") != F.col("own")) | (F.col("left.id") < F.col("right.id"))).filter("left.id <> right.id")
        met.append(half.select(on, "left", "right"))
    first = F.col("left.id") < F.col("right.id")
    a, b = F.when(first, F.col("left")).otherwise(F.col("right")), F.when(first, F.col("right")).otherwise(F.col("left"))
    d2 = sum(((F.col(f"left.{c}") - F.col(f"right.{c}")) ** 2 for c in "yz"), (F.col("left.x") - F.col("right.x")) ** 2)
    near = [m.withColumn("d2", d2).filter(F.col("d2") <= radius * radius).select(on, a.alias("a"), b.alias("b"), F.sqrt("d2").alias("d")) for m in met]
    close = near[0] if len(near) == 1 else near[0].unionByName(near[1])
    return close.select(on, F.col("a.id").alias("a"), F.col("b.id").alias("b"), "d", *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "ab" for c in carry])


def radius_join(left: DataFrame, right: DataFrame, radius: float, on: str = "scan_id", left_id: str = "ordinal", right_id: str = "ordinal") -> DataFrame:
    """Pairs of points of one scan within ``radius``: ``scan_id, a, b, d``.

    The right side goes into its cell and the 26 around it, the left side
    stays in its own: one equi-join whose cost follows the density, never a
    product of the tables.
    """
    cell = _d(radius)
    a = left.select(F.col(on), F.col(left_id).alias("id"), "x", "y", "z", vx.voxel_key("x", "y", "z", cell).alias("key")).filter("key is not null").alias("a")
    b = right.select(F.col(on), F.col(right_id).alias("id"), "x", "y", "z", F.explode(vx.neighbour_keys(vx.voxel_key("x", "y", "z", cell))).alias("key")).alias("b")
    pairs = a.join(b, (F.col(f"a.{on}") == F.col(f"b.{on}")) & (F.col("a.key") == F.col("b.key")))
    return pairs.withColumn("d2", _d2("a", "b")).filter(F.col("d2") <= radius * radius).select(F.col(f"a.{on}").alias(on), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.sqrt("d2").alias("d"))


#: Levels of the tree of cells of ``nearest``: cells of level n are 2**n of the finest, which are 256 to a radius. At the last level a scan is eight cells.
LEVELS = [*range(15), 16, 20, 24, 30, 36, 44, 62]
FINER = 8
_FAR = 1 << 61


def _fine_cell(radius: float, of: str = "") -> list[Column]:
    """Indices ix, iy, iz of the finest cell. Cells of no level but the last have an edge near zero, where scans start."""
    edge = _d(radius) / 2**FINER
    return [F.least(F.greatest(F.floor(F.col(of + c).cast("double") / edge).cast("long") + (1 << 60) // 3, F.lit(-_FAR)), F.lit(_FAR - 1)).alias(f"i{c}") for c in "xyz"]


_FINE = ["ix", "iy", "iz"]
_CELL = ["scan_id", "level", "jx", "jy", "jz"]


def _above(level: Column, *moves: Column) -> Column:
    """The cell of a level that holds a fine cell, or one some cells from it."""
    moves = moves or (F.lit(0),) * 3
    return F.struct(level.alias("level"), *[(F.call_function("shiftright", F.col(i), level) + m).cast("long").alias(f"j{i[1]}") for i, m in zip(_FINE, moves, strict=True)])


#: Points in one array of a cell, and rows of the cells around askers in one task.
CHUNK, ROWS = 512, 1 << 20


def _closest(near: str, k: int, limit: Column, skip: bool) -> Column:
    """Up to k structs (d, ordinal) of the points in an array, nearest first, within ``limit`` of ax, ay, az; with ``skip`` without a itself."""
    apart = lambda p, c: (F.col(f"a{c}") - p[c]) * (F.col(f"a{c}") - p[c])
    every = F.transform(near, lambda p: F.struct(F.sqrt(apart(p, "x") + apart(p, "y") + apart(p, "z")).alias("d"), p["ordinal"].alias("ordinal")))
    some = F.filter(every, lambda p: (p["d"] <= limit) & (p["ordinal"] != F.col("a")) if skip else p["d"] <= limit)
    return F.filter(F.array(F.array_min(some)), lambda p: p.isNotNull()) if k == 1 else F.slice(F.array_sort(some), 1, k)


def _ranked_rows(found: DataFrame, *more: Column) -> DataFrame:
    """A row for each struct of ``near``: ``scan_id, a, b, d, rank`` and more."""
    rows = found.select("scan_id", "a", *more, F.posexplode("near").alias("place", "it"))
    return rows.select("scan_id", "a", F.col("it.ordinal").alias("b"), F.col("it.d").alias("d"), (F.col("place") + 1).alias("rank"), *[c for c in rows.columns if c not in ("scan_id", "a", "place", "it")])


def nearest(left: DataFrame, right: DataFrame, k: int, radius: float, rings: int | None = None, same_table: bool = False, left_id: str = "ordinal") -> DataFrame:
    """The k nearest points of ``right`` for each of ``left``: ``scan_id, a, b, d, rank``.

    A scan of few points is one array, which its askers look through. In
    others each point searches at its own scale (``_by_scale``). Either way
    no pair leaves its task but the k best. With ``rings`` nothing beyond
    ``radius * 2 ** (rings - 1)`` is looked for; otherwise ``radius`` does
    not matter to the result. Points that are not finite have no neighbours
    and are none.
    """
    from stereoloom.functions.numeric import all_finite
    from stereoloom.plans.durable import durable

    reach = math.inf if rings is None else radius * 2 ** (rings - 1)
    finite = right.filter(all_finite("x", "y", "z") & F.col("scan_id").isNotNull()).select("scan_id", "ordinal", "x", "y", "z")
    asking = left.filter(all_finite("x", "y", "z") & F.col("scan_id").isNotNull()).select("scan_id", F.col(left_id).alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    sizes = finite.groupBy("scan_id").agg(F.count("*").alias("n"))
    asked = sizes.withColumnRenamed("n", "m") if same_table else asking.groupBy("scan_id").agg(F.count("*").alias("m"))
    sizes = durable(sizes.join(asked, "scan_id").select("scan_id", ((F.col("n") <= FEW) & (F.col("m") <= 16 * FEW)).alias("few")))
    kinds = {r["few"] for r in sizes.select("few").distinct().collect()}
    of = lambda df, few: df if len(kinds) < 2 else df.join(sizes.filter("few" if few else "not few").hint("merge"), "scan_id", "left_semi")
    parts = []
    if kinds != {False}:
        block = of(finite, True).groupBy("scan_id").agg(F.collect_list(F.struct("ordinal", "x", "y", "z")).alias("points"))
        parts.append(_ranked_rows(of(asking, True).join(block, "scan_id").select("scan_id", "a", _closest("points", k, F.lit(reach), same_table).alias("near"))))
    if False in kinds:
        parts.append(_by_scale(of(asking, False), of(finite, False), k, radius, reach, same_table))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _by_scale(asking: DataFrame, finite: DataFrame, k: int, radius: float, reach: float, same_table: bool) -> DataFrame:
    """``nearest`` of finite points, each at its own scale: the finest level of a tree of cells at which its cell holds as many points as it needs.

    What it needs lies within the diagonal of that cell, so those that a
    radius of one cell does not serve are served by twice that; there is no
    third search. ``radius`` sets the scale of the levels. Of points at the
    very same place the first k + 1 are enough for everyone.
    """
    from stereoloom.plans.durable import durable

    steps = [n for n in LEVELS if n <= FINER or radius * 2.0 ** (n - FINER) < reach]
    steps += LEVELS[len(steps) : len(steps) + 1]  # the first that goes as far as reach
    top = steps[-1]
    place = Window.partitionBy("scan_id", "x", "y", "z").orderBy("ordinal")
    finite = finite.select("*", *_fine_cell(radius))
    cells = durable(finite.groupBy("scan_id", *_FINE).agg(F.count("*").alias("n")))
    held = cells.groupBy("scan_id").agg((F.sum("n") - int(same_table)).alias("n")).filter("n > 0").select("scan_id", F.least("n", F.lit(k)).alias("need"))
    points = durable(finite.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1).drop("place"))

    def at_levels(fine: DataFrame, *carry: str) -> DataFrame:
        every = F.transform(F.array(*map(F.lit, steps)), lambda n: _above(n))
        return fine.select("scan_id", *carry, F.explode(every).alias("at")).select("scan_id", *carry, "at.*")

    asking = asking.select("scan_id", "a", "ax", "ay", "az", *_fine_cell(radius, "a"))
    within = F.greatest(*[F.abs(F.col(i)) for i in _FINE]) < _FAR - 1
    counts = at_levels(cells.filter(within), "n").groupBy(_CELL).agg(F.sum("n").alias("n"))
    enough = counts.join(held, "scan_id").filter(F.col("n") >= F.col("need") + int(same_table)).select(_CELL)
    scale = at_levels(asking.filter(within).select("scan_id", *_FINE).distinct(), *_FINE).join(enough, _CELL).groupBy("scan_id", *_FINE).agg(F.min("level").alias("level"))
    todo = durable(asking.join(held, "scan_id").join(scale, ["scan_id", *_FINE], "left").withColumn("level", F.coalesce("level", F.lit(top))))
    around = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xyz", (x, y, z), strict=True)]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    # The rows of a cell's surroundings are alike and so few bytes when compressed: the number of tasks is given, by rows.
    tasks = max(int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-27 * todo.count() // ROWS))
    within_level = F.when(F.col("level") == LEVELS[-1], F.lit(math.inf)).otherwise(F.lit(radius / 2**FINER) * F.pow(F.lit(2.0), F.col("level")))

    def search(rows: DataFrame) -> DataFrame:
        met = rows.select("scan_id", "a", "ax", "ay", "az", "need", F.explode(F.transform(around, lambda m: _above(F.col("level"), m["x"], m["y"], m["z"]))).alias("at")).select("scan_id", "a", "ax", "ay", "az", "need", "at.*")
        there = at_levels(cells, *_FINE).join(met.select(_CELL).distinct(), _CELL, "left_semi")
        placed = points.join(there, ["scan_id", *_FINE]).withColumn("part", F.floor(F.row_number().over(Window.partitionBy(*_CELL).orderBy("ordinal")) / CHUNK))
        block = placed.groupBy(*_CELL, "part").agg(F.collect_list(F.struct("ordinal", "x", "y", "z")).alias("points"))
        some = met.repartition(tasks, *_CELL).join(block.repartition(tasks, *_CELL).hint("merge"), _CELL)
        some = some.select("scan_id", "a", "level", "need", _closest("points", k, F.least(within_level, F.lit(reach)), same_table).alias("near")).filter(F.size("near") > 0)
        best = some.repartition(tasks, "scan_id", "a").groupBy("scan_id", "a", "level", "need").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
        return _ranked_rows(best, (F.col("level") == top).alias("last"), (F.size("near") >= F.col("need")).alias("full"))

    first = durable(search(todo).filter("full or last").drop("full", "last"))
    rest = todo.filter(F.col("level") < top).join(first.filter("rank = 1"), ["scan_id", "a"], "left_anti")
    coarser = F.element_at(F.create_map(*[F.lit(v) for pair in zip(steps, steps[1:], strict=False) for v in pair]), F.col("level"))
    return first.unionByName(search(rest.withColumn("level", coarser)).drop("full", "last"))


def neighbour_frames(frames: DataFrame, distance: float = 0.5, degrees: float = 30.0, carry: tuple[str, ...] = (), ordered: bool = True) -> DataFrame:
    """Ordered pairs of other frames of the scan, near in place and viewing direction.

    frames: scan_id, id (unique in a scan), x, y, z, dx, dy, dz (unit
    direction). Gives ``scan_id, a, b, d, cos`` and the ``carry`` columns of
    both as a_..., b_...; each pair in both orders, or without ``ordered`` once with
    a < b. The pairs are never joined to the frames again.
    """
    pairs = near_pairs(frames, distance, ("dx", "dy", "dz", *carry))
    cos = F.col("a_dx") * F.col("b_dx") + F.col("a_dy") * F.col("b_dy") + F.col("a_dz") * F.col("b_dz")
    pairs = pairs.withColumn("cos", cos).filter(F.col("cos") >= math.cos(math.radians(degrees)))
    ends = lambda a, b: [F.col(a).alias("a"), F.col(b).alias("b"), "d", "cos", *[F.col(f"{x}_{c}").alias(f"{y}_{c}") for x, y in ((a, "a"), (b, "b")) for c in carry]]
    if not ordered:
        return pairs.select("scan_id", *ends("a", "b"))
    return pairs.select("scan_id", F.explode(F.array(F.struct(*ends("a", "b")), F.struct(*ends("b", "a")))).alias("pair")).select("scan_id", "pair.*")


def signature_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equal-length arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def near_duplicate_views(frames: DataFrame, distance: float = 0.04, degrees: float = 3.0, difference: float = 0.06) -> DataFrame:
    """Neighbouring frames (a < b) whose signatures hardly differ."""
    pairs = neighbour_frames(frames, distance, degrees, ("signature",), ordered=False)
    return pairs.withColumn("difference", signature_distance(F.col("a_signature"), F.col("b_signature"))).filter(F.col("difference") < difference).select("scan_id", "a", "b", "d", "difference")


def time_pairs(frames: DataFrame, least: float, most: float) -> DataFrame:
    """Pairs (a before b) whose times differ by more than ``least`` and at most ``most``, by time buckets: an equi-join."""
    own = frames.withColumn("__b", F.floor(F.col("timestamp") / most).cast("long"))
    a = own.select("scan_id", F.col("id").alias("a"), F.col("timestamp").alias("ta"), F.explode(F.array(F.col("__b"), F.col("__b") + 1)).alias("__b"))
    b = own.select("scan_id", F.col("id").alias("b"), F.col("timestamp").alias("tb"), "__b")
    dt = F.col("tb") - F.col("ta")
    return a.join(b, ["scan_id", "__b"]).filter((dt > least) & (dt <= most)).select("scan_id", "a", "b", dt.alias("dt"))


def revisit_candidates(frames: DataFrame, distance: float = 0.8, cos: float = 0.9, gap: int = 30, seconds: float = 8.0, travel: float = 2.0) -> DataFrame:
    """For each frame the nearest earlier frame that it returns to.

    Index gap above ``gap``, at least ``seconds`` and ``travel`` metres of
    path between them, near in place and direction.
    """
    from stereoloom.operators.sequence import cumulative_travel

    w = Window.partitionBy("scan_id").orderBy("id")
    own = cumulative_travel(frames).withColumn("i", F.row_number().over(w))
    degrees = math.degrees(math.acos(cos))
    pairs = neighbour_frames(own, distance, degrees, ("i", "timestamp", "travel"), ordered=False)  # the earlier frame has the smaller id
    between = lambda c: F.col(f"b_{c}") - F.col(f"a_{c}")
    found = pairs.filter((between("i") > gap) & (between("timestamp") >= seconds) & (between("travel") >= travel) & (F.col("d") < distance))
    return first_per(found, ["scan_id", "b"], [F.asc("d"), F.asc("a")]).select("scan_id", "a", "b", "d", "cos")


def pair_selection(frames: DataFrame, most: int = 40) -> DataFrame:
    """Adjacent pairs (under a second, over 5 mm apart) and wide pairs (1.5 s or more, 25 to 80 cm, alike in direction; the one nearest 45 cm).

    Unordered pairs occur once; ``kind`` says which. Wide pairs are thinned to ``most`` a scan.
    """
    from stereoloom.operators.sampling import stride_sample

    w = Window.partitionBy("scan_id").orderBy("timestamp", "id")
    nxt = lambda n: F.lead(n).over(w)
    step = F.sqrt(sum(((nxt(c) - F.col(c)) ** 2 for c in "yz"), (nxt("x") - F.col("x")) ** 2))
    adjacent = frames.select("scan_id", F.col("id").alias("a"), nxt("id").alias("b"), (nxt("timestamp") - F.col("timestamp")).alias("dt"), step.alias("d")).filter("b is not null and dt > 0 and dt < 1 and d > 0.005")
    pairs = neighbour_frames(frames, 0.8, math.degrees(math.acos(0.8)))
    times = lambda n: frames.select("scan_id", F.col("id").alias(n), F.col("timestamp").alias(f"{n}_t"))
    dt = F.abs(F.col("b_t") - F.col("a_t"))
    wide = pairs.join(times("a"), ["scan_id", "a"]).join(times("b"), ["scan_id", "b"]).withColumn("dt", dt).filter("dt >= 1.5 and d >= 0.25 and cos > 0.8")
    best = first_per(wide, ["scan_id", "a"], [F.asc(F.abs(F.col("d") - 0.45)), F.asc("b")])
    once = best.select("scan_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dt", "d").dropDuplicates(["scan_id", "a", "b"])
    kept = stride_sample(once, most, ["a", "b"], ["scan_id"])
    both = lambda df, kind: df.select("scan_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dt", "d", F.lit(kind).alias("kind"))
    return both(adjacent, "adjacent").unionByName(both(kept, "wide"))


def source_view_scores(frames: DataFrame, samples: DataFrame, cos: float = 0.707, baseline: float = 0.04, reach: float = 1.0) -> DataFrame:
    """Candidate source views with the sum over the reference's sample points of a triangulation-angle weight.

    The weight rises to 10 degrees and falls beyond. samples: scan_id, id,
    px, py, pz (points seen by the frame). Candidates lie within ``reach``.
    """
    pairs = neighbour_frames(frames, reach, math.degrees(math.acos(cos)), ("x", "y", "z")).filter(F.col("d") >= baseline)
    rays = pairs.join(samples.withColumnRenamed("id", "a"), ["scan_id", "a"])
    va = [F.col(f"p{c}") - F.col(f"a_{c}") for c in "xyz"]
    vb = [F.col(f"p{c}") - F.col(f"b_{c}") for c in "xyz"]
    angle = F.degrees(F.acos(clamp(g.dot(va, vb) / F.sqrt(g.dot(va, va) * g.dot(vb, vb)), -1.0, 1.0)))
    weight = F.when(angle <= 10, angle / 10).otherwise(F.greatest(F.lit(0.0), 1 - (angle - 10) / 30))
    return rays.groupBy("scan_id", "a", "b").agg(F.sum(weight).alias("score"), F.first("d").alias("d"))


#: Values of one block of correlations in ``_best_matches``.
BLOCK = 1 << 20


def _best_matches(left: DataFrame, right: DataFrame, on: str, place: tuple[str, ...], radius: float, mutual: bool = True) -> DataFrame:
    """The best partner of each left point within ``radius``, if ``mutual`` only where it is also best for its partner: ``on, a, b, d, ncc, second``.

    Both sides: ``on``, id, the coordinates of ``place``, patch. A left point
    meets its cell and those around it in one group, so its best two are known
    there; what is best for a right point comes from a few groups, as one row
    of each. Groups are taken block by block, and no pair leaves its task.
    Equal correlations go to the smaller id.
    """
    import itertools

    import numpy as np
    import pandas as pd

    cells = [f"c{i}" for i in range(len(place))]
    cell = lambda c: F.floor(F.col(c) / _d(radius)).cast("long")
    sound = F.col(on).isNotNull() & F.forall("patch", lambda x: x.isNotNull())
    for c in place:
        sound &= F.abs(F.col(c).cast("double")) < float("inf")  # not so if it is no number
    own = lambda df: df.filter(sound).select(on, F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in place], F.col("patch").cast("array<double>").alias("patch"), *[cell(c).alias(n) for c, n in zip(place, cells, strict=True)])
    around = F.array(*[F.array(*map(F.lit, m)) for m in itertools.product((-1, 0, 1), repeat=len(place))])
    spread = own(right).withColumn("m", F.explode(around)).select(on, "id", *place, "patch", *[(F.col(c) + F.col("m")[i]).alias(c) for i, c in enumerate(cells)])

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["a", "b", "d", "ncc", "second", "side"]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[on, *names])
        a, b = a.sort_values("id", ignore_index=True), b.sort_values("id", ignore_index=True)
        ai, bi, at, bt = a["id"].to_numpy(), b["id"].to_numpy(), a[list(place)].to_numpy(), b[list(place)].to_numpy()
        out, top = [], [np.full(len(b), -np.inf), np.zeros(len(b), np.int64)]
        sizes = [x.patch.map(len).to_numpy() for x in (a, b)]
        for size in np.intersect1d(*sizes):
            ra, rb = (np.flatnonzero(s == size) for s in sizes)
            pa, pb = np.stack(a.patch.to_numpy()[ra]), np.ascontiguousarray(np.stack(b.patch.to_numpy()[rb]).T)
            for start in range(0, len(ra), max(1, BLOCK // len(rb))):
                rows = ra[start : start + max(1, BLOCK // len(rb))]
                d2 = sum((at[rows, c][:, None] - bt[rb, c][None, :]) ** 2 for c in range(len(place)))
                ncc = np.zeros(d2.shape)
                for k in range(size):  # one after another, as a fold does, so that equal patches correlate equally
                    ncc += pa[start : start + len(rows), k][:, None] * pb[k][None, :]
                near = d2 <= radius * radius
                ncc = np.where(near & ~np.isnan(ncc), ncc, -np.inf)
                every = np.arange(len(rows))
                best = ncc.argmax(axis=1)
                score = ncc[every, best]
                column = ncc.argmax(axis=0)
                peak = ncc[column, np.arange(len(rb))]
                better = peak > top[0][rb]
                top[0][rb[better]], top[1][rb[better]] = peak[better], ai[rows[column[better]]]
                ncc[every, best] = -np.inf
                second = ncc.max(axis=1)
                hit = score > -np.inf
                out.append(pd.DataFrame({"a": ai[rows[hit]], "b": bi[rb[best[hit]]], "d": np.sqrt(d2[every, best][hit]), "ncc": score[hit], "second": np.where(second > -np.inf, second, -1.0)[hit], "side": 0}))
        seen = top[0] > -np.inf
        out.append(pd.DataFrame({"a": top[1][seen], "b": bi[seen], "d": 0.0, "ncc": top[0][seen], "second": 0.0, "side": 1}))
        out = pd.concat([o for o in out if len(o)] or out[-1:], ignore_index=True)
        out.insert(0, on, key[0])
        return out

    kind = left.schema[on].dataType.simpleString()
    keys = [on, *cells]
    tops = own(left).groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(run, f"{on} {kind}, a long, b long, d double, ncc double, second double, side int")
    if not mutual:
        return tops.filter("side = 0").select(on, "a", "b", "d", "ncc", "second")
    theirs = F.max(F.when(F.col("side") == 1, F.struct("ncc", (-F.col("a")).alias("least")))).over(Window.partitionBy(on, "b"))
    return tops.withColumn("theirs", theirs).filter((F.col("side") == 0) & (F.col("theirs.least") == -F.col("a"))).select(on, "a", "b", "d", "ncc", "second")


def feature_match(features: DataFrame, predictions: DataFrame, radius: float = 28.0, least: float = 0.70, ratio: float = 0.9, reciprocal: bool = True) -> DataFrame:
    """Predicted image positions to features of the frame, by descriptor correlation.

    Both sides have frame_id, id, u, v, patch (array of centred, normalised
    values). Best correlation of at least ``least``, the second at most
    ``ratio`` of it; with ``reciprocal`` also best for the feature.
    """
    best = _best_matches(predictions, features, "frame_id", ("u", "v"), radius, reciprocal)
    return best.filter((F.col("ncc") >= least) & (F.col("second") <= ratio * F.col("ncc"))).select("frame_id", F.col("a").alias("p"), F.col("b").alias("f"), "ncc")


def reciprocal_match(a: DataFrame, b: DataFrame, radius: float = 0.30, least: float = 0.8, ratio: float = 0.9, most: int = 256) -> DataFrame:
    """Mutually best points within ``radius`` by patch correlation, at most ``most`` a scan (the strongest).

    Both sides: scan_id, ordinal, x, y, z, patch. The ratio test compares the
    first and second best of the left point.
    """
    side = lambda df: df.select("scan_id", F.col("ordinal").alias("id"), "x", "y", "z", "patch")
    best = _best_matches(side(a), side(b), "scan_id", ("x", "y", "z"), radius)
    good = best.filter((F.col("ncc") >= least) & (F.col("second") < ratio * F.col("ncc")))
    top = Window.partitionBy("scan_id").orderBy(F.desc("ncc"), "a")
    return good.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= most).select("scan_id", "a", "b", "d", "ncc")


def supplement(sparse: DataFrame, dense: DataFrame, size: float) -> DataFrame:
    """The dense points and those sparse ones with no dense point in their voxel or the 26 around it."""
    taken = dense.select("scan_id", F.explode(vx.neighbour_keys(vx.voxel_key("x", "y", "z", size))).alias("key")).distinct()
    lone = sparse.withColumn("key", vx.voxel_key("x", "y", "z", size)).join(taken, ["scan_id", "key"], "left_anti").drop("key")
    return dense.unionByName(lone.select(*dense.columns))


def far_excluded(cells: DataFrame, radius: float = 0.15) -> DataFrame:
    """Cells (scan_id, ordinal, x, y, z, far, measured) without the far ones within ``radius`` of a measured near one."""
    near = cells.filter("not far and measured")
    hit = radius_join(cells.filter("far"), near, radius).select("scan_id", F.col("a").alias("ordinal")).distinct().withColumn("far", F.lit(True))
    return cells.join(hit, ["scan_id", "ordinal", "far"], "left_anti")


def playback(images: DataFrame, frames: DataFrame) -> DataFrame:
    """Every image with the frame of its file name, if there is one."""
    return images.join(frames.withColumnRenamed("imageFile", "name"), "name", "left")


def corrected_records(raw: DataFrame, corrected: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """IO3: records by key, the corrected one if there is one, which ``corrected`` says."""
    c = corrected.select(key, *[F.col(x).alias(f"c_{x}") for x in columns], F.lit(True).alias("__c"))
    both = raw.join(c, key, "full")
    return both.select(key, *[F.when(F.col("__c"), F.col(f"c_{x}")).otherwise(F.col(x)).alias(x) for x in columns], F.coalesce("__c", F.lit(False)).alias("corrected"))


def merged_records(raw: DataFrame, corrected: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """IO3: records by key, the corrected one if there is one; ``incomplete`` says that corrections exist but not for all."""
    merged = corrected_records(raw, corrected, columns, key)
    state = merged.agg((F.max("corrected") & F.max(~F.col("corrected"))).alias("incomplete"))
    return merged.join(F.broadcast(state))  # one row


def tile_pairs(splats: DataFrame, width: int, height: int, tile: int = 16) -> DataFrame:
    """A row for each tile that the box of a splat's ellipse (u, v, rx, ry) touches, clipped to the image."""
    span = lambda c, r, n: F.sequence(F.greatest(F.floor((F.col(c) - F.col(r)) / tile), F.lit(0)), F.least(F.floor((F.col(c) + F.col(r)) / tile), F.lit((n - 1) // tile)))
    seen = splats.filter((F.col("u") + F.col("rx") >= 0) & (F.col("u") - F.col("rx") < width) & (F.col("v") + F.col("ry") >= 0) & (F.col("v") - F.col("ry") < height))
    out = seen.withColumn("tx", F.explode(span("u", "rx", width))).withColumn("ty", F.explode(span("v", "ry", height)))
    return out.withColumn("tile", F.col("ty") * ((width + tile - 1) // tile) + F.col("tx"))


def tile_ranges(pairs: DataFrame) -> DataFrame:
    """First and last place of each tile in the order of (tile, depth, row): tile counts are summed, rows are not numbered."""
    counts = pairs.groupBy("tile").agg(F.count("*").alias("n"))
    w = Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)  # a row a tile of one image
    return counts.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0))).select("tile", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def covered_by(far: DataFrame, near: DataFrame, radius: float = 0.15, closest: float = 0.035, alike: float = 0.94) -> DataFrame:
    """Far points that a near patch covers, as (scan_id, ordinal).

    Both sides have x, y, z and a unit normal nx, ny, nz. Covered: near
    samples of like normal in all four quadrants of the tangent plane, the
    closest within ``closest`` of the plane's point.
    """
    pairs = radius_join(far, near, radius)
    side = lambda df, n: df.select("scan_id", F.col("ordinal").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    j = pairs.join(side(far, "a"), ["scan_id", "a"]).join(side(near, "b"), ["scan_id", "b"])
    n = [F.col(f"a_n{c}") for c in "xyz"]
    m = [F.col(f"b_n{c}") for c in "xyz"]
    delta = [F.col(f"b_{c}") - F.col(f"a_{c}") for c in "xyz"]
    flat = F.abs(n[0]) < 0.9  # an axis that is not along the normal
    helper = [F.when(flat, 1.0).otherwise(0.0), F.when(flat, 0.0).otherwise(1.0), F.lit(0.0)]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    t = cross(n, helper)
    b = cross(n, t)
    quadrant = F.when(g.dot(delta, t) >= 0, 1).otherwise(0) + F.when(g.dot(delta, b) >= 0, 2).otherwise(0)
    agg = j.filter(g.dot(n, m) >= alike).withColumn("q", quadrant).groupBy("scan_id", "a").agg(F.count_distinct("q").alias("quadrants"), F.min("d").alias("d"))
    return agg.filter((F.col("quadrants") == 4) & (F.col("d") <= closest)).select("scan_id", F.col("a").alias("ordinal"))
