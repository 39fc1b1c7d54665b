"""Composite pipelines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereoloom.operators import spatial
from stereoloom.operators.sampling import numbered


def surface_accuracy(test: DataFrame, truth: DataFrame, cap: float = 0.10) -> DataFrame:
    """Distances of a surface to another, capped: count, median, p90, share within 1, 2 and 5 cm."""
    near = spatial.radius_join(test, truth, cap).groupBy("scan_id", F.col("a").alias("ordinal")).agg(F.min("d").alias("d"))
    own = test.select("scan_id", "ordinal").join(near, ["scan_id", "ordinal"], "left").withColumn("d", F.coalesce("d", F.lit(cap)))
    within = [F.avg((F.col("d") <= cm / 100).cast("int")).alias(f"within{cm}") for cm in (1, 2, 5)]
    # percentiles by place in the sorted distances, so that no task holds them all
    placed = numbered(own.select("d"), ["d"])
    last = F.col("__n") - 1

    def at(share: float):
        low, high = F.floor(last * share), F.ceil(last * share)
        value = lambda place: F.max(F.when(F.col("__i") == place, F.col("d")))
        return value(low) + (value(high) - value(low)) * F.max(last * share - low)

    return placed.agg(F.count("*").alias("n"), at(0.5).alias("median"), at(0.9).alias("p90"), *within)


def valid_frames(frames: DataFrame) -> DataFrame:
    """frames of 16 finite pose values, positive sizes and focal lengths, a plain file name, and an id and a name of their own within the scan.

    Ids and names that repeat are counted first, so a hot one is a sum, not a
    window.
    """
    from stereoloom.functions.numeric import is_finite

    k = F.col("intrinsics")
    plain = F.col("imageFile").rlike(r"^[^/\\]+$") & ~F.col("imageFile").isin(".", "..")
    ok = (F.size("transform") == 16) & F.forall("transform", is_finite) & (k["fx"] > 0) & (k["fy"] > 0) & (k["width"] > 0) & (k["height"] > 0) & plain
    good = frames.filter(F.coalesce(ok, F.lit(False)))
    for key in ("id", "imageFile"):
        twice = frames.groupBy("scan_id", key).agg(F.count("*").alias("n")).filter("n > 1")
        good = good.join(twice, ["scan_id", key], "left_anti")
    return good


def usable(frames: DataFrame, training: bool = False) -> DataFrame:
    """frames that no verdict drops; for training also none that it demotes."""
    return frames.filter(~F.col("verdict").isin("drop", *(["demote"] if training else [])))


def blur_verdicts(frames: DataFrame, distance: float = 0.5, degrees: float = 30.0, drop: float = 25.0, demote: float = 10.0, soft: float = 0.5, peers: int = 2, share: float = 0.3) -> DataFrame:
    """``verdict`` keep, demote or drop of each frame with at least ``peers`` sharp neighbours.

    Dropped above ``drop`` px of blur; demoted above ``demote`` px of
    exposure blur or below ``soft`` of the neighbours' p75 sharpness. At most
    ``share`` of a scan is rejected, drops first, then the most severe.
    frames: + blur, exposure_blur, sharpness.
    """
    from stereoloom.functions.numeric import nearest_rank
    from stereoloom.operators.sampling import capped_rejection

    near = spatial.neighbour_frames(frames, distance, degrees, ("sharpness",)).filter("b_sharpness > 0")
    facts = near.groupBy("scan_id", F.col("a").alias("id")).agg(F.count("*").alias("peers"), nearest_rank(F.col("b_sharpness"), 0.75).alias("p75"))
    own = frames.join(facts, ["scan_id", "id"], "left")
    judged = F.coalesce(F.col("peers"), F.lit(0)) >= peers
    blurred = F.when(judged & (F.col("blur") > drop), "drop").when(judged & ((F.col("exposure_blur") > demote) | (F.col("sharpness") < soft * F.col("p75"))), "demote")
    severity = F.greatest(F.coalesce(F.try_divide("blur", F.lit(drop)), F.lit(0.0)), F.coalesce(1 - F.try_divide("sharpness", "p75"), F.lit(0.0)))
    return capped_rejection(own.withColumns({"verdict": blurred, "severity": severity}), share)


def training_selection(frames: DataFrame, distance: float = 0.04, degrees: float = 3.0, difference: float = 0.06, clearer: float = 0.65) -> DataFrame:
    """Which frames train: best detail first, each kept frame bars near and alike ones.

    Gives ``scan_id, id, selected, reason, replacement``: a barred frame's
    replacement is its best-ranked kept neighbour, the reason says whether
    its detail is far below. frames: + detail, signature, verdict (frames
    with one other than keep do not train).
    """
    from stereoloom.operators.graph import greedy_independent, ranked
    from stereoloom.plans.durable import durable

    own = frames.filter("verdict = 'keep'")
    edges = durable(spatial.near_duplicate_views(own, distance, degrees, difference))
    node = lambda n: F.struct("scan_id", F.col(n).alias("id"))
    order = ranked(own, [F.desc("detail"), F.asc("id")], ["scan_id"])
    state = greedy_independent(order.select(node("id").alias("id"), "rank"), edges.select(node("a").alias("a"), node("b").alias("b")))
    kept = state.select("id.scan_id", "id.id", F.col("kept").alias("selected"))
    both = edges.select("scan_id", F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select("scan_id", F.col("b").alias("id"), F.col("a").alias("other")))
    best = both.join(kept.filter("selected").select("scan_id", F.col("id").alias("other")), ["scan_id", "other"]).join(order.select("scan_id", F.col("id").alias("other"), "rank", F.col("detail").alias("other_detail")), ["scan_id", "other"])
    replacement = best.groupBy("scan_id", "id").agg(F.min(F.struct("rank", "other", "other_detail")).alias("r"))
    out = frames.select("scan_id", "id", "verdict", "detail").join(kept, ["scan_id", "id"], "left").join(replacement, ["scan_id", "id"], "left")
    reason = F.when(F.col("verdict") != "keep", F.concat(F.lit("verdict:"), F.col("verdict"))).when(F.col("selected"), "selected").when(F.col("detail") < clearer * F.col("r.other_detail"), "clearer view").otherwise("similar view")
    return out.select("scan_id", "id", F.coalesce("selected", F.lit(False)).alias("selected"), reason.alias("reason"), F.when(~F.coalesce("selected", F.lit(False)), F.col("r.other")).alias("replacement"))


def reference_views(frames: DataFrame, near: float = 0.06, far: float = 0.4, cos: float = 0.85, seconds: float = 0.25, ideal: float = 0.15, apart: float = 0.06, most: int = 4) -> DataFrame:
    """Up to ``most`` reference views of each frame: ``scan_id, a, b, place``.

    Candidates lie between ``near`` and ``far``, look alike and were taken
    ``seconds`` apart; nearest the ``ideal`` distance first, each at least
    ``apart`` from those taken. The greedy choice is made per frame over its
    candidates, whose number the capture's density bounds.
    """
    import math

    pairs = spatial.neighbour_frames(frames, far, math.degrees(math.acos(cos)), ("timestamp", "x", "y", "z")).filter(F.col("d") >= near)
    own = pairs.filter(F.abs(F.col("a_timestamp") - F.col("b_timestamp")) >= seconds).select("scan_id", "a", "b", F.abs(F.col("d") - ideal).alias("r"), *[F.col(f"b_{c}").alias(c) for c in "xyz"])
    return _taken_apart(own, ["r", "b"], apart, most).select("scan_id", "a", "taken.b", F.col("place").cast("int").alias("place"))


def _taken_apart(candidates: DataFrame, order: list[str], apart: float, most: int) -> DataFrame:
    """Greedy choice for each (scan_id, a) of its candidates by ``order``, each at x, y, z at least ``apart`` from those taken: ``scan_id, a, place, taken``."""
    fields = [*order, *[c for c in candidates.columns if c not in ("scan_id", "a", *order)]]
    far = lambda o: lambda t: sum(((o[c] - t[c]) ** 2 for c in "yz"), (o["x"] - t["x"]) ** 2) >= apart * apart
    in_turn = F.array_sort(F.collect_list(F.struct(*fields)))
    taken = F.aggregate("all", F.slice("all", 1, 0), lambda taken, o: F.when((F.size(taken) < most) & F.forall(taken, far(o)), F.concat(taken, F.array(o))).otherwise(taken))
    groups = candidates.groupBy("scan_id", "a").agg(in_turn.alias("all"))
    return groups.select("scan_id", "a", F.posexplode(taken).alias("place", "taken"))


def spaced_references(frames: DataFrame, seconds: float = 0.25, apart: float = 0.08, most: int = 64) -> DataFrame:
    """Frames in capture order, each ``seconds`` after the last kept and ``apart`` from all kept; then at most ``most``, evenly.

    One scan's frames are walked in order; a scan is one capture session.
    """
    import pandas as pd

    from stereoloom.operators.sampling import evenly_spaced

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["timestamp", "id"])
        cells: dict[tuple, list] = {}
        keep, last = [], -float("inf")
        for row in pdf.itertuples():
            cell = tuple(int(v // apart) for v in (row.x, row.y, row.z))
            near = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) for p in cells.get((cell[0] + a, cell[1] + b, cell[2] + c), ()))
            ok = row.timestamp - last >= seconds and all((row.x - p[0]) ** 2 + (row.y - p[1]) ** 2 + (row.z - p[2]) ** 2 >= apart * apart for p in near)
            keep.append(ok)
            if ok:
                last = row.timestamp
                cells.setdefault(cell, []).append((row.x, row.y, row.z))
        return pdf[keep]

    own = frames.select("scan_id", "id", "timestamp", "x", "y", "z")
    return evenly_spaced(own.groupBy("scan_id").applyInPandas(walk, own.schema), most, ["timestamp", "id"], ["scan_id"])


def separated_revisits(candidates: DataFrame, gap: int = 10, most: int = 64) -> DataFrame:
    """J8, second part: revisit pairs, nearest first, whose ends both lie ``gap`` ids from those of any kept pair; at most ``most`` a scan."""
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list = []
        for row in pdf.sort_values(["d", "a", "b"]).itertuples():
            if len(taken) < most and all(abs(row.a - t.a) >= gap or abs(row.b - t.b) >= gap for t in taken):
                taken.append(row)
        return pdf.loc[[t.Index for t in taken]]

    return candidates.groupBy("scan_id").applyInPandas(pick, candidates.schema)


def sources_apart(scores: DataFrame, frames: DataFrame, apart: float = 0.02, most: int = 4) -> DataFrame:
    """J13, second part: the best-scored source views of each frame, ``apart`` from one another."""
    own = scores.join(frames.select("scan_id", F.col("id").alias("b"), "x", "y", "z"), ["scan_id", "b"])
    last, first = F.col("score").isNull().alias("none"), (-F.col("score")).alias("first")
    return _taken_apart(own.select("*", last, first), ["none", "first", "b"], apart, most).select("scan_id", "taken.b", "a", *[f"taken.{c}" for c in own.columns if c not in ("scan_id", "a", "b")])


def _checks(df: DataFrame, checks: list[tuple]) -> DataFrame:
    """(name, value, ok) of each (name, aggregate, what it must satisfy), all in one pass over ``df``."""
    row = df.agg(*[value.cast("double").alias(f"v{i}") for i, (_, value, _) in enumerate(checks)])
    parts = [F.struct(F.lit(name).alias("name"), F.col(f"v{i}").alias("value"), ok(F.col(f"v{i}")).alias("ok")) for i, (name, _, ok) in enumerate(checks)]
    return row.select(F.explode(F.array(*parts)).alias("c")).select("c.*")


def dataset_checks(frames: DataFrame, jump: float = 0.5) -> DataFrame:
    """Check table (name, value, ok) of a dataset's frames (+ pose, imageFile, width, height of the image)."""
    from stereoloom.functions.geometry import is_rigid
    from stereoloom.operators.sequence import adjacent_differences

    none = lambda v: v == 0
    return _checks(adjacent_differences(frames), [
        ("frames", F.count("*"), lambda v: v > 0), ("missing images", F.count_if(F.col("imageFile").isNull()), none), ("poses not rigid", F.count_if(~is_rigid("pose")), none),
        ("repeated ids", F.count("*") - F.count_distinct("scan_id", "id"), none), ("time not forward", F.count_if("backwards"), none), ("jumps", F.count_if("jump"), none),
    ])


def capture_checks(frames: DataFrame, longest: float = 1 / 60 * 1.05, iso: float = 1600, rejected: float = 0.28, blur: float = 10.0, breathing: float = 0.02) -> DataFrame:
    """Check table of capture quality (frames: exposure, iso, blur, verdict, fx)."""
    bad = F.avg((F.col("verdict") != "keep").cast("int"))
    breathe = (F.max("fx") - F.min("fx")) / F.avg("fx")
    return _checks(frames, [
        ("longest exposure", F.max("exposure"), lambda v: v <= longest), ("highest iso", F.max("iso"), lambda v: v <= iso), ("rejected share", bad, lambda v: v <= rejected),
        ("mean blur", F.avg("blur"), lambda v: v <= blur), ("focal breathing", breathe, lambda v: v <= breathing),
    ])


def scan_accuracy(points: DataFrame, frames: DataFrame, cell: float = 0.05) -> DataFrame:
    """Floor and ceiling, wall angle, wall bands, ghost error and trajectory of each scan, in one row."""
    from stereoloom.operators import metrics as m

    bands = m.wall_bands(points, "x", cell)
    out = m.floor_and_ceiling(points, cell).join(m.wall_angle(points, cell).withColumnRenamed("score", "angle_score"), "scan_id", "left")
    return out.join(m.error_budget(bands).select("scan_id", "ghost"), "scan_id", "left").join(m.trajectory(frames), "scan_id", "left")


def coverage_comparison(a: DataFrame, b: DataFrame, cell: float = 0.05, far: float = 0.03, reach: float = 0.5) -> DataFrame:
    """Nearest distances both ways (count beyond ``far``, p95, capped at ``reach``) and components of the occupied cells at two grid phases."""
    from stereoloom.operators.fusion import keyed
    from stereoloom.operators.graph import cell_components, component_summary

    def way(test, truth, name):
        near = spatial.radius_join(test, truth, reach).groupBy("scan_id", F.col("a").alias("ordinal")).agg(F.min("d").alias("d"))
        own = test.select("scan_id", "ordinal").join(near, ["scan_id", "ordinal"], "left").withColumn("d", F.coalesce("d", F.lit(reach)))
        return own.groupBy("scan_id").agg(F.lit(name).alias("part"), F.count_if(F.col("d") > far).alias("n"), F.percentile("d", F.lit(0.95)).alias("value"))

    def islands(points, phase, name):
        moved = points.withColumns({c: F.col(c) + phase for c in "xyz"})
        s = component_summary(cell_components(keyed(moved, cell).select("scan_id", "key")))
        return s.select("scan_id", F.lit(name).alias("part"), F.col("components").alias("n"), F.col("largest").cast("double").alias("value"))

    return way(a, b, "a to b").unionByName(way(b, a, "b to a")).unionByName(islands(a, 0.0, "islands a")).unionByName(islands(a, cell / 2, "islands a, half a cell on"))


def metric_scales(references: DataFrame, most: float = 0.02, share: float = 0.01) -> DataFrame:
    """Scale of each scan from its valid references (scan_id, start, end, knownMeters): median of known over measured, residuals, status."""
    from stereoloom.functions.capture import reference_valid
    from stereoloom.functions.numeric import middle_median

    length = F.sqrt(F.aggregate(F.zip_with("start", "end", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    own = references.filter(reference_valid("knownMeters")).withColumn("measured", length).filter("measured > 0")
    s = own.groupBy("scan_id").agg(middle_median(F.col("knownMeters") / F.col("measured")).alias("scale"), F.count("*").alias("references"))
    residual = F.abs(F.col("measured") * F.col("scale") - F.col("knownMeters"))
    worst = own.join(s, "scan_id").groupBy("scan_id", "scale", "references").agg(F.max(residual).alias("residual"), F.bool_and(residual <= F.greatest(F.lit(most), share * F.col("knownMeters"))).alias("consistent"))
    return worst.withColumn("status", F.when(F.col("references") < 2, "single").when(F.col("consistent"), "verified").otherwise("inconsistent"))


def stale(scale: DataFrame, geometry: DataFrame) -> DataFrame:
    """Whether the geometry's fingerprint (scan_id, content) is still the one the scale was measured on (``fingerprint``)."""
    now = geometry.select("scan_id", F.sha2("content", 256).alias("now"))
    return scale.join(now, "scan_id", "left").withColumn("stale", ~F.col("fingerprint").eqNullSafe(F.col("now"))).drop("now")


def dataset_preparation(raw: DataFrame, corrected: DataFrame, columns: list[str], holdout: int = 8) -> DataFrame:
    """C20: saved records merged, judged for blur, selected for training, split: frames with ``selected``, ``holdout`` and ``ev``."""
    from stereoloom.functions.capture import exposure_value
    from stereoloom.operators.sequence import holdout_every
    from stereoloom.plans.durable import durable

    merged = durable(spatial.corrected_records(raw, corrected, columns).drop("corrected"), "merged")
    judged = durable(blur_verdicts(merged))
    chosen = training_selection(judged).filter("selected").select("scan_id", "id")
    kept = judged.join(chosen, ["scan_id", "id"], "left_semi")
    return holdout_every(kept, holdout).withColumn("ev", exposure_value("exposure", "iso"))


def refusion(samples: DataFrame, views: DataFrame, size: float, lookups: DataFrame | None = None, near: float = 3.0, least: int = 3) -> DataFrame:
    """Accepted samples to world points, consensus shift along the ray, near and far fusion, isolated cells removed.

    samples: F3's output with scan_id, frame_id, ordinal, u, v, z, weight;
    views: scan_id, frame_id, pose, intrinsics. lookups: J6's answers, if
    there are reference views.
    """
    from stereoloom.functions import geometry as g
    from stereoloom.operators import fusion
    from stereoloom.operators.raster import depth_consensus

    own = samples
    if lookups is not None:
        shift = depth_consensus(lookups).select("scan_id", "ordinal", "shift")
        own = own.join(shift, ["scan_id", "ordinal"]).withColumn("z", F.col("z") + F.col("shift"))
    placed = own.join(views, ["scan_id", "frame_id"])
    x, y, z = g.unproject(g.Camera.of("intrinsics"), "pose", F.col("u"), F.col("v"), F.col("z").cast("double"))
    points = placed.select("scan_id", "ordinal", x.alias("x"), y.alias("y"), z.alias("z"), F.col("weight").alias("score"), (F.col("z") > near).alias("far"))
    cells = fusion.fuse(points, size, keys=("scan_id", "far"))
    return fusion.isolated_removed(cells, least, keys=("scan_id", "far"))


def tsdf_surface(points: DataFrame, fallback: DataFrame, size: float, share: float = 0.35) -> tuple[DataFrame, bool]:
    """Zero crossings of the signed distance, plus fallback points where no cell supports a surface; taken only if they reach ``share`` of the fallback.

    The flag says whether the surface was taken.
    """
    from stereoloom.functions import voxels as vx
    from stereoloom.operators import fusion
    from stereoloom.plans.durable import durable

    cells = durable(fusion.tsdf_integrate(points, size))
    surface = durable(fusion.tsdf_crossings(cells, size).select("scan_id", "x", "y", "z"))
    if surface.count() < share * fallback.count():
        return fallback.select("scan_id", "x", "y", "z"), False
    masked = cells.filter("views >= 2").select("scan_id", F.explode(vx.neighbour_keys("key")).alias("key")).distinct()
    lone = fallback.withColumn("key", vx.voxel_key("x", "y", "z", size)).join(masked, ["scan_id", "key"], "left_anti")
    return surface.unionByName(lone.select("scan_id", "x", "y", "z")), True


def far_coverage(far: DataFrame, near: DataFrame) -> DataFrame:
    """Far points without those that a like near patch covers."""
    return far.join(spatial.covered_by(far, near), ["scan_id", "ordinal"], "left_anti")


def floor_plan(points: DataFrame, cell: float, low: float, high: float, gap: int = 2) -> DataFrame:
    """Wall runs of a scan: spanning columns, rotated to the wall angle, joined along their longer direction.

    Gives ``scan_id, direction, line, first, last, cells, component`` in cells
    of the rotated grid.
    """
    from stereoloom.operators import graph
    from stereoloom.operators import metrics as m
    from stereoloom.operators import sequence as s
    from stereoloom.plans.durable import durable

    angle = m.wall_angle(points, cell)
    a = F.radians(F.col("angle") * 0.5)
    turned = points.join(angle.select("scan_id", "angle"), "scan_id")
    turned = turned.select("scan_id", "ordinal", (F.cos(a) * F.col("x") + F.sin(a) * F.col("z")).alias("x"), "y", (F.cos(a) * F.col("z") - F.sin(a) * F.col("x")).alias("z"))
    columns = m.column_spans(turned, cell, low, high).withColumn("span", F.col("high") - F.col("low"))
    limit = columns.groupBy("scan_id").agg((0.6 * F.percentile("span", F.lit(0.9))).alias("limit"))
    walls = s.run_direction(columns.join(limit, "scan_id").filter("span >= limit").select("scan_id", "i", "j"))
    flat = s.runs(walls.filter("direction = 'horizontal'"), "j", "i", gap).select("scan_id", F.lit("horizontal").alias("direction"), F.col("j").alias("line"), "first", "last", "cells")
    up = s.runs(walls.filter("direction = 'vertical'"), "i", "j", gap).select("scan_id", F.lit("vertical").alias("direction"), F.col("i").alias("line"), "first", "last", "cells")
    runs = durable(flat.unionByName(up))
    node = F.struct("scan_id", "direction", "line", "first")
    joined = graph.connected_components(
        runs.select(node.alias("a"), "scan_id", "direction", "first", "last", F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line"))
        .join(runs.select(node.alias("b"), "scan_id", "direction", F.col("first").alias("f2"), F.col("last").alias("l2"), "line"), ["scan_id", "direction", "line"])
        .filter((F.col("a") != F.col("b")) & (F.col("first") <= F.col("l2") + gap) & (F.col("f2") <= F.col("last") + gap)).select("a", "b"),
        runs.select(node.alias("node")))
    named = joined.select("node.*", F.hash("component").alias("component"))
    return runs.join(named, ["scan_id", "direction", "line", "first"])


def sharpness_replay(frames: DataFrame, decay: float = 0.97, longest: float = 0.25, dark: float = 1e-6) -> DataFrame:
    """Ratio of each frame's sharpness to a peak that decays at 60 Hz steps, in time order; severe motion stops the decay.

    The same rule as ``SharpnessReference``, without a fold: with the decay
    since the start as a running sum s of logarithms, the peak is the running
    maximum of log(sharpness) + s, less s. Values that are no numbers or below
    zero give 1 and take no part.
    """
    from pyspark.sql import Window

    from stereoloom.functions.numeric import is_finite

    good = F.coalesce(is_finite(F.col("sharpness")) & (F.col("sharpness") >= 0), F.lit(False))
    w = Window.partitionBy("scan_id").orderBy("timestamp", "id")
    since = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.least(F.greatest(F.col("timestamp") - F.lag("timestamp").over(w), F.lit(0.0)), F.lit(longest))
    fall = F.when(F.col("severe"), 0.0).otherwise(-60 * math.log(decay) * F.coalesce(step, F.lit(0.0)))
    own = frames.filter(good).withColumn("fall", fall).withColumn("fallen", F.sum("fall").over(since))
    top = F.max(F.log(F.when(F.col("sharpness") > 0, F.col("sharpness"))) + F.col("fallen")).over(since)
    own = own.withColumn("peak", F.coalesce(F.exp(top - F.col("fallen")), F.lit(0.0)))
    ratio = F.when(F.col("peak") > dark, F.least(F.col("sharpness") / F.col("peak"), F.lit(1.0))).otherwise(1.0)
    return own.select("scan_id", F.col("id").cast("long").alias("id"), ratio.alias("ratio")).unionAll(frames.filter(~good).select("scan_id", F.col("id").cast("long"), F.lit(1.0)))


def desktop_points(samples: DataFrame, views: DataFrame, size: float, most: int, confidence: int = 2, near: float = 0.15, far: float = 6.0) -> DataFrame:
    """The desktop depth rebuild: confident samples in range to world points, the first of each voxel by frame, at most ``most`` in that order."""
    from stereoloom.functions import geometry as g
    from stereoloom.operators.sampling import first_per_voxel

    own = samples.filter((F.col("conf") >= confidence) & (F.col("z") > near) & (F.col("z") < far)).join(views, ["scan_id", "frame_id"])
    x, y, z = g.unproject(g.Camera.of("intrinsics"), "pose", F.col("u"), F.col("v"), F.col("z").cast("double"))
    points = own.select("scan_id", "frame_id", (F.col("v") * 100_000 + F.col("u")).alias("ordinal"), x.alias("x"), y.alias("y"), z.alias("z"))
    return first_per_voxel(points, size).orderBy("scan_id", "frame_id", "ordinal").limit(most)


def desktop_conversion(frames: DataFrame, max_blur: float | None, keep: int, portrait: bool = False) -> DataFrame:
    """Records filtered in order, spread to ``keep``, poses for COLMAP, intrinsics turned for portrait images."""
    from stereoloom.functions import geometry as g
    from stereoloom.operators.sampling import evenly_spaced
    from stereoloom.operators.sequence import strictly_later

    chosen = evenly_spaced(strictly_later(frames, max_blur), keep, ["id"], ["scan_id"])
    camera = g.Camera.of("intrinsics")
    return chosen.withColumns({"colmap": g.colmap_pose("pose"), "intrinsics": (camera.portrait() if portrait else camera).struct()})


def optimised_entry(frames: DataFrame, refine, gate, path: str, least: int = 1) -> str:
    """A new history entry from a scan's frames: judged, refined if the gate accepts, selected, published whole.

    The source is never written; an empty selection raises ValueError and
    publishes nothing.
    """
    from stereoloom.operators.kernels import staged_refinement
    from stereoloom.plans.durable import durable
    from stereoloom.sources.scans import publish

    refined, _ = staged_refinement([("refine", refine)], gate, frames)
    judged = durable(blur_verdicts(refined))
    chosen = training_selection(judged).filter("selected").select("scan_id", "id")
    out = durable(judged.join(chosen, ["scan_id", "id"], "left_semi"))
    if out.count() < least:
        raise ValueError("nothing is left to publish")
    publish(out, path)
    return path
