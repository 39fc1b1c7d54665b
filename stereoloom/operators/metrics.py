"""Grouped statistics: tracks, plans, surfaces, trajectories, images."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stereoloom.functions import voxels as vx
from stereoloom.functions.numeric import clamp, nearest_rank, upper_median


def long_tracks(observations: DataFrame, least: int = 3) -> DataFrame:
    """A10: observations of tracks that have ``least`` or more. Counts are aggregated before the join, so long tracks do not gather."""
    counts = observations.groupBy("track_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return observations.join(counts.select("track_id"), "track_id", "left_semi")


def track_means(observations: DataFrame) -> DataFrame:
    """Mean world point of each track's observations that have depth."""
    return observations.filter("depth > 0").groupBy("track_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"])


def triangulate(rays: DataFrame, least_degrees: float = 1.0) -> DataFrame:
    """The point nearest to a track's rays, from sums of I - d d-transpose, by Cramer's rule.

    rays: track_id, ox, oy, oz, dx, dy, dz (unit). Tracks whose widest pair of
    rays is under ``least_degrees`` or whose point lies behind a ray give
    null. The widest pair is bounded below by twice the widest angle to the
    mean direction only if rays are symmetric, so each ray is compared with
    the track's extreme rays on the three axes.
    """
    d, o = [F.col(f"d{c}") for c in "xyz"], [F.col(f"o{c}") for c in "xyz"]
    sums = [F.count("*").alias("n")]
    for i in range(3):
        for j in range(i, 3):
            sums.append(F.sum((1.0 if i == j else 0.0) - d[i] * d[j]).alias(f"m{i}{j}"))
        sums.append(F.sum(sum((((1.0 if i == k else 0.0) - d[i] * d[k]) * o[k] for k in range(1, 3)), ((1.0 if i == 0 else 0.0) - d[i] * d[0]) * o[0])).alias(f"b{i}"))
    for c in "xyz":
        for f, name in ((F.min, "l"), (F.max, "h")):
            sums.append(f(F.struct(F.col(f"d{c}").alias("lead"), "dx", "dy", "dz")).alias(f"{name}{c}"))
    s = rays.groupBy("track_id").agg(*sums)
    m = lambda i, j: F.col(f"m{min(i, j)}{max(i, j)}")

    def det(a):
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    full = [[m(i, j) for j in range(3)] for i in range(3)]
    whole = det(full)
    solved = {c: det([[F.col(f"b{i}") if j == k else full[i][j] for j in range(3)] for i in range(3)]) / whole for k, c in enumerate("xyz")}
    points = s.withColumn("det", whole).filter(F.abs("det") > 1e-12).select("track_id", "n", *[v.alias(f"p{c}") for c, v in solved.items()], *[F.col(f"{e}{c}") for e in "lh" for c in "xyz"])
    checked = rays.join(points, "track_id")
    ahead = sum(((F.col(f"p{c}") - F.col(f"o{c}")) * F.col(f"d{c}") for c in "yz"), (F.col("px") - F.col("ox")) * F.col("dx"))
    least_cos = F.least(*[sum((F.col(f"{e}{c}.d{k}") * F.col(f"d{k}") for k in "yz"), F.col(f"{e}{c}.dx") * F.col("dx")) for e in "lh" for c in "xyz"])
    out = checked.groupBy("track_id", "n", "px", "py", "pz").agg(F.min(ahead).alias("ahead"), F.min(least_cos).alias("cos"))
    return out.filter((F.col("ahead") > 0) & (F.col("cos") <= math.cos(math.radians(least_degrees)))).select("track_id", "n", "px", "py", "pz")


def column_spans(points: DataFrame, cell: float, low: float, high: float) -> DataFrame:
    """Per (i, j) floor cell: least and greatest height within the band, count, which thirds of the band are occupied."""
    third = (high - low) / 3
    band = F.floor((F.col("y") - low) / third)
    own = points.filter((F.col("y") >= low) & (F.col("y") < high)).withColumns({"i": F.floor(F.col("x") / cell), "j": F.floor(F.col("z") / cell)})
    return own.groupBy("scan_id", "i", "j").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("n"), *[F.bool_or(band == k).alias(f"band{k}") for k in range(3)])


def wall_angle(points: DataFrame, bin_size: float, angles: int = 180) -> DataFrame:
    """Per scan the angle (in steps of 90 / angles degrees) whose two axis histograms have the greatest sum of squared counts; the least on a tie."""
    spun = points.select("scan_id", "x", "z", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("angle"))
    a = F.radians(F.col("angle") * F.lit(90.0 / angles))
    axes = F.array(F.struct(F.lit(0).alias("axis"), F.floor((F.cos(a) * F.col("x") + F.sin(a) * F.col("z")) / bin_size).alias("bin")), F.struct(F.lit(1).alias("axis"), F.floor((F.cos(a) * F.col("z") - F.sin(a) * F.col("x")) / bin_size).alias("bin")))
    counts = spun.select("scan_id", "angle", F.explode(axes).alias("b")).groupBy("scan_id", "angle", "b.axis", "b.bin").agg(F.count("*").alias("c"))
    scores = counts.groupBy("scan_id", "angle").agg(F.sum(F.col("c") * F.col("c")).alias("score"))
    return scores.groupBy("scan_id").agg(F.max(F.struct("score", (-F.col("angle")).alias("neg"))).alias("b")).select("scan_id", (-F.col("b.neg")).alias("angle"), F.col("b.score").alias("score"))


def floor_and_ceiling(points: DataFrame, bin_size: float = 0.05, apart: float = 1.8) -> DataFrame:
    """The fullest height bin and the fullest at least ``apart`` from it; without one, the 2nd and 98th percentiles."""
    bins = points.groupBy("scan_id", F.floor(F.col("y") / bin_size).alias("bin")).agg(F.count("*").alias("n"))
    top = bins.groupBy("scan_id").agg(F.max(F.struct("n", (-F.col("bin")).alias("neg"))).alias("t")).select("scan_id", (-F.col("t.neg")).alias("first"))
    far = bins.join(top, "scan_id").filter(F.abs(F.col("bin") - F.col("first")) * F.lit(bin_size) >= apart)
    second = far.groupBy("scan_id").agg(F.max(F.struct("n", (-F.col("bin")).alias("neg"))).alias("t")).select("scan_id", (-F.col("t.neg")).alias("second"))
    edge = points.groupBy("scan_id").agg(F.percentile("y", F.lit(0.02)).alias("p2"), F.percentile("y", F.lit(0.98)).alias("p98"))
    both = edge.join(top, "scan_id").join(second, "scan_id", "left")
    mid = lambda c: (F.col(c) + 0.5) * F.lit(bin_size)
    found = F.col("second").isNotNull()
    return both.select("scan_id", F.when(found, F.least(mid("first"), mid("second"))).otherwise(F.col("p2")).alias("floor"), F.when(found, F.greatest(mid("first"), mid("second"))).otherwise(F.col("p98")).alias("ceiling"))


def plane_moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """Means and second moments of groups of points, one hash aggregate."""
    second = [F.covar_pop(a, b).alias(f"c{a}{b}") for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *second)


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("nx", "ny", "nz", "rms")]))
def plane_of(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Normal (positive largest part) and RMS distance of the plane with these second moments."""
    m = np.stack([np.stack(r, axis=-1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], axis=-2).astype(float)
    if not len(m):
        return pd.DataFrame({k: pd.Series(dtype=float) for k in ("nx", "ny", "nz", "rms")})
    values, vectors = np.linalg.eigh(np.nan_to_num(m))
    normal = vectors[:, :, 0]
    lead = np.take_along_axis(normal, np.abs(normal).argmax(axis=1)[:, None], 1)
    normal = normal * np.where(lead < 0, -1, 1)
    return pd.DataFrame({"nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2], "rms": np.sqrt(np.maximum(values[:, 0], 0))})


def plane_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Plane of each group: mean, normal, rms. The moments are aggregated in the JVM; only they reach Python."""
    m = plane_moments(points, keys)
    return m.withColumn("p", plane_of("cxx", "cxy", "cxz", "cyy", "cyz", "czz")).select(*keys, "n", "mx", "my", "mz", "p.nx", "p.ny", "p.nz", "p.rms")


def patch_thickness(points: DataFrame, centres: DataFrame, radius: float = 0.20, least: int = 12, flat: float = 0.5) -> DataFrame:
    """p10 to p90 distance along the normal of the planar patches around centres (scan_id, ordinal, x, y, z)."""
    from stereoloom.operators.spatial import radius_join

    pairs = radius_join(centres, points, radius)
    near = pairs.join(points.select("scan_id", F.col("ordinal").alias("b"), "x", "y", "z"), ["scan_id", "b"])
    planes = plane_fit(near, ["scan_id", "a"]).filter((F.col("n") >= least) & (F.col("rms") <= flat * radius))
    along = near.join(planes, ["scan_id", "a"]).withColumn("h", (F.col("x") - F.col("mx")) * F.col("nx") + (F.col("y") - F.col("my")) * F.col("ny") + (F.col("z") - F.col("mz")) * F.col("nz"))
    return along.groupBy("scan_id", "a").agg(F.count("*").alias("n"), (F.percentile("h", F.lit(0.9)) - F.percentile("h", F.lit(0.1))).alias("thickness"))


def wall_bands(points: DataFrame, value: str, bin_size: float = 0.05, least: int = 30, gap: int = 2) -> DataFrame:
    """Bands of strong histogram bins (above ``least`` and the 90th percentile of bins), small gaps merged; rms and thickness of each."""
    own = points.withColumn("bin", F.floor(F.col(value) / bin_size))
    bins = own.groupBy("scan_id", "bin").agg(F.count("*").alias("c"))
    limit = bins.groupBy("scan_id").agg(F.greatest(F.lit(float(least)), F.percentile("c", F.lit(0.9))).alias("limit"))
    strong = bins.join(limit, "scan_id").filter("c > limit")
    w = Window.partitionBy("scan_id").orderBy("bin")
    banded = strong.withColumn("s", F.when(F.col("bin") - F.lag("bin").over(w) > gap + 1, 1).otherwise(0)).withColumn("band", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = banded.groupBy("scan_id", "band").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.count("*").alias("peaks"))
    inside = own.join(spans, "scan_id").filter(F.col("bin").between(F.col("first"), F.col("last")))
    return inside.groupBy("scan_id", "band", "peaks").agg(F.count("*").alias("n"), F.stddev_pop(value).alias("rms"), (F.percentile(value, F.lit(0.9)) - F.percentile(value, F.lit(0.1))).alias("thickness"))


def error_budget(bands: DataFrame) -> DataFrame:
    """Ghost error of a scan: the root of what the double walls' median square has beyond the single walls'."""
    med = lambda ok: F.percentile(F.when(ok, F.col("rms")), F.lit(0.5))
    out = bands.groupBy("scan_id").agg(med(F.col("peaks") > 1).alias("double"), med(F.col("peaks") == 1).alias("single"))
    return out.withColumn("ghost", F.sqrt(F.greatest(F.col("double") ** 2 - F.col("single") ** 2, F.lit(0.0))))


def trajectory(frames: DataFrame) -> DataFrame:
    """Path length, distance from start to end, nearest return to the start in the second half, drift in per cent."""
    from stereoloom.operators.sequence import by_scan, step_length

    w = Window.partitionBy("scan_id")
    own = frames.withColumns({"step": step_length(), "i": F.row_number().over(by_scan()), "n": F.count("*").over(w), **{f"s{c}": F.first(c).over(by_scan()) for c in "xyz"}})
    back = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2 + (F.col("z") - F.col("sz")) ** 2)
    out = own.groupBy("scan_id").agg(F.count("*").alias("frames"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.max(F.when(F.col("i") == F.col("n"), back)).alias("end_gap"), F.min(F.when(F.col("i") * 2 > F.col("n"), back)).alias("nearest_return"))
    return out.withColumn("drift_percent", F.when(F.col("path") > 0, 100 * F.col("end_gap") / F.col("path")))


def drift_summary(raw: DataFrame, refined: DataFrame, large: float = 0.02, even: float = 0.9) -> DataFrame:
    """Displacement between raw and refined positions by id: upper median, maximum, whether it is a uniform shift."""
    r = refined.select("scan_id", "id", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    moved = raw.join(r, ["scan_id", "id"]).withColumn("d", F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2 + (F.col("z") - F.col("rz")) ** 2))
    out = moved.groupBy("scan_id").agg(F.count("*").alias("n"), upper_median(F.col("d")).alias("median"), F.max("d").alias("largest"))
    return out.withColumn("uniform", (F.col("largest") > large) & (F.col("median") / F.col("largest") > even))


def working_distance(samples: DataFrame, frames: int = 40, grid: int = 8) -> DataFrame:
    """Upper median depth of confident samples on a pixel grid over at most ``frames`` spread frames of a scan."""
    from stereoloom.operators.sampling import stride_sample

    chosen = stride_sample(samples.select("scan_id", "frame_id").distinct(), frames, ["frame_id"], ["scan_id"])
    good = samples.filter((F.col("u") % grid == 0) & (F.col("v") % grid == 0) & (F.col("conf") >= 1) & (F.col("z") > 0.1))
    return good.join(chosen, ["scan_id", "frame_id"], "left_semi").groupBy("scan_id").agg(F.count("*").alias("n"), upper_median(F.col("z")).alias("distance"))


def truncated_rank(values: Column, p: float) -> Column:
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, (F.floor((F.size(ordered) - 1) * F.lit(p)) + 1).cast("int"))


def robust_bounds(points: DataFrame, keys: list[str], most: int = 100_000) -> DataFrame:
    """p10 and p90 of each axis over every n-th point, centre, half extents, largest extent."""
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(*keys)) / most))
    own = points.withColumn("__s", step).filter(F.pmod("ordinal", "__s") == 0)
    out = own.groupBy(*keys).agg(*[truncated_rank(F.col(c), p).alias(f"{n}{c}") for c in "xyz" for n, p in (("l", 0.1), ("h", 0.9))])
    half = {f"e{c}": (F.col(f"h{c}") - F.col(f"l{c}")) / 2 for c in "xyz"}
    mid = {f"c{c}": (F.col(f"h{c}") + F.col(f"l{c}")) / 2 for c in "xyz"}
    return out.withColumns(half | mid).withColumn("extent", F.greatest("ex", "ey", "ez"))


def region_statistics(splats: DataFrame, bounds: DataFrame, keys: list[str], grid: int = 24) -> DataFrame:
    """Sums of visibility and error and the most views per region of a grid over twice the extents; outside goes to the rim."""
    own = splats.join(bounds, keys)
    cell = lambda c: clamp(F.floor((F.col(c) - F.col(f"c{c}") + 2 * F.col("extent")) / (4 * F.col("extent")) * grid), 0, grid - 1).cast("int")
    region = cell("x") + grid * (cell("y") + grid * cell("z"))
    return own.withColumn("region", region).groupBy(*keys, "region").agg(F.count("*").alias("n"), F.sum("visibility").alias("support"), F.sum("error").alias("error"), F.max("views").alias("views"))


def smoothed_regions(now: DataFrame, before: DataFrame, keys: list[str], rate: float = 0.1) -> DataFrame:
    """Moving averages of support and error; a region seen first starts at its own value, one not seen now decays."""
    b = before.select(*keys, F.col("support").alias("s0"), F.col("error").alias("e0"))
    ema = lambda new, old: F.when(F.col(old).isNull(), F.col(new)).otherwise(F.col(old) * (1 - rate) + F.coalesce(new, F.lit(0.0)) * rate)
    return now.join(b, keys, "full").select(*keys, ema("support", "s0").alias("support"), ema("error", "e0").alias("error"))


def region_shares(regions: DataFrame, keys: list[str], area: str = "n") -> DataFrame:
    """Each region's share by area, support (full at three times the mean) and relative error (up to four times the mean)."""
    w = Window.partitionBy(*keys)
    support = F.least(F.lit(1.0), F.col("support") * F.count("*").over(w) / 3 / F.greatest(F.sum("support").over(w), F.lit(1e-12)))
    relative = F.least(F.col("error") / F.greatest(F.avg("error").over(w), F.lit(1e-12)), F.lit(4.0))
    raw = F.col(area) * support * (0.5 + 0.5 * relative)
    return regions.withColumn("__w", raw).withColumn("share", F.col("__w") / F.greatest(F.sum("__w").over(w), F.lit(1e-300))).drop("__w")


def allot(shares: DataFrame, total: int, key: str, cap: str | None = None) -> DataFrame:
    """Integer split of ``total`` in proportion to ``share``: floors, then the largest remainders; with a cap column no row gets more.

    What caps free is split again among rows below theirs, until none is left
    over or all are full. The table is a row a region.
    """
    from stereoloom.plans.durable import durable

    limit = F.col(cap) if cap else F.lit(total)
    out, left = shares.withColumn("allotted", F.lit(0).cast("long")), total
    while left > 0:
        open_ = F.when(F.col("allotted") < limit, F.col("share")).otherwise(0.0)
        w = Window.partitionBy()
        part = out.withColumn("__o", open_).withColumn("__x", F.coalesce(F.try_divide(F.col("__o"), F.sum("__o").over(w)), F.lit(0.0)) * left)
        part = part.withColumns({"__f": F.floor("__x"), "__g": F.col("__x") - F.floor("__x")})
        part = part.withColumns({"__rest": F.lit(left) - F.sum("__f").over(w), "__r": F.row_number().over(w.orderBy(F.desc("__g"), key))})
        more = F.col("__f") + F.when((F.col("__r") <= F.col("__rest")) & (F.col("__o") > 0), 1).otherwise(0)
        before = left
        out = durable(part.withColumn("allotted", F.least(F.col("allotted") + F.coalesce(more, F.lit(0)), limit).cast("long")).select(*shares.columns, "allotted"))
        left = total - out.agg(F.sum("allotted")).first()[0]
        if left == before:
            break
    return out


def quality_counts(frames: DataFrame) -> DataFrame:
    """Frames by verdict and the share that was not kept."""
    out = frames.groupBy("scan_id").agg(F.count("*").alias("frames"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("keep", "demote", "drop")])
    return out.withColumn("rejected", (F.col("demote") + F.col("drop")) / F.col("frames"))


def signature(pixels: DataFrame, width: int, height: int, columns: int = 16, rows: int = 12) -> DataFrame:
    """Block means of luma (frame_id, u, v, luma), as one array a frame in block order."""
    block = F.floor(F.col("v") * rows / height) * columns + F.floor(F.col("u") * columns / width)
    means = pixels.groupBy("frame_id", block.alias("block")).agg(F.avg("luma").alias("m"))
    return means.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "m"))), lambda s: s["m"]).alias("signature"))


def stencil(pixels: DataFrame, reach: int = 1, value: str = "luma") -> DataFrame:
    """Neighbours left, right, up, down at ``reach`` pixels, null where the pixel is missing."""
    row, column = Window.partitionBy("frame_id", "v").orderBy("u"), Window.partitionBy("frame_id", "u").orderBy("v")

    def at(f, w, axis, sign):
        return F.when(f(axis, reach).over(w) - F.col(axis) == sign * reach, f(value, reach).over(w))

    return pixels.withColumns({"left": at(F.lag, row, "u", -1), "right": at(F.lead, row, "u", 1), "up": at(F.lag, column, "v", -1), "down": at(F.lead, column, "v", 1)})


def detail(pixels: DataFrame, least: float = 4.0) -> DataFrame:
    """Squared Laplacian over squared gradient of inner pixels; 0 if the mean squared gradient is not above ``least``."""
    s = stencil(pixels).filter("left is not null and right is not null and up is not null and down is not null")
    lap = F.col("left") + F.col("right") + F.col("up") + F.col("down") - 4 * F.col("luma")
    grad = (F.col("right") - F.col("left")) ** 2 + (F.col("down") - F.col("up")) ** 2
    out = s.groupBy("frame_id").agg(F.sum(lap * lap).alias("l"), F.sum(grad).alias("g"), F.count("*").alias("n"))
    return out.select("frame_id", F.when(F.col("g") / F.col("n") > least, F.col("l") / F.col("g")).otherwise(0.0).alias("detail"))


def sharpness(pixels: DataFrame, width: int, height: int, every: int = 6) -> DataFrame:
    """Absolute second differences at step 2 on a grid in the central 80 per cent, over the luma there."""
    s = stencil(pixels, 2)
    inside = (F.col("u") >= width * 0.1) & (F.col("u") < width * 0.9) & (F.col("v") >= height * 0.1) & (F.col("v") < height * 0.9) & (F.col("u") % every == 0) & (F.col("v") % every == 0)
    second = F.abs(F.col("left") + F.col("right") - 2 * F.col("luma")) + F.abs(F.col("up") + F.col("down") - 2 * F.col("luma"))
    return s.filter(inside & second.isNotNull()).groupBy("frame_id").agg((F.sum(second) / F.sum("luma")).alias("sharpness"))


def ncc(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Normalised correlation of two columns per group."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(a, b).alias("ncc"))


def psnr(pairs: DataFrame, a: str, b: str, keys: list[str], peak: float = 1.0) -> DataFrame:
    """PSNR in dB per group; infinite for equal images."""
    mse = F.avg((F.col(a) - F.col(b)) ** 2)
    return pairs.groupBy(*keys).agg(mse.alias("mse")).withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(F.lit(peak * peak) / F.col("mse"))).otherwise(F.lit(float("inf"))))


def polygon_measures(rooms: DataFrame, polygon: str = "polygon2D") -> DataFrame:
    """Area and area-weighted centroid of a flat array x0, y0, x1, y1, ...; a degenerate one has its vertices' mean."""
    p = F.col(polygon)
    n = F.floor(F.size(p) / 2).cast("int")
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(p[2 * i].cast("double").alias("x0"), p[2 * i + 1].cast("double").alias("y0"), p[2 * F.pmod(i + 1, n)].cast("double").alias("x1"), p[2 * F.pmod(i + 1, n) + 1].cast("double").alias("y1")))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("a", "x", "y", "mx", "my")])

    def step(acc, e):
        c = e["x0"] * e["y1"] - e["x1"] * e["y0"]
        return F.struct((acc["a"] + c).alias("a"), (acc["x"] + (e["x0"] + e["x1"]) * c).alias("x"), (acc["y"] + (e["y0"] + e["y1"]) * c).alias("y"), (acc["mx"] + e["x0"]).alias("mx"), (acc["my"] + e["y0"]).alias("my"))

    s = F.aggregate(ring, zero, step)
    own = rooms.withColumn("__s", F.when(n >= 3, s))
    thin = F.abs(F.col("__s.a")) < 1e-12
    centre = lambda c: F.when(thin, F.col(f"__s.m{c}") / n).otherwise(F.col(f"__s.{c}") / (3 * F.col("__s.a")))
    return own.withColumns({"area": F.abs(F.col("__s.a")) / 2, "cx": centre("x"), "cy": centre("y")}).drop("__s")


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """ray casting over a flat polygon array."""
    n = F.floor(F.size(polygon) / 2).cast("int")
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(polygon[2 * i].alias("x0"), polygon[2 * i + 1].alias("y0"), polygon[2 * F.pmod(i + 1, n)].alias("x1"), polygon[2 * F.pmod(i + 1, n) + 1].alias("y1")))
    crosses = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])
    return F.coalesce((n >= 3) & (F.size(F.filter(edges, crosses)) % 2 == 1), F.lit(False))


def smallest_room(points: DataFrame, rooms: DataFrame) -> DataFrame:
    """The room of least area (then least label) that holds each point (id, px, py). Rooms are a floor plan's, few."""
    own = polygon_measures(rooms).select("scan_id", "label", "area", "polygon2D")
    inside = points.join(own, "scan_id").filter(point_in_polygon(F.col("px"), F.col("py"), F.col("polygon2D")))
    best = inside.groupBy("scan_id", "id").agg(F.min(F.struct("area", "label")).alias("b")).select("scan_id", "id", F.col("b.label").alias("label"))
    return points.join(best, ["scan_id", "id"], "left")


def axial_mean(walls: DataFrame, keys: list[str]) -> DataFrame:
    """Length-weighted mean angle of axes modulo 90 degrees, radians."""
    return walls.groupBy(*keys).agg((F.atan2(F.sum(F.col("length") * F.sin(4 * F.col("angle"))), F.sum(F.col("length") * F.cos(4 * F.col("angle")))) / 4).alias("angle"))


def plan_summary(walls: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds, and upper medians of length, of thickness above 2 cm, and of height."""
    return walls.groupBy(*keys).agg(
        F.min(F.least("x0", "x1")).alias("min_x"), F.max(F.greatest("x0", "x1")).alias("max_x"), F.min(F.least("y0", "y1")).alias("min_y"), F.max(F.greatest("y0", "y1")).alias("max_y"),
        upper_median(F.col("length")).alias("length"), upper_median(F.when(F.col("thickness") > 0.02, F.col("thickness"))).alias("thickness"), upper_median(F.col("height")).alias("height"))


def exposure_range(frames: DataFrame) -> DataFrame:
    """A38."""
    return frames.groupBy("scan_id").agg((F.max("ev") - F.min("ev")).alias("ev_range"))


def centre_depth(samples: DataFrame, width: int, height: int, step: int = 8, reach: int = 2) -> DataFrame:
    """Upper median of the valid depths at (2 * reach + 1)**2 places around the centre."""
    near = lambda c, n: (F.abs(F.col(c) - n // 2) <= step * reach) & ((F.col(c) - n // 2) % step == 0)
    return samples.filter(near("u", width) & near("v", height) & (F.col("z") > 0)).groupBy("frame_id").agg(upper_median(F.col("z")).alias("depth"))


def visible_features(projected: DataFrame, width: int, height: int, most: int = 512, least_central: int = 6) -> DataFrame:
    """Per frame over at most ``most`` spread projections (u, v, z): count, distinct 3x3 cells, lower-quartile depth of the central ones."""
    from stereoloom.operators.sampling import stride_sample

    own = stride_sample(projected, most, ["id"], ["frame_id"])
    cell = F.floor(F.col("v") * 3 / height) * 3 + F.floor(F.col("u") * 3 / width)
    central = cell == 4
    out = own.groupBy("frame_id").agg(F.count("*").alias("features"), F.count_distinct(cell).alias("cells"), F.count_if(central).alias("central"), nearest_rank(F.when(central, F.col("z")), 0.25).alias("depth"))
    return out.withColumn("depth", F.when(F.col("central") >= least_central, F.col("depth")))


def diversity_bands(directions: DataFrame, keys: list[str], bucket: float = 0.5) -> DataFrame:
    """Exact widest angle per region over distinct direction buckets, and its band.

    Directions fall into buckets of ``bucket`` degrees first, so a region's
    pairs are bounded by the sphere's buckets, not by its views.
    """
    step = math.radians(bucket)
    own = directions.withColumns({"theta": F.floor(F.acos(clamp("dz", -1.0, 1.0)) / step), "phi": F.floor(F.atan2("dy", "dx") / step)})
    mid = own.select(*keys, "theta", "phi").distinct()
    t, p = (F.col("theta") + 0.5) * step, (F.col("phi") + 0.5) * step
    spots = mid.select(*keys, (F.sin(t) * F.cos(p)).alias("x"), (F.sin(t) * F.sin(p)).alias("y"), F.cos(t).alias("z"))
    pairs = spots.alias("a").join(spots.alias("b"), keys)
    cos = F.col("a.x") * F.col("b.x") + F.col("a.y") * F.col("b.y") + F.col("a.z") * F.col("b.z")
    angle = F.degrees(F.acos(clamp(F.min(cos), -1.0, 1.0)))
    out = pairs.groupBy(*keys).agg(angle.alias("span"))
    return out.withColumn("band", F.when(F.col("span") < 10, "<10").when(F.col("span") < 30, "<30").otherwise(">=30"))


def band_confusion(estimated: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """Regions by estimated and exact band."""
    band = F.when(F.col("span") < 10, "<10").when(F.col("span") < 30, "<30").otherwise(">=30")
    e = estimated.select(*keys, band.alias("estimated"))
    return e.join(exact.select(*keys, F.col("band").alias("exact")), keys).groupBy("estimated", "exact").agg(F.count("*").alias("regions"))


def render_report(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Share of pixels with transmittance above half, and of relative depth errors the median, p90 and share above 5 per cent."""
    relative = F.when(F.col("truth") > 0, F.abs(F.col("depth") - F.col("truth")) / F.col("truth"))
    own = pixels.withColumn("e", relative)
    return own.groupBy(*keys).agg(F.avg((F.col("transmittance") > 0.5).cast("int")).alias("uncovered"), F.percentile("e", F.lit(0.5)).alias("median"), F.percentile("e", F.lit(0.9)).alias("p90"), F.avg((F.col("e") > 0.05).cast("int")).alias("large"))


def extrapolation(frames: DataFrame, start: float = 0.25) -> DataFrame:
    """Distance and angle to the nearest training frame of each held-out frame (frames: + holdout)."""
    from stereoloom.operators.spatial import nearest
    from stereoloom.plans.durable import durable

    own = durable(frames.select("scan_id", F.struct("id", "dx", "dy", "dz").alias("ordinal"), "x", "y", "z", "holdout"), "held")  # an id with its direction, so that pairs are not joined back
    found = nearest(own.filter("holdout"), own.filter("not holdout"), 1, start)
    cos = sum((F.col(f"a.d{c}") * F.col(f"b.d{c}") for c in "yz"), F.col("a.dx") * F.col("b.dx"))
    return found.select("scan_id", F.col("a.id").alias("id"), F.col("b.id").alias("nearest"), "d", F.degrees(F.acos(clamp(cos, -1.0, 1.0))).alias("degrees"))


def splat_statistics(samples: DataFrame) -> DataFrame:
    """SP11: per splat: visibility sum, greatest error, edge sum, greatest share, views."""
    return samples.groupBy("row").agg(F.sum("visibility").alias("visibility"), F.max("error").alias("errorMax"), F.sum("edge").alias("edgeSum"), F.max("share").alias("shareMax"), F.count_if(F.col("visibility") > 0).alias("views"))
