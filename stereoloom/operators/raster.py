"""Depth and luma rasters: per-frame kernels in NumPy, relational joins on pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stereoloom.functions import geometry as g
from stereoloom.functions.numeric import clamp, is_finite, upper_median

NEAR, FAR = 0.15, 5.0


def depth_samples(rasters: DataFrame) -> DataFrame:
    """IO5: pixels of depth rasters (scan_id, frame_id, width, height, depth float32 LE, conf uint8) whose byte counts fit; others are left out."""
    fit = rasters.filter((F.length("depth") == F.col("width") * F.col("height") * 4) & (F.length("conf") == F.col("width") * F.col("height")))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = row["width"] * row["height"]
                at = np.arange(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["scan_id"]] * n, pa.string()), pa.array(np.full(n, row["frame_id"], dtype=np.int32)), pa.array(at % row["width"]), pa.array(at // row["width"]),
                    pa.array(np.frombuffer(row["depth"], dtype="<f4")), pa.array(np.frombuffer(row["conf"], dtype=np.uint8).astype(np.int32))], names=["scan_id", "frame_id", "u", "v", "z", "conf"])

    return fit.select("scan_id", "frame_id", "width", "height", "depth", "conf").mapInArrow(run, "scan_id string, frame_id int, u int, v int, z float, conf int")


def with_neighbours(samples: DataFrame, columns: tuple[str, ...] = ("z", "conf")) -> DataFrame:
    """The four neighbours' values as ``z_l, z_r, z_u, z_d`` and so on, null where the pixel is missing."""
    row, column = Window.partitionBy("scan_id", "frame_id", "v").orderBy("u"), Window.partitionBy("scan_id", "frame_id", "u").orderBy("v")
    new = {}
    for name, f, w, axis, sign in (("l", F.lag, row, "u", -1), ("r", F.lead, row, "u", 1), ("u", F.lag, column, "v", -1), ("d", F.lead, column, "v", 1)):
        for c in columns:
            new[f"{c}_{name}"] = F.when(f(axis).over(w) - F.col(axis) == sign, f(c).over(w))
    return samples.withColumns(new)


def accepted(samples: DataFrame, camera: g.Camera, jump: float = 0.05, steepest: float = 80.0) -> DataFrame:
    """samples in range whose four neighbours are confident and near in depth and whose surface is not too steep.

    Adds the camera-space normal nx, ny, nz (towards the camera) and the
    weight cosine squared. ``camera`` refers to columns of ``samples``.
    """
    own = with_neighbours(samples)
    z = F.col("z").cast("double")
    ok = is_finite("z") & (z > NEAR) & (z < FAR) & (F.col("conf") >= 1)
    for n in "lrud":
        ok = ok & is_finite(f"z_{n}") & (F.col(f"conf_{n}") >= 1) & (F.abs(F.col(f"z_{n}").cast("double") - z) <= jump * z)
    at = lambda du, dv, d: ((F.col("u") + du - camera.cx) / camera.fx * d, -(F.col("v") + dv - camera.cy) / camera.fy * d, -d)
    sub = lambda p, q: [a - b for a, b in zip(p, q, strict=True)]
    a = sub(at(1, 0, F.col("z_r").cast("double")), at(-1, 0, F.col("z_l").cast("double")))
    b = sub(at(0, 1, F.col("z_d").cast("double")), at(0, -1, F.col("z_u").cast("double")))
    n = [b[1] * a[2] - b[2] * a[1], b[2] * a[0] - b[0] * a[2], b[0] * a[1] - b[1] * a[0]]
    size = F.sqrt(g.dot(n, n))
    p = at(0, 0, z)
    cos = -g.dot(n, p) / (size * F.sqrt(g.dot(p, p)))
    sign = F.when(cos < 0, -1.0).otherwise(1.0)
    out = own.filter(ok).withColumns({"__cos": F.abs(cos), "nx": n[0] / size * sign, "ny": n[1] / size * sign, "nz": n[2] / size * sign})
    kept = out.filter(F.col("__cos") >= float(np.cos(np.radians(steepest)))).withColumn("weight", F.col("__cos") * F.col("__cos"))
    return kept.drop("__cos", *[f"{c}_{n}" for c in ("z", "conf") for n in "lrud"])


def feature_depths(features: DataFrame, samples: DataFrame, spread: float = 0.03) -> DataFrame:
    """features (scan_id, frame_id, id, u, v, variance) with a confident 3x3 depth patch within ``spread`` and textured; bilinear depth.

    Nine pixels are joined by equality.
    """
    base = features.filter("variance > 1").withColumns({"bu": F.floor("u").cast("int"), "bv": F.floor("v").cast("int")})
    offsets = F.array(*[F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    wanted = base.withColumn("o", F.explode(offsets)).select("scan_id", "frame_id", "id", "u", "v", "bu", "bv", "o.du", "o.dv", (F.col("bu") + F.col("o.du")).alias("pu"), (F.col("bv") + F.col("o.dv")).alias("pv"))
    s = samples.select("scan_id", "frame_id", F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("z").cast("double").alias("z"), "conf")
    got = wanted.join(s, ["scan_id", "frame_id", "pu", "pv"]).filter(is_finite("z") & (F.col("conf") >= 2))
    fu, fv = F.col("u") - F.col("bu"), F.col("v") - F.col("bv")
    w = F.when(F.col("du").isin(0, 1) & F.col("dv").isin(0, 1), F.when(F.col("du") == 0, 1 - fu).otherwise(fu) * F.when(F.col("dv") == 0, 1 - fv).otherwise(fv)).otherwise(0.0)
    out = got.groupBy("scan_id", "frame_id", "id").agg(F.count("*").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.sum(w * F.col("z")).alias("depth"))
    return out.filter((F.col("n") == 9) & (F.col("hi") - F.col("lo") <= spread * F.col("lo")) & F.col("depth").between(NEAR, FAR)).select("scan_id", "frame_id", "id", "depth")


def textured(pixels: DataFrame, keys: list[str], least: float = 0.012, one_way: float = 0.05) -> DataFrame:
    """patches (keys, gx, gy, luma) of enough spread whose gradients are not all one way (smaller eigenvalue above a share of the larger)."""
    m = pixels.groupBy(*keys).agg(F.stddev_pop("luma").alias("std"), F.sum(F.col("gx") ** 2).alias("a"), F.sum(F.col("gx") * F.col("gy")).alias("b"), F.sum(F.col("gy") ** 2).alias("c"))
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)
    return m.withColumns({"small": half - root, "large": half + root}).filter((F.col("std") >= least) & (F.col("small") > one_way * F.col("large"))).select(*keys, "std", "small", "large")


def raster_lookup(points: DataFrame, views: DataFrame, samples: DataFrame, base: float = 0.015, slope: float = 0.005) -> DataFrame:
    """What reference views say of points: ``supported``, ``occluded``, ``contradicted`` or ``unobserved``.

    points: scan_id, ordinal, x, y, z, view_id (the view to ask). views:
    scan_id, view_id, pose, intrinsics. samples: scan_id, frame_id, u, v, z.
    The bilinear depth needs all four pixels, found by equality. Adds the
    signed residual (measured minus projected depth).
    """
    v = views.select("scan_id", "view_id", "pose", "intrinsics")
    j = points.join(v, ["scan_id", "view_id"])
    camera = g.Camera.of("intrinsics")
    seen = j.withColumn("p", g.project(camera, F.col("pose"), (F.col("x"), F.col("y"), F.col("z"))))
    corner = F.array(*[F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a in (0, 1) for b in (0, 1)])
    quad = seen.filter("p is not null").select("scan_id", "view_id", "ordinal", "p", F.explode(corner).alias("o"))
    pixel = quad.select("*", (F.floor("p.u").cast("int") + F.col("o.du")).alias("pu"), (F.floor("p.v").cast("int") + F.col("o.dv")).alias("pv"))
    s = samples.select("scan_id", F.col("frame_id").alias("view_id"), F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("z").cast("double").alias("m"))
    fu, fv = F.col("p.u") - F.floor("p.u"), F.col("p.v") - F.floor("p.v")
    w = F.when(F.col("o.du") == 0, 1 - fu).otherwise(fu) * F.when(F.col("o.dv") == 0, 1 - fv).otherwise(fv)
    got = pixel.join(s.filter(is_finite("m") & (F.col("m") > 0)), ["scan_id", "view_id", "pu", "pv"]).groupBy("scan_id", "view_id", "ordinal").agg(F.count("*").alias("n"), F.sum(w * F.col("m")).alias("measured"), F.first("p.z").alias("depth"))
    residual, tolerance = F.col("measured") - F.col("depth"), base + slope * F.col("depth")
    state = F.when(F.coalesce(F.col("n"), F.lit(0)) < 4, "unobserved").when(F.abs(residual) <= tolerance, "supported").when(residual < 0, "occluded").otherwise("contradicted")
    return points.join(got, ["scan_id", "view_id", "ordinal"], "left").withColumns({"state": state, "residual": residual}).drop("n", "measured", "depth")


def consistent(lookups: DataFrame, least: int = 2) -> DataFrame:
    """C4: points with at least ``least`` supports and more supports than contradictions."""
    c = lookups.groupBy("scan_id", "ordinal").agg(F.count_if(F.col("state") == "supported").alias("supports"), F.count_if(F.col("state") == "contradicted").alias("contradictions"))
    return c.filter((F.col("supports") >= least) & (F.col("supports") > F.col("contradictions")))


def depth_consensus(lookups: DataFrame, views: int = 2, largest: float = 0.02) -> DataFrame:
    """Shift of each supported point: the upper median of 0 and the agreeing views' residuals, with three votes or more (else 0)."""
    votes = F.filter(F.collect_list(F.when((F.col("state") == "supported") & (F.abs("residual") <= largest), F.col("residual"))), lambda r: r.isNotNull())
    c = lookups.groupBy("scan_id", "ordinal").agg(F.count("*").alias("asked"), F.count_if(F.col("state") == "supported").alias("supports"), F.count_if(F.col("state") == "contradicted").alias("contradictions"), F.array_sort(F.concat(F.array(F.lit(0.0)), votes)).alias("votes"))
    enough = (F.col("supports") >= F.least(F.lit(views), F.col("asked"))) & (F.col("supports") > F.col("contradictions"))
    middle = F.element_at("votes", (F.floor(F.size("votes") / 2) + 1).cast("int"))
    return c.filter(enough).select("scan_id", "ordinal", "supports", "contradictions", F.when(F.size("votes") >= 3, middle).otherwise(0.0).alias("shift"))


def visibility_validated(points: DataFrame, lookups: DataFrame, protect: int = 2, refute: int = 3, most: float = 0.10) -> tuple[DataFrame, bool]:
    """Points without those that views refute; nothing is removed if more than ``most`` would be. The flag says whether the step applied."""
    c = lookups.groupBy("scan_id", "ordinal").agg(F.count_if(F.col("state") == "supported").alias("s"), F.count_if(F.col("state") == "contradicted").alias("c"))
    gone = c.filter((F.col("s") < protect) & (F.col("c") >= refute)).select("scan_id", "ordinal")
    total, away = points.count(), gone.count()
    if away > most * total:
        return points, False
    return points.join(gone, ["scan_id", "ordinal"], "left_anti"), True


def mesh_visible(vertices: DataFrame, lookups: DataFrame, within: float = 0.10, factor: float = 0.25) -> DataFrame:
    """F8: mesh vertices that some view measures within ``within`` of their depth; their score counts a quarter."""
    seen = lookups.filter(F.abs("residual") <= within).select("scan_id", "ordinal").distinct()
    return vertices.join(seen, ["scan_id", "ordinal"], "left_semi").withColumn("score", F.col("score") * factor)


def cross_checked(matches: DataFrame, keys: list[str], stride: int = 1, relative: float = 0.01, least: int = 2) -> DataFrame:
    """Depths that at least ``least`` neighbour maps confirm (reprojection within stride + 1 px and 1 per cent of depth); the mean of those and the own one.

    matches: keys, depth, reprojection_error, other_depth.
    """
    agree = (F.col("reprojection_error") <= stride + 1) & (F.abs(F.col("other_depth") - F.col("depth")) <= relative * F.col("depth"))
    c = matches.filter(agree).groupBy(*keys, "depth").agg(F.count("*").alias("n"), F.sum("other_depth").alias("s"))
    return c.filter(F.col("n") >= least).select(*keys, "n", ((F.col("s") + F.col("depth")) / (F.col("n") + 1)).alias("depth"))


def _frame_kernel(rasters: DataFrame, kernel, schema: str) -> DataFrame:
    """A kernel over each frame's luma (frame_id, width, height, luma uint8 bytes): it gets a float array and yields column dicts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["luma"] is None or len(row["luma"]) != row["width"] * row["height"]:
                    continue
                image = np.frombuffer(row["luma"], dtype=np.uint8).reshape(row["height"], row["width"]).astype(np.float64)
                out = kernel(image)
                n = len(next(iter(out.values())))
                yield pa.RecordBatch.from_pydict({"frame_id": pa.array(np.full(n, row["frame_id"], dtype=np.int64))} | {k: pa.array(v) for k, v in out.items()})

    return rasters.select("frame_id", "width", "height", "luma").mapInArrow(run, "frame_id long, " + schema)


def cell_energy(image: np.ndarray, cell: int = 16) -> dict:
    """Per full cell: squared gradient over squared mean less the noise's part (Immerkaer), 0 for clipped or dark cells."""
    h, w = image.shape[0] // cell * cell, image.shape[1] // cell * cell
    x = image[:h, :w]
    gy, gx = np.gradient(image)
    energy = (gx**2 + gy**2)[:h, :w]
    lap = np.zeros_like(image)
    lap[1:-1, 1:-1] = image[:-2, :-2] + image[:-2, 2:] + image[2:, :-2] + image[2:, 2:] - 2 * (image[:-2, 1:-1] + image[2:, 1:-1] + image[1:-1, :-2] + image[1:-1, 2:]) + 4 * image[1:-1, 1:-1]
    sigma = np.sqrt(np.pi / 2) / 6 * np.abs(lap[1:-1, 1:-1]).mean()
    blocks = lambda a: a.reshape(h // cell, cell, w // cell, cell).mean((1, 3))
    mean, raw = blocks(x), blocks(energy)
    bad = (blocks((x >= 250).astype(float)) > 0.1) | (mean < 16)
    value = np.where(bad, 0.0, np.maximum(0.0, raw - sigma**2) / np.maximum(mean, 1) ** 2)
    gy_, gx_ = np.indices(value.shape)
    return {"i": gy_.reshape(-1), "j": gx_.reshape(-1), "energy": value.reshape(-1)}


def cell_energies(rasters: DataFrame, cell: int = 16) -> DataFrame:
    return _frame_kernel(rasters, lambda image: cell_energy(image, cell), "i long, j long, energy double")


def corner_response(image: np.ndarray, stride: int = 2) -> dict:
    """Smaller eigenvalue of the 3x3-summed structure tensor on a stride grid, edges extended."""
    gy, gx = np.gradient(image / 255.0)

    def box(a):
        p = np.pad(a, 1, mode="edge")
        return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3))

    a, b, c = box(gx * gx), box(gx * gy), box(gy * gy)
    r = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    v, u = np.mgrid[0 : image.shape[0] : stride, 0 : image.shape[1] : stride]
    return {"u": u.reshape(-1), "v": v.reshape(-1), "response": r[::stride, ::stride].reshape(-1)}


def corner_responses(rasters: DataFrame, stride: int = 2) -> DataFrame:
    return _frame_kernel(rasters, lambda image: corner_response(image, stride), "u long, v long, response double")


def suppressed(corners: DataFrame, least: float, apart: float, most: int, stride: int = 2) -> DataFrame:
    """Local maxima on the grid, then the strongest first with ``apart`` grid units between them, at most ``most`` a frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf.response >= least]
        at = {(u, v): r for u, v, r in zip(pdf.u // stride, pdf.v // stride, pdf.response, strict=True)}
        peak = [r >= max(at.get((u + a, v + b), -1.0) for a in (-1, 0, 1) for b in (-1, 0, 1)) for u, v, r in zip(pdf.u // stride, pdf.v // stride, pdf.response, strict=True)]
        pdf = pdf[peak].sort_values(["response", "v", "u"], ascending=[False, True, True])
        taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
        keep, size = [], max(1, int(np.ceil(apart)))
        for u, v in zip(pdf.u // stride, pdf.v // stride, strict=True):
            cell = (u // size, v // size)
            near = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in taken.get((cell[0] + a, cell[1] + b), ()))
            ok = len(keep) - keep.count(False) < most and all((u - p) ** 2 + (v - q) ** 2 >= apart * apart for p, q in near)
            keep.append(ok)
            if ok:
                taken.setdefault(cell, []).append((u, v))
        return pdf[keep] if len(pdf) else pdf

    return corners.groupBy("frame_id").applyInPandas(run, corners.schema)


def covisible_differences(cells: DataFrame, targets: DataFrame, ratio: float = 1.25, depth: float = 0.05) -> DataFrame:
    """Log energy difference of a cell and the peer's cell it projects to, where depths and scales agree.

    targets: frame_id, i, j, peer_id, pi, pj, depth, peer_depth, scale.
    """
    a = cells.select("frame_id", "i", "j", F.col("energy").alias("e"))
    b = cells.select(F.col("frame_id").alias("peer_id"), F.col("i").alias("pi"), F.col("j").alias("pj"), F.col("energy").alias("pe"))
    ok = (F.abs(F.col("depth") - F.col("peer_depth")) <= depth * F.col("depth")) & F.col("scale").between(1 / ratio, ratio) & (F.col("e") > 0) & (F.col("pe") > 0)
    return targets.join(a, ["frame_id", "i", "j"]).join(b, ["peer_id", "pi", "pj"]).filter(ok).select("frame_id", "peer_id", (F.log("e") - F.log("pe")).alias("difference"))


def covisible_weights(differences: DataFrame, strength: float = 1.0, floor: float = 0.2) -> DataFrame:
    """Weight of each frame from the deficit at the 80th percentile (nearest rank) of its peers' median differences."""
    from stereoloom.functions.numeric import nearest_rank

    pair = differences.groupBy("frame_id", "peer_id").agg(upper_median(-F.col("difference")).alias("deficit"))
    out = pair.groupBy("frame_id").agg(F.count("*").alias("peers"), nearest_rank(F.col("deficit"), 0.8).alias("deficit"))
    return out.withColumn("weight", F.greatest(F.lit(floor), F.exp(-strength * F.greatest(F.col("deficit"), F.lit(0.0)))))


def ssim(pairs: DataFrame, keys: list[str], peak: float = 1.0) -> DataFrame:
    """SSIM of blocks (keys, a, b): by the blocks' moments, one aggregate."""
    m = pairs.groupBy(*keys).agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.covar_pop("a", "b").alias("c"))
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    ma, mb = F.col("ma"), F.col("mb")
    value = (2 * ma * mb + c1) * (2 * F.col("c") + c2) / ((ma * ma + mb * mb + c1) * (F.col("va") + F.col("vb") + c2))
    return m.select(*keys, value.alias("ssim"))


def in_range(c: Column) -> Column:
    return is_finite(c) & (c > NEAR) & (c < FAR)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("np", "pd", "pa", "F", "g", "clamp")]
