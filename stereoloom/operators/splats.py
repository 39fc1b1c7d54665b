"""Splat-model operators: initialisation, refinement steps, quantisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stereoloom.functions import capture as cp
from stereoloom.functions.numeric import clamp, hash_uniform, upper_median
from stereoloom.operators.sampling import gumbel_top_k
from stereoloom.operators.spatial import nearest

SH_ZERO = 0.2820948


def initialise(points: DataFrame, median_size: float, radius: float, rings: int = 8) -> DataFrame:
    """SP1: log scale from the mean of the two nearest distances, opacity logit 0, zeroth harmonic from the colour.

    Points (scan_id, ordinal, x, y, z, r, g, b with colours 0 to 255). Points
    with fewer than two neighbours in reach get log scale 0.
    """
    near = nearest(points, points, 2, radius, rings, same_table=True)
    sums = near.groupBy("scan_id", F.col("a").alias("ordinal")).agg(F.sum("d").alias("s"), F.count("*").alias("k"))
    scale = F.when(F.col("k") == 2, F.log(clamp(F.col("s") / 4, 1e-3, 0.1 * median_size))).otherwise(0.0)
    sh = lambda c: ((F.col(c) / 255.0 - 0.5) / SH_ZERO).alias(f"sh_{c}")
    return points.join(sums, ["scan_id", "ordinal"], "left").select("scan_id", "ordinal", "x", "y", "z", scale.alias("log_scale"), F.lit(0.0).alias("opacity"), sh("r"), sh("g"), sh("b"))


def jittered(points: DataFrame, spacing: float, seed: int = 0, most: float = 0.03) -> DataFrame:
    """SP2: Gaussian jitter of each axis by Box-Muller over hashes of (seed, ordinal, axis); sigma is the spacing, at most 3 cm."""
    sigma = min(spacing, most)

    def normal(axis):
        u, v = hash_uniform(F.lit(seed), F.col("ordinal"), F.lit(axis)), hash_uniform(F.lit(seed + 1), F.col("ordinal"), F.lit(axis))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)

    return points.withColumns({c: F.col(c) + sigma * normal(c) for c in "xyz"})


def pruned(splats: DataFrame, extent: float) -> DataFrame:
    """SP3: splats that are worth keeping."""
    return splats.filter(~cp.splat_prunable("opacity", "quat_norm", "scale_max", "distance", F.lit(extent)))


def refine(splats: DataFrame, extent: float, grow: int, decay: float = 0.001, seed: int = 0, most_scale: float = 0.0) -> DataFrame:
    """SP4: one refinement: clip scales, prune, decay opacity, and split the ``grow`` splats drawn by error weight.

    A drawn splat is replaced by two children a third of its scale to either
    side along x, each with 0.8 of its scale. Children are numbered after
    twice the parent's row.
    """
    clipped = splats.withColumn("log_scale", F.least("log_scale", F.lit(most_scale)))
    alive = pruned(clipped, extent).withColumn("opacity", F.col("opacity") - decay)
    drawn = gumbel_top_k(alive, "error", grow, "row", seed).select("row").withColumn("__drawn", F.lit(True))
    both = alive.join(drawn, "row", "left")
    side = F.explode(F.when(F.col("__drawn"), F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = both.withColumn("__side", side)
    return out.withColumns({
        "x": F.col("x") + F.col("__side") * F.exp("log_scale") / 3,
        "row": F.col("row") * 2 + F.when(F.col("__side") == 1, 1).otherwise(0),
        "log_scale": F.col("log_scale") + F.when(F.col("__side") != 0, F.log(F.lit(0.8))).otherwise(0.0),
    }).drop("__drawn", "__side")


def quantised_means(splats: DataFrame, bits: int = 16) -> DataFrame:
    """SP5: log-transformed positions in 16-bit steps of their bounding box, with the box on every row."""
    logged = splats.withColumns({f"l{c}": cp.log_transform(c) for c in "xyz"})
    box = logged.agg(*[f(f"l{c}").alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    top = (1 << bits) - 1
    step = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.floor((F.col(f"l{c}") - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * top + 0.5)).otherwise(0).cast("int")
    return logged.join(F.broadcast(box)).withColumns({f"q{c}": step(c) for c in "xyz"}).drop("lx", "ly", "lz")  # one row is broadcast


def dequantised_means(quantised: DataFrame, bits: int = 16) -> DataFrame:
    top = float((1 << bits) - 1)
    return quantised.withColumns({c: cp.inverse_log_transform(F.col(f"lo_{c}") + F.col(f"q{c}") / top * (F.col(f"hi_{c}") - F.col(f"lo_{c}"))) for c in "xyz"})


def codebook_index(rows: DataFrame, value: str, book: list[float]) -> DataFrame:
    """SP6: nearest entry of a sorted codebook; the lower on a tie."""
    if len(book) < 2:
        return rows.withColumn("entry", F.lit(0))
    edges = F.array(*[F.lit((a + b) / 2) for a, b in zip(book, book[1:], strict=False)])
    return rows.withColumn("entry", F.size(F.filter(edges, lambda e: e < F.col(value))))


def flipped_frame(splats: DataFrame) -> DataFrame:
    """SP8: world turned by 180 degrees about X: y and z change sign, so do the quaternion's y and z parts; odd harmonics in y or z change too.

    quat is (w, x, y, z), sh1 the three first-order coefficients (y, z, x).
    """
    sign = lambda a, signs: F.zip_with(F.col(a), F.array(*[F.lit(float(s)) for s in signs]), lambda v, s: v * s)
    return splats.withColumns({"y": -F.col("y"), "z": -F.col("z"), "quat": sign("quat", (1, 1, -1, -1)), "sh1": sign("sh1", (-1, -1, 1))})


def hole_seeds(pixels: DataFrame, keys: list[str], most: int = 2000, open_: float = 0.4, wrong: float = 0.08) -> DataFrame:
    """SP9: pixels that the model leaves open and wrong, worst first, with their own depth or the median of their 16-pixel block."""
    block = [F.floor(F.col("u") / 16), F.floor(F.col("v") / 16)]
    own = pixels.withColumns({"bu": block[0], "bv": block[1]})
    local = own.groupBy(*keys, "bu", "bv").agg(upper_median(F.when(F.col("depth") > 0, F.col("depth"))).alias("local"))
    holes = own.filter((F.col("transmittance") > open_) & (F.col("error") > wrong)).join(local, [*keys, "bu", "bv"])
    seeded = holes.withColumn("seed_depth", F.when(F.col("depth") > 0, F.col("depth")).otherwise(F.col("local"))).filter("seed_depth is not null")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("error"), "v", "u"))
    return seeded.withColumn("rank", rank).filter(F.col("rank") <= most).drop("bu", "bv", "local")


def transient_mask(blocks: DataFrame, keys: list[str], factor: float = 3.0, least: float = 0.05) -> DataFrame:
    """SP10: blocks (keys, window, i, j, difference) that stand out beside another and do so in two windows running."""
    med = F.percentile("difference", F.lit(0.5)).over(Window.partitionBy(*keys, "window"))
    hot = blocks.withColumn("hot", F.col("difference") > F.greatest(F.lit(least), factor * med))
    offsets = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    near = hot.filter("hot").select(*keys, "window", "i", "j", F.explode(offsets).alias("o")).select(*keys, "window", (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j")).distinct().withColumn("near", F.lit(True))
    both = hot.join(near, [*keys, "window", "i", "j"], "left").withColumn("now", F.col("hot") & F.coalesce("near", F.lit(False)))
    w = Window.partitionBy(*keys, "i", "j").orderBy("window")
    before = (F.lag("window").over(w) == F.col("window") - 1) & F.lag("now").over(w)
    return both.withColumn("masked", F.col("now") & F.coalesce(before, F.lit(False))).drop("hot", "near", "now")


def dataset_signature(frames: DataFrame) -> DataFrame:
    """SP12: one SHA-256 a scan over all frames' digests (in place of a 64-bit FNV).

    Digests are combined in order of id within blocks of 4,096 ids, and the
    blocks' digests within the scan, so no row holds a whole scan's.
    """

    def combined(order: str):
        return F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(order, "__d"))), lambda s: s["__d"])), 256).alias("__d")

    own = frames.withColumns({"__d": F.sha2(F.to_json(F.struct(*sorted(frames.columns))), 256), "__block": F.floor(F.col("id") / 4096)})
    blocks = own.groupBy("scan_id", "__block").agg(combined("id"))
    return blocks.groupBy("scan_id").agg(combined("__block")).withColumnRenamed("__d", "signature")
