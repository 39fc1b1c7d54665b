"""Splat refinement between training windows: what is useless goes, its place goes to splats that fit badly, and these split.

Every choice is a ranking by keys hashed from the row, so it depends on no
order; the numbers that bound the choices are aggregates. Splats stay a table
throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stereoloom.functions import capture as cp
from stereoloom.functions.numeric import hash_uniform
from stereoloom.operators.sampling import numbered as numbered_rows
from stereoloom.plans.durable import durable

SCALES = ("s0", "s1", "s2")
QUAT = ("qw", "qx", "qy", "qz")


@dataclass(frozen=True)
class RefineRules:
    """Shares, logits and window counts; ``capacity`` is what a model may hold, ``ceiling`` what it may hold now."""

    capacity: int
    ceiling: int
    step: int = 0
    iterations: int = 10_000
    grow_until: int = 5_000
    stop_refine: int = 8_500
    most_share: float = 0.3
    edge_weight: float = 0.25
    grow_error: float = 0.003
    grow_fraction: float = 0.07
    oversize_fraction: float = 0.15
    least_views: float = 3.0
    low_share: float = 0.02
    low_windows: int = 2
    most_moved: float = 0.005
    opacity_decay: float = 0.004
    scale_decay: float = 0.002
    seed: int = 0


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def _first(df: DataFrame, wanted: Column, order: Column, most: int) -> DataFrame:
    """``row`` of the ``most`` rows of least ``order``; rows are numbered by ranges, so none of them meet in one task."""
    return numbered_rows(df.filter(wanted).select("row", order.alias("place")), [F.col("place"), F.col("row")]).filter(F.col("__i") < most).select("row")


def _drawn(weight: Column, salt: int, seed: int) -> Column:
    """Order of a draw without replacement: Gumbel keys of the weights, the largest first."""
    u = hash_uniform(F.lit(seed * 8 + salt), "row")
    return F.log(-F.log(u)) - F.log(weight)


def refine_window(splats: DataFrame, extent: float, rules: RefineRules) -> tuple[DataFrame, dict[str, int]]:
    """SP4: the model after one refinement, and how many splats each part of it took.

    splats: row (long), x, y, z, s0..s2 (log scales), qw..qz, opacity (logit),
    and the window's statistics: visibility, error_max, error_sum, share_max,
    edge_sum, views, low_windows (nulls read as 0).

    1. The largest axis of a splat that fills more than ``most_share`` of an
       image shrinks, by a third at most. 2. Splats without use or sense go
       (``splat_prunable``). 3. At the ceiling, splats that in ``low_windows``
       windows in a row gave under ``low_share`` of the median blending weight
       are given up, the least first: at most ``most_moved`` of the model, less
       as training ends, and no more than there are badly fitting splats.
       4. As many splats as went are drawn by opacity, as many as were given up
       by error a view; while the model grows, ``grow_fraction`` of the erring
       ones more, some of them for their size. A splat is drawn once.
       5. A drawn splat splits along its largest axis: both halves move half a
       scale, shrink and fade. 6. All fade and shrink a little.

    Halves of splat r are rows 2 r and 2 r + 1, others become 2 r; the
    statistics of new halves are 0 and ``low_windows`` goes on counting.
    """
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("visibility", "error_max", "error_sum", "share_max", "edge_sum", "views")}
    own = splats.withColumns(zero | {"low_windows": F.coalesce("low_windows", F.lit(0))})
    largest = F.greatest(*SCALES)
    axis = F.when(F.col("s0") == largest, 0).when(F.col("s1") == largest, 1).otherwise(2)
    cut = F.when(F.col("share_max") > rules.most_share, F.least(F.log(F.col("share_max") / rules.most_share), F.log(F.lit(1.5)))).otherwise(0.0)
    own = own.withColumns({"axis": axis, "cut": cut}).withColumns({s: F.col(s) - F.when(F.col("axis") == i, F.col("cut")).otherwise(0.0) for i, s in enumerate(SCALES)}).drop("cut")

    norm = F.sqrt(sum((F.col(c) ** 2 for c in QUAT[1:]), F.col(QUAT[0]) ** 2))
    away = F.greatest(F.abs("x"), F.abs("y"), F.abs("z"))
    own = own.withColumns({"quat_norm": norm, "scale_max": F.greatest(*SCALES), "distance": away})
    gone = F.coalesce(cp.splat_prunable("opacity", "quat_norm", "scale_max", "distance", F.lit(extent)), F.lit(True))
    own = durable(own.withColumn("gone", gone).drop("quat_norm", "scale_max", "distance"), "splats")
    alive = own.filter("not gone").drop("gone")

    middle = F.percentile(F.when(F.col("edge_sum") > 0, F.col("edge_sum")), F.lit(0.5))
    judged = F.col("views") >= rules.least_views
    share = F.percentile(F.when(judged, F.col("visibility") / F.col("views")), F.lit(0.5))
    facts = own.agg(F.count_if("gone").alias("pruned"), F.count_if(~F.col("gone")).alias("live")).first()
    medians = alive.agg(middle.alias("edge"), share.alias("share")).first()
    guidance = 1.0 + (rules.edge_weight * F.col("edge_sum") / medians.edge if medians.edge else F.lit(0.0))
    low = judged & (F.col("visibility") / F.greatest("views", F.lit(1e-12)) < rules.low_share * (medians.share or 0.0))
    alive = alive.withColumns({"guidance": guidance, "low_windows": F.when(low, F.col("low_windows") + 1).when(judged, 0).otherwise(F.col("low_windows")), "low": low})
    receives = judged & ~F.col("low") & (F.col("visibility") > 0) & (F.col("error_sum") > F.col("visibility"))
    alive = durable(alive.withColumn("receives", receives), "alive")

    counts = {"pruned": facts.pruned, "relocated": 0, "replaced": 0, "oversize": 0, "grown": 0}
    given_up = None
    if facts.live + facts.pruned >= rules.ceiling and rules.step < rules.stop_refine and medians.share:
        receivers = alive.filter("receives").count()
        limit = min(int(facts.live * rules.most_moved * max(0.0, 1 - rules.step / max(1, rules.stop_refine))), receivers)
        given_up = durable(_first(alive, F.col("low") & (F.col("low_windows") >= rules.low_windows), F.col("visibility") / F.greatest("views", F.lit(1e-12)), limit), "given_up")
        counts["relocated"] = given_up.count()
        alive = durable(alive.join(given_up, "row", "left_anti"), "kept")

    budget, parents = max(0, rules.ceiling - (facts.live - counts["relocated"])), None

    def draw(name: str, wanted: Column, weight: Column, most: int, salt: int) -> int:
        """Draws among those not drawn yet; returns how many there were."""
        nonlocal parents
        if most <= 0:
            return 0
        pool = alive if parents is None else alive.join(parents, "row", "left_anti")
        some = durable(_first(pool, wanted & (weight > 0), _drawn(weight, salt, rules.seed), most), name)
        parents = some if parents is None else parents.unionByName(some)
        return some.count()

    seen = F.col("visibility") > 0
    counts["replaced"] = draw("replaced", seen, sigmoid(F.col("opacity")) * F.col("guidance"), min(facts.pruned, budget), 1)
    budget -= counts["replaced"]
    budget -= draw("relocated", F.col("receives"), F.col("error_sum") / F.greatest("views", F.lit(1e-12)) * F.col("guidance"), min(counts["relocated"], budget), 2)
    if rules.step < rules.grow_until and budget > 0:
        erring = seen & (F.col("error_max") > rules.grow_error)
        grow = max(0, min(round(alive.filter(erring).count() * rules.grow_fraction) - counts["replaced"], budget))
        wide = F.col("share_max") > rules.most_share
        error = F.col("error_max") * F.col("guidance")
        counts["oversize"] = draw("oversize", wide, F.sqrt(error) * F.col("share_max") / rules.most_share, round(rules.oversize_fraction * grow), 3)
        counts["grown"] = draw("grown", erring, error, grow - counts["oversize"], 4)

    drawn = alive.join(parents.withColumn("split", F.lit(True)), "row", "left") if parents is not None else alive.withColumn("split", F.lit(None).cast("boolean"))
    return _faded(_split(drawn), rules), counts


def _split(drawn: DataFrame) -> DataFrame:
    side = F.explode(F.when(F.col("split"), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(0))))
    both = drawn.withColumn("side", side).withColumn("axis", F.when(F.col("s0") == F.greatest(*SCALES), 0).when(F.col("s1") == F.greatest(*SCALES), 1).otherwise(2))
    n = F.sqrt(sum((F.col(c) ** 2 for c in QUAT[1:]), F.col(QUAT[0]) ** 2))
    w, x, y, z = (F.col(c) / n for c in QUAT)
    columns = ((1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)), (2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)), (2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)))
    along = [F.when(F.col("axis") == 0, columns[0][i]).when(F.col("axis") == 1, columns[1][i]).otherwise(columns[2][i]) for i in range(3)]
    half = F.col("side") * 0.5 * F.exp(F.greatest(*SCALES))
    both = both.withColumns({f"m{c}": F.col(c) + half * along[i] for i, c in enumerate("xyz")})
    is_half = F.col("side") != 0
    faded = F.greatest(F.least(0.6 * sigmoid(F.col("opacity")), F.lit(1 - 1e-7)), F.lit(1e-7))
    both = both.withColumns(
        {s: F.col(s) + F.when(is_half, F.log(F.when(F.col("axis") == i, 0.5).otherwise(0.85))).otherwise(0.0) for i, s in enumerate(SCALES)}
        | {"opacity": F.when(is_half, logit(faded)).otherwise(F.col("opacity")), "row": F.col("row") * 2 + F.when(F.col("side") == -1, 1).otherwise(0)}
        | {"low_windows": F.when(is_half, 0).otherwise(F.col("low_windows"))} | {c: F.col(f"m{c}") for c in "xyz"}
    )
    return both.drop("side", "split", "axis", "guidance", "low", "receives", "mx", "my", "mz")


def _faded(splats: DataFrame, rules: RefineRules) -> DataFrame:
    left = 1 - rules.step / rules.iterations
    o = F.greatest(sigmoid(F.col("opacity")) - rules.opacity_decay * left, F.lit(1e-12))
    out = splats.withColumns({"opacity": logit(o)} | {s: F.log(F.greatest(F.exp(s) * (1 - rules.scale_decay * left), F.lit(1e-12))) for s in SCALES})
    return out.withColumns({c: F.lit(0.0) for c in ("visibility", "error_max", "error_sum", "share_max", "edge_sum", "views")})


def numbered(splats: DataFrame) -> DataFrame:
    """Rows counted anew from 0 in order of ``row``, so that doubling in each refinement stays within 64 bits.

    Counts of blocks of rows are added up; no window runs over the whole model.
    """
    block = F.expr("row div 65536")
    sizes = splats.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "start")
    within = F.row_number().over(Window.partitionBy("block").orderBy("row")) - 1
    return splats.withColumn("block", block).join(starts, "block").withColumn("row", (F.col("start") + within).cast("long")).drop("block", "start")
