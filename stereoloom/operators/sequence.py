"""Window and sequence operators over frames and grid lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_scan(*order: str):
    return Window.partitionBy("scan_id").orderBy(*(order or ("id",)))


def step_length(order=("id",)) -> Column:
    w = by_scan(*order)
    d = [F.col(c) - F.lag(c).over(w) for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def adjacent_differences(frames: DataFrame, jump: float = 0.5) -> DataFrame:
    """Step, dt, whether time went back or stood, whether the step is a jump."""
    dt = F.col("timestamp") - F.lag("timestamp").over(by_scan())
    return frames.withColumns({"step": step_length(), "dt": dt}).withColumns({"backwards": F.coalesce(F.col("dt") <= 0, F.lit(False)), "jump": F.coalesce(F.col("step") > jump, F.lit(False))})


def cumulative_travel(frames: DataFrame) -> DataFrame:
    """Path length up to each frame."""
    stepped = frames.withColumn("step", F.coalesce(step_length(), F.lit(0.0)))
    return stepped.withColumn("travel", F.sum("step").over(by_scan().rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("step")


def frame_velocity(frames: DataFrame, gap: float = 0.3, change: float = 0.8, fastest: float = 1.5) -> DataFrame:
    """N3, translation: central velocity of frames with steady neighbours, else the usable one-sided, else null.

    One-sided velocities over gaps of ``gap`` or more, faster than
    ``fastest`` or differing by more than ``change`` are refused.
    """
    w = by_scan("timestamp", "id")
    back_dt, next_dt = F.col("timestamp") - F.lag("timestamp").over(w), F.lead("timestamp").over(w) - F.col("timestamp")
    out = frames.withColumns({"bt": back_dt, "nt": next_dt, **{f"b{c}": F.try_divide(F.col(c) - F.lag(c).over(w), back_dt) for c in "xyz"}, **{f"n{c}": F.try_divide(F.lead(c).over(w) - F.col(c), next_dt) for c in "xyz"}})
    speed = lambda p: F.sqrt(F.col(f"{p}x") ** 2 + F.col(f"{p}y") ** 2 + F.col(f"{p}z") ** 2)
    b_ok = F.coalesce((F.col("bt") > 0) & (F.col("bt") < gap) & (speed("b") <= fastest), F.lit(False))
    n_ok = F.coalesce((F.col("nt") > 0) & (F.col("nt") < gap) & (speed("n") <= fastest), F.lit(False))
    diff = F.sqrt(sum(((F.col(f"n{c}") - F.col(f"b{c}")) ** 2 for c in "yz"), (F.col("nx") - F.col("bx")) ** 2))
    pick = lambda c: F.when(b_ok & n_ok, F.when(diff <= change, (F.col(f"b{c}") * F.col("bt") + F.col(f"n{c}") * F.col("nt")) / (F.col("bt") + F.col("nt")))).when(b_ok, F.col(f"b{c}")).when(n_ok, F.col(f"n{c}"))
    return out.withColumns({f"v{c}": pick(c) for c in "xyz"}).drop("bt", "nt", *[f"{p}{c}" for p in "bn" for c in "xyz"])


def runs(cells: DataFrame, line: str, place: str, gap: int = 2, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Runs of cells along a line; a new run starts where more than ``gap`` cells are missing.

    Gives per run: keys, line, run, first, last, cells.
    """
    w = Window.partitionBy(*keys, line).orderBy(place)
    start = F.when(F.col(place) - F.lag(place).over(w) > gap + 1, 1).otherwise(0)
    flagged = cells.withColumn("__s", start)
    numbered = flagged.withColumn("run", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, line, "run").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("cells"))


def run_direction(cells: DataFrame, gap: int = 0, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Per cell (i, j) the length of its run along i and along j and the longer direction (ties: horizontal)."""
    def length(line, place, name):
        w = Window.partitionBy(*keys, line).orderBy(place)
        start = F.when(F.col(place) - F.lag(place).over(w) > gap + 1, 1).otherwise(0)
        return lambda df: df.withColumn("__s", start).withColumn("__r", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(name, F.count("*").over(Window.partitionBy(*keys, line, "__r"))).drop("__s", "__r")

    both = length("i", "j", "vertical")(length("j", "i", "horizontal")(cells))
    return both.withColumn("direction", F.when(F.col("horizontal") >= F.col("vertical"), "horizontal").otherwise("vertical"))


def openings(cells: DataFrame, cell: float, keys: tuple[str, ...] = ("wall_id",), narrow: float = 0.40, door: tuple[float, float] = (0.55, 1.60), widest: float = 3.50) -> DataFrame:
    """Door, window or unknown gaps of a wall.

    cells: keys, place, low, middle, high (occupied height bands). A column
    with all bands is solid; without low and middle it votes door, without
    middle but with low it votes window. Adjacent columns that are not solid
    form a gap; the majority decides and the width must fit.
    """
    kind = F.when(F.col("low") & F.col("middle"), "solid").when(~F.col("low") & ~F.col("middle"), "door").when(F.col("low") & ~F.col("middle"), "window").otherwise("unknown")
    gaps = cells.withColumn("kind", kind).filter("kind <> 'solid'")
    w = Window.partitionBy(*keys).orderBy("place")
    runs_ = gaps.withColumn("__s", F.when(F.col("place") - F.lag("place").over(w) > 1, 1).otherwise(0)).withColumn("run", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    agg = runs_.groupBy(*keys, "run").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count_if(F.col("kind") == "door").alias("doors"), F.count_if(F.col("kind") == "window").alias("windows"), F.count("*").alias("n"))
    width = (F.col("last") - F.col("first") + 1) * F.lit(cell)
    label = F.when((F.col("doors") * 2 > F.col("n")) & width.between(*door), "door").when((F.col("windows") * 2 > F.col("n")) & width.between(narrow, widest), "window").otherwise("unknown")
    return agg.select(*keys, "first", "last", width.alias("width"), label.alias("opening"))


def holdout_every(frames: DataFrame, n: int) -> DataFrame:
    """``holdout`` for every n-th frame of a scan, from the middle of the first n; none if that leaves nothing to hold out or train on."""
    i = F.row_number().over(by_scan()) - 1
    marked = frames.withColumn("holdout", i % n == n // 2)
    held = F.count_if("holdout").over(Window.partitionBy("scan_id"))
    total = F.count("*").over(Window.partitionBy("scan_id"))
    return marked.withColumn("holdout", F.col("holdout") & (held < total))


def track_holdout(observations: DataFrame) -> DataFrame:
    """Tracks whose number leaves 4 when divided by 5 are held out."""
    return observations.withColumn("holdout", F.pmod(F.col("track_id"), F.lit(5)) == 4)


def pose_continuity(frames: DataFrame, gap: float = 0.25, shift: float = 0.08, speed: float = 3.0) -> DataFrame:
    """W8 offline, translation: whether each frame continues the one before it."""
    w = by_scan("timestamp", "id")
    dt = F.col("timestamp") - F.lag("timestamp").over(w)
    ok = (F.col("dt") > 0) & (F.col("dt") <= gap) & (F.col("step") <= F.greatest(F.lit(shift), speed * F.col("dt")))
    return frames.withColumns({"dt": dt, "step": step_length(("timestamp", "id"))}).withColumn("continuous", F.coalesce(ok, F.lit(False)))


def pacing_buckets(frames: DataFrame, photos: int = 100, stall: float = 0.05) -> DataFrame:
    """Per bucket of photos: frames, stalls and the longest gap."""
    w = by_scan("timestamp", "id")
    own = frames.withColumns({"dt": F.col("timestamp") - F.lag("timestamp").over(w), "bucket": F.floor((F.row_number().over(w) - 1) / photos)})
    return own.groupBy("scan_id", "bucket").agg(F.count("*").alias("frames"), F.count_if(F.col("dt") > stall).alias("stalls"), F.max("dt").alias("longest"))


def budgeted_fifo(tiles: DataFrame, budget: int, most: int = 8) -> DataFrame:
    """The first tiles in line whose points fit the budget; the first always goes."""
    w = Window.partitionBy("scan_id").orderBy("queued", "tile_id")
    own = tiles.withColumns({"place": F.row_number().over(w), "used": F.sum("points").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return own.filter((F.col("place") <= most) & ((F.col("place") == 1) | (F.col("used") <= budget)))


def strictly_later(frames: DataFrame, max_blur: float | None = None) -> DataFrame:
    """frames in id order whose time passes every kept frame's, after missing images and blurred frames are gone."""
    own = frames.filter("imageFile is not null")
    if max_blur is not None:
        own = own.filter(F.col("blur") <= max_blur)
    before = F.max("timestamp").over(by_scan().rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn("__b", before).filter(F.col("__b").isNull() | (F.col("timestamp") > F.col("__b"))).drop("__b")


def rpe_pairs(path: DataFrame, window: float) -> DataFrame:
    """For each frame the first frame whose path length is ``window`` or more beyond its own.

    path: scan_id, id, travel. By path buckets: a frame looks in its target's
    bucket and, if that holds nothing further on, takes the next bucket's
    first frame.
    """
    bucket = lambda c: F.floor(c / window).cast("long")
    own = path.withColumn("goal", F.col("travel") + window)
    seen = path.select("scan_id", F.col("id").alias("j"), F.col("travel").alias("tj"), bucket(F.col("travel")).alias("k"))
    firsts = seen.groupBy("scan_id", "k").agg(F.min(F.struct("tj", "j")).alias("f"))
    after = Window.partitionBy("scan_id").orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    ahead = firsts.withColumn("next", F.first("f", ignorenulls=True).over(after))
    every = own.withColumn("k", bucket(F.col("goal")))
    inside = every.join(seen, ["scan_id", "k"]).filter(F.col("tj") >= F.col("goal")).groupBy("scan_id", "id").agg(F.min(F.struct("tj", "j")).alias("inside"))
    # the last bucket at or before the goal's knows the next one that holds a frame
    grid = ahead.select("scan_id", "k", "next").unionByName(every.join(ahead.select("scan_id", "k"), ["scan_id", "k"], "left_anti").select("scan_id", "k").distinct().withColumn("next", F.lit(None).cast(ahead.schema["next"].dataType)))
    back = Window.partitionBy("scan_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = grid.withColumn("next", F.last("next", ignorenulls=True).over(back))
    out = every.join(inside, ["scan_id", "id"], "left").join(filled, ["scan_id", "k"], "left").withColumn("hit", F.coalesce("inside", "next"))
    return out.filter((F.col("hit").isNotNull()) & (F.col("hit.tj") >= F.col("goal"))).select("scan_id", F.col("id").alias("i"), F.col("hit.j").alias("j"), (F.col("hit.tj") - F.col("travel")).alias("length"))


def front_to_back(pairs: DataFrame, keys: list[str], least: float = 1e-4) -> DataFrame:
    """Transmittance before each splat and its blending weight; splats behind ``least`` add nothing."""
    w = Window.partitionBy(*keys).orderBy("depth", "row").rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce(F.exp(F.sum(F.log(1 - F.col("alpha"))).over(w)), F.lit(1.0))
    return pairs.withColumn("transmittance", t).withColumn("weight", F.when(F.col("transmittance") >= least, F.col("transmittance") * F.col("alpha")).otherwise(0.0))


def stability_gate(events: DataFrame, seconds: float = 0.6, gap: float = 0.25, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """W4 over a table: ``open`` after ``seconds`` of normal tracking without a break (a step that is not forward, or longer than ``gap``)."""
    w = Window.partitionBy("scan_id").orderBy(*order)
    step = F.col("timestamp") - F.lag("timestamp").over(w)
    goes_on = F.col("normal") & F.coalesce(F.lag("normal").over(w), F.lit(False)) & F.coalesce((step > 0) & (step <= gap), F.lit(False))
    runs = events.withColumn("goes_on", goes_on).withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w))
    since = F.first("timestamp").over(Window.partitionBy("scan_id", "run").orderBy(*order))
    return runs.withColumn("open", F.coalesce(F.col("normal") & (F.col("timestamp") - since >= seconds), F.lit(False))).drop("goes_on", "run")


def previous_views(events: DataFrame, longest: float = 0.5, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """W6 over a table: (scan_id, timestamp, view_id, previous_id) where the view before is of the same epoch and at most ``longest`` old."""
    w = Window.partitionBy("scan_id").orderBy(*order)
    seen = events.withColumns({"previous_id": F.lag("view_id").over(w), "was": F.lag("epoch").over(w), "step": F.col("timestamp") - F.lag("timestamp").over(w)})
    return seen.filter((F.col("was") == F.col("epoch")) & (F.col("step") > 0) & (F.col("step") <= longest)).select("scan_id", "timestamp", "view_id", "previous_id")


def fenced(events: DataFrame, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """W14 over a table: events whose epoch is not older than the newest so far."""
    w = Window.partitionBy("scan_id").orderBy(*order)
    return events.withColumn("newest", F.max("epoch").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("epoch") >= F.col("newest")).drop("newest")
