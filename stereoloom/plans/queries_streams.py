"""Live state machines replayed over the event view, and numeric kernels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stereoloom.operators import kernels, sequence
from stereoloom.plans import adapters as ad
from stereoloom.plans.queries_files import folder
from stereoloom.plans.registry import query, r6
from stereoloom.streaming import landmarks, state

FR = ad.CTES["frames"]


def events(spark, sf):
    """Frames with times shrunk ten-thousandfold, so that live thresholds apply."""
    fr = ad.frames(spark, sf)
    return fr.select("scan_id", "id", (F.col("timestamp") / 10_000).alias("timestamp"), "x", "y", "z", F.atan2("dy", "dx").alias("yaw"), "dx", "dy", "dz", F.abs("z").alias("depth"), (F.col("id") % 5 == 0).alias("camera_only"), (F.col("id") % 9 * 60).cast("int").alias("width"), F.lit(180).alias("height"), F.lit(None).cast("double").alias("gyro_timestamp"), F.lit(0.0).alias("gyro_rate"),
                     F.abs("dz").alias("sharpness"), (F.col("kind") == "error").alias("severe"), (F.col("kind") != "error").alias("normal"), (F.col("kind") == "view").alias("photo"), F.col("id").alias("view_id"),
                     (F.col("id") / 2000).cast("int").alias("epoch"), F.col("kind"), (F.col("blur") / 100).alias("seconds"), F.col("blur").alias("loss"), (F.col("blur") * 2).alias("psnr"))


def machine(name):
    def run(spark, sf):
        return state.replay(events(spark, sf), state.MACHINES[name], order=("timestamp", "id"))

    return run


W14 = f"WITH {FR}, e AS (SELECT scan_id, id, timestamp, CAST(trunc(id/2000::DOUBLE) AS INT) AS epoch FROM frames), m AS (SELECT *, max(epoch) OVER (PARTITION BY scan_id ORDER BY timestamp, id) AS top FROM e) SELECT scan_id, count(*) AS n FROM m WHERE epoch >= top GROUP BY scan_id"
W4 = f"""WITH {FR}, e AS (SELECT scan_id, id, timestamp/10000 AS t, kind <> 'error' AS ok FROM frames), p AS (SELECT *, lag(t) OVER w AS pt, lag(ok) OVER w AS pok FROM e WINDOW w AS (PARTITION BY scan_id ORDER BY t, id)),
 s AS (SELECT *, CASE WHEN ok AND (pt IS NULL OR NOT pok OR NOT (t-pt > 0 AND t-pt <= 0.25::DOUBLE)) THEN 1 WHEN NOT ok THEN 1 ELSE 0 END AS st FROM p), g AS (SELECT *, sum(st) OVER (PARTITION BY scan_id ORDER BY t, id) AS run FROM s), o AS (SELECT scan_id, ok AND t - min(t) OVER (PARTITION BY scan_id, run) >= 0.6::DOUBLE AS open FROM g)
 SELECT scan_id, count(*) AS n, count(*) FILTER (open) AS open_ FROM o GROUP BY scan_id"""
W6 = f"WITH {FR}, e AS (SELECT scan_id, id, timestamp/10000 AS t, CAST(trunc(id/2000::DOUBLE) AS INT) AS epoch FROM frames), p AS (SELECT *, lag(t) OVER w AS pt, lag(id) OVER w AS pid, lag(epoch) OVER w AS pe FROM e WINDOW w AS (PARTITION BY scan_id ORDER BY t, id)) SELECT scan_id, id AS view_id, pid AS previous_id FROM p WHERE pe = epoch AND t-pt > 0 AND t-pt <= 0.5::DOUBLE"


@query("w4_stability_gate", W4)
def w4(spark, sf):
    return sequence.stability_gate(events(spark, sf), order=("timestamp", "id")).groupBy("scan_id").agg(F.count("*").alias("n"), F.count_if("open").alias("open_"))


@query("w6_previous_view", W6)
def w6(spark, sf):
    return sequence.previous_views(events(spark, sf), order=("timestamp", "id")).select("scan_id", "view_id", "previous_id")


@query("w14_epoch_fence", W14)
def w14(spark, sf):
    return sequence.fenced(events(spark, sf), order=("timestamp", "id")).groupBy("scan_id").agg(F.count("*").alias("n"))


#: Events with their place in their scan, for oracles that step from one to the next.
EVENTS = f"""{FR}, ev AS (SELECT scan_id, id, timestamp/10000 AS t, x, y, z, atan2(dy, dx) AS yaw, abs(z) AS depth, id % 5 = 0 AS alone, abs(dz) AS sharp, kind = 'error' AS severe, kind, blur/100 AS seconds, blur AS loss, blur*2 AS psnr, id % 9 * 60 AS width,
 row_number() OVER (PARTITION BY scan_id ORDER BY timestamp, id) AS n FROM frames)"""
W2 = f"""WITH RECURSIVE {EVENTS}, s AS (SELECT scan_id, n, t, sharp AS peak, sharp FROM ev WHERE n = 1
 UNION ALL SELECT e.scan_id, e.n, e.t, greatest(e.sharp, s.peak * CASE WHEN e.severe THEN 1 ELSE pow(0.97::DOUBLE, 60*greatest(0, least(0.25::DOUBLE, e.t - s.t))) END), e.sharp FROM s JOIN ev e ON e.scan_id = s.scan_id AND e.n = s.n + 1)
 SELECT scan_id, n, round(CASE WHEN peak > 1e-6::DOUBLE THEN sharp/peak ELSE 1 END, 6) AS ratio FROM s"""
W3 = f"""WITH RECURSIVE {EVENTS}, s AS (SELECT scan_id, n, t AS lt, x AS lx, y AS ly, z AS lz, yaw AS lyaw, true AS captured FROM ev WHERE n = 1
 UNION ALL SELECT scan_id, n, CASE WHEN due THEN t ELSE lt END, CASE WHEN due THEN x ELSE lx END, CASE WHEN due THEN y ELSE ly END, CASE WHEN due THEN z ELSE lz END, CASE WHEN due THEN yaw ELSE lyaw END, due FROM (
  SELECT *, t - lt >= 0.1::DOUBLE AND (NOT alone OR moved >= 0.04::DOUBLE) AND (moved >= CASE WHEN depth > 0 THEN least(0.05::DOUBLE, greatest(CASE WHEN alone THEN 0.04::DOUBLE ELSE 0.02::DOUBLE END, depth*0.05::DOUBLE)) ELSE 0.05::DOUBLE END OR degrees(least(turn, 2*pi() - turn)) >= 3) AS due FROM (
  SELECT e.*, s.lt, s.lx, s.ly, s.lz, s.lyaw, sqrt((e.x-lx)*(e.x-lx)+(e.y-ly)*(e.y-ly)+(e.z-lz)*(e.z-lz)) AS moved, abs(e.yaw - lyaw) AS turn FROM s JOIN ev e ON e.scan_id = s.scan_id AND e.n = s.n + 1)))
 SELECT scan_id, count(*) AS n, count(*) FILTER (captured) AS captured FROM s GROUP BY scan_id"""
W9 = f"""WITH RECURSIVE {EVENTS}, e9 AS (SELECT scan_id, id AS job, kind = 'view' AS done, row_number() OVER (PARTITION BY scan_id ORDER BY t, id) AS n FROM ev),
 s AS (SELECT scan_id, n, CASE WHEN NOT done THEN job END AS active, CAST(NULL AS BIGINT) AS waiting, 0 AS replaced, CASE WHEN NOT done THEN job END AS started FROM e9 WHERE n = 1
 UNION ALL SELECT e.scan_id, e.n, CASE WHEN done THEN waiting WHEN active IS NULL THEN job ELSE active END, CASE WHEN NOT done AND active IS NOT NULL THEN job WHEN done THEN NULL ELSE waiting END, replaced + CASE WHEN NOT done AND active IS NOT NULL AND waiting IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN done THEN waiting WHEN active IS NULL THEN job END FROM s JOIN e9 e ON e.scan_id = s.scan_id AND e.n = s.n + 1)
 SELECT scan_id, started, replaced FROM s WHERE started IS NOT NULL"""
W11 = f"""WITH RECURSIVE {EVENTS}, f AS (SELECT scan_id, n, seconds, width, 180 AS height FROM ev),
 s AS (SELECT scan_id, n, 2 AS stride, 0 AS quick, 0 AS phase, 0 AS step, 0 AS spot FROM f WHERE n = 1
 UNION ALL SELECT scan_id, n, CASE WHEN seconds > 0.035::DOUBLE THEN least(6, stride+1) WHEN q = 12 THEN greatest(2, stride-1) ELSE stride END, CASE WHEN q = 12 THEN 0 ELSE q END, (phase % (w*w) + 1) % (w*w), w, phase % (w*w) FROM (
  SELECT e.scan_id, s.n + 1 AS n, s.stride, s.phase, e.seconds, CASE WHEN e.seconds < 0.0175::DOUBLE THEN s.quick + 1 ELSE 0 END AS q, CAST(list_min(list_filter(range(s.stride, s.stride + 200), lambda k: ((e.width + k - 1) // k) * ((e.height + k - 1) // k) <= 6000)) AS INT) AS w FROM s JOIN f e ON e.scan_id = s.scan_id AND e.n = s.n))
 SELECT scan_id, n - 1 AS n, step AS stride, spot % step AS x, spot // step AS y FROM s WHERE n > 1"""
W16 = f"""WITH RECURSIVE {EVENTS}, s AS (SELECT scan_id, n, loss, psnr FROM ev WHERE n = 1 UNION ALL SELECT e.scan_id, e.n, s.loss + 0.1::DOUBLE*(e.loss - s.loss), s.psnr + 0.1::DOUBLE*(e.psnr - s.psnr) FROM s JOIN ev e ON e.scan_id = s.scan_id AND e.n = s.n + 1)
 SELECT scan_id, n, round(loss, 6) AS loss, round(psnr, 6) AS psnr FROM s"""


def in_order(df):
    """Rows of a replay with their place in their scan; times are distinct in a scan but for rare ties, which the machines take in order of id."""
    w = Window.partitionBy("scan_id").orderBy("timestamp")
    return df.withColumn("n", F.row_number().over(w).cast("long"))


@query("w1_motion_estimator", None)
def w1(spark, sf):
    return machine("w1")(spark, sf)


@query("w2_sharpness_reference", W2)
def w2(spark, sf):
    return in_order(machine("w2")(spark, sf)).select("scan_id", "n", r6(F.col("ratio")).alias("ratio"))


@query("w3_smart_shutter", W3)
def w3(spark, sf):
    return machine("w3")(spark, sf).groupBy("scan_id").agg(F.count("*").alias("n"), F.count_if("captured").alias("captured"))


@query("w5_revisit_guide", None)
def w5(spark, sf):
    return machine("w5")(spark, sf)


@query("w11_adaptive_stride", W11)
def w11(spark, sf):
    return in_order(machine("w11")(spark, sf)).select("scan_id", "n", "stride", "x", "y")


@query("w16_running_average", W16)
def w16(spark, sf):
    return in_order(machine("w16")(spark, sf)).select("scan_id", "n", r6(F.col("loss")).alias("loss"), r6(F.col("psnr")).alias("psnr"))


@query("w7_landmark_admission", None)
def w7(spark, sf):
    own = ad.frames(spark, sf).select(F.pmod("id", F.lit(100)).alias("scan_id"), (F.col("timestamp") / 100_000).alias("time"), F.lit(0).alias("epoch"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(-2.0).alias("z"), (F.col("x") / 4).alias("cam_x"), (F.col("y") / 4).alias("cam_y"), (F.col("z") / 4).alias("cam_z"))
    return state.replay(own, state.LandmarkAdmission, order=("time", "cam_x"))


def scan_samples(spark, sf):
    """Every frame of a scan sees eight of 776 landmarks; a fifth of them wander."""
    fr = ad.frames(spark, sf).withColumn("landmark_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.col("id") * (i + 1), F.lit(97)).cast("long") + 100 * i)))
    wander = F.when(F.col("landmark_id") % 5 == 0, F.col("dx") / 4).otherwise(F.col("dx") / 500)
    return fr.select("scan_id", "landmark_id", (F.col("timestamp") / 100_000).alias("time"), (F.col("id") / 2000).cast("int").alias("epoch"), wander.alias("x"), F.lit(0.0).alias("y"), F.lit(-2.0).alias("z"), (F.col("x") / 4).alias("cam_x"), (F.col("y") / 4).alias("cam_y"), (F.col("z") / 4).alias("cam_z"))


@query("w7_scan_landmarks", None)
def w7_scan(spark, sf):
    return landmarks.replay(scan_samples(spark, sf))


@query("w15_resumed_log", W4)
def w15(spark, sf):
    """A capture log of JSON lines, read by a streaming query that ends, is started again over the log's second half and goes on from its checkpoint."""
    own = events(spark, sf).select("scan_id", "id", "timestamp", "normal")
    middle = own.groupBy("scan_id").agg(F.percentile("timestamp", 0.5).alias("middle"))
    halves = own.join(middle, "scan_id").withColumn("late", F.col("timestamp") > F.col("middle")).drop("middle")
    log, out, at = (folder(spark, n) for n in ("log", "gate", "gate-state"))
    for late in (False, True):
        halves.filter(F.col("late") == late).drop("late").write.mode("append").json(log)
        state.run_available(state.stream(state.follow(spark, log, own.schema, None), state.StabilityGate, order=("timestamp", "id")), out, at)
    return spark.read.parquet(out).groupBy("scan_id").agg(F.count("*").alias("n"), F.count_if("open").alias("open_"))


@query("w9_conflating_queue", W9)
def w9(spark, sf):
    own = events(spark, sf).select("scan_id", "timestamp", F.when(F.col("kind") == "view", "done").otherwise("submit").alias("kind"), F.col("id").alias("job"))
    return state.replay(own, state.ConflatingQueue, order=("timestamp", "job")).select("scan_id", "started", "replaced")


@query("c26_pose_comparison", None)
def c26(spark, sf):
    own = ad.frames(spark, sf).select("scan_id", "id", "x", "y", "z", (-F.col("y") + 1).alias("rx"), (F.col("x") + 2).alias("ry"), (F.col("z") + F.pmod("id", F.lit(2)) * 0.01).alias("rz"))
    return kernels.pose_comparison(own).select("scan_id", "n", F.round("rmse", 5).alias("rmse"))


C12 = f"""WITH {FR}, m AS (SELECT id // 100 AS pair_id, x, y, z, (id // 100) % 3 AS kind, CASE WHEN (id // 100) % 3 = 1 THEN id % 5 = 0 WHEN (id // 100) % 3 = 2 THEN id % 2 = 0 ELSE false END AS off FROM frames),
 o AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS n, (row_number() OVER (PARTITION BY pair_id ORDER BY x, y, z) - 1) % 5 = 0 AS held FROM m),
 g AS (SELECT pair_id, n, count(*) FILTER (NOT held) AS fit, count(*) FILTER (NOT held AND NOT off) AS good, quantile_cont(CASE WHEN off THEN 1.05::DOUBLE ELSE 0.05::DOUBLE END, 0.5) FILTER (held) AS was, quantile_cont(CASE WHEN off THEN 1 ELSE 0 END, 0.5) FILTER (held) AS now, avg(CASE WHEN off THEN 0 ELSE 1 END) FILTER (held) AS close FROM o GROUP BY pair_id, n)
 SELECT pair_id, n >= 40 AND good >= 24 AND good*5 >= fit*3 AND now < 0.025::DOUBLE AND close >= 0.75::DOUBLE AS accepted FROM g"""


@query("c12_revisit_verification", C12)
def c12(spark, sf):
    """A hundred frames a pair, moved by 5 cm; a fifth of each second pair and half of each third moved by a metre more."""
    pair = F.expr("id div 100")
    off = F.when(pair % 3 == 1, F.col("id") % 5 == 0).when(pair % 3 == 2, F.col("id") % 2 == 0).otherwise(False)
    own = ad.frames(spark, sf).select(pair.alias("pair_id"), "x", "y", "z", (F.col("x") + 0.05 + F.when(off, 1.0).otherwise(0.0)).alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"))
    return kernels.revisit_verification(own).select("pair_id", "accepted")


@query("c13_pose_graph", None)
def c13(spark, sf):
    fr = ad.frames(spark, sf).select("scan_id", "id", "timestamp", (F.col("kind") != "error").alias("usable"))
    ends = fr.filter("usable").groupBy("scan_id").agg(F.min_by("id", "timestamp").alias("a"), F.max_by("id", "timestamp").alias("b")).select("scan_id", "a", "b", *[F.lit(0.1 * i).alias(f"c{i}") for i in range(6)])
    return kernels.pose_graph(fr, ends).select("scan_id", "id", r6(F.col("c1")).alias("c1"))


@query("c14_photometric_gate", f"""WITH {FR}, m AS (SELECT scan_id, id % 5 AS pair_id, x AS r, x + 0.2::DOUBLE*y AS b, x + 0.1::DOUBLE*y AS a, abs(z) AS g FROM frames), s AS (SELECT *, quantile_cont(g, 0.7) OVER (PARTITION BY scan_id, pair_id) AS cut FROM m),
 p AS (SELECT scan_id, pair_id, corr(r, a) - corr(r, b) AS change FROM s WHERE g >= cut GROUP BY scan_id, pair_id), o AS (SELECT scan_id, count(*) AS pairs, quantile_cont(change, 0.5) AS mid, avg(CASE WHEN change <= -0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS lost FROM p WHERE change IS NOT NULL AND NOT isnan(change) GROUP BY scan_id)
 SELECT scan_id, pairs, pairs >= 3 AND mid >= 0 AND lost <= 0.2::DOUBLE AS accepted FROM o""")
def c14(spark, sf):
    own = ad.frames(spark, sf).select("scan_id", F.pmod("id", F.lit(5)).alias("pair_id"), F.col("x").alias("reference"), (F.col("x") + 0.2 * F.col("y")).alias("before"), (F.col("x") + 0.1 * F.col("y")).alias("after"), F.abs("z").alias("gradient"))
    return kernels.photometric_gate(own).select("scan_id", "pairs", "accepted")


@query("c11_plane_icp", f"WITH {FR} SELECT id // 100 AS window_id, true AS accepted, 0.02::DOUBLE AS tx, 0.0::DOUBLE AS ty, -0.01::DOUBLE AS tz FROM frames GROUP BY 1")
def c11(spark, sf):
    own = ad.frames(spark, sf).select(F.expr("id div 100").alias("window_id"), "x", "y", "z", (F.col("x") + 0.02).alias("rx"), F.col("y").alias("ry"), (F.col("z") - 0.01).alias("rz"), F.col("dx").alias("nx"), F.col("dy").alias("ny"), F.col("dz").alias("nz"))
    moved = lambda i: (F.round(F.col("motion")[i], 4) + 0.0)  # noqa: E731  no negative zero
    return kernels.plane_icp(own).select("window_id", "accepted", *[moved(9 + i).alias(f"t{c}") for i, c in enumerate("xyz")])
