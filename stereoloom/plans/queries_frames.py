"""Queries over frames: sequences, frame joins, selection, state machines offline."""

from __future__ import annotations

from pyspark.sql import functions as F

from stereoloom.operators import graph, metrics, raster, sampling, sequence, spatial
from stereoloom.plans import adapters as ad
from stereoloom.plans import pipelines as pl
from stereoloom.plans.registry import query, r6

FR = ad.CTES["frames"]
P = ad.CTES["points"]
STEP = f"{FR}, st AS (SELECT *, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)+(z-lag(z) OVER w)*(z-lag(z) OVER w)) AS step, timestamp - lag(timestamp) OVER w AS dt FROM frames WINDOW w AS (PARTITION BY scan_id ORDER BY id))"
PIX = """pix AS (SELECT vec_id AS frame_id, CAST((i-1) % 8 AS INT) AS u, CAST((i-1) // 8 AS INT) AS v, 128 + 100*CAST(embedding[i] AS DOUBLE) AS luma, 1 + CAST(embedding[i] AS DOUBLE) AS z, CAST((vec_id + i) % 3 AS INT) AS conf FROM embeddings, (SELECT unnest(range(1, 65)) AS i) t)"""
NB = f"""{PIX}, nb AS (SELECT p.*, l.luma AS l, r.luma AS r, t.luma AS t, b.luma AS b FROM pix p LEFT JOIN pix l ON l.frame_id=p.frame_id AND l.v=p.v AND l.u=p.u-1 LEFT JOIN pix r ON r.frame_id=p.frame_id AND r.v=p.v AND r.u=p.u+1 LEFT JOIN pix t ON t.frame_id=p.frame_id AND t.u=p.u AND t.v=p.v-1 LEFT JOIN pix b ON b.frame_id=p.frame_id AND b.u=p.u AND b.v=p.v+1)"""


def pixels(spark, sf):
    """Eight by eight pixels from each vector."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("i", "e"))
    e = e.withColumn("e", F.col("e").cast("double"))
    return e.select(F.lit("s").alias("scan_id"), "frame_id", (F.col("i") % 8).cast("int").alias("u"), F.floor(F.col("i") / 8).cast("int").alias("v"), (128 + 100 * F.col("e")).alias("luma"), (1 + F.col("e")).alias("z"), ((F.col("frame_id") + F.col("i") + 1) % 3).cast("int").alias("conf"))


@query("n1_adjacent_difference", f"WITH {STEP} SELECT scan_id, count(*) AS frames, CAST(sum(CASE WHEN dt <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS backwards, CAST(sum(CASE WHEN step > 0.5::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS jumps, round(avg(step),6) AS step FROM st GROUP BY scan_id")
def n1(spark, sf):
    own = sequence.adjacent_differences(ad.frames(spark, sf))
    return own.groupBy("scan_id").agg(F.count("*").alias("frames"), F.count_if("backwards").alias("backwards"), F.count_if("jump").alias("jumps"), r6(F.avg("step")).alias("step"))


@query("n2_cumulative_travel", f"WITH {STEP} SELECT scan_id, id, round(sum(coalesce(step,0)) OVER (PARTITION BY scan_id ORDER BY id),5) AS travel FROM st")
def n2(spark, sf):
    return sequence.cumulative_travel(ad.frames(spark, sf)).select("scan_id", "id", F.round("travel", 5).alias("travel"))


@query("n3_frame_velocity", f"""WITH {FR}, t AS (SELECT *, timestamp/1000000 AS ts FROM frames), n AS (SELECT scan_id, id, x, ts, lag(ts) OVER w AS pt, lead(ts) OVER w AS nt, lag(x) OVER w AS px, lead(x) OVER w AS nx, lag(y) OVER w AS py, lead(y) OVER w AS ny, lag(z) OVER w AS pz, lead(z) OVER w AS nz, y, z FROM t WINDOW w AS (PARTITION BY scan_id ORDER BY ts, id)),
 v AS (SELECT *, ts-pt AS bt, nt-ts AS ft, (x-px)/(ts-pt) AS bx, (nx-x)/(nt-ts) AS fx, sqrt(((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)))/(ts-pt) AS bs, sqrt(((nx-x)*(nx-x)+(ny-y)*(ny-y)+(nz-z)*(nz-z)))/(nt-ts) AS fs FROM n),
 o AS (SELECT *, coalesce(bt > 0 AND bt < 0.3::DOUBLE AND bs <= 100, false) AS bo, coalesce(ft > 0 AND ft < 0.3::DOUBLE AND fs <= 100, false) AS fo FROM v)
 SELECT scan_id, id, round(CASE WHEN bo AND fo THEN (bx*bt+fx*ft)/(bt+ft) WHEN bo THEN bx WHEN fo THEN fx END,5) AS vx FROM o""")
def n3(spark, sf):
    """Times are shrunk a millionfold, since the events lie hours apart."""
    own = ad.frames(spark, sf).withColumn("timestamp", F.col("timestamp") / 1_000_000)
    return sequence.frame_velocity(own, change=1e9, fastest=100.0).select("scan_id", "id", F.round("vx", 5).alias("vx"))


CELLS2 = f"{P}, c2 AS (SELECT DISTINCT scan_id, {ad.cell_sql('x', 0.05)} AS i, {ad.cell_sql('z', 0.05)} AS j FROM points)"


def cells2(spark, sf):
    from stereoloom.functions import voxels as vx

    return ad.points(spark, sf).select("scan_id", vx.cell_index("x", 0.05).alias("i"), vx.cell_index("z", 0.05).alias("j")).distinct()


@query("n4_runs", f"WITH {CELLS2}, s AS (SELECT *, CASE WHEN j - lag(j) OVER w > 3 THEN 1 ELSE 0 END AS st FROM c2 WINDOW w AS (PARTITION BY scan_id, i ORDER BY j)), g AS (SELECT *, sum(st) OVER (PARTITION BY scan_id, i ORDER BY j) AS run FROM s) SELECT scan_id, i, min(j) AS first_, max(j) AS last_, count(*) AS cells FROM g GROUP BY scan_id, i, run")
def n4(spark, sf):
    return sequence.runs(cells2(spark, sf), "i", "j").select("scan_id", "i", F.col("first").alias("first_"), F.col("last").alias("last_"), "cells")


@query("n5_run_direction", f"""WITH {CELLS2}, a AS (SELECT *, j - row_number() OVER (PARTITION BY scan_id, i ORDER BY j) AS gv, i - row_number() OVER (PARTITION BY scan_id, j ORDER BY i) AS gh FROM c2), l AS (SELECT *, count(*) OVER (PARTITION BY scan_id, i, gv) AS vertical, count(*) OVER (PARTITION BY scan_id, j, gh) AS horizontal FROM a)
 SELECT scan_id, i, j, vertical, horizontal, CASE WHEN horizontal >= vertical THEN 'horizontal' ELSE 'vertical' END AS direction FROM l""")
def n5(spark, sf):
    return sequence.run_direction(cells2(spark, sf)).select("scan_id", "i", "j", "vertical", "horizontal", "direction")


@query("n6_openings", f"""WITH {CELLS2}, w AS (SELECT scan_id || ':' || i AS wall_id, j AS place, (i + j) % 3 = 0 AS low, (i * j) % 4 = 0 AS middle FROM c2), k AS (SELECT *, CASE WHEN NOT low AND NOT middle THEN 'door' WHEN low AND NOT middle THEN 'window' ELSE 'unknown' END AS kind FROM w WHERE NOT (low AND middle)),
 s AS (SELECT *, place - row_number() OVER (PARTITION BY wall_id ORDER BY place) AS run FROM k), g AS (SELECT wall_id, run, min(place) AS f, max(place) AS l, count(*) AS n, count(*) FILTER (kind='door') AS d, count(*) FILTER (kind='window') AS w FROM s GROUP BY wall_id, run)
 SELECT wall_id, f AS first_, l AS last_, CASE WHEN d*2 > n AND (l-f+1)*0.3::DOUBLE BETWEEN 0.55::DOUBLE AND 1.6::DOUBLE THEN 'door' WHEN w*2 > n AND (l-f+1)*0.3::DOUBLE BETWEEN 0.4::DOUBLE AND 3.5::DOUBLE THEN 'window' ELSE 'unknown' END AS opening FROM g""")
def n6(spark, sf):
    own = cells2(spark, sf).select(F.concat_ws(":", "scan_id", F.col("i").cast("string")).alias("wall_id"), F.col("j").alias("place"), ((F.col("i") + F.col("j")) % 3 == 0).alias("low"), ((F.col("i") * F.col("j")) % 4 == 0).alias("middle"), F.lit(True).alias("high"))
    return sequence.openings(own, 0.3).select("wall_id", F.col("first").alias("first_"), F.col("last").alias("last_"), "opening")


@query("n7_holdout_split", f"WITH {FR}, r AS (SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY id) - 1 AS i FROM frames) SELECT scan_id, id, i % 8 = 4 AS holdout FROM r")
def n7(spark, sf):
    return sequence.holdout_every(ad.frames(spark, sf), 8).select("scan_id", "id", "holdout")


@query("n9_percentile_reference", f"WITH {FR}, l AS (SELECT scan_id, list_sort(list(blur)) AS s FROM frames GROUP BY scan_id) SELECT scan_id, round(s[CAST(floor((len(s)-1)*0.75::DOUBLE+0.5::DOUBLE) AS BIGINT)+1],6) AS p75, round(s[len(s)//2+1],6) AS upper_, round((s[(len(s)+1)//2]+s[len(s)//2+1])/2,6) AS middle FROM l")
def n9(spark, sf):
    from stereoloom.functions.numeric import middle_median, nearest_rank, upper_median

    return ad.frames(spark, sf).groupBy("scan_id").agg(r6(nearest_rank(F.col("blur"), 0.75)).alias("p75"), r6(upper_median(F.col("blur"))).alias("upper_"), r6(middle_median(F.col("blur"))).alias("middle"))


@query("n12_rpe_windows", f"""WITH {STEP}, p AS (SELECT scan_id, id, sum(coalesce(step,0)) OVER (PARTITION BY scan_id ORDER BY id) AS travel FROM st), c AS (SELECT a.scan_id, a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.scan_id, a.id ORDER BY b.travel, b.id) AS rn FROM p a JOIN p b ON a.scan_id = b.scan_id AND b.travel >= a.travel + 5.0::DOUBLE)
 SELECT scan_id, i, j FROM c WHERE rn = 1""")
def n12(spark, sf):
    return sequence.rpe_pairs(sequence.cumulative_travel(ad.frames(spark, sf)).select("scan_id", "id", "travel"), 5.0).select("scan_id", "i", "j")


@query("f6_record_filter", f"WITH {FR}, a AS (SELECT * FROM frames WHERE kind <> 'error' AND blur <= 8), m AS (SELECT *, max(timestamp) OVER (PARTITION BY scan_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM a) SELECT scan_id, id FROM m WHERE b IS NULL OR timestamp > b")
def f6(spark, sf):
    own = ad.frames(spark, sf).withColumn("imageFile", F.when(F.col("kind") != "error", F.col("id").cast("string")))
    return sequence.strictly_later(own, 8.0).select("scan_id", "id")


NEAR = f"{FR}, near AS (SELECT a.scan_id, a.id AS a, b.id AS b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d, a.dx*b.dx+a.dy*b.dy+a.dz*b.dz AS cos, a.timestamp AS ta, b.timestamp AS tb, a.signature AS sa, b.signature AS sb FROM frames a JOIN frames b ON a.scan_id = b.scan_id AND a.id <> b.id)"


@query("j3_neighbour_frames", f"WITH {NEAR} SELECT scan_id, a, b, round(d,6) AS d FROM near WHERE d <= 0.6::DOUBLE AND cos >= cos(radians(30))")
def j3(spark, sf):
    return spatial.neighbour_frames(ad.frames(spark, sf), 0.6, 30.0).select("scan_id", "a", "b", r6(F.col("d")).alias("d"))


@query("j4_near_duplicate_views", f"WITH {NEAR} SELECT scan_id, a, b FROM near WHERE a < b AND d <= 1.2::DOUBLE AND cos >= cos(radians(40)) AND list_sum(list_transform(list_zip(sa, sb), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))/16 < 0.14::DOUBLE")
def j4(spark, sf):
    return spatial.near_duplicate_views(ad.frames(spark, sf), 1.2, 40.0, 0.14).select("scan_id", "a", "b")


@query("j5_reference_views", None)
def j5(spark, sf):
    return pl.reference_views(ad.frames(spark, sf), 0.1, 1.0, 0.5, ideal=0.4, apart=0.2)


@query("j8_revisit_candidates", f"""WITH {STEP}, t AS (SELECT scan_id, id, timestamp, x, y, z, dx, dy, dz, sum(coalesce(step,0)) OVER (PARTITION BY scan_id ORDER BY id) AS s, row_number() OVER (PARTITION BY scan_id ORDER BY id) AS i FROM st),
 c AS (SELECT a.scan_id, a.id AS a, b.id AS b, row_number() OVER (PARTITION BY b.scan_id, b.id ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), a.id) AS rn FROM t a JOIN t b ON a.scan_id = b.scan_id AND a.id <> b.id
 WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 0.8::DOUBLE AND a.dx*b.dx+a.dy*b.dy+a.dz*b.dz >= 0.5::DOUBLE AND b.i - a.i > 5 AND b.timestamp - a.timestamp >= 8 AND b.s - a.s >= 2)
 SELECT scan_id, a, b FROM c WHERE rn = 1""")
def j8(spark, sf):
    return spatial.revisit_candidates(ad.frames(spark, sf), cos=0.5, gap=5).select("scan_id", "a", "b")


@query("j12_pair_selection", f"""WITH {FR}, t AS (SELECT scan_id, id, x, y, z, timestamp/1000000 AS ts FROM frames), n AS (SELECT scan_id, id AS a, lead(id) OVER w AS b, lead(ts) OVER w - ts AS dt, sqrt((lead(x) OVER w - x)*(lead(x) OVER w - x)+(lead(y) OVER w - y)*(lead(y) OVER w - y)+(lead(z) OVER w - z)*(lead(z) OVER w - z)) AS d FROM t WINDOW w AS (PARTITION BY scan_id ORDER BY ts, id))
 SELECT scan_id, least(a,b) AS a, greatest(a,b) AS b FROM n WHERE b IS NOT NULL AND dt > 0 AND dt < 1 AND d > 0.005::DOUBLE""")
def j12(spark, sf):
    """The adjacent pairs, at times shrunk a millionfold; wide pairs have a sequential oracle in the tests."""
    own = ad.frames(spark, sf).withColumn("timestamp", F.col("timestamp") / 1_000_000)
    return spatial.pair_selection(own).filter("kind = 'adjacent'").select("scan_id", "a", "b")


@query("j13_source_views", None)
def j13(spark, sf):
    fr = ad.frames(spark, sf)
    samples = fr.select("scan_id", "id", *[(F.col(c) + F.col(f"d{c}")).alias(f"p{c}") for c in "xyz"])
    scores = spatial.source_view_scores(fr, samples)
    return pl.sources_apart(scores, fr).select("scan_id", "a", "b", r6(F.col("score")).alias("score"))


@query("j15_playback", "WITH img AS (SELECT o_orderkey AS name FROM orders WHERE o_orderkey % 3 = 0), rec AS (SELECT o_orderkey AS name, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0) SELECT img.name, rec.status FROM img LEFT JOIN rec USING (name)")
def j15(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    images = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("name"))
    return spatial.playback(images, o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("imageFile"), F.col("o_orderstatus").alias("status")))


@query("j19_raw_refined_join", "SELECT a.o_orderkey AS id, round(abs(a.o_totalprice - b.o_totalprice * 1.01::DOUBLE),4) AS moved FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey AND b.o_orderkey % 5 = 0")
def j19(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    refined = o.filter("id % 5 = 0").select("id", (F.col("x") * 1.01).alias("rx"))
    return o.join(refined, "id").select("id", F.round(F.abs(F.col("x") - F.col("rx")), 4).alias("moved"))


@query("io3_saved_records_merge", "WITH c AS (SELECT o_orderkey AS id, 'X' AS status, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 4 = 0) SELECT o_orderkey AS id, coalesce(c.status, o_orderstatus) AS status, round(CASE WHEN c.id IS NOT NULL THEN c.price ELSE o_totalprice END,2) AS price, c.id IS NOT NULL AS corrected, true AS incomplete FROM orders LEFT JOIN c ON c.id = o_orderkey")
def io3(spark, sf):
    raw = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    corrected = raw.filter("id % 4 = 0").select("id", F.lit("X").alias("status"), (F.col("price") + 1).alias("price"))
    return spatial.merged_records(raw, corrected, ["status", "price"]).withColumn("price", F.round("price", 2))


VERDICT = f"""{NEAR}, fr2 AS (SELECT *, abs(dx)*10 AS sharp FROM frames), peer AS (SELECT n.scan_id, n.a AS id, count(*) AS peers, list_sort(list(f.sharp)) AS s FROM near n JOIN fr2 f ON f.scan_id = n.scan_id AND f.id = n.b WHERE d <= 0.8::DOUBLE AND cos >= cos(radians(60)) AND f.sharp > 0 GROUP BY n.scan_id, n.a),
 j AS (SELECT f.scan_id, f.id, f.blur, f.sharp, peers, s[CAST(floor((len(s)-1)*0.75::DOUBLE+0.5::DOUBLE) AS BIGINT)+1] AS p75 FROM fr2 f LEFT JOIN peer USING (scan_id, id)),
 v AS (SELECT *, CASE WHEN coalesce(peers,0) >= 2 AND blur > 9 THEN 'drop' WHEN coalesce(peers,0) >= 2 AND (blur*0.5::DOUBLE > 3 OR sharp < 0.5::DOUBLE*p75) THEN 'demote' END AS verdict, greatest(blur/9, coalesce(1-sharp/p75, 0)) AS sev FROM j),
 r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY CASE verdict WHEN 'drop' THEN 0 WHEN 'demote' THEN 1 ELSE 2 END, sev DESC, id) AS rn, count(*) OVER (PARTITION BY scan_id) AS n FROM v)"""


@query("c1_blur_verdict", f"WITH {VERDICT} SELECT scan_id, id, CASE WHEN rn <= floor(n*0.3::DOUBLE) THEN coalesce(verdict, 'keep') ELSE 'keep' END AS verdict FROM r")
def c1(spark, sf):
    own = ad.frames(spark, sf).withColumns({"exposure_blur": F.col("blur") * 0.5, "sharpness": F.abs("dx") * 10})
    return pl.blur_verdicts(own, 0.8, 60.0, drop=9.0, demote=3.0).select("scan_id", "id", "verdict")


@query("k12_capped_rejection", f"WITH {FR}, v AS (SELECT scan_id, id, blur, CASE kind WHEN 'error' THEN 'drop' WHEN 'click' THEN 'demote' END AS verdict FROM frames), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY CASE verdict WHEN 'drop' THEN 0 WHEN 'demote' THEN 1 ELSE 2 END, blur DESC, id) AS rn, count(*) OVER (PARTITION BY scan_id) AS n FROM v) SELECT scan_id, id, CASE WHEN rn <= floor(n*0.3::DOUBLE) THEN coalesce(verdict,'keep') ELSE 'keep' END AS verdict FROM r")
def k12(spark, sf):
    verdict = F.when(F.col("kind") == "error", "drop").when(F.col("kind") == "click", "demote")
    own = ad.frames(spark, sf).select("scan_id", "id", verdict.alias("verdict"), F.col("blur").alias("severity"))
    return sampling.capped_rejection(own).select("scan_id", "id", "verdict")


@query("c2_training_selection", None)
def c2(spark, sf):
    own = ad.frames(spark, sf).withColumns({"detail": F.abs("dx"), "verdict": F.when(F.col("kind") == "error", "drop").otherwise("keep")})
    return pl.training_selection(own, 1.2, 40.0, 0.14)


@query("k14_evenly_spaced", f"WITH {FR}, r AS (SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY scan_id) AS n FROM frames), q AS (SELECT range AS q FROM range(12)) SELECT DISTINCT scan_id, id FROM r, q WHERE n <= 12 OR i = CAST(round_even(q*(n-1)/11::DOUBLE, 0) AS BIGINT)")
def k14(spark, sf):
    return sampling.evenly_spaced(ad.frames(spark, sf).select("scan_id", "id"), 12, ["id"], ["scan_id"])


@query("k20_two_stage_pick", f"WITH {FR}, n AS (SELECT scan_id AS query_id, id, blur*10 AS distance, abs(z) AS depth FROM frames WHERE blur*10 <= 18), m AS (SELECT *, min(distance) OVER (PARTITION BY query_id) AS m FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, distance, id) AS rn FROM m WHERE distance <= m + 2) SELECT query_id, id FROM r WHERE rn = 1")
def k20(spark, sf):
    own = ad.frames(spark, sf).select(F.col("scan_id").alias("query_id"), "id", (F.col("blur") * 10).alias("distance"), F.abs("z").alias("depth"))
    return sampling.two_stage_pick(own).select("query_id", "id")


@query("k21_spaced_references", None)
def k21(spark, sf):
    return pl.spaced_references(ad.frames(spark, sf), apart=0.5, most=12).select("scan_id", "id")


@query("k22_pilot_ordinals", f"WITH {FR}, r AS (SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY scan_id) AS n FROM frames), e AS (SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY scan_id) AS n FROM r WHERE i > 0 AND i < n-1 AND i % 8 <> 0), q AS (SELECT range AS q FROM range(9)) SELECT DISTINCT scan_id, id FROM e, q WHERE n <= 9 OR i = CAST(round_even(q*(n-1)/8::DOUBLE, 0) AS BIGINT)")
def k22(spark, sf):
    return sampling.pilot_ordinals(ad.frames(spark, sf).select("scan_id", "id"), 9)


@query("k19_corner_per_cell", f"WITH {FR}, c AS (SELECT scan_id AS frame_id, 120+x*30 AS u, 90+y*20 AS v, abs(z) AS response, id FROM frames WHERE kind <> 'view'), l AS (SELECT DISTINCT scan_id AS frame_id, CAST(least(floor((90+y*20)*12/180),11)*16 + least(floor((120+x*30)*16/240),15) AS INT) AS cell FROM frames WHERE kind = 'view'), k AS (SELECT *, CAST(least(floor(v*12/180),11)*16 + least(floor(u*16/240),15) AS INT) AS cell FROM c WHERE response >= 0.0002::DOUBLE), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, cell ORDER BY response DESC, v, u) AS rn FROM k ANTI JOIN l USING (frame_id, cell)) SELECT frame_id, cell, round(response,6) AS response FROM r WHERE rn = 1")
def k19(spark, sf):
    fr = ad.frames(spark, sf).select(F.col("scan_id").alias("frame_id"), (120 + F.col("x") * 30).alias("u"), (90 + F.col("y") * 20).alias("v"), F.abs("z").alias("response"), "kind")
    return sampling.corner_per_empty_cell(fr.filter("kind <> 'view'"), fr.filter("kind = 'view'"), 240, 180).select("frame_id", "cell", r6(F.col("response")).alias("response"))


@query("a21_trajectory", f"WITH {STEP}, t AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY id) AS i, count(*) OVER (PARTITION BY scan_id) AS n, first_value(x) OVER w AS sx, first_value(y) OVER w AS sy, first_value(z) OVER w AS sz FROM st WINDOW w AS (PARTITION BY scan_id ORDER BY id)), b AS (SELECT *, sqrt((x-sx)*(x-sx)+(y-sy)*(y-sy)+(z-sz)*(z-sz)) AS back FROM t) SELECT scan_id, count(*) AS frames, round(sum(coalesce(step,0)),5) AS path, round(max(back) FILTER (i = n),6) AS end_gap, round(min(back) FILTER (i*2 > n),6) AS nearest_return FROM b GROUP BY scan_id")
def a21(spark, sf):
    return metrics.trajectory(ad.frames(spark, sf)).select("scan_id", "frames", F.round("path", 5).alias("path"), r6(F.col("end_gap")).alias("end_gap"), r6(F.col("nearest_return")).alias("nearest_return"))


@query("a22_drift_summary", f"WITH {FR}, d AS (SELECT scan_id, abs(x)*0.01::DOUBLE AS d FROM frames WHERE id % 3 <> 0), l AS (SELECT scan_id, list_sort(list(d)) AS s FROM d GROUP BY scan_id) SELECT scan_id, CAST(len(s) AS BIGINT) AS n, round(s[len(s)//2+1],6) AS median, round(s[len(s)],6) AS largest FROM l")
def a22(spark, sf):
    raw = ad.frames(spark, sf)
    refined = raw.filter("id % 3 <> 0").withColumn("x", F.col("x") * 1.01)
    return metrics.drift_summary(raw, refined).select("scan_id", "n", r6(F.col("median")).alias("median"), r6(F.col("largest")).alias("largest"))


@query("a23_working_distance", f"WITH {PIX}, l AS (SELECT frame_id, list_sort(list(z)) AS s FROM pix WHERE u % 2 = 0 AND v % 2 = 0 AND conf >= 1 AND z > 0.1::DOUBLE GROUP BY frame_id) SELECT frame_id AS scan_id, round(s[len(s)//2+1],6) AS distance FROM l")
def a23(spark, sf):
    own = pixels(spark, sf).withColumn("scan_id", F.col("frame_id"))
    return metrics.working_distance(own, grid=2).select("scan_id", r6(F.col("distance")).alias("distance"))


@query("a29_signature", f"WITH {PIX} SELECT frame_id, CAST(v//2*4 + u//2 AS BIGINT) AS block, round(avg(luma),6) AS mean FROM pix GROUP BY frame_id, v//2*4 + u//2")
def a29(spark, sf):
    s = metrics.signature(pixels(spark, sf), 8, 8, 4, 4)
    return s.select("frame_id", F.posexplode("signature").alias("block", "mean")).select("frame_id", F.col("block").cast("long").alias("block"), r6(F.col("mean")).alias("mean"))


@query("a30_detail", f"WITH {NB}, s AS (SELECT frame_id, sum((l+r+t+b-4*luma)*(l+r+t+b-4*luma)) AS lap, sum((r-l)*(r-l)+(b-t)*(b-t)) AS g, count(*) AS n FROM nb WHERE l IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL AND b IS NOT NULL GROUP BY frame_id) SELECT frame_id, round(CASE WHEN g/n > 4 THEN lap/g ELSE 0 END,6) AS detail FROM s")
def a30(spark, sf):
    return metrics.detail(pixels(spark, sf)).select("frame_id", r6(F.col("detail")).alias("detail"))


@query("a31_sharpness", f"WITH {PIX}, s AS (SELECT p.frame_id, sum(abs(l.luma+r.luma-2*p.luma)+abs(t.luma+b.luma-2*p.luma))/sum(p.luma) AS s FROM pix p JOIN pix l ON l.frame_id=p.frame_id AND l.v=p.v AND l.u=p.u-2 JOIN pix r ON r.frame_id=p.frame_id AND r.v=p.v AND r.u=p.u+2 JOIN pix t ON t.frame_id=p.frame_id AND t.u=p.u AND t.v=p.v-2 JOIN pix b ON b.frame_id=p.frame_id AND b.u=p.u AND b.v=p.v+2 WHERE p.u >= 0.8::DOUBLE AND p.u < 7.2::DOUBLE AND p.v >= 0.8::DOUBLE AND p.v < 7.2::DOUBLE AND p.u % 2 = 0 AND p.v % 2 = 0 GROUP BY p.frame_id) SELECT frame_id, round(s,6) AS sharpness FROM s")
def a31(spark, sf):
    return metrics.sharpness(pixels(spark, sf), 8, 8, 2).select("frame_id", r6(F.col("sharpness")).alias("sharpness"))


@query("a40_centre_depth", f"WITH {PIX}, l AS (SELECT frame_id, list_sort(list(z)) AS s FROM pix WHERE abs(u-4) <= 2 AND abs(v-4) <= 2 AND z > 0 GROUP BY frame_id) SELECT frame_id, round(s[len(s)//2+1],6) AS depth FROM l")
def a40(spark, sf):
    return metrics.centre_depth(pixels(spark, sf), 8, 8, 1).select("frame_id", r6(F.col("depth")).alias("depth"))


@query("a41_visible_features", f"WITH {PIX}, g AS (SELECT frame_id, count(*) AS features, count(DISTINCT floor(v*3/8::DOUBLE)*3+floor(u*3/8::DOUBLE)) AS cells, count(*) FILTER (floor(v*3/8::DOUBLE)*3+floor(u*3/8::DOUBLE) = 4) AS central FROM pix GROUP BY frame_id) SELECT * FROM g")
def a41(spark, sf):
    own = pixels(spark, sf).withColumn("id", F.col("v") * 8 + F.col("u"))
    return metrics.visible_features(own, 8, 8, least_central=4).select("frame_id", "features", "cells", "central")


@query("a42_view_diversity", f"""WITH {FR}, b AS (SELECT DISTINCT id // 50 AS region, floor(acos(least(1, greatest(-1, dz)))/radians(5)) AS t, floor(atan2(dy, dx)/radians(5)) AS p FROM frames), s AS (SELECT region, (t+0.5::DOUBLE)*radians(5) AS t, (p+0.5::DOUBLE)*radians(5) AS p FROM b),
 v AS (SELECT region, sin(t)*cos(p) AS x, sin(t)*sin(p) AS y, cos(t) AS z FROM s), w AS (SELECT a.region, degrees(acos(least(1, greatest(-1, min(a.x*b.x+a.y*b.y+a.z*b.z))))) AS span FROM v a JOIN v b ON a.region = b.region GROUP BY a.region)
 SELECT region, CASE WHEN span < 10 THEN '<10' WHEN span < 30 THEN '<30' ELSE '>=30' END AS band, round(span, 4) AS span FROM w""")
def a42(spark, sf):
    own = ad.frames(spark, sf).withColumn("region", F.expr("id div 50"))
    return metrics.diversity_bands(own, ["region"], 5.0).select("region", "band", F.round("span", 4).alias("span"))


@query("a44_extrapolation", f"""WITH {FR}, h AS (SELECT *, (row_number() OVER (PARTITION BY scan_id ORDER BY id) - 1) % 8 = 4 AS holdout FROM frames),
 p AS (SELECT a.scan_id, a.id, b.id AS nearest, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM h a JOIN h b ON a.scan_id = b.scan_id AND a.holdout AND NOT b.holdout), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, id ORDER BY d, nearest) AS n FROM p)
 SELECT scan_id, id, nearest, round(d,6) AS d FROM r WHERE n = 1""")
def a44(spark, sf):
    own = ad.frames(spark, sf)
    return metrics.extrapolation(sequence.holdout_every(own, 8), start=1.0).select("scan_id", "id", "nearest", r6(F.col("d")).alias("d"))


#: Byte images and their gradients: one-sided at the rim, central inside.
BYTES = f"""{PIX}, px AS (SELECT frame_id, u, v, CAST(trunc(least(greatest(luma, 0), 255)) AS DOUBLE) AS l FROM pix),
 gr AS (SELECT frame_id, u, v, l, CASE WHEN u = 0 THEN lead(l) OVER a - l WHEN u = 7 THEN l - lag(l) OVER a ELSE (lead(l) OVER a - lag(l) OVER a)/2 END AS gx, CASE WHEN v = 0 THEN lead(l) OVER d - l WHEN v = 7 THEN l - lag(l) OVER d ELSE (lead(l) OVER d - lag(l) OVER d)/2 END AS gy
 FROM px WINDOW a AS (PARTITION BY frame_id, v ORDER BY u), d AS (PARTITION BY frame_id, u ORDER BY v))"""
ENERGY = f"""{BYTES}, s3 AS (SELECT frame_id, u, v, l, lag(l) OVER a + lead(l) OVER a - 2*l AS across FROM px WINDOW a AS (PARTITION BY frame_id, v ORDER BY u)),
 lap AS (SELECT frame_id, u, v, lag(across) OVER d + lead(across) OVER d - 2*across AS x FROM s3 WINDOW d AS (PARTITION BY frame_id, u ORDER BY v)),
 sg AS (SELECT frame_id, sqrt(pi()/2)/6*avg(abs(x)) AS sigma FROM lap WHERE x IS NOT NULL GROUP BY frame_id),
 ce AS (SELECT frame_id, v // 4 AS i, u // 4 AS j, avg(l) AS mean, avg(gx*gx+gy*gy) AS raw, avg(CASE WHEN l >= 250 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS clipped FROM gr GROUP BY frame_id, v // 4, u // 4),
 energy AS (SELECT frame_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE WHEN clipped > 0.1::DOUBLE OR mean < 16 THEN 0 ELSE greatest(0, raw - sigma*sigma)/(greatest(mean, 1)*greatest(mean, 1)) END AS energy FROM ce JOIN sg USING (frame_id))"""
CORNER = f"""{BYTES}, o AS (SELECT unnest([-1, 0, 1]) AS o), bx AS (SELECT g.frame_id, g.u, g.v, sum(n.gx*n.gx)/65025 AS a, sum(n.gx*n.gy)/65025 AS b, sum(n.gy*n.gy)/65025 AS c
 FROM gr g, o du, o dv JOIN gr n ON n.frame_id = g.frame_id AND n.u = least(greatest(g.u + du.o, 0), 7) AND n.v = least(greatest(g.v + dv.o, 0), 7) WHERE g.u % 2 = 0 AND g.v % 2 = 0 GROUP BY g.frame_id, g.u, g.v),
 corner AS (SELECT frame_id, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, (a+c)/2 - sqrt((a-c)/2*(a-c)/2 + b*b) AS response FROM bx)"""


@query("a32_cell_energy", f"WITH {ENERGY} SELECT frame_id, i, j, round(energy,6) AS energy FROM energy")
def a32(spark, sf):
    return raster.cell_energies(luma(spark, sf), 4).withColumn("energy", r6(F.col("energy")))


@query("a39_corner_response", f"WITH {CORNER} SELECT frame_id, u, v, round(response,6) AS response FROM corner")
def a39(spark, sf):
    return raster.corner_responses(luma(spark, sf)).withColumn("response", r6(F.col("response")))


@query("k18_non_maximum", f"""WITH {CORNER}, pk AS (SELECT p.* FROM corner p WHERE response >= 1e-6::DOUBLE AND NOT EXISTS (SELECT 1 FROM corner q WHERE q.frame_id = p.frame_id AND abs(q.u-p.u) <= 2 AND abs(q.v-p.v) <= 2 AND q.response > p.response)),
 r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY response DESC, v, u) AS n FROM pk) SELECT frame_id, u, v, round(response,6) AS response FROM r WHERE n <= 5""")
def k18(spark, sf):
    return raster.suppressed(raster.corner_responses(luma(spark, sf)), 1e-6, 1.5, 5).withColumn("response", r6(F.col("response")))


def luma(spark, sf, shift: bool = False):
    """Eight by eight luma bytes of each vector; with ``shift`` all one pixel to the right."""
    own = pixels(spark, sf)
    if shift:
        to = F.when(F.col("u") == 0, F.array(F.lit(0), F.lit(1))).when(F.col("u") < 7, F.array(F.col("u") + 1)).otherwise(F.array().cast("array<int>"))
        own = own.withColumn("u", F.explode(to))
    rows = own.select("frame_id", (F.col("v") * 8 + F.col("u")).alias("i"), F.least(F.greatest(F.col("luma"), F.lit(0.0)), F.lit(255.0)).cast("int").alias("b"))
    joined = rows.groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda s: F.lpad(F.hex(s["b"]), 2, "0")), "").alias("h"))
    return joined.select("frame_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex("h").alias("luma"))


@query("f3_depth_acceptance", f"""WITH {PIX}, n AS (SELECT *, lag(z) OVER across AS l, lead(z) OVER across AS r, lag(z) OVER down AS t, lead(z) OVER down AS b FROM pix WINDOW across AS (PARTITION BY frame_id, v ORDER BY u), down AS (PARTITION BY frame_id, u ORDER BY v))
 SELECT frame_id, u, v FROM n WHERE z > 0.15::DOUBLE AND z < 5 AND abs(l-z) <= 0.2::DOUBLE*z AND abs(r-z) <= 0.2::DOUBLE*z AND abs(t-z) <= 0.2::DOUBLE*z AND abs(b-z) <= 0.2::DOUBLE*z""")
def f3(spark, sf):
    """With every sample confident and no limit on the slope; slopes and weights have a NumPy oracle in the tests."""
    from stereoloom.functions.geometry import Camera

    camera = Camera(*[F.lit(v) for v in (8.0, 8.0, 4.0, 4.0, 8, 8)])
    own = pixels(spark, sf).withColumn("conf", F.lit(2))
    return raster.accepted(own, camera, jump=0.2, steepest=90.0).select("frame_id", "u", "v")


@query("f13_texture", f"WITH {NB}, m AS (SELECT frame_id, stddev_pop(luma) AS s, sum((r-l)*(r-l)) AS a, sum((r-l)*(b-t)) AS b, sum((b-t)*(b-t)) AS c FROM nb WHERE l IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL AND b IS NOT NULL GROUP BY frame_id), e AS (SELECT *, (a+c)/2 - sqrt((a-c)*(a-c)/4+b*b) AS small, (a+c)/2 + sqrt((a-c)*(a-c)/4+b*b) AS large FROM m) SELECT frame_id FROM e WHERE s >= 0.012::DOUBLE AND small > 0.3::DOUBLE*large")
def f13(spark, sf):
    s = metrics.stencil(pixels(spark, sf)).filter("left is not null and right is not null and up is not null and down is not null")
    own = s.select("frame_id", "luma", (F.col("right") - F.col("left")).alias("gx"), (F.col("down") - F.col("up")).alias("gy"))
    return raster.textured(own, ["frame_id"], one_way=0.3).select("frame_id")


@query("cc1_run_components", f"""WITH RECURSIVE {CELLS2}, s AS (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY scan_id, i ORDER BY j) > 1 THEN 1 ELSE 0 END AS st FROM c2), g AS (SELECT *, sum(st) OVER (PARTITION BY scan_id, i ORDER BY j) AS run FROM s), runs AS (SELECT CAST(scan_id AS BIGINT)*10000 + i AS line, min(j) AS f, max(j) AS l, (CAST(scan_id AS BIGINT)*10000 + i)*1000 + min(j) AS id FROM g GROUP BY scan_id, i, run),
 e AS (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON abs(a.line-b.line) <= 1 AND a.f <= b.l + 2 AND b.f <= a.l + 2), reach AS (SELECT id, id AS root FROM runs UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id) SELECT id AS node, min(root) AS component FROM reach GROUP BY id""")
def cc1(spark, sf):
    """Each scan's lines have numbers of their own, ten thousand apart."""
    own = sequence.runs(cells2(spark, sf), "i", "j", gap=0).withColumn("line", F.col("scan_id").cast("long") * 10_000 + F.col("i"))
    return graph.run_components(own.select((F.col("line") * 1000 + F.col("first")).alias("id"), "line", "first", "last"))


@query("w8_pose_continuity", f"WITH {STEP}, t AS (SELECT scan_id, id, dt/1000000 AS dt, step FROM st) SELECT scan_id, id, coalesce(dt > 0 AND dt <= 0.25::DOUBLE AND step <= greatest(0.08::DOUBLE, 3*dt), false) AS continuous FROM t")
def w8(spark, sf):
    """Events come in time order of their ids within a scan only if the data says so; the oracle orders by id, so the frames are timed by id."""
    fr = ad.frames(spark, sf)
    return sequence.pose_continuity(fr.withColumn("timestamp", F.col("timestamp") / 1_000_000)).select("scan_id", "id", "continuous")


@query("w12_frame_pacing", f"WITH {STEP}, t AS (SELECT *, (row_number() OVER (PARTITION BY scan_id ORDER BY timestamp, id) - 1) // 20 AS bucket, timestamp - lag(timestamp) OVER (PARTITION BY scan_id ORDER BY timestamp, id) AS gap FROM st) SELECT scan_id, bucket, count(*) AS frames, count(*) FILTER (gap > 20000) AS stalls, round(max(gap),3) AS longest FROM t GROUP BY scan_id, bucket")
def w12(spark, sf):
    return sequence.pacing_buckets(ad.frames(spark, sf), 20, 20_000.0).select("scan_id", "bucket", "frames", "stalls", F.round("longest", 3).alias("longest"))


@query("w13_budgeted_fifo", f"WITH {FR}, r AS (SELECT scan_id, id AS tile_id, id % 7 + 1 AS points, row_number() OVER (PARTITION BY scan_id ORDER BY timestamp, id) AS place, sum(id % 7 + 1) OVER (PARTITION BY scan_id ORDER BY timestamp, id) AS used FROM frames) SELECT scan_id, tile_id FROM r WHERE place <= 8 AND (place = 1 OR used <= 20)")
def w13(spark, sf):
    own = ad.frames(spark, sf).select("scan_id", F.col("id").alias("tile_id"), (F.col("id") % 7 + 1).alias("points"), F.col("timestamp").alias("queued"))
    return sequence.budgeted_fifo(own, 20).select("scan_id", "tile_id")


@query("c21_dataset_checks", f"WITH {STEP} SELECT 'jumps' AS name, CAST(count(*) FILTER (step > 0.5::DOUBLE) AS DOUBLE) AS value FROM st UNION ALL SELECT 'frames', CAST(count(*) AS DOUBLE) FROM frames UNION ALL SELECT 'repeated ids', 0 UNION ALL SELECT 'time not forward', CAST(count(*) FILTER (dt <= 0) AS DOUBLE) FROM st UNION ALL SELECT 'missing images', 0 UNION ALL SELECT 'poses not rigid', 0")
def c21(spark, sf):
    identity = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    own = ad.frames(spark, sf).withColumns({"imageFile": F.col("id").cast("string"), "pose": identity})
    return pl.dataset_checks(own).select("name", "value")


@query("c22_capture_checks", f"WITH {FR} SELECT 'longest exposure' AS name, round(max(blur)/1000,6) AS value FROM frames UNION ALL SELECT 'highest iso', round(max(blur)*50,6) FROM frames UNION ALL SELECT 'rejected share', round(avg(CASE WHEN kind = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) FROM frames UNION ALL SELECT 'mean blur', round(avg(blur),6) FROM frames UNION ALL SELECT 'focal breathing', 0.0")
def c22(spark, sf):
    own = ad.frames(spark, sf).withColumns({"exposure": F.col("blur") / 1000, "iso": F.col("blur") * 50, "verdict": F.when(F.col("kind") == "error", "drop").otherwise("keep"), "fx": F.lit(300.0)})
    return pl.capture_checks(own).select("name", r6(F.col("value")).alias("value"))


@query("c29_sharpness_replay", f"""WITH RECURSIVE {FR}, ev AS (SELECT scan_id, id, timestamp AS t, abs(dx) AS sharp, kind = 'error' AS severe, row_number() OVER (PARTITION BY scan_id ORDER BY timestamp, id) AS n FROM frames),
 s AS (SELECT scan_id, n, id, t, sharp AS peak, sharp FROM ev WHERE n = 1
 UNION ALL SELECT e.scan_id, e.n, e.id, e.t, greatest(e.sharp, s.peak * CASE WHEN e.severe THEN 1 ELSE pow(0.97::DOUBLE, 60*greatest(0, least(0.25::DOUBLE, e.t - s.t))) END), e.sharp FROM s JOIN ev e ON e.scan_id = s.scan_id AND e.n = s.n + 1)
 SELECT scan_id, id, round(CASE WHEN peak > 1e-6::DOUBLE THEN sharp/peak ELSE 1 END, 6) AS ratio FROM s""")
def c29(spark, sf):
    own = ad.frames(spark, sf).withColumns({"sharpness": F.abs("dx"), "severe": F.col("kind") == "error"})
    return pl.sharpness_replay(own).withColumn("ratio", r6(F.col("ratio")))


@query("c23_scan_accuracy", None)
def c23(spark, sf):
    return pl.scan_accuracy(ad.points(spark, sf), ad.frames(spark, sf).withColumn("scan_id", F.col("scan_id").cast("string"))).select("scan_id", r6(F.col("floor")).alias("floor"), "angle", "frames")


@query("c24_coverage_comparison", None)
def c24(spark, sf):
    p = ad.points(spark, sf)
    return pl.coverage_comparison(p.filter("measured"), p.filter("not measured"), 0.1).withColumn("value", r6(F.col("value")))


@query("c18_floor_plan", None)
def c18(spark, sf):
    return pl.floor_plan(ad.points(spark, sf), 0.05, -0.3, 0.3)
