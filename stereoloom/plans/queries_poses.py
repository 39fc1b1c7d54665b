"""Queries over the pose view: cameras, rotations, scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from stereoloom.functions import capture as cp
from stereoloom.functions import geometry as g
from stereoloom.functions.numeric import is_finite
from stereoloom.plans import adapters as ad
from stereoloom.plans.registry import query, r6

Q = ad.CTES["poses"]
FR = ad.CTES["frames"]
OB = ad.CTES["observations"]


@query("p1_intrinsics_rescale", f"WITH {Q} SELECT id, round(fx*120/240::DOUBLE,6) AS fx, round(fy*60/180::DOUBLE,6) AS fy, round(cx*120/240::DOUBLE,6) AS cx, round(cy*60/180::DOUBLE,6) AS cy FROM poses")
def p1(spark, sf):
    k = g.Camera.of("intrinsics").rescaled(F.lit(120), F.lit(60))
    return ad.poses(spark, sf).select("id", *[r6(getattr(k, n)).alias(n) for n in ("fx", "fy", "cx", "cy")])


@query("p2_depth_unproject", f"""WITH {Q}, c AS (SELECT *, (30-cx)/fx*(1+abs(a)) AS px, -(40-cy)/fy*(1+abs(a)) AS py, -(1+abs(a)) AS pz FROM poses)
 SELECT id, round(r00*px+r01*py+r02*pz+tx,6) AS x, round(r10*px+r11*py+r12*pz+ty,6) AS y, round(r20*px+r21*py+r22*pz+tz,6) AS z FROM c""")
def p2(spark, sf):
    x, y, z = g.unproject(g.Camera.of("intrinsics"), "pose", F.lit(30), F.lit(40), 1 + F.abs("a"))
    return ad.poses(spark, sf).select("id", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query("p3_project", f"""WITH {Q}, d AS (SELECT *, 0.5::DOUBLE-tx AS ex, 0.25::DOUBLE-ty AS ey, -1.0::DOUBLE-tz AS ez FROM poses), c AS (SELECT *, r00*ex+r10*ey+r20*ez AS px, r01*ex+r11*ey+r21*ez AS py, -(r02*ex+r12*ey+r22*ez) AS z FROM d),
 p AS (SELECT id, fx*px/z+cx AS u, cy-fy*py/z AS v, z FROM c WHERE z > 0) SELECT id, round(u,6) AS u, round(v,6) AS v, round(z,6) AS z FROM p WHERE u >= 0 AND v >= 0 AND u < 240 AND v < 180""")
def p3(spark, sf):
    p = g.project(g.Camera.of("intrinsics"), "pose", (F.lit(0.5), F.lit(0.25), F.lit(-1.0)))
    return ad.poses(spark, sf).withColumn("p", p).filter("p is not null").select("id", *[r6(F.col(f"p.{n}")).alias(n) for n in "uvz"])


@query("p4_project_cv", f"WITH {Q} SELECT id, round(fx*tx/a+cx,6) AS u, round(fy*ty/a+cy,6) AS v FROM poses WHERE a > 0.01::DOUBLE")
def p4(spark, sf):
    p = g.project_cv(g.Camera.of("intrinsics"), (F.col("tx"), F.col("ty"), F.col("a")))
    return ad.poses(spark, sf).filter("a > 0.01").withColumn("p", p).select("id", r6(F.col("p.u")).alias("u"), r6(F.col("p.v")).alias("v"))


@query("p5_rigid_inverse", f"WITH {Q} SELECT id, round(r10,6) AS m01, round(r01,6) AS m10, round(-(r00*tx+r10*ty+r20*tz),6) AS m03, round(-(r01*tx+r11*ty+r21*tz),6) AS m13, round(-(r02*tx+r12*ty+r22*tz),6) AS m23 FROM poses")
def p5(spark, sf):
    own = ad.poses(spark, sf).withColumn("m", g.rigid_inverse("pose"))
    return own.select("id", *[r6(F.col("m")[i]).alias(n) for n, i in (("m01", 1), ("m10", 4), ("m03", 3), ("m13", 7), ("m23", 11))])


@query("p6_axis_flips", f"WITH {Q} SELECT id, round(-r01,6) AS camera01, round(r00,6) AS camera00, round(-r10,6) AS world10, round(-tz,6) AS world23, round(-r20,6) AS up10, round(ty,6) AS up23 FROM poses")
def p6(spark, sf):
    own = ad.poses(spark, sf).select("id", g.flip_camera("pose").alias("c"), g.flip_world("pose").alias("w"), g.y_up_to_z_up("pose").alias("u"))
    return own.select("id", r6(F.col("c")[1]).alias("camera01"), r6(F.col("c")[0]).alias("camera00"), r6(F.col("w")[4]).alias("world10"), r6(F.col("w")[11]).alias("world23"), r6(F.col("u")[4]).alias("up10"), r6(F.col("u")[11]).alias("up23"))


@query("p7_colmap_pose", f"""WITH {Q}, f AS (SELECT id, qw, qx, qy, qz, r00*tx+r10*ty+r20*tz AS a, r01*tx+r11*ty+r21*tz AS b, r02*tx+r12*ty+r22*tz AS c FROM poses),
 s AS (SELECT id, qx AS w, qw AS x, qz AS y, -qy AS z, -a AS tx, b AS ty, c AS tz FROM f)
 SELECT id, round(abs(w),6) AS qw, round(CASE WHEN w < 0 THEN -x ELSE x END,6) AS qx, round(CASE WHEN w < 0 THEN -y ELSE y END,6) AS qy, round(CASE WHEN w < 0 THEN -z ELSE z END,6) AS qz, round(tx,6) AS tx, round(ty,6) AS ty, round(tz,6) AS tz FROM s""")
def p7(spark, sf):
    """The oracle multiplies quaternions: the camera flip is a half turn about x, the inverse a conjugate."""
    own = ad.poses(spark, sf).withColumn("p", g.colmap_pose("pose"))
    return own.select("id", *[r6(F.col(f"p.{n}")).alias(n) for n in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])


@query("p8_matrix_quaternion", f"WITH {Q}, s AS (SELECT id, CASE WHEN qw < 0 THEN -1 ELSE 1 END AS s, qw, qx, qy, qz FROM poses) SELECT id, round(s*qw,6) AS w, round(s*qx,6) AS x, round(s*qy,6) AS y, round(s*qz,6) AS z FROM s")
def p8(spark, sf):
    own = ad.poses(spark, sf).withColumn("q", g.quaternion("pose"))
    return own.select("id", *[r6(F.col(f"q.{n}")).alias(n) for n in "wxyz"])


@query("p9_portrait_rotation", f"WITH {Q} SELECT id, round(fy,6) AS fx, round(fx,6) AS fy, round(180-cy,6) AS cx, round(cx,6) AS cy, 180 AS width, 240 AS height FROM poses")
def p9(spark, sf):
    k = g.Camera.of("intrinsics").portrait()
    return ad.poses(spark, sf).select("id", *[r6(getattr(k, n)).alias(n) for n in ("fx", "fy", "cx", "cy")], k.width.alias("width"), k.height.alias("height"))


@query("p10_position_forward", f"WITH {Q} SELECT id, round(tx,6) AS x, round(-r02/sqrt(r02*r02+r12*r12+r22*r22),6) AS dx, round(-r12/sqrt(r02*r02+r12*r12+r22*r22),6) AS dy, round(-r22/sqrt(r02*r02+r12*r12+r22*r22),6) AS dz FROM poses")
def p10(spark, sf):
    d = g.forward("pose")
    return ad.poses(spark, sf).select("id", r6(g.position("pose")[0]).alias("x"), *[r6(v).alias(f"d{c}") for c, v in zip("xyz", d, strict=True)])


@query("p11_rotation_angle", f"""WITH {Q} SELECT a.id, round(2*acos(least(1.0::DOUBLE, abs(a.qw*b.qw+a.qx*b.qx+a.qy*b.qy+a.qz*b.qz))),5) AS angle FROM poses a JOIN poses b ON b.id = a.id + 1""")
def p11(spark, sf):
    p = ad.poses(spark, sf)
    a, b = p.select("id", F.col("pose").alias("pa")), p.select((F.col("id") - 1).alias("id"), F.col("pose").alias("pb"))
    return a.join(b, "id").select("id", F.round(g.rotation_angle("pa", "pb"), 5).alias("angle"))


@query("p12_point_score", f"WITH {Q} SELECT id, round((1-0.5::DOUBLE*least(1.0::DOUBLE, abs(a)*1.4::DOUBLE)) * (1/(0.2::DOUBLE+(1+b)*(1+b))) * abs(c) * CASE WHEN id % 3 >= 2 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END * tx * tx,6) AS score FROM poses")
def p12(spark, sf):
    return ad.poses(spark, sf).select("id", r6(cp.point_score(F.abs("a"), 1 + F.col("b"), F.abs("c"), F.col("id") % 3, "tx")).alias("score"))


@query("p13_blur_weight", f"WITH {FR} SELECT id, round(pow(1/(1+blur/4), 0.5::DOUBLE)*pow(10.0::DOUBLE, 0.5::DOUBLE),6) AS weight FROM frames")
def p13(spark, sf):
    return ad.frames(spark, sf).select("id", r6(cp.blur_weight("blur", power=0.5)).alias("weight"))


@query("p14_blur_risk", f"WITH {Q} SELECT id, round((abs(a)+abs(b)/greatest(0.1::DOUBLE, coalesce(CASE WHEN id % 4 > 0 THEN abs(c)*5 END, 0.5::DOUBLE)))*fx*(0.008::DOUBLE+0.01::DOUBLE),6) AS risk FROM poses")
def p14(spark, sf):
    depth = F.when(F.col("id") % 4 > 0, F.abs("c") * 5)
    return ad.poses(spark, sf).select("id", r6(cp.blur_risk(F.abs("a"), F.abs("b"), depth, F.col("intrinsics.fx"), F.lit(0.008))).alias("risk"))


@query("p15_exposure_blur", f"WITH {FR} SELECT id, round(blur*0.02::DOUBLE/(0.02::DOUBLE+0.01::DOUBLE),6) AS blur FROM frames WHERE blur >= 0")
def p15(spark, sf):
    return ad.frames(spark, sf).filter("blur >= 0").select("id", r6(cp.exposure_blur("blur", F.lit(0.02))).alias("blur"))


@query("p20_metric_scale", f"WITH {Q} SELECT id, round(CASE WHEN id % 5 = 0 THEN 1.0::DOUBLE ELSE least(greatest(abs(a)*5/1.2::DOUBLE, 0.125::DOUBLE), 1.0::DOUBLE) END,6) AS scale FROM poses")
def p20(spark, sf):
    return ad.poses(spark, sf).select("id", r6(cp.metric_scale(F.when(F.col("id") % 5 != 0, F.abs("a") * 5))).alias("scale"))


@query("p21_scaled_pose", f"WITH {Q} SELECT id, round(tx*2.5::DOUBLE,6) AS x, round(tz*2.5::DOUBLE,6) AS z, round(r01,6) AS r01 FROM poses")
def p21(spark, sf):
    own = ad.poses(spark, sf).withColumn("m", cp.scaled_pose("pose", F.lit(2.5)))
    return own.select("id", r6(F.col("m")[3]).alias("x"), r6(F.col("m")[11]).alias("z"), r6(F.col("m")[1]).alias("r01"))


@query("p22_capture_ev", f"WITH {FR} SELECT id, round(CASE WHEN blur > 0 THEN log2(blur*100) END,6) AS ev FROM frames")
def p22(spark, sf):
    return ad.frames(spark, sf).select("id", r6(cp.exposure_value("blur", F.lit(100))).alias("ev"))


@query("p23_denoise_level", f"WITH {FR} SELECT id, round(CASE WHEN blur*100 > 400 THEN 0.022::DOUBLE*least(1.0::DOUBLE, log2(blur*100/400)/2) END,6) AS level FROM frames")
def p23(spark, sf):
    return ad.frames(spark, sf).select("id", r6(cp.denoise_level(F.col("blur") * 100)).alias("level"))


@query("p27_activations", f"WITH {Q} SELECT id, round(1/(1+exp(-a)),6) AS s, round(a,6) AS back, round(exp(b),6) AS scale FROM poses")
def p27(spark, sf):
    return ad.poses(spark, sf).select("id", r6(cp.sigmoid("a")).alias("s"), r6(cp.logit(cp.sigmoid("a"))).alias("back"), r6(F.exp("b")).alias("scale"))


@query("p28_hash_rank", f"WITH {Q}, {ad.split_mix_sql('poses', 'id')} SELECT id, CAST(CASE WHEN h >= 9223372036854775808::UBIGINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END AS BIGINT) AS rank FROM mixed")
def p28(spark, sf):
    return ad.poses(spark, sf).select("id", cp.hash_rank("id").alias("rank"))


@query("p29_playback_orientation", f"WITH {Q} SELECT id, CASE WHEN abs(b) >= abs(a) THEN CASE WHEN b <= 0 THEN 'up' ELSE 'down' END WHEN a > 0 THEN 'right' ELSE 'left' END AS down FROM poses")
def p29(spark, sf):
    return ad.poses(spark, sf).select("id", cp.playback_orientation("a", "b").alias("down"))


@query("p30_playback_interval", f"WITH {FR} SELECT id, round(1/least(greatest(blur, 0.5::DOUBLE), 30.0::DOUBLE),6) AS seconds FROM frames")
def p30(spark, sf):
    return ad.frames(spark, sf).select("id", r6(cp.playback_interval("blur")).alias("seconds"))


@query("p31_heat_colour", f"WITH {FR}, q AS (SELECT id, least(1.0::DOUBLE, blur*4/30) AS q FROM frames) SELECT id, round(CASE WHEN q < 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 2-2*q END,6) AS r, round(CASE WHEN q < 0.5::DOUBLE THEN 2*q ELSE 1.0::DOUBLE END,6) AS g FROM q")
def p31(spark, sf):
    own = ad.frames(spark, sf).withColumn("c", cp.heat_colour(F.col("blur") * 4))
    return own.select("id", r6(F.col("c.r")).alias("r"), r6(F.col("c.g")).alias("g"))


@query("p33_training_schedule", f"WITH {FR}, n AS (SELECT scan_id, count(*) AS n FROM frames GROUP BY scan_id) SELECT scan_id, CAST(greatest(4000, ceil(n*90000/1000::DOUBLE)*1000) AS BIGINT) AS iterations, CAST(floor(15000*greatest(4000, ceil(n*90000/1000::DOUBLE)*1000)/30000::DOUBLE) AS BIGINT) AS half FROM n")
def p33(spark, sf):
    n = ad.frames(spark, sf).groupBy("scan_id").agg(F.count("*").alias("n")).withColumn("iterations", cp.training_iterations(F.lit(4000), "n", F.lit(90_000)))
    return n.select("scan_id", "iterations", cp.scaled_schedule(F.lit(15_000), "iterations").alias("half"))


@query("f1_frame_validity", f"WITH {FR} SELECT count(*) AS n FROM frames WHERE NOT isnan(timestamp) AND id IN (SELECT id FROM frames GROUP BY id HAVING count(*) = 1)")
def f1(spark, sf):
    from stereoloom.plans.pipelines import valid_frames

    fr = ad.frames(spark, sf)
    full = fr.select("scan_id", "id", F.array_repeat(F.lit(1.0), 16).alias("transform"), F.struct(F.lit(300.0).alias("fx"), F.lit(300.0).alias("fy"), F.lit(240).alias("width"), F.lit(180).alias("height")).alias("intrinsics"), F.concat(F.lit("frame_"), F.col("id").cast("string"), F.lit(".jpg")).alias("imageFile"))
    return valid_frames(full).agg(F.count("*").alias("n"))


@query("f2_rigid_pose", f"WITH {Q} SELECT id, id % 7 <> 0 AS rigid FROM poses")
def f2(spark, sf):
    own = ad.poses(spark, sf).withColumn("m", F.when(F.col("id") % 7 == 0, F.transform("pose", lambda v: v * 1.1)).otherwise(F.col("pose")))
    return own.select("id", g.is_rigid("m").alias("rigid"))


@query("f4_block_reason", f"WITH {FR} SELECT id, CASE WHEN kind = 'signup' THEN 'tracking' WHEN id % 9 = 0 THEN 'features' WHEN blur > 24 OR abs(x) > 1.6::DOUBLE OR abs(y) > 1.6::DOUBLE THEN 'motion' WHEN abs(z) < 0.1::DOUBLE THEN 'focus' END AS reason FROM frames")
def f4(spark, sf):
    own = ad.frames(spark, sf)
    return own.select("id", cp.block_reason(F.col("kind") != "signup", F.col("id") % 9, "blur", F.abs("x"), F.abs("y"), F.abs("z") * 4).alias("reason"))


@query("f5_quality_issues", f"WITH {FR} SELECT id, concat_ws(',', CASE WHEN blur*100 < 150 THEN 'dark' END, CASE WHEN blur*100 > 20000 THEN 'bright' END, CASE WHEN abs(x)*4 < 0.25::DOUBLE THEN 'near' END, CASE WHEN abs(x)*4 > 4 THEN 'far' END, CASE WHEN id % 4 >= 2 THEN 'heat' END) AS issues FROM frames")
def f5(spark, sf):
    own = ad.frames(spark, sf)
    return own.select("id", F.concat_ws(",", cp.quality_issues(F.col("blur") * 100, F.abs("x") * 4, F.col("id") % 4)).alias("issues"))


@query("f7_verdict_filter", f"WITH {FR} SELECT count(*) FILTER (kind <> 'error') AS everywhere, count(*) FILTER (kind NOT IN ('error', 'click')) AS training FROM frames")
def f7(spark, sf):
    from stereoloom.plans.pipelines import usable

    verdict = F.when(F.col("kind") == "error", "drop").when(F.col("kind") == "click", "demote").otherwise("keep")
    own = ad.frames(spark, sf).withColumn("verdict", verdict)
    return usable(own).agg(F.count("*").alias("everywhere"), F.count_if(F.col("verdict") == "keep").alias("training"))


@query("f9_near_far_split", f"WITH {FR} SELECT abs(z)*20 > 3.0::DOUBLE AS far, count(*) AS n FROM frames GROUP BY 1")
def f9(spark, sf):
    return ad.frames(spark, sf).groupBy((F.abs("z") * 20 > 3.0).alias("far")).agg(F.count("*").alias("n"))


@query("f10_reference_validity", f"WITH {FR} SELECT id, blur >= 0.1::DOUBLE AND blur <= 1000 AS valid FROM frames")
def f10(spark, sf):
    return ad.frames(spark, sf).select("id", cp.reference_valid("blur").alias("valid"))


@query("f11_point_in_polygon", f"""WITH {Q}, l AS (SELECT id, a, b, abs(a*5) + abs(b*5) < 1 AS inside FROM poses) SELECT id, inside FROM l""")
def f11(spark, sf):
    """The polygon is a diamond, which the oracle tests by its norm."""
    from stereoloom.operators.metrics import point_in_polygon

    diamond = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, -1.0, 0.0, 0.0, -1.0)])
    return ad.poses(spark, sf).select("id", point_in_polygon(F.col("a") * 5, F.col("b") * 5, diamond).alias("inside"))


@query("a10_long_tracks", f"WITH {OB}, n AS (SELECT track_id FROM observations GROUP BY track_id HAVING count(*) >= 30) SELECT frame_id, track_id, line FROM observations JOIN n USING (track_id)")
def a10(spark, sf):
    from stereoloom.operators.metrics import long_tracks

    return long_tracks(ad.observations(spark, sf), 30).select("frame_id", "track_id", "line")


@query("a11_track_means", f"WITH {OB} SELECT track_id, count(*) AS n, round(avg(u),6) AS mx FROM observations WHERE depth > 0 GROUP BY track_id")
def a11(spark, sf):
    from stereoloom.operators.metrics import track_means

    own = ad.observations(spark, sf).withColumns({"x": F.col("u"), "y": F.col("v"), "z": F.col("depth")})
    return track_means(own).select("track_id", "n", r6(F.col("mx")).alias("mx"))


@query("a12_triangulation", f"""WITH {Q}, r AS (SELECT id % 20 AS track_id, tx AS ox, ty AS oy, tz AS oz, -tx/sqrt(tx*tx+ty*ty+tz*tz) AS dx, -ty/sqrt(tx*tx+ty*ty+tz*tz) AS dy, -tz/sqrt(tx*tx+ty*ty+tz*tz) AS dz FROM poses)
 SELECT track_id, count(*) AS n, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, 0.0::DOUBLE AS pz FROM r GROUP BY track_id"""
)
def a12(spark, sf):
    from stereoloom.operators.metrics import triangulate

    p = ad.poses(spark, sf)
    n = F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2 + F.col("tz") ** 2)
    rays = p.select((F.col("id") % 20).alias("track_id"), *[F.col(f"t{c}").alias(f"o{c}") for c in "xyz"], *[(-F.col(f"t{c}") / n).alias(f"d{c}") for c in "xyz"])
    return triangulate(rays).select("track_id", "n", *[(r6(F.col(c)) + 0.0).alias(c) for c in ("px", "py", "pz")])


@query("a28_quality_counts", f"WITH {FR}, v AS (SELECT scan_id, CASE kind WHEN 'error' THEN 'drop' WHEN 'click' THEN 'demote' ELSE 'keep' END AS verdict FROM frames) SELECT scan_id, count(*) AS frames, count(*) FILTER (verdict='keep') AS keep, count(*) FILTER (verdict='demote') AS demote, count(*) FILTER (verdict='drop') AS drop_, round(count(*) FILTER (verdict<>'keep')/count(*)::DOUBLE,6) AS rejected FROM v GROUP BY scan_id")
def a28(spark, sf):
    from stereoloom.operators.metrics import quality_counts

    own = ad.frames(spark, sf).withColumn("verdict", F.when(F.col("kind") == "error", "drop").when(F.col("kind") == "click", "demote").otherwise("keep"))
    return quality_counts(own).withColumnRenamed("drop", "drop_").withColumn("rejected", r6(F.col("rejected")))


@query("n8_track_holdout", f"WITH {OB} SELECT track_id % 5 = 4 AS holdout, count(*) AS n FROM observations GROUP BY 1")
def n8(spark, sf):
    from stereoloom.operators.sequence import track_holdout

    return track_holdout(ad.observations(spark, sf)).groupBy("holdout").agg(F.count("*").alias("n"))


@query("a33_ncc", f"WITH {OB} SELECT track_id, count(*) AS n, round(corr(u, v),5) AS ncc FROM observations GROUP BY track_id HAVING count(*) > 2")
def a33(spark, sf):
    from stereoloom.operators.metrics import ncc

    return ncc(ad.observations(spark, sf), "u", "v", ["track_id"]).filter("n > 2").withColumn("ncc", F.round("ncc", 5))


@query("a34_psnr", f"WITH {OB} SELECT line, round(10*log10(1/avg((u/50-depth*10)*(u/50-depth*10))),6) AS psnr FROM observations GROUP BY line")
def a34(spark, sf):
    from stereoloom.operators.metrics import psnr

    own = ad.observations(spark, sf).select("line", (F.col("u") / 50).alias("a"), (F.col("depth") * 10).alias("b"))
    return psnr(own, "a", "b", ["line"]).select("line", r6(F.col("psnr")).alias("psnr"))


@query("a34_ssim", f"""WITH {OB}, o AS (SELECT line, u/50 AS a, depth*10 AS b FROM observations), m AS (SELECT line, avg(a) ma, avg(b) mb, var_pop(a) va, var_pop(b) vb, covar_pop(a,b) c FROM o GROUP BY line)
 SELECT line, round((2*ma*mb+0.0001::DOUBLE)*(2*c+0.0009::DOUBLE)/((ma*ma+mb*mb+0.0001::DOUBLE)*(va+vb+0.0009::DOUBLE)),6) AS ssim FROM m""")
def a34s(spark, sf):
    from stereoloom.operators.raster import ssim

    own = ad.observations(spark, sf).select("line", (F.col("u") / 50).alias("a"), (F.col("depth") * 10).alias("b"))
    return ssim(own, ["line"]).withColumn("ssim", r6(F.col("ssim")))


@query("a35_polygon_measures", f"WITH {Q} SELECT id, round(abs((2+a)*(1+b)),6) AS area, round((2+a)/2,6) AS cx, round((1+b)/2,6) AS cy FROM poses")
def a35(spark, sf):
    """Rectangles, whose measures the oracle knows."""
    from stereoloom.operators.metrics import polygon_measures

    w, h = 2 + F.col("a"), 1 + F.col("b")
    own = ad.poses(spark, sf).select("id", F.array(F.lit(0.0), F.lit(0.0), w, F.lit(0.0), w, h, F.lit(0.0), h).alias("polygon2D"))
    return polygon_measures(own).select("id", *[r6(F.col(c)).alias(c) for c in ("area", "cx", "cy")])


@query("a36_axial_mean", f"WITH {Q} SELECT id % 10 AS plan, round(atan2(sum(abs(b)*sin(4*a)), sum(abs(b)*cos(4*a)))/4,6) AS angle FROM poses GROUP BY 1")
def a36(spark, sf):
    from stereoloom.operators.metrics import axial_mean

    own = ad.poses(spark, sf).select((F.col("id") % 10).alias("plan"), F.col("a").alias("angle"), F.abs("b").alias("length"))
    return axial_mean(own, ["plan"]).withColumn("angle", r6(F.col("angle")))


@query("a37_plan_summary", f"""WITH {Q}, w AS (SELECT id % 10 AS plan, least(tx,a) AS x0, greatest(tx,a) AS x1, abs(a) AS len, CASE WHEN abs(b) > 0.02::DOUBLE THEN abs(b) END AS thick FROM poses), l AS (SELECT plan, min(x0) AS min_x, max(x1) AS max_x, list_sort(list(len)) AS ls, list_sort(list(thick) FILTER (thick IS NOT NULL)) AS ts FROM w GROUP BY plan)
 SELECT plan, round(min_x,6) AS min_x, round(max_x,6) AS max_x, round(ls[len(ls)//2+1],6) AS length, round(ts[len(ts)//2+1],6) AS thickness FROM l""")
def a37(spark, sf):
    from stereoloom.operators.metrics import plan_summary

    own = ad.poses(spark, sf).select((F.col("id") % 10).alias("plan"), F.col("tx").alias("x0"), F.col("a").alias("x1"), F.col("ty").alias("y0"), F.col("ty").alias("y1"), F.abs("a").alias("length"), F.abs("b").alias("thickness"), F.abs("c").alias("height"))
    return plan_summary(own, ["plan"]).select("plan", *[r6(F.col(c)).alias(c) for c in ("min_x", "max_x", "length", "thickness")])


@query("a38_exposure_range", f"WITH {FR} SELECT scan_id, round(max(blur)-min(blur),6) AS ev_range FROM frames GROUP BY scan_id")
def a38(spark, sf):
    from stereoloom.operators.metrics import exposure_range

    return exposure_range(ad.frames(spark, sf).withColumn("ev", F.col("blur"))).withColumn("ev_range", r6(F.col("ev_range")))


@query("a43_render_report", f"WITH {OB}, e AS (SELECT line, depth*10 AS t, CASE WHEN u > 0 THEN abs(u*1.02::DOUBLE+depth-u)/u END AS e FROM observations) SELECT line, round(avg(CASE WHEN t > 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS uncovered, round(quantile_cont(e,0.5),6) AS median, round(quantile_cont(e,0.9),6) AS p90 FROM e GROUP BY line")
def a43(spark, sf):
    from stereoloom.operators.metrics import render_report

    own = ad.observations(spark, sf).select("line", (F.col("depth") * 10).alias("transmittance"), (F.col("u") * 1.02 + F.col("depth")).alias("depth"), F.col("u").alias("truth"))
    return render_report(own, ["line"]).select("line", *[r6(F.col(c)).alias(c) for c in ("uncovered", "median", "p90")])


@query("sp8_frame_flip", f"WITH {Q} SELECT id, round(-ty,6) AS y, round(qw,6) AS w, round(-qy,6) AS qy, round(-qz,6) AS qz FROM poses")
def sp8(spark, sf):
    from stereoloom.operators.splats import flipped_frame

    own = ad.poses(spark, sf).select("id", F.col("ty").alias("y"), F.col("tz").alias("z"), F.array("qw", "qx", "qy", "qz").alias("quat"), F.array("a", "b", "c").alias("sh1"))
    return flipped_frame(own).select("id", r6(F.col("y")).alias("y"), r6(F.col("quat")[0]).alias("w"), r6(F.col("quat")[2]).alias("qy"), r6(F.col("quat")[3]).alias("qz"))


@query("sp12_dataset_signature", None)
def sp12(spark, sf):
    from stereoloom.operators.splats import dataset_signature

    return dataset_signature(ad.frames(spark, sf).select("scan_id", "id", "timestamp"))


@query("finite_guard", f"WITH {Q} SELECT count(*) AS n FROM poses")
def finite(spark, sf):
    return ad.poses(spark, sf).filter(is_finite("a")).agg(F.count("*").alias("n"))
