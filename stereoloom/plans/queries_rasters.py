"""Queries over rasters, surfaces, tracks and documents: the vectors serve as small images and point samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from stereoloom.functions import geometry as g
from stereoloom.operators import fusion, graph, kernels, raster, spatial, splats
from stereoloom.plans import adapters as ad
from stereoloom.plans import pipelines as pl
from stereoloom.plans.queries_frames import BYTES, ENERGY, NB, PIX, luma, pixels
from stereoloom.plans.registry import query, r6
from stereoloom.sources import colmap, scans

P = ad.CTES["points"]
FR = ad.CTES["frames"]
Q = ad.CTES["poses"]
IDENTITY = [float(i % 5 == 0) for i in range(16)]


def oriented(spark, sf):
    """Points with a unit normal along their own direction."""
    p = ad.points(spark, sf)
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return p.withColumns({f"n{c}": F.col(c) / n for c in "xyz"})


def lookups(spark, sf):
    """Points before eight by eight depth images, each as the five frames from its own number on see it."""
    n = max(spark.read.parquet(f"{sf}/embeddings.parquet").count(), 1)
    k = F.struct(F.lit(8.0).alias("fx"), F.lit(8.0).alias("fy"), F.lit(3.5).alias("cx"), F.lit(3.5).alias("cy"), F.lit(7).alias("width"), F.lit(7).alias("height"))
    views = spark.range(n).select(F.lit("s").alias("scan_id"), F.col("id").cast("int").alias("view_id"), F.array(*[F.lit(v) for v in IDENTITY]).alias("pose"), k.alias("intrinsics"))
    p = ad.points(spark, sf).select(F.lit("s").alias("scan_id"), "ordinal", "x", "y", (-1 + F.col("z")).alias("z"))
    asked = p.withColumn("view_id", F.explode(F.array(*[((F.col("ordinal") + i) % n).cast("int") for i in range(5)])))
    samples = pixels(spark, sf).withColumn("frame_id", F.col("frame_id").cast("int"))
    return p, raster.raster_lookup(asked, views, samples)


LOOK = f"""{P}, {PIX}, ask AS (SELECT ordinal, (ordinal + view) % (SELECT count(*) FROM embeddings) AS view_id, x, y, -1+z AS z, 8*x/(1-z)+3.5::DOUBLE AS u, 3.5::DOUBLE-8*y/(1-z) AS v FROM points, (SELECT unnest(range(5)) AS view) w), seen AS (SELECT *, floor(u) AS iu, floor(v) AS iv FROM ask WHERE z < 0 AND u >= 0 AND v >= 0 AND u < 7 AND v < 7),
 m AS (SELECT s.ordinal, s.view_id, s.z, count(*) AS n, sum(p.z * CASE WHEN p.u = iu THEN 1-(s.u-iu) ELSE s.u-iu END * CASE WHEN p.v = iv THEN 1-(s.v-iv) ELSE s.v-iv END) AS d FROM seen s JOIN pix p ON p.frame_id = s.view_id AND p.u BETWEEN iu AND iu+1 AND p.v BETWEEN iv AND iv+1 GROUP BY s.ordinal, s.view_id, s.z),
 look AS (SELECT a.ordinal, a.view_id, m.d + a.z AS residual, CASE WHEN coalesce(n,0) < 4 THEN 'unobserved' WHEN abs(d + a.z) <= 0.015::DOUBLE + 0.005::DOUBLE * -a.z THEN 'supported' WHEN d + a.z < 0 THEN 'occluded' ELSE 'contradicted' END AS state FROM ask a LEFT JOIN m ON m.ordinal = a.ordinal AND m.view_id = a.view_id)"""


@query("j6_depth_consistency", f"WITH {LOOK} SELECT CAST(view_id AS INT) AS view_id, state, count(*) AS n FROM look GROUP BY view_id, state")
def j6(spark, sf):
    return lookups(spark, sf)[1].groupBy("view_id", "state").agg(F.count("*").alias("n"))


@query("c4_consistency_filter", f"WITH {LOOK}, c AS (SELECT ordinal, count(*) FILTER (state='supported') AS s, count(*) FILTER (state='contradicted') AS c FROM look GROUP BY ordinal) SELECT ordinal, s AS supports FROM c WHERE s >= 1 AND s > c")
def c4(spark, sf):
    return raster.consistent(lookups(spark, sf)[1], 1).select("ordinal", "supports")


@query("c3_depth_consensus", f"WITH {LOOK}, c AS (SELECT ordinal, count(*) AS asked, count(*) FILTER (state='supported') AS s, count(*) FILTER (state='contradicted') AS c, list_sort(list_append(list(residual) FILTER (state='supported' AND abs(residual) <= 0.02::DOUBLE), 0.0::DOUBLE)) AS v FROM look GROUP BY ordinal) SELECT ordinal, s AS supports, round(CASE WHEN len(v) >= 3 THEN v[len(v)//2+1] ELSE 0 END,6) AS shift FROM c WHERE s >= least(1, asked) AND s > c")
def c3(spark, sf):
    return raster.depth_consensus(lookups(spark, sf)[1], views=1).select("ordinal", "supports", r6(F.col("shift")).alias("shift"))


@query("c7_visibility_validation", f"WITH {LOOK}, c AS (SELECT ordinal, count(*) FILTER (state='supported') AS s, count(*) FILTER (state='contradicted') AS c FROM look GROUP BY ordinal) SELECT ordinal FROM c WHERE NOT (s < 2 AND c >= 3)")
def c7(spark, sf):
    p, found = lookups(spark, sf)
    return raster.visibility_validated(p, found, most=1.0)[0].select("ordinal")


@query("f8_mesh_visibility", f"WITH {LOOK} SELECT DISTINCT p.ordinal, round(p.score*0.25::DOUBLE,6) AS score FROM points p JOIN look l ON l.ordinal = p.ordinal AND abs(residual) <= 0.1::DOUBLE")
def f8(spark, sf):
    p, found = lookups(spark, sf)
    vertices = p.join(ad.points(spark, sf).select("ordinal", "score"), "ordinal")
    return raster.mesh_visible(vertices, found).select("ordinal", r6(F.col("score")).alias("score"))


@query("f12_feature_depth", f"WITH {PIX}, c AS (SELECT frame_id, count(*) AS n, min(z) AS lo, max(z) AS hi FROM pix WHERE u BETWEEN 2 AND 4 AND v BETWEEN 2 AND 4 GROUP BY frame_id), q AS (SELECT frame_id, sum(z)/4 AS depth FROM pix WHERE u IN (3,4) AND v IN (3,4) GROUP BY frame_id) SELECT c.frame_id, round(depth,6) AS depth FROM c JOIN q USING (frame_id) WHERE n = 9 AND hi-lo <= 0.5::DOUBLE*lo")
def f12(spark, sf):
    own = pixels(spark, sf).withColumn("conf", F.lit(2))
    features = own.select("scan_id", "frame_id").distinct().select("scan_id", "frame_id", F.lit(0).alias("id"), F.lit(3.5).alias("u"), F.lit(3.5).alias("v"), F.lit(2.0).alias("variance"))
    return raster.feature_depths(features, own, 0.5).select("frame_id", r6(F.col("depth")).alias("depth"))


#: Signed distances: cells that each sample touches on its normal, the first sample of a cell and frame, and a running mean in frame order.
TSDF = f"""{P}, k AS (SELECT unnest(range(-6, 7)) AS k), un AS (SELECT *, x/sqrt(x*x+y*y+z*z) AS nx, y/sqrt(x*x+y*y+z*z) AS ny, z/sqrt(x*x+y*y+z*z) AS nz FROM points),
 mv AS (SELECT *, x + nx*k*0.05::DOUBLE AS px, y + ny*k*0.05::DOUBLE AS py, z + nz*k*0.05::DOUBLE AS pz FROM un, k),
 cl AS (SELECT *, {ad.cell_sql('px', 0.1)} AS ci, {ad.cell_sql('py', 0.1)} AS cj, {ad.cell_sql('pz', 0.1)} AS ck FROM mv),
 up AS (SELECT *, {ad.key_sql('ci', 'cj', 'ck')} AS key, row_number() OVER (PARTITION BY scan_id, frame_id, ci, cj, ck ORDER BY ordinal, k) AS first FROM cl),
 sd AS (SELECT scan_id, frame_id, key, ci, cj, ck, (((ci+0.5::DOUBLE)*0.1::DOUBLE - x)*nx + ((cj+0.5::DOUBLE)*0.1::DOUBLE - y)*ny + ((ck+0.5::DOUBLE)*0.1::DOUBLE - z)*nz)/0.3::DOUBLE AS sdf, greatest(score, 0.01::DOUBLE) AS w, row_number() OVER (PARTITION BY scan_id, key ORDER BY frame_id) AS n FROM up WHERE first = 1),
 fold AS (SELECT scan_id, key, ci, cj, ck, n, sdf AS d, w FROM sd WHERE n = 1 UNION ALL SELECT s.scan_id, s.key, s.ci, s.cj, s.ck, s.n, (f.d*least(f.w, 24) + s.sdf*s.w)/(least(f.w, 24) + s.w), least(f.w, 24) + s.w FROM fold f JOIN sd s ON s.scan_id = f.scan_id AND s.key = f.key AND s.n = f.n + 1),
 tsdf AS (SELECT scan_id, key, ci, cj, ck, n AS views, d AS sdf FROM fold QUALIFY row_number() OVER (PARTITION BY scan_id, key ORDER BY n DESC) = 1)"""


@query("a9_tsdf_integration", f"WITH RECURSIVE {TSDF} SELECT scan_id, key, views, round(sdf,6) AS sdf FROM tsdf")
def a9(spark, sf):
    return fusion.tsdf_integrate(oriented(spark, sf), 0.1).select("scan_id", "key", "views", r6(F.col("sdf")).alias("sdf"))


@query("j22_tsdf_edges", f"""WITH RECURSIVE {TSDF}, ax AS (SELECT unnest([0, 1, 2]) AS axis), e AS (SELECT a.*, axis, b.sdf AS other FROM tsdf a, ax JOIN tsdf b ON b.scan_id = a.scan_id AND b.ci = a.ci + CAST(axis = 0 AS INT) AND b.cj = a.cj + CAST(axis = 1 AS INT) AND b.ck = a.ck + CAST(axis = 2 AS INT) WHERE a.sdf*b.sdf < 0)
 SELECT scan_id, key, axis, round((ci+0.5::DOUBLE)*0.1::DOUBLE + CASE WHEN axis = 0 THEN sdf/(sdf-other)*0.1::DOUBLE ELSE 0 END,6) AS x FROM e""")
def j22(spark, sf):
    return fusion.tsdf_crossings(fusion.tsdf_integrate(oriented(spark, sf), 0.1), 0.1, 1).select("scan_id", "key", "axis", r6(F.col("x")).alias("x"))


@query("c6_tsdf_surface", None)
def c6(spark, sf):
    p = oriented(spark, sf)
    return pl.tsdf_surface(p, p.select("scan_id", "x", "y", "z"), 0.1)[0].select("scan_id", r6(F.col("x")).alias("x"))


@query("c5_refusion", None)
def c5(spark, sf):
    k = F.struct(F.lit(8.0).alias("fx"), F.lit(8.0).alias("fy"), F.lit(3.5).alias("cx"), F.lit(3.5).alias("cy"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    poses = ad.poses(spark, sf).select(F.lit("s").alias("scan_id"), F.col("id").alias("frame_id"), "pose", k.alias("intrinsics"))
    camera = g.Camera(*[F.lit(v) for v in (8.0, 8.0, 3.5, 3.5, 8, 8)])
    own = raster.accepted(pixels(spark, sf).withColumn("conf", F.lit(2)), camera, jump=0.3, steepest=89.0).withColumn("ordinal", F.col("frame_id") * 64 + F.col("v") * 8 + F.col("u"))
    return pl.refusion(own, poses, 0.1).select("scan_id", "far", "key", "samples")


#: Far points for which near points lie in all four quadrants of the tangent plane.
COVERED = f"""{P}, un AS (SELECT *, x/sqrt(x*x+y*y+z*z) AS nx, y/sqrt(x*x+y*y+z*z) AS ny, z/sqrt(x*x+y*y+z*z) AS nz FROM points),
 fa AS (SELECT *, CASE WHEN abs(nx) < 0.9::DOUBLE THEN 0 ELSE -nz END AS t0, CASE WHEN abs(nx) < 0.9::DOUBLE THEN nz ELSE 0 END AS t1, CASE WHEN abs(nx) < 0.9::DOUBLE THEN -ny ELSE nx END AS t2 FROM un WHERE far),
 fr AS (SELECT *, ny*t2 - nz*t1 AS b0, nz*t0 - nx*t2 AS b1, nx*t1 - ny*t0 AS b2 FROM fa),
 pr AS (SELECT a.scan_id, a.ordinal, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) AS d, a.nx*b.nx+a.ny*b.ny+a.nz*b.nz AS cos, ((b.x-a.x)*t0+(b.y-a.y)*t1+(b.z-a.z)*t2 >= 0) AS qa, ((b.x-a.x)*b0+(b.y-a.y)*b1+(b.z-a.z)*b2 >= 0) AS qb FROM fr a JOIN un b ON a.scan_id = b.scan_id AND NOT b.far)"""


@query("c8_far_coverage", f"""WITH {COVERED}, cv AS (SELECT scan_id, ordinal FROM pr WHERE d <= 0.15::DOUBLE AND cos >= 0.94::DOUBLE GROUP BY scan_id, ordinal HAVING count(DISTINCT (qa, qb)) = 4 AND min(d) <= 0.035::DOUBLE)
 SELECT scan_id, ordinal FROM points p WHERE far AND NOT EXISTS (SELECT 1 FROM cv WHERE cv.scan_id = p.scan_id AND cv.ordinal = p.ordinal)""")
def c8(spark, sf):
    p = oriented(spark, sf)
    return pl.far_coverage(p.filter("far"), p.filter("not far")).select("scan_id", "ordinal")


@query("j18_covered_by", f"WITH {COVERED} SELECT scan_id, ordinal FROM pr WHERE d <= 0.4::DOUBLE AND cos >= -1 GROUP BY scan_id, ordinal HAVING count(DISTINCT (qa, qb)) = 4 AND min(d) <= 0.3::DOUBLE")
def j18(spark, sf):
    p = oriented(spark, sf)
    return spatial.covered_by(p.filter("far"), p.filter("not far"), radius=0.4, closest=0.3, alike=-1.0)


def patches(spark, sf):
    n = F.sqrt(F.aggregate(F.slice("embedding", 8, 9), F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    patch = F.transform(F.slice("embedding", 8, 9), lambda x: x.cast("double") / n)
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").cast("string").alias("scan_id"), F.col("label").alias("frame_id"), F.col("vec_id").alias("id"), F.col("vec_id").alias("ordinal"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], (F.col("embedding")[0] * 100).cast("double").alias("u"), (F.col("embedding")[1] * 100).cast("double").alias("v"), patch.alias("patch"))


MATCH = """e AS (SELECT vec_id AS id, label AS f, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, list_transform(e[8:16], lambda x: x / sqrt(list_sum(list_transform(e[8:16], lambda y: y*y)))) AS p FROM e)"""


@query("j9_feature_match", f"""WITH {MATCH}, s AS (SELECT a.f AS frame_id, a.id AS p, b.id AS q, list_dot_product(a.p, b.p) AS ncc FROM n a JOIN n b ON a.f = b.f AND a.id % 2 = 0 AND b.id % 2 = 1 WHERE pow(CAST(a.e[1] AS FLOAT)*100 - CAST(b.e[1] AS FLOAT)*100, 2) + pow(CAST(a.e[2] AS FLOAT)*100 - CAST(b.e[2] AS FLOAT)*100, 2) <= 784),
 r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, p ORDER BY ncc DESC, q) AS ra, row_number() OVER (PARTITION BY frame_id, q ORDER BY ncc DESC, p) AS rb, coalesce(lead(ncc) OVER (PARTITION BY frame_id, p ORDER BY ncc DESC, q), -1) AS second FROM s) SELECT frame_id, p, q AS f FROM r WHERE ra = 1 AND rb = 1 AND ncc >= 0.4::DOUBLE AND second <= 0.9::DOUBLE*ncc""")
def j9(spark, sf):
    own = patches(spark, sf)
    return spatial.feature_match(own.filter("id % 2 = 1"), own.filter("id % 2 = 0"), least=0.4).select("frame_id", "p", "f")


@query("j10_reciprocal_match", f"""WITH {MATCH}, s AS (SELECT a.f AS scan, a.id AS a, b.id AS b, list_dot_product(a.p, b.p) AS ncc FROM n a JOIN n b ON a.f = b.f AND a.id % 2 = 0 AND b.id % 2 = 1 WHERE sqrt((a.e[1]-b.e[1])*(a.e[1]-b.e[1])+(a.e[2]-b.e[2])*(a.e[2]-b.e[2])+(a.e[3]-b.e[3])*(a.e[3]-b.e[3])) <= 0.3::DOUBLE),
 r AS (SELECT *, row_number() OVER (PARTITION BY scan, a ORDER BY ncc DESC, b) AS ra, row_number() OVER (PARTITION BY scan, b ORDER BY ncc DESC, a) AS rb, coalesce(lead(ncc) OVER (PARTITION BY scan, a ORDER BY ncc DESC, b), -1) AS second FROM s) SELECT CAST(scan AS VARCHAR) AS scan_id, a, b FROM r WHERE ra = 1 AND rb = 1 AND ncc >= 0.4::DOUBLE AND second < 0.9::DOUBLE*ncc""")
def j10(spark, sf):
    own = patches(spark, sf)
    return spatial.reciprocal_match(own.filter("ordinal % 2 = 0"), own.filter("ordinal % 2 = 1"), least=0.4).select("scan_id", "a", "b")


@query("j11_plane_warp", f"""WITH {BYTES}, b AS (SELECT frame_id, v*8 + u AS k, u, v, l FROM px), o AS (SELECT i, i % 5 AS du, i // 5 AS dv FROM range(25) t(i)),
 m AS (SELECT t.frame_id, o.i, o.du, o.dv, t.l AS a, w.l AS b FROM b t, o JOIN b w ON w.frame_id = t.frame_id AND w.u = t.k % 4 + o.du AND w.v = t.k // 4 + o.dv WHERE t.k < 16),
 n AS (SELECT frame_id, i, du, dv, CASE WHEN stddev_pop(a)*stddev_pop(b) > 0 THEN corr(a, b) ELSE -1 END AS ncc FROM m GROUP BY frame_id, i, du, dv), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY ncc DESC, i) AS best FROM n)
 SELECT frame_id AS pair_id, 0 AS id, CAST(du - 2 AS INT) AS du, CAST(dv - 2 AS INT) AS dv, round(ncc,6) AS ncc FROM r WHERE best = 1""")
def j11(spark, sf):
    own = luma(spark, sf)
    templates = own.select(F.col("frame_id").alias("pair_id"), F.lit(0).cast("long").alias("id"), F.lit(4).alias("size"), F.col("luma").substr(1, 16).alias("patch"), F.col("luma").alias("window"))
    return kernels.plane_warp_match(templates.withColumn("patch", F.substring("window", 1, 16)), reach=2, least=-1.0).withColumn("ncc", r6(F.col("ncc")))


DIFFER = f"{ENERGY}, df AS (SELECT a.frame_id, b.frame_id AS peer_id, ln(a.energy) - ln(b.energy) AS difference FROM energy a JOIN energy b ON b.frame_id = a.frame_id + 1 AND a.i = b.i AND a.j = b.j AND a.energy > 0 AND b.energy > 0)"


@query("j14_covisible_cells", f"WITH {DIFFER} SELECT frame_id, peer_id, round(difference,6) AS difference FROM df")
def j14(spark, sf):
    return covisible(spark, sf).withColumn("difference", r6(F.col("difference")))


def covisible(spark, sf):
    cells = raster.cell_energies(luma(spark, sf), 4)
    targets = cells.select("frame_id", "i", "j", (F.col("frame_id") + 1).alias("peer_id"), F.col("i").alias("pi"), F.col("j").alias("pj"), F.lit(1.0).alias("depth"), F.lit(1.0).alias("peer_depth"), F.lit(1.0).alias("scale"))
    return raster.covisible_differences(cells, targets)


@query("c19_covisible_sharpness", f"WITH {DIFFER}, pr AS (SELECT frame_id, list_sort(list(-difference)) AS s FROM df GROUP BY frame_id) SELECT frame_id, 1 AS peers, round(greatest(0.2::DOUBLE, exp(-greatest(s[len(s)//2+1], 0))),6) AS weight FROM pr")
def c19(spark, sf):
    return raster.covisible_weights(covisible(spark, sf)).select("frame_id", "peers", r6(F.col("weight")).alias("weight"))


@query("j20_room_labels", f"WITH {Q}, r AS (SELECT id, CASE WHEN abs(a) < 0.05::DOUBLE AND abs(b) < 0.05::DOUBLE THEN 'inner' WHEN abs(a) < 0.2::DOUBLE AND abs(b) < 0.2::DOUBLE THEN 'outer' END AS label FROM poses) SELECT id, label FROM r")
def j20(spark, sf):
    from stereoloom.operators.metrics import smallest_room

    square = lambda s: [-s, -s, s, -s, s, s, -s, s]
    rooms = spark.range(2).select(F.lit("s").alias("scan_id"), F.when(F.col("id") == 0, "inner").otherwise("outer").alias("label"), F.when(F.col("id") == 0, F.array(*[F.lit(v) for v in square(0.05)])).otherwise(F.array(*[F.lit(v) for v in square(0.2)])).alias("polygon2D"))
    pts = ad.poses(spark, sf).select(F.lit("s").alias("scan_id"), "id", F.col("a").alias("px"), F.col("b").alias("py"))
    return smallest_room(pts, rooms).select("id", "label")


@query("j23_depth_cross_check", f"WITH {PIX}, m AS (SELECT a.frame_id, a.u, a.v, a.z AS depth, b.z AS other FROM pix a JOIN pix b ON a.u = b.u AND a.v = b.v AND b.frame_id BETWEEN a.frame_id + 1 AND a.frame_id + 20), c AS (SELECT frame_id, u, v, depth, count(*) AS n, sum(other) AS s FROM m WHERE abs(other-depth) <= 0.01::DOUBLE*depth GROUP BY frame_id, u, v, depth) SELECT frame_id, u, v, n, round((s+depth)/(n+1),6) AS depth FROM c WHERE n >= 2")
def j23(spark, sf):
    """Blocks of as many frames as one looks ahead: what it may meet lies in its own block or the next, so a pixel is shuffled three times and not 21. No side is broadcast: both come out of a small file many times larger."""
    p = pixels(spark, sf)
    block = F.col("frame_id") - F.pmod("frame_id", F.lit(20))
    own = p.select("frame_id", "u", "v", F.col("z").alias("depth"), block.alias("block"))
    other = p.select("u", "v", F.col("frame_id").alias("other_id"), F.col("z").alias("other_depth"), F.explode(F.array(block, block - 20)).alias("block"))
    m = own.hint("merge").join(other, ["block", "u", "v"]).filter("other_id between frame_id + 1 and frame_id + 20").withColumn("reprojection_error", F.lit(1.0))
    return raster.cross_checked(m, ["frame_id", "u", "v"]).withColumn("depth", r6(F.col("depth")))


@query("c9_feature_tracks", f"""WITH RECURSIVE {MATCH}, s AS (SELECT a.f AS frame_id, a.id AS p, b.id AS q, list_dot_product(a.p, b.p) AS ncc FROM n a JOIN n b ON a.f = b.f AND a.id % 2 = 0 AND b.id % 2 = 1 WHERE pow(CAST(a.e[1] AS FLOAT)*100 - CAST(b.e[1] AS FLOAT)*100, 2) + pow(CAST(a.e[2] AS FLOAT)*100 - CAST(b.e[2] AS FLOAT)*100, 2) <= 784),
 r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, p ORDER BY ncc DESC, q) AS ra, row_number() OVER (PARTITION BY frame_id, q ORDER BY ncc DESC, p) AS rb, coalesce(lead(ncc) OVER (PARTITION BY frame_id, p ORDER BY ncc DESC, q), -1) AS second FROM s),
 m AS (SELECT p AS a, q AS b FROM r WHERE ra = 1 AND rb = 1 AND ncc >= 0.4::DOUBLE AND second <= 0.9::DOUBLE*ncc), link AS (SELECT a, b FROM m UNION ALL SELECT b, a FROM m),
 reach AS (SELECT id, id AS root FROM n UNION SELECT link.b, x.root FROM reach x JOIN link ON link.a = x.id), c AS (SELECT id, min(root) AS track FROM reach GROUP BY id), f AS (SELECT *, row_number() OVER (PARTITION BY track, id % 2 ORDER BY id) AS k FROM c) SELECT id AS feature_id, track AS track_id FROM f WHERE k = 1""")
def c9(spark, sf):
    own = patches(spark, sf)
    m = spatial.feature_match(own.filter("id % 2 = 1"), own.filter("id % 2 = 0"), least=0.4).select(F.col("p").alias("a"), F.col("f").alias("b"))
    return kernels.feature_tracks(m, own.select("scan_id", F.col("id").alias("feature_id"), (F.col("id") % 2).alias("frame_id"))).select("feature_id", "track_id")


@query("c10_bundle_adjustment", "SELECT DISTINCT vec_id // 60 AS scan_id, CAST(f AS BIGINT) AS frame_id, true AS accepted, 0.1::DOUBLE * f AS tx FROM embeddings, range(3) t(f)")
def c10(spark, sf):
    pts = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.expr("vec_id div 60").alias("scan_id"), F.col("vec_id").alias("track_id"), F.col("embedding")[0].cast("double").alias("px"), F.col("embedding")[1].cast("double").alias("py"), (F.col("embedding")[2].cast("double") - 2).alias("pz"))
    seen = pts.withColumn("frame_id", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    x = F.col("px") + F.col("frame_id") * 0.1
    obs = seen.select("scan_id", F.col("frame_id").cast("long").alias("frame_id"), "track_id", (300 * x / -F.col("pz") + 160).alias("u"), (120 - 300 * F.col("py") / -F.col("pz")).alias("v"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("frame_id") * 0.12, F.lit(0.0), F.lit(0.0)).alias("pose"), "px", "py", "pz", F.lit(300.0).alias("fx"), F.lit(300.0).alias("fy"), F.lit(160.0).alias("cx"), F.lit(120.0).alias("cy"))
    return kernels.bundle_adjustment(obs).select("scan_id", "frame_id", "accepted", F.round(F.col("pose")[3], 3).alias("tx"))


@query("c16_camera_tracking", None)
def c16(spark, sf):
    """Each image and itself, moved one pixel to the right."""
    moved = luma(spark, sf, shift=True).select("frame_id", F.col("luma").alias("luma_b"))
    pairs = luma(spark, sf).join(moved, "frame_id").select(F.col("frame_id").alias("pair_id"), "width", "height", F.col("luma").alias("luma_a"), "luma_b", F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(4.0).alias("u"), F.lit(4.0).alias("v"))).alias("points"))
    return kernels.tracked(pairs).select("pair_id", "id", F.round("u", 3).alias("u"))


@query("c20_dataset_preparation", None)
def c20(spark, sf):
    fr = ad.frames(spark, sf).withColumns({"exposure_blur": F.col("blur"), "sharpness": F.abs("dx"), "detail": F.abs("dy"), "exposure": F.lit(0.01), "iso": F.lit(100.0)})
    columns = ["scan_id", "timestamp", "blur", "x", "y", "z", "dx", "dy", "dz", "signature", "exposure_blur", "sharpness", "detail", "exposure", "iso"]
    own = fr.select("id", *columns)
    return pl.dataset_preparation(own, own.filter("id % 4 = 0"), columns).select("scan_id", "id", "holdout", r6(F.col("ev")).alias("ev"))


@query("c27_metric_scale", f"WITH {FR}, r AS (SELECT scan_id, sqrt(x*x+y*y+z*z) AS m, sqrt(x*x+y*y+z*z)*2 AS k FROM frames WHERE sqrt(x*x+y*y+z*z)*2 BETWEEN 0.1::DOUBLE AND 1000) SELECT scan_id, round(quantile_cont(k/m, 0.5),6) AS scale, count(*) AS n FROM r WHERE m > 0 GROUP BY scan_id")
def c27(spark, sf):
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    own = ad.frames(spark, sf).select("scan_id", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("start"), F.array("x", "y", "z").alias("end"), (n * 2).alias("knownMeters"))
    return pl.metric_scales(own).select("scan_id", r6(F.col("scale")).alias("scale"), F.col("references").alias("n"))


@query("c31_metric_archive", "SELECT doc_id AS scan_id, doc_id % 3 = 0 AS stale FROM documents")
def c31(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("scan_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    scale = d.select("scan_id", F.when(F.col("scan_id") % 3 == 0, F.lit("old")).otherwise(F.sha2("content", 256)).alias("fingerprint"))
    return pl.stale(scale, d).select("scan_id", "stale")


@query("sp6_codebooks", None)
def sp6(spark, sf):
    p = ad.points(spark, sf)
    return splats.codebook_index(p, "score", graph.codebook(p, "score", 32, 4)).groupBy("entry").agg(F.count("*").alias("n"))


@query("sp9_hole_seeds", f"WITH {PIX}, h AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY abs(luma-128) DESC, v, u) AS rn FROM pix WHERE z > 1.02::DOUBLE AND abs(luma-128) > 8) SELECT frame_id, u, v FROM h WHERE rn <= 5")
def sp9(spark, sf):
    own = pixels(spark, sf).withColumns({"transmittance": F.col("z") - 0.62, "error": F.abs(F.col("luma") - 128) / 100, "depth": F.col("z")})
    return splats.hole_seeds(own, ["frame_id"], 5).select("frame_id", "u", "v")


@query("sp10_transient_mask", f"""WITH {PIX}, b AS (SELECT frame_id // 5 AS f, frame_id % 5 AS w, u, v, abs(luma-128) AS d FROM pix), m AS (SELECT *, d > greatest(0.05::DOUBLE, 1.5::DOUBLE*quantile_cont(d, 0.5) OVER (PARTITION BY f, w)) AS hot FROM b), n AS (SELECT a.f, a.w, a.u, a.v, a.hot AND bool_or(coalesce(c.hot, false)) AS now FROM m a LEFT JOIN m c ON a.f = c.f AND a.w = c.w AND abs(a.u-c.u) <= 1 AND abs(a.v-c.v) <= 1 AND (a.u <> c.u OR a.v <> c.v) GROUP BY a.f, a.w, a.u, a.v, a.hot)
 SELECT x.f, x.w AS window_, x.u AS i, x.v AS j FROM n x JOIN n y ON x.f = y.f AND x.u = y.u AND x.v = y.v AND y.w = x.w - 1 WHERE x.now AND y.now""")
def sp10(spark, sf):
    own = pixels(spark, sf).select(F.floor(F.col("frame_id") / 5).alias("f"), (F.col("frame_id") % 5).alias("window"), F.col("u").alias("i"), F.col("v").alias("j"), F.abs(F.col("luma") - 128).alias("difference"))
    return splats.transient_mask(own, ["f"], 1.5).filter("masked").select("f", F.col("window").alias("window_"), "i", "j")


@query("io5_depth_rasters", f"WITH {BYTES} SELECT CAST(frame_id AS INT) AS frame_id, count(*) AS n, CAST(sum(l) AS BIGINT) AS conf FROM px WHERE v < 2 GROUP BY frame_id")
def io5(spark, sf):
    own = luma(spark, sf).select(F.lit("s").alias("scan_id"), F.col("frame_id").cast("int").alias("frame_id"), F.lit(4).alias("width"), F.lit(4).alias("height"), F.substring("luma", 1, 64).alias("depth"), F.substring("luma", 1, 16).alias("conf"))
    return raster.depth_samples(own).groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("conf").alias("conf"))


@query("io9_colmap_binary", f"""WITH {P}, i AS (SELECT CAST(vec_id % 10 AS VARCHAR) AS scan_id, count(*) AS n, sum(length('f' || vec_id || '.jpg')) AS names FROM embeddings GROUP BY 1), p AS (SELECT scan_id, count(*) AS n FROM points GROUP BY scan_id)
 SELECT CAST(s AS VARCHAR) AS scan_id, 'cameras.bin' AS name, CAST(8 + 24 + 4*8 AS INT) AS bytes FROM (SELECT DISTINCT vec_id % 10 AS s FROM embeddings) UNION ALL SELECT scan_id, 'images.bin', CAST(8 + n*(4 + 7*8 + 4 + 1 + 8) + names AS INT) FROM i UNION ALL SELECT scan_id, 'points3D.bin', CAST(8 + n*(8 + 3*8 + 3 + 8 + 8) AS INT) FROM p""")
def io9(spark, sf):
    p = ad.points(spark, sf)
    pts = p.select("scan_id", F.col("ordinal").alias("point_id"), "x", "y", "z", *[F.lit(9).alias(c) for c in "rgb"], F.lit(0.5).alias("error"))
    scan = (F.col("id") % 10).cast("string").alias("scan_id")
    poses = ad.poses(spark, sf).select(scan, F.col("id").alias("image_id"), g.colmap_pose("pose").alias("p"))
    images = poses.select("scan_id", "image_id", *[F.col(f"p.{c}") for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")], F.lit(1).cast("long").alias("camera_id"), F.format_string("f%d.jpg", "image_id").alias("name"))
    cameras = poses.select("scan_id").distinct().select("scan_id", F.lit(1).cast("long").alias("camera_id"), F.lit("PINHOLE").alias("model"), F.lit(640).cast("long").alias("width"), F.lit(480).cast("long").alias("height"), F.array(*[F.lit(v) for v in (500.0, 500.0, 320.0, 240.0)]).alias("params"))
    return colmap.model_files(cameras, images, pts).select("scan_id", "name", F.length("content").alias("bytes"))


@query("io11_nerf_transforms", f"WITH {Q} SELECT CAST(id % 5 AS VARCHAR) AS scan_id, CAST(count(*) + 1 AS INT) AS frames FROM poses GROUP BY 1")
def io11(spark, sf):
    own = ad.poses(spark, sf).select((F.col("id") % 5).cast("string").alias("scan_id"), "id", F.col("pose").alias("transform"), "intrinsics", F.format_string("f%d.jpg", "id").alias("imageFile"))
    return scans.nerf_transforms(own).select("scan_id", F.size(F.split("json", "file_path")).alias("frames"))


@query("io20_floor_plan_svg", f"WITH {Q} SELECT id % 5 AS scan_id, count(*) AS lines FROM poses GROUP BY 1")
def io20(spark, sf):
    own = ad.poses(spark, sf).select((F.col("id") % 5).alias("scan_id"), F.col("tx").alias("x0"), F.col("ty").alias("y0"), F.col("a").alias("x1"), F.col("b").alias("y1"))
    return scans.floor_plan_svg(own).select("scan_id", (F.size(F.split("svg", "<line")) - 1).cast("long").alias("lines"))


@query("io23_synthetic_scan", f"WITH {P}, n AS (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY ordinal) - 1 AS id, count(*) OVER (PARTITION BY scan_id) AS frames FROM points) SELECT scan_id, CAST(id AS INT) AS id, 2.0::DOUBLE AS towards_centre, 0.0::DOUBLE AS dy, round(2*cos(id*2*pi()/frames),6) + 0.0 AS x FROM n")
def io23(spark, sf):
    """A circle of as many frames as a scan has points, for every scan."""
    frames = scans.orbits(ad.points(spark, sf).groupBy("scan_id").agg(F.count("*").alias("frames")))
    x, y, z = g.forward("transform")
    return frames.select("scan_id", "id", r6(-(x * F.col("transform")[3] + z * F.col("transform")[11])).alias("towards_centre"), (r6(y) + 0.0).alias("dy"), (r6(F.col("transform")[3]) + 0.0).alias("x"))


@query("a30_stencil", f"WITH {NB} SELECT frame_id, count(l) AS l, count(r) AS r, count(t) AS t, count(b) AS b FROM nb GROUP BY frame_id")
def stencil(spark, sf):
    from stereoloom.operators.metrics import stencil as s

    return s(pixels(spark, sf)).groupBy("frame_id").agg(F.count("left").alias("l"), F.count("right").alias("r"), F.count("up").alias("t"), F.count("down").alias("b"))
