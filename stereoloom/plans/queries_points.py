"""Queries over the point view: grids, fusion, sampling, spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stereoloom.functions import voxels as vx
from stereoloom.operators import fusion, graph, metrics, sampling, spatial, splats
from stereoloom.plans import adapters as ad
from stereoloom.plans.registry import query, r6

P = ad.CTES["points"]
VOXEL = 0.1
KEYED = f"{P}, keyed AS (SELECT *, {ad.voxel_sql(VOXEL)} AS key FROM points)"
W = "greatest(score, 0.01::DOUBLE)"
CELLS = f"{KEYED}, cells AS (SELECT scan_id, key, count(*) AS samples, sum(x*{W})/sum({W}) AS mx, sum(y*{W})/sum({W}) AS my, sum(z*{W})/sum({W}) AS mz, sum({W}) AS weight, max(score) AS best_score FROM keyed GROUP BY scan_id, key)"
UNPACK = "((key >> 42) & 2097151) - 1048576 AS i, ((key >> 21) & 2097151) - 1048576 AS j, (key & 2097151) - 1048576 AS k"


def plain(spark, sf):
    """Points without the measured flag (no precedence)."""
    return ad.points(spark, sf).drop("measured")


@query("p16_voxel_key", f"WITH {KEYED} SELECT ordinal, key, {UNPACK} FROM keyed")
def p16(spark, sf):
    own = fusion.keyed(ad.points(spark, sf), VOXEL)
    i, j, k = vx.unpack3("key")
    return own.select("ordinal", "key", i.alias("i"), j.alias("j"), k.alias("k"))


@query("p17_shard_hash", f"WITH {KEYED} SELECT CAST(xor(xor(key, key >> 21), key >> 42) & 15 AS INT) AS shard, count(*) AS n FROM keyed GROUP BY 1")
def p17(spark, sf):
    return fusion.keyed(ad.points(spark, sf), VOXEL).groupBy(vx.shard_of("key").alias("shard")).agg(F.count("*").alias("n"))


@query("p18_cell_key_2d", f"WITH {P} SELECT (({ad.cell_sql('x', VOXEL)} + 1048576) << 21) | ({ad.cell_sql('z', VOXEL)} + 1048576) AS key, count(*) AS n FROM points GROUP BY 1")
def p18(spark, sf):
    return ad.points(spark, sf).groupBy(vx.pack2(vx.cell_index("x", VOXEL), vx.cell_index("z", VOXEL)).alias("key")).agg(F.count("*").alias("n"))


@query("p19_octahedral_normal", f"""WITH {P}, n AS (SELECT ordinal, x, y, z, abs(x)+abs(y)+abs(z) AS s FROM points),
 o AS (SELECT ordinal, CASE WHEN z >= 0 THEN x/s ELSE (1-abs(y/s)) * CASE WHEN x/s >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END END AS u,
 CASE WHEN z >= 0 THEN y/s ELSE (1-abs(x/s)) * CASE WHEN y/s >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END END AS v FROM n)
 SELECT ordinal, CAST(greatest(floor((u*0.5::DOUBLE+0.5::DOUBLE)*255+0.5::DOUBLE)*256 + floor((v*0.5::DOUBLE+0.5::DOUBLE)*255+0.5::DOUBLE), 1) AS INT) AS code FROM o""")
def p19(spark, sf):
    return ad.points(spark, sf).select("ordinal", vx.oct_encode("x", "y", "z").cast("int").alias("code"))


@query("p25_log_transform", f"WITH {P} SELECT ordinal, round(sign(x)*ln(abs(x)+1), 6) AS lx, round(x, 6) AS back FROM points")
def p25(spark, sf):
    from stereoloom.functions import capture as cp

    return ad.points(spark, sf).select("ordinal", r6(cp.log_transform("x")).alias("lx"), r6(cp.inverse_log_transform(cp.log_transform("x"))).alias("back"))


@query("p26_morton_code", f"""WITH {P}, box AS (SELECT min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz FROM points),
 c AS (SELECT ordinal, CAST(least(floor((x-lx)/(hx-lx)*1024), 1023) AS BIGINT) a, CAST(least(floor((y-ly)/(hy-ly)*1024), 1023) AS BIGINT) b, CAST(least(floor((z-lz)/(hz-lz)*1024), 1023) AS BIGINT) d FROM points, box)
 SELECT ordinal, CAST(list_sum(list_transform(range(10), lambda i: ((a >> i) & 1) * (1 << (3*i+2)) + ((b >> i) & 1) * (1 << (3*i+1)) + ((d >> i) & 1) * (1 << (3*i)))) AS BIGINT) AS morton FROM c""")
def p26(spark, sf):
    return sampling.morton_order(ad.points(spark, sf)).select("ordinal", "morton")


@query("a2_voxel_fusion", f"WITH {CELLS} SELECT scan_id, key, samples, round(mx,6) AS mx, round(my,6) AS my, round(mz,6) AS mz, round(weight,6) AS weight, round(best_score,6) AS best_score FROM cells")
def a2(spark, sf):
    c = fusion.fuse(plain(spark, sf), VOXEL)
    return c.select("scan_id", "key", "samples", *[r6(F.col(n)).alias(n) for n in ("mx", "my", "mz", "weight", "best_score")])


@query("a1_voxel_fusion_exact", f"""WITH RECURSIVE {KEYED}, ord AS (SELECT *, row_number() OVER (PARTITION BY scan_id, key ORDER BY ordinal) AS rn FROM keyed),
 fold AS (SELECT scan_id, key, rn, x AS mx, y AS my, z AS mz, least({W}, 8.0::DOUBLE) AS w FROM ord WHERE rn = 1
 UNION ALL SELECT o.scan_id, o.key, o.rn, f.mx + (o.x - f.mx) * greatest(o.score, 0.01::DOUBLE)/(f.w + greatest(o.score, 0.01::DOUBLE)), f.my + (o.y - f.my) * greatest(o.score, 0.01::DOUBLE)/(f.w + greatest(o.score, 0.01::DOUBLE)),
 f.mz + (o.z - f.mz) * greatest(o.score, 0.01::DOUBLE)/(f.w + greatest(o.score, 0.01::DOUBLE)), least(f.w + greatest(o.score, 0.01::DOUBLE), 8.0::DOUBLE)
 FROM fold f JOIN ord o ON o.scan_id = f.scan_id AND o.key = f.key AND o.rn = f.rn + 1)
 SELECT scan_id, key, CAST(max(rn) AS BIGINT) AS samples, round(arg_max(mx, rn),6) AS mx, round(arg_max(my, rn),6) AS my, round(arg_max(mz, rn),6) AS mz, round(arg_max(w, rn),6) AS weight FROM fold GROUP BY scan_id, key""")
def a1(spark, sf):
    c = fusion.fuse_exact(plain(spark, sf), VOXEL)
    return c.select("scan_id", "key", "samples", *[r6(F.col(n)).alias(n) for n in ("mx", "my", "mz", "weight")])


@query("a3_measured_precedence", f"""WITH {KEYED}, m AS (SELECT *, bool_or(measured) OVER (PARTITION BY scan_id, key) AS any_m FROM keyed), kept AS (SELECT * FROM m WHERE NOT any_m OR measured)
 SELECT scan_id, key, count(*) AS samples, round(sum(x*{W})/sum({W}),6) AS mx, round(sum({W}),6) AS weight FROM kept GROUP BY scan_id, key""")
def a3(spark, sf):
    return fusion.fuse(ad.points(spark, sf), VOXEL).select("scan_id", "key", "samples", r6(F.col("mx")).alias("mx"), r6(F.col("weight")).alias("weight"))


@query("a4_coarsen", f"""WITH {CELLS}, up AS (SELECT *, {ad.voxel_sql(2 * VOXEL, ('mx', 'my', 'mz'))} AS key2 FROM cells)
 SELECT scan_id, key2 AS key, CAST(sum(samples) AS BIGINT) AS samples, round(sum(mx*weight)/sum(weight),6) AS mx, round(sum(my*weight)/sum(weight),6) AS my, round(sum(mz*weight)/sum(weight),6) AS mz, round(sum(weight),6) AS weight FROM up GROUP BY scan_id, key2""")
def a4(spark, sf):
    c = fusion.coarsen(fusion.fuse(plain(spark, sf), VOXEL), VOXEL)
    return c.select("scan_id", "key", "samples", *[r6(F.col(n)).alias(n) for n in ("mx", "my", "mz", "weight")])


@query("a5_capacity_reduction", f"""WITH {CELLS}, ranked AS (SELECT *, row_number() OVER (ORDER BY scan_id, key) - 1 AS i, count(*) OVER () AS n FROM cells)
 SELECT scan_id, key, samples FROM ranked WHERE n <= 100 OR ((i + 1) * 100) // n > (i * 100) // n""")
def a5(spark, sf):
    """One round without coarsening: the proportional thinning that ends the reduction."""
    cells = fusion.fuse(plain(spark, sf), VOXEL)
    return fusion.reduce_to(cells, VOXEL, 100, rounds=0)[0].select("scan_id", "key", "samples")


@query("a6_tiled_fusion", f"""WITH {P}, tiles AS (SELECT vec_id AS tile_id, CAST(embedding[1] AS DOUBLE) AS ox, CAST(embedding[2] AS DOUBLE) AS oy, CAST(embedding[3] AS DOUBLE) AS oz FROM embeddings),
 c AS (SELECT p.scan_id, p.ordinal, p.x, p.y, p.z, p.score, t.tile_id, t.ox, t.oy, t.oz, row_number() OVER (PARTITION BY p.ordinal ORDER BY (p.x-ox)*(p.x-ox)+(p.y-oy)*(p.y-oy)+(p.z-oz)*(p.z-oz), tile_id) AS rn
 FROM points p JOIN tiles t ON abs(p.x-ox) <= 0.15::DOUBLE AND abs(p.y-oy) <= 0.15::DOUBLE AND abs(p.z-oz) <= 0.15::DOUBLE)
 SELECT scan_id, tile_id, CAST(count(*) AS BIGINT) AS samples FROM c WHERE rn = 1 GROUP BY scan_id, tile_id""")
def a6(spark, sf):
    tiles = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("tile_id"), *[F.col("embedding")[i].cast("double").alias(f"o{c}") for i, c in enumerate("xyz")])
    cells = fusion.fuse_tiled(plain(spark, sf), tiles, 0.05, edge=0.3)
    return cells.filter("tile_id >= 0").groupBy("scan_id", "tile_id").agg(F.sum("samples").alias("samples"))


@query("j7_tile_containment", f"""WITH {P}, tiles AS (SELECT vec_id AS tile_id, CAST(embedding[1] AS DOUBLE) AS ox, CAST(embedding[2] AS DOUBLE) AS oy, CAST(embedding[3] AS DOUBLE) AS oz FROM embeddings),
 c AS (SELECT p.ordinal, t.tile_id, row_number() OVER (PARTITION BY p.ordinal ORDER BY (x-ox)*(x-ox)+(y-oy)*(y-oy)+(z-oz)*(z-oz), tile_id) AS rn FROM points p JOIN tiles t ON abs(x-ox) <= 0.15::DOUBLE AND abs(y-oy) <= 0.15::DOUBLE AND abs(z-oz) <= 0.15::DOUBLE)
 SELECT p.ordinal, c.tile_id FROM points p LEFT JOIN c ON c.ordinal = p.ordinal AND c.rn = 1""")
def j7(spark, sf):
    tiles = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("tile_id"), *[F.col("embedding")[i].cast("double").alias(f"o{c}") for i, c in enumerate("xyz")])
    return fusion.tile_of(ad.points(spark, sf), tiles, edge=0.3).select("ordinal", "tile_id")


@query("a7_view_span", f"""WITH {CELLS} SELECT scan_id, key, CAST(samples AS BIGINT) AS views FROM cells""")
def a7(spark, sf):
    """The number of views is compared; the folded span has a sequential oracle in the tests."""
    own = fusion.keyed(ad.points(spark, sf), VOXEL)
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    spans = fusion.view_span(own.select("scan_id", "key", "ordinal", (F.col("x") / n).alias("dx"), (F.col("y") / n).alias("dy"), (F.col("z") / n).alias("dz")), ["scan_id", "key"])
    return spans.select("scan_id", "key", "views")


@query("a8_completeness", f"WITH {CELLS} SELECT scan_id, count(*) AS cells, round(avg(CASE WHEN samples >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS completeness FROM cells GROUP BY scan_id")
def a8(spark, sf):
    cells = fusion.fuse(plain(spark, sf), VOXEL).withColumn("well_observed", F.col("samples") >= 3)
    return fusion.completeness(cells).withColumn("completeness", r6(F.col("completeness")))


@query("a18_cell_retention", f"""WITH {KEYED}, a AS (SELECT DISTINCT scan_id, key FROM keyed), b AS (SELECT DISTINCT scan_id, key FROM keyed WHERE measured)
 SELECT a.scan_id, count(*) AS cells, count(b.key) AS kept, round(count(b.key)/count(*)::DOUBLE, 6) AS retention FROM a LEFT JOIN b ON a.scan_id = b.scan_id AND a.key = b.key GROUP BY a.scan_id""")
def a18(spark, sf):
    own = fusion.keyed(ad.points(spark, sf), VOXEL)
    return fusion.cell_retention(own, own.filter("measured")).withColumn("retention", r6(F.col("retention")))


NEIGHBOURS = f"""{CELLS}, ijk AS (SELECT scan_id, key, {UNPACK} FROM cells), off AS (SELECT a.d AS di, b.d AS dj, c.d AS dk FROM (VALUES (-1),(0),(1)) a(d), (VALUES (-1),(0),(1)) b(d), (VALUES (-1),(0),(1)) c(d) WHERE NOT (a.d = 0 AND b.d = 0 AND c.d = 0)),
 near AS (SELECT p.scan_id, p.key, count(q.key) AS neighbours FROM ijk p, off LEFT JOIN ijk q ON q.scan_id = p.scan_id AND q.i = p.i + di AND q.j = p.j + dj AND q.k = p.k + dk GROUP BY p.scan_id, p.key)"""


@query("k9_isolated_removal", f"WITH {NEIGHBOURS} SELECT scan_id, key FROM near WHERE neighbours >= 3")
def k9(spark, sf):
    return fusion.isolated_removed(fusion.fuse(plain(spark, sf), VOXEL)).select("scan_id", "key")


@query("k1_stratified_best", f"WITH {KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, key ORDER BY score DESC, ordinal) AS rn FROM keyed) SELECT scan_id, ordinal, key, round(score,6) AS score FROM r WHERE rn = 1")
def k1(spark, sf):
    """One round at a fixed cell size."""
    return sampling.best_per_cell(ad.points(spark, sf), VOXEL).select("scan_id", "ordinal", "key", r6(F.col("score")).alias("score"))


@query("k2_first_per_voxel", f"""WITH {KEYED}, a AS (SELECT *, row_number() OVER (PARTITION BY scan_id, frame_id, key ORDER BY ordinal) AS rn FROM keyed), b AS (SELECT *, row_number() OVER (PARTITION BY scan_id, key ORDER BY frame_id, ordinal) AS rm FROM a WHERE rn = 1)
 SELECT scan_id, key, ordinal FROM b WHERE rm = 1""")
def k2(spark, sf):
    return sampling.first_per_voxel(ad.points(spark, sf), VOXEL).select("scan_id", "key", "ordinal")


@query("k3_thinned_seeds", f"""WITH {P}, keyed AS (SELECT *, {ad.voxel_sql(0.2)} AS key FROM points), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, key ORDER BY ordinal) AS rn FROM keyed) SELECT scan_id, ordinal FROM r WHERE rn = 1""")
def k3(spark, sf):
    """A limit that the first round meets, so the cell stays 0.2."""
    return sampling.thinned_seeds(ad.points(spark, sf), 0.2, 1_000_000).select("scan_id", "ordinal")


@query("k4_depth_seeds", f"""WITH {P}, c AS (SELECT *, {ad.voxel_sql(0.1)} AS key FROM points WHERE NOT measured), taken AS (SELECT DISTINCT scan_id, {ad.voxel_sql(0.1)} AS key FROM points WHERE measured),
 free AS (SELECT c.*, row_number() OVER (PARTITION BY c.scan_id, frame_id ORDER BY ordinal) AS turn FROM c ANTI JOIN taken USING (scan_id, key)), b AS (SELECT *, row_number() OVER (PARTITION BY scan_id, key ORDER BY turn, frame_id, ordinal) AS rn FROM free)
 SELECT scan_id, ordinal FROM b WHERE rn = 1""")
def k4(spark, sf):
    p = ad.points(spark, sf)
    candidates = p.filter("not measured").withColumns({"conf": F.lit(1), "depth": F.lit(1.0)})
    return sampling.depth_seeds(candidates, p.filter("measured"), 0.1, 1_000_000).select("scan_id", "ordinal")


@query("k5_stride_sample", f"""WITH {P}, r AS (SELECT scan_id, ordinal, row_number() OVER (PARTITION BY scan_id ORDER BY ordinal) - 1 AS i, count(*) OVER (PARTITION BY scan_id) AS n FROM points), pick AS (SELECT range AS q FROM range(10))
 SELECT DISTINCT scan_id, ordinal FROM r, pick WHERE n <= 10 OR i = (q * n) // 10""")
def k5(spark, sf):
    return sampling.stride_sample(ad.points(spark, sf), 10, ["ordinal"], ["scan_id"]).select("scan_id", "ordinal")


@query("k6_proportional_thinning", f"""WITH {P}, r AS (SELECT ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS i, count(*) OVER () AS n FROM points) SELECT ordinal FROM r WHERE n <= 70 OR ((i+1)*70)//n > (i*70)//n""")
def k6(spark, sf):
    return sampling.thin_proportionally(ad.points(spark, sf), 70, ["ordinal"]).select("ordinal")


@query("k7_interval_hash_sample", f"""WITH {KEYED}, u AS (SELECT DISTINCT key, xor(xor(key, key >> 21), key >> 42) & 15 AS shard FROM keyed), {ad.split_mix_sql('u', 'key')},
 n AS (SELECT key, shard, h, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY shard) AS n, count(*) OVER () AS total FROM mixed), s AS (SELECT *, (i * greatest(1, n*100 // total)) // n AS slot FROM n),
 r AS (SELECT *, row_number() OVER (PARTITION BY shard, slot ORDER BY h, key) AS best FROM s) SELECT key FROM r WHERE best = 1 OR total <= 100""")
def k7(spark, sf):
    cells = fusion.fuse(plain(spark, sf), VOXEL).select("key").distinct()
    return sampling.interval_hash_sample(cells, 100)


@query("k8_hash_sample", None)
def k8(spark, sf):
    return sampling.hash_sample(ad.points(spark, sf), 50, "ordinal").select("ordinal")


@query("k10_gumbel_top_k", None)
def k10(spark, sf):
    return sampling.gumbel_top_k(ad.points(spark, sf), "score", 50, "ordinal", seed=3).select("ordinal", r6(F.col("gumbel")).alias("gumbel"))


@query("k13_random_order", None)
def k13(spark, sf):
    return sampling.shuffled(ad.points(spark, sf), 1, 2, "ordinal").select("ordinal", "place")


@query("k15_exclusive_scan", f"WITH {P} SELECT ordinal, CAST(sum(frame_id) OVER (PARTITION BY scan_id ORDER BY ordinal) - frame_id AS BIGINT) AS offset_ FROM points")
def k15(spark, sf):
    return sampling.exclusive_scan(ad.points(spark, sf), "frame_id", ["ordinal"], ["scan_id"]).select("ordinal", F.col("offset").cast("long").alias("offset_"))


@query("k16_morton_order", f"""WITH {P}, box AS (SELECT min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz FROM points),
 c AS (SELECT ordinal, CAST(least(floor((x-lx)/(hx-lx)*1024), 1023) AS BIGINT) a, CAST(least(floor((y-ly)/(hy-ly)*1024), 1023) AS BIGINT) b, CAST(least(floor((z-lz)/(hz-lz)*1024), 1023) AS BIGINT) d FROM points, box),
 m AS (SELECT ordinal, CAST(list_sum(list_transform(range(10), lambda i: ((a >> i) & 1) * (1 << (3*i+2)) + ((b >> i) & 1) * (1 << (3*i+1)) + ((d >> i) & 1) * (1 << (3*i)))) AS BIGINT) AS morton FROM c)
 SELECT ordinal, CAST(row_number() OVER (ORDER BY morton, ordinal) - 1 AS BIGINT) AS place FROM m""")
def k16(spark, sf):
    return sampling.numbered(sampling.morton_order(ad.points(spark, sf)).select("ordinal", "morton"), ["morton", "ordinal"]).select("ordinal", F.col("__i").alias("place"))


@query("k17_far_cap", f"""WITH {P}, room AS (SELECT greatest(0, 450 - count(*)) AS k FROM points WHERE NOT far), r AS (SELECT ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS i, count(*) OVER () AS n FROM points WHERE far)
 SELECT ordinal FROM points WHERE NOT far UNION ALL SELECT ordinal FROM r, room WHERE k > 0 AND (n <= k OR ((i+1)*k)//n > (i*k)//n)""")
def k17(spark, sf):
    return sampling.cap_far(ad.points(spark, sf), 450, ["ordinal"]).select("ordinal")


PAIRS = f"{P}, pairs AS (SELECT a.scan_id, a.ordinal AS a, b.ordinal AS b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM points a JOIN points b ON a.scan_id = b.scan_id)"


@query("j1_radius_join", f"WITH {PAIRS} SELECT scan_id, a, b, round(d, 6) AS d FROM pairs WHERE d <= 0.1::DOUBLE")
def j1(spark, sf):
    p = ad.points(spark, sf)
    return spatial.radius_join(p, p, 0.1).withColumn("d", r6(F.col("d")))


@query("j2_nearest_neighbours", f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM pairs WHERE a <> b) SELECT scan_id, a, b, round(d, 6) AS d, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2")
def j2(spark, sf):
    p = ad.points(spark, sf)
    return spatial.nearest(p, p, 2, 0.1, same_table=True).select("scan_id", "a", "b", r6(F.col("d")).alias("d"), F.col("rank").cast("int").alias("rank"))


@query("j16_supplement", f"""WITH {KEYED}, dense AS (SELECT scan_id, {UNPACK} FROM keyed WHERE measured), sparse AS (SELECT scan_id, ordinal, {UNPACK} FROM keyed WHERE NOT measured)
 SELECT scan_id, ordinal FROM points WHERE measured UNION ALL SELECT s.scan_id, s.ordinal FROM sparse s WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.scan_id = s.scan_id AND abs(d.i-s.i) <= 1 AND abs(d.j-s.j) <= 1 AND abs(d.k-s.k) <= 1)""")
def j16(spark, sf):
    p = ad.points(spark, sf)
    return spatial.supplement(p.filter("not measured"), p.filter("measured"), VOXEL).select("scan_id", "ordinal")


@query("j17_far_exclusion", f"""WITH {PAIRS}, hit AS (SELECT DISTINCT p.a FROM pairs p JOIN points f ON f.ordinal = p.a AND f.far JOIN points n ON n.ordinal = p.b AND NOT n.far AND n.measured WHERE d <= 0.1::DOUBLE)
 SELECT scan_id, ordinal FROM points WHERE ordinal NOT IN (SELECT a FROM hit)""")
def j17(spark, sf):
    return spatial.far_excluded(ad.points(spark, sf), 0.1).select("scan_id", "ordinal")


@query("cc2_cell_components", f"""WITH RECURSIVE {CELLS}, ijk AS (SELECT scan_id, key, {UNPACK} FROM cells), e AS (SELECT p.scan_id, p.key AS a, q.key AS b FROM ijk p JOIN ijk q ON p.scan_id = q.scan_id AND abs(p.i-q.i) <= 1 AND abs(p.j-q.j) <= 1 AND abs(p.k-q.k) <= 1),
 reach AS (SELECT scan_id, key, key AS root FROM ijk UNION SELECT r.scan_id, e.b, r.root FROM reach r JOIN e ON e.scan_id = r.scan_id AND e.a = r.key) SELECT scan_id, key, min(root) AS component FROM reach GROUP BY scan_id, key""")
def cc2(spark, sf):
    return graph.cell_components(fusion.fuse(plain(spark, sf), VOXEL))


def _kmeans_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds written out: centres from the first distinct points, then means of those nearest."""
    parts = [f"c0 AS (SELECT row_number() OVER (ORDER BY f) - 1 AS i, x, y, z FROM (SELECT x, y, z, min(ordinal) AS f FROM points GROUP BY x, y, z ORDER BY f LIMIT {k}))"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT p.ordinal, p.x, p.y, p.z, c.i FROM points p, c{r} c QUALIFY row_number() OVER (PARTITION BY p.ordinal ORDER BY (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)+(p.z-c.z)*(p.z-c.z), c.i) = 1)")
        if r < rounds:
            parts.append(f"c{r + 1} AS (SELECT c.i, coalesce(avg(a.x), any_value(c.x)) AS x, coalesce(avg(a.y), any_value(c.y)) AS y, coalesce(avg(a.z), any_value(c.z)) AS z FROM c{r} c LEFT JOIN a{r} a ON a.i = c.i GROUP BY c.i)")
    return f"WITH {P}, {', '.join(parts)} SELECT ordinal AS row, CAST(i AS INT) AS cluster FROM a{rounds}"


@query("g2_kmeans", _kmeans_sql(8, 3))
def g2(spark, sf):
    rows, _ = graph.kmeans(ad.points(spark, sf).withColumnRenamed("ordinal", "row"), 8, 3, ["x", "y", "z"])
    return rows.select("row", "cluster")


@query("g3_codebook", None)
def g3(spark, sf):
    book = graph.codebook(ad.points(spark, sf), "x", 16, 5)
    return splats.codebook_index(ad.points(spark, sf), "x", book).select("ordinal", "entry")


@query("a13_column_spans", f"""WITH {P}, own AS (SELECT *, floor(x/0.05::DOUBLE) AS i, floor(z/0.05::DOUBLE) AS j, floor((y + 0.3::DOUBLE) / 0.2::DOUBLE) AS band FROM points WHERE y >= -0.3::DOUBLE AND y < 0.3::DOUBLE)
 SELECT scan_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(min(y),6) AS low, round(max(y),6) AS high, count(*) AS n FROM own GROUP BY scan_id, i, j""")
def a13(spark, sf):
    return metrics.column_spans(ad.points(spark, sf), 0.05, -0.3, 0.3).select("scan_id", "i", "j", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "n")


@query("a14_wall_angle", f"""WITH {P}, s AS (SELECT scan_id, x, z, range AS angle, radians(range * (90.0::DOUBLE/36)) AS a FROM points, range(36)), b AS (SELECT scan_id, angle, 0 AS axis, floor((cos(a)*x + sin(a)*z)/0.07::DOUBLE) AS bin FROM s UNION ALL SELECT scan_id, angle, 1, floor((cos(a)*z - sin(a)*x)/0.07::DOUBLE) FROM s),
 c AS (SELECT scan_id, angle, axis, bin, count(*) AS c FROM b GROUP BY ALL), t AS (SELECT scan_id, angle, CAST(sum(c*c) AS BIGINT) AS score FROM c GROUP BY scan_id, angle), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, angle) AS rn FROM t) SELECT scan_id, CAST(angle AS INT) AS angle, score FROM r WHERE rn = 1""")
def a14(spark, sf):
    return metrics.wall_angle(ad.points(spark, sf), 0.07, 36).select("scan_id", F.col("angle").cast("int").alias("angle"), "score")


@query("a15_floor_ceiling", f"""WITH {P}, b AS (SELECT scan_id, CAST(floor(y/0.05::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM points GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, bin) AS rn FROM b), f AS (SELECT scan_id, bin AS first FROM t WHERE rn = 1),
 s AS (SELECT b.scan_id, bin, row_number() OVER (PARTITION BY b.scan_id ORDER BY n DESC, bin) AS rn FROM b JOIN f USING (scan_id) WHERE abs(bin - first) * 0.05::DOUBLE >= 0.2::DOUBLE)
 SELECT f.scan_id, round(least(first + 0.5::DOUBLE, bin + 0.5::DOUBLE) * 0.05::DOUBLE, 6) AS floor_, round(greatest(first + 0.5::DOUBLE, bin + 0.5::DOUBLE) * 0.05::DOUBLE, 6) AS ceiling_ FROM f JOIN s ON f.scan_id = s.scan_id AND s.rn = 1""")
def a15(spark, sf):
    return metrics.floor_and_ceiling(ad.points(spark, sf), 0.05, 0.2).select("scan_id", r6(F.col("floor")).alias("floor_"), r6(F.col("ceiling")).alias("ceiling_"))


@query("a16_plane_fit", None)
def a16(spark, sf):
    return metrics.plane_fit(ad.points(spark, sf), ["scan_id"]).select("scan_id", "n", *[r6(F.col(c)).alias(c) for c in ("nx", "ny", "nz", "rms")])


@query("a17_patch_thickness", None)
def a17(spark, sf):
    p = ad.points(spark, sf)
    return metrics.patch_thickness(p, sampling.hash_sample(p, 50, "ordinal"), 0.3, flat=1.0).withColumn("thickness", r6(F.col("thickness")))


@query("a19_wall_bands", f"""WITH {P}, own AS (SELECT scan_id, x, CAST(floor(x/0.05::DOUBLE) AS BIGINT) AS bin FROM points), b AS (SELECT scan_id, bin, count(*) AS c FROM own GROUP BY ALL), l AS (SELECT scan_id, greatest(2.0::DOUBLE, quantile_cont(c::DOUBLE, 0.9)) AS lim FROM b GROUP BY scan_id),
 s AS (SELECT scan_id, bin, CASE WHEN bin - lag(bin) OVER (PARTITION BY scan_id ORDER BY bin) > 3 THEN 1 ELSE 0 END AS st FROM b JOIN l USING (scan_id) WHERE c > lim), g AS (SELECT *, sum(st) OVER (PARTITION BY scan_id ORDER BY bin) AS band FROM s),
 sp AS (SELECT scan_id, band, min(bin) AS f, max(bin) AS t, count(*) AS peaks FROM g GROUP BY scan_id, band)
 SELECT sp.scan_id, CAST(band AS BIGINT) AS band, peaks, count(*) AS n, round(stddev_pop(x), 6) AS rms FROM own JOIN sp ON own.scan_id = sp.scan_id AND bin BETWEEN f AND t GROUP BY sp.scan_id, band, peaks""")
def a19(spark, sf):
    return metrics.wall_bands(ad.points(spark, sf), "x", 0.05, 2).select("scan_id", F.col("band").cast("long").alias("band"), "peaks", "n", r6(F.col("rms")).alias("rms"))


@query("a20_error_budget", f"""WITH {P}, b AS (SELECT scan_id, frame_id, stddev_pop(x) AS rms, CASE WHEN frame_id % 2 = 0 THEN 1 ELSE 2 END AS peaks FROM points GROUP BY scan_id, frame_id), m AS (SELECT scan_id, quantile_cont(rms, 0.5) FILTER (peaks > 1) AS d, quantile_cont(rms, 0.5) FILTER (peaks = 1) AS s FROM b GROUP BY scan_id)
 SELECT scan_id, round(sqrt(greatest(d*d - s*s, 0)), 6) AS ghost FROM m""")
def a20(spark, sf):
    bands = ad.points(spark, sf).groupBy("scan_id", "frame_id").agg(F.stddev_pop("x").alias("rms")).withColumn("peaks", F.when(F.col("frame_id") % 2 == 0, 1).otherwise(2))
    return metrics.error_budget(bands).select("scan_id", r6(F.col("ghost")).alias("ghost"))


@query("a24_robust_bounds", f"""WITH {P}, l AS (SELECT scan_id, list_sort(list(x)) AS xs, list_sort(list(y)) AS ys FROM points GROUP BY scan_id)
 SELECT scan_id, round(xs[CAST(floor((len(xs)-1)*0.1::DOUBLE) AS BIGINT)+1],6) AS lx, round(xs[CAST(floor((len(xs)-1)*0.9::DOUBLE) AS BIGINT)+1],6) AS hx, round(ys[CAST(floor((len(ys)-1)*0.1::DOUBLE) AS BIGINT)+1],6) AS ly FROM l""")
def a24(spark, sf):
    return metrics.robust_bounds(ad.points(spark, sf), ["scan_id"]).select("scan_id", *[r6(F.col(c)).alias(c) for c in ("lx", "hx", "ly")])


SPLATS = f"{P}, m AS (SELECT ordinal AS row, x, y, z, score AS visibility, abs(x) AS error, frame_id AS views FROM points), box AS (SELECT 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, 0.0::DOUBLE AS cz, 0.2::DOUBLE AS extent)"
REGIONS = f"""{SPLATS}, reg AS (SELECT *, CAST(least(greatest(floor((x-cx+2*extent)/(4*extent)*6),0),5) AS INT) + 6*(CAST(least(greatest(floor((y-cy+2*extent)/(4*extent)*6),0),5) AS INT) + 6*CAST(least(greatest(floor((z-cz+2*extent)/(4*extent)*6),0),5) AS INT)) AS region FROM m, box),
 regions AS (SELECT region, count(*) AS n, sum(visibility) AS support, sum(error) AS error, max(views) AS views FROM reg GROUP BY region)"""


def regions(spark, sf):
    s = ad.points(spark, sf).select(F.lit(0).alias("model"), F.col("ordinal").alias("row"), "x", "y", "z", F.col("score").alias("visibility"), F.abs("x").alias("error"), F.col("frame_id").alias("views"))
    b = spark.range(1).select(F.lit(0).alias("model"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("cz"), F.lit(0.2).alias("extent"))
    return metrics.region_statistics(s, b, ["model"], 6)


@query("a25_region_statistics", f"WITH {REGIONS} SELECT region, n, round(support,6) AS support, round(error,6) AS error, views FROM regions")
def a25(spark, sf):
    return regions(spark, sf).select("region", "n", r6(F.col("support")).alias("support"), r6(F.col("error")).alias("error"), "views")


@query("a26_region_shares", f"""WITH {REGIONS}, w AS (SELECT region, n * least(1.0::DOUBLE, support * count(*) OVER () / 3 / greatest(sum(support) OVER (), 1e-12::DOUBLE)) * (0.5::DOUBLE + 0.5::DOUBLE * least(error / greatest(avg(error) OVER (), 1e-12::DOUBLE), 4.0::DOUBLE)) AS w FROM regions)
 SELECT region, round(w / sum(w) OVER (), 6) AS share FROM w""")
def a26(spark, sf):
    return metrics.region_shares(regions(spark, sf), ["model"]).select("region", r6(F.col("share")).alias("share"))


@query("a27_largest_remainder", f"""WITH {KEYED}, s AS (SELECT scan_id, count(*) AS n FROM keyed GROUP BY scan_id), x AS (SELECT scan_id, n / CAST(sum(n) OVER () AS DOUBLE) * 97 AS x FROM s), f AS (SELECT scan_id, floor(x) AS f, x - floor(x) AS g FROM x),
 r AS (SELECT *, 97 - sum(f) OVER () AS rest, row_number() OVER (ORDER BY g DESC, scan_id) AS rn FROM f) SELECT scan_id, CAST(f + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS allotted FROM r""")
def a27(spark, sf):
    s = fusion.keyed(ad.points(spark, sf), VOXEL).groupBy("scan_id").agg(F.count("*").cast("double").alias("share"))
    return metrics.allot(s, 97, "scan_id").select("scan_id", "allotted")


@query("sp1_splat_init", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM pairs WHERE a <> b), s AS (SELECT a, sum(d) AS s, count(*) AS k FROM r WHERE rank <= 2 GROUP BY a)
 SELECT ordinal, round(CASE WHEN k = 2 THEN ln(least(greatest(s/4, 0.001::DOUBLE), 0.03::DOUBLE)) ELSE 0 END, 6) AS log_scale FROM points LEFT JOIN s ON a = ordinal""")
def sp1(spark, sf):
    p = ad.points(spark, sf).withColumns({c: F.lit(128) for c in "rgb"})
    return splats.initialise(p, 0.3, 0.1, rings=6).select("ordinal", r6(F.col("log_scale")).alias("log_scale"))


@query("sp2_seed_jitter", None)
def sp2(spark, sf):
    return splats.jittered(ad.points(spark, sf), 0.02).select("ordinal", *[r6(F.col(c)).alias(c) for c in "xyz"])


@query("sp3_prune", f"WITH {P} SELECT ordinal FROM points WHERE NOT (x * 30 < -5.541::DOUBLE) AND abs(y) >= 1e-8::DOUBLE AND NOT abs(z) > 0.2::DOUBLE")
def sp3(spark, sf):
    s = ad.points(spark, sf).select("ordinal", (F.col("x") * 30).alias("opacity"), F.abs("y").alias("quat_norm"), F.lit(0.1).alias("scale_max"), F.abs("z").alias("distance"))
    return splats.pruned(s, 0.002).select("ordinal")


@query("sp4_refine", None)
def sp4(spark, sf):
    s = ad.points(spark, sf).select(F.col("ordinal").alias("row"), "x", "y", "z", F.lit(-3.0).alias("log_scale"), F.lit(0.0).alias("opacity"), F.lit(1.0).alias("quat_norm"), F.lit(0.1).alias("scale_max"), F.lit(0.1).alias("distance"), F.col("score").alias("error"))
    return splats.refine(s, 1.0, 20).select("row", r6(F.col("x")).alias("x"), r6(F.col("log_scale")).alias("log_scale"), r6(F.col("opacity")).alias("opacity"))


@query("sp5_quantised_means", f"""WITH {P}, l AS (SELECT ordinal, sign(x)*ln(abs(x)+1) AS l FROM points), b AS (SELECT min(l) AS lo, max(l) AS hi FROM l) SELECT ordinal, CAST(floor((l-lo)/(hi-lo)*65535+0.5::DOUBLE) AS INT) // 8 AS qx FROM l, b""")
def sp5(spark, sf):
    """Compared at 13 bits, where the engines' logarithms cannot differ by a step except at an edge."""
    return splats.quantised_means(ad.points(spark, sf)).select("ordinal", F.expr("int(qx div 8)").alias("qx"))


@query("sp7_texture_size", f"WITH {KEYED}, n AS (SELECT scan_id, count(*) AS c FROM keyed GROUP BY scan_id), w AS (SELECT scan_id, c, CAST(ceil(ceil(sqrt(c::DOUBLE))/4::DOUBLE)*4 AS BIGINT) AS width FROM n) SELECT scan_id, width, CAST(ceil(ceil(c/width::DOUBLE)/4::DOUBLE)*4 AS BIGINT) AS height FROM w")
def sp7(spark, sf):
    from stereoloom.functions import capture as cp

    n = fusion.keyed(ad.points(spark, sf), VOXEL).groupBy("scan_id").agg(F.count("*").alias("c")).withColumn("t", cp.texture_size("c"))
    return n.select("scan_id", "t.width", "t.height")


@query("sp11_statistics", f"WITH {P} SELECT frame_id AS row, round(sum(score),6) AS visibility, round(max(abs(x)),6) AS errorMax, count(*) FILTER (score > 0) AS views FROM points GROUP BY frame_id")
def sp11(spark, sf):
    s = ad.points(spark, sf).select(F.col("frame_id").alias("row"), F.col("score").alias("visibility"), F.abs("x").alias("error"), F.col("y").alias("edge"), F.col("z").alias("share"))
    return metrics.splat_statistics(s).select("row", r6(F.col("visibility")).alias("visibility"), r6(F.col("errorMax")).alias("errorMax"), "views")


@query("c25_accuracy_completeness", f"""WITH {PAIRS}, a AS (SELECT p.ordinal, least(min(d), 0.1::DOUBLE) AS d FROM points p LEFT JOIN (SELECT a, d FROM pairs JOIN points q ON q.ordinal = pairs.b AND q.measured) x ON x.a = p.ordinal WHERE NOT p.measured GROUP BY p.ordinal),
 b AS (SELECT coalesce(d, 0.1::DOUBLE) AS d FROM a) SELECT count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(avg(CASE WHEN d <= 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS within5 FROM b""")
def c25(spark, sf):
    from stereoloom.plans.pipelines import surface_accuracy

    p = ad.points(spark, sf)
    return surface_accuracy(p.filter("not measured"), p.filter("measured"), 0.10).select("n", r6(F.col("median")).alias("median"), r6(F.col("p90")).alias("p90"), r6(F.col("within5")).alias("within5"))


@query("j21_tile_pairs", f"""WITH {P}, s AS (SELECT ordinal, 160 + x*300 AS u, 120 + y*300 AS v, 4 + score*20 AS r FROM points), t AS (SELECT ordinal, CAST(greatest(floor((u-r)/16),0) AS BIGINT) AS a, CAST(least(floor((u+r)/16),19) AS BIGINT) AS b, CAST(greatest(floor((v-r)/16),0) AS BIGINT) AS c, CAST(least(floor((v+r)/16),14) AS BIGINT) AS d FROM s WHERE u+r >= 0 AND u-r < 320 AND v+r >= 0 AND v-r < 240)
 SELECT ordinal, CAST(ty*20+tx AS BIGINT) AS tile FROM (SELECT ordinal, unnest(range(a, b+1)) AS tx, c, d FROM t) x, LATERAL (SELECT unnest(range(c, d+1)) AS ty) y""")
def j21(spark, sf):
    r = 4 + F.col("score") * 20
    s = ad.points(spark, sf).select("ordinal", (160 + F.col("x") * 300).alias("u"), (120 + F.col("y") * 300).alias("v"), r.alias("rx"), r.alias("ry"))
    return spatial.tile_pairs(s, 320, 240).select("ordinal", "tile")


@query("n10_tile_ranges", f"WITH {P}, c AS (SELECT frame_id AS tile, count(*) AS n FROM points GROUP BY frame_id) SELECT tile, CAST(coalesce(sum(n) OVER (ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_, CAST(sum(n) OVER (ORDER BY tile) - 1 AS BIGINT) AS last_ FROM c")
def n10(spark, sf):
    return spatial.tile_ranges(ad.points(spark, sf).select(F.col("frame_id").alias("tile"))).select("tile", F.col("first").alias("first_"), F.col("last").alias("last_"))


@query("n11_front_to_back", f"""WITH {P}, a AS (SELECT frame_id, ordinal AS row, z AS depth, least(score, 0.9::DOUBLE) AS alpha FROM points), t AS (SELECT *, coalesce(exp(sum(ln(1-alpha)) OVER (PARTITION BY frame_id ORDER BY depth, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0::DOUBLE) AS t FROM a)
 SELECT row, round(t, 6) AS transmittance FROM t""")
def n11(spark, sf):
    from stereoloom.operators.sequence import front_to_back

    a = ad.points(spark, sf).select("frame_id", F.col("ordinal").alias("row"), F.col("z").alias("depth"), F.least("score", F.lit(0.9)).alias("alpha"))
    return front_to_back(a, ["frame_id"]).select("row", r6(F.col("transmittance")).alias("transmittance"))
