"""Queries over rendered scenes: tracks with and without depth, stereo, solvers; tests hold them against plain folds and the scenes' known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stereoloom.operators import camera_tracks, graph, kernels, refinement, stereo, surfaces, tracking
from stereoloom.plans import scenes
from stereoloom.plans.durable import durable
from stereoloom.plans.registry import query, r6

FRAMES = 12


def frames_with_features(spark, sf):
    return scenes.featured(scenes.views(spark, sf, FRAMES, 160, 120, step=0.06, fine=4.0), FRAMES)


def camera_views(spark, sf):
    return scenes.views(spark, sf, FRAMES, 160, 120, step=0.06, fine=4.0, visitor=True)


def stereo_views(spark, sf):
    """Views of four cameras and, for each, its other three as sources. They are drawn once: pairs, sources and views read them."""
    views = durable(scenes.views(spark, sf, 4, 48, 36), "views")
    own = views.select("scan_id", "frame_id")
    pairs = own.join(own.select("scan_id", F.col("frame_id").alias("source_id")), "scan_id").filter("frame_id <> source_id")
    return views, pairs.withColumn("score", -F.abs(F.col("frame_id") - F.col("source_id")))


@query("c9_feature_tracker", None)
def c9_tracker(spark, sf):
    return tracking.feature_tracker(frames_with_features(spark, sf), reciprocal=True).select("scan_id", "frame_id", "track_id", "feature_id")


@query("c9_tracker_report", None)
def c9_report(spark, sf):
    return tracking.tracker_report(frames_with_features(spark, sf))


@query("c16_camera_tracks", None)
def c16_tracks(spark, sf):
    return camera_tracks.camera_tracks(camera_views(spark, sf)).select("scan_id", "frame_id", "track_id", F.round("u", 3).alias("u"), F.round("v", 3).alias("v"))


@query("c16_track_report", None)
def c16_report(spark, sf):
    return camera_tracks.camera_track_report(camera_views(spark, sf))


@query("c17_depth_maps", None)
def c17_maps(spark, sf):
    return stereo.depth_maps(*stereo_views(spark, sf)).select("frame_id", "u", "v", r6(F.col("depth")).alias("depth"))


@query("c17_confirmed_depths", None)
def c17_confirmed(spark, sf):
    views, pairs = stereo_views(spark, sf)
    maps = durable(stereo.depth_maps(views, pairs), "maps")
    return stereo.confirmed(maps, views, pairs).select("frame_id", "u", "v", "n", r6(F.col("depth")).alias("depth"))


ROOM_FRAMES = 9


def room_frames(spark, sf, walls=3):
    return scenes.rooms(spark, sf, ROOM_FRAMES, 80, 60, walls)


@query("c11_surface_refinement", None)
def c11_surfaces(spark, sf):
    frames = durable(room_frames(spark, sf), "rooms")  # drawn once, read for the order and for the fit
    return surfaces.surface_refinement(frames).select("scan_id", "frame_id", "status", r6(F.col("before")).alias("before"), r6(F.col("after")).alias("after"))


#: Scenes of 72 points; those whose points are complete must be accepted and bring the held-out error near the noise.
C10 = "SELECT s AS scan_id, true AS accepted, true AS better, true AS near_noise FROM (SELECT DISTINCT vec_id // 72 AS s FROM embeddings)"


@query("c10_noisy_adjustment", C10)
def c10_noisy(spark, sf):
    """Noise, outliers and disturbed starts in every scene; the oracle holds the outcome by tolerance."""
    found = kernels.bundle_adjustment(scenes.disturbed_tracks(spark, sf), motion=kernels.MotionPrior(0.02, 0.4)).groupBy("scan_id").agg(F.min("accepted").alias("accepted"), F.first("before").alias("b"), F.first("after").alias("a"))
    return found.select("scan_id", "accepted", (F.col("a") < 0.5 * F.col("b")).alias("better"), (F.col("a") < 1.0).alias("near_noise"))


def harmonics(spark, sf):
    """45 numbers a splat, from its vector."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform(F.slice("embedding", 1, 45), lambda x: x.cast("double")).alias("sh"))


@query("sp6_palette", None)
def sp6_palette(spark, sf):
    return graph.palette(harmonics(spark, sf), "sh", entries=64)[0].select("vec_id", "entry")


def splat_windows(spark, sf):
    """A splat for each vector, with a window's statistics from its components."""
    e = lambda i: F.col("embedding")[i].cast("double")
    own = spark.read.parquet(f"{sf}/embeddings.parquet")
    return own.select(F.col("vec_id").alias("row"), *[e(i).alias(c) for i, c in enumerate("xyz")], *[(e(3 + i) - 3).alias(f"s{i}") for i in range(3)], *[(e(6 + i) + (1.0 if i == 0 else 0.0)).alias(c) for i, c in enumerate(("qw", "qx", "qy", "qz"))],
                      (e(10) * 30).alias("opacity"), F.greatest(e(11) * 100, F.lit(0.05)).alias("visibility"), F.abs(e(12)).alias("error_max"), F.abs(e(13) * 100).alias("error_sum"), F.abs(e(14) * 2).alias("share_max"), F.abs(e(15)).alias("edge_sum"), F.lit(10.0).alias("views"), F.pmod("vec_id", F.lit(3)).cast("int").alias("low_windows"))


@query("sp4_refine_window", None)
def sp4_window(spark, sf):
    """One refinement of a model at its ceiling."""
    own = splat_windows(spark, sf)
    n = own.count()
    out, _ = refinement.refine_window(own, 5.0, refinement.RefineRules(capacity=n, ceiling=n, most_moved=0.05))
    return out.select("row", *[r6(F.col(c)).alias(c) for c in ("x", "y", "z", "opacity", "s0")], "low_windows")
