"""Scores, weights and rules of capture quality as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from stereoloom.functions.numeric import clamp, col, is_finite


def point_score(radius, z, sharpness, confidence, cosine) -> Column:
    """Central, near, sharp, confident and frontal samples weigh more; confidence 2 counts 1, else 0.4."""
    central = 1 - 0.5 * F.least(F.lit(1.0), col(radius) * 1.4)
    near = 1 / (0.2 + col(z) * col(z))
    return central * near * col(sharpness) * F.when(col(confidence) >= 2, 1.0).otherwise(0.4) * col(cosine) * col(cosine)


def blur_weight(blur, half: float = 4.0, power: float = 1.0, reference: float = 10.0) -> Column:
    """P13."""
    return F.pow(1 / (1 + col(blur) / half), F.lit(power)) * F.pow(F.lit(reference), F.lit(1 - power))


def blur_risk(angular, speed, depth, focal, exposure, readout: float = 0.010, fallback: float = 0.5) -> Column:
    """Pixels of motion blur; a missing depth counts as ``fallback`` metres."""
    d = F.greatest(F.lit(0.1), F.coalesce(col(depth), F.lit(fallback)))
    return (col(angular) + col(speed) / d) * col(focal) * (col(exposure) + readout)


def exposure_blur(risk, exposure, readout: float = 0.010) -> Column:
    """The exposure's part of the risk; invalid input is infinite."""
    ok = is_finite(risk) & is_finite(exposure) & (col(exposure) > 0) & (col(risk) >= 0)
    return F.when(ok, col(risk) * col(exposure) / (col(exposure) + readout)).otherwise(F.lit(float("inf")))


def metric_scale(z) -> Column:
    """P20."""
    return F.when(is_finite(z), clamp(col(z) / 1.2, 0.125, 1.0)).otherwise(F.lit(1.0))


def scaled_pose(pose, factor) -> Column:
    """Translation times a factor."""
    return F.transform(col(pose), lambda x, i: F.when(i.isin(3, 7, 11), x * factor).otherwise(x))


def exposure_value(exposure, iso) -> Column:
    """P22."""
    return F.when((col(exposure) > 0) & (col(iso) > 0), F.log2(col(exposure) * col(iso)))


def denoise_level(iso) -> Column:
    """Null up to ISO 400."""
    return F.when(col(iso) > 400, 0.022 * F.least(F.lit(1.0), F.log2(col(iso) / 400) / 2))


def log_transform(v) -> Column:
    """P25."""
    return F.signum(col(v)) * F.log1p(F.abs(col(v)))


def inverse_log_transform(v) -> Column:
    return F.signum(col(v)) * F.expm1(F.abs(col(v)))


def sigmoid(v) -> Column:
    """P27."""
    return 1 / (1 + F.exp(-col(v)))


def logit(p) -> Column:
    return F.log(col(p) / (1 - col(p)))


@F.pandas_udf(LongType())
def hash_rank(key: pd.Series) -> pd.Series:
    """SplitMix64 of the key; wraps, so it is computed on unsigned words and returned as signed."""
    with np.errstate(over="ignore"):
        x = key.fillna(0).to_numpy(dtype=np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return pd.Series(x.view(np.int64), index=key.index)


def playback_orientation(gx, gy) -> Column:
    """Which image edge points down, by the larger gravity component; ties go to the vertical."""
    gx, gy = col(gx), col(gy)
    return F.when(F.abs(gy) >= F.abs(gx), F.when(gy <= 0, "up").otherwise("down")).otherwise(F.when(gx > 0, "right").otherwise("left"))


def playback_interval(fps) -> Column:
    """P30."""
    return 1 / clamp(fps, 0.5, 30.0)


def heat_colour(degrees) -> Column:
    """struct<r,g,b>, red over yellow to green at 30 degrees."""
    q = F.least(F.lit(1.0), col(degrees) / 30)
    return F.struct(F.when(q < 0.5, 1.0).otherwise(2 - 2 * q).alias("r"), F.when(q < 0.5, 2 * q).otherwise(1.0).alias("g"), F.lit(0.0).alias("b"))


def training_iterations(preset, photos, per_thousand) -> Column:
    """The preset, or enough full thousands for the photos."""
    return F.greatest(col(preset), F.ceil(col(photos) * col(per_thousand) / 1000) * 1000).cast("long")


def scaled_schedule(step, iterations, base: int = 30_000) -> Column:
    """A step of the base schedule at another length."""
    return F.floor(col(step) * col(iterations) / base).cast("long")


def block_reason(tracking, features, blur, angular, speed, focus_ratio, max_blur: float = 24.0, max_angular: float = 1.6, max_speed: float = 1.6, min_focus: float = 0.4, min_features: int = 1) -> Column:
    """the first rule that blocks a capture, else null."""
    return (
        F.when(~F.coalesce(col(tracking), F.lit(False)), "tracking")
        .when(col(features) < min_features, "features")
        .when((col(blur) > max_blur) | (col(angular) > max_angular) | (col(speed) > max_speed), "motion")
        .when(col(focus_ratio) < min_focus, "focus")
    )


def quality_issues(lux, metres, heat, dark: float = 150, bright: float = 20_000, near: float = 0.25, far: float = 4.0) -> Column:
    """all issues of a frame, in a fixed order."""
    return F.array_compact(F.array(
        F.when(col(lux) < dark, "dark"), F.when(col(lux) > bright, "bright"), F.when(col(metres) < near, "near"),
        F.when(col(metres) > far, "far"), F.when(col(heat) >= 2, "heat")))


def reference_valid(known) -> Column:
    """a scale reference between 10 cm and 1000 m."""
    return is_finite(known) & (col(known) >= 0.1) & (col(known) <= 1000.0)


def texture_size(count) -> Column:
    """SP7: side of the square-ish texture: width is the ceiling of the root, rounded up to 4."""
    width = F.ceil(F.ceil(F.sqrt(col(count).cast("double"))) / 4) * 4
    return F.struct(width.cast("long").alias("width"), (F.ceil(F.ceil(col(count) / width) / 4) * 4).cast("long").alias("height"))


def splat_prunable(opacity, quat_norm, scale_max, distance, extent, min_opacity: float = -5.541) -> Column:
    """SP3: nearly transparent, degenerate or far beyond the scene."""
    return (col(opacity) < min_opacity) | ~is_finite(quat_norm) | (col(quat_norm) < 1e-8) | ~is_finite(scale_max) | (col(distance) > 100 * col(extent))
