"""Frame quality from pixel statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of(v: Column) -> Column:
    return F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x) / F.size(v)


def variance_of(v: Column) -> Column:
    """Population variance of an array."""
    return F.transform(F.array(F.struct(v.cast("array<double>").alias("v"), mean_of(v).alias("m"))), lambda s: F.aggregate(F.transform(s["v"], lambda x: (x - s["m"]) * (x - s["m"])), F.lit(0.0), lambda a, x: a + x) / F.size(s["v"]))[0]


def quality_score(blur: Column, brightness: Column, valid: Column) -> Column:
    """Half sharpness, half closeness to middle grey; an invalid frame scores 0."""
    return F.when(~valid, 0.0).otherwise(0.5 * F.least(F.lit(1.0), blur / 500.0) + 0.5 * (1.0 - F.abs(brightness - 128.0) / 128.0))


def reject_reasons(blur: Column, brightness: Column, valid: Column, blur_at: float = 40.0, dark_at: float = 20.0) -> Column:
    return F.when(~valid, F.array(F.lit("invalid_image"))).otherwise(F.array_compact(F.array(F.when(blur < blur_at, "blurry"), F.when(brightness < dark_at, "too_dark"))))
