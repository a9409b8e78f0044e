"""The Bayes filter: one step on plain dicts (for trackers), and dense beliefs over whole replays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.streaming.fold import fold


def softmax(values: Column, temperature: float) -> Column:
    """Likelihoods of an array of evidence; a temperature of 0 or less is next to none."""
    t = temperature if temperature > 0 else 1e-6
    e = F.transform(F.array(F.struct(values.alias("v"), F.array_max(values).alias("m"))), lambda s: F.transform(s["v"], lambda x: F.exp((x - s["m"]) / t)))[0]
    return F.transform(F.array(F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("s"))), lambda s: F.transform(s["e"], lambda x: x / s["s"]))[0]


def entropy(posterior: Column, n: int) -> Column:
    """Normalised to [0, 1]; nothing known is 1, one place or fewer 0."""
    pos = F.filter(posterior, lambda x: x > 0)
    total = F.aggregate(pos, F.lit(0.0), lambda a, x: a + x)
    h = F.transform(F.array(F.struct(pos.alias("p"), total.alias("t"))), lambda s: F.aggregate(s["p"], F.lit(0.0), lambda a, x: a - (x / s["t"]) * F.log(x / s["t"] + 1e-12)))[0]
    return F.when(F.size(pos) == 0, 1.0).otherwise(0.0 if n <= 1 else h / math.log(n))


def filter_replay(frames: DataFrame, key: str, order: str, likelihood: str, matrix: list[list[float]]) -> DataFrame:
    """The belief after each frame of each session: key, order, posterior.

    ``likelihood`` is an array with a number for each place; ``matrix`` holds the prior's rows. A session
    begins with equal masses. A frame without candidates (null or empty) leaves the belief as it is and
    yields null; a belief that has come to nothing stays nothing. Sessions stream through a fold: one of
    any length takes the memory of one batch.
    """
    m = np.array(matrix, np.float64)
    kinds = {c: frames.schema[c].dataType.simpleString() for c in (key, order)}

    def one(prior: np.ndarray, row) -> tuple[np.ndarray, tuple]:
        like = row[2]
        if like is None or len(like) == 0:
            return prior, (row[1], None)
        moved = prior @ m
        total = moved.sum()
        post = like * (moved / total if total > 0 else moved)
        return post, (row[1], post.tolist())

    return fold(frames, key, order, [likelihood], lambda: np.full(len(m), 1.0 / len(m)), one, f"{key} {kinds[key]}, {order} {kinds[order]}, posterior array<double>")


def belief_step(prior: dict, likelihood: dict, matrix: dict) -> dict:
    """One step of a sparse belief, place -> mass. A place without a row stays where it is."""
    moved: dict = {}
    for src, mass in prior.items():
        for dst, p in matrix.get(src, {src: 1.0}).items():
            moved[dst] = moved.get(dst, 0.0) + mass * p
    total = sum(moved.values()) or 1.0
    return {k: m for k, v in moved.items() if (m := likelihood.get(k, 0.0) * v / total) > 0}


def likelihoods(evidence: dict, temperature: float) -> dict:
    t, top = (temperature if temperature > 0 else 1e-6), max(evidence.values())
    e = {k: math.exp((v - top) / t) for k, v in evidence.items()}
    s = sum(e.values())
    return {k: v / s for k, v in e.items()}


def belief_entropy(post: dict, n: int) -> float:
    if not post:
        return 1.0
    if n <= 1:
        return 0.0
    s = sum(post.values())
    return -sum(v / s * math.log(v / s + 1e-12) for v in post.values()) / math.log(n)
