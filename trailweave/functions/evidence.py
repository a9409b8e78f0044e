"""Evidence: set overlaps, scene and landmark agreement, the blend of terms, confidence levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode counts as white space.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

# The closed vocabularies of scenes, landmarks and directions.
SCENES = ("room", "corridor", "junction", "stairs", "elevator", "entrance", "lobby", "unknown")
SCENE_ALIASES = {"corridor_junction": "junction"}
LANDMARKS = ("door", "room_sign", "direction_sign", "stairs", "elevator", "entrance", "reception", "desk", "junction", "corridor_opening", "fire_equipment", "other")
DIRECTIONS = ("left", "forward", "right")
GENERIC = ("door", "direction_sign", "corridor_opening", "fire_equipment", "junction", "other")
DISCRIMINATIVE = ("room_sign", "stairs", "elevator", "entrance", "reception", "desk")
SIGN_JUNK = (*GENERIC, *DISCRIMINATIVE, "direction sign", "fire equipment", "unknown", "window", "wall", "doorway")
#: How far scene, landmarks and objects count in the similarity of two tag sets.
SHARES = (0.4, 0.4, 0.2)


def _ratio(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _none(a: Column) -> Column:
    return a.isNull() | (F.size(a) == 0)


def jaccard_open(a: Column, b: Column) -> Column:
    """Overlap for changes: an empty side is no evidence of a change, so 1."""
    return F.when(_none(a) | _none(b), 1.0).otherwise(_ratio(a, b))


def jaccard_strict(a: Column, b: Column) -> Column:
    """Overlap for merges and scores: an empty side gives 0."""
    return F.when(_none(a) | _none(b), 0.0).otherwise(_ratio(a, b))


def jaccard_floored(query: Column, place: Column, floor: float = 0.1) -> Column:
    """Overlap for ranking: no query evidence is neutral 0.5, no place evidence 0, else at least ``floor``."""
    return F.when(_none(query), 0.5).when(_none(place), 0.0).otherwise(F.greatest(_ratio(query, place), F.lit(floor)))


def normalise_scene(s: Column) -> Column:
    """Aliases become the scene they stand for; other values pass; null is unknown."""
    out = F.coalesce(s, F.lit("unknown"))
    for old, new in SCENE_ALIASES.items():
        out = F.when(out == old, new).otherwise(out)
    return out


def scene_match(a: Column, b: Column) -> Column:
    known = (a != "unknown") & (b != "unknown")
    return F.when(~known | known.isNull(), 0.5).when(a == b, 1.0).otherwise(0.0)


def tokens(a: Column) -> Column:
    """Stripped, lower-case tokens, once each."""
    return F.array_distinct(F.transform(a, lambda x: F.lower(F.btrim(x, F.lit(WHITE)))))


def semantic_similarity(q_scene: Column, q_marks: Column, q_objects: Column, p_scene: Column, p_marks: Column, p_objects: Column) -> Column:
    """Agreement of two tag sets in [0, 1]; a query without any evidence is neutral 0.5.

    If neither side has a known scene or a landmark, the objects alone decide.
    """
    tags = lambda s, m: (F.coalesce(s, F.lit("unknown")) != "unknown") | ~_none(m)
    scene, mark, thing = SHARES
    objects = jaccard_floored(tokens(q_objects), tokens(p_objects))
    whole = scene * scene_match(F.coalesce(q_scene, F.lit("unknown")), F.coalesce(p_scene, F.lit("unknown"))) + mark * jaccard_floored(tokens(q_marks), tokens(p_marks)) + thing * objects
    return F.when(~tags(q_scene, q_marks) & _none(q_objects), 0.5).when(~tags(q_scene, q_marks) & ~tags(p_scene, p_marks), objects).otherwise(whole)


def legacy_semantic(q_scene: Column, q_marks: Column, p_scene: Column, p_marks: Column) -> Column:
    """Half scene equality, half landmark overlap; without query tags 0.5."""
    return F.when(q_scene.isNull() & _none(q_marks), 0.5).otherwise(0.5 * F.coalesce((q_scene == p_scene).cast("double"), F.lit(0.0)) + 0.5 * jaccard_strict(q_marks, p_marks))


def hop_penalty(hops: Column, known: Column, same: Column, strength: float = 0.5) -> Column:
    """0 at the previous place, the full strength where no path is known, else growing with the hops."""
    return F.when(same, 0.0).when(~known | hops.isNull(), strength).otherwise(strength * (1 - F.exp(-hops / 2.0)))


def blend(terms: list[Column], weights: list[float]) -> Column:
    """Weighted mean of terms; weights that are all zero or less count equally."""
    if all(w <= 0 for w in weights):
        weights = [1 / len(weights)] * len(weights)
    total = sum(weights)
    out = F.lit(0.0)
    for t, w in zip(terms, weights):
        out = out + t * F.lit(float(w))
    return out / F.lit(float(total))


def temporal_term(place: Column, previous: Column) -> Column:
    return F.when(place == previous, 1.0).otherwise(0.5)


def confidence_level(score: Column, margin: Column, entropy: Column, unknown: Column, cfg: dict | None = None) -> Column:
    """UNKNOWN, HIGH, LOW or MEDIUM: the first that holds, all comparisons strict."""
    c = {"unknown_high_mass": 0.4, "high_score": 0.526, "high_margin": 0.15, "high_entropy": 0.4, "low_score": 0.226, "low_margin": 0.02} | (cfg or {})
    high = (score > c["high_score"]) & (margin > c["high_margin"]) & (entropy < c["high_entropy"])
    low = (score < c["low_score"]) | (margin < c["low_margin"])
    return F.when(unknown > c["unknown_high_mass"], "UNKNOWN").when(high, "HIGH").when(low, "LOW").otherwise("MEDIUM")


def accepted(label: Column, score: Column, threshold: float) -> Column:
    return F.when(score < threshold, "Unrecognized").otherwise(label)
