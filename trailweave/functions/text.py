"""Text of models and cameras: cleaning, parsing, decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailweave.functions.evidence import DIRECTIONS, LANDMARKS, SCENES, SIGN_JUNK, WHITE, normalise_scene

TAGS = "struct<scene_type:string,landmarks:array<string>,sign_text:array<string>,walkable:array<string>,description:string>"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def clean_list(a: Column, cap: int = 80) -> Column:
    """Stripped strings of at most ``cap`` characters, without empty ones and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(a, lambda x: F.substring(strip(x), 1, cap)), lambda x: x != ""))


def without_echo(c: Column) -> Column:
    """What follows the last "assistant", without the line breaks and blanks before it."""
    return F.regexp_replace(F.substring_index(c, "assistant", -1), r"^[\n ]+", "")


def without_junk(a: Column, junk: tuple[str, ...] = SIGN_JUNK) -> Column:
    """Sign texts, stripped and in lower case, that aren't junk."""
    return F.filter(F.transform(a, lambda x: F.lower(strip(x))), lambda x: ~x.isin(*junk) & (x != ""))


def data_url_bytes(c: Column) -> Column:
    """Bytes of a base-64 data URL; null without a comma or where they don't decode."""
    return F.when(F.contains(c, F.lit(",")), F.try_to_binary(F.regexp_replace(c, r"^[^,]*,", ""), F.lit("base64")))


def _strings(v: Column, path: str) -> Column:
    """The elements of a JSON array that are strings."""
    got = F.try_variant_get(v, path, "array<variant>")
    only = F.filter(got, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(only, lambda x: F.variant_get(x, "$", "string")), F.array().cast("array<string>"))


def parse_tags(c: Column) -> Column:
    """Scene tags from a model's answer: the widest braces are read as JSON, values are held against the
    vocabularies, case and all, and lists are cleaned and capped. Fences around the braces, or anything
    else there, don't matter; those inside a string stay. What can't be read is the unknown scene."""
    v = F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0))
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    scene = normalise_scene(text("$.scene_type"))
    known = lambda a, words: F.filter(a, lambda x: x.isin(*words))
    read = F.struct(
        F.when(scene.isin(*SCENES), scene).otherwise("unknown").alias("scene_type"),
        F.slice(known(clean_list(_strings(v, "$.landmarks")), LANDMARKS), 1, 12).alias("landmarks"),
        F.slice(clean_list(_strings(v, "$.sign_text")), 1, 8).alias("sign_text"),
        F.slice(known(clean_list(_strings(v, "$.walkable"), 16), DIRECTIONS), 1, 3).alias("walkable"),
        F.substring(F.coalesce(text("$.description"), F.lit("")), 1, 160).alias("description"),
    ).cast(TAGS)
    empty = F.array().cast("array<string>")
    unknown = F.struct(F.lit("unknown").alias("scene_type"), empty.alias("landmarks"), empty.alias("sign_text"), empty.alias("walkable"), F.lit("").alias("description")).cast(TAGS)
    return F.when(v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), unknown).otherwise(read)


# Object names by which the stub tagger tells scenes.
ROOM_OBJECTS = ("refrigerator", "tv", "couch", "chair")
CORRIDOR_OBJECTS = ("bench", "person")
FIRE_OBJECTS = ("fire hydrant",)


def _any(classes: Column, words: tuple[str, ...]) -> Column:
    return F.exists(classes, lambda c: c.rlike("|".join(words)))


def stub_scene(classes: Column) -> Column:
    """A scene by rule from object classes; a room's furniture comes before a corridor's."""
    return F.when(_any(classes, ROOM_OBJECTS), "room").when(_any(classes, CORRIDOR_OBJECTS), "corridor").otherwise("unknown")


def stub_landmarks(classes: Column) -> Column:
    return F.when(_any(classes, FIRE_OBJECTS), F.array(F.lit("fire_equipment"))).otherwise(F.array().cast("array<string>"))


def normalised_boxes(boxes: Column, width: Column, height: Column, names: Column) -> Column:
    """Boxes (cls, confidence, x1, y1, x2, y2) in pixels as shares of the image, with class names from a map."""
    return F.transform(
        boxes,
        lambda b: F.struct(
            F.coalesce(F.try_element_at(names, b["cls"]), F.concat(F.lit("cls_"), b["cls"].cast("string"))).alias("class"),
            F.round(b["confidence"], 4).alias("confidence"),
            F.array(b["x1"] / width, b["y1"] / height, b["x2"] / width, b["y2"] / height).alias("bbox"),
        ),
    )
