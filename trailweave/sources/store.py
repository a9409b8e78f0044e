"""Observations, maps and reports as folders of tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One observation: what every sequence, place and retrieval operator reads.
OBSERVATION = (
    "id string, ts double, frame_path string, embedding array<float>, quality_score double, "
    "objects array<struct<class:string,confidence:double,bbox:array<double>>>, "
    "scene_tags struct<scene_type:string,landmarks:array<string>,sign_text:array<string>,walkable:array<string>,description:string>, "
    "landmarks array<string>, segment_id string, place_id string"
)
MAP_TABLES = ("places", "nodes", "edges", "exemplars", "names", "manifest")
STORE_TABLES = ("observations", "encoder")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def without_vector(obs: DataFrame) -> DataFrame:
    """Rows as they are written for people to read: all but the vector."""
    return obs.drop("embedding")


def with_defaults(obs: DataFrame) -> DataFrame:
    """Missing lists become empty ones."""
    return obs.withColumns({c: F.coalesce(F.col(c), F.array().cast(obs.schema[c].dataType)) for c in ("objects", "landmarks") if c in obs.columns})


def write_jsonl(obs: DataFrame, path: str) -> None:
    obs.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = OBSERVATION) -> DataFrame:
    """Observations from JSON lines; blank lines are skipped and unknown keys dropped."""
    return with_defaults(spark.read.schema(schema).json(path))


def observations(frames: DataFrame, name: str, vector: str) -> DataFrame:
    """Observations of named frames, in order of name, nameless ones last: id obs_000000 and so on, ts the index.

    Every row has a number of its own; of rows with equal names the smaller vector comes first.
    """
    rows = frames.select(F.col(name).alias("frame_path"), F.col(vector).alias("embedding"))
    numbered = with_index(rows, [F.asc_nulls_last("frame_path"), "embedding"])
    return numbered.select(F.format_string("obs_%06d", "index").alias("id"), F.col("index").cast("double").alias("ts"), "frame_path", "embedding")


def with_index(df: DataFrame, by: list[str | Column]) -> DataFrame:
    """``index``: the position (from 0) of each row in the order of ``by``; equal rows are numbered in any order.

    Rows are dealt out by range and sorted there, and each takes the number of its range and its place
    in it. That is settled before anything else reads it: were the ranges formed anew for each use, their
    bounds would differ, and rows would be lost. The ranges' counts are all that meets in one task.
    """
    from pyspark.sql import Window as W

    from trailweave.scratch import settled

    rows = settled(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part, rank = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    # One row for each range.
    return rows.join(F.broadcast(before), part == F.col("__part")).withColumn("index", rank + F.col("__before")).drop("__at", "__part", "__before")


def append(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Adds observations: all of them, or none if an id is there twice or a vector is missing."""
    bad = new.where(F.col("embedding").isNull()).limit(1).count()
    twice = new.groupBy("id").count().where("count > 1").limit(1).count()
    known = new.join(spark.read.parquet(path).select("id"), "id", "left_semi").limit(1).count() if exists(spark, path) else 0
    if bad or twice or known:
        raise ValueError("observations need a vector and an id of their own")
    new.write.mode("append").parquet(path)


def lookup(obs: DataFrame, id_: str) -> DataFrame:
    """The observation of that id; the filter reaches the scan."""
    return obs.where(F.col("id") == id_)


def in_order(obs: DataFrame) -> DataFrame:
    return obs.orderBy("ts", "id")


def save_store(obs: DataFrame, path: str, encoder: str) -> None:
    """A store of observations with the name and width of their encoder."""
    obs.write.mode("overwrite").parquet(f"{path}/observations")
    obs.where(F.col("embedding").isNotNull()).agg(F.lit(encoder).alias("encoder"), F.max(F.size("embedding")).alias("dimension"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/encoder")


def load_store(spark: SparkSession, path: str) -> DataFrame:
    missing = [t for t in STORE_TABLES if not exists(spark, f"{path}/{t}")]
    if missing:
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
    return spark.read.parquet(f"{path}/observations")


def content_hash(places: DataFrame, edges: DataFrame) -> DataFrame:
    """16 hexadecimal digits that depend on the places and edges and not on their order.

    Each row's JSON is hashed, and the hashes are added up in four parts of 60 bits: sums of partial sums,
    so that no task sees more than its own rows. The digest is that of the count and the sums.
    """
    side = lambda df, name: df.select(F.sha2(F.concat(F.lit(name), F.to_json(F.struct("*"))), 256).alias("h"))
    rows = side(places, "place ").unionByName(side(edges, "edge "))
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)]
    sums = rows.agg(F.count("*").cast("string").alias("n"), *parts)
    return sums.select(F.substring(F.sha2(F.concat_ws(",", "n", "s0", "s1", "s2", "s3"), 256), 1, 16).alias("content_hash"))


def write_map(path: str, places: DataFrame, nodes: DataFrame, edges: DataFrame, exemplars: DataFrame, names: DataFrame, obs: DataFrame, facts: dict[str, str]) -> None:
    """Replaces the map at ``path``: a table each, and a manifest of counts over what places refer to."""
    used = obs.join(places.select(F.explode("observation_ids").alias("id")).distinct(), "id", "left_semi")
    counts = places.agg(F.count("*").alias("n_places")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(used.agg(F.count("*").alias("n_observations")))
    manifest = counts.crossJoin(content_hash(places, edges)).withColumns({k: F.lit(v) for k, v in facts.items()} | {"created_at": F.current_timestamp()})
    for name, df in zip(MAP_TABLES, (places, nodes, edges, exemplars, names, manifest)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_map(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    missing = [t for t in MAP_TABLES if not exists(spark, f"{path}/{t}")]
    if missing:
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
    out = {t: spark.read.parquet(f"{path}/{t}") for t in MAP_TABLES}
    out["names"] = place_names(out["places"], out["names"])
    return out


def place_names(places: DataFrame, names: DataFrame) -> DataFrame:
    """A name for each place: its own or Place_<id>. names: place_id, name."""
    return places.select("place_id").join(names, "place_id", "left").select("place_id", F.coalesce("name", F.concat(F.lit("Place_"), F.col("place_id").cast("string"))).alias("name"))


def latest(manifests: DataFrame, path: Column, created: Column) -> DataFrame:
    """The path of the map that was made last."""
    return manifests.agg(F.max_by(path, created).alias("path"))


def graph_json(nodes: DataFrame, edges: DataFrame, decimals: int = 4) -> DataFrame:
    """A graph as one JSON text, numbers rounded: the graph of one map."""
    e = edges.select(*[F.round(c, decimals).alias(c) if t == "double" else F.col(c) for c, t in edges.dtypes])
    n = nodes.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("nodes"))
    return n.crossJoin(e.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("edges"))).select(F.to_json(F.struct("nodes", "edges")).alias("json"))


def write_report(warnings: DataFrame, path: str) -> None:
    """Warnings as JSON lines and as Markdown text."""
    warnings.write.mode("overwrite").json(f"{path}/json")
    line = F.concat(F.lit("- **"), F.col("check"), F.lit("** "), F.col("subject"))
    warnings.orderBy("check", "subject").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


WEIGHTS = ("w_visual", "w_semantic", "w_temporal", "w_graph")


def load_config(path: str) -> dict:
    """Settings from a .json file, or from YAML where a reader of that is installed."""
    with open(path, encoding="utf-8") as f:  # FileNotFoundError names the path
        if path.endswith(".json"):
            return json.load(f) or {}
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path}: no YAML reader is installed; give the settings as .json") from e
        return yaml.safe_load(f) or {}


def validate_config(cfg: dict, encoders: tuple[str, ...] = (), detectors: tuple[str, ...] = (), taggers: tuple[str, ...] = (), never_4bit: tuple[str, ...] = (), root: str | None = None) -> list[tuple[str, str]]:
    """Problems of the settings: (error or warning, what); none if they are sound.

    ``encoders``, ``detectors``, ``taggers``: the names that may be asked for; empty: any. Taggers whose
    name holds one of ``never_4bit`` mustn't be quantised to 4 bits. With a ``root``, the folders of
    ``paths`` must exist below it; a missing video alone is a warning.
    """
    out = []
    for key, rel in (cfg.get("paths") or {}).items() if root is not None else ():
        if isinstance(rel, str):
            at = Path(root) / rel
            if not at.parent.exists():
                out.append(("error", f"paths.{key}: {at.parent} doesn't exist"))
            elif key == "video" and not at.exists():
                out.append(("warning", f"paths.{key}: {at} doesn't exist yet"))
    sight = cfg.get("perception") or {}
    for key, names in (("detector_model", detectors), ("vlm_model", taggers)):
        if names and sight.get(key) not in names:
            out.append(("error", f"perception.{key} {sight.get(key)!r} isn't registered"))
    if sight.get("vlm_quantization") == "4bit" and any(n in (sight.get("vlm_model") or "") for n in never_4bit):
        out.append(("error", f"perception.vlm_quantization: {sight['vlm_model']} can't run at 4 bits"))
    loc = cfg.get("localization") or {}
    weights = {k: float(loc.get(k, 0.0)) for k in WEIGHTS}
    out += [("error", f"localization.{k} must lie within 0 and 1, not {v}") for k, v in weights.items() if not 0 <= v <= 1]
    if not 0 < sum(weights.values()) <= 2:
        out.append(("error", "localization weights must add up to more than 0 and at most 2"))
    name = (cfg.get("embedding") or {}).get("model")
    if encoders and name not in encoders:
        out.append(("error", f"embedding.model {name!r} isn't registered"))
    method = (cfg.get("mapping") or {}).get("exemplar_method", "temporal_diversity")
    if method not in ("kmeans", "diversity", "temporal_diversity"):
        out.append(("error", f"mapping.exemplar_method {method!r} is unknown"))
    return out
