"""Retrieval of places by exemplars, and similarities of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.functions.vectors import best_matches, group_similarities


def retrieve(queries: DataFrame, exemplars: DataFrame, top_k: int = 10, factor: int = 4) -> DataFrame:
    """Candidate places of each query: query_id, rank, place, score, best_exemplar, n_support, margin.

    The best ``max(top_k * factor, 10)`` exemplars of a query vote: a place takes its best score, the
    exemplar that has it, and the number of its exemplars; ``top_k`` places stay. The margin of a
    place is its score less that of the next (the last: its own score).
    queries: (id, v); exemplars: (id, v, place).
    """
    hits = best_matches(queries, exemplars.select("id", "v"), max(top_k * factor, 10)).join(exemplars.select("id", "place"), "id")
    return places_of_hits(hits, top_k)


def places_of_hits(hits: DataFrame, top_k: int) -> DataFrame:
    per = hits.groupBy("query_id", "place").agg(F.max("score").alias("score"), F.min_by("id", "rank").alias("best_exemplar"), F.count("*").alias("n_support"), F.min("rank").alias("__first"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "__first")
    ranked = per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    margin = F.col("score") - F.coalesce(F.lead("score").over(W.partitionBy("query_id").orderBy("rank")), F.lit(0.0))
    return ranked.withColumn("margin", margin).drop("__first")


def place_similarity(exemplars: DataFrame, how: str = "max", block: int = 2048) -> DataFrame:
    """Best (or mean) cosine between exemplars of each two places a < b. exemplars: (id, v, place)."""
    cells = group_similarities(exemplars.select("id", F.col("place").alias("label"), "v"), block)
    return cells.select("a", "b", (F.col("most") if how == "max" else F.col("total") / F.col("n")).alias("similarity"))


def score_terms(candidates: DataFrame, semantic: Column, previous: Column, graph: Column, weights: tuple[float, float, float, float] = (0.5, 0.25, 0.15, 0.1)) -> DataFrame:
    """Candidates with their four terms and ``total``, ranked anew within each query."""
    from trailweave.functions.evidence import blend, temporal_term

    df = candidates.withColumns({"semantic_term": F.coalesce(semantic, F.lit(0.5)), "temporal_term": temporal_term(F.col("place"), previous), "graph_term": F.coalesce(graph, F.lit(0.5))})
    df = df.withColumn("total", blend([F.col("score"), F.col("semantic_term"), F.col("temporal_term"), F.col("graph_term")], list(weights)))
    return df.withColumn("new_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("total"), "rank")))
