"""The place graph: gates, node types, components, hops, routes, transition priors, validation."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.functions.evidence import normalise_scene
from trailweave.scratch import settled


def gated_edges(transitions: DataFrame, nodes: DataFrame, confidence: float = 0.6, support: int = 3) -> DataFrame:
    """Undirected edges of a place graph.

    Each direction passes the gates by itself, and both ends must be nodes; then directions are
    folded: counts and support add up, confidence and strength are the greater.
    transitions: src, dst, forward, reverse, support, strength, confidence; nodes: id.
    """
    ok = transitions.where((F.col("forward") + F.col("reverse") >= support) & (F.col("confidence") >= confidence))
    for end in ("src", "dst"):
        ok = ok.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    return ok.groupBy(*ends).agg(F.max("confidence").alias("confidence"), F.sum("forward").alias("forward"), F.sum("reverse").alias("reverse"), F.sum("support").alias("support"), F.max("strength").alias("strength"))


def symmetric(edges: DataFrame, *more: str) -> DataFrame:
    """Every edge in both directions."""
    return edges.select("src", "dst", *more).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more)).where("src <> dst")


def walkable_evidence(votes: Column, n: Column) -> Column:
    """Whether two or more directions have the votes of half the observations (rounded up) each."""
    return F.size(F.filter(F.map_values(votes), lambda c: c >= F.greatest(F.lit(1), F.floor((n + 1) / 2)))) >= 2


def node_types(nodes: DataFrame, edges: DataFrame, min_degree: int = 3) -> DataFrame:
    """``node_type`` by degree, then by dominant scene. nodes: id, scene, walkable (map), n."""
    degree = symmetric(edges).groupBy("src").agg(F.countDistinct("dst").alias("degree"))
    df = nodes.join(degree, nodes["id"] == degree["src"], "left").drop("src").fillna({"degree": 0})
    scene = normalise_scene(F.col("scene"))
    kind = (
        F.when(F.col("degree") >= min_degree, "junction")
        .when(scene.isin("stairs", "elevator", "entrance"), scene)
        .when((scene == "junction") & walkable_evidence(F.col("walkable"), F.col("n")), "junction")
        .when(scene.isin("corridor", "junction"), "corridor")
        .when(scene.isin("room", "lobby"), "room")
        .otherwise("unknown")
    )
    return df.withColumn("node_type", kind)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component): the smallest node id that each node reaches.

    Labels spread along edges and jump through the labels of labels, so the number of rounds grows
    with the logarithm of the longest path. Every round is checkpointed.
    """
    both = settled(symmetric(edges).distinct())
    cur = nodes.select("id", F.col("id").alias("component")).transform(settled)
    for _ in range(rounds):
        near = both.join(cur, both["dst"] == cur["id"]).groupBy("src").agg(F.min("component").alias("m"))
        nxt = cur.join(near, cur["id"] == near["src"], "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("m"))
        roots = nxt.select(F.col("id").alias("r"), F.col("m").alias("rm"))
        new = nxt.join(roots, nxt["m"] == roots["r"]).select("id", "component", F.least("m", "rm").alias("new")).transform(settled)
        cur = new.select("id", F.col("new").alias("component"))
        if new.where("new <> component").isEmpty():
            return cur
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def hops(edges: DataFrame, limit: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, hops) of all pairs that are connected, or up to ``limit`` hops apart; each node itself at 0.

    Breadth first: a round joins the last frontier with the edges and drops what is known. Rounds end
    when one adds nothing.
    """
    both = settled(symmetric(edges).distinct())
    nodes = sources.select(F.col("id").alias("src")) if sources is not None else both.select("src").distinct()
    known = nodes.select("src", F.col("src").alias("dst"), F.lit(0).alias("hops"))
    front = known
    step = both.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    for d in count(1) if limit is None else range(1, limit + 1):
        reached = front.join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        front = settled(reached.join(known, ["src", "dst"], "left_anti").withColumn("hops", F.lit(d)))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def shortest_paths(edges: DataFrame, source: Column, limit: int | None = None, weight: Column | None = None) -> DataFrame:
    """Cheapest path from one node to each node that it reaches: dst, cost, path; of at most ``limit`` edges if that is given.

    Of equally cheap paths that with fewer edges, then that of smaller ids. Rounds relax edges as
    Bellman and Ford do, and keep one path for each node; they end when one improves nothing.
    """
    w = weight if weight is not None else F.lit(1.0)
    both = settled(symmetric(edges.withColumn("w", w), "w").groupBy("src", "dst").agg(F.min("w").alias("w")))
    best = edges.sparkSession.range(1).select(source.alias("dst")).select("dst", F.lit(0.0).alias("cost"), F.array("dst").alias("path"))
    step = both.select(F.col("src").alias("dst"), F.col("dst").alias("next"), "w")
    rank = F.struct(F.round("cost", 9).alias("c"), F.size("path").alias("n"), F.col("path").alias("p"))
    for _ in count() if limit is None else range(limit):
        more = best.join(step, "dst").where(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("dst"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("next")).alias("path"))
        new = settled(best.unionByName(more).groupBy("dst").agg(F.min_by(F.struct("cost", "path"), rank).alias("b")).select("dst", "b.cost", "b.path"))
        done = new.join(best, ["dst", "path"], "left_anti").isEmpty()
        best = new
        if done:
            break
    return best


def inverse_count(count: str) -> Column:
    """The weight of an edge that was seen so often: rarely used edges are long."""
    return 1.0 / F.greatest(F.col(count).cast("double"), F.lit(1.0))


def directions(path: Column, names: Column) -> Column:
    """Names of a route joined by arrows; ids without a name are Place_<id>."""
    return F.array_join(F.transform(path, lambda i: F.coalesce(F.try_element_at(names, i.cast("string")), F.concat(F.lit("Place_"), i.cast("string")))), " -> ")


def transition_prior(nodes: DataFrame, edges: DataFrame, stay: float = 0.7, far: float = 0.05) -> DataFrame:
    """Rows of a stochastic matrix: src, dst, p.

    A node keeps ``stay``; each other node that isn't a neighbour gets ``far``; neighbours share what
    is left (0 at least) by confidence, and where there are none it stays.
    The matrix is nodes x nodes by definition; the graph of one map is small.
    """
    conf = symmetric(edges, "confidence").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    pairs = nodes.select(F.col("id").alias("src")).crossJoin(nodes.select(F.col("id").alias("dst"))).join(conf, ["src", "dst"], "left")
    w = W.partitionBy("src")
    near, total = F.count("confidence").over(w), F.sum("confidence").over(w)
    left = F.greatest(F.lit(0.0), 1.0 - stay - far * (F.count("*").over(w) - 1 - near))
    p = F.when(F.col("src") == F.col("dst"), stay + F.when(near == 0, left).otherwise(0.0)).when(F.col("confidence").isNull(), F.lit(far)).otherwise(left * F.col("confidence") / F.when(total == 0, 1.0).otherwise(total))
    return pairs.select("src", "dst", p.alias("p"))


def complete(nodes: DataFrame) -> DataFrame:
    """An edge between every two nodes: what an ablation without a graph uses."""
    a, b = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
    return a.join(b, F.col("src") < F.col("dst"))


def warnings(nodes: DataFrame, edges: DataFrame, min_obs: int = 3, std_at: float = 0.35, weak_at: float = 0.4, mixed_at: float = 0.2) -> DataFrame:
    """Problems of a graph: check, subject. nodes: id, n, std_sim, scenes (map of counts)."""
    linked = symmetric(edges).select(F.col("src").alias("id")).distinct()
    known = F.map_values(F.map_filter("scenes", lambda k, v: k != "unknown"))
    total = F.aggregate(known, F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))
    minority = (total - F.array_max(known)) / F.when(total > 0, total)
    alone = nodes.join(linked, "id", "left_anti").select(F.lit("isolated_node").alias("check"), F.col("id").cast("string").alias("subject"))
    few = nodes.where(F.col("n") < min_obs).select(F.lit("low_observations"), F.col("id").cast("string"))
    vary = nodes.where(F.col("std_sim") > std_at).select(F.lit("high_variance"), F.col("id").cast("string"))
    mixed = nodes.where((F.size(known) > 1) & (minority >= mixed_at)).select(F.lit("mixed_scene"), F.col("id").cast("string"))
    weak = edges.where((F.col("confidence") < weak_at) | (F.col("support") < min_obs)).select(F.lit("weak_edge"), F.concat_ws("-", "src", "dst"))
    return alone.union(few).union(vary).union(mixed).union(weak)
