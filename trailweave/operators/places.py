"""Places: members, exemplars, counters, visual statistics, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.functions.vectors import best_matches, centroids, dot, doubles
from trailweave.scratch import settled

METHODS = ("kmeans", "diversity", "temporal_diversity")


def members(places: DataFrame, obs: DataFrame) -> DataFrame:
    """Observations of each place, by the ids that it lists; ids without an observation fall away."""
    listed = places.select("place_id", F.posexplode("observation_ids").alias("at", "id"))
    return listed.join(obs, "id")


def in_segments(obs: DataFrame, segs: DataFrame, keys: list[str]) -> DataFrame:
    """Observations (with ``pos``) of each segment (seg, lo, hi). Segments of a session are joined by it."""
    return obs.join(segs, keys).where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))


def first_last_middle(df: DataFrame, place: str, by: list[str], id_: str, most: int = 3) -> DataFrame:
    """Exemplars by temporal diversity, up to three: first, last and middle rows; (place, rank, id)."""
    w = W.partitionBy(place)
    n = F.count("*").over(w)
    ranked = df.select(place, F.col(id_).alias("id"), F.row_number().over(w.orderBy(*by)).alias("__r"), n.alias("__n"))
    cap = F.least(F.lit(min(most, 3)), F.col("__n"))
    picks = F.slice(F.array(F.lit(1), F.col("__n").cast("int"), F.floor(F.col("__n") / 2).cast("int") + 1), F.lit(1), cap.cast("int"))
    rank = F.array_position(picks, F.col("__r"))
    return ranked.withColumn("rank", rank).where("rank > 0").select(place, "rank", "id")


def _rows(df: DataFrame, place: str, by: list[str], id_: str, vector: str) -> DataFrame:
    """Rows with a vector, as (place, k, id, v): k orders the rows of a place."""
    return df.where(F.col(vector).isNotNull()).select(F.col(place).alias("place"), F.struct(*by, id_).alias("k"), F.col(id_).alias("id"), doubles(F.col(vector)).alias("v"))


def _farthest(rows: DataFrame, most: int) -> DataFrame:
    """Greedy max-min on cosine in each place: the first row, then again and again the row least like all chosen ones.

    Returns place, n (rows) and picks, an array of (id, v). Each round is a join of all rows with the few
    that are chosen, and one aggregate; so a place with a third of all rows is spread over tasks.
    """
    pick = F.struct("id", "v")
    chosen = settled(rows.groupBy("place").agg(F.count("*").alias("n"), F.array(F.min_by(pick, "k")).alias("picks")))
    for r in range(1, most):
        near = F.array_max(F.transform("picks", lambda p: dot(F.col("v"), p["v"])))
        more = chosen.where(F.col("n") > r).select(F.col("place").alias("p"), "picks")
        found = rows.join(more, F.col("place").eqNullSafe(F.col("p"))).groupBy("p").agg(F.min_by(pick, F.struct(near, "k")).alias("next"))
        joined = chosen.join(found, F.col("place").eqNullSafe(F.col("p")), "left")
        chosen = settled(joined.select("place", "n", F.when(F.col("next").isNull(), F.col("picks")).otherwise(F.array_append("picks", F.col("next"))).alias("picks")))
    return chosen


def _picked(chosen: DataFrame, place: str, after: int = 0) -> DataFrame:
    each = chosen.select("place", F.posexplode("picks").alias("at", "pick"))
    return each.select(F.col("place").alias(place), (F.col("at") + 1 + after).alias("rank"), F.col("pick.id").alias("id"))


def sub_clusters(rows: DataFrame, most: int, rounds: int = 10) -> DataFrame:
    """k-means in each place with k = min(most, rows): place, n, cluster, centre, k, id, v for each row.

    Centres begin at the rows that are farthest from each other; after at most ``rounds`` rounds, or when
    none moves, rows belong to their nearest centre, the first of equals. A centre without rows stays
    where it is. Rows meet centres by a join, and only sums of each cluster are shuffled.
    """
    centres = _farthest(rows, most).select("place", "n", F.transform("picks", lambda p: p["v"]).alias("centres"))

    def assigned(centres: DataFrame) -> DataFrame:
        c = centres.withColumnRenamed("place", "p")
        # The square of the distance less that of the row.
        away = F.transform("centres", lambda c, j: F.struct((dot(c, c) - 2.0 * dot(F.col("v"), c)).alias("d"), j.alias("j")))
        return rows.join(c, F.col("place").eqNullSafe(F.col("p"))).withColumn("cluster", F.array_min(away)["j"]).drop("p")

    for _ in range(rounds):
        means = centroids(assigned(centres).select("place", "cluster", "v"), ["place", "cluster"], "v", "mean", unit=False).withColumnRenamed("place", "p")
        each = centres.select("place", "n", F.posexplode("centres").alias("j", "old"))
        met = each.join(means, F.col("place").eqNullSafe(F.col("p")) & (F.col("j") == F.col("cluster")), "left").withColumn("new", F.coalesce("mean", "old"))
        moved = F.exists(F.zip_with("new", "old", lambda a, b: F.abs(a - b)), lambda x: x > 1e-9)
        both = settled(met.groupBy("place", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "new"))), lambda x: x["new"]).alias("centres"), F.max(moved).alias("moved")))
        centres = both.drop("moved")
        if both.where("moved").isEmpty():
            break
    return assigned(centres).select("place", "n", "cluster", F.get("centres", "cluster").alias("centre"), "k", "id", "v")


def cluster_means(df: DataFrame, place: str, by: list[str], id_: str, vector: str, most: int = 3) -> DataFrame:
    """Up to ``most`` unit vectors that stand for each place: the means of its sub-clusters; (place, rank, centroid)."""
    member = sub_clusters(_rows(df, place, by, id_, vector), most)
    means = centroids(member.select("place", "cluster", "v"), ["place", "cluster"], "v")
    rank = F.row_number().over(W.partitionBy("place").orderBy("cluster"))
    return means.select(F.col("place").alias(place), rank.alias("rank"), "centroid")


def exemplars(df: DataFrame, place: str, by: list[str], id_: str, vector: str, method: str = "temporal_diversity", most: int = 3) -> DataFrame:
    """Up to ``most`` representative rows of each place: (place, rank, id).

    ``diversity`` takes the first row and then those farthest from all taken; ``temporal_diversity`` the
    first, last and middle row, and beyond three the farthest of the others; ``kmeans`` the row nearest
    to the mean of each sub-cluster, or of a place with one row that. The last two read rows with a
    vector only.
    """
    if method not in METHODS:
        raise ValueError(f"unknown exemplar method: {method!r}")
    if method == "temporal_diversity":
        ends = first_last_middle(df, place, by, id_, most)
        if most <= 3:
            return ends
        taken = ends.select(F.col(place).alias("p"), F.col("id").alias("i"))
        rest = _rows(df, place, by, id_, vector)
        rest = rest.join(taken, F.col("place").eqNullSafe(F.col("p")) & (F.col("id") == F.col("i")), "left_anti")
        return ends.unionByName(_picked(_farthest(rest, most - 3), place, 3))
    rows = _rows(df, place, by, id_, vector)
    if method == "diversity":
        return _picked(_farthest(rows, most), place)
    if most == 1:
        w = W.partitionBy("place")
        middle = rows.withColumns({"r": F.row_number().over(w.orderBy("k")), "n": F.count("*").over(w)}).where("r = n DIV 2 + 1")
        return middle.select(F.col("place").alias(place), F.lit(1).alias("rank"), "id")
    member = sub_clusters(rows, most)
    means = centroids(member.select("place", "cluster", "v"), ["place", "cluster"], "v").withColumnsRenamed({"place": "p", "cluster": "c"})
    near = member.join(means, F.col("place").eqNullSafe(F.col("p")) & (F.col("cluster") == F.col("c")))
    best = near.groupBy("place", "cluster").agg(F.min_by("id", F.struct(-dot(F.col("v"), F.col("centroid")), "k")).alias("id"))
    return best.select(F.col("place").alias(place), F.row_number().over(W.partitionBy("place").orderBy("cluster")).alias("rank"), "id")


def counted(df: DataFrame, keys: list[str], items: Column, order: list[str], limit: int | None = None, name: str = "items") -> DataFrame:
    """Items of each group in falling order of count, of equals those first met: arrays of (item, n)."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, F.row_number().over(w).alias("__r"), F.posexplode(items).alias("__p", "item"))
    per = rows.groupBy(*keys, "item").agg(F.count("*").alias("n"), F.min(F.struct("__r", "__p")).alias("__first"))
    sort = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "__first", "item", "n")))
    sort = F.slice(sort, 1, limit) if limit else sort
    return per.groupBy(*keys).agg(F.transform(sort, lambda s: F.struct(s["item"].alias("item"), s["n"].alias("n"))).alias(name))


def dominant(df: DataFrame, keys: list[str], label: str, order: list[str]) -> DataFrame:
    """The most frequent label of each group, the first met of equals."""
    w = W.partitionBy(*keys).orderBy(*order)
    per = df.withColumn("__r", F.row_number().over(w)).groupBy(*keys, label).agg(F.count("*").alias("n"), F.min("__r").alias("__f"))
    return per.groupBy(*keys).agg(F.max_by(label, F.struct("n", -F.col("__f"))).alias("dominant"), F.max("n").alias("n"))


def visual_stats(df: DataFrame, place: str, vector: str) -> DataFrame:
    """Mean and deviation of members' similarity to their centroid, and their number, to 4 places."""
    c = centroids(df, [place], vector)
    sims = df.select(place, vector).join(c, place).select(place, dot(F.col(vector), F.col("centroid")).alias("s"))
    return sims.groupBy(place).agg(F.bround(F.avg("s"), 4).alias("mean_sim"), F.bround(F.stddev_pop("s"), 4).alias("std_sim"), F.count("*").alias("n"))


def representatives(df: DataFrame, place: str, by: list[str], id_: str, vector: str) -> DataFrame:
    """The member most like its group's centroid, the first of equals; the first member if any lacks a vector."""
    c = centroids(df.where(F.col(vector).isNotNull()), [place], vector)
    w = W.partitionBy(place).orderBy(*by)
    sims = df.withColumn("__r", F.row_number().over(w)).join(c, place, "left")
    best = F.max_by(id_, F.struct(dot(F.col(vector), F.col("centroid")).alias("s"), -F.col("__r")))
    return sims.groupBy(place).agg(F.when(F.count("*") > F.count(vector), F.min_by(id_, "__r")).otherwise(best).alias("representative"))


def evenly_spaced(a: Column, most: int) -> Column:
    """At most ``most`` elements at even distances, the first and last among them; halves round to even."""
    if most <= 0:
        return a
    last = F.size(a) - 1
    step = F.lit(0.0) if most == 1 else last / float(most - 1)
    return F.when(F.size(a) <= most, a).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get(a, F.bround(k * step).cast("int"))))


def nearest_members(df: DataFrame, points: DataFrame, place: str, id_: str, vector: str, l2: bool = False) -> DataFrame:
    """For each point (point_id, place, v) the most similar member of its own place; of equals the smaller id.

    ``l2``: the member at the least Euclidean distance.
    """
    joined = points.join(df.select(place, F.col(id_).alias("__id"), F.col(vector).alias("__v")), place)
    score = dot(F.col("v"), F.col("__v"))
    if l2:
        score = 2.0 * score - dot(F.col("__v"), F.col("__v"))
    return joined.withColumn("__s", score).groupBy("point_id", place).agg(F.min_by("__id", F.struct(-F.col("__s"), "__id")).alias("member"))


def nearest_centroid(df: DataFrame, means: DataFrame, id_: str, vector: str, label: str) -> DataFrame:
    """The label whose centroid is most similar to each row; of equals the smaller label.

    Blocks of rows are multiplied with blocks of centroids, as in any search for the best match.
    """
    best = best_matches(df.select(F.col(id_).alias("id"), doubles(F.col(vector)).alias("v")), means.select(F.col(label).alias("id"), F.col("centroid").alias("v")), 1)
    return best.select(F.col("query_id").alias(id_), F.col("id").alias("predicted"), "score")
