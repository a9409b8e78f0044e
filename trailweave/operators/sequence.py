"""Ordered sequences: change scores, segments, debouncing, transitions.

All sequence operators take the columns that name a session: rows of one session are ordered by
(ts, id) and never meet those of another, so sessions are what Spark deals out to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.functions.evidence import jaccard_open
from trailweave.functions.vectors import cosine_distance


def ordered(keys: list[str], by: list[str]):
    return W.partitionBy(*keys).orderBy(*by)


def first_mode(labels: Column) -> Column:
    """The most frequent element of an array; of equals the one that comes first."""
    pairs = lambda s: F.transform(F.array_distinct(s), lambda x: F.struct(F.size(F.filter(s, lambda y: y.eqNullSafe(x))).alias("n"), (-F.array_position(s, x)).alias("p"), x.alias("x")))
    return F.array_max(pairs(labels))["x"]


def semantic_change(scene: Column, marks: Column, next_scene: Column, next_marks: Column) -> Column:
    """1 where a known scene gives way to another, or landmarks overlap by less than half."""
    known = (scene != "unknown") & (next_scene != "unknown")
    return F.when(known & (scene != next_scene), 1.0).when(jaccard_open(marks, next_marks) < 0.5, 1.0).otherwise(0.0)


def change_scores(obs: DataFrame, keys: list[str], by: list[str], vector: str = "embedding", scene: str | None = None, marks: str | None = None, persistence: int = 3) -> DataFrame:
    """For each row but the last of its session, the change to the next: ``score`` and ``pos`` (from 0).

    Visual distance plus half the semantic change, which counts only if the rows after the next, as
    many as ``persistence`` looks at, keep the next row's scene.
    """
    w = ordered(keys, by)
    df = obs.withColumn("pos", F.row_number().over(w) - 1).withColumn("__next", F.lead(F.struct(F.col(vector).alias("v"), *([F.col(scene).alias("s"), F.col(marks).alias("m")] if scene else []))).over(w))
    score = cosine_distance(F.col(vector), F.col("__next.v"))
    if scene:
        df = df.withColumn("__later", F.collect_list(scene).over(w.rowsBetween(2, persistence + 1)))
        held = F.forall("__later", lambda s: s == F.col("__next.s"))
        score = score + F.when(held, 0.5 * semantic_change(F.col(scene), F.col(marks), F.col("__next.s"), F.col("__next.m"))).otherwise(0.0)
    return df.where(F.col("__next").isNotNull()).withColumn("score", score).drop("__next", "__later")


def adaptive_threshold(scores: DataFrame, keys: list[str]) -> DataFrame:
    """mean + 2.5 deviations, held within 0.08 and 0.5; where nothing varies, 1."""
    sd = F.stddev_pop("score")
    limit = F.when(sd < 1e-9, 1.0).otherwise(F.least(F.greatest(F.avg("score") + 2.5 * sd, F.lit(0.08)), F.lit(0.5)))
    return scores.groupBy(*keys).agg(limit.alias("threshold"))


def zone_cuts(scores: DataFrame, keys: list[str], threshold: float | None = None, gap: int = 2) -> DataFrame:
    """One cut for each zone of scores strictly above the threshold: after its first highest score.

    Zones are rows above the threshold that lie at most ``gap`` positions apart.
    """
    if threshold is None:
        above = scores.join(adaptive_threshold(scores, keys), keys).where(F.col("score") > F.col("threshold"))
    else:
        above = scores.where(F.col("score") > threshold)
    w = ordered(keys, ["pos"])
    starts = F.when(F.col("pos") - F.lag("pos").over(w) <= gap, 0).otherwise(1)
    zones = above.withColumn("__s", starts).withColumn("zone", F.sum("__s").over(w))
    peak = F.max_by("pos", F.struct("score", (-F.col("pos")).alias("p")))
    return zones.groupBy(*keys, "zone").agg((peak + 1).alias("cut"), F.max("score").alias("peak"), F.count("*").alias("n_rows"))


def fold_ranges(bounds: Column, least: int) -> Column:
    """Adjacent ranges (lo, hi) of sorted bounds, with those shorter than ``least`` folded into the one
    before; a short first range takes in what follows until it is long enough."""
    n = F.size(bounds)
    ranges = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get(bounds, i - 1).alias("lo"), F.get(bounds, i).alias("hi")))
    start = F.array().cast("array<struct<lo:int,hi:int>>")

    def step(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), r["hi"].alias("hi"))))
        short = (r["hi"] - r["lo"] < least) | (last["hi"] - last["lo"] < least)
        return F.when(F.size(acc) == 0, F.array(F.struct(r["lo"].cast("int").alias("lo"), r["hi"].cast("int").alias("hi")))).when(short, joined).otherwise(F.concat(acc, F.array(F.struct(r["lo"].cast("int").alias("lo"), r["hi"].cast("int").alias("hi")))))

    return F.aggregate(ranges, start, step)


def segments(obs: DataFrame, keys: list[str], by: list[str], vector: str = "embedding", threshold: float | None = None, gap: int = 2, least: int = 3, **evidence) -> DataFrame:
    """Segments of each session: keys, seg (from 0), lo, hi (exclusive positions)."""
    scores = change_scores(obs, keys, by, vector, **evidence)
    cuts = zone_cuts(scores, keys, threshold, gap).groupBy(*keys).agg(F.collect_list("cut").alias("cuts"))
    sizes = obs.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
    bounds = F.array_sort(F.concat(F.array(F.lit(0), F.col("n")), F.coalesce(F.col("cuts").cast("array<int>"), F.array().cast("array<int>"))))
    return sizes.join(cuts, keys, "left").select(*keys, F.posexplode(fold_ranges(bounds, least)).alias("seg", "r")).select(*keys, "seg", "r.lo", "r.hi")


def debounce_labels(df: DataFrame, keys: list[str], by: list[str], label: str, reach: int = 2, unknown: str = "unknown") -> DataFrame:
    """``smooth``: the most frequent label within ``reach`` rows, the first of equals; null votes unknown and stays null."""
    w = ordered(keys, by).rowsBetween(-reach, reach)
    votes = F.collect_list(F.coalesce(F.col(label), F.lit(unknown))).over(w)
    return df.withColumn("smooth", F.when(F.col(label).isNotNull(), first_mode(votes)))


def majority_vote(df: DataFrame, keys: list[str], by: list[str], label: str, last: int = 5) -> DataFrame:
    """``vote``: the most frequent of the last ``last`` labels, the first of equals."""
    return df.withColumn("vote", first_mode(F.collect_list(label).over(ordered(keys, by).rowsBetween(-(last - 1), 0))))


def islands(df: DataFrame, keys: list[str], by: list[str], label: str, name: str = "run") -> DataFrame:
    """Numbers the runs of equal labels of each session."""
    w = ordered(keys, by)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w)).drop("__new")


def debounced(df: DataFrame, keys: list[str], by: list[str], label: str, persistence: int = 3) -> DataFrame:
    """Rows of runs that last at least ``persistence`` rows."""
    runs = islands(df, keys, by, label)
    return runs.withColumn("run_length", F.count("*").over(W.partitionBy(*keys, "run"))).where(F.col("run_length") >= persistence)


def surviving_runs(df: DataFrame, keys: list[str], by: list[str], label: str, start: str, persistence: int = 3) -> DataFrame:
    """Runs after short ones are gone and their neighbours have grown together: keys, run, label, began, n."""
    kept = debounced(df, keys, by, label, persistence).drop("run", "run_length")
    again = islands(kept, keys, by, label)
    return again.groupBy(*keys, "run", label).agg(F.min(start).alias("began"), F.count("*").alias("n"))


def transitions(df: DataFrame, keys: list[str], by: list[str], label: str, start: str, persistence: int = 3, support: int = 3, strength: Column | None = None) -> DataFrame:
    """Statistics of each ordered pair of labels that follow each other: src, dst, n, mean_duration,
    support (rows of either label before debouncing) and confidence."""
    runs = surviving_runs(df, keys, by, label, start, persistence)
    w = ordered(keys, ["run"])
    hops = runs.select(F.col(label).alias("src"), F.lead(label).over(w).alias("dst"), (F.lead("began").over(w) - F.col("began")).alias("duration")).where("dst IS NOT NULL AND src <> dst")
    stats = hops.groupBy("src", "dst").agg(F.count("*").alias("n"), F.avg("duration").alias("mean_duration"))
    rows = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))
    a, b = rows.select(F.col("label").alias("src"), F.col("rows").alias("ra")), rows.select(F.col("label").alias("dst"), F.col("rows").alias("rb"))
    confidence = F.bround(F.least(F.lit(1.0), F.col("n") / float(support)) * 0.9 + 0.1, 3)
    return stats.join(a, "src").join(b, "dst").select("src", "dst", "n", "mean_duration", (F.col("ra") + F.col("rb")).alias("support"), confidence.alias("confidence"))


def raw_transition_counts(df: DataFrame, keys: list[str], by: list[str], label: str) -> DataFrame:
    """Undirected counts of label changes between neighbours, without debouncing: lo, hi, n."""
    pairs = df.select(*keys, F.col(label).alias("a"), F.lead(label).over(ordered(keys, by)).alias("b")).where("b IS NOT NULL AND a <> b")
    return pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n"))


def sampled_every(df: DataFrame, index: str, n: int) -> DataFrame:
    """Every n-th row by its index."""
    return df.where(F.pmod(F.col(index), F.lit(n)) == 0)


def temporal_split(df: DataFrame, keys: list[str], by: list[str], fraction: float = 0.8) -> DataFrame:
    """``train``: whether a row is among the first ``floor(n * fraction)`` of its session."""
    n = F.count("*").over(W.partitionBy(*keys))
    return df.withColumn("train", F.row_number().over(ordered(keys, by)) <= F.floor(n * fraction))


def near_positions(a: DataFrame, b: DataFrame, keys: list[str], pos: str, within: int = 3) -> DataFrame:
    """Rows of ``a`` with a row of ``b`` at most ``within`` positions away: a join on cells of positions."""
    cell = lambda c: F.floor(F.col(c) / float(within))
    other = b.select(*keys, F.col(pos).alias("__p"), F.explode(F.array(*[cell(pos) + d for d in (-1, 0, 1)])).alias("__cell"))
    mine = a.withColumn("__cell", cell(pos))
    on = [*keys, "__cell"]
    cond = F.abs(F.col(pos) - F.col("__p")) <= within
    for k in on:
        cond = cond & (mine[k] == other[k])
    return mine.join(other, cond, "left_semi").drop("__cell")
