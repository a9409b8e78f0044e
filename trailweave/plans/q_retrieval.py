"""Queries of retrieval, similarities and evaluation of encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.functions import evidence as ev
from trailweave.functions.vectors import best_matches, dot, pair_statistics
from trailweave.operators import places, retrieval
from trailweave.plans.catalog import query, table
from trailweave.sources.store import with_index

_E = "e AS (SELECT vec_id, embedding::DOUBLE[] v, label FROM embeddings)"
_X = "x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) r, count(*) OVER (PARTITION BY label) n FROM e) WHERE r IN (1, n, n // 2 + 1))"


def _exemplars(s, d):
    e = table(s, d, "embeddings")
    return places.exemplars(e, "label", ["vec_id"], "vec_id", "embedding").join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id").select("id", "v", F.col("label").alias("place"))


def _queries(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _labelled(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


def _hits(k: int) -> str:
    return f"h AS (SELECT * FROM (SELECT e.vec_id query_id, x.vec_id id, x.label place, list_dot_product(e.v, x.v) score, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_dot_product(e.v, x.v) DESC, x.vec_id) rank FROM e CROSS JOIN x) WHERE rank <= {k})"


_CAND = f"{_E}, {_X}, {_hits(12)}, p AS (SELECT query_id, place, max(score) score, arg_min(id, rank) best_exemplar, count(*) n_support, min(rank) f FROM h GROUP BY ALL), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) rank FROM p) WHERE rank <= 3), k AS (SELECT *, score - coalesce(lead(score) OVER (PARTITION BY query_id ORDER BY rank), 0) margin FROM c)"


def _candidates(s, d):
    return retrieval.retrieve(_queries(s, d), _exemplars(s, d), 3, 4)


@query("exemplar_retrieval", f"WITH {_CAND} SELECT query_id, rank, place, round(score, 6) AS score, best_exemplar, n_support, round(margin, 6) AS margin FROM k")
def exemplar_retrieval(s, d):
    """J5, K1, A1, W12: exact top exemplars, places by their best, margins."""
    return _candidates(s, d).select("query_id", "rank", "place", F.round("score", 6).alias("score"), "best_exemplar", "n_support", F.round("margin", 6).alias("margin"))


@query("k2_a2_legacy_topk", f"WITH {_E}, {_X}, {_hits(12)}, p AS (SELECT query_id, place, max(score) score, min(rank) f FROM h GROUP BY ALL) SELECT query_id, place, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) rank FROM p) WHERE rank <= 3")
def legacy_topk(s, d):
    hits = best_matches(_queries(s, d), _exemplars(s, d).select("id", "v"), 12).join(_exemplars(s, d).select("id", "place"), "id")
    return retrieval.places_of_hits(hits, 3).select("query_id", "place", "rank", F.round("score", 6).alias("score"))


@query("k3_knn_observations", f"WITH {_E} SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT a.vec_id query_id, b.vec_id id, list_dot_product(a.v, b.v) score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) rank FROM e a CROSS JOIN e b) WHERE rank <= 5")
def knn(s, d):
    q = _queries(s, d)
    return best_matches(q, q, 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("a8_place_pair_max", f"WITH {_E}, {_X} SELECT a.label AS a, b.label AS b, round(max(list_dot_product(a.v, b.v)), 6) AS similarity FROM x a JOIN x b ON a.label < b.label GROUP BY ALL")
def place_pair_max(s, d):
    return retrieval.place_similarity(_exemplars(s, d)).withColumn("similarity", F.round("similarity", 6))


@query("a8_g7_j6_duplicate_candidates", f"WITH {_E}, {_X}, m AS (SELECT a.label AS a, b.label AS b, avg(list_dot_product(a.v, b.v)) s FROM x a JOIN x b ON a.label < b.label GROUP BY ALL) SELECT a, b, round(s, 6) AS similarity FROM m WHERE s >= 0.02")
def duplicate_candidates(s, d):
    return retrieval.place_similarity(_exemplars(s, d), "mean").where("similarity >= 0.02").withColumn("similarity", F.round("similarity", 6))


@query(
    "j7_a15_e6_pair_similarity",
    f"WITH {_E}, p AS (SELECT a.label = b.label same, list_dot_product(a.v, b.v) s FROM e a JOIN e b ON a.vec_id <> b.vec_id) SELECT count(*) FILTER (WHERE same) AS n_same, count(*) FILTER (WHERE NOT same) AS n_diff, round(avg(s) FILTER (WHERE same), 6) AS mean_same, round(avg(s) FILTER (WHERE NOT same), 6) AS mean_diff, round(stddev_pop(s) FILTER (WHERE same), 6) AS std_same, round(stddev_pop(s) FILTER (WHERE NOT same), 6) AS std_diff, round(avg(s) FILTER (WHERE same) - avg(s) FILTER (WHERE NOT same), 6) AS margin, round(min(s) FILTER (WHERE same), 6) AS least_same, round(max(s) FILTER (WHERE NOT same), 6) AS most_diff FROM p",
)
def pair_similarity(s, d):
    p = pair_statistics(_labelled(s, d), 0.2)
    of = lambda c, same: F.max(F.when(F.col("same") == F.lit(same), F.col(c)))  # noqa: E731 - one row of each kind
    mean = {same: of("total", same) / of("n", same) for same in (True, False)}
    std = {same: F.sqrt(of("squares", same) / of("n", same) - mean[same] * mean[same]) for same in mean}
    return p.agg(
        (2 * of("n", True)).alias("n_same"), (2 * of("n", False)).alias("n_diff"), F.round(mean[True], 6).alias("mean_same"), F.round(mean[False], 6).alias("mean_diff"),
        F.round(std[True], 6).alias("std_same"), F.round(std[False], 6).alias("std_diff"), F.round(mean[True] - mean[False], 6).alias("margin"),
        F.round(of("least", True), 6).alias("least_same"), F.round(of("most", False), 6).alias("most_diff"),
    )


@query("j8_exemplar_pairs", f"WITH {_E}, {_X} SELECT count(*) AS n, round(avg(list_dot_product(a.v, b.v)), 6) AS cross_mean, count(*) FILTER (WHERE list_dot_product(a.v, b.v) > 0.2) AS n_like FROM x a JOIN x b ON a.vec_id < b.vec_id AND a.label <> b.label")
def exemplar_pairs(s, d):
    p = pair_statistics(_exemplars(s, d).select("id", F.col("place").alias("label"), "v"), 0.2).where("NOT same")
    return p.select("n", F.round(F.col("total") / F.col("n"), 6).alias("cross_mean"), F.col("over").alias("n_like"))


@query(
    "f20_f21_t1_evidence_blend",
    f"WITH {_CAND}, t AS (SELECT *, CASE WHEN place % 3 = 0 THEN 1.0 WHEN place % 3 = 1 THEN 0.4 ELSE 0.5 END sem, CASE WHEN place = query_id % 10 THEN 1.0 ELSE 0.5 END tmp, CASE WHEN place = query_id % 10 THEN 0.0 WHEN (query_id + place) % 4 = 0 THEN 0.5 ELSE 0.5 * (1 - exp(-((query_id + place) % 4) / 2)) END pen FROM k), u AS (SELECT *, (score * 0.5 + sem * 0.25 + tmp * 0.15 + (1 - pen) * 0.1) total FROM t) SELECT query_id, place, round(pen, 6) AS penalty, round(total, 6) AS total, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, rank) AS new_rank FROM u",
)
def evidence_blend(s, d):
    hop = (F.col("query_id") + F.col("place")) % 4
    pen = ev.hop_penalty(hop, hop != 0, F.col("place") == F.col("query_id") % 10)
    c = _candidates(s, d).withColumn("penalty", pen)
    sem = F.when(F.col("place") % 3 == 0, 1.0).when(F.col("place") % 3 == 1, 0.4)
    out = retrieval.score_terms(c, sem, F.col("query_id") % 10, 1 - F.col("penalty"))
    return out.select("query_id", "place", F.round("penalty", 6).alias("penalty"), F.round("total", 6).alias("total"), "new_rank")


@query(
    "a14_classification_report",
    f"WITH {_CAND}, r AS (SELECT label t, place p FROM k JOIN e ON vec_id = query_id WHERE rank = 1), l AS (SELECT DISTINCT label FROM e) SELECT label, count(*) FILTER (WHERE t = label) AS support, round(count(*) FILTER (WHERE t = label AND p = label) / nullif(count(*) FILTER (WHERE p = label), 0), 6) AS precision, round(count(*) FILTER (WHERE t = label AND p = label) / nullif(count(*) FILTER (WHERE t = label), 0), 6) AS recall FROM r CROSS JOIN l GROUP BY label",
)
def classification_report(s, d):
    truth = table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    r = _candidates(s, d).where("rank = 1").join(truth, "query_id").select(F.col("label").alias("t"), F.col("place").alias("p"))
    by_t = r.groupBy(F.col("t").alias("label")).agg(F.count("*").alias("support"), F.sum((F.col("t") == F.col("p")).cast("int")).alias("hit"))
    by_p = r.groupBy(F.col("p").alias("label")).agg(F.count("*").alias("said"))
    j = by_t.join(by_p, "label", "left")
    return j.select("label", "support", F.round(F.col("hit") / F.col("said"), 6).alias("precision"), F.round(F.col("hit") / F.col("support"), 6).alias("recall"))


@query("a14_confusion_matrix", f"WITH {_CAND} SELECT label AS truth, place AS predicted, count(*) AS n FROM k JOIN e ON vec_id = query_id WHERE rank = 1 GROUP BY ALL")
def confusion(s, d):
    truth = table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"))
    return _candidates(s, d).where("rank = 1").join(truth, "query_id").groupBy("truth", F.col("place").alias("predicted")).agg(F.count("*").alias("n"))


@query(
    "e1_top1_top3_accuracy",
    f"WITH {_CAND} SELECT count(DISTINCT query_id) AS n, round(sum((rank = 1 AND place = label)::INT) / count(DISTINCT query_id), 4) AS top1, round(sum((place = label)::INT) / count(DISTINCT query_id), 4) AS top3 FROM k JOIN e ON vec_id = query_id",
)
def accuracy(s, d):
    truth = table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    j = _candidates(s, d).join(truth, "query_id")
    hit = F.col("place") == F.col("label")
    n = F.sum((F.col("rank") == 1).cast("int"))
    return j.agg(n.alias("n"), F.round(F.sum((hit & (F.col("rank") == 1)).cast("int")) / n, 4).alias("top1"), F.round(F.sum(hit.cast("int")) / n, 4).alias("top3"))


@query(
    "e4_ambiguous_subset",
    f"WITH {_CAND}, r AS (SELECT label, place, margin FROM k JOIN e ON vec_id = query_id WHERE rank = 1) SELECT margin < 0.05 AS ambiguous, count(*) AS n, round(median(margin), 6) AS median_margin, round(avg((place = label)::INT), 6) AS top1 FROM r GROUP BY 1",
)
def ambiguous(s, d):
    truth = table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    r = _candidates(s, d).where("rank = 1").join(truth, "query_id")
    return r.groupBy((F.col("margin") < 0.05).alias("ambiguous")).agg(F.count("*").alias("n"), F.round(F.median("margin"), 6).alias("median_margin"), F.round(F.avg((F.col("place") == F.col("label")).cast("int")), 6).alias("top1"))


@query(
    "a17_e7_recalibrated_thresholds",
    f"WITH {_E}, s AS (SELECT list_dot_product(v, lead(v) OVER (ORDER BY vec_id)) x, list_dot_product(v, lead(v, 2) OVER (ORDER BY vec_id)) y FROM e), t AS (SELECT unnest([-0.9, 0.0, 0.1, 0.3]) o), p AS (SELECT o, avg((x <= o)::INT) p, quantile_cont(x, 0.01) q1, avg(x) mx, avg(y) my, list(y ORDER BY y) l FROM t CROSS JOIN s WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY o) SELECT o AS old, round(p, 6) AS percentile, round(CASE WHEN o <= q1 THEN greatest(0, o + my - mx) ELSE l[floor(p * (len(l) - 1))::INT + 1] + (l[ceil(p * (len(l) - 1))::INT + 1] - l[floor(p * (len(l) - 1))::INT + 1]) * (p * (len(l) - 1) - floor(p * (len(l) - 1))) END, 6) AS new FROM p",
)
def recalibrated(s, d):
    e = table(s, d, "embeddings")
    near = lambda k: e.alias("a").join(e.alias("b"), F.col("a.vec_id") + k == F.col("b.vec_id")).select(F.col("a.vec_id").alias("i"), dot(F.col("a.embedding"), F.col("b.embedding")).alias("xy"[k - 1]))
    # Two columns of the compared similarities: what a quantile is taken of.
    both = near(1).join(near(2), "i")
    old = [-0.9, 0.0, 0.1, 0.3]
    stats = both.agg(*[F.avg((F.col("x") <= o).cast("int")).alias(f"p{i}") for i, o in enumerate(old)], F.percentile("x", F.lit(0.01)).alias("q1"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
    rows = stats.select(F.explode(F.array(*[F.struct(F.lit(o).alias("old"), F.col(f"p{i}").alias("p")) for i, o in enumerate(old)])).alias("r"), "q1", "mx", "my", "n").select("r.*", "q1", "mx", "my", (F.col("r.p") * (F.col("n") - 1)).alias("at"))
    # Quantiles of the other similarities, by their distributed order.
    ordered = with_index(both.select("y", "i"), ["y", "i"]).select("y", "index")
    rows = rows.join(ordered.select(F.col("y").alias("lo"), F.col("index").alias("f")), F.floor("at") == F.col("f")).join(ordered.select(F.col("y").alias("hi"), F.col("index").alias("c")), F.ceil("at") == F.col("c"))
    match = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))
    return rows.select("old", F.round("p", 6).alias("percentile"), F.round(F.when(F.col("old") <= F.col("q1"), F.greatest(F.lit(0.0), F.col("old") + F.col("my") - F.col("mx"))).otherwise(match), 6).alias("new"))


@query("a13_majority_cluster", "WITH c AS (SELECT label, vec_id % 7 AS k, count(*) n FROM embeddings GROUP BY ALL) SELECT label, arg_max(k, {'n': n, 'k': -k}) AS cluster FROM c GROUP BY label")
def majority_cluster(s, d):
    c = table(s, d, "embeddings").groupBy("label", (F.col("vec_id") % 7).alias("k")).agg(F.count("*").alias("n"))
    return c.groupBy("label").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("cluster"))


@query("a16_latency", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query(
    "e5_j9_failures",
    "SELECT event_id, CASE WHEN event_type = (SELECT max(event_type) FROM events) THEN 'lost' WHEN value < 5 THEN 'low_confidence_arrived' WHEN quality IS NOT NULL AND user_id % 5 <> quality THEN CASE WHEN user_id % 3 > 0 THEN 'top3_miss' ELSE 'top1_miss' END END AS kind FROM events LEFT JOIN labels ON doc_id = event_id WHERE event_type = (SELECT max(event_type) FROM events) OR value < 5 OR (quality IS NOT NULL AND user_id % 5 <> quality)",
)
def failures(s, d):
    e, lab = table(s, d, "events"), table(s, d, "labels")
    last = F.broadcast(e.agg(F.max("event_type").alias("last")))
    j = e.crossJoin(last).join(lab, F.col("doc_id") == F.col("event_id"), "left")
    miss = F.col("quality").isNotNull() & (F.col("user_id") % 5 != F.col("quality"))
    kind = F.when(F.col("event_type") == F.col("last"), "lost").when(F.col("value") < 5, "low_confidence_arrived").when(miss & (F.col("user_id") % 3 > 0), "top3_miss").when(miss, "top1_miss")
    return j.select("event_id", kind.alias("kind")).where("kind IS NOT NULL")


@query("e9_ground_truth", "SELECT vec_id, coalesce(quality, label) AS truth FROM embeddings LEFT JOIN labels ON doc_id = vec_id")
def ground_truth(s, d):
    return table(s, d, "embeddings").join(table(s, d, "labels"), F.col("doc_id") == F.col("vec_id"), "left").select("vec_id", F.coalesce("quality", "label").alias("truth"))


@query("u5_merge_errors", "SELECT event_type, count(DISTINCT user_id % 3) AS n_labels FROM events GROUP BY event_type HAVING count(DISTINCT user_id % 3) > 1")
def merge_errors(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.countDistinct(F.col("user_id") % 3).alias("n_labels")).where("n_labels > 1")
