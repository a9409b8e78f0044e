"""Queries of the place graph, whose transitions come from events: places are users modulo 40."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.operators import graph
from trailweave.plans.catalog import query, table

_T = """s AS (SELECT user_id % 40 p, ts, event_id, event_type FROM events), l AS (SELECT p src, lead(p) OVER (PARTITION BY event_type, p // 8 ORDER BY ts, event_id) dst FROM s),
 t AS (SELECT src, dst, count(*) forward FROM l WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL),
 u AS (SELECT t.*, coalesce(r.forward, 0) reverse, round(least(1, (t.forward + coalesce(r.forward, 0)) / 120) * 0.9 + 0.1, 3) confidence FROM t LEFT JOIN t r ON r.src = t.dst AND r.dst = t.src),
 g AS (SELECT least(src, dst) src, greatest(src, dst) dst, max(confidence) confidence, sum(forward)::BIGINT forward, sum(reverse)::BIGINT reverse, sum(forward + reverse)::BIGINT support, max(forward / 50) strength FROM u WHERE forward + reverse >= 3 AND confidence >= 0.55 AND src % 8 <> 7 AND dst % 8 <> 7 GROUP BY ALL),
 n AS (SELECT DISTINCT user_id % 40 id FROM events WHERE user_id % 8 <> 7),
 b AS (SELECT src, dst, confidence, forward FROM g UNION SELECT dst, src, confidence, forward FROM g)"""


def _transitions(s, d):
    e = table(s, d, "events").withColumn("p", F.col("user_id") % 40)
    w = W.partitionBy("event_type", F.floor(F.col("p") / 8)).orderBy("ts", "event_id")
    t = e.select(F.col("p").alias("src"), F.lead("p").over(w).alias("dst")).where("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("forward"))
    r = t.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("forward").alias("reverse"))
    u = t.join(r, ["src", "dst"], "left").fillna({"reverse": 0})
    both = F.col("forward") + F.col("reverse")
    return u.withColumns({"confidence": F.round(F.least(F.lit(1.0), both / 120.0) * 0.9 + 0.1, 3), "support": both, "strength": F.col("forward") / 50.0})


def _nodes(s, d):
    return table(s, d, "events").where("user_id % 8 <> 7").select((F.col("user_id") % 40).alias("id")).distinct()


def _edges(s, d):
    return graph.gated_edges(_transitions(s, d), _nodes(s, d), 0.55, 3)


@query("g1_a10_j4_gated_graph", f"WITH {_T} SELECT src, dst, round(confidence, 3) AS confidence, forward, reverse, support, round(strength, 6) AS strength FROM g")
def gated_graph(s, d):
    return _edges(s, d).withColumns({"confidence": F.round("confidence", 3), "strength": F.round("strength", 6)})


@query(
    "g2_g3_node_types",
    f"WITH {_T}, dg AS (SELECT src id, count(DISTINCT dst) degree FROM b GROUP BY 1), a AS (SELECT n.id, coalesce(degree, 0) degree, CASE n.id % 5 WHEN 0 THEN 'room' WHEN 1 THEN 'corridor' WHEN 2 THEN 'junction' WHEN 3 THEN 'stairs' ELSE 'unknown' END sc FROM n LEFT JOIN dg USING (id)) SELECT id, degree, CASE WHEN degree >= 6 THEN 'junction' WHEN sc = 'stairs' THEN 'stairs' WHEN sc = 'junction' AND id % 2 = 0 THEN 'junction' WHEN sc IN ('corridor', 'junction') THEN 'corridor' WHEN sc = 'room' THEN 'room' ELSE 'unknown' END AS node_type FROM a",
)
def node_types(s, d):
    scene = F.expr("CASE id % 5 WHEN 0 THEN 'room' WHEN 1 THEN 'corridor' WHEN 2 THEN 'junction' WHEN 3 THEN 'stairs' ELSE 'unknown' END")
    votes = F.create_map(F.lit("left"), F.lit(4), F.lit("right"), F.when(F.col("id") % 2 == 0, 3).otherwise(2))
    n = _nodes(s, d).select("id", scene.alias("scene"), votes.alias("walkable"), F.lit(5).alias("n"))
    return graph.node_types(n, _edges(s, d), 6).select("id", "degree", "node_type")


@query("g4_components", f"WITH RECURSIVE {_T}, r AS (SELECT id, id AS x FROM n UNION SELECT r.id, b.dst FROM r JOIN b ON b.src = r.x) SELECT id, min(x) AS component FROM r GROUP BY id")
def components(s, d):
    return graph.components(_nodes(s, d), _edges(s, d))


#: Problems of the graph: check, subject.
_WARN = f"WITH {_T}, c AS (SELECT user_id % 40 id, count(*) n, stddev_pop(value) / 100 sd, count(*) FILTER (WHERE event_type = 'click') k, count(*) FILTER (WHERE event_type <> 'click') o FROM events GROUP BY 1), a AS (SELECT n.id, c.n, c.sd, k, o FROM n JOIN c USING (id)), w AS (SELECT 'isolated_node' AS check, id::VARCHAR AS subject FROM a WHERE id NOT IN (SELECT src FROM b) UNION ALL SELECT 'low_observations', id::VARCHAR FROM a WHERE n < 200 UNION ALL SELECT 'high_variance', id::VARCHAR FROM a WHERE sd > 0.35 UNION ALL SELECT 'mixed_scene', id::VARCHAR FROM a WHERE k > 0 AND o > 0 AND least(k, o) / (k + o) >= 0.2 UNION ALL SELECT 'weak_edge', src || '-' || dst FROM g WHERE confidence < 0.6 OR support < 200)"


@query("g5_g6_graph_warnings", f"{_WARN} SELECT * FROM w")
def graph_warnings(s, d):
    e = table(s, d, "events")
    click = (F.col("event_type") == "click").cast("int")
    c = e.groupBy((F.col("user_id") % 40).alias("id")).agg(F.count("*").alias("n"), (F.stddev_pop("value") / 100).alias("std_sim"), F.sum(click).alias("k"), F.sum(1 - click).alias("o"))
    scenes = F.map_filter(F.create_map(F.lit("room"), F.col("k"), F.lit("hall"), F.col("o")), lambda _, v: v > 0)
    n = _nodes(s, d).join(c, "id").withColumn("scenes", scenes)
    return graph.warnings(n, _edges(s, d), 200, 0.35, 0.6, 0.2)


@query("g8_khop", f"WITH RECURSIVE {_T}, r AS (SELECT id src, id dst, 0 h FROM n WHERE id = 9 UNION SELECT r.src, b.dst, h + 1 FROM r JOIN b ON b.src = r.dst WHERE h < 2) SELECT dst, min(h) AS hops FROM r GROUP BY dst")
def khop(s, d):
    return graph.hops(_edges(s, d), 2, _nodes(s, d).where("id = 9")).select("dst", "hops")


@query("g9_hop_distances", f"WITH RECURSIVE {_T}, r AS (SELECT id src, id dst, 0 h FROM n WHERE id IN (SELECT src FROM b) UNION SELECT r.src, b.dst, h + 1 FROM r JOIN b ON b.src = r.dst WHERE h < (SELECT count(*) FROM n)) SELECT src, dst, min(h) AS hops FROM r GROUP BY ALL")
def hop_distances(s, d):
    return graph.hops(_edges(s, d))


_BF = "r AS (SELECT dst, cost, path FROM (SELECT 9::BIGINT dst, 0.0::DOUBLE cost, [9::BIGINT] path) UNION ALL SELECT b.dst, cost + {w}, list_append(path, b.dst) FROM r JOIN b ON b.src = r.dst WHERE NOT list_contains(path, b.dst)), z AS (SELECT dst, arg_min({{'c': cost, 'p': path}}, {{'c': round(cost, 9), 'n': len(path), 'p': path}}) x FROM r GROUP BY dst)"


@query("g10_shortest_paths", f"WITH RECURSIVE {_T}, {_BF.format(w='1.0 / greatest(forward, 1)')} SELECT dst, round(x.c, 6) AS cost, array_to_string(x.p, '>') AS path FROM z")
def shortest_paths(s, d):
    p = graph.shortest_paths(_edges(s, d), F.lit(9).cast("long"), weight=graph.inverse_count("forward"))
    return p.select("dst", F.round("cost", 6).alias("cost"), F.array_join("path", ">").alias("path"))


@query("g10_fewest_hops", f"WITH RECURSIVE {_T}, {_BF.format(w='1.0')} SELECT dst, x.c AS cost, array_to_string(x.p, '>') AS path FROM z")
def fewest_hops(s, d):
    p = graph.shortest_paths(_edges(s, d), F.lit(9).cast("long"))
    return p.select("dst", "cost", F.array_join("path", ">").alias("path"))


@query(
    "g11_transition_prior",
    f"WITH {_T}, p AS (SELECT x.id src, y.id dst, b.confidence c FROM n x CROSS JOIN n y LEFT JOIN b ON b.src = x.id AND b.dst = y.id), q AS (SELECT *, count(c) OVER (PARTITION BY src) k, sum(c) OVER (PARTITION BY src) t, count(*) OVER (PARTITION BY src) m FROM p), z AS (SELECT *, greatest(0, 1 - 0.7 - 0.005 * (m - 1 - k)) lft FROM q) SELECT src, dst, round(CASE WHEN src = dst THEN 0.7 + CASE WHEN k = 0 THEN lft ELSE 0 END WHEN c IS NULL THEN 0.005 ELSE lft * c / t END, 6) AS p FROM z",
)
def transition_prior(s, d):
    return graph.transition_prior(_nodes(s, d), _edges(s, d), 0.7, 0.005).withColumn("p", F.round("p", 6))


@query("g12_complete_graph", f"WITH {_T} SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON a.id < b.id")
def complete_graph(s, d):
    return graph.complete(_nodes(s, d))


@query(
    "w14_e8_false_jumps",
    f"WITH RECURSIVE {_T}, r AS (SELECT id src, id dst, 0 h FROM n UNION SELECT r.src, b.dst, h + 1 FROM r JOIN b ON b.src = r.dst WHERE h < (SELECT count(*) FROM n)), hp AS (SELECT src, dst, min(h) h FROM r GROUP BY ALL), m AS (SELECT event_type, p cur, lag(p) OVER (PARTITION BY event_type ORDER BY ts, event_id) prv FROM s) SELECT event_type, sum((prv IS NOT NULL AND prv <> cur AND h > 1)::INT)::BIGINT AS jumps, round(sum((prv IS NOT NULL AND prv <> cur AND h > 1)::INT) / greatest(1, count(*) - 1), 4) AS rate FROM m LEFT JOIN hp ON src = prv AND dst = cur GROUP BY event_type",
)
def false_jumps(s, d):
    e = table(s, d, "events").withColumn("cur", F.col("user_id") % 40)
    m = e.select("event_type", "cur", F.lag("cur").over(W.partitionBy("event_type").orderBy("ts", "event_id")).alias("prv"))
    h = graph.hops(_edges(s, d), sources=_nodes(s, d)).select(F.col("src").alias("prv"), F.col("dst").alias("cur"), "hops")
    jump = F.coalesce(((F.col("prv") != F.col("cur")) & (F.col("hops") > 1)).cast("int"), F.lit(0))
    return m.join(h, ["prv", "cur"], "left").groupBy("event_type").agg(F.sum(jump).alias("jumps"), F.round(F.sum(jump) / F.greatest(F.lit(1), F.count("*") - 1), 4).alias("rate"))


_PR = "WITH gt AS ({a}), rp AS ({b}), i AS (SELECT * FROM gt INTERSECT SELECT * FROM rp) SELECT CASE WHEN (SELECT count(*) FROM gt) = 0 THEN 1.0 ELSE round((SELECT count(*) FROM i) / (SELECT count(*) FROM gt), 6) END AS recall, CASE WHEN (SELECT count(*) FROM rp) = 0 THEN 0.0 ELSE round((SELECT count(*) FROM i) / (SELECT count(*) FROM rp), 6) END AS precision"


def _precision_recall(truth, reported):
    truth, reported = truth.distinct(), reported.distinct()
    n = truth.agg(F.count("*").alias("t")).crossJoin(reported.agg(F.count("*").alias("r"))).crossJoin(truth.intersect(reported).agg(F.count("*").alias("i")))
    return n.select(F.when(F.col("t") == 0, 1.0).otherwise(F.round(F.col("i") / F.nullif("t", F.lit(0)), 6)).alias("recall"), F.when(F.col("r") == 0, 0.0).otherwise(F.round(F.col("i") / F.nullif("r", F.lit(0)), 6)).alias("precision"))


@query("u1_transition_precision_recall", _PR.format(a="SELECT DISTINCT user_id % 20 a, user_id % 7 b FROM events WHERE value > 60", b="SELECT DISTINCT user_id % 20 a, user_id % 7 b FROM events WHERE value < 40"))
def transition_pr(s, d):
    e = table(s, d, "events").select("value", (F.col("user_id") % 20).alias("a"), (F.col("user_id") % 7).alias("b"))
    return _precision_recall(e.where("value > 60").select("a", "b"), e.where("value < 40").select("a", "b"))


@query("u2_edge_precision_recall", _PR.format(a="SELECT DISTINCT least(user_id % 20, event_id % 20) a, greatest(user_id % 20, event_id % 20) b FROM events WHERE value > 95", b="SELECT DISTINCT least(user_id % 20, event_id % 20) a, greatest(user_id % 20, event_id % 20) b FROM events WHERE value < 5"))
def edge_pr(s, d):
    u, v = F.col("user_id") % 20, F.col("event_id") % 20
    e = table(s, d, "events").select("value", F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    return _precision_recall(e.where("value > 95").select("a", "b"), e.where("value < 5").select("a", "b"))


@query(
    "e2_graph_metrics",
    f"WITH RECURSIVE {_T}, x AS (SELECT label, vec_id, embedding::DOUBLE[] v FROM embeddings), p AS (SELECT a.label = b.label same, list_dot_product(a.v, b.v) s FROM x a JOIN x b ON a.vec_id < b.vec_id), r AS (SELECT id, id AS y FROM n UNION SELECT r.id, b.dst FROM r JOIN b ON b.src = r.y), c AS (SELECT id, min(y) c FROM r GROUP BY id) SELECT round(avg(s) FILTER (WHERE same) / (avg(s) FILTER (WHERE same) + avg(s) FILTER (WHERE NOT same)), 4) AS purity, round(avg((s > 0.2)::INT) FILTER (WHERE NOT same), 4) AS duplicate_rate, (SELECT count(DISTINCT c) - 1 FROM c) AS fragmentation FROM p",
)
def graph_metrics(s, d):
    from trailweave.functions.vectors import pair_statistics

    p = pair_statistics(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")), 0.2)
    mean = lambda c, kind: F.sum(F.when(kind, F.col(c))) / F.nullif(F.sum(F.when(kind, F.col("n"))), F.lit(0))
    same, diff = mean("total", F.col("same")), mean("total", ~F.col("same"))
    m = p.agg(F.round(same / (same + diff), 4).alias("purity"), F.round(mean("over", ~F.col("same")), 4).alias("duplicate_rate"))
    return m.crossJoin(graph.components(_nodes(s, d), _edges(s, d)).agg((F.countDistinct("component") - 1).alias("fragmentation")))
