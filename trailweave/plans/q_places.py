"""Queries of places: exemplars, counters, statistics, reconciliation, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.functions.vectors import centroids
from trailweave.operators import cluster, places, reconcile
from trailweave.plans.catalog import query, table

_E = "e AS (SELECT vec_id, embedding::DOUBLE[] v, label FROM embeddings)"
_C = "m AS (SELECT label, i, avg(x) m FROM (SELECT label, unnest(v) x, generate_subscripts(v, 1) i FROM e) GROUP BY ALL), c AS (SELECT label, list(m / n ORDER BY i) AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) n FROM m) GROUP BY label)"


@query("j1_j2_members", "SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings WHERE vec_id % 3 > 0 GROUP BY label")
def members(s, d):
    e = table(s, d, "embeddings")
    listed = e.groupBy(F.col("label").alias("place_id")).agg(F.collect_list("vec_id").alias("observation_ids"))
    there = e.where("vec_id % 3 > 0").select(F.col("vec_id").alias("id"))
    return places.members(listed, there).groupBy(F.col("place_id").alias("label")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("j3_semi_join", "SELECT vec_id FROM embeddings WHERE label IN (SELECT p_size % 10 FROM part WHERE p_partkey < 30)")
def semi_join(s, d):
    used = table(s, d, "part").where("p_partkey < 30").select((F.col("p_size") % 10).alias("label")).distinct()
    return table(s, d, "embeddings").join(used, "label", "left_semi").select("vec_id")


@query(
    "k4_temporal_exemplars",
    "WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) r, count(*) OVER (PARTITION BY label) n FROM embeddings) SELECT label, CASE WHEN r = 1 THEN 1 WHEN r = n THEN 2 ELSE 3 END AS rank, vec_id AS id FROM r WHERE r IN (1, n, n // 2 + 1)",
)
def temporal_exemplars(s, d):
    return places.exemplars(table(s, d, "embeddings"), "label", ["vec_id"], "vec_id", "embedding")


#: The first row of each label, the row least like it, and the row least like both.
_FAR = """f AS (SELECT label, min(vec_id) id FROM e GROUP BY label), a AS (SELECT e.label, e.vec_id, e.v, list_dot_product(e.v, x.v) s1, f.id fst FROM e JOIN f USING (label) JOIN e x ON x.vec_id = f.id),
    b AS (SELECT label, arg_min(vec_id, {'s': s1, 'i': vec_id}) id FROM a GROUP BY label), g AS (SELECT a.*, b.id snd, greatest(s1, list_dot_product(a.v, x.v)) s2 FROM a JOIN b ON a.label = b.label JOIN e x ON x.vec_id = b.id),
    h AS (SELECT label, arg_min(vec_id, {'s': s2, 'i': vec_id}) id FROM g GROUP BY label)"""


@query("k5_diverse_exemplars", f"WITH {_E}, {_FAR} SELECT label, 1 AS rank, id FROM f UNION ALL SELECT label, 2, id FROM b UNION ALL SELECT label, 3, id FROM h")
def diverse_exemplars(s, d):
    return places.exemplars(table(s, d, "embeddings"), "label", ["vec_id"], "vec_id", "embedding", "diversity", 3)


def _lloyd_sql(rounds: int = 10) -> str:
    """CTEs of k-means with three centres a label that begin far apart: z(label, vec_id, v, j), y(label, j, m)."""
    out = "c0 AS (SELECT label, list(x.v ORDER BY rank) AS c FROM (SELECT label, 1 AS rank, id FROM f UNION ALL SELECT label, 2, id FROM b UNION ALL SELECT label, 3, id FROM h) p JOIN (SELECT vec_id, v FROM e) x ON x.vec_id = p.id GROUP BY label)"
    at = "list_transform([list_transform(c, lambda x: list_dot_product(x, x) - 2 * list_dot_product(v, x))], lambda d: list_position(d, list_min(d)))[1]"
    for i in range(rounds):
        out += f""",
    a{i} AS MATERIALIZED (SELECT e.label, vec_id, v, {at} AS j FROM e JOIN c{i} USING (label)),
    m{i} AS (SELECT label, j, list(m ORDER BY i) AS m FROM (SELECT label, j, i, avg(x) AS m FROM (SELECT label, j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY ALL) GROUP BY ALL),
    c{i + 1} AS MATERIALIZED (SELECT o.label, list(coalesce(m, old) ORDER BY o.j) AS c FROM (SELECT label, unnest(c) AS old, generate_subscripts(c, 1) AS j FROM c{i}) o LEFT JOIN m{i} ON m{i}.label = o.label AND m{i}.j = o.j GROUP BY o.label)"""
    return out + f""",
    z AS MATERIALIZED (SELECT e.label, vec_id, v, {at} AS j FROM e JOIN c{rounds} USING (label)),
    y AS (SELECT label, j, list_transform([list(m ORDER BY i)], lambda l: list_transform(l, lambda x: x / sqrt(list_dot_product(l, l))))[1] AS m FROM (SELECT label, j, i, avg(x) AS m FROM (SELECT label, j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM z) GROUP BY ALL) GROUP BY ALL)"""


@query("k6_kmeans_exemplars", f"WITH {_E}, {_FAR}, {_lloyd_sql()} SELECT label, row_number() OVER (PARTITION BY label ORDER BY j) AS rank, id FROM (SELECT z.label, z.j, arg_max(vec_id, {{'s': list_dot_product(v, m), 'i': -vec_id}}) AS id FROM z JOIN y ON y.label = z.label AND y.j = z.j GROUP BY ALL)")
def kmeans_exemplars(s, d):
    return places.exemplars(table(s, d, "embeddings"), "label", ["vec_id"], "vec_id", "embedding", "kmeans", 3)


@query("m3_sub_cluster_means", f"WITH {_E}, {_FAR}, {_lloyd_sql()}, r AS (SELECT label, m, row_number() OVER (PARTITION BY label ORDER BY j) AS rank FROM y) SELECT label, rank, generate_subscripts(m, 1) - 1 AS dim, round(unnest(m), 6) AS x FROM r")
def sub_cluster_means(s, d):
    m = places.cluster_means(table(s, d, "embeddings"), "label", ["vec_id"], "vec_id", "embedding", 3)
    return m.select("label", "rank", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("k7_evenly_spaced", "SELECT o_custkey, k[1] AS a, k[2] AS b, k[3] AS c FROM (SELECT o_custkey, CASE WHEN len(l) <= 3 THEN l ELSE [l[1], l[CASE WHEN (len(l) - 1) % 2 = 0 THEN (len(l) - 1) // 2 WHEN ((len(l) - 2) // 2) % 2 = 0 THEN (len(l) - 2) // 2 ELSE len(l) // 2 END + 1], l[-1]] END k FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) l FROM orders GROUP BY 1))")
def evenly_spaced(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("l"))
    k = places.evenly_spaced(F.col("l"), 3)
    return o.select("o_custkey", k.alias("k")).select("o_custkey", *[F.get("k", F.lit(i)).alias(c) for i, c in enumerate("abc")])


@query(
    "a3_a4_top_tokens",
    "WITH w AS (SELECT p_size, t.p_partkey k, unnest(string_split(p_name, ' ')) item, generate_subscripts(string_split(p_name, ' '), 1) i FROM part t), n AS (SELECT p_size, item, count(*) n, min(k * 100 + i) f FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, f) r FROM n) SELECT p_size, r - 1 AS rank, item, n FROM r WHERE r <= 8",
)
def top_tokens(s, d):
    c = places.counted(table(s, d, "part"), ["p_size"], F.split("p_name", " "), ["p_partkey"], 8)
    return c.select("p_size", F.posexplode("items").alias("rank", "x")).select("p_size", "rank", "x.item", "x.n")


@query(
    "a5_dominant_label",
    "WITH r AS (SELECT user_id, event_type, count(*) n, min(k) f FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM events) GROUP BY ALL) SELECT user_id, arg_max(event_type, {'n': n, 'f': -f}) AS dominant, max(n) AS n FROM r GROUP BY user_id",
)
def dominant(s, d):
    return places.dominant(table(s, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


_S = f"{_E}, {_C}, s AS (SELECT e.label, vec_id, list_dot_product(v, c) s FROM e JOIN c USING (label))"


@query("a6_visual_stats", f"WITH {_S} SELECT label, round_even(avg(s), 4) AS mean_sim, round_even(stddev_pop(s), 4) AS std_sim, count(*) AS n FROM s GROUP BY label")
def visual_stats(s, d):
    return places.visual_stats(table(s, d, "embeddings"), "label", "embedding")


@query("a7_representatives", f"WITH {_S} SELECT label, CASE WHEN label = 3 THEN min(vec_id) ELSE arg_max(vec_id, {{'s': s, 'i': -vec_id}}) END AS representative FROM s GROUP BY label")
def representatives(s, d):
    e = table(s, d, "embeddings")
    gap = F.when((F.col("label") == 3) & (F.col("vec_id") % 7 == 0), None).otherwise(F.col("embedding"))
    return places.representatives(e.withColumn("embedding", gap), "label", ["vec_id"], "vec_id", "embedding")


@query("m4_nearest_centroid", f"WITH {_E}, {_C} SELECT vec_id, arg_max(c.label, {{'s': list_dot_product(v, c), 'l': -c.label}}) AS predicted FROM e CROSS JOIN c GROUP BY vec_id")
def nearest_centroid(s, d):
    e = table(s, d, "embeddings")
    return places.nearest_centroid(e, centroids(e, ["label"], "embedding"), "vec_id", "embedding", "label").select("vec_id", "predicted")


@query("j10_nearest_members", f"WITH {_E}, {_C} SELECT c.label AS label, arg_max(vec_id, {{'s': list_dot_product(v, c), 'i': -vec_id}}) AS cosine, arg_min(vec_id, {{'s': list_distance(v, c), 'i': vec_id}}) AS l2 FROM c JOIN e USING (label) GROUP BY c.label")
def nearest_members(s, d):
    e = table(s, d, "embeddings")
    points = centroids(e, ["label"], "embedding").select(F.col("label").alias("point_id"), "label", F.col("centroid").alias("v"))
    a = places.nearest_members(e, points, "label", "vec_id", "embedding").select("label", F.col("member").alias("cosine"))
    return a.join(places.nearest_members(e, points, "label", "vec_id", "embedding", l2=True).select("label", F.col("member").alias("l2")), "label")


@query("m1_m2_choose_k")
def choose_k(s, d):
    return cluster.choose_k(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")


@query("m2_cluster_assignment")
def cluster_assignment(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    k = cluster.choose_k(e, "vec_id", "embedding").where("best").first().k
    return cluster.clustered(e, "embedding", k).select("vec_id", "cluster")


def _places(s, d):
    scene = F.expr("CASE vec_id % 4 WHEN 0 THEN 'room' WHEN 1 THEN 'corridor' WHEN 2 THEN 'unknown' ELSE 'corridor_junction' END")
    e = table(s, d, "embeddings").withColumn("place", F.floor(F.col("vec_id") / 20)).withColumn("scene", F.when(F.col("place") % 3 == 0, "corridor").otherwise(scene))
    marks = F.when(F.col("place_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("door"), F.when(F.col("place_id") % 2 == 0, "desk").otherwise("stairs")))
    signs = F.when(F.col("place_id") % 5 == 0, F.array(F.lit("room 1"))).otherwise(F.array().cast("array<string>"))
    g = e.groupBy(F.col("place").alias("place_id")).agg(F.sort_array(F.collect_list("vec_id")).alias("observation_ids"), F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "scene"))), lambda x: x["scene"]).alias("scenes"))
    return e, g.withColumns({"exemplar_ids": F.array(F.get("observation_ids", F.lit(0)), F.element_at("observation_ids", -1)), "marks": marks, "signs": signs})


_PL = """e AS (SELECT vec_id, embedding::DOUBLE[] v, vec_id // 20 p FROM embeddings), x AS (SELECT p, min(vec_id) i FROM e GROUP BY p UNION SELECT p, max(vec_id) FROM e GROUP BY p), xv AS (SELECT x.p, e.v FROM x JOIN e ON e.vec_id = x.i),
 vis AS (SELECT a.p pa, b.p pb, max(list_dot_product(a.v, b.v)) vis FROM xv a JOIN xv b ON a.p < b.p GROUP BY ALL),
 pl AS (SELECT DISTINCT p, CASE WHEN p % 3 = 0 THEN 'corridor' ELSE 'room' END sc, CASE WHEN p % 4 = 0 THEN [] ELSE ['door', CASE WHEN p % 2 = 0 THEN 'desk' ELSE 'stairs' END] END m, CASE WHEN p % 5 = 0 THEN ['room 1'] ELSE [] END sg FROM e),
 q AS (SELECT *, list_concat(list_filter(m, lambda x: x <> 'door'), sg) ev FROM pl),
 j AS (SELECT a.p a, b.p b, vis, a.sc = 'corridor' AND b.sc = 'corridor' hall, a.sc = b.sc ok, a.m ma, b.m mb, a.ev da, b.ev db, CASE WHEN len(a.m) = 0 OR len(b.m) = 0 THEN 0 ELSE len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m))) END lj, CASE WHEN len(a.ev) = 0 OR len(b.ev) = 0 THEN 0 ELSE len(list_intersect(a.ev, b.ev)) / len(list_distinct(list_concat(a.ev, b.ev))) END dj FROM q a JOIN q b ON a.p < b.p JOIN vis ON pa = a.p AND pb = b.p)"""


@query(
    "r1_r4_merge_decisions",
    f"""WITH {_PL} SELECT a, b, round(lj, 6) AS landmark_jaccard, ok AS scene_compatible, CASE WHEN hall THEN ((dj >= 0.5 AND vis >= 0.3) OR (len(da) = 0 AND len(db) = 0 AND vis >= 0.95)) AND ok AND NOT (len(da) > 0 AND len(db) > 0 AND dj = 0 AND vis >= 0.05) AND NOT (NOT ok AND vis >= 0.2)
    ELSE vis >= 0.2 AND ok AND NOT (len(ma) > 0 AND len(mb) > 0 AND lj < 1e-9 AND vis >= 0.05) AND (lj >= 0.5 OR (len(ma) = 0 AND len(mb) = 0 AND vis >= 0.3)) END AS merged FROM j""",
)
def merge_decisions(s, d):
    from trailweave.operators.retrieval import place_similarity

    e, p = _places(s, d)
    x = p.select("place_id", F.explode("exemplar_ids").alias("vec_id")).join(e.select("vec_id", "embedding"), "vec_id").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("place_id").alias("place"))
    top = F.when(F.col("place_id") % 3 == 0, "corridor").otherwise("room")
    side = lambda c: p.select(F.col("place_id").alias(c), top.alias(f"scene_{c}"), F.col("marks").alias(f"marks_{c}"), F.col("signs").alias(f"signs_{c}"))
    pairs = place_similarity(x).withColumnRenamed("similarity", "vis").join(side("a"), "a").join(side("b"), "b").withColumn("order_gap", F.col("b") - F.col("a"))
    out = reconcile.merge_decisions(pairs, {"visual": 0.2, "extra": 0.3})
    return out.select("a", "b", F.round("landmark_jaccard", 6).alias("landmark_jaccard"), "scene_compatible", "merged")


def _counted(l: str, then: str) -> str:
    """Of the distinct elements of a list, the most frequent first and of equals those first met, ``then`` picks."""
    return f"list_transform([{l}], lambda l: list_transform(list_sort(list_transform(list_distinct(l), lambda x: [-len(list_filter(l, lambda y: y = x)), list_position(l, x)])){then}, lambda r: l[r[2]]))[1]"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


#: One state a step: the place at hand, those after it in this pass, those done with, and the pass.
_TOLD = "list_distinct(list_concat(list_filter({m}, lambda x: x IN ('room_sign', 'stairs', 'elevator', 'entrance', 'reception', 'desk')), {g}))"
_HALL = "(h.t IN ('corridor', 'junction') AND q.t IN ('corridor', 'junction'))"
_OK = f"(h.t = 'unknown' OR q.t = 'unknown' OR h.t = q.t OR {_HALL})"
_VIS = "list_max(flatten(list_transform(h.ex, lambda i: list_transform(q.ex, lambda j: sim[i][j]))))"
_SAME = f"""list_transform([{_VIS}], lambda vis: {_OK} AND CASE WHEN {_HALL} THEN (({_jaccard("h.ev", "q.ev")} >= 0.5 AND vis >= 0.3) OR (len(h.ev) = 0 AND len(q.ev) = 0 AND vis >= 0.95)) AND NOT (len(h.ev) > 0 AND len(q.ev) > 0 AND len(list_intersect(h.ev, q.ev)) = 0 AND vis >= 0.05)
     ELSE vis >= 0.2 AND NOT (len(h.m) > 0 AND len(q.m) > 0 AND len(list_intersect(h.m, q.m)) = 0 AND vis >= 0.05) AND ({_jaccard("h.m", "q.m")} >= 0.5 OR (len(h.m) = 0 AND len(q.m) = 0 AND vis >= 0.3)) END)[1]"""


def _place_sql(x: dict[str, str]) -> str:
    """A place with its dominant scene and telling evidence."""
    top = _counted(x["sc"], "[1:1]") + "[1]"
    fields = x | {"t": f"CASE {top} WHEN 'corridor_junction' THEN 'junction' ELSE {top} END", "ev": _TOLD.format(m=x["m"], g=x["g"])}
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


_BOTH = {"id": "least(h.id, q.id)", "n": "h.n + q.n", "obs": "list_sort(list_concat(h.obs, q.obs))", "ex": "list_transform([list_concat(h.ex, q.ex)], lambda c: CASE WHEN len(c) > 3 THEN [c[1], c[3], c[-1]] ELSE c END)[1]", "sc": "list_concat(h.sc, q.sc)", "m": _counted("list_concat(h.m, q.m)", "[1:8]"), "g": _counted("list_concat(h.g, q.g)", "[1:8]")}
_SWEEP = f"""{_PL}, xi AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM (SELECT DISTINCT vec_id AS i FROM e)), sm AS (SELECT list(r ORDER BY k) AS sim FROM (SELECT a.k, list(list_dot_product(x.v, y.v) ORDER BY b.k) AS r FROM xi a JOIN e x ON x.vec_id = a.i CROSS JOIN xi b JOIN e y ON y.vec_id = b.i GROUP BY a.k)),
    scn AS (SELECT p, vec_id, CASE WHEN p % 3 = 0 THEN 'corridor' ELSE CASE vec_id % 4 WHEN 0 THEN 'room' WHEN 1 THEN 'corridor' WHEN 2 THEN 'unknown' ELSE 'corridor_junction' END END AS seen FROM e),
    one AS (SELECT p AS id, 1 AS n, list(vec_id ORDER BY vec_id) AS obs, [arg_min(k, vec_id), arg_max(k, vec_id)] AS ex, list(seen ORDER BY vec_id) AS sc, any_value(m) AS m, any_value(sg) AS g FROM scn JOIN xi ON i = vec_id JOIN pl USING (p) GROUP BY p),
    s0 AS (SELECT list({_place_sql({k: k for k in _BOTH})} ORDER BY id) AS l FROM one),
    st AS (SELECT 1 AS pass, len(l) AS before, l[1] AS h, l[2:] AS todo, l[1:0] AS kept, false AS fin FROM s0 UNION ALL
     SELECT CASE WHEN more THEN pass + 1 ELSE pass END, CASE WHEN more THEN len(kept1) ELSE before END,
      CASE WHEN hit IS NOT NULL THEN list_transform([todo[hit]], lambda q: {_place_sql(_BOTH)})[1] WHEN more THEN kept1[1] ELSE todo[1] END,
      CASE WHEN hit IS NOT NULL THEN list_filter(todo, lambda x, i: i <> hit) WHEN more THEN kept1[2:] ELSE todo[2:] END,
      CASE WHEN hit IS NOT NULL THEN kept WHEN more THEN kept1[1:0] ELSE kept1 END, hit IS NULL AND len(todo) = 0 AND NOT more
     FROM (SELECT *, hit IS NULL AND len(todo) = 0 AND len(kept1) <> before AND pass < 10 AS more FROM (SELECT *, list_append(kept, h) AS kept1, nullif(list_position(list_transform(todo, lambda q: {_SAME}), true), 0) AS hit FROM st, sm WHERE NOT fin)))"""


@query(
    "d6_r5_r6_reconciled_places",
    f"""WITH RECURSIVE {_SWEEP}, z AS (SELECT unnest(kept) AS x FROM st WHERE fin), ids AS (SELECT list(i ORDER BY k) AS ids FROM xi)
    SELECT 'm' AS map_id, x.id AS place_id, array_to_string(x.obs, ',') AS observation_ids, array_to_string(list_transform(x.ex, lambda k: ids[k]), ',') AS exemplar_ids, array_to_string(x.m, ',') AS marks, array_to_string(x.g, ',') AS signs, x.n AS merged_from FROM z, ids""",
)
def reconciled(s, d):
    e, p = _places(s, d)
    one = p.withColumn("map_id", F.lit("m"))
    x = e.select(F.lit("m").alias("map_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    out = reconcile.reconcile(one, x, "map_id", {"visual": 0.2, "extra": 0.3})
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("observation_ids", "exemplar_ids", "marks", "signs")})


@query("u3_u4_set_operations", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_intersect(m, ['room_sign', 'stairs', 'desk']), ['sign ' || p_size]))), ',') AS evidence, p_size + 1 AS total FROM (SELECT p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN ['door', 'desk'] WHEN 1 THEN ['stairs'] ELSE [] END m FROM part)")
def set_operations(s, d):
    k = F.col("p_size") % 3
    m = F.when(k == 0, F.array(F.lit("door"), F.lit("desk"))).when(k == 1, F.array(F.lit("stairs"))).otherwise(F.array().cast("array<string>"))
    signs = F.array(F.concat(F.lit("sign "), F.col("p_size").cast("string")))
    a, b = F.create_map(F.lit("x"), F.col("p_size")), F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2))
    added = F.map_zip_with(a, b, lambda _, v, w: F.coalesce(v, F.lit(0)) + F.coalesce(w, F.lit(0)))
    return table(s, d, "part").select("p_partkey", F.array_join(F.sort_array(reconcile.discriminative(m, signs)), ",").alias("evidence"), added["x"].alias("total"))
