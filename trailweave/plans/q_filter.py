"""Queries of the Bayes filter, trackers, gates, and of replays' evaluation."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.functions import registry
from trailweave.operators import places
from trailweave.operators import sequence as seq
from trailweave.plans.catalog import query, table
from trailweave.plans.q_graph import _WARN, graph_warnings
from trailweave.plans.q_retrieval import _CAND, _candidates
from trailweave.scratch import run_dir
from trailweave.sources import store
from trailweave.streaming import filter as bayes
from trailweave.streaming import gate, tracker

_EV = "ev AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"
#: The prior of a path of four places.
MATRIX = [[0.75, 0.15, 0.05, 0.05], [0.1, 0.75, 0.1, 0.05], [0.05, 0.1, 0.75, 0.1], [0.05, 0.05, 0.15, 0.75]]


def _ev(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").withColumn("pos", F.row_number().over(w) - 1)


_EVIDENCE = "[(event_id % 11) / 10, (event_id % 7) / 10, (event_id % 5) / 10, (event_id % 3) / 10]"


def _evidence():
    return F.array(*[(F.col("event_id") % m) / 10.0 for m in (11, 7, 5, 3)])


def _like_sql(t: float) -> str:
    return f"list_transform([{_EVIDENCE}], lambda v: list_transform([list_transform(v, lambda x: exp((x - list_max(v)) / {t}))], lambda e: list_transform(e, lambda y: y / list_sum(e)))[1])[1]"


@query("b1_softmax_likelihood", f"SELECT event_id, generate_subscripts(l, 1) - 1 AS place, round(unnest(l), 6) AS p FROM (SELECT event_id, {_like_sql(0.379)} AS l FROM events)")
def softmax(s, d):
    return table(s, d, "events").select("event_id", F.posexplode(bayes.softmax(_evidence(), 0.379)).alias("place", "p")).withColumn("p", F.round("p", 6))


_M = "[" + ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in r) + "]" for r in MATRIX) + "]"
_MOVE = "list_transform([1, 2, 3, 4], lambda j: list_sum(list_transform([1, 2, 3, 4], lambda i: prior[i] * m[i][j])))"


@query(
    "b2_b3_b4_b5_b6_filter_replay",
    f"""WITH RECURSIVE {_EV}, mm AS (SELECT {_M} AS m), l AS (SELECT user_id, pos, CASE WHEN event_id % 13 = 0 THEN NULL ELSE {_like_sql(0.379)} END lk FROM ev),
    r AS (SELECT DISTINCT user_id, (-1)::BIGINT pos, [0.25, 0.25, 0.25, 0.25]::DOUBLE[] prior, NULL::DOUBLE[] post FROM ev UNION ALL
     SELECT x.user_id, x.pos, coalesce(x.p, prior), x.p FROM (SELECT l.user_id, l.pos, prior, CASE WHEN lk IS NOT NULL THEN list_transform([{_MOVE}], lambda v: list_transform([1, 2, 3, 4], lambda i: lk[i] * v[i] / list_sum(v)))[1] END p FROM r JOIN l ON l.user_id = r.user_id AND l.pos = r.pos + 1, mm) x),
    z AS (SELECT *, list_sum(post) t FROM r WHERE pos >= 0)
    SELECT user_id, pos, round(coalesce(list_max(post), 0), 6) AS best, round(CASE WHEN post IS NULL THEN 1 ELSE 1 - t END, 6) AS unknown, round(CASE WHEN post IS NULL THEN 1 ELSE list_sum(list_transform(post, lambda x: -(x / t) * ln(x / t + 1e-12))) / ln(4) END, 6) AS entropy FROM z""",
)
def filter_replay(s, d):
    like = F.when(F.col("event_id") % 13 != 0, bayes.softmax(_evidence(), 0.379))
    frames = _ev(s, d).select("user_id", F.col("pos").cast("long").alias("pos"), like.alias("likelihood"))
    rows = bayes.filter_replay(frames, "user_id", "pos", "likelihood", MATRIX).withColumnRenamed("posterior", "post")
    total = F.aggregate("post", F.lit(0.0), lambda a, x: a + x)
    known = F.col("post").isNotNull()
    return rows.select("user_id", "pos", F.round(F.coalesce(F.array_max("post"), F.lit(0.0)), 6).alias("best"), F.round(F.when(known, 1 - total).otherwise(1.0), 6).alias("unknown"), F.round(F.when(known, bayes.entropy(F.col("post"), 4)).otherwise(1.0), 6).alias("entropy"))


NAMES = {0: "Lobby", 2: "Hall"}


def world(goal: int | None = 3, **settings) -> tracker.World:
    """A path of four places, as a tracker's map."""
    hops = {a: {b: abs(a - b) for b in range(4)} for a in range(4)}
    routes = {(a, b): list(range(a, b + 1) if a <= b else range(a, b - 1, -1)) for a in range(4) for b in range(4)}
    return tracker.World(list(range(4)), {i: dict(enumerate(r)) for i, r in enumerate(MATRIX)}, hops, routes, goal, settings, NAMES)


def _masses():
    """A belief as place:millionths."""
    return F.array_join(F.transform(F.array_sort(F.map_entries("posterior")), lambda e: F.concat_ws(":", e["key"].cast("string"), F.round(e["value"] * 1000000).cast("long").cast("string"))), ",")


def tracker_frames(s, d):
    """Frames of users' events: places drift slowly with position, and now and then nothing fits."""
    at = (F.col("pos") / 8).cast("int") % 4
    cand = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.cast("long").alias("place"), F.when(i == at, 0.9).when(F.abs(i - at) == 1, 0.5).otherwise(0.2).alias("visual"), F.lit(0.5).alias("semantic")))
    ranked = F.transform(F.sort_array(F.transform(cand, lambda c: F.struct((-c["visual"]).alias("k"), c.alias("c")))), lambda x: x["c"])
    none = F.array().cast("array<struct<place:bigint,visual:double,semantic:double>>")
    return _ev(s, d).select("user_id", F.col("pos").cast("long").alias("seq"), F.when(F.col("event_id") % 5 == 0, none).otherwise(ranked).alias("candidates"))


_STEP = """
 SELECT *, list_transform([0, 1, 2, 3], lambda i: has AND (mode <> 'LOCAL' OR place IS NULL OR abs(i - place) <= 2)) okl FROM (SELECT r.user_id, r.belief, r.state, r.mode, r.place, r.pending, r.pn, r.weak, r.gn, f.pos npos, f.event_id % 5 <> 0 has, (f.pos // 8) % 4 here FROM r JOIN ev f ON f.user_id = r.user_id AND f.pos = r.pos + 1)"""
_STEP = f"SELECT *, len(list_filter(okl, lambda x: x)) > 0 anyc, list_transform([0, 1, 2, 3], lambda i: CASE WHEN okl[i + 1] THEN (0.5 * CASE WHEN i = here THEN 0.9 WHEN abs(i - here) = 1 THEN 0.5 ELSE 0.2 END + 0.125) / 0.75 END) evd FROM ({_STEP})"
_STEP = f"SELECT *, list_transform(evd, lambda x: coalesce(exp((x - list_max(evd)) / 0.1), 0)) e, coalesce(belief, [0.25, 0.25, 0.25, 0.25]) prior FROM ({_STEP})"
_STEP = f"SELECT *, list_transform([1, 2, 3, 4], lambda i: e[i] / list_sum(e)) lk, {_MOVE} mv FROM ({_STEP}), mm"
_STEP = f"SELECT *, CASE WHEN anyc THEN list_transform([1, 2, 3, 4], lambda i: lk[i] * mv[i] / list_sum(mv)) END post FROM ({_STEP})"
_STEP = f"SELECT *, coalesce(list_max(post), 0) score, list_position(post, list_max(post)) - 1 best, CASE WHEN anyc THEN greatest(0, 1 - list_sum(post)) ELSE 1 END unk, CASE WHEN anyc THEN list_sum(list_transform(list_filter(post, lambda x: x > 0), lambda x: -(x / list_sum(post)) * ln(x / list_sum(post) + 1e-12))) / ln(4) ELSE 1 END ent, coalesce(post, belief) bel FROM ({_STEP})"
_STEP = f"SELECT *, best IS NULL OR coalesce(best = place, false) same, CASE WHEN best IS NULL THEN pending WHEN best = place THEN NULL ELSE best END pend1, CASE WHEN best IS NULL OR coalesce(best = place, false) THEN 0 WHEN pending = best THEN pn + 1 ELSE 1 END pn1 FROM ({_STEP})"
_STEP = f"SELECT *, NOT same AND (score > 0.576 OR pn1 >= 3) chg FROM ({_STEP})"
_STEP = f"SELECT *, CASE WHEN chg THEN best ELSE place END place1, CASE WHEN NOT chg THEN pend1 END pend2, CASE WHEN chg THEN 0 ELSE pn1 END pn2, CASE WHEN chg THEN 0 ELSE weak END weak1, score > 0.426 back, state IN ('LOST', 'REACQUIRING') away FROM ({_STEP})"
_STEP = f"SELECT *, back AND ent < 0.6 AND (pend2 IS NULL OR place1 IS NULL OR coalesce(pend2 = best, false)) good FROM ({_STEP})"
_STEP = f"SELECT *, CASE WHEN away THEN weak1 WHEN good THEN 0 ELSE weak1 + 1 END weak2, NOT away AND NOT good AND weak1 + 1 >= 3 AND (score < 0.126 OR unk > 0.6) lost FROM ({_STEP})"
_STEP = f"SELECT *, CASE WHEN away THEN CASE WHEN back THEN 'TRACKING' ELSE 'REACQUIRING' END WHEN good THEN 'TRACKING' WHEN lost THEN 'LOST' ELSE 'UNCERTAIN' END st, CASE WHEN away AND back OR good AND place1 IS NOT NULL THEN 'LOCAL' WHEN lost OR state = 'REACQUIRING' THEN 'GLOBAL' ELSE mode END md, coalesce(place1, best) rep FROM ({_STEP})"
_STEP = f"SELECT *, coalesce(rep = 3, false) AND st = 'TRACKING' home FROM ({_STEP})"
_STEP = f"SELECT *, CASE WHEN rep IS NULL THEN gn WHEN home THEN gn + 1 ELSE 0 END gn1 FROM ({_STEP})"


_TRACK = f"""WITH RECURSIVE {_EV}, mm AS (SELECT {_M} AS m),
    r AS (SELECT DISTINCT user_id, (-1)::BIGINT pos, NULL::DOUBLE[] belief, 'UNCERTAIN' state, 'GLOBAL' mode, NULL::BIGINT place, NULL::BIGINT pending, 0::BIGINT pn, 0::BIGINT weak, 0::BIGINT gn, NULL::BIGINT rep, 0::DOUBLE score, false chg, false arr, 0::DOUBLE unk, 0::DOUBLE ent, false has, false home, NULL::DOUBLE[] post FROM ev UNION ALL
     SELECT user_id, npos, CASE WHEN NOT lost THEN bel END, st, md, place1, pend2, pn2, weak2, gn1, rep, score, chg, home AND gn1 >= 2, unk, ent, has, home, post FROM ({_STEP})),
    o AS (SELECT *, CASE WHEN arr THEN 'ARRIVED' ELSE state END os FROM r WHERE pos >= 0)"""
#: Beliefs as place:millionths.
_POST = "coalesce(array_to_string(list_transform(list_filter([0, 1, 2, 3], lambda i: post[i + 1] > 0), lambda i: i || ':' || round(post[i + 1] * 1000000)::BIGINT), ','), '')"
_LEVEL = "CASE WHEN unk > 0.4 THEN 'UNKNOWN' WHEN score > 0.526 AND has AND ent < 0.4 THEN 'HIGH' WHEN score < 0.226 OR NOT has THEN 'LOW' ELSE 'MEDIUM' END"


@query(
    "t1_t5_b7_d15_d18_tracker_replay",
    f"""{_TRACK}
    SELECT user_id, pos AS seq, rep AS place_id, CASE rep WHEN 0 THEN 'Lobby' WHEN 2 THEN 'Hall' ELSE coalesce('Place_' || rep, 'Unrecognized') END AS place_name, round(score, 6) AS confidence, chg AS changed, os IN ('UNCERTAIN', 'LOST') AS low_confidence, arr AS arrived, CASE WHEN rep IS NOT NULL AND NOT home THEN array_to_string(range(rep, 4), ',') END AS route, CASE WHEN rep IS NOT NULL AND NOT home THEN array_to_string(['Lobby', 'Place_1', 'Hall', 'Place_3'][rep + 1:], ' -> ') END AS directions, os AS state, mode,
     {_LEVEL} AS confidence_level, round(unk, 6) AS unknown_mass, round(ent, 6) AS entropy, {_POST} AS posterior FROM o""",
)
def tracker_replay(s, d):
    out = tracker.replay(tracker_frames(s, d), "user_id", world(likelihood_temperature=0.1))
    return out.withColumns({"route": F.array_join("route", ","), "posterior": _masses()} | {c: F.round(c, 6) for c in ("confidence", "unknown_mass", "entropy")})


@query("d17_decision_log", f"{_TRACK} SELECT user_id, pos AS seq, os AS state, mode, {_LEVEL} AS confidence_level, round(unk, 6) AS unknown_mass, rep AS place_id, round(score, 6) AS best_score, CASE WHEN has THEN 2 ELSE 0 END AS candidates, {_POST} AS posterior FROM o")
def decision_log(s, d):
    frames = tracker_frames(s, d)
    log = tracker.decision_log(tracker.replay(frames, "user_id", world(likelihood_temperature=0.1)), frames, "user_id", 2)
    return log.withColumns({"candidates": F.size("candidates"), "posterior": _masses(), "unknown_mass": F.round("unknown_mass", 6), "best_score": F.round("best_score", 6)})


@query(
    "t6_legacy_tracker",
    f"WITH {_EV}, a AS (SELECT *, list(event_id % 4) OVER (PARTITION BY user_id, value >= 25 ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) l FROM ev), v AS (SELECT user_id, pos, CASE WHEN value >= 25 THEN l[list_transform([l], lambda s: list_sort(list_transform(list_distinct(s), lambda x: [-len(list_filter(s, lambda y: y = x)), list_position(s, x)]))[1][2])[1]] END vote FROM a) SELECT user_id, pos AS seq, last_value(vote IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos) AS place_id FROM v",
)
def legacy_tracker(s, d):
    frames = _ev(s, d).select("user_id", F.col("pos").cast("long").alias("seq"), (F.col("event_id") % 4).alias("place"), F.col("value").alias("score"))
    return tracker.legacy_replay(frames, "user_id", 25.0)


def gate_frames(s, d):
    a = F.radians((F.col("event_id") % 24) * 15.0)
    return _ev(s, d).select("user_id", F.col("pos").cast("long").alias("seq"), (F.col("pos") * 1.5).alias("ts"), F.array(F.cos(a), F.sin(a)).alias("v"), F.when(F.col("event_id") % 9 == 0, F.array(F.lit("blurry"))).otherwise(F.array().cast("array<string>")).alias("rejects"))


@query(
    "t8_d18_runtime_gate",
    f"""WITH RECURSIVE {_EV}, f AS (SELECT user_id, pos, pos * 1.5 ts, radians((event_id % 24) * 15.0) a FROM ev),
    r AS (SELECT user_id, pos, ts lt, a la, true run, 'novel' reason FROM f WHERE pos = 0 UNION ALL
     SELECT user_id, pos, CASE WHEN run THEN ts ELSE lt END, CASE WHEN run THEN a ELSE la END, run, reason FROM (
      SELECT f.user_id, f.pos, f.ts, f.a, lt, la, f.ts - lt > 5 OR 1 - cos(f.a - la) >= 0.15 run, CASE WHEN f.ts - lt > 5 THEN 'forced_interval' WHEN 1 - cos(f.a - la) < 0.15 THEN 'redundant' ELSE 'novel' END reason FROM r JOIN f ON f.user_id = r.user_id AND f.pos = r.pos + 1))
    SELECT user_id, pos AS seq, run, reason FROM r""",
)
def runtime_gate(s, d):
    return gate.gate(gate_frames(s, d), "user_id")


@query(
    "t7_d19_smart_sampler",
    f"""WITH RECURSIVE {_EV}, f AS (SELECT user_id, pos, pos * 0.25 ts, radians((event_id % 24) * 15.0) a, event_id % 9 = 0 rej FROM ev),
    r AS (SELECT DISTINCT user_id, (-1)::BIGINT pos, NULL::DOUBLE lt, NULL::DOUBLE la, []::DOUBLE[] rec, 0 owed, NULL::VARCHAR decision, NULL::DOUBLE d, '' why FROM ev UNION ALL
     SELECT user_id, pos, CASE WHEN decision = 'keep' THEN ts ELSE lt END, CASE WHEN decision = 'keep' THEN a ELSE la END, rec, owed, decision, d, CASE WHEN drp <> '' THEN drp WHEN sus THEN 'sustained_change' ELSE '' END FROM (
      SELECT *, CASE WHEN drp <> '' THEN 'drop' ELSE 'keep' END decision FROM (
       SELECT *, CASE WHEN rej THEN 'blurry' WHEN d IS NULL OR held OR sus THEN '' WHEN d < 0.15 THEN 'redundant' WHEN ts - lt < 0.5 THEN 'too_frequent' ELSE '' END drp, CASE WHEN sus THEN 2 WHEN rej THEN owed0 ELSE greatest(0, owed0 - 1) END owed FROM (
        SELECT *, NOT rej AND NOT held AND d IS NOT NULL AND len(rec) = 5 AND list_min(rec) > 0.4 sus FROM (
         SELECT user_id, pos, ts, a, rej, lt, la, owed0, owed0 > 0 held, d, CASE WHEN d IS NULL THEN rec0 ELSE list_append(rec0, d)[-5:] END rec FROM (
          SELECT f.*, r.lt, r.la, r.rec rec0, r.owed owed0, CASE WHEN NOT f.rej THEN 1 - cos(f.a - r.la) END d FROM r JOIN f ON f.user_id = r.user_id AND f.pos = r.pos + 1))))))
    SELECT user_id, pos AS seq, decision, round(d, 6) AS distance, why AS reasons FROM r WHERE pos >= 0""",
)
def smart_sampler(s, d):
    frames = gate_frames(s, d).withColumn("ts", F.col("seq") * 0.25)
    return gate.sample(frames, "user_id").withColumns({"distance": F.round("distance", 6), "reasons": F.array_join("reasons", ",")})


@query(
    "w15_e1_reacquisition",
    f"WITH {_EV}, st AS (SELECT user_id, pos, CASE event_id % 5 WHEN 0 THEN 'LOST' WHEN 1 THEN 'TRACKING' END st FROM ev), k AS (SELECT * FROM st WHERE st IS NOT NULL), i AS (SELECT *, CASE WHEN lag(st) OVER (PARTITION BY user_id ORDER BY pos) = st THEN 0 ELSE 1 END nw FROM k), r AS (SELECT user_id, st, sum(nw) OVER (PARTITION BY user_id ORDER BY pos) run, pos FROM i), b AS (SELECT user_id, st, run, min(pos) p FROM r GROUP BY ALL), e AS (SELECT user_id, st, lead(p) OVER (PARTITION BY user_id ORDER BY run) - p AS n FROM b) SELECT user_id, count(n) AS episodes, round(avg(n), 2) AS frames FROM e WHERE st = 'LOST' GROUP BY user_id",
)
def reacquisition(s, d):
    state = F.when(F.col("event_id") % 5 == 0, "LOST").when(F.col("event_id") % 5 == 1, "TRACKING")
    k = _ev(s, d).withColumn("st", state).where("st IS NOT NULL")
    runs = seq.islands(k, ["user_id"], ["pos"], "st").groupBy("user_id", "run", "st").agg(F.min("pos").alias("p"))
    e = runs.select("user_id", "st", (F.lead("p").over(W.partitionBy("user_id").orderBy("run")) - F.col("p")).alias("n")).where("st = 'LOST'")
    return e.groupBy("user_id").agg(F.count("n").alias("episodes"), F.round(F.avg("n"), 2).alias("frames"))


@query("e1_unknown_precision", f"WITH {_EV} SELECT user_id, round(avg((event_id % 4 <> event_id % 3)::INT), 4) AS unknown_precision FROM ev WHERE event_id % 5 IN (0, 2) GROUP BY user_id")
def unknown_precision(s, d):
    flagged = _ev(s, d).where((F.col("event_id") % 5).isin(0, 2))
    return flagged.groupBy("user_id").agg(F.round(F.avg((F.col("event_id") % 4 != F.col("event_id") % 3).cast("int")), 4).alias("unknown_precision"))


_VARIANTS = {"visual": (1.0, 0.0, 0.0, 0.0), "semantic": (0.5, 0.25, 0.0, 0.0), "temporal": (0.5, 0.25, 0.15, 0.0), "graph": (0.5, 0.25, 0.15, 0.1)}


@query(
    "e3_ablation",
    f"WITH {_CAND}, t AS (SELECT k.*, label, CASE WHEN place = label THEN 0.55 ELSE 0.5 END sem, CASE WHEN place = query_id % 10 THEN 1.0 ELSE 0.5 END tmp, CASE WHEN (query_id + place) % 3 = 0 THEN 1.0 ELSE 0.5 END g FROM k JOIN e ON vec_id = query_id), "
    + "v AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS variant, *, (score * {w[0]} + sem * {w[1]} + tmp * {w[2]} + g * {w[3]}) / {sum(w)} total FROM t" for n, w in _VARIANTS.items())
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY total DESC, rank) nr FROM v) SELECT variant, count(*) AS n, round(avg((place = label)::INT), 4) AS top1 FROM r WHERE nr = 1 GROUP BY variant",
)
def ablation(s, d):
    from trailweave.operators import retrieval

    truth = table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    c = _candidates(s, d).join(truth, "query_id")
    sem = F.when(F.col("place") == F.col("label"), 0.55).otherwise(0.5)
    g = F.when((F.col("query_id") + F.col("place")) % 3 == 0, 1.0).otherwise(0.5)
    out = None
    for name, w in _VARIANTS.items():
        top = retrieval.score_terms(c, sem, F.col("query_id") % 10, g, w).where("new_rank = 1")
        row = top.agg(F.lit(name).alias("variant"), F.count("*").alias("n"), F.round(F.avg((F.col("place") == F.col("label")).cast("int")), 4).alias("top1"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "k8_term_breakdown",
    f"WITH {_CAND}, t AS (SELECT *, CASE WHEN place = query_id % 10 THEN 1.0 ELSE 0.5 END tmp FROM k), u AS (SELECT *, score * 0.5 + 0.5 * 0.25 + tmp * 0.15 + 0.5 * 0.1 total FROM t) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, rank) AS rank, place, round(total, 4) AS total, round(score, 4) AS visual_term, 0.5 AS semantic_term, tmp AS temporal_term, 0.5 AS graph_term FROM u) WHERE rank <= 2",
)
def term_breakdown(s, d):
    from trailweave.operators import retrieval

    none = F.lit(None).cast("double")
    top = retrieval.score_terms(_candidates(s, d), none, F.col("query_id") % 10, none).where("new_rank <= 2")
    return top.select("query_id", F.col("new_rank").alias("rank"), "place", F.round("total", 4).alias("total"), F.round("score", 4).alias("visual_term"), "semantic_term", "temporal_term", "graph_term")


def _fresh(s, name):
    return f"{run_dir(s)}/{name}/{uuid.uuid4().hex}"


@query(
    "s7_s8_map_round_trip",
    """SELECT 'place' AS kind, label::VARCHAR AS key, count(*) || ',' || sum(vec_id) AS value FROM embeddings GROUP BY label UNION ALL SELECT 'node', label::VARCHAR, '' FROM embeddings GROUP BY label
    UNION ALL SELECT 'name', label::VARCHAR, CASE WHEN label = 0 THEN 'Lobby' ELSE 'Place_' || label END FROM embeddings GROUP BY label UNION ALL SELECT * FROM (VALUES ('edge', '0-1', '900'), ('edge', '1-2', '700'))
    UNION ALL SELECT 'exemplar', vec_id::VARCHAR, label::VARCHAR FROM embeddings WHERE vec_id % 10 = 0 UNION ALL SELECT 'manifest', 'm', count(DISTINCT label) || ',2,' || count(*) FROM embeddings""",
)
def map_round_trip(s, d):
    path = _fresh(s, "maps")
    obs = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    places = obs.groupBy(F.col("label").alias("place_id")).agg(F.sort_array(F.collect_list("id")).alias("observation_ids"))
    nodes = places.select(F.col("place_id").alias("id"))
    edges = s.sql("SELECT * FROM VALUES (0, 1, 0.9D), (1, 2, 0.7D) AS t(src, dst, confidence)")
    names = s.sql("SELECT 0 AS place_id, 'Lobby' AS name")
    store.write_map(path, places, nodes, edges, obs.where("id % 10 = 0"), names, obs, {"map_id": "m", "encoder": "e"})
    m = store.load_map(s, path)
    total = F.aggregate("observation_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = {
        "place": ("places", F.col("place_id"), F.concat_ws(",", F.size("observation_ids").cast("string"), total.cast("string"))),
        "node": ("nodes", F.col("id"), F.lit("")),
        "name": ("names", F.col("place_id"), F.col("name")),
        "edge": ("edges", F.concat_ws("-", "src", "dst"), F.round(F.col("confidence") * 1000).cast("int").cast("string")),
        "exemplar": ("exemplars", F.col("id"), F.col("label").cast("string")),
        "manifest": ("manifest", F.col("map_id"), F.concat_ws(",", "n_places", "n_edges", "n_observations")),
    }
    return reduce(DataFrame.unionByName, [m[t].select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.alias("value")) for kind, (t, key, value) in parts.items()])


@query("s6_store_round_trip", "SELECT vec_id AS id, 'sixty-four' AS encoder, 64 AS dimension, count(*) OVER () AS n, 'observations' AS missing FROM embeddings")
def store_round_trip(s, d):
    path = _fresh(s, "stores")
    store.save_store(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), path, "sixty-four")
    s.range(1).write.parquet(f"{path}-broken/encoder")
    try:
        missing = store.load_store(s, f"{path}-broken") and ""
    except FileNotFoundError as e:
        missing = str(e).rpartition(" ")[2]
    facts = F.broadcast(s.read.parquet(f"{path}/encoder"))
    return store.load_store(s, path).select("id").crossJoin(facts).select("id", "encoder", "dimension", "n", F.lit(missing).alias("missing"))


@query("s3_append_constraints", "SELECT vec_id AS id, vec_id % 2 AS part, 3 AS refused FROM embeddings")
def append_constraints(s, d):
    """Two parts are appended; a known id, an id that is there twice and a row without a vector are refused, whole."""
    path = _fresh(s, "stores")
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 2).alias("part"), "embedding")
    even, odd = e.where("part = 0"), e.where("part = 1")
    store.append(s, path, even)
    refused = 0
    for bad in (even.limit(1).unionByName(odd), odd.unionByName(odd.limit(1)), odd.withColumn("embedding", F.when(F.col("id") % 3 > 0, F.col("embedding")))):
        try:
            store.append(s, path, bad)
        except ValueError:
            refused += 1
    store.append(s, path, odd)
    return s.read.parquet(path).select("id", "part", F.lit(refused).alias("refused"))


@query("d1_s1_observations_as_json_lines", "SELECT 'o' || event_id AS id, event_id / 4.0 AS ts, '' AS marks, event_type AS scene, event_id % 2 = 0 AS known FROM events")
def json_lines(s, d):
    e = table(s, d, "events").select(F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("id"), (F.col("event_id") / 4.0).alias("ts"), F.when(F.col("event_id") % 2 == 0, F.struct(F.col("event_type").alias("scene_type"))).alias("scene_tags"), F.col("event_type").alias("segment_id"), F.array(F.lit(1.0)).alias("embedding"))
    path = _fresh(s, "lines")
    store.write_jsonl(store.without_vector(e), path)
    back = store.read_jsonl(s, path)
    return back.select("id", "ts", F.array_join("landmarks", ",").alias("marks"), F.coalesce("scene_tags.scene_type", "segment_id").alias("scene"), F.col("scene_tags").isNotNull().alias("known"))


@query("s12_validation_report", f"{_WARN} SELECT '- **' || w.check || '** ' || subject AS line FROM w UNION ALL SELECT w.check || ' ' || subject FROM w")
def validation_report(s, d):
    path = _fresh(s, "reports")
    store.write_report(graph_warnings(s, d), path)
    return s.read.text(f"{path}/markdown").select(F.col("value").alias("line")).unionByName(s.read.schema("check string, subject string").json(f"{path}/json").select(F.concat_ws(" ", "check", "subject").alias("line")))


@query(
    "s16_settings",
    "SELECT * FROM (VALUES ('sound', 'none', 0), ('weight', 'error', 1), ('names', 'error', 5), ('paths', 'error', 1), ('paths', 'warning', 1)) t(settings, level, n)",
)
def settings(s, d):
    good = {"localization": {"w_visual": 0.5, "w_semantic": 0.25}}
    tried = {
        "sound": store.validate_config(good),
        "weight": store.validate_config({"localization": {"w_visual": 1.5}}),
        "names": store.validate_config(good | {"embedding": {"model": "x"}, "perception": {"detector_model": "d", "vlm_model": "big-4", "vlm_quantization": "4bit"}, "mapping": {"exemplar_method": "luck"}}, ("e",), ("f",), ("g",), ("big",)),
        "paths": store.validate_config(good | {"paths": {"video": "no-such.mp4", "map": "no/such/folder/map"}}, root="/"),
    }
    rows = [(name, level, sum(x == level for x, _ in issues)) for name, issues in tried.items() for level in sorted({x for x, _ in issues}) or ["none"]]
    return s.createDataFrame(rows, "settings string, level string, n int")


@query("k9_exemplar_methods", "SELECT * FROM (VALUES ('diversity', true), ('kmeans', true), ('luck', false), ('temporal_diversity', true)) t(method, known)")
def exemplar_methods(s, d):
    e, rows = table(s, d, "embeddings"), []
    for method in ("diversity", "kmeans", "luck", "temporal_diversity"):
        try:
            rows.append((method, places.exemplars(e, "label", ["vec_id"], "vec_id", "embedding", method) is not None))
        except ValueError:
            rows.append((method, False))
    return s.createDataFrame(rows, "method string, known boolean")


def _sizes() -> registry.Encoder:
    return lambda texts: np.array([[len(t), 1.0] for t in texts])


registry.register_encoder("sizes", _sizes)


@query("m5_m6_encoders_and_fallbacks", "SELECT conv_id, turn, round(length(text) / sqrt(length(text) * length(text) + 1), 3) AS x, CASE WHEN length(text) % 2 = 0 THEN length(text) ELSE -1 END AS tag FROM conversations")
def encoders_and_fallbacks(s, d):
    def model(texts: list) -> list:
        if any(len(t) % 2 for t in texts):
            raise ValueError("odd")
        return [len(t) for t in texts]

    e = registry.encode(table(s, d, "conversations").select("conv_id", "turn", "text"), "text", "sizes")
    t = registry.attach(e, "text", model, "int", "tag", -1)
    return t.select("conv_id", "turn", F.round(F.get("embedding", F.lit(0)).cast("double"), 3).alias("x"), "tag")
