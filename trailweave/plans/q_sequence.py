"""Queries of the sequence operators: sessions are users of events, and hundreds of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.operators import sequence as seq
from trailweave.plans.catalog import query, table

_OBS = "obs AS (SELECT vec_id // 100 AS session, vec_id AS id, embedding::DOUBLE[] v, label, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1 AS pos FROM embeddings)"
_SCORES = f"{_OBS}, sc AS (SELECT * FROM (SELECT session, id, pos, 1 - list_dot_product(v, lead(v) OVER (PARTITION BY session ORDER BY pos)) score FROM obs) WHERE score IS NOT NULL)"
_ZONES = f"{_SCORES}, ab AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY session ORDER BY pos) <= 2 THEN 0 ELSE 1 END st FROM sc WHERE score > 1.15), zo AS (SELECT *, sum(st) OVER (PARTITION BY session ORDER BY pos) zone FROM ab)"


def _obs(s, d):
    return table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("session"), F.col("vec_id").alias("id"), "embedding", "label")


@query("w1_change_scores", f"WITH {_SCORES} SELECT session, id, pos, round(score, 6) AS score FROM sc")
def change_scores(s, d):
    return seq.change_scores(_obs(s, d), ["session"], ["id"]).select("session", "id", "pos", F.round("score", 6).alias("score"))


_EV = "ev AS (SELECT user_id, event_id, ts, event_type, value, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE event_type END scene, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"


def _ev(s, d):
    e = table(s, d, "events")
    return e.select("user_id", "event_id", "ts", "event_type", "value", (F.col("ts").cast("timestamp").cast("double")).alias("sec"))


@query(
    "w2_w3_semantic_change_persistence",
    f"""WITH {_EV}, t AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN [] ELSE [event_type, 'm' || (event_id % 2)] END m FROM ev),
    n AS (SELECT *, lead(scene) OVER w ns, lead(m) OVER w nm, lead(event_id) OVER w ne, list(scene) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) later FROM t WINDOW w AS (PARTITION BY user_id ORDER BY pos))
    SELECT event_id, round(0.5 + CASE WHEN len(list_filter(coalesce(later, []), lambda x: x <> ns)) = 0 AND ((scene <> 'unknown' AND ns <> 'unknown' AND scene <> ns) OR (len(m) > 0 AND len(nm) > 0 AND len(list_intersect(m, nm)) / len(list_distinct(list_concat(m, nm))) < 0.5)) THEN 0.5 ELSE 0 END, 6) AS score FROM n WHERE ne IS NOT NULL""",
)
def semantic_change(s, d):
    scene = F.when(F.col("event_id") % 3 == 0, "unknown").otherwise(F.col("event_type"))
    m = F.when(F.col("event_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type", F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string"))))
    e = _ev(s, d).withColumns({"scene": scene, "m": m, "v": F.lit(None).cast("array<float>")})
    return seq.change_scores(e, ["user_id"], ["ts", "event_id"], "v", "scene", "m").select("event_id", F.round("score", 6).alias("score"))


@query("w4_adaptive_threshold", f"WITH {_SCORES} SELECT session, round(CASE WHEN stddev_pop(score) < 1e-9 THEN 1 ELSE least(greatest(avg(score) + 2.5 * stddev_pop(score), 0.08), 0.5) END, 6) AS threshold FROM sc GROUP BY session")
def threshold(s, d):
    return seq.adaptive_threshold(seq.change_scores(_obs(s, d), ["session"], ["id"]), ["session"]).select("session", F.round("threshold", 6).alias("threshold"))


@query("w5_w6_zone_cuts", f"WITH {_ZONES} SELECT session, zone::BIGINT AS zone, arg_max(pos, {{'s': score, 'p': -pos}}) + 1 AS cut, round(max(score), 6) AS peak, count(*) AS n_rows FROM zo GROUP BY session, zone")
def zone_cuts(s, d):
    return seq.zone_cuts(seq.change_scores(_obs(s, d), ["session"], ["id"]), ["session"], 1.15).select("session", "zone", "cut", F.round("peak", 6).alias("peak"), "n_rows")


@query(
    "w7_segments",
    f"""WITH RECURSIVE {_ZONES}, cuts AS (SELECT session, arg_max(pos, {{'s': score, 'p': -pos}}) + 1 AS cut FROM zo GROUP BY session, zone),
    b AS (SELECT session, cut AS x FROM cuts UNION SELECT session, 0 FROM obs UNION SELECT session, count(*) FROM obs GROUP BY session),
    r AS (SELECT * FROM (SELECT session, x AS lo, lead(x) OVER (PARTITION BY session ORDER BY x) AS hi, row_number() OVER (PARTITION BY session ORDER BY x) AS i FROM b) WHERE hi IS NOT NULL),
    f AS (SELECT session, i, [{{'lo': lo, 'hi': hi}}] AS acc FROM r WHERE i = 1 UNION ALL
      SELECT f.session, r.i, CASE WHEN r.hi - r.lo < 3 OR f.acc[-1].hi - f.acc[-1].lo < 3 THEN list_append(f.acc[:-2], {{'lo': f.acc[-1].lo, 'hi': r.hi}}) ELSE list_append(f.acc, {{'lo': r.lo, 'hi': r.hi}}) END FROM f JOIN r ON r.session = f.session AND r.i = f.i + 1),
    l AS (SELECT session, arg_max(acc, i) AS acc FROM f GROUP BY session)
    SELECT session, generate_subscripts(acc, 1) - 1 AS seg, unnest(acc).lo AS lo, unnest(acc).hi AS hi FROM l""",
)
def segments(s, d):
    return seq.segments(_obs(s, d), ["session"], ["id"], threshold=1.15)


_MODE = "list_transform([{}], lambda s: list_sort(list_transform(list_distinct(s), lambda x: [-len(list_filter(s, lambda y: y = x)), list_position(s, x)]))[1][2])[1]"


@query("w8_scene_debounce", f"WITH {_EV}, w AS (SELECT user_id, event_id, scene, list(scene) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM ev) SELECT event_id, l[{_MODE.format('l')}] AS smooth FROM w")
def scene_debounce(s, d):
    e = _ev(s, d).withColumn("scene", F.when(F.col("event_id") % 3 == 0, "unknown").otherwise(F.col("event_type")))
    return seq.debounce_labels(e, ["user_id"], ["ts", "event_id"], "scene").select("event_id", "smooth")


@query("w11_majority_vote", f"WITH {_EV}, w AS (SELECT event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM ev) SELECT event_id, l[{_MODE.format('l')}] AS vote FROM w")
def majority_vote(s, d):
    return seq.majority_vote(_ev(s, d), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "vote")


_RUNS = """{ev}, i1 AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) = event_type THEN 0 ELSE 1 END nw FROM ev), r1 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY pos) run FROM i1),
 k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS run_length FROM r1) WHERE run_length >= 2),
 i2 AS (SELECT user_id, pos, ts, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) = event_type THEN 0 ELSE 1 END nw FROM k), r2 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY pos) run FROM i2),
 s AS (SELECT user_id, run, event_type, min(epoch_us(ts) / 1e6) began, count(*) n FROM r2 GROUP BY ALL),
 h AS (SELECT event_type src, lead(event_type) OVER (PARTITION BY user_id ORDER BY run) dst, lead(began) OVER (PARTITION BY user_id ORDER BY run) - began AS dur FROM s)""".replace("{ev}", _EV)


@query("w9_debounced_rows", f"WITH {_RUNS} SELECT user_id, event_id, run_length FROM k")
def debounced(s, d):
    return seq.debounced(_ev(s, d), ["user_id"], ["ts", "event_id"], "event_type", 2).select("user_id", "event_id", "run_length")


@query("w10_surviving_runs", f"WITH {_RUNS} SELECT user_id, run::BIGINT AS run, event_type, round(began, 3) AS began, n FROM s")
def surviving_runs(s, d):
    return seq.surviving_runs(_ev(s, d), ["user_id"], ["ts", "event_id"], "event_type", "sec", 2).select("user_id", "run", "event_type", F.round("began", 3).alias("began"), "n")


_TR = f"{_RUNS}, t AS (SELECT src, dst, count(*) n, avg(dur) mean_duration FROM h WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL), c AS (SELECT event_type, count(*) n FROM events GROUP BY 1)"


@query("a9_d8_transitions", f"WITH {_TR} SELECT src, dst, t.n AS n, round(mean_duration, 3) AS mean_duration, a.n + b.n AS support, round(least(1, t.n / 500) * 0.9 + 0.1, 3) AS confidence FROM t JOIN c a ON a.event_type = src JOIN c b ON b.event_type = dst")
def transitions(s, d):
    return seq.transitions(_ev(s, d), ["user_id"], ["ts", "event_id"], "event_type", "sec", 2, 500).withColumn("mean_duration", F.round("mean_duration", 3))


@query("a11_j11_raw_transitions", f"WITH {_EV}, p AS (SELECT event_type a, lead(event_type) OVER (PARTITION BY user_id ORDER BY pos) b FROM ev) SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n FROM p WHERE b IS NOT NULL AND a <> b GROUP BY ALL")
def raw_transitions(s, d):
    return seq.raw_transition_counts(_ev(s, d), ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "w13_run_accuracy",
    f"WITH {_EV}, i AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) = event_type THEN 0 ELSE 1 END nw FROM ev), r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY pos) run FROM i), a AS (SELECT user_id, run, avg((value > 50)::INT) acc FROM r GROUP BY ALL) SELECT user_id, count(*) AS runs, round(avg(acc), 6) AS segment_accuracy FROM a GROUP BY user_id",
)
def run_accuracy(s, d):
    r = seq.islands(_ev(s, d), ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "run").agg(F.avg((F.col("value") > 50).cast("int")).alias("acc"))
    return r.groupBy("user_id").agg(F.count("*").alias("runs"), F.round(F.avg("acc"), 6).alias("segment_accuracy"))


@query("w16_temporal_split", f"WITH {_EV} SELECT user_id, event_id, pos + 1 <= floor(0.8 * count(*) OVER (PARTITION BY user_id)) AS train FROM ev")
def temporal_split(s, d):
    return seq.temporal_split(_ev(s, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "train")


@query("j12_near_positions", f"WITH {_EV} SELECT event_id FROM ev a WHERE event_type = (SELECT min(event_type) FROM events) AND EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.event_type = (SELECT max(event_type) FROM events) AND abs(a.pos - b.pos) <= 3)")
def near_positions(s, d):
    from pyspark.sql import Window as W

    e = _ev(s, d).withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    ends = table(s, d, "events").agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    a, b = (e.join(F.broadcast(ends), F.col("event_type") == F.col(x)).select("user_id", "event_id", "pos") for x in ("lo", "hi"))
    return seq.near_positions(a, b, ["user_id"], "pos", 3).select("event_id")


@query("w9_conversation_turns", "WITH r AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END nw FROM conversations), s AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn) run FROM r) SELECT conv_id, max(run)::BIGINT AS runs, count(*) AS turns FROM s GROUP BY conv_id")
def conversation_turns(s, d):
    r = seq.islands(table(s, d, "conversations"), ["conv_id"], ["turn"], "role")
    return r.groupBy("conv_id").agg(F.max("run").alias("runs"), F.count("*").alias("turns"))
