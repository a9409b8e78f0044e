"""Scenarios with known outcomes: segments, debouncing, merges, tracking, gates."""

import math
import time

import pytest
from pyspark.sql import functions as F

from trailweave.functions import evidence as ev
from trailweave.functions import registry, text
from trailweave.operators import graph, places, reconcile, sequence as seq
from trailweave.sources import store
from trailweave.streaming import gate, tracker
from trailweave.streaming.filter import belief_entropy, belief_step, likelihoods

A, B = [1.0, 0.0], [0.0, 1.0]


def obs(spark, plan):
    rows = [("s", float(i), f"o{i:03d}", v, sc, []) for i, (v, sc) in enumerate(plan)]
    return spark.createDataFrame(rows, "session string, ts double, id string, embedding array<double>, scene string, marks array<string>")


def cut(spark, plan, **kw):
    kw = {"scene": "scene", "marks": "marks"} | kw
    return [(r.lo, r.hi) for r in seq.segments(obs(spark, plan), ["session"], ["ts", "id"], **kw).orderBy("seg").collect()]


def test_segments_of_clean_splits(spark):
    assert cut(spark, [(A, "room")] * 10 + [(B, "corridor")] * 10) == [(0, 10), (10, 20)]
    assert cut(spark, [(A, "room")] * 10 + [(B, "room")] * 10 + [(A, "room")] * 10) == [(0, 10), (10, 20), (20, 30)]


def test_segments_by_scene_alone_and_short_first(spark):
    assert len(cut(spark, [(A, "corridor")] * 5 + [(A, "room")] * 5, threshold=0.35)) == 2
    assert cut(spark, [(B, "room")] * 2 + [(A, "room")] * 8, least=3) == [(0, 10)]


def test_unknown_scene_is_no_change(spark):
    got = seq.change_scores(obs(spark, [(A, "corridor")] * 4 + [(A, "unknown")] * 4), ["session"], ["ts", "id"], scene="scene", marks="marks")
    assert [r.score for r in got.collect()] == [0.0] * 7


def hops(spark, s, ts=None):
    rows = [("s", i, x, float(ts[i] if ts else i)) for i, x in enumerate(s)]
    return spark.createDataFrame(rows, "k string, pos int, place string, ts double")


def trans(spark, s, persistence=3, support=3, ts=None):
    t = seq.transitions(hops(spark, s, ts), ["k"], ["pos"], "place", "ts", persistence, support)
    return {(r.src, r.dst): r for r in t.collect()}


def test_transitions(spark):
    assert {k: v.n for k, v in trans(spark, "AAAABBBBCCCC").items()} == {("A", "B"): 1, ("B", "C"): 1}
    assert trans(spark, "ABABAB") == {}
    assert set(trans(spark, "AAABAAA")) == set()
    assert set(trans(spark, "AAABBBAAA")) == {("A", "B"), ("B", "A")}
    assert trans(spark, "AAABBB", ts=[0, 0.5, 1, 2, 2.5, 3])["A", "B"].mean_duration == 2.0
    assert trans(spark, "AAABBB")["A", "B"].confidence == pytest.approx(0.4)


def test_debounced_scenes(spark):
    labels = ["corridor", "corridor", "room", "corridor", "corridor", "unknown", "corridor"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(labels)], "k string, pos int, scene string")
    assert [r.smooth for r in seq.debounce_labels(df, ["k"], ["pos"], "scene").orderBy("pos").collect()] == ["corridor"] * 7


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def test_overlaps(spark):
    assert one(spark, ev.jaccard_strict(arr("a", "b"), arr("a", "b", "c"))) == pytest.approx(2 / 3)
    assert one(spark, ev.jaccard_strict(arr(), arr())) == 0.0 and one(spark, ev.jaccard_open(arr(), arr("a"))) == 1.0
    assert one(spark, ev.jaccard_floored(arr(), arr("a"))) == 0.5 and one(spark, ev.jaccard_floored(arr("z"), arr("a"))) == 0.1
    sim = ev.semantic_similarity(F.lit("room"), arr("desk"), arr(), F.lit("room"), arr("desk"), arr("x"))
    assert one(spark, sim) == pytest.approx(0.9)


def test_confidence_levels(spark):
    old = {"high_score": 0.6, "low_score": 0.3}
    level = lambda s, m, u=0.0: one(spark, ev.confidence_level(F.lit(s), F.lit(m), F.lit(0.1), F.lit(u), old))
    assert [level(0.8, 0.3), level(0.2, 0.3), level(0.5, 0.01), level(0.5, 0.1), level(0.9, 0.9, 0.6)] == ["HIGH", "LOW", "LOW", "MEDIUM", "UNKNOWN"]


def test_model_text(spark):
    raw = '{"scene_type": "room", "landmarks": ["desk", "blue sign", "teleporter"], "walkable": ["left", "left", "up"]}'
    t = one(spark, text.parse_tags(F.lit(raw)))
    assert (t.scene_type, t.landmarks, t.walkable) == ("room", ["desk"], ["left"])
    for bad in ("", "{", "nope", "[]", '{"scene_type": 3}'):
        assert one(spark, text.parse_tags(F.lit(bad))).scene_type == "unknown"
    assert one(spark, text.parse_tags(F.lit('{"scene_type": "corridor_junction"}'))).scene_type == "junction"


def test_model_text_is_held_to_the_vocabulary_case_and_all(spark):
    t = one(spark, text.parse_tags(F.lit('{"scene_type": "ROOM", "landmarks": ["Desk", " desk\u00a0"], "walkable": ["LEFT"], "description": " see ```json here "}')))
    assert (t.scene_type, t.landmarks, t.walkable, t.description) == ("unknown", ["desk"], [], " see ```json here ")
    t = one(spark, text.parse_tags(F.lit('```json\n{"scene_type": "room", "sign_text": ["```", "B"]}\n```')))
    assert (t.scene_type, t.sign_text) == ("room", ["```", "B"])
    assert one(spark, text.parse_tags(F.lit('{"scene_type": " room "}'))).scene_type == "unknown"


def test_exemplars(spark):
    df = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(7)], "p int, i int, v array<double>")
    assert [r.id for r in places.exemplars(df, "p", ["i"], "i", "v").orderBy("rank").collect()] == [0, 6, 3]
    assert places.exemplars(df, "p", ["i"], "i", "v", "kmeans", 3).count() == 3
    assert places.exemplars(df, "p", ["i"], "i", "v", "temporal_diversity", 5).count() == 5
    with pytest.raises(ValueError):
        places.exemplars(df, "p", ["i"], "i", "v", "best")
    assert one(spark, places.evenly_spaced(F.array(*map(F.lit, range(6))), 3)) == [0, 2, 5]


def test_exemplars_of_odd_places(spark):
    """Null places, places with fewer rows than exemplars, equal rows, rows without a vector, more than three."""
    rows = [("a", i, [math.cos(i / 3), math.sin(i / 3)]) for i in range(9)] + [(None, 1, [1.0, 0.0]), (None, 2, [0.0, 1.0]), ("one", 1, [1.0, 0.0]), ("same", 1, [1.0, 0.0]), ("same", 2, [1.0, 0.0]), ("a", 99, None)]
    df = spark.createDataFrame(rows, "p string, i int, v array<double>")
    of = lambda method, most: {p: [r.id for r in sorted(x, key=lambda r: r["rank"])] for p, x in groups(places.exemplars(df, "p", ["i"], "i", "v", method, most).collect())}

    def groups(rs):
        return [(p, [r for r in rs if r.p == p]) for p in {r.p for r in rs}]

    far = of("diversity", 4)
    assert far == {"a": [0, 8, 4, 2], None: [1, 2], "one": [1], "same": [1, 1]}
    assert of("temporal_diversity", 5)["a"][:3] == [0, 99, 5] and len(of("temporal_diversity", 5)["a"]) == 5
    k = of("kmeans", 3)
    assert len(k["a"]) == 3 and k["one"] == [1] and sorted(k[None]) == [1, 2]
    assert of("kmeans", 1)["a"] == [4] and of("kmeans", 1)["same"] == [2]


def test_merge_decisions(spark):
    cols = "vis double, order_gap int, scene_a string, scene_b string, marks_a array<string>, marks_b array<string>, signs_a array<string>, signs_b array<string>"
    cfg = {"visual": 0.75, "extra": 0.92}
    rows = [
        (0.8, 2, "room", "room", ["desk"], ["desk"], [], []),
        (0.8, 2, "room", "room", [], [], [], []),
        (0.93, 2, "room", "room", [], [], [], []),
        (0.99, 2, "room", "corridor", [], [], [], []),
        (0.99, 2, "room", "room", ["desk"], ["stairs"], [], []),
        (0.93, 2, "corridor", "junction", ["door"], ["door"], [], []),
        (0.96, 2, "corridor", "corridor", ["door"], ["door"], [], []),
        (0.93, 2, "corridor", "corridor", [], [], ["room 1"], ["room 1"]),
    ]
    got = [r.merged for r in reconcile.merge_decisions(spark.createDataFrame(rows, cols), cfg).collect()]
    assert got == [True, False, True, False, False, False, True, True]


def test_merge_decisions_in_columns_and_in_memory_are_one_rule(spark):
    import random
    from collections import Counter

    rnd, rows, want = random.Random(13), [], []
    scenes, marks = ["room", "corridor", "junction", "corridor_junction", "unknown", "lobby"], ["door", "desk", "stairs", "room_sign", "other"]
    for i in range(600):
        side = lambda: {"scenes": Counter([rnd.choice(scenes)]), "marks": rnd.sample(marks, rnd.choice([0, 0, 1, 2])), "signs": rnd.sample(["a 1", "b 2"], rnd.choice([0, 0, 1]))}
        a, b, vis = side(), side(), rnd.choice([0.2, 0.274, 0.275, 0.3, 0.424, 0.425, 0.6, 0.835, 0.9, 0.95, 0.99])
        cfg = {"scene_required": i % 3 > 0}
        rows.append((i, cfg["scene_required"], vis, rnd.randint(1, 3), *[x for p in (a, b) for x in (next(iter(p["scenes"])), p["marks"], p["signs"])]))
        want.append(reconcile._same(a, b, vis, reconcile.DEFAULTS | cfg))
    df = spark.createDataFrame(rows, "i int, req boolean, vis double, order_gap int, scene_a string, marks_a array<string>, signs_a array<string>, scene_b string, marks_b array<string>, signs_b array<string>")
    got = {r.i: r.merged for req in (True, False) for r in reconcile.merge_decisions(df.where(F.col("req") == req), {"scene_required": req}).collect()}
    assert [got[i] for i in range(600)] == want and 40 < sum(want) < 560


def test_reconcile_joins_revisits(spark):
    p = [("m", i, [i], [i], ["room"], [], []) for i in range(3)]
    df = spark.createDataFrame(p, "m string, place_id int, observation_ids array<int>, exemplar_ids array<int>, scenes array<string>, marks array<string>, signs array<string>")
    x = spark.createDataFrame([("m", 0, A), ("m", 1, B), ("m", 2, A)], "m string, id int, v array<double>")
    got = {r.place_id: sorted(r.observation_ids) for r in reconcile.reconcile(df, x, "m", {"visual": 0.75, "extra": 0.92}).collect()}
    assert got == {0: [0, 2], 1: [1]}


def test_reconcile_is_the_sweep_over_all_pairs(spark):
    """Against the plain sweep, on places with and without vectors and evidence, scenes that turn, and several maps."""
    import random
    from collections import Counter

    rnd, cfg = random.Random(5), {"visual": 0.5, "extra": 0.7, "exact": 0.9}
    common = lambda xs: [x for x, _ in Counter(xs).most_common(8)]
    vectors = {(m, i): [rnd.gauss(0, 1) for _ in range(3)] for m in "ab" for i in range(160)}
    vectors = {k: [x / sum(y * y for y in v) ** 0.5 for x in v] for k, v in vectors.items() if k[1] % 11}
    scenes, marks = ["room", "room", "lobby", "corridor", "corridor_junction", "unknown"], ["door", "desk", "stairs", "room_sign", "plant"]
    p = [(m, i, [9 * i, 9 * i + 1], rnd.sample(range(2 * i, 2 * i + 2), rnd.choice([1, 2, 2])), rnd.choices(scenes, k=rnd.choice([0, 1, 3])), rnd.sample(marks, rnd.choice([0, 1, 2])), rnd.sample(["a 1", "b 2"], rnd.choice([0, 0, 1]))) for m in "ab" for i in range(80)]
    names = ("m", "place_id", "observation_ids", "exemplar_ids", "scenes", "marks", "signs")
    want, merges = [], 0
    for m in "ab":
        todo = [dict(zip(names, r)) | {"scenes": Counter(r[4]), "n": 1} for r in p if r[0] == m]
        for _ in range(10):
            before, kept = len(todo), []
            while todo:
                head, *todo = todo
                while True:
                    vis = lambda q: max((sum(x * y for x, y in zip(vectors[m, i], vectors[m, j])) for i in head["exemplar_ids"] for j in q["exemplar_ids"] if (m, i) in vectors and (m, j) in vectors), default=0.0)  # noqa: B023, E731
                    at = next((k for k, q in enumerate(todo) if reconcile._same(head, q, vis(q), reconcile.DEFAULTS | cfg)), None)
                    if at is None:
                        break
                    q, merges = todo.pop(at), merges + 1
                    ex = head["exemplar_ids"] + q["exemplar_ids"]
                    ex = ex if len(ex) <= 3 else [ex[0], ex[{4: 2, 5: 2, 6: 2}[len(ex)]], ex[-1]]
                    head = {"place_id": min(head["place_id"], q["place_id"]), "observation_ids": sorted(head["observation_ids"] + q["observation_ids"]), "exemplar_ids": ex, "scenes": head["scenes"] + q["scenes"], "marks": common(head["marks"] + q["marks"]), "signs": common(head["signs"] + q["signs"]), "n": head["n"] + q["n"]}
                kept.append(head)
            todo = kept
            if len(todo) == before:
                break
        want += [(m, *[q[k] for k in ("place_id", "observation_ids", "exemplar_ids", "marks", "signs", "n")]) for q in todo]
    schema = "m string, place_id int, observation_ids array<int>, exemplar_ids array<int>, scenes array<string>, marks array<string>, signs array<string>"
    x = spark.createDataFrame([(m, i, v) for (m, i), v in vectors.items()], "m string, id int, v array<double>")
    got = [tuple(r) for r in reconcile.reconcile(spark.createDataFrame(p, schema), x, "m", cfg).collect()]
    assert sorted(got) == sorted(want) and merges > 60


def test_reconcile_takes_long_maps(spark):
    """4,000 places, each seen twice: nearly all pairs are held against each other, in seconds and not minutes."""
    import random

    rnd, n = random.Random(3), 2000
    views = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(n)]
    views = [[x / sum(y * y for y in v) ** 0.5 for x in v] for v in views]
    df = spark.range(2 * n).selectExpr("'m' AS m", "id AS place_id", "array(id) AS observation_ids", "array(id) AS exemplar_ids", "array('room') AS scenes", "cast(array() AS array<string>) AS marks", "cast(array() AS array<string>) AS signs")
    x = spark.createDataFrame([("m", i, views[i % n]) for i in range(2 * n)], "m string, id long, v array<double>")
    t = time.perf_counter()
    got = {r.place_id: (r.observation_ids, r.merged_from) for r in reconcile.reconcile(df, x, "m", {"extra": 0.999}).collect()}
    assert got == {i: ([i, i + n], 2) for i in range(n)} and time.perf_counter() - t < 20


def test_graph(spark):
    e = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (2, 3, 0.9), (1, 4, 0.9)], "src long, dst long, confidence double")
    n = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 99)], "id long")
    p = {r.dst: r.path for r in graph.shortest_paths(e, F.lit(4).cast("long"), 6).collect()}
    assert p[3] == [4, 1, 2, 3] and 99 not in p
    assert {r.id: r.component for r in graph.components(n, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 99: 99}
    near = lambda k: {r.dst for r in graph.hops(e, k, n.where("id = 1")).collect()}
    assert near(1) == {0, 1, 2, 4} and near(2) == {0, 1, 2, 3, 4}
    rows = graph.transition_prior(n, e, 0.7, 0.02).groupBy("src").agg(F.sum("p").alias("p")).collect()
    assert all(r.p == pytest.approx(1.0) for r in rows)


OLD = {
    "likelihood_temperature": 0.1, "tracking_threshold": 0.5, "tracking_entropy": 0.6, "lost_after": 3, "lost_threshold": 0.2, "lost_unknown_mass": 0.6,
    "reacquired_threshold": 0.5, "arrived_confirmations": 2, "transition_confirmation_count": 3, "transition_threshold": 0.65, "high_score": 0.6, "low_score": 0.3,
}
EX = [(0, [1, 0, 0, 0]), (1, [0, 1, 0, 0]), (1, [0, 0.9, 0.44, 0]), (2, [0, 0, 1, 0])]
V = {"0": [1, 0, 0, 0], "1": [0, 1, 0, 0], "2": [0, 0, 1, 0], "w": [0.1, 0.1, 0.1, 0.97]}
SCENES = {0: "room", 1: "corridor", 2: "room"}


def toy(**more):
    prior = {0: {0: 0.7, 1: 0.25, 2: 0.05}, 1: {1: 0.7, 0: 0.15, 2: 0.15}, 2: {2: 0.7, 1: 0.25, 0: 0.05}}
    hops = {a: {b: abs(a - b) for b in range(3)} for a in range(3)}
    routes = {(a, b): list(range(a, b + 1)) for a in range(3) for b in range(a, 3)}
    return tracker.World([0, 1, 2], prior, hops, routes, 2, OLD | more)


def frame(c):
    best = {}
    for p, x in EX:
        best[p] = max(best.get(p, -9.0), sum(a * b for a, b in zip(x, V[c])))
    return sorted(((p, s, 0.5) for p, s in best.items()), key=lambda t: -t[1])


def run(plan, world):
    t, out = tracker.Track(), []
    for c in plan:
        t, status = tracker.step(t, frame(c), world)
        out.append(status)
    return out


def test_tracker_converges():
    last = run("0000", toy())[-1]
    assert (last["state"], last["place_id"], last["route"]) == ("TRACKING", 0, [0, 1, 2])


def test_tracker_gets_lost_and_back():
    out = run("0000" + "www" + "w" + "22222", toy())
    assert (out[6]["state"], out[6]["mode"], out[6]["place_id"]) == ("LOST", "GLOBAL", 0)
    assert out[7]["state"] == "REACQUIRING"
    assert out[-1]["state"] in ("TRACKING", "ARRIVED") and out[-1]["place_id"] == 2


def test_tracker_confirms_changes():
    assert [o["changed"] for o in run("000011", toy())[4:]] == [False, True]
    assert [o["changed"] for o in run("0000111", toy(transition_threshold=0.95))[4:]] == [False, False, True]
    assert not any(o["changed"] for o in run("0000101010", toy())[4:])


def test_a_belief_that_came_to_nothing_stays_so_until_lost():
    w = tracker.World([0, 1], {0: {0: 0.8, 1: 0.2}, 1: {1: 0.8, 0: 0.2}}, {0: {0: 0, 1: 1}, 1: {0: 1, 1: 0}}, names={0: "Lobby"})
    known, other = [(0, 0.9, 0.5), (1, 0.2, 0.5)], [(7, 0.9, 0.5)]
    t, out = tracker.Track(), []
    for c in (known, other, known, known):
        t, status = tracker.step(t, c, w)
        out.append(status)
    assert out[0]["confidence"] > 0 and out[0]["place_name"] == "Lobby" and out[0]["posterior"]
    assert [o["confidence"] for o in out[1:3]] == [0, 0] and out[2]["posterior"] == {}
    # The third weak frame in a row is lost; then it begins anew.
    assert out[2]["state"] == "LOST" and out[3]["confidence"] > 0


def test_status_names_and_directions():
    w = toy()
    w.names = {0: "Lobby", 2: "Hall"}
    last = run("0000", w)[-1]
    assert (last["place_name"], last["directions"]) == ("Lobby", "Lobby -> Place_1 -> Hall")
    assert tracker.step(tracker.Track(), [], w)[1]["place_name"] == "Unrecognized"


def test_dense_replay_equals_sparse_steps(spark):
    from trailweave.streaming.filter import filter_replay

    m = [[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]]
    likes = [[0.5, 0.3, 0.2], None, [0.0, 0.0, 1.0], [], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [1.0, 0.0, 0.0]]
    rows = [(k, i, x) for k in ("a", "b") for i, x in enumerate(likes if k == "a" else likes[::-1])]
    got = {(r.k, r.i): r.posterior for r in filter_replay(spark.createDataFrame(rows, "k string, i int, l array<double>"), "k", "i", "l", m).collect()}
    assert len(got) == len(rows)
    for k, seen in (("a", likes), ("b", likes[::-1])):
        belief = {i: 1 / 3 for i in range(3)}
        for i, x in enumerate(seen):
            if not x:
                assert got[k, i] is None
                continue
            belief = belief_step(belief, dict(enumerate(x)), {a: dict(enumerate(r)) for a, r in enumerate(m)})
            assert got[k, i] == pytest.approx([belief.get(j, 0.0) for j in range(3)])


def test_beliefs():
    like = likelihoods({0: 0.9, 1: 0.1}, 0.1)
    assert sum(like.values()) == pytest.approx(1) and likelihoods({0: 1, 1: 0}, 0)[0] == pytest.approx(1)
    post = belief_step({0: 0.5, 1: 0.5}, like, {0: {0: 1.0}, 1: {1: 1.0}})
    assert post[0] > post[1] and sum(post.values()) < 1
    assert belief_entropy({}, 3) == 1.0 and belief_entropy({0: 1.0}, 1) == 0.0 and 0 <= belief_entropy(post, 2) <= 1


def test_replay_equals_stream(spark, sf_dir, tmp_path):
    from trailweave.plans.q_filter import gate_frames, tracker_frames, world

    for name, frames, batch, stream in (
        ("tracker", tracker_frames(spark, sf_dir), lambda f: tracker.replay(f, "user_id", world()), lambda f: tracker.track_stream(f, "user_id", world())),
        ("gate", gate_frames(spark, sf_dir), lambda f: gate.gate(f, "user_id"), lambda f: gate.gate_stream(f, "user_id")),
    ):
        path = str(tmp_path / name)
        frames.where("user_id % 3 = 0").write.parquet(f"{path}/in")
        src = spark.readStream.schema(frames.schema).parquet(f"{path}/in")
        q = stream(src).writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", f"{path}/cp").start()
        q.processAllAvailable()
        q.stop()
        got = {(r.user_id, r.seq): r for r in spark.sql(f"SELECT * FROM out_{name}").collect()}
        want = {(r.user_id, r.seq): r for r in batch(spark.read.parquet(f"{path}/in")).collect()}
        assert got == want and got


def test_gate_decisions():
    import numpy as np

    a, b = np.array(A), np.array(B)
    assert gate.gate_step(None, 0.0, a, 0.15, 5.0) == (True, "novel")
    assert gate.gate_step((0.0, a), 1.0, a, 0.15, 5.0) == (False, "redundant")
    assert gate.gate_step((0.0, a), 1.0, b, 0.15, 5.0) == (True, "novel")
    assert gate.gate_step((0.0, a), 5.1, a, 0.15, 5.0) == (True, "forced_interval")
    assert gate.gate_step((0.0, a), 9.0, None, 0.15, 5.0) == (True, "novel")


def test_sampler():
    import pandas as pd

    v = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    rows = [(0, 0.0, v(0), []), (1, 1.0, v(5), []), (2, 1.2, v(90), ["blurry"]), (3, 1.3, v(90), []), (4, 1.4, v(180), []), (5, 2.0, v(180), [])]
    memory, out = gate.NO_SAMPLES, []
    for row in pd.DataFrame(rows, columns=["seq", "ts", "v", "rejects"]).itertuples():
        memory, values = gate.sample_step(memory, row, gate.SAMPLING)
        out.append(values)
    out = pd.DataFrame(out, columns=["seq", "decision", "distance", "reasons"])
    assert out["decision"].tolist() == ["keep", "drop", "drop", "keep", "drop", "keep"]
    assert out["reasons"].tolist() == [[], ["redundant"], ["blurry"], [], ["too_frequent"], []]


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.0, [1.0]), ("b", 1.0, [2.0])], "id string, ts double, embedding array<double>")
    path = str(tmp_path / "s")
    store.append(spark, path, df)
    with pytest.raises(ValueError):
        store.append(spark, path, df)
    with pytest.raises(ValueError):
        store.append(spark, path, spark.createDataFrame([("c", 0.0, None)], df.schema))
    assert spark.read.parquet(path).count() == 2
    store.save_store(df, str(tmp_path / "t"), "enc")
    assert store.load_store(spark, str(tmp_path / "t")).count() == 2
    with pytest.raises(FileNotFoundError):
        store.load_store(spark, str(tmp_path / "none"))
    store.write_jsonl(df, str(tmp_path / "j"))
    assert store.read_jsonl(spark, str(tmp_path / "j"), "id string, ts double, objects array<string>").select(F.size("objects").alias("n")).distinct().first().n == 0


def test_numbered_rows_are_all_there(spark):
    """Wide rows, many ranges, ties, and default adaptive execution."""
    n = 150_000
    rows = spark.range(n).select((F.col("id") * 7919 % 50_021).alias("k"), F.concat(F.xxhash64("id").cast("string"), F.expr("repeat(sha2(cast(id AS string), 256), 4)")).alias("wide"), "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = store.with_index(rows, ["k"]).select("index", "k", "id", F.length("wide").alias("w")).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = got.sort_values("index")
    assert got["index"].tolist() == list(range(n)) and got["id"].nunique() == n
    assert got["k"].is_monotonic_increasing and (got["w"] >= 256).all()


def test_every_frame_has_a_number_of_its_own(spark):
    """Frames with equal names, with equal vectors as well, and without a name."""
    frames = [("b", [2.0]), ("a", [1.0]), ("b", [1.0]), (None, [0.0]), ("b", [2.0])]
    got = store.observations(spark.createDataFrame(frames, "frame string, v array<float>"), "frame", "v").orderBy("ts").collect()
    assert [(r.id, r.ts, r.frame_path, list(r.embedding)) for r in got] == [
        (f"obs_00000{i}", float(i), f, v) for i, (f, v) in enumerate([("a", [1.0]), ("b", [1.0]), ("b", [2.0]), ("b", [2.0]), (None, [0.0])])
    ]


def test_models_get_batches_of_bounded_size(spark):
    """Of long texts a few, of short ones some thousands; nulls, lists and structs pass as they are."""
    wide = spark.range(1500, numPartitions=1).select("id", F.when(F.col("id") > 0, F.repeat(F.lit("x"), 20_000)).alias("text"), F.array("id").alias("ids"), F.struct("id").alias("s"))
    got = registry.attach(wide, "text", lambda texts: [len(texts)] * len(texts), "int", "n").collect()
    assert [(r.id, r.ids, r.s.id) for r in got] == [(i, [i], i) for i in range(1500)] and got[0].text is None and len(got[1].text) == 20_000
    assert 100 < max(r.n for r in got) <= 400
    short = spark.range(9000, numPartitions=1)
    assert max(r.n for r in registry.attach(short, "id", lambda ids: [len(ids)] * len(ids), "int", "n").collect()) == 2048

    def odd(ids):
        if any(i % 3 == 0 for i in ids):
            raise ValueError
        return [[str(i)] for i in ids]

    said = {r.id: r.said for r in registry.attach(short, "id", odd, "array<string>", "said").collect()}
    assert said == {i: [str(i)] if i % 3 else None for i in range(9000)}


def test_report_and_hash(spark, tmp_path):
    w = spark.createDataFrame([("weak_edge", "1-2")], "check string, subject string")
    store.write_report(w, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r/markdown")).first()[0] == "- **weak_edge** 1-2"
    a = spark.createDataFrame([(1, 2), (3, 4)], "x int, y int")
    b = spark.createDataFrame([(3, 4), (1, 2)], "x int, y int")
    assert store.content_hash(a, a).first() == store.content_hash(b, b).first()


def test_config():
    good = {"localization": {"w_visual": 0.5, "w_semantic": 0.25}}
    assert store.validate_config(good) == []
    assert store.validate_config({"localization": {"w_visual": 1.5}}) and store.validate_config({})
    assert store.validate_config(good | {"embedding": {"model": "x"}}, ("y",))


def test_settings_files(tmp_path):
    (tmp_path / "a.json").write_text('{"localization": {"w_visual": 0.5}, "paths": {"video": "v.mp4", "map": "no/map"}}')
    cfg = store.load_config(str(tmp_path / "a.json"))
    assert [x for x, _ in store.validate_config(cfg, root=str(tmp_path))] == ["warning", "error"]
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("localization:\n  w_visual: 0.5\n")
    assert store.load_config(str(tmp_path / "a.yaml")) == {"localization": {"w_visual": 0.5}}
    with pytest.raises(FileNotFoundError):
        store.load_config(str(tmp_path / "none.yaml"))
