"""The localization tracker: a state machine over beliefs, one pure step for replays and streams."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from trailweave.streaming.filter import belief_entropy, belief_step, likelihoods
from trailweave.streaming.fold import fold, names_of
from trailweave.shipping import ship

# Defaults of the localization settings.
SETTINGS = {
    "w_visual": 0.5,
    "w_semantic": 0.25,
    "w_temporal": 0.15,
    "w_graph": 0.1,
    "graph_radius": 2,
    "graph_penalty_strength": 0.5,
    "likelihood_temperature": 0.379,
    "tracking_threshold": 0.426,
    "tracking_entropy": 0.6,
    "lost_after": 3,
    "lost_threshold": 0.126,
    "lost_unknown_mass": 0.6,
    "reacquired_threshold": 0.426,
    "arrived_confirmations": 2,
    "transition_confirmation_count": 3,
    "transition_threshold": 0.576,
    "high_score": 0.526,
    "high_margin": 0.15,
    "high_entropy": 0.4,
    "low_score": 0.226,
    "low_margin": 0.02,
    "unknown_high_mass": 0.4,
}
OUT = "seq long, place_id long, place_name string, confidence double, changed boolean, low_confidence boolean, arrived boolean, route array<long>, directions string, state string, mode string, confidence_level string, unknown_mass double, entropy double, posterior map<bigint,double>"


@dataclass
class Track:
    """What a session remembers between frames."""

    belief: dict | None = None
    state: str = "UNCERTAIN"
    mode: str = "GLOBAL"
    place: int | None = None
    pending: int | None = None
    pending_n: int = 0
    weak: int = 0
    at_goal: int = 0

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(s: str) -> Track:
        d = json.loads(s)
        d["belief"] = None if d["belief"] is None else {int(k): v for k, v in d["belief"].items()}
        return Track(**d)


@dataclass
class World:
    """The map that a tracker runs on; small, and sent to executors with the code."""

    nodes: list[int]
    prior: dict[int, dict[int, float]]
    hops: dict[int, dict[int, int]]
    routes: dict[tuple[int, int], list[int]] = field(default_factory=dict)
    goal: int | None = None
    settings: dict = field(default_factory=dict)
    names: dict[int, str] = field(default_factory=dict)

    def name(self, place: int | None) -> str:
        return "Unrecognized" if place is None else self.names.get(place, f"Place_{place}")

    def get(self, key: str) -> float:
        return self.settings.get(key, SETTINGS[key])


def _level(score: float, margin: float, entropy: float, unknown: float, w: World) -> str:
    if unknown > w.get("unknown_high_mass"):
        return "UNKNOWN"
    if score > w.get("high_score") and margin > w.get("high_margin") and entropy < w.get("high_entropy"):
        return "HIGH"
    return "LOW" if score < w.get("low_score") or margin < w.get("low_margin") else "MEDIUM"


def step(t: Track, candidates: list[tuple[int, float, float]], w: World) -> tuple[Track, dict]:
    """One frame. candidates: (place, visual, semantic), best first. Returns the new memory and a status.

    Evidence for the belief is visual and semantic only; where the tracker was enters through the
    prior. Equal beliefs go to the smaller place id. A belief that has come to nothing stays so until the
    tracker is lost, and begins anew.
    """
    t = replace(t)
    margin = candidates[0][1] - candidates[1][1] if len(candidates) > 1 else candidates[0][1] if candidates else 0.0
    if t.mode == "LOCAL" and t.place in w.hops:
        reach = w.hops[t.place]
        candidates = [c for c in candidates if reach.get(c[0], 1 << 30) <= w.get("graph_radius")]
    post, best, score, unknown, entropy = {}, None, 0.0, 1.0, 1.0
    if candidates:
        wv, ws = w.get("w_visual"), w.get("w_semantic")
        like = likelihoods({p: (wv * v + ws * s) / (wv + ws) for p, v, s in candidates}, w.get("likelihood_temperature"))
        prior = {n: 1.0 / len(w.nodes) for n in w.nodes} if t.belief is None else t.belief
        post = belief_step(prior, like, w.prior)
        t.belief = post
        if post:
            best = min(post, key=lambda k: (-post[k], k))
            score = post[best]
        unknown, entropy = max(0.0, 1.0 - sum(post.values())), belief_entropy(post, len(w.nodes))
    changed = _confirm(t, best, score, w)
    state = _advance(t, best, score, unknown, entropy, w)
    place = t.place if t.place is not None else best
    arrived, route = False, None
    if place is not None and w.goal is not None:
        if place == w.goal and state == "TRACKING":
            t.at_goal += 1
            arrived = t.at_goal >= w.get("arrived_confirmations")
            state = "ARRIVED" if arrived else state
        elif place != w.goal or state != "TRACKING":
            t.at_goal = 0
            route = w.routes.get((place, w.goal))
    status = {
        "place_id": place,
        "place_name": w.name(place),
        "confidence": score,
        "changed": changed,
        "low_confidence": state in ("UNCERTAIN", "LOST"),
        "arrived": arrived,
        "route": route,
        "directions": " -> ".join(map(w.name, route)) if route else None,
        "state": state,
        "mode": t.mode,
        "confidence_level": _level(score, margin, entropy, unknown, w),
        "unknown_mass": unknown,
        "entropy": entropy,
        "posterior": post,
    }
    return t, status


def _confirm(t: Track, best: int | None, score: float, w: World) -> bool:
    """A change of place counts at once if belief is high, else after enough frames in a row."""
    if best is None or best == t.place:
        t.pending, t.pending_n = (t.pending if best is None else None), 0
        return False
    t.pending, t.pending_n = best, (t.pending_n + 1 if t.pending == best else 1)
    if score > w.get("transition_threshold") or t.pending_n >= w.get("transition_confirmation_count"):
        t.place, t.pending, t.pending_n, t.weak = best, None, 0, 0
        return True
    return False


def _advance(t: Track, best: int | None, score: float, unknown: float, entropy: float, w: World) -> str:
    back = score > w.get("reacquired_threshold")
    if t.state in ("LOST", "REACQUIRING"):
        if back:
            t.mode = "LOCAL"
        elif t.state == "REACQUIRING":
            t.mode = "GLOBAL"
        t.state = "TRACKING" if back else "REACQUIRING"
        return t.state
    settled = t.pending is None or t.pending == best or t.place is None
    if score > w.get("tracking_threshold") and entropy < w.get("tracking_entropy") and settled:
        t.state, t.weak = "TRACKING", 0
        t.mode = "LOCAL" if t.place is not None else t.mode
        return t.state
    t.weak += 1
    t.state = "UNCERTAIN"
    if t.weak >= w.get("lost_after") and (score < w.get("lost_threshold") or unknown > w.get("lost_unknown_mass")):
        t.state, t.mode, t.belief = "LOST", "GLOBAL", None
    return t.state


_FIELDS = names_of(OUT)


def _one(t: Track, row, w: World) -> tuple[Track, tuple]:
    seen = row.candidates if row.candidates is not None else []
    t, status = step(t, [(int(c["place"]), float(c["visual"]), float(c["semantic"])) for c in seen], w)
    return t, (row.seq, *(status[f] for f in _FIELDS[1:]))


def replay(frames: DataFrame, key: str, world: World) -> DataFrame:
    """Tracks each session (``key``) of a table: seq, candidates (array of struct place, visual, semantic)."""
    kind = frames.schema[key].dataType.simpleString()
    return fold(frames, key, "seq", ["candidates"], Track, lambda t, row: _one(t, row, world), f"{key} {kind}, {OUT}")


def track_stream(frames: DataFrame, key: str, world: World) -> DataFrame:
    """The same over a stream: each session's memory is state of the query; frames come in order of seq."""
    ship(frames.sparkSession)
    kind = frames.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        t = Track.load(state.get[0]) if state.exists else Track()
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            t, values = _one(t, row, world)
            out.append((k[0], *values))
        state.update((t.dump(),))
        yield pd.DataFrame(out, columns=[key, *_FIELDS])

    return frames.select(key, "seq", "candidates").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {OUT}", "track string", "append", GroupStateTimeout.NoTimeout)


def decision_log(tracked: DataFrame, frames: DataFrame, key: str, best: int = 5) -> DataFrame:
    """What was decided for each frame and on which candidates: rows for an append-only sink.

    How many are kept is the sink's affair: drop old partitions, not the last rows of a buffer.
    """
    seen = frames.select(key, "seq", F.slice("candidates", 1, best).alias("candidates"))
    return tracked.select(key, "seq", "state", "mode", "confidence_level", "unknown_mass", "place_id", F.col("confidence").alias("best_score"), "posterior").join(seen, [key, "seq"])


def legacy_step(held: tuple, place: int | None, score: float, threshold: float, last: int = 5) -> tuple[tuple, int | None]:
    """The older tracker: a weak frame keeps the last place; else the last predictions vote, the first of equals wins.

    held: (recent predictions, last place). Returns the new memory and the place.
    """
    recent, kept = held
    if place is None or score < threshold:
        return (recent, kept), kept
    recent = (*recent, place)[-last:]
    return (recent, vote := max(dict.fromkeys(recent), key=recent.count)), vote


def legacy_replay(frames: DataFrame, key: str, threshold: float, last: int = 5) -> DataFrame:
    """The older tracker over each session: key, seq, place_id. frames: key, seq, place, score."""
    ship(frames.sparkSession)
    kind = frames.schema[key].dataType.simpleString()

    def one(held: tuple, row) -> tuple:
        held, place = legacy_step(held, None if pd.isna(row.place) else int(row.place), row.score, threshold, last)
        return held, (row.seq, place)

    return fold(frames, key, "seq", ["place", "score"], lambda: ((), None), one, f"{key} {kind}, seq long, place_id long")
