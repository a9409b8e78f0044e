"""Reconciliation: places that are the same are merged, pair by pair, to a fixed point."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.functions.evidence import DISCRIMINATIVE, jaccard_strict, normalise_scene
from trailweave.shipping import ship

HALLS = ("corridor", "junction")
DEFAULTS = {"visual": 0.425, "extra": 0.835, "landmark": 0.5, "scene_required": True, "exact": 0.95, "slack": 0.15}


def scene_compatible(a: Column, b: Column) -> Column:
    return (a == "unknown") | (b == "unknown") | (a == b) | (a.isin(*HALLS) & b.isin(*HALLS))


def discriminative(marks: Column, signs: Column) -> Column:
    """Evidence of identity: telling landmarks and sign texts."""
    return F.array_union(F.array_intersect(marks, F.array(*map(F.lit, DISCRIMINATIVE))), signs)


def merge_decisions(pairs: DataFrame, cfg: dict | None = None) -> DataFrame:
    """Adds ``merged`` and ``reasons`` to pairs of places.

    pairs: vis, order_gap, and of either side scene, marks, signs (suffix _a, _b). Two halls merge on
    shared telling evidence in near the same view, or on the same view where neither has any; other
    pairs on a like view with shared landmarks, or a near equal view where neither has any. Clashing
    scenes or landmarks of like views forbid it. That places aren't neighbours is noted, no more.
    """
    c = DEFAULTS | (cfg or {})
    df = pairs.withColumns({f"__s{x}": normalise_scene(F.col(f"scene_{x}")) for x in "ab"} | {f"__d{x}": discriminative(F.col(f"marks_{x}"), F.col(f"signs_{x}")) for x in "ab"})
    vis, sa, sb, da, db, ma, mb = (F.col(x) for x in ("vis", "__sa", "__sb", "__da", "__db", "marks_a", "marks_b"))
    halls = sa.isin(*HALLS) & sb.isin(*HALLS)
    strong, near, ok = vis >= c["visual"], vis >= c["visual"] - c["slack"], scene_compatible(sa, sb)
    needed = ok | F.lit(not c["scene_required"])
    scene_clash = F.lit(c["scene_required"]) & ~ok & strong
    empty = lambda x: F.size(x) == 0
    shared = (jaccard_strict(da, db) >= c["landmark"]) & (vis >= c["extra"])
    exact = empty(da) & empty(db) & (vis >= c["exact"])
    hall_clash = ~empty(da) & ~empty(db) & ~F.arrays_overlap(da, db) & near
    overlap = jaccard_strict(ma, mb)
    bare = empty(ma) & empty(mb)
    marks_strong = overlap >= c["landmark"]
    mark_clash = ~empty(ma) & ~empty(mb) & (overlap < 1e-9) & near
    apart = (F.col("order_gap") > 1) & strong
    merged = F.when(halls, (shared | exact) & needed & ~hall_clash & ~scene_clash).otherwise(strong & needed & ~mark_clash & ~scene_clash & (marks_strong | (bare & (vis >= c["extra"]))))
    listed = lambda *xs: F.array_compact(F.array(*[F.when(cond, name) for name, cond in xs]))
    reasons = F.when(
        halls, listed(("landmarks", shared), ("visual_near_identical", exact), ("visual", strong), ("context", apart), ("scene", ok), ("landmark_conflict", hall_clash), ("scene_conflict", scene_clash))
    ).otherwise(listed(("visual", strong), ("landmarks", marks_strong), ("landmarks_neutral", bare & strong), ("context", apart), ("scene", ok), ("landmark_conflict", mark_clash), ("scene_conflict", scene_clash)))
    return df.withColumns({"landmark_jaccard": overlap, "scene_compatible": ok, "merged": merged, "reasons": reasons}).drop("__sa", "__sb", "__da", "__db")


def _most_common(xs: list, limit: int = 8) -> list:
    return [x for x, _ in Counter(xs).most_common(limit)]


#: What a decision for two places in memory depends on besides their views: scene, marks, telling evidence.
Kind = tuple[str, frozenset, frozenset]


def _kind(p: dict) -> Kind:
    scene = p["scenes"].most_common(1)[0][0] if p["scenes"] else "unknown"
    return {"corridor_junction": "junction"}.get(scene, scene), frozenset(p["marks"]), frozenset(m for m in p["marks"] if m in DISCRIMINATIVE) | frozenset(p["signs"])


def _window(a: Kind, b: Kind, c: dict) -> tuple[float, float] | None:
    """The similarities of views, from the first up to below the second, at which two places merge; none: None.

    Equal to ``merge_decisions`` for one pair.
    """
    (sa, ma, da), (sb, mb, db) = a, b
    halls = sa in HALLS and sb in HALLS
    if c["scene_required"] and not (halls or "unknown" in (sa, sb) or sa == sb):
        return None
    x, y = (da, db) if halls else (ma, mb)
    overlap = len(x & y) / len(x | y) if x and y else 0.0
    shared, bare = overlap >= c["landmark"], not x and not y
    if not (shared or bare):
        return None
    if halls:
        least = min([c["extra"]] * shared + [c["exact"]] * bare)
    else:
        least = c["visual"] if shared else max(c["visual"], c["extra"])
    clash = x and y and overlap < 1e-9
    return least, c["visual"] - c["slack"] if clash else np.inf


def _same(a: dict, b: dict, vis: float, c: dict) -> bool:
    """The decision for two places in memory."""
    w = _window(_kind(a), _kind(b), c)
    return w is not None and w[0] <= vis < w[1]


def _merge(a: dict, b: dict, cap: int | None) -> None:
    """Adds the place ``b`` to ``a``; observations are put in order at the end."""
    ids = a["exemplar_ids"] + b["exemplar_ids"]
    if cap and len(ids) > cap:
        ids = [ids[i] for i in np.linspace(0, len(ids) - 1, cap).round().astype(int)]
    for scene, n in b["scenes"].items():
        a["scenes"][scene] += n
    if len(a["parts"]) < len(b["parts"]):
        a["parts"], b["parts"] = b["parts"], a["parts"]
    a["parts"] += b["parts"]
    a |= {"place_id": min(a["place_id"], b["place_id"]), "exemplar_ids": ids, "n": a["n"] + b["n"], "touched": True} | {k: _most_common(a[k] + b[k]) for k in ("marks", "signs")}


class _Todo:
    """The places of a pass in their order, until each is taken: as a head, or by one that it merges with."""

    def __init__(self, places: list[dict], vectors: np.ndarray, row: dict, c: dict) -> None:
        self.places, self.vectors, self.row, self.c = places, vectors, row, c
        self.there = np.ones(len(places), bool)
        self.touched = np.array([p["touched"] for p in places], bool)
        rows = [self._rows(p) for p in places]
        self.n = np.array([len(r) for r in rows], np.int64)
        self.rows, self.first = np.concatenate([*rows, np.zeros(0, np.int64)]), np.cumsum(self.n) - self.n
        self.of: dict[Kind, list[int]] = {}
        for i, p in enumerate(places):
            self.of.setdefault(_kind(p), []).append(i)
        # Places merge if they share some evidence, or if both have none, so others needn't be looked at.
        self.by: dict = {}
        for k in self.of:
            for token in self._tokens(k):
                self.by.setdefault(token, []).append(k)
        self.known: dict[Kind, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _rows(self, p: dict) -> np.ndarray:
        return np.array([self.row[i] for i in p["exemplar_ids"] if i in self.row], np.int64)

    @staticmethod
    def _tokens(k: Kind) -> list:
        _, marks, telling = k
        return [("mark", m) for m in marks or (None,)] + [("telling", m) for m in telling or (None,)]

    def _partners(self, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places left that may merge with one of this kind, in order, with their windows."""
        if kind in self.known:
            at, least, below = self.known[kind]
        else:
            near = self.of if self.c["landmark"] <= 0 else dict.fromkeys(k for t in self._tokens(kind) for k in self.by.get(t, ()))
            hits = [(self.of[k], w) for k in near if (w := _window(kind, k, self.c))]
            at = np.concatenate([np.zeros(0, np.int64), *[np.array(i) for i, _ in hits]])
            ends = np.repeat(np.array([w for _, w in hits]).reshape(-1, 2), [len(i) for i, _ in hits], axis=0)
            order = np.argsort(at)
            at, least, below = at[order], ends[order, 0], ends[order, 1]
            if len(self.known) >= 64:
                self.known.clear()
        left = self.there[at]
        if not left.all():
            at, least, below = at[left], least[left], below[left]
        self.known[kind] = at, least, below
        return at, least, below

    def match(self, head: dict, fresh: bool) -> int | None:
        """The first place left that merges with ``head``; unless it is ``fresh``, among those touched in the last pass."""
        at, least, below = self._partners(_kind(head))
        if not fresh:
            new = self.touched[at]
            at, least, below = at[new], least[new], below[new]
        own, start, step = self.vectors[self._rows(head)], 0, 64
        while start < len(at):
            some = at[start : start + step]
            n = self.n[some]
            sims = np.zeros(len(some))
            if len(own) and n.any():
                ends = np.cumsum(n)
                flat = np.repeat(self.first[some] - (ends - n), n) + np.arange(ends[-1])
                most = (self.vectors[self.rows[flat]] @ own.T).max(axis=1)
                sims[n > 0] = np.maximum.reduceat(most, (ends - n)[n > 0])
            hit = np.flatnonzero((sims >= least[start : start + step]) & (sims < below[start : start + step]))
            if len(hit):
                return int(some[hit[0]])
            start, step = start + step, min(2 * step, 4096)
        return None


def reconcile(places: DataFrame, exemplars: DataFrame, key: str, cfg: dict | None = None, cap: int = 3, passes: int = 10) -> DataFrame:
    """Merges the places of each map (``key``) to a fixed point; which merges come first matters.

    places: key, place_id, observation_ids, exemplar_ids, scenes (array of scene per observation), marks, signs.
    exemplars: key, id, v. The sweep over pairs is sequential by definition, so a map is one task, which
    gets the vectors of exemplars only; maps are independent. A place is held against those that share
    evidence with it, a block at a time and up to the first that merges, and in later passes against
    what has changed. Returns key, place_id, observation_ids, exemplar_ids, marks, signs, merged_from
    (number of places).
    """
    c = DEFAULTS | (cfg or {})
    ship(places.sparkSession)
    kind = places.schema[key].dataType.simpleString()
    pid = places.schema["place_id"].dataType.simpleString()
    ident = exemplars.schema["id"].dataType.simpleString()
    used = places.select(F.col(key).alias("__key"), F.explode("exemplar_ids").alias("__id"))
    exemplars = exemplars.where("v IS NOT NULL").join(used, F.col(key).eqNullSafe(F.col("__key")) & (F.col("id") == F.col("__id")), "left_semi")

    def sweep(rows: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        row = {i: n for n, i in enumerate(vectors["id"])}
        v = np.array(vectors["v"].tolist(), np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
        todo = [
            {"place_id": r.place_id, "parts": [r.observation_ids], "exemplar_ids": list(r.exemplar_ids), "scenes": Counter(r.scenes), "marks": list(r.marks), "signs": list(r.signs), "n": 1, "touched": True}
            for r in rows.sort_values("place_id", kind="stable").itertuples()
        ]
        for _ in range(passes):
            left, kept = _Todo(todo, v, row, c), []
            for at, head in enumerate(todo):
                if not left.there[at]:
                    continue
                left.there[at] = False
                fresh, head["touched"] = head["touched"], False
                # A merged place is held against all later ones anew.
                while (other := left.match(head, fresh)) is not None:
                    left.there[other] = False
                    _merge(head, todo[other], cap)
                    fresh = True
                kept.append(head)
            todo, before = kept, len(todo)
            if len(todo) == before:
                break
        first = rows[key].iloc[0] if len(rows) else None
        columns = [key, "place_id", "observation_ids", "exemplar_ids", "marks", "signs", "merged_from"]
        return pd.DataFrame([(first, p["place_id"], sorted(i for part in p["parts"] for i in part), p["exemplar_ids"], p["marks"], p["signs"], p["n"]) for p in todo], columns=columns)

    schema = f"{key} {kind}, place_id {pid}, observation_ids array<{ident}>, exemplar_ids array<{ident}>, marks array<string>, signs array<string>, merged_from int"
    return places.groupBy(key).cogroup(exemplars.groupBy(key)).applyInPandas(sweep, schema)
