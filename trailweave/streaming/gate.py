"""Gates that skip rows which bring nothing new: the sampler of frames and the gate of expensive work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from trailweave.shipping import ship
from trailweave.streaming.fold import fold

# Defaults of the sampling settings.
SAMPLING = {"min_interval": 0.5, "novelty": 0.15, "sustained": 0.4, "window": 5, "keep_after": 2, "max_stale": 5.0}


def distance(a: np.ndarray | None, b: np.ndarray | None) -> float:
    return 1.0 - float(np.dot(a, b)) if a is not None and b is not None else 1.0


def gate_step(last: tuple | None, ts: float, v: np.ndarray | None, novelty: float, stale: float) -> tuple[bool, str]:
    """Whether to run: invalid frames and first ones do, stale ones are forced, near copies of the last run don't."""
    if v is None:
        return True, "novel"
    if last is None:
        return True, "novel"
    if ts - last[0] > stale:
        return True, "forced_interval"
    return (False, "redundant") if distance(v, last[1]) < novelty else (True, "novel")


GATE_OUT = "seq long, run boolean, reason string"


def _one(last: tuple | None, row, novelty: float, stale: float) -> tuple[tuple | None, tuple]:
    v = None if row.v is None else np.asarray(row.v, np.float64)
    run, why = gate_step(last, row.ts, v, novelty, stale)
    return ((row.ts, v) if run else last), (row.seq, run, why)


def gate(frames: DataFrame, key: str, novelty: float = SAMPLING["novelty"], stale: float = SAMPLING["max_stale"]) -> DataFrame:
    """Each session's gate decisions: key, seq, run, reason. frames: key, seq, ts (seconds), v."""
    kind = frames.schema[key].dataType.simpleString()
    return fold(frames, key, "seq", ["ts", "v"], lambda: None, lambda last, row: _one(last, row, novelty, stale), f"{key} {kind}, {GATE_OUT}")


def gate_stream(frames: DataFrame, key: str, novelty: float = SAMPLING["novelty"], stale: float = SAMPLING["max_stale"]) -> DataFrame:
    """The same over a stream; the last frame that ran is the state of its session."""
    ship(frames.sparkSession)
    kind = frames.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = None
        if state.exists:
            ts, v = state.get
            last = (ts, None if v is None else np.asarray(v, np.float64))
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            last, values = _one(last, row, novelty, stale)
            out.append((k[0], *values))
        if last is not None:
            state.update((float(last[0]), None if last[1] is None else last[1].tolist()))
        yield pd.DataFrame(out, columns=[key, "seq", "run", "reason"])

    return frames.select(key, "seq", "ts", "v").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {GATE_OUT}", "ts double, v array<double>", "append", GroupStateTimeout.NoTimeout)


def sample_step(memory: tuple, row, c: dict) -> tuple[tuple, tuple]:
    """One decision of the smart sampler: seq, decision, distance, reasons.

    Frames are held against the last one kept. Those that quality rejects go. A sustained change (a
    full window of distances above its threshold) keeps the frame and the next few; any other must
    be novel and late enough after the last one kept. memory: (last kept, recent distances, frames owed).
    """
    last, recent, owed = memory
    why = list(row.rejects) if row.rejects is not None else []
    d, kept = None, not why
    if kept:
        v = np.asarray(row.v, np.float64)
        held, owed = owed > 0, max(0, owed - 1)
        if last is not None:
            d = distance(v, last[1])
            recent = [*recent, d][-c["window"] :]
            if not held and len(recent) == c["window"] and min(recent) > c["sustained"]:
                held, owed, why = True, c["keep_after"], ["sustained_change"]
            if not held:
                why = ["redundant"] if d < c["novelty"] else ["too_frequent"] if row.ts - last[0] < c["min_interval"] else []
                kept = not why
        if kept:
            last = (row.ts, v)
    return (last, recent, owed), (row.seq, "keep" if kept else "drop", d, why)


NO_SAMPLES = (None, [], 0)


def sample(frames: DataFrame, key: str, settings: dict | None = None) -> DataFrame:
    """The smart sampler over each session. frames: key, seq, ts, v, rejects (array of reasons)."""
    kind = frames.schema[key].dataType.simpleString()
    c = SAMPLING | (settings or {})
    return fold(frames, key, "seq", ["ts", "v", "rejects"], lambda: NO_SAMPLES, lambda m, row: sample_step(m, row, c), f"{key} {kind}, seq long, decision string, distance double, reasons array<string>")
