"""Benchmark decontamination: pieces of test items found exactly, then verified by Myers' edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.work import held, ship, texts_of

#: Edits allowed, as a share of an item's normalised bytes.
ERROR_RATE = 0.08
#: Bytes of test items that one pass over the documents looks for; more items are taken in blocks. A worker
#: needs about 70 bytes for each of them (measured: 73 MB for 1 MB, 281 MB for 4 MB, 1.1 GB for 16 MB).
BLOCK_BYTES = 2 << 20
_CUT = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
_PLAIN = bytes.maketrans(_CUT, b" " * len(_CUT))


def normalised(text: str | None) -> bytes:
    """UTF-8 in lower case (A-Z), ASCII punctuation and white space as single spaces; null is empty."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().translate(_PLAIN).split())


def pieces(item: bytes, errors: int) -> list[tuple[int, bytes]]:
    """``errors + 1`` adjacent pieces of near equal length: (where, piece). One survives any ``errors`` edits."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Least edit distance of a pattern to any substring of a text, by bit vectors."""

    def __init__(self, pattern: bytes) -> None:
        self.m = len(pattern)
        self.full, self.top = (1 << self.m) - 1, 1 << (self.m - 1)
        self.peq = [0] * 256
        for i, c in enumerate(pattern):
            self.peq[c] |= 1 << i

    def search(self, text: bytes, most: int) -> int | None:
        """The least distance if it is at most ``most``, else None."""
        full, top, peq = self.full, self.top, self.peq
        pv, mv, score, best = full, 0, self.m, self.m
        for c in text:
            eq = peq[c]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
        return best if best <= most else None


def budget(item: bytes, rate: float) -> int:
    return int(len(item) * rate)


class Finder:
    def __init__(self, items: list[tuple[int, bytes]], rate: float) -> None:
        import ahocorasick

        self.items = [(i, t, budget(t, rate), Myers(t)) for i, t in items if t]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e, _) in enumerate(self.items):
            for at, p in pieces(t, e):
                where.setdefault(p.decode("latin-1"), []).append((k, at))
        for p, places in where.items():
            self.automaton.add_word(p, (len(p), places))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def matches(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(item id, least distance, edits allowed) of each item that the text holds within its budget.

        Hits of one item whose alignments with it overlap are verified in one run over what they span.
        """
        if not self.any:
            return
        starts: dict[int, set[int]] = {}
        for end, (n, places) in self.automaton.iter(text.decode("latin-1")):
            for k, at in places:
                starts.setdefault(k, set()).add(end - n + 1 - at)
        for k, at in starts.items():
            item_id, t, e, myers = self.items[k]
            best, runs = None, []
            for s in sorted(at):
                lo, hi = max(0, s - e), min(len(text), s + len(t) + e)
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            for lo, hi in runs:
                d = myers.search(text[lo:hi], e if best is None else best - 1)
                best = d if d is not None else best
                if best == 0:
                    break
            if best is not None:
                yield item_id, best, e


def _searcher(items: list[tuple[int, bytes]], rate: float) -> Callable:
    key = "finder " + hashlib.sha256(repr((items, rate)).encode()).hexdigest()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = held(key, lambda: Finder(items, rate))
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for r, text in enumerate(texts_of(b.column("text"))):
                for item, d, e in finder.matches(normalised(text)):
                    for column, v in zip(out, (r, item, d, e)):
                        column.append(v)
            taken = b.select([c for c in b.schema.names if c != "text"]).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(c, pa.int64()) for c in out[1:])], [*taken.schema.names, "item_id", "distance", "allowed"])

    return search


def item_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The distinct test items in blocks of about ``most`` bytes: what an executor holds stays bounded."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // most)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield sorted((r["item_id"], normalised(r["text"])) for r in rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """A row for each document and test item of which it holds a passage: doc_id, item_id, distance, allowed.

    Texts are normalised (see normalised). An item of n bytes may be found with up to ``n * rate``
    edits; it is split into one piece more, so that at least one piece is found exactly wherever the
    item lies within its budget, and the least edit distance near the hits decides. All documents
    are read in one pass, without a shuffle, for each block of items of BLOCK_BYTES.

    Null ids of documents stay; null texts hold nothing; items that are null or empty once normalised
    are never found; items with equal ids are looked for each, repeated ones once. Repeated documents
    give repeated rows; empty tables give an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, distance long, allowed long"
    out = None
    for items in item_blocks(benchmark):
        part = rows.mapInArrow(_searcher(items, rate), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _clean(items: list[tuple[int, bytes]], rate: float) -> Callable:
    key = "finder " + hashlib.sha256(repr((items, rate)).encode()).hexdigest()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = held(key, lambda: Finder(items, rate))
        for b in batches:
            keep = [next(finder.matches(normalised(t)), None) is None for t in texts_of(b.column("text"))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return clean


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no test item (see contaminated), with all their columns."""
    ship(docs.sparkSession)
    for items in item_blocks(benchmark):
        docs = docs.mapInArrow(_clean(items, rate), docs.schema)
    return docs
