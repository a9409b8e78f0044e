"""Packing of token pieces into sequences: best fit, then a local search by moves and swaps."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.tokens import encoder
from trailweave.llm.work import ship, texts_of, written

#: Pieces that one task packs together, on average. A group wastes less than one sequence by itself.
GROUP_PIECES = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: list[int], room: int, falling: bool = True) -> list[list[int]]:
    """Best fit, in falling order of length or as the pieces come: bins as lists of indices. No length exceeds ``room``."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)) if falling else range(len(lengths)):
        k = bisect_left(free, (lengths[i], -1))
        if k == len(free):
            bins.append([i])
            left, b = room - lengths[i], len(bins) - 1
        else:
            left, b = free.pop(k)
            bins[b].append(i)
            left -= lengths[i]
        if left:
            insort(free, (left, b))
    return bins


class _Search:
    """A packing that exchanges rearrange. Pieces are numbered in order of length."""

    def __init__(self, lengths: list[int], bins: list[list[int]], room: int) -> None:
        size = np.array(lengths, np.int64)
        self.room, self.order = room, np.argsort(size, kind="stable")
        self.size = size[self.order]
        number = np.empty(len(size), np.int64)
        number[self.order] = np.arange(len(size))
        self.bins = [number[b].tolist() for b in bins]
        self.home = np.empty(len(size), np.int64)
        for k, b in enumerate(self.bins):
            self.home[b] = k
        self.fill = np.array([self.size[b].sum() for b in self.bins], np.int64)
        self.left = len(self.bins)
        #: Fewer bins than this hold no packing: at that the search ends.
        self.least = -(-int(size.sum()) // room)
        # The room of underfull bins (-1: full, empty or the source), and how long a piece, or a pair of
        # pieces, may be that takes the place of each.
        self.gap = np.where(self.fill < room, room - self.fill, -1)
        self.reach = self.size + room - self.fill[self.home]
        self.pairs: tuple | None = None

    def settle(self, k: int, delta: int) -> None:
        """Notes that the fill of bin k has changed; its pairs are out of date."""
        self.fill[k] += delta
        self.gap[k] = self.room - self.fill[k] if 0 < self.fill[k] < self.room else -1
        b = self.bins[k]
        self.reach[b] = self.size[b] + self.room - self.fill[k]
        if self.pairs is not None:
            _, _, reach, of = self.pairs
            reach[of.get(k, [])] = 0
            self.stale = True

    def exchange(self, src: int, out: list[int], dst: int, back: list[int]) -> None:
        """Pieces ``out`` of bin src for pieces ``back`` of bin dst."""
        delta = int(self.size[out].sum() - self.size[back].sum())
        for pieces, a, b in ((out, src, dst), (back, dst, src)):
            for p in pieces:
                self.bins[a].remove(p)
                self.bins[b].append(p)
                self.home[p] = b
        self.settle(dst, delta)
        self.settle(src, -delta)
        self.gap[src] = -1
        self.reach[self.bins[src]] = 0
        self.left -= not self.bins[src]

    # A step carries d > 0 tokens from src to dst. It adds 2 d (fill[dst] - fill[src] + d) to the sum of
    # squared fills; only steps that add are taken, so the fill of dst must come above that of src.

    def move(self, src: int, t: int) -> int | None:
        """The bin with the least room that takes a piece of length t."""
        ok = (self.gap >= t) & (self.gap < self.room + t - self.fill[src])
        fit = np.flatnonzero(ok)
        return int(fit[np.argmin(self.gap[fit])]) if len(fit) else None

    def partner(self, src: int, t: int) -> int | None:
        """The shortest piece that tokens of length t, longer than it, can take the place of."""
        reach = self.reach[: np.searchsorted(self.size, t)]
        ok = (reach >= t) & (reach < self.room + t - self.fill[src])
        at = int(ok.argmax()) if len(ok) else 0
        return at if len(ok) and ok[at] else None

    def two_of(self, k: int) -> dict[int, tuple[int, int]]:
        """Sums of two pieces of bin k, each with one such pair. Equal lengths are alike, so sums are few."""
        by: dict[int, list[int]] = {}
        for p in self.bins[k]:
            by.setdefault(int(self.size[p]), []).append(p)
        sizes = sorted(by)
        out = {2 * x: (by[x][0], by[x][1]) for x in sizes if len(by[x]) > 1}
        for i, x in enumerate(sizes):
            for y in sizes[i + 1 :]:
                out.setdefault(x + y, (by[x][0], by[y][0]))
        return out

    def all_pairs(self) -> tuple:
        """Sums of two pieces in all underfull bins, sorted; their pairs; what each pair may give way to; where bins' pairs are."""
        rows = sorted((s, k, *xy) for k in np.flatnonzero(self.gap > 0).tolist() for s, xy in self.two_of(k).items())
        sums, of = np.array([r[0] for r in rows], np.int64), {}
        for i, r in enumerate(rows):
            of.setdefault(r[1], []).append(i)
        k = np.array([r[1] for r in rows], np.int64)
        self.stale = False
        return sums, rows, sums + self.room - self.fill[k] if len(rows) else sums, of

    def pair(self, src: int, t: int) -> tuple | None:
        """Two pieces of one bin that a single piece of length t, longer than both together, can take the place of."""
        sums, rows, reach, _ = self.pairs
        reach = reach[: np.searchsorted(sums, t)]
        ok = (reach >= t) & (reach < self.room + t - self.fill[src])
        at = int(ok.argmax()) if len(ok) else 0
        return rows[at] if len(ok) and ok[at] else None

    def step(self, src: int) -> bool:
        for i in sorted(self.bins[src], key=lambda p: -self.size[p]):
            t = int(self.size[i])
            if (dst := self.move(src, t)) is not None:
                self.exchange(src, [i], dst, [])
                return True
            if (j := self.partner(src, t)) is not None:
                self.exchange(src, [i], int(self.home[j]), [j])
                return True
        for t, xy in sorted(self.two_of(src).items(), reverse=True):
            if (z := self.partner(src, t)) is not None:
                self.exchange(src, list(xy), int(self.home[z]), [z])
                return True
        if self.pairs is None:
            self.pairs = self.all_pairs()
        for i in sorted(self.bins[src], key=lambda p: -self.size[p]):
            if (two := self.pair(src, int(self.size[i]))) is not None:
                self.exchange(src, [i], two[1], list(two[2:]))
                return True
        return False

    def drain(self, src: int) -> int:
        """Steps out of bin src until none is left; returns how many there were."""
        n = 0
        self.gap[src] = -1
        self.reach[self.bins[src]] = 0
        if self.pairs is not None:
            self.pairs[2][self.pairs[3].get(src, [])] = 0
            self.stale = True
        while self.bins[src] and self.step(src):
            n += 1
        self.settle(src, 0)
        return n

    def run(self) -> list[list[int]]:
        while self.left > self.least:
            n = 0
            if self.pairs is not None and self.stale:
                self.pairs = None
            for src in np.argsort(self.fill, kind="stable").tolist():
                if 0 < self.fill[src] < self.room:
                    n += self.drain(src)
                    if self.left <= self.least:
                        break
            if not n:
                break
        return [self.order[b].tolist() for b in self.bins if b]


def local_search(lengths: list[int], bins: list[list[int]], room: int) -> list[list[int]]:
    """Empties bins of a packing by moves, one-for-one and two-for-one exchanges among underfull bins.

    From the emptiest bin upwards, tokens are carried out of a bin: a piece goes to the fullest bin that
    takes it; or into the place of the shortest piece of any bin that it fits in; or two pieces go into
    the place of one; or one into that of two, all shorter than what comes. Every step raises the sum of
    squared fills, so steps come to an end; bins that come empty go. No partner is left out: what a
    length can take the place of is found in a sorted list of all pieces, or all pairs, of underfull
    bins. The search ends when no step is left, or at as many bins as the tokens need at least, where no
    packing is better. No step makes a new bin or exceeds ``room``.
    """
    return _Search(lengths, bins, room).run()


def packed_bins(lengths: list[int], room: int) -> list[list[int]]:
    """Bins of a group of pieces: best fit as the pieces come, and from there the local search.

    Where that ends above the bins that the tokens need at least, the search also begins at best fit in
    falling order of length, and the better packing counts: so it is never worse than best fit.
    """
    bins = local_search(lengths, best_fit(lengths, room, falling=False), room)
    if len(bins) > -(-sum(lengths) // room):
        bins = min(bins, local_search(lengths, best_fit(lengths, room), room), key=len)
    return bins


def _cut(path: str, room: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(texts_of(b.column("text")))):
                ids += b"\0\0\0\0"
                for p, at in enumerate(range(0, len(ids), 4 * room)):
                    piece = ids[at : at + 4 * room]
                    for column, v in zip(out, (doc, p, at // 4, len(piece) // 4, zlib.crc32(piece))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def _pack(room: int) -> Callable:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].tolist()
        bins = packed_bins(lengths, room)
        seq, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], offset[i] = (int(key[0]) << 32) + k, at
                at += lengths[i]
        return rows.drop(columns="bucket").assign(sequence_id=seq, offset=offset)

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """All texts of ``docs`` as token pieces in sequences of at most ``room`` tokens.

    A document is the ids of its text (null: empty) and then id 0. Only documents longer than
    ``room`` are cut, into pieces of ``room``; the last may be shorter. Pieces are dealt by hash into
    groups of about ``group_pieces``, and each group is packed by itself; so a task holds a bounded
    number of pieces however many there are, whatever their source, and no key can be hot. Returns
    for each piece doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Null ids stay; repeated rows are packed each; an empty table gives an empty result; other columns
    are not read. A text of any length is cut; one document's ids are in memory at a time.
    """
    ship(docs.sparkSession)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    pieces = written(texts.mapInArrow(_cut(tokenizer, room), PIECES), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("bucket").applyInPandas(_pack(room), f"{PIECES}, sequence_id long, offset long")
