"""Removal of repeated byte strings, by a suffix sort that compares prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.work import ship, written

#: The length of a repeated string, of the grams that bring repeats together, and so of windows of grams.
LENGTH, GRAM = 200, 64
#: Places of one key that a task compares at most; keys with more are split by what follows their gram.
HOT_KEY = 2_500
#: Offsets of windows in a range, at the first and second split.
WIDTHS = (12, 1)
#: Bytes that are hashed at once.
CHUNK = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class PrefixHashes:
    """Hashes of all substrings of ``data``: sums of byte * base**position modulo 2**64 before each position."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.data = data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes from ``a`` and ``b`` on that are equal, up to ``most``: binary search on hashes."""
        lo, hi = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.of(a, a + mid) == self.of(b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def back_extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes before ``a`` and ``b`` that are equal, up to ``most``."""
        lo, hi = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.of(a - mid, a) == self.of(b - mid, b)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the bytes themselves are equal: hashes may collide."""
        out = np.ones(len(a), bool)
        for i in range(0, len(a), 4096):
            m = int(n[i : i + 4096].max(initial=0))
            at = np.arange(m)
            top = len(self.data) - 1
            x = self.data[np.minimum(a[i : i + 4096, None] + at, top)]
            y = self.data[np.minimum(b[i : i + 4096, None] + at, top)]
            out[i : i + 4096] = ((x == y) | (at >= n[i : i + 4096, None])).all(axis=1)
        return out


def suffix_sort(h: PrefixHashes, start: np.ndarray, stop: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes data[start:stop] within each group (groups lie together): a merge sort.

    All merges of one width run at once: each suffix finds its rank in the sibling run by binary
    search, and each comparison finds the common extension by binary search on prefix hashes and looks
    at one byte after it. Equal suffixes keep their order.
    """
    n = len(start)
    first = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(n), 0))
    size = np.bincount(np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1) if n else np.zeros(0, int)
    size = np.repeat(size, size)
    order, width, data = np.arange(n), 1, h.data

    def less(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        la, lb = stop[a] - start[a], stop[b] - start[b]
        common = h.extension(start[a], start[b], np.minimum(la, lb))
        ends = (common == la) | (common == lb)
        top = len(data) - 1
        x, y = data[np.minimum(start[a] + common, top)], data[np.minimum(start[b] + common, top)]
        return np.where(ends, (la < lb) | ((la == lb) & or_equal), x < y)

    while n and width < size.max():
        at = np.flatnonzero(size > width)
        local = at - first[at]
        run = local // width
        odd = run % 2 == 1
        sibling = first[at] + np.where(odd, run - 1, run + 1) * width
        end = np.minimum(sibling + width, first[at] + size[at])
        lo, hi = np.minimum(sibling, end), end.copy()
        low = lo.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            other, mine = order[mid], order[at[live]]
            # In the left run equals go before, so they pass only what is strictly less.
            before = less(other, mine, odd[live])
            lo[live] = np.where(before, mid + 1, lo[live])
            hi[live] = np.where(before, hi[live], mid)
            live = live[lo[live] < hi[live]]
        pair = first[at] + (run - odd) * width
        target = pair + (local - run * width) + (lo - low)
        new = order.copy()
        new[target] = order[at]
        order, width = new, width * 2
    return order


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text index, key, position, least and most offset of the anchors of all LENGTH-byte windows.

    The anchor of a window is its gram of least hash, the leftmost among equals: it depends on the
    window's bytes alone, so equal windows have equal anchors at equal offsets. The windows that an
    anchor serves are those that start ``least`` to ``most`` bytes before it.
    """
    empty = np.zeros(0, np.int64)
    lens = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    span = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return empty, empty.view(np.uint64), empty, empty, empty
    h = PrefixHashes(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = _mix(h.of(at, at + GRAM))
    low = (gram & ~np.uint64(0xFFFFFFF)) | at.astype(np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    where = (low & np.uint64(0xFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    room = np.maximum(lens - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(texts)), room)
    start = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room)
    a = where[start]
    if not len(a):
        return empty, empty.view(np.uint64), empty, empty, empty
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[cut[1:], len(a)] - 1
    d, p = doc[cut], a[cut]
    return d, gram[p], p - first[d], p - start[last], p - start[cut]


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    i, size = 0, 0
    for j, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield i, j
            i, size = j, 0
        size += len(t)
    if texts:
        yield i, len(texts)


def _pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts cut into pieces that overlap by LENGTH - 1 bytes, so that a long text is hashed in parts."""
    step = CHUNK
    out, doc, at = [], [], []
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - LENGTH + 1), step):
            out.append(t[s : s + step + LENGTH - 1])
            doc.append(i)
            at.append(s)
    return out, np.array(doc, np.int64), np.array(at, np.int64)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        uid, ids = b.column("uid").to_numpy(zero_copy_only=False), b.column("doc_id")
        parts, doc, at = _pieces(b.column("body").to_pylist())
        for i, j in _blocks(parts):
            d, key, pos, least, most = anchors(parts[i:j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), ids.take(pa.array(doc[i:j][d])), pa.array(uid[doc[i:j][d]]), pa.array((pos + at[i:j][d]).astype(np.int32)), pa.array(least.astype(np.int16)), pa.array(most.astype(np.int16))],
                ["key", "doc_id", "uid", "pos", "least", "most"],
            )


def _merged(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each text, with those that overlap or touch made one."""
    by = np.lexsort((lo, uid))
    uid, lo, hi = uid[by], lo[by], hi[by]
    if not len(uid):
        return uid, lo, hi
    text = np.cumsum(np.r_[False, uid[1:] != uid[:-1]])
    span = int(hi.max()) + 2
    far = np.maximum.accumulate(hi + text * span) - text * span
    new = np.r_[True, (uid[1:] != uid[:-1]) | (lo[1:] > far[:-1])]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(uid) - 1]
    return uid[new], lo[new], far[last]


_CONTEXT = "key long, uid long, pos int, least short, most short, ctx binary"


def _rows(key, uid, pos, least, most, ctx) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((key, uid, pos, least, most, ctx), kinds)], ["key", "uid", "pos", "least", "most", "ctx"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], tuple | None]]:
    """Places of anchors with the bytes that their windows cover: (key, uid, pos, least, most, bytes).

    Of places whose bytes are equal, such as those of a line that fills texts, one goes on to be
    compared; that they all repeat is settled here: ranges (uid, start, stop), or None.
    """
    first: dict[tuple, list] = {}
    size = 0

    def flush() -> tuple[list[tuple], tuple | None]:
        again = [(u, p - k[2], p - k[1] + LENGTH) for k, v in first.items() if len(v) > 1 for u, p in v]
        return [(k[0], *v[0], k[1], k[2], k[3]) for k, v in first.items()], _merged(*(np.array(c, np.int64) for c in zip(*again))) if again else None

    for b in batches:
        for uid, body, found in zip(b.column("uid").to_pylist(), b.column("body").to_pylist(), b.column("found")):
            s = found.values
            key, pos, least, most = (s.field(k).to_pylist() for k in ("key", "pos", "least", "most"))
            for k, p, n, m in zip(key, pos, least, most):
                first.setdefault((k, n, m, body[p - m : p - n + LENGTH]), []).append((uid, p))
            size += len(key)
            if size >= 100_000:
                yield flush()
                first, size = {}, 0
    yield flush()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, known in _places(batches):
        for i in range(0, len(rows), 20_000):
            yield _rows(*zip(*rows[i : i + 20_000]))
        if known:
            yield _settled(*known)


_FINER = "key long, uid long, pos int, least short, most short, stop int"


def _finer(width: int):
    """Splits the windows of each place into those whose offsets lie in one range of ``width``.

    What all windows of a range share is longer than the gram at the anchor, and its hash is the key
    of the new place: places around a passage that very many texts hold part ways where the texts
    do. Rows with a stop are ranges that are settled; their key is null.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FINER.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int32())

        def out(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for rows, known in _places(batches):
            for i in range(0, len(rows), 5_000):
                new = []
                for key, uid, pos, least, most, ctx in rows[i : i + 5_000]:
                    for s in range(least // width * width, most + 1, width):
                        core = _core(ctx, most, s, width)
                        h = xxhash.xxh3_64_intdigest(core, (key ^ (s * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF)
                        new.append((h - (1 << 64) if h >> 63 else h, uid, pos, max(least, s), min(most, s + width - 1), None))
                if new:
                    yield out(*zip(*new))
            if known:
                uid, lo, hi = known
                none = [None] * len(uid)
                yield out(none, uid, lo, none, none, hi)

    return split


def _core(ctx: bytes, most: int, s: int, width: int) -> bytes:
    """The bytes that windows of offsets s to s + width - 1 share; the anchor is ``most`` bytes into ctx.

    Each window of the range holds them, so a place that has one of the windows has them all.
    """
    return ctx[most - s : most - (s + width - 1) + LENGTH]


def _settled(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Ranges that are known to repeat, as rows among contexts: ctx is null, key spreads them, and
    pos and the 15-bit halves of the length say where."""
    n = hi - lo
    return _rows(_mix(uid.view(np.uint64)).view(np.int64), uid, lo, n & 0x7FFF, n >> 15, [None] * len(uid))


def repeats(key: np.ndarray, least: np.ndarray, most: np.ndarray, ctx: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows occur more than once: (row, from offset, to offset) of each run of them.

    Rows are distinct places of anchors, sorted by key; row i has the windows that start least[i] to
    most[i] bytes before its anchor, and ctx[i] is what they cover. Equal rows are repeats as a
    whole. Of the others one of each kind is sorted by the suffix at its anchor; common extensions of
    neighbours to the right and left prove windows repeated. Windows that no neighbour proves are
    looked up by hash among all of their group. Every proof is checked on the bytes themselves.
    """
    lens = np.array([len(c) for c in ctx], np.int64)
    data = np.frombuffer(b"".join(ctx), np.uint8)
    first = np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)
    h = PrefixHashes(data)
    least, most = least.astype(np.int64), most.astype(np.int64)
    whole = _mix(h.of(first, first + lens) ^ key.view(np.uint64) ^ (least * 211 + most).astype(np.uint64))
    by = np.lexsort((whole, key))
    same = np.r_[False, (whole[by][1:] == whole[by][:-1]) & (key[by][1:] == key[by][:-1])]
    head = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
    ok = np.ones(len(by), bool)
    at = np.flatnonzero(same)
    ok[at] = (lens[by[at]] == lens[head[at]]) & (least[by[at]] == least[head[at]]) & (most[by[at]] == most[head[at]])
    at = at[ok[at]]
    ok[at] = h.equal(first[by[at]], first[head[at]], lens[by[at]])
    copy = same & ok
    rows_, lo_, hi_ = [], [], []

    def report(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        keep = lo <= hi
        rows_.append(rows[keep]), lo_.append(lo[keep]), hi_.append(hi[keep])

    twins = np.unique(np.r_[by[copy], head[copy]])
    report(twins, least[twins], most[twins])
    proven = np.zeros(len(by), bool)
    proven[twins] = True
    rep = by[~copy]  # one row of each kind, sorted by key
    group = key[rep]
    anchor = first + most
    stop = first + lens
    order = rep[suffix_sort(h, anchor[rep], stop[rep], group)]
    i, j = order[:-1], order[1:]
    pair = key[i] == key[j]
    i, j = i[pair], j[pair]
    right = h.extension(anchor[i], anchor[j], np.minimum(stop[i] - anchor[i], stop[j] - anchor[j]))
    left = h.back_extension(anchor[i], anchor[j], np.minimum(most[i], most[j]))
    good = right + left >= LENGTH
    i, j, right, left = i[good], j[good], right[good], left[good]
    true = h.equal(anchor[i] - left, anchor[j] - left, left + right)
    i, j, right, left = i[true], j[true], right[true], left[true]
    # Windows per row as a flat array of flags.
    width = most - least + 1
    base = np.concatenate(([0], np.cumsum(width)))
    edge = np.zeros(base[-1] + 1, np.int64)
    for r in (i, j):
        lo, hi = np.maximum(least[r], LENGTH - right), np.minimum(most[r], left)
        fits = lo <= hi
        np.add.at(edge, (base[r] + lo - least[r])[fits], 1)
        np.add.at(edge, (base[r] + hi - least[r] + 1)[fits], -1)
    flag = np.cumsum(edge[:-1]) > 0
    mine = np.repeat(np.arange(len(by)), width)
    flag |= proven[mine]
    # Groups with windows that nothing has proven: all their windows meet by hash.
    is_rep = np.zeros(len(by), bool)
    is_rep[rep] = True
    sizes = np.unique(group, return_counts=True)
    many = np.isin(key, sizes[0][sizes[1] > 1]) & is_rep
    open_keys = np.unique(key[mine[~flag & many[mine]]])
    some = np.flatnonzero(np.isin(key, open_keys) & is_rep)
    for o in range(0, LENGTH - GRAM + 1, 8) if len(some) else ():
        off = np.arange(o, o + 8)
        r, c = np.nonzero((least[some, None] <= off) & (off <= most[some, None]))
        r, d = some[r], off[c]
        w = base[r] + d - least[r]
        at = anchor[r] - d
        code = _mix(h.of(at, at + LENGTH) ^ _mix(key[r].view(np.uint64) + d.astype(np.uint64)))
        by_code = np.argsort(code, kind="stable")
        eq = np.flatnonzero(code[by_code][1:] == code[by_code][:-1])
        x, y = by_code[eq], by_code[eq + 1]
        need = ~(flag[w[x]] & flag[w[y]])
        x, y = x[need], y[need]
        sure = h.equal(at[x], at[y], np.full(len(x), LENGTH))
        flag[w[x[sure]]] = True
        flag[w[y[sure]]] = True
    flag &= ~proven[mine]
    cut = np.flatnonzero(np.diff(np.r_[0, flag.astype(np.int8), 0]) != 0) if len(flag) else np.zeros(0, int)
    # Runs may not go on into the next row.
    begin = np.flatnonzero(flag & np.r_[True, ~flag[:-1] | (mine[1:] != mine[:-1])]) if len(flag) else cut
    end = np.flatnonzero(flag & np.r_[~flag[1:] | (mine[1:] != mine[:-1]), True]) if len(flag) else cut
    r = mine[begin]
    report(r, begin - base[r] + least[r], end - base[r] + least[r])
    return np.concatenate(rows_), np.concatenate(lo_), np.concatenate(hi_)


#: Contexts that a task compares at once, or those of one key if they are more.
_STEP = 4_000


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, uid, pos, least, most, ctx), sorted by key; emits repeated byte ranges of texts."""

    def out(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["uid", "start", "stop"])

    def of(t: pa.Table) -> pa.RecordBatch:
        c = {k: t.column(k).to_numpy() for k in ("key", "uid", "pos", "least", "most")}
        row, lo, hi = repeats(c["key"], c["least"], c["most"], t.column("ctx").to_pylist())
        pos = c["pos"][row].astype(np.int64)
        return out(*_merged(c["uid"][row], pos - hi, pos - lo + LENGTH))

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        known = b.filter(pc.is_null(b.column("ctx")))
        if known.num_rows:
            lo, low, high = (known.column(k).to_numpy().astype(np.int64) for k in ("pos", "least", "most"))
            yield out(known.column("uid").to_numpy(), lo, lo + low + (high << 15))
        b = b.filter(pc.is_valid(b.column("ctx")))
        held.append(b)
        size += b.num_rows
        if size < _STEP:
            continue
        t = pa.Table.from_batches(held)
        cuts = np.flatnonzero(np.diff(t.column("key").to_numpy())) + 1
        begin = 0
        for end in cuts.tolist():
            if end - begin >= _STEP or end == cuts[-1]:
                yield of(t.slice(begin, end - begin))
                begin = end
        held = t.slice(begin).combine_chunks().to_batches()
        size = t.num_rows - begin
    if size:
        yield of(pa.Table.from_batches(held))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for uid, body, spans in zip(b.column("uid").to_pylist(), b.column("body").to_pylist(), b.column("spans")):
            lo, hi = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in ("start", "stop"))
            cover = np.zeros(len(body) + 1, np.int32)
            np.add.at(cover, lo, 1)
            np.add.at(cover, hi, -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
            for column, v in zip(out, (uid, int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), kept)):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["uid", "n_removed", "n_spans", "kept"])


def _with_texts(rows: DataFrame, firsts: DataFrame, places: DataFrame) -> DataFrame:
    """uid, body and the places ``found`` of each text that has any."""
    listed = places.groupBy("uid").agg(F.collect_set(F.struct("key", "pos", "least", "most")).alias("found"))
    mine = listed.join(firsts, listed["uid"] == firsts["u"]).select("u", "first_id", "found")
    return rows.join(mine, (rows["uid"] == mine["u"]) & rows["doc_id"].eqNullSafe(mine["first_id"])).select("uid", "body", "found")


def repeated_bytes(docs: DataFrame, digest_only: bool = True, hot_key: int = HOT_KEY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans and kept_sha256 (or kept, binary).

    Bytes are removed that a LENGTH-byte string covers which also starts anywhere else. Texts are
    known by a 64-bit hash, which is checked against SHA-256 and seeded anew should two texts share
    one. A text of LENGTH bytes or more that several rows hold goes as a whole; one copy stands for
    it from there on. Each distinct text gives anchors (about one in 69 positions); anchors whose gram occurs once
    are done; the others, with the bytes around them, meet by key, and each task sorts its suffixes.
    Keys with over ``hot_key`` places, such as those of a passage in a third of all texts, are split
    twice: by what all windows in a range of offsets share, and then by whole windows, of which equal
    ones need only one place for each batch. So no task compares an unbounded number of places.

    Null texts are empty; short texts keep all; repeated rows count as copies; null ids stay; an
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    body = F.coalesce(docs["text"], F.lit("")).cast("binary")
    for seed in range(64):
        rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.lit(seed), body).alias("uid"), body.alias("body"))
        meta = written(rows.select("doc_id", "uid", F.length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha")), "texts")
        per = meta.groupBy("uid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min("sha").alias("a"), F.max("sha").alias("b"))
        per = written(per.select("uid", "copies", "first_id", (F.col("a") != F.col("b")).alias("clash")), "distinct-texts")
        if per.where("clash").isEmpty():
            break
    found = written(rows.where(F.length("body") >= LENGTH).select("doc_id", "uid", "body").mapInArrow(_find_anchors, "key long, doc_id long, uid long, pos int, least short, most short"), "anchors")
    # Of copies of a text, which give the same places, one brings its anchors along.
    firsts = per.select(F.col("uid").alias("u"), "first_id")
    cold, settled = [], []
    for width in (*WIDTHS, None):
        # A key counts if it has two different places.
        extremes = found.groupBy("key").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("uid", "pos") for n, f in (("lo", F.min), ("hi", F.max))])
        shared = extremes.where("lo_uid < hi_uid OR lo_pos < hi_pos").select(F.col("key").alias("k"), (F.col("n") > hot_key).alias("hot"))
        # Written, so that the join reads two plain exchanges and can split those of hot keys.
        shared = written(shared, "shared-keys")
        hits = found.join(shared, found["key"] == F.col("k"))
        if "doc_id" in found.columns:
            hits = hits.join(firsts, (hits["uid"] == F.col("u")) & hits["doc_id"].eqNullSafe(F.col("first_id")))
        hits = written(hits.select("uid", "key", "pos", "least", "most", "hot"), "shared-anchors")
        if width is None or hits.where("hot").isEmpty():
            cold.append(hits.drop("hot"))
            break
        cold.append(hits.where("NOT hot").drop("hot"))
        finer = written(_with_texts(rows, firsts, hits.where("hot")).mapInArrow(_finer(width), _FINER), "finer-anchors")
        settled.append(finer.where("key IS NULL").select("uid", F.col("pos").alias("start"), "stop"))
        found = finer.where("key IS NOT NULL").drop("stop")
    places = reduce(DataFrame.unionByName, cold)
    ctx = _with_texts(rows, firsts, places).mapInArrow(_contexts, _CONTEXT)
    ranges = ctx.repartition("key").sortWithinPartitions("key", "uid", "pos").mapInArrow(_judge, "uid long, start int, stop int")
    ranges = reduce(DataFrame.unionByName, [ranges, *settled])
    spans = written(ranges.groupBy("uid").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    single = per.where("copies = 1").join(spans, "uid").select(F.col("uid").alias("u"), "first_id", "spans")
    left = rows.join(single, (rows["uid"] == single["u"]) & rows["doc_id"].eqNullSafe(single["first_id"])).select("uid", "body", "spans").mapInArrow(_remove, "uid long, n_removed long, n_spans long, kept binary")
    kept = F.sha2("kept", 256).alias("kept_sha256") if digest_only else F.col("kept")
    left = left.select(F.col("uid").alias("u"), "n_removed", "n_spans", kept)
    out = meta.join(per.where("copies > 1").select(F.col("uid").alias("v"), F.lit(True).alias("many")), meta["uid"] == F.col("v"), "left").join(left, meta["uid"] == F.col("u"), "left")
    gone = F.coalesce(F.col("many"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    if digest_only:
        last = F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).when(F.col("u").isNull(), F.col("sha")).otherwise(F.col("kept_sha256")).alias("kept_sha256")
    else:
        last = F.when(gone, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        last,
    )


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """What repeated_bytes must return for a few texts: n_bytes, n_removed, n_spans, kept_sha256."""
    bodies = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in bodies:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out
