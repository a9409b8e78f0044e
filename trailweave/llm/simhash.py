"""SimHash near-duplicates: fingerprints, an exact tiled comparison, and connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.work import done, ship, texts_of, written

#: Fingerprints of one block value that a task compares at most; larger groups are dealt out by tile pairs.
TILE = 4096


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text; null and texts without words give 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(w) - words + 1)
    stops = ends[len(w) - n :] - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), stops.tolist())], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in texts_of(b.column("text"))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])


def _words(a: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return a.reshape(len(a), -1)


def near(a: np.ndarray, b: np.ndarray, radius: int, side: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of ``a`` and ``b`` that differ in at most ``radius`` bits.

    Fingerprints are numbers of 64 bits, or rows of several. Both sides are cut into tiles in order of
    population count; a pair of tiles is compared, by exclusive-or and bit counts, only where their
    population counts come within the radius: |pop(x) - pop(y)| is never more than the distance of x
    and y.
    """
    a, b = _words(a), _words(b)
    ca, cb = (np.bitwise_count(x).sum(axis=1, dtype=np.int32) for x in (a, b))
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    pa_, pb = ca[oa], cb[ob]
    left, right = [], []
    for i in range(0, len(a), side):
        x, px = a[oa[i : i + side]], pa_[i : i + side]
        lo, hi = np.searchsorted(pb, px[0] - radius), np.searchsorted(pb, px[-1] + radius, side="right")
        for j in range(lo, hi, side):
            y = b[ob[j : min(j + side, hi)]]
            away = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            for w in range(1, a.shape[1]):
                away = away + np.bitwise_count(x[:, None, w] ^ y[None, :, w]).astype(np.uint16)
            p, q = np.nonzero(away <= radius)
            left.append(oa[i + p])
            right.append(ob[j + q])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of edges that connect distinct fingerprints exactly as all links of at most ``radius`` bits do.

    Where links are few they are the edges; in dense groups a search from each unreached fingerprint
    joins what it reaches to it, so that there are never more edges than 4 a fingerprint.
    """
    sparse = len(fp) <= 64
    if not sparse:
        sample = fp[:: max(1, len(fp) // 256)]
        sparse = len(near(sample, fp, radius)[0]) <= 3 * len(sample)
    if sparse:
        a, b = near(fp, fp, radius)
        keep = a < b
        if keep.sum() <= 4 * len(fp):
            return a[keep], b[keep]
    root = np.full(len(fp), -1)
    for s in range(len(fp)):
        if root[s] >= 0:
            continue
        root[s], front = s, np.array([s])
        while len(front):
            free = np.flatnonzero(root < 0)
            if not len(free):
                break
            reached = []
            for i in range(0, len(front), 256):
                hit = np.unique(near(fp[front[i : i + 256]], fp[free], radius)[1])
                reached.append(free[hit])
                free = np.delete(free, hit)
            front = np.concatenate(reached)
            root[front] = s
    child = np.flatnonzero(root != np.arange(len(fp)))
    return root[child], child


def _linker(radius: int) -> Callable:
    """Reads rows (grp, node, fp) that are sorted by group; emits edges of nodes."""

    def of(groups: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        a, b = [], []
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)]))
        for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
            if hi - lo < 2:
                continue
            part = rows.slice(lo, hi - lo)
            codes = part.column("node").combine_chunks().dictionary_encode().indices.to_numpy()
            own = np.unique(codes, return_index=True)[1]  # a node may be there on both sides of a pair of tiles
            x, y = links(_bits(part.column("fp"))[own], radius)
            a.append(own[x] + lo)
            b.append(own[y] + lo)
        at = lambda x: rows.column("node").take(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))).combine_chunks()
        return pa.RecordBatch.from_arrays([at(a), at(b)], ["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("grp").to_numpy(zero_copy_only=False)
            whole = int(np.searchsorted(g == g[-1], True))  # the last group may go on
            t = pa.Table.from_batches([batch])
            if whole or (kept and kept[0].column("grp")[0].as_py() != g[0]):
                done_ = pa.concat_tables([*kept, t.slice(0, whole)])
                yield of(done_.column("grp").to_numpy(), done_)
                kept = []
            kept.append(t.slice(whole))
        if kept:
            rest = pa.concat_tables(kept)
            yield of(rest.column("grp").to_numpy(), rest)

    return link


def _bits(fp: pa.ChunkedArray) -> np.ndarray:
    """Fingerprints of a column of longs, or of binary strings of one length, as 64-bit words."""
    if pa.types.is_integer(fp.type):
        return fp.to_numpy().view(np.uint64)
    return np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(len(fp), -1)


def tiled_edges(keyed: DataFrame, prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b) of nodes that connect all nodes with a key in common as all links within ``radius`` do.

    keyed: (node, grp), a row for each key of a node; prints: (node, fp, pop), one row a node, pop the
    population count of its fingerprint fp. Nodes of one key are compared in a task. A key with more
    than ``tile`` nodes is cut into tiles by population count, and pairs of its tiles whose counts are
    within the radius go to tasks of their own.
    """
    node = keyed.schema["node"].dataType.simpleString()
    sizes = written(keyed.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    sized = sizes.where(F.col("n") > tile)
    link = _linker(radius)

    def linked(df: DataFrame) -> DataFrame:
        return df.select("grp", "node", "fp").repartition("grp").sortWithinPartitions("grp").mapInArrow(link, f"a {node}, b {node}")

    # Fingerprints, which may be long, join what is left of the keys.
    found = linked(keyed.join(sizes.where(F.col("n") <= tile), "grp", "left_semi").join(prints, "node"))
    if not sized.isEmpty():
        hot = keyed.join(sized, "grp", "left_semi").join(prints, "node")
        per = hot.groupBy("grp", "pop").agg(F.ceil(F.count("*") / tile).cast("long").alias("parts"))
        tiles = written(per.select("grp", "pop", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")), "tiles")
        a, b = tiles.alias("a"), tiles.alias("b")
        before = (F.col("a.pop") < F.col("b.pop")) | ((F.col("a.pop") == F.col("b.pop")) & (F.col("a.part") <= F.col("b.part")))
        pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("b.pop") - F.col("a.pop") <= radius) & before)
        pair = F.xxhash64("a.grp", "a.pop", "a.part", "b.pop", "b.part").alias("pair")
        ends = pairs.select("a.grp", pair, F.explode(F.array_distinct(F.array(F.struct("a.pop", "a.part", "a.parts"), F.struct("b.pop", "b.part", "b.parts")))).alias("t"))
        ends = ends.select("grp", "pair", "t.*")
        dealt = hot.join(per, ["grp", "pop"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        found = found.unionByName(linked(dealt.join(ends.drop("parts"), ["grp", "pop", "part"]).select(F.col("pair").alias("grp"), "node", "fp")))
    return written(found.where(F.col("a") != F.col("b")).distinct(), "near-edges")


def near_edges(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` of ``distinct`` as all links within ``radius`` do.

    Bits are cut into ``radius + 3`` blocks. Fingerprints within ``radius`` bits agree on at least three
    of them, so only those that have one choice of three blocks, and its bits, in common are ever
    compared: a plain grid of tiles over everything, which grows with the square of the table, isn't
    needed, and no link is lost. With a radius of 4 that is 35 choices of 27 bits or so: of n random
    fingerprints each meets about n / 4,000,000.
    """
    n = radius + 3
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) - (1 << 64 if sum(c) >> 63 else 0) for c in combinations(blocks, 3)]
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]
    prints = distinct.select(F.col("fp").alias("node"), "fp", F.bit_count("fp").alias("pop"))
    return tiled_edges(distinct.select(F.col("fp").alias("node"), F.explode(F.array(*keys)).alias("grp")), prints, radius, tile)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): root is the smallest node that a node reaches.

    Large stars and small stars in turn until nothing changes: each round joins edges with the
    smallest neighbour of each node, which partial aggregation finds even at a hub with a third of
    all edges; it is written, so that the join deals out edges anew and can split those of a hub. The
    number of rounds grows with the logarithm of the longest chain. Only a count and a checksum of the
    edges reach the driver.
    """
    cur = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "cc")
    seen = None
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(lower, "u")
        nxt = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        before, cur = cur, written(nxt.where("u > v").distinct(), "cc")
        done(before, least, large, lower)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (the fingerprint as a long), component_id.

    Fingerprints are compared once each, however many documents share one. component_id is the
    smallest doc_id that links reach. Null texts count as empty and texts without words have
    fingerprint 0, linked like any other. Null ids stay and are passed over as component ids (a
    component of null ids only has a null one); repeated rows give repeated results; an empty table
    gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    prints = written(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    edges = near_edges(distinct.select("fp"), radius, tile)
    out = _with_components(prints.withColumnRenamed("fp", "key"), distinct.select(F.col("fp").alias("key"), F.col("fp").alias("node"), "first_id"), edges)
    return out.withColumnRenamed("key", "fp")


def near_duplicates_by_key(docs: DataFrame) -> DataFrame:
    """near_duplicates with its fingerprint as ``key``: for one_of_each."""
    return near_duplicates(docs).withColumnRenamed("fp", "key")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: see near_duplicates."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Wide fingerprints: words of 64 bits, and the keys by which near copies meet, each of so many least hashes.
WIDE, KEYS, LEAST = 8, 12, 4


def _spread(n: int, seed: int) -> np.ndarray:
    """n odd numbers of 64 bits, far apart: steps of a SplitMix generator."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mixed(x) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SALTS, _FACTORS = _spread(WIDE, 1), _spread(KEYS * LEAST, 2)


def wide_fingerprint(text: str | None, words: int = 5) -> tuple[bytes, list[int]]:
    """512 SimHash bits of the set of a text's word shingles, and KEYS hashes of LEAST least shingle hashes each.

    Shingles that occur twice count once. Null and texts without words give bits 0 and one key of their own.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return bytes(8 * WIDE), [0]
    digest = xxhash.xxh64_intdigest
    h = np.array(list({digest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))}), np.uint64)
    ones, least = np.zeros(64 * WIDE, np.int64), np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for i in range(0, len(h), 1 << 13):
        part = h[i : i + (1 << 13), None]
        ones += np.unpackbits(mixed(part ^ _SALTS).astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (part * _FACTORS).min(axis=0))
    rows = least.astype("<u8").reshape(KEYS, LEAST)
    return np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), [digest(r.tobytes(), k) - 2**63 for k, r in enumerate(rows)]


def _wide_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [wide_fingerprint(t) for t in texts_of(b.column("text"))]
        pop = [int.from_bytes(fp, "little").bit_count() for fp, _ in got]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fp for fp, _ in got], pa.binary()), pa.array(pop, pa.int32()), pa.array([k for _, k in got], pa.list_(pa.int64()))], ["doc_id", "fp", "pop", "keys"])


def radius_of(similarity: float, bits: int = 64 * WIDE) -> int:
    """The distance within which sets of that Jaccard similarity lie but for one in some thousands.

    Sets of like size and similarity s have a cosine of 2s / (1 + s); each bit differs with probability
    angle / pi. Three and a half deviations are added to the mean.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + 3.5 * math.sqrt(bits * p * (1 - p)))


def near_copies(docs: DataFrame, similarity: float = 0.8, tile: int = TILE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, key, component_id: documents whose sets of five-word shingles are alike.

    64 bits can't tell a similarity of 0.8 from one of 0.5, so fingerprints have 512, and two link
    within ``radius_of(similarity)``: at 0.8 that is 105 bits, which pairs of 0.8 exceed once in 4,000
    times, and within which pairs of 0.7 lie in three of four cases, of 0.6 in one of ten, of 0.5 hardly
    ever. Which fingerprints are compared is up to their keys: texts of similarity s have one of the 12
    in common with probability 1 - (1 - s**4)**12, which is 0.998 at 0.8 and 0.9999 at 0.9. Keys with
    many documents are compared by tiles, as in near_duplicates. Exact copies have one fingerprint and are
    compared once.

    component_id is the smallest doc_id that links reach; key stands for the fingerprint. Nulls, texts
    without words, repeated rows, empty tables and other columns are dealt with as in near_duplicates.
    """
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    prints = rows.mapInArrow(_wide_fingerprints, "doc_id long, fp binary, pop int, keys array<bigint>")
    prints = written(prints.withColumn("key", F.unhex(F.md5("fp"))), "wide-fingerprints")
    distinct = prints.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min("fp").alias("fp"), F.min("pop").alias("pop"), F.min("keys").alias("keys"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-fingerprints")
    edges = tiled_edges(distinct.select("node", F.explode("keys").alias("grp")), distinct.select("node", "fp", "pop"), radius_of(similarity), tile)
    return _with_components(prints.select("doc_id", "key"), distinct.select("key", "node", "first_id"), edges)


def _with_components(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (doc_id, key) with the smallest doc_id that the node of their key reaches. distinct: (key, node, first_id)."""
    cc = written(components(edges), "components").withColumnRenamed("node", "at")
    rooted = distinct.join(cc, F.col("node") == F.col("at"), "left").select("key", "first_id", F.coalesce("root", "node").alias("root"))
    # Written, so that the join with a root that many fingerprints reach can be split, or isn't shuffled at all.
    ids = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    per_print = written(rooted.join(ids, "root").select("key", "component_id"), "fingerprint-components")
    return prints.join(per_print, "key").select("doc_id", "key", "component_id")


def one_of_each(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = near_copies) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the component_id that ``find`` gives, once each; all columns stay.

    Rows with a null doc_id stay if no document with an id is near, one for each component.
    """
    found = written(find(docs), "near-copies")
    known = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    own = docs.where(F.col("doc_id").isNotNull())
    # Ids to keep grow with the documents: by this hint they are never broadcast, at no size.
    kept = own.join(known.hint("merge"), "doc_id", "left_semi")
    kept = kept.dropDuplicates(["doc_id"]) if _repeats(found) else kept
    if found.where(F.col("component_id").isNull()).isEmpty():
        return kept
    bare = docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"])
    name = F.xxhash64(F.coalesce("text", F.lit("")))
    named = written(find(bare.select(name.alias("doc_id"), "text")), "near-copies")
    free = found.where(F.col("component_id").isNull()).select("key").distinct()
    names = named.where(F.col("doc_id") == F.col("component_id")).join(free, "key", "left_semi").select(F.col("doc_id").alias("__name")).distinct()
    return kept.unionByName(bare.withColumn("__name", name).join(names, "__name", "left_semi").drop("__name"))


def _repeats(found: DataFrame) -> bool:
    return not found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count().where("count > 1").isEmpty()
