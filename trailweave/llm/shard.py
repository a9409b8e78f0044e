"""Sharding by a k-d tree over row metadata, cut at distributed weighted medians."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.llm.work import BROADCAST_BYTES, done, literal_side, written

#: Rows of a shard that one task numbers at most, on average.
ROWS_PER_CHUNK = 1_000_000


def ordinal(c: Column) -> Column:
    """A number that orders strings by their first six bytes; null gives 0."""
    return F.coalesce(F.conv(F.rpad(F.substring(F.hex(c), 1, 12), 12, "0"), 16, 10).cast("double"), F.lit(0.0))


def number(c: Column) -> Column:
    """A finite double; null, NaN and infinities give 0."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(d)


def _double(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def _assigned(tree: dict, n: int, name: Callable[[int], int]) -> str:
    """SQL for the node that a row comes to from node n: one comparison for each level."""
    if n not in tree:
        return str(name(n))
    x, cut, tie, below, above = tree[n]
    return f"CASE WHEN {x} < {_double(cut)} OR ({x} = {_double(cut)} AND __kd_t <= {_double(tie)}) THEN {_assigned(tree, below, name)} ELSE {_assigned(tree, above, name)} END"


def _crossing(hist: DataFrame) -> list:
    """Of each node's buckets (b, w, n, lo, hi) that in which the weight before it comes to ``target``, or the last.

    hist: also node, target, acc (the weight before the first bucket) and what else is one a node. One
    row a node reaches the driver.
    """
    w = W.partitionBy("__kd_node").orderBy("b")
    end = F.col("acc") + F.sum("w").over(w)
    row = F.struct(*[c for c in hist.columns if c not in ("__kd_node", "b", "acc")], (F.col("end") - F.col("w")).alias("acc"))
    per = hist.withColumn("end", end).groupBy("__kd_node")
    picked = per.agg(F.coalesce(F.min_by(F.when(F.col("end") >= F.col("target"), row), F.when(F.col("end") >= F.col("target"), F.col("b"))), F.max_by(row, "b")).alias("r"))
    return picked.select("__kd_node", "r.*").collect()


def _bucket(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    span = F.when(hi > lo, hi - lo).otherwise(1.0)
    return F.least(F.floor((v - lo) / span * buckets), F.lit(buckets - 1))


_SUMS = (F.sum, "__kd_w", "w"), (F.count, "__kd_w", "n"), (F.min, "v", "lo"), (F.max, "v", "hi")


def _cuts(cur: DataFrame, share: dict[int, float], ranges: list[tuple[str, float, float]], buckets: int, fine: float) -> dict:
    """Cuts of the nodes in ``share``: node -> (column, value, tie). Rows up to the cut weigh ``share`` of the node.

    The first pass sums weights of all dimensions into ``buckets`` equal ranges of what all rows span. The
    widest dimension of a node and the range that holds its cut are known from that. Further passes go on
    inside that range, until what is left in doubt weighs at most ``fine`` or is one row. Of rows with one
    value, their hashes decide.
    """
    spark, sums = cur.sparkSession, [f(c).alias(name) for f, c, name in _SUMS]
    ask = literal_side(spark, list(share.items()), ["__kd_node", "share"], ["int", "double"])
    each = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(x).alias("v"), F.lit(lo).alias("from"), F.lit(hi).alias("to")) for i, (x, lo, hi) in enumerate(ranges)])
    rows = cur.join(ask, "__kd_node").select("__kd_node", "share", "__kd_w", F.inline(each))
    hist = rows.groupBy("__kd_node", "share", "dim", _bucket(F.col("v"), F.col("from"), F.col("to"), buckets).alias("b"), (F.col("to") - F.col("from")).alias("all")).agg(*sums)
    one, node = W.partitionBy("__kd_node", "dim"), W.partitionBy("__kd_node")
    span = (F.max("hi").over(one) - F.min("lo").over(one)) / F.when(F.col("all") > 0, F.col("all")).otherwise(1.0)
    wide = hist.withColumns({"target": F.sum("w").over(one) * F.col("share"), "span": span}).withColumn("best", F.max(F.struct("span", -F.col("dim"))).over(node)).where(F.col("dim") == -F.col("best.col2"))
    got = _crossing(wide.select("__kd_node", "dim", "target", F.lit(0.0).alias("acc"), "b", "w", "n", "lo", "hi"))
    state = {r["__kd_node"]: {"dim": r["dim"], "value": None, "target": r["target"]} for r in got}
    cuts = {}
    while True:
        for r in got:
            n, s = r["__kd_node"], state[r["__kd_node"]]
            point = r["lo"] == r["hi"]
            if r["w"] <= fine or (point and (s["value"] is not None or r["n"] == 1)):
                before = abs(r["acc"] - s["target"]) <= abs(r["acc"] + r["w"] - s["target"])
                edge = math.nextafter(r["lo"], -math.inf) if before else r["hi"]
                x = ranges[s["dim"]][0]
                cuts[n] = (x, edge, 1e300) if s["value"] is None else (x, s["value"], edge)
                del state[n]
            elif point:
                s |= {"value": r["lo"], "lo": 0.0, "hi": 2.0**53, "acc": r["acc"]}
            else:
                s |= {"lo": r["lo"], "hi": r["hi"], "acc": r["acc"]}
        if not state:
            return cuts
        asked = [(n, s["dim"], s["value"], s["lo"], s["hi"], s["acc"], s["target"]) for n, s in state.items()]
        ask = literal_side(spark, asked, ["__kd_node", "dim", "value", "from", "to", "acc", "target"], ["int", "int", *["double"] * 5])
        x = F.element_at(F.array(*[F.col(x) for x, _, _ in ranges]), F.col("dim") + 1)
        v = F.when(F.col("value").isNull(), x).otherwise(F.col("__kd_t"))
        inside = cur.join(ask, "__kd_node").where(F.col("value").isNull() | (x == F.col("value"))).withColumn("v", v).where("v BETWEEN from AND to")
        hist = inside.groupBy("__kd_node", "target", "acc", _bucket(F.col("v"), F.col("from"), F.col("to"), buckets).alias("b")).agg(*sums)
        got = _crossing(hist)


def kd_shards(
    df: DataFrame,
    weight: Column,
    dims: list[Column],
    identity: list[Column],
    *,
    shards: int | None = None,
    target_bytes: int | None = None,
    buckets: int = 256,
    tolerance: float = 1e-3,
    inline: int = 256,
) -> DataFrame:
    """Adds ``shard`` (0..) and ``slot`` (0.. without gaps in each shard) to the rows of ``df``.

    A node of the tree stands for some number of shards; it is cut where its weight divides in the
    proportion of the shards on either side, along the dimension in which its rows spread widest
    (its range, as a share of that of all rows). All nodes of a level are cut together, in about two
    passes over the narrow rows: histograms of ``buckets`` ranges, and again of the range that holds the
    cut, until that weighs at most ``tolerance`` of a shard (see _cuts). Rows with one value, such as
    those of a hot source, are cut by a hash of ``identity``. The driver sees one row a node; rows never
    meet in one task.

    The tree so far is one expression, a comparison a level, while it has at most ``inline`` cuts; beyond
    that each level's cuts are joined and the rows are written with their nodes.

    Nulls: a null dimension counts as 0, a null weight as 0. Repeated rows may be put into different
    shards. An empty table gives an empty result. ``df`` keeps its columns; pick narrow ones, as they
    are written once to the shared folder. Names that begin with ``__kd_`` are taken.
    """
    spark = df.sparkSession
    xs = [f"__kd_x{i}" for i in range(len(dims))]
    mine = F.shiftright(F.xxhash64(*identity), 34).cast("double") + 2.0**29
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 22)).cast("double")
    base = written(
        df.select(
            *[df[c] for c in df.columns],
            F.coalesce(weight.cast("double"), F.lit(0.0)).alias("__kd_w"),
            (mine * 2.0**22 + row).alias("__kd_t"),
            *[d.alias(x) for d, x in zip(dims, xs)],
            F.lit(0).alias("__kd_node"),
        ),
        "kd-rows",
    )
    total = base.agg(F.coalesce(F.sum("__kd_w"), F.lit(0.0)).alias("w"), F.count("*").alias("n"), *[f(x).alias(f"{k}{x}") for x in xs for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if shards is None:
        shards = max(1, math.ceil(total["w"] / target_bytes))
    ranges = [(x, total[f"lo{x}"], total[f"hi{x}"]) for x in xs]
    todo, free, first, tree, joined = {0: shards}, 1, {0: 0}, {}, False
    cur = base
    while total["n"] and (todo := {n: k for n, k in todo.items() if k > 1}):
        cuts = _cuts(cur, {n: (k // 2) / k for n, k in todo.items()}, ranges, buckets, tolerance * total["w"] / shards)
        after, level = {}, {}
        for n, cut in cuts.items():
            half = todo[n] // 2
            level[n] = (*cut, free, free + 1)
            after |= {free: half, free + 1: todo[n] - half}
            first |= {free: first[n], free + 1: first[n] + half}
            free += 2
        todo, tree = after, tree | level
        joined = joined or len(tree) > inline
        if joined:
            rows = [(n, int(x.removeprefix("__kd_x")), cut, tie, below, above) for n, (x, cut, tie, below, above) in level.items()]
            table = literal_side(spark, rows, ["__kd_node", "dim", "cut", "tie", "below", "above"], ["int", "int", "double", "double", "int", "int"])
            x = F.element_at(F.array(*xs), F.col("dim") + 1)
            low = (x < F.col("cut")) | ((x == F.col("cut")) & (F.col("__kd_t") <= F.col("tie")))
            to = F.when(F.col("dim").isNull(), F.col("__kd_node")).when(low, F.col("below")).otherwise(F.col("above"))
            nxt = written(cur.join(table, "__kd_node", "left").select(*base.columns[:-1], to.alias("__kd_node")), "kd-level")
            done(base)
            base = cur = nxt
        else:
            cur = base.withColumn("__kd_node", F.expr(_assigned(tree, 0, lambda n: n)))
    if joined:
        leaves = literal_side(spark, list(first.items()), ["__kd_node", "shard"], ["int", "int"])
        placed = cur.join(leaves, "__kd_node")
    else:
        placed = base.withColumn("shard", F.expr(_assigned(tree, 0, lambda n: first[n])).cast("int"))
    chunks = max(32, math.ceil((total["n"] or 0) / shards / ROWS_PER_CHUNK))
    placed = placed.withColumn("__kd_chunk", F.pmod(F.xxhash64("__kd_t"), F.lit(chunks)).cast("int"))
    counts = placed.groupBy("shard", "__kd_chunk").agg(F.count("*").alias("__kd_n"))
    offsets = counts.select("shard", "__kd_chunk", (F.sum("__kd_n").over(W.partitionBy("shard").orderBy("__kd_chunk")) - F.col("__kd_n")).alias("__kd_before"))
    # At most shards * chunks rows of three numbers: as small as the tree itself.
    offsets = F.broadcast(offsets) if shards * chunks * 24 <= BROADCAST_BYTES else offsets
    rank = F.row_number().over(W.partitionBy("shard", "__kd_chunk").orderBy("__kd_t"))
    return (
        placed.withColumn("__kd_rank", rank)
        .join(offsets, ["shard", "__kd_chunk"])
        .select(*df.columns, "shard", (F.col("__kd_before") + F.col("__kd_rank") - 1).cast("long").alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """All documents in ``shards`` shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The size of a document is the UTF-8 bytes of its text (null: none) plus 16; the tree's
    dimensions are doc_id, size, source and lang. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    meta = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        ordinal(docs["source"]).alias("source_at"),
        ordinal(docs["lang"]).alias("lang_at"),
    )
    dims = [number(meta["doc_id"]), meta["size"].cast("double"), meta["source_at"], meta["lang_at"]]
    out = kd_shards(meta, meta["size"], dims, [meta["doc_id"], meta["text_crc32"]], shards=shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
