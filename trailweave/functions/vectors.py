"""Vectors as array columns. Sums run in double, in order of the elements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.shipping import ship


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either side is."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors; an unknown side is neutral: 0.5."""
    return F.coalesce(1.0 - dot(a, b), F.lit(0.5))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return F.transform(F.array(F.struct(doubles(v).alias("v"), norm(v).alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))[0]


def mean_subtracted(v: Column) -> Column:
    """The vector less its mean, with the mean (as a share of 255) appended, at unit length."""
    m = F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x) / F.size(v)
    tailed = F.transform(F.array(F.struct(doubles(v).alias("v"), m.alias("m"))), lambda s: F.concat(F.transform(s["v"], lambda x: x - s["m"]), F.array(s["m"] / 255.0)))[0]
    return l2_normalise(tailed)


def centroids(df: DataFrame, keys: list[str], vector: str, name: str = "centroid", unit: bool = True) -> DataFrame:
    """Mean vector of each group, at unit length unless ``unit`` is false.

    One partial sum for each group and dimension is shuffled, whatever the size of a group.
    """
    flat = df.select(*keys, F.posexplode(doubles(F.col(vector))).alias("__dim", "__x"))
    means = flat.groupBy(*keys, "__dim").agg(F.avg("__x").alias("__m"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("__dim", "__m"))), lambda s: s["__m"])
    out = means.groupBy(*keys).agg(ordered.alias(name))
    return out.withColumn(name, l2_normalise(F.col(name))) if unit else out


def tiles(df: DataFrame, block: int, by: Column | None = None) -> DataFrame:
    """Rows (id, ...) dealt into blocks of about ``block`` rows, and each sent to every pair of blocks that its own is in.

    Adds bucket, lo and hi; rows with equal (lo, hi) are one tile: two blocks, or one with itself.
    Rows with equal ``by`` (a hash; that of the id if none is given) are in one block.
    """
    n = max(1, -(-df.count() // block))
    at, other = F.col("bucket"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64("id") if by is None else by, F.lit(n)).cast("int")).withColumn("other", other)
    return dealt.withColumns({"lo": F.least(at, "other"), "hi": F.greatest(at, "other")}).drop("other")


def _tile(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a tile, and which rows are on its one side and which on the other."""
    v = np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
    bucket = t.column("bucket").to_numpy()
    return v, np.flatnonzero(bucket == t.column("lo")[0].as_py()), np.flatnonzero(bucket == t.column("hi")[0].as_py())


def pair_statistics(df: DataFrame, above: float, block: int = 2048) -> DataFrame:
    """Inner products of all pairs of rows (id, label, v) with different ids, by whether labels are equal.

    Returns same, n, total, squares, least, most, over: the pairs, the sum of their products and of their
    squares, the ends of their sorted list, and how many exceed ``above``. A task multiplies two blocks of
    ``block`` rows, and only sums leave it. Rows without an id, a label or a vector are in no pair.
    """
    ship(df.sparkSession)
    df = df.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")

    def summed(t: pa.Table) -> pa.Table:
        v, a, b = _tile(t)
        ids, label = t.column("id").to_numpy(), t.column("label").to_numpy()
        sims, same = v[a] @ v[b].T, label[a][:, None] == label[b]
        pair = ids[a][:, None] < ids[b] if a is b or np.array_equal(a, b) else np.ones(same.shape, bool)
        kinds = [(s, x) for s in (True, False) if len(x := sims[pair & (same == s)])]
        sums = {"n": len, "total": lambda x: float(x.sum()), "squares": lambda x: float((x * x).sum()), "least": lambda x: float(x.min()), "most": lambda x: float(x.max()), "over": lambda x: int((x > above).sum())}
        return pa.table({"same": pa.array([s for s, _ in kinds], pa.bool_())} | {k: pa.array([f(x) for _, x in kinds], pa.int64() if k in ("n", "over") else pa.float64()) for k, f in sums.items()})

    sums = tiles(df, block).groupBy("lo", "hi").applyInArrow(summed, "same boolean, n long, total double, squares double, least double, most double, over long")
    return sums.groupBy("same").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares", "over")], F.min("least").alias("least"), F.max("most").alias("most"))


def group_similarities(df: DataFrame, block: int = 2048, cells: int = 1 << 18) -> DataFrame:
    """For each two labels a < b of rows (id, label, v): n, total and most of the products of their rows.

    A task multiplies two blocks of rows, and one row for each two labels leaves it, about ``cells`` at a
    time. The rows of a label are in one block, so that each two labels meet once; only where labels have
    more than a sixteenth of a block are their rows spread, and what is found of two labels put together.
    Rows without an id, a label or a vector are in no pair.
    """
    ship(df.sparkSession)
    df = df.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    kind = df.schema["label"].dataType.simpleString()
    large = df.groupBy("label").count().where(F.col("count") > max(1, block // 16)).select("label", F.lit(True).alias("__large"))
    spread = large.count()
    by = F.xxhash64("label")
    if spread:
        df = df.join(F.broadcast(large) if spread <= 1 << 16 else large, "label", "left")
        by = F.when(F.col("__large"), F.xxhash64("id")).otherwise(by)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        v, a, b = _tile(t)
        order = t.column("label").combine_chunks().dictionary_encode()
        values, code = order.dictionary, order.indices.to_numpy().astype(np.int64)

        def runs(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            side = side[np.argsort(code[side], kind="stable")]
            first = np.flatnonzero(np.diff(code[side], prepend=-1))
            return side, first, code[side][first]

        (x, fx, cx), (y, fy, cy) = runs(a), runs(b)
        if not (len(x) and len(y)):
            return
        nx, ny = np.diff(fx, append=len(x)), np.diff(fy, append=len(y))
        own, other, step = np.array_equal(a, b), v[y].T, max(1, cells // len(cy))
        for s in range(0, len(cx), step):
            e = min(s + step, len(cx))
            sims = v[x[fx[s] : fx[e - 1] + nx[e - 1]]] @ other
            i, j = (m.ravel() for m in np.meshgrid(cx[s:e], cy, indexing="ij"))
            # Of one block with itself both orders of two labels are there: one of them counts.
            keep = np.flatnonzero(i < j if own else i != j)
            fold = lambda f: f.reduceat(f.reduceat(sims, fx[s:e] - fx[s], axis=0), fy, axis=1).ravel()[keep]  # noqa: B023, E731
            found = [values.take(pa.array(i[keep])), values.take(pa.array(j[keep])), np.outer(nx[s:e], ny).ravel()[keep], fold(np.add), fold(np.maximum)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["a", "b", "n", "total", "most"])

    found = tiles(df, block, by).select("label", "v", "bucket", "lo", "hi").groupBy("lo", "hi").applyInArrow(folded, f"a {kind}, b {kind}, n long, total double, most double")
    ends = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", "total", "most")
    if not spread:
        return ends
    return ends.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one width as rows of doubles."""
    lists = column.combine_chunks()
    flat = lists.flatten()
    if lists.null_count or flat.null_count or len(lists) and len(set(np.diff(lists.offsets.to_numpy()).tolist())) != 1:
        raise ValueError("vectors must be there, of one width, and without gaps")
    return np.asarray(flat, np.float64).reshape(len(lists), -1)


def _first_copies(y: np.ndarray, k: int) -> np.ndarray:
    """The rows without those that have ``k`` equal ones before them."""
    kind = np.unique(np.ascontiguousarray(y).view(f"V{y.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel() if y.shape[1] else np.zeros(len(y), np.int64)
    order = np.argsort(kind, kind="stable")
    start = np.flatnonzero(np.diff(kind[order], prepend=-1))
    nth = np.arange(len(y)) - np.repeat(start, np.diff(start, append=len(y)))
    return np.sort(order[nth < k])


def _hopeful(x: np.ndarray, y: np.ndarray, k: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``x`` and ``y`` among which are the ``k`` best of each row of ``x``, a few rows of it at a time.

    Products in single precision, whose error has a bound. Rows of ``y`` are in groups; the k-th best of the
    groups' best bounds the k-th best of all from below, and only groups that reach it are looked at.
    """
    size, most = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1).max()
    if not size.max() * most < 1e30 or not max(size.max(), most) < 1e30:
        # Not finite, or too large for single precision.
        for s in range(0, len(x), rows):
            best = np.argsort(-(x[s : s + rows] @ y.T), axis=1, kind="stable")[:, :k]
            yield np.repeat(np.arange(s, s + len(best)), best.shape[1]), best.ravel()
        return
    wide = min(64, max(1, len(y) // (8 * k)))
    groups = -(-len(y) // wide)
    a, b = x.astype(np.float32), np.zeros((groups * wide, y.shape[1]), np.float32)
    b[: len(y)] = y
    slack = (2.0 * (x.shape[1] + 8) * 2.0**-24 * size * most + 1e-36)[:, None]
    for s in range(0, len(a), rows):
        sims = a[s : s + rows] @ b.T
        sims[:, len(y) :] = -np.inf
        sims = sims.reshape(len(sims), wide, groups)
        top = sims.max(axis=1)
        least = np.partition(top, groups - k, axis=1)[:, groups - k, None] if groups > k else np.full((len(top), 1), -np.inf)
        least = least - slack[s : s + rows]
        r, g = np.nonzero(top >= least)
        at, in_group = np.nonzero(sims[r, :, g] >= least[r])
        i = in_group * groups + g[at]
        there = i < len(y)
        yield s + r[at][there], i[there]


def _best(x: np.ndarray, y: np.ndarray, k: int, pairs: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``k`` rows of ``y`` with the greatest products with each row of ``x``, of equals the first, and the products.

    Sums run in order of the elements, so that equal rows have equal products.
    """
    for q, i in _hopeful(x, y, k):
        score = np.empty(len(q))
        for s in range(0, len(q), pairs):
            score[s : s + pairs] = np.cumsum(x[q[s : s + pairs]] * y[i[s : s + pairs]], axis=1)[:, -1] if x.shape[1] else 0.0
        order = np.lexsort((i, -score, q))
        q = q[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        keep = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q))) < k
        yield q[keep], i[order][keep], score[order][keep]


def best_matches(queries: DataFrame, items: DataFrame, k: int, block: int = 1 << 15) -> DataFrame:
    """Exact k best items of each query by inner product: (query_id, rank, id, score), ties to the smaller id.

    Both sides are dealt into blocks, of ``block`` rows at most, and each task keeps the k best of one block of
    items for each query of one block, by products in single precision and then, of those that may be among
    them, in double; a window over those few picks the k best of all. Both sides may be of any size.
    """

    ship(queries.sparkSession)

    def blocks(n: int) -> int:
        # Rows are sent once to each block of the other side; of smaller tables there are more blocks than cores.
        return max(1, -(-n // block), min(16, -(-n // 4096)))

    def dealt(df: DataFrame, n: int, mine: str, other: str, others: int) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    nq, ni = (blocks(d.count()) for d in (queries, items))
    q, it = dealt(queries, nq, "bq", "bi", ni), dealt(items, ni, "bi", "bq", nq)

    def top(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            b = b.sort_by("id")
            y = _matrix(b.column("v"))
            first = _first_copies(y, k)
            found = [(q, first[i], score) for q, i, score in _best(_matrix(a.column("v")), y[first], k)]
        q, i, score = (np.concatenate([np.zeros(0, t), *c]) for t, c in zip((np.int64, np.int64, np.float64), zip(*found) if found else ((), (), ())))
        return pa.table({"query_id": a.column("id").take(pa.array(q)), "id": b.column("id").take(pa.array(i)), "score": pa.array(score)})

    tq, ti = (d.schema["id"].dataType.simpleString() for d in (queries, items))
    best = q.groupBy("bq", "bi").cogroup(it.groupBy("bq", "bi")).applyInArrow(top, f"query_id {tq}, id {ti}, score double")
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
