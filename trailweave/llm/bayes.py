"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.work import BROADCAST_BYTES, ship, small_side, texts_of, written

#: Labelled documents that the classifier is fitted on at most: those of least hash.
SAMPLE = 20_000
NAMES = ("bias", "log_words", "word_bytes", "symbols", "upper", "digits", "stops", "high", "pipes", "bangs", "repeats", "short_lines")
_SYMBOLS = list(b"#*$%&|<>")


def evidence(text: str | None) -> list[float]:
    """Numbers about a whole text, in the order of NAMES; null counts as empty."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(b))
    h = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    words = b.lower().split()
    k = max(1, len(words))
    share = lambda x: float(h[x].sum()) / n
    lines = b.count(b"\n") + 1
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    return [1.0, float(np.log1p(len(words))), min(20.0, n / k), share(_SYMBOLS), share(slice(65, 91)), share(slice(48, 58)), share([46, 44]), share(slice(128, 256)), share([124]), share([33]), 1.0 - pairs, min(1.0, lines / k)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method with a ridge penalty, on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[0] = 0.0, 1.0
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - ridge * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = w / scale
    out[0] -= (w[1:] * mean[1:] / scale[1:]).sum()
    return out


def _scorer(weights: np.ndarray) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([evidence(t) for t in texts_of(b.column("text"))]).reshape(-1, len(NAMES))
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(p)], [*rest, "p_doc"])

    return score


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """Weights fitted on at most ``most`` labelled documents, chosen by a hash of doc_id.

    Contradictory labels of a document count as bad. Of rows that repeat a doc_id one counts, that with the
    least numbers; so at most ``most`` rows reach the driver. Without both classes the weights say even odds.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` ids: texts needn't move to meet them.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked) if most * 32 <= BROADCAST_BYTES else picked, "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [evidence(t) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    quality = rows.schema["quality"].dataType.simpleString()
    found = rows.select("doc_id", "quality", "text").mapInArrow(features, f"doc_id {kind}, quality {quality}, x array<double>")
    got = found.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()
    y = got["quality"].to_numpy(dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(len(NAMES))
    order = np.lexsort((y, got["doc_id"].to_numpy()))
    return fit(np.stack(got["x"].to_numpy())[order], y[order])


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(q / (1 - q))


def site_posteriors(scored: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Posterior quality of each (host, path), shrunk to its host's, which is shrunk to the global mean.

    Each document adds its classifier probability to its path. The strength of each prior is the
    beta distribution's that matches the variance between groups, found by the method of moments:
    what groups of their sizes would vary by chance is taken off. Grouped sums alone are used: per
    path first, per host from paths, and the global moments from hosts.

    Null hosts and paths are groups like any other. Rows with a null p_doc say nothing: they don't count,
    and groups of such rows alone are left out. An empty table gives an empty result.
    """
    paths = written(scored.where(F.col("p_doc").isNotNull()).groupBy(host, path).agg(F.sum("p_doc").alias("s"), F.count("*").alias("n")), "paths")
    hosts = written(paths.groupBy(host).agg(F.sum("s").alias("hs"), F.sum("n").alias("hn")), "hosts")

    def moments(df: DataFrame, s: str, n: str) -> tuple[float, float]:
        m = df.agg(F.sum(s).alias("s"), F.sum(n).alias("n"), F.count("*").alias("g"), F.sum(F.col(s) * F.col(s) / F.col(n)).alias("q"), F.sum(F.col(n).cast("double") * F.col(n)).alias("n2")).first()
        if not m["n"]:
            return 0.5, 1.0
        mu = m["s"] / m["n"]
        within = mu * (1 - mu)
        between = (m["q"] - m["s"] * mu - (m["g"] - 1) * within) / max(1.0, m["n"] - m["n2"] / m["n"])
        strength = within / between - 1 if between > 1e-9 else 1e6
        return mu, float(min(1e6, max(1.0, strength)))

    mu, k_host = moments(hosts, "hs", "hn")
    _, k_path = moments(paths, "s", "n")
    posts = hosts.select(F.col(host).alias("__host"), ((F.lit(k_host * mu) + F.col("hs")) / (F.lit(k_host) + F.col("hn"))).alias("host_post"))
    joined = paths.join(posts, F.col(host).eqNullSafe(F.col("__host")))
    return joined.select(host, path, "host_post", ((F.lit(k_path) * F.col("host_post") + F.col("s")) / (F.lit(k_path) + F.col("n"))).alias("path_post"), F.lit(mu).alias("mean"))


def quality_posteriors(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, p_doc, host_post, path_post, posterior, kept.

    Hosts are sources and paths their languages. A document's posterior odds are its classifier's,
    with the base rate of all documents exchanged for that of its path. Texts are read once for the
    scores, which are written; sites meet them by a join that splits hot sites (or a broadcast, where
    the counted sites are few).

    Null texts count as empty, null sources and languages are sites of their own, repeated rows count
    and are scored each, an empty table gives an empty result, and without labels all is even odds.
    Other columns are not read.
    """
    ship(docs.sparkSession)
    weights = train(docs, labels, sample)
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("host"), docs["lang"].alias("path"), docs["text"].alias("text"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "host", "path"))
    scored = written(rows.mapInArrow(_scorer(weights), f"{kinds}, p_doc double"), "scores")
    sites = site_posteriors(scored)
    sites = small_side(sites.select(F.col("host").alias("h"), F.col("path").alias("l"), "host_post", "path_post", "mean"), 256)
    out = scored.join(sites, scored["host"].eqNullSafe(F.col("h")) & scored["path"].eqNullSafe(F.col("l")))
    odds = _logit(F.col("p_doc")) + _logit(F.col("path_post")) - _logit(F.col("mean"))
    post = 1 / (1 + F.exp(-odds))
    return out.select("doc_id", F.round("p_doc", 6).alias("p_doc"), F.round("host_post", 6).alias("host_post"), F.round("path_post", 6).alias("path_post"), F.round(post, 6).alias("posterior"), (post >= keep_at).alias("kept"))
