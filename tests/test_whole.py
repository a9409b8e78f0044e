"""Queries do the whole job: results over all rows, worked out here from the tables without any cut."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trailweave.functions import vectors
from trailweave.operators import cluster
from trailweave.plans import catalog, q_graph


@pytest.fixture(scope="module")
def emb(sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").sort_by("vec_id")
    return t["vec_id"].to_numpy(), t["label"].to_numpy(), np.array(t["embedding"].to_pylist(), np.float64)


def test_graph_metrics_over_all_rows(spark, sf_dir, emb):
    ids, label, v = emb
    i, j = np.triu_indices(len(ids), 1)
    s, same = np.einsum("ij,ij->i", v[i], v[j]), label[i] == label[j]
    intra, cross = s[same].mean(), s[~same].mean()
    got = catalog.queries()["e2_graph_metrics"](spark, sf_dir).first()
    assert got.purity == pytest.approx(intra / (intra + cross), abs=1e-4)
    assert got.duplicate_rate == pytest.approx((s[~same] > 0.2).mean(), abs=1e-4)


def test_pair_statistics_do_not_depend_on_blocks(spark, sf_dir, emb):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    n = len(emb[0])
    for block in (64, 2048):
        rows = {r.same: r for r in vectors.pair_statistics(e, 0.2, block).collect()}
        assert rows[True].n + rows[False].n == n * (n - 1) // 2
        assert rows[False].over == int(((emb[2] @ emb[2].T > 0.2) & (emb[1][:, None] != emb[1])).sum()) // 2


def test_group_similarities_do_not_depend_on_blocks(spark, emb):
    e = spark.createDataFrame([(int(i), f"L{c}" if c else None, x.tolist()) for i, c, x in zip(*emb)] + [(-1, "L1", None)], "id long, label string, v array<double>")
    sims, label = emb[2] @ emb[2].T, emb[1]
    want = {(a, b): sims[np.ix_(label == a, label == b)] for a in set(label) for b in set(label) if 0 < a < b}
    for block in (50, 2048):
        got = {(r.a, r.b): r for r in vectors.group_similarities(e, block).collect()}
        assert set(got) == {tuple(sorted((f"L{a}", f"L{b}"))) for a, b in want}
        for (a, b), m in want.items():
            r = got[tuple(sorted((f"L{a}", f"L{b}")))]
            assert (r.n, r.most, r.total) == (m.size, pytest.approx(m.max()), pytest.approx(m.sum(), abs=1e-9))


def test_each_two_labels_meet_in_one_tile(spark, emb):
    """Labels of two rows and one of a hundred, in many blocks and a few cells a batch; without the large one, nothing is put together after the tiles."""
    ids, _, v = emb
    label = np.arange(len(ids)) // 2
    label[-100:] = 10**6
    sims = v @ v.T
    for rows in (len(ids) - 100, len(ids)):
        e = spark.createDataFrame([(int(i), int(c), x.tolist()) for i, c, x in list(zip(ids, label, v))[:rows]], "id long, label long, v array<double>")
        found = vectors.group_similarities(e, 96, 50)
        assert ("Aggregate" in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]) == (rows == len(ids))
        got = {(r.a, r.b): (r.n, r.most, r.total) for r in found.collect()}
        known = sorted(set(label[:rows].tolist()))
        assert len(got) == len(known) * (len(known) - 1) // 2
        for a, b in [(0, 1), (3, known[-2]), (known[-2], known[-1])]:
            m = sims[np.ix_(label[:rows] == a, label[:rows] == b)]
            assert got[a, b] == (m.size, pytest.approx(m.max()), pytest.approx(m.sum(), abs=1e-9))


@pytest.mark.parametrize("scale", [1.0, 1e25])
def test_best_matches_are_those_of_all_pairs(spark, scale):
    """Copies, near copies within the error of single precision, few and many items, many blocks; sums in order of the elements."""
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(40, 17))
    v = np.concatenate([base[rnd.integers(0, 40, 700)], base[:20] + 1e-9, rnd.normal(size=(300, 17)), np.zeros((5, 17))]) * scale
    ids = rnd.permutation(len(v))
    scores = np.array([np.cumsum(x * v, axis=1)[:, -1] for x in v])
    e = spark.createDataFrame([(f"r{i:04d}", x.tolist()) for i, x in zip(ids, v)], "id string, v array<double>")
    name = np.array([f"r{i:04d}" for i in ids])
    for few, block in ((len(v), 1 << 15), (len(v), 150), (30, 100)):
        got = {(r.query_id, r.rank): (r.id, r.score) for r in vectors.best_matches(e, e.where(f"id < 'r{few:04d}'"), 5, block).collect()}
        assert len(got) == 5 * len(v)
        there = np.flatnonzero(ids < few)
        for q in range(len(v)):
            order = there[np.lexsort((name[there], -scores[q, there]))[:5]]
            assert [got[name[q], r] for r in range(1, 6)] == [(name[i], scores[q, i]) for i in order]


def test_few_pairs_are_multiplied_in_double():
    """Of random vectors, little more than the best are left after single precision."""
    v = np.random.default_rng(1).normal(size=(3000, 32))
    hopeful = np.concatenate([np.stack(p, axis=1) for p in vectors._hopeful(v[:500], v, 5)])
    assert 2500 <= len(hopeful) < 2750
    assert set(map(tuple, hopeful.tolist())) >= {(q, i) for q, row in enumerate(v[:500] @ v.T) for i in np.argsort(-row)[:5].tolist()}


def test_recalibrated_thresholds_over_all_rows(spark, sf_dir, emb):
    v = emb[2]
    x, y = (v[:-2] * v[1:-1]).sum(1), np.sort((v[:-2] * v[2:]).sum(1))
    rows = catalog.queries()["a17_e7_recalibrated_thresholds"](spark, sf_dir).collect()
    assert sorted(r.old for r in rows) == [-0.9, 0.0, 0.1, 0.3]
    for r in rows:
        p = (x <= r.old).mean()
        new = max(0.0, r.old + y.mean() - x.mean()) if r.old <= np.quantile(x, 0.01) else np.quantile(y, p)
        assert r.percentile == pytest.approx(p, abs=1e-6) and r.new == pytest.approx(new, abs=1e-5)


@pytest.fixture(scope="module")
def swept(spark, sf_dir):
    return sorted(catalog.queries()["m1_m2_choose_k"](spark, sf_dir).collect())


def test_choose_k_tries_the_whole_sweep(swept):
    rows = swept
    assert [r.k for r in rows] == list(range(3, 13))
    assert [r.k for r in rows if r.best] == [max(rows, key=lambda r: (r.silhouette, -r.k)).k]


def test_every_row_has_one_cluster(spark, sf_dir, emb, swept):
    ids, _, v = emb
    rows = sorted(catalog.queries()["m2_cluster_assignment"](spark, sf_dir).collect())
    assert [r.vec_id for r in rows] == ids.tolist()
    k = next(r.k for r in swept if r.best)
    own = np.array([r.cluster for r in rows])
    assert set(own) == set(range(k))
    # A k-means result: nearly all rows are nearest to the mean of their own cluster.
    means = np.array([v[own == c].mean(0) for c in range(k)])
    near = ((v[:, None] - means) ** 2).sum(2).argmin(1)
    assert (near == own).mean() > 0.9


def test_clusters_of_clear_groups(spark):
    at = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    e = spark.createDataFrame([(i, [x + 0.01 * (i % 5), y + 0.01 * (i % 7)]) for i, (x, y) in enumerate(at * 20)], "id long, v array<double>")
    got = {r.id: r.cluster for r in cluster.clustered(e, "v", 3).collect()}
    assert len(got) == 60 and len({got[i] for i in range(3)}) == 3
    assert all(got[i] == got[i % 3] for i in got)


def test_scan_has_all_rows_in_order(spark, sf_dir, emb):
    ids, label, _ = emb
    found, *scan = catalog.queries()["s4_s5_lookup_and_scan"](spark, sf_dir).collect()
    assert (found.vec_id, found.label, found.position) == (42, label[ids.tolist().index(42)], None)
    assert [(r.vec_id, r.label, r.position) for r in scan] == [(i, c, n) for n, (i, c) in enumerate(zip(ids.tolist(), label.tolist()))]


def test_far_places_on_a_sparse_graph(spark, sf_dir, monkeypatch):
    """Places 9 to 16 in a row, and a heavy edge from 9 to 16."""
    run = range(9, 17)
    edges = [(i, i + 1, 100) for i in run[:-1]]
    of = lambda rows: lambda s, d: s.createDataFrame(rows, "src long, dst long, forward long")
    query = lambda name: catalog.queries()[name](spark, sf_dir).collect()
    monkeypatch.setattr(q_graph, "_nodes", lambda s, d: s.createDataFrame([(i,) for i in run], "id long"))
    monkeypatch.setattr(q_graph, "_edges", of(edges))
    assert {(r.src, r.dst): r.hops for r in query("g9_hop_distances")} == {(a, b): abs(a - b) for a in run for b in run}
    assert {r.dst: r.path for r in query("g10_fewest_hops")} == {i: ">".join(map(str, range(9, i + 1))) for i in run}
    e = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_type", "ts", "event_id").collect()
    jumps = {r.event_type: 0 for r in e}
    for a, b in zip(e, e[1:]):
        p, q = a.user_id % 40, b.user_id % 40
        jumps[b.event_type] += a.event_type == b.event_type and p in run and q in run and abs(p - q) > 1
    assert {r.event_type: r.jumps for r in query("w14_e8_false_jumps")} == jumps
    monkeypatch.setattr(q_graph, "_edges", of([*edges, (9, 16, 1)]))
    assert {r.dst: r.path for r in query("g10_shortest_paths")}[16] == "9>10>11>12>13>14>15>16"
