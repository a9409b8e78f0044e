"""The pipeline against a plain version of its stages, on small tables."""

import numpy as np
from pyspark.sql import functions as F
from test_operators import DOCS, brute_spans, distance, jaccard, slow_features

import corpus_pipeline
from trailweave.llm import decontam, rules
from trailweave.llm.work import written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in out.collect()}
        out = written(stage(spark, out, sf_dir), "test")
        after = {r.doc_id: r for r in out.collect()}
        if name != names[-1]:
            assert out.columns == columns
        if name == "quality_rules":
            f = {i: slow_features(r.text) for i, r in before.items()}
            base = {i for i, x in f.items() if not (x[0] < 10 or 100 * x[4] > 20 * x[0])}
            verdict = {r.doc_id for r in rules.quality_report(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").collect()}
            assert set(after) == verdict <= base
        elif name == "near_duplicates":
            # No two like documents stay, and none goes without a like one with a smaller id.
            like = {(i, j): jaccard(before[i].text, before[j].text) for i in before for j in before if i < j}
            assert not any(s >= 0.8 and i in after and j in after for (i, j), s in like.items())
            assert len(after) < len(before)
            assert all(any(j == k and s > 0.45 for (_, j), s in like.items()) for k in set(before) - set(after))
        elif name == "decontamination":
            items = [decontam.normalised(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            held = lambda t: any(p[:20] in t or p[-20:] in t or p[60:80] in t for p in items) and any(distance(p, t) <= decontam.budget(p, decontam.ERROR_RATE) for p in items if p[:20] in t or p[-20:] in t or p[60:80] in t)
            assert set(after) == {i for i, r in before.items() if not held(decontam.normalised(r.text))}
        elif name == "secret_scan":
            assert set(after) == set(before)
            for i, r in after.items():
                assert not brute_spans(r.text) and (brute_spans(before[i].text) or r.text == before[i].text)
        else:
            assert set(after) == set(before)
    assert np.unique([r.doc_id for r in out.collect()]).size == len(before)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_run_on_odd_tables(spark, sf_dir, tmp_path):
    """An empty table; null texts, ids, languages and sources, repeated rows, and columns with clashing names."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    path = str(tmp_path / "documents.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(0).write.parquet(path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "word " * 5, None, None, 1), (7, None, "en", None, None), (8, "", None, "s", 0)], DOCS)
    some = docs.where("doc_id < 40").select("doc_id", "text", "lang", "source", "n_chars")
    clash = {c: F.lit(1) for c in ("node", "fp", "row", "stratum", "piece", "digest", "keys", "pop", "bucket")}
    odd.unionByName(some).unionByName(some.limit(5)).withColumns(clash).write.mode("overwrite").parquet(path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 10 and {r.doc_id for r in out.select("doc_id").distinct().collect()} <= set(range(40))
