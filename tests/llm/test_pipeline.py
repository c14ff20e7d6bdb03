"""The pipeline on a small table, stage by stage against brute force."""

import re

import corpus_pipeline
from test_decontaminate import brute as hits_of
from test_near_join import brute as classes_of
from test_packing import check


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "12 34", "en", "src1", 5)], docs.schema)
    docs.union(odd).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        before = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        if name == "packing":
            sequences, total = check(after.collect(), before, 4096)
            assert sequences == -(-total // 4096)
            break
        assert after.columns == docs.columns
        kept[name] = {r.doc_id for r in after.select("doc_id").collect()}
        ids = {i for i, _ in before}
        if name == "language_id":
            assert 10**6 not in kept[name] and 10**6 + 1 not in kept[name] and len(kept[name]) >= 0.97 * len(ids)
        elif name == "exact_dedup":
            first = {}
            for doc_id, text in before:
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), doc_id)
            assert kept[name] == set(first.values()) and len(first) < len(ids)
        elif name == "near_dedup":
            assert kept[name] == {r[3] for r in classes_of(before)} and kept[name] < ids
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            assert kept[name] == {r[0] for r in hits_of(before, items) if not r[2]}
        docs = after


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
