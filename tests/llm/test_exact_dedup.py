"""Exact deduplication against brute force on small tables."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from barloom.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc_id is None, doc_id or 0, i))
    return sorted((rows[i][0] is None, rows[i][0] or 0, rows[min(g)[2]][0], len(g)) for g in groups.values() for *_, i in g)


ROWS = [(3, "a  b"), (1, "a\tb"), (1, "a b"), (None, "a\n\n b"), (5, None), (4, ""), (9, "x"), (8, "y"), (7, "y"),
        (20, "y "), (21, " y"), (30, "long " * 50_000), (31, "long \t" * 50_000), (32, "Y")]


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size) for r in df.collect())


def test_groups_and_ties(spark):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, at int")
    got = exact_dedup.deduplicate(docs)
    assert rows_of(got) == brute(ROWS)
    kept = [r for r in got.collect() if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept})
    stay = exact_dedup.keep_first(docs)
    assert stay.columns == docs.columns and stay.count() == len(kept)


def test_shared_digests_are_split_by_bytes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    weak = exact_dedup.deduplicate(docs, digest=lambda c: (F.xxhash64(c) % 2).cast("string"))
    assert rows_of(weak) == brute(ROWS)


def test_several_batches_share_their_state(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    assert rows_of(exact_dedup.deduplicate(docs, files_per_batch=1)) == brute(ROWS)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.deduplicate(docs).collect() == []
    assert exact_dedup.keep_first(docs).collect() == []
