"""Rule statistics against plain counting, the forest against plain walks, and held-out labels."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import quality_rules as qr
from barloom.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab é\n\t#|<\x1c\xa0\x0b", max_size=60))
def test_counts(text):
    counts, features = qr.statistics(text.encode())
    assert counts == plain_counts(text)
    assert len(features) == len(qr.FEATURES) and np.isfinite(features).all()


def test_long_texts_are_counted_whole():
    text = ("one two three four # \n" * 40_000) + "é" * 1_500_000 + " last"
    counts, _ = qr.statistics(text.encode())
    assert counts == [200_002, 40_000 * 16 + 1_500_000 + 4, 40_000, 39_999, 200_000]


def test_paths_and_kinds_against_plain_walks():
    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(size=(400, len(qr.FEATURES))), 1)
    rows[:, 2] = 0.0
    forest = qr.grow(rows, trees=20, drawn=64, seed=1)
    scores, kinds = forest.judge(rows)
    for i in range(0, 400, 7):
        paths, apart = [], np.zeros(2 * len(qr.FEATURES))
        for tree in range(20):
            node = 0
            while (by := forest.feature[tree, node]) >= 0:
                high = rows[i, by] >= forest.cut[tree, node]
                child = forest.left[tree, node] + int(high)
                apart[2 * by + high] += np.log2(forest.size[tree, node] / forest.size[tree, child])
                node = child
            paths.append(forest.path[tree, node])
        assert np.isclose(scores[i], 2 ** (-np.mean(paths) / float(qr.expected_path(64))))
        assert np.isclose(apart.max(), apart[kinds[i]])
    far = np.full((1, len(qr.FEATURES)), 50.0)
    assert forest.judge(far)[0][0] > np.quantile(scores, 0.9)


def test_equal_rows_cannot_be_split():
    forest = qr.grow(np.ones((9, len(qr.FEATURES))), trees=3)
    assert (forest.feature == -1).all()
    assert len(set(forest.judge(np.ones((4, len(qr.FEATURES))))[0])) == 1
    assert qr.grow(np.ones((1, len(qr.FEATURES)))).judge(np.zeros((2, len(qr.FEATURES))))[0].shape == (2,)


def test_thresholds_spare_good_rows():
    scores = np.array([0.4, 0.45, 0.5, 0.6, 0.7, 0.72, 0.74, 0.44, 0.9, 0.3])
    kinds = np.array([1, 1, 1, 1, 1, 1, 1, 1, 3, 5])
    good = np.array([1, 1, 1, 0, 0, 0, 0, 0, 0, 1], bool)
    out = qr.calibrated(scores, kinds, good)
    assert 0.5 < out[1] <= 0.6 and np.isinf(out[3]) and np.isinf(out[5])  # one bad row is not enough


def test_held_out_labels(spark):
    """Fitted on half the labels: of the others most bad documents go and good ones stay."""
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    seen = labels.where(half)
    judged = qr.judge(docs, seen).join(labels.where(~half), "doc_id").select("quality", "kept", "base_failed", "unusual").collect()
    bad, good = [r for r in judged if r.quality == 0], [r for r in judged if r.quality == 1 and not r.base_failed]
    assert sum(r.unusual for r in bad if not r.base_failed) >= 0.8 * sum(not r.base_failed for r in bad)
    assert sum(not r.kept for r in bad) >= 0.85 * len(bad)
    assert sum(r.kept for r in good) >= 0.98 * len(good)


def test_query_rows(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op13_quality_rules"](spark, sf_dir)
    assert dict(got.dtypes)["n_symbols"] == "bigint" and dict(got.dtypes)["kept"] == "boolean"
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        counts = plain_counts(texts[r.doc_id])
        assert [r[c] for c in qr.COUNTS] == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert r.kept == (not r.base_failed and not r.unusual)


def test_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (None, words), (3, words), (3, words), (4, "x " * 80)]
    docs = spark.createDataFrame([(i, t, 5, "f") for i, t in rows], "doc_id long, text string, n_words int, features string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, None), (4, 0), (4, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    for known in (labels, labels.where("false"), labels.where("quality = 0")):
        got = qr.judge(docs, known).collect()
        assert len(got) == len(rows)
        kept = {(r.doc_id, r.n_words, r.kept) for r in got}
        assert kept == {(1, 0, False), (2, 0, False), (None, 60, True), (3, 60, True), (4, 80, False)}
    assert qr.judge(docs.where("false"), labels).collect() == []


def test_all_labelled_rows_are_fitted_on(spark, monkeypatch):
    """F16: no bound on labelled rows; trees draw from all of one half and all of the other is scored."""
    assert not hasattr(qr, "LABELLED_ROWS")
    n = 24_001
    rng = np.random.default_rng(5)
    features = rng.normal(size=(n, len(qr.FEATURES)))
    rows = [(i, *[100] * 4, 0, [float(x) for x in f]) for i, f in enumerate(features)]
    measured = spark.createDataFrame(rows, f"doc_id long, {qr._COUNT_TYPE}, {qr._FEATURE_TYPE}")
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3 > 0).cast("int").alias("quality"))
    scored, over = [], qr.calibrated_over
    monkeypatch.setattr(qr, "calibrated_over", lambda df: scored.append(df) or over(df))
    forest, thresholds = qr.fit(measured, labels)
    got = scored[0].toPandas()
    assert len(got) == n // 2 and got.doc_id.is_unique
    even = np.setdiff1d(np.arange(n), got.doc_id)
    hashed = [r.doc_id for r in spark.range(n).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    assert sorted(hashed[::2]) == even.tolist()
    assert np.array_equal(forest.cut, qr.grow(features[hashed[::2]]).cut)
    scores, kinds = forest.judge(features[got.doc_id])
    assert np.array_equal(scores, got.score) and np.array_equal(kinds, got.kind)
    assert np.array_equal(thresholds, qr.calibrated(scores, kinds, got.good.to_numpy()))


def test_trees_draw_from_more_rows_than_reach_the_driver(spark):
    """F16: the drawn rows are those of the draws, from anywhere among all rows."""
    features = np.random.default_rng(6).normal(size=(1000, len(qr.FEATURES)))
    rows = spark.createDataFrame([(2 * i, [float(x) for x in f]) for i, f in enumerate(features)] + [(1, [0.0] * len(qr.FEATURES))],
                                 "no long, features array<double>")
    forest = qr._grown(rows, 1000, trees=5, drawn=32)
    at = qr.draws(1000, 5, 32)
    own = qr.grow_on((features[a] for a in at), 5, 32, np.random.default_rng(8))
    assert np.array_equal(forest.cut, own.cut) and at.max() > 900 and (forest.size[:, 0] == 32).all()


def test_thresholds_by_table_and_by_array(spark):
    rng = np.random.default_rng(9)
    scores, kinds, good = np.round(rng.beta(4, 4, 3000), 2), rng.integers(0, 6, 3000), rng.random(3000) < 0.8
    good[kinds == 5] = False
    good[kinds == 4] = True
    rows = [(i, int(k), float(x), bool(g)) for i, (k, x, g) in enumerate(zip(kinds, scores, good))]
    df = spark.createDataFrame(rows, "doc_id long, kind long, score double, good boolean")
    for lost in (0.002, 0.3):
        made = qr.calibrated_over(df, lost)
        assert np.array_equal(made, qr.calibrated(scores, kinds, good, lost)) and np.isfinite(made).any()
