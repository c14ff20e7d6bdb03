"""Similarity join against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import near_join


def grams(text, n=5):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    k = min(n, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(docs, threshold=0.8):
    sets = [grams(t) for _, t in docs]
    label, links = list(range(len(docs))), [0] * len(docs)

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= threshold * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                label[max(top(i), top(j))] = min(top(i), top(j))
    key = lambda i: (docs[i][0] is None, docs[i][0] or 0)
    heads = {}
    for i in range(len(docs)):
        heads[top(i)] = min(heads.get(top(i), key(i)), key(i))
    return sorted((*key(i), *heads[top(i)], links[i]) for i in range(len(docs)))


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.class_id is None, r.class_id or 0, r.n_links) for r in df.collect())


def cases(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = []
    for size, changes in ((60, 0), (60, 1), (200, 2), (200, 4), (200, 9), (7, 1), (3, 0)):
        base = text(size)
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, changes)):
                copy[rng.randrange(size)] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += [" ".join(text(30)) for _ in range(20)] + ["", None, " ... ", "One", "one!", " ".join(text(40_000))]
    docs = [(i, d) for i, d in enumerate(docs)]
    return docs + [(None, docs[0][1]), (3, docs[3][1]), (3, docs[50][1])]


@pytest.mark.parametrize("block", [128, 4])
def test_against_brute_force(spark, block):
    docs = cases()
    frame = spark.createDataFrame([(*d, b"x") for d in docs], "doc_id long, text string, node binary")
    got = near_join.join(frame, block=block)
    assert rows_of(got) == brute(docs)
    assert got.where("kept").count() == len({r[2:4] for r in brute(docs)})
    if block == 128:
        stay = near_join.keep_one(frame)
        assert stay.columns == frame.columns and stay.count() == got.where("kept").count()


def test_real_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(near_join.join(docs)) == want
    assert any(r[4] for r in want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_join.join(docs).collect() == []


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.99999), (0.5, 0.9), (0.95, 0.999)):
        bands, rows = near_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold ** rows) ** bands >= recall and bands * rows <= near_join.MAX_HASHES


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    signer = near_join.Signer(250, 1)
    for share in (0.2, 0.5, 0.8):
        same, own = int(4000 * share), int(4000 * (1 - share) / 2)
        pool = rng.integers(0, 1 << 63, same + 2 * own, dtype=np.uint64)
        a, b = signer(pool[:same + own]), signer(np.concatenate([pool[:same], pool[same + own:]]))
        assert abs((a == b).mean() - share) < 0.11


def test_components_of_chains_and_stars(spark):
    from barloom.llm.shared import components

    rng = random.Random(2)
    edges = [(f"{i:05d}", f"{i + 1:05d}") for i in range(300)] + [("10000", f"{10001 + i}") for i in range(3000)]
    edges += [(f"2{rng.randrange(400):04d}", f"2{rng.randrange(400):04d}") for _ in range(250)] + [("30000", "30000"), (None, "00001")]
    label = {x: x for e in edges for x in e if x and e[0] and e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {r.node: r.label for r in got} == label and len(got) == len(label)


def kept_by_brute_force(docs):
    """The first row of the smallest identifier of each class."""
    heads = {}
    for i, (_, *label) in enumerate(docs_with_heads(docs)):
        heads.setdefault(tuple(label), []).append(docs[i])
    return sorted(min(((d[0] is None, d[0] or 0) for d in group)) for group in heads.values())


def docs_with_heads(docs):
    """Rows with the head of their class, in the order of ``docs``."""
    sets = [grams(t) for _, t in docs]
    label = list(range(len(docs)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                label[max(top(i), top(j))] = min(top(i), top(j))
    return [(d, top(i)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("block", [128, 4])
def test_kept_rows_against_brute_force(spark, block):
    docs = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    stay = near_join.keep_one(frame, block=block).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in stay) == kept_by_brute_force(docs)


def test_rows_grow_with_a_group_not_with_its_square(spark):
    """Pipeline, near_dedup: a large group of near copies made a row per member and block."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    docs = [(i, " ".join([*base[:140], *(f"x{i}y{k}" for k in range(2))])) for i in range(240)]
    units = []
    real = near_join._verify

    def counted(*args):
        run = real(*args)

        def counting(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield from run(iter([batch]))
        seen = spark.sparkContext.accumulator(0)
        units.append(seen)
        return counting

    near_join._verify = counted
    try:
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        assert near_join.keep_one(frame, block=8).count() == 1
    finally:
        near_join._verify = real
    met = 240 * near_join.choose_bands(0.8, 0.99999)[0]
    assert sum(u.value for u in units) <= 1.3 * met  # 30 blocks: 30 times as many before


def test_nodes_are_numbers(spark, monkeypatch):
    """Pipeline, near_dedup: with byte strings as nodes every least one took two sorts, whose pages fill the executors' heap."""
    seen, real = [], near_join.components

    def looked_at(edges):
        seen.append((dict(edges.dtypes), edges.groupBy("a").agg(F.min("b"))._jdf.queryExecution().executedPlan().toString()))
        return real(edges)

    monkeypatch.setattr(near_join, "components", looked_at)
    docs = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    stay = near_join.keep_one(frame, block=4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in stay) == kept_by_brute_force(docs)
    assert seen and all(kinds == {"a": "bigint", "b": "bigint"} and "SortAggregate" not in plan for kinds, plan in seen)


def test_links_of_a_large_group_with_few_rows(spark, monkeypatch):
    """op8: every member of a large group of near copies made a row for each block of 128."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    docs = [(i, " ".join([*base[:140], *(f"x{i}y{k}" for k in range(2))])) for i in range(240)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    met = 240 * near_join.choose_bands(0.8, 0.99999)[0]

    def made():
        units, real = spark.sparkContext.accumulator(0), near_join._verify

        def counted(*args):
            run = real(*args)

            def counting(batches):
                for batch in batches:
                    units.add(batch.num_rows)
                    yield from run(iter([batch]))
            return counting

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(near_join, "_verify", counted)
            near_join.join(frame, block=8).count()
        return units.value

    links = lambda: {(r.class_id, r.n_links, r.n_partners, r.class_size) for r in near_join.join(frame, block=8).collect()}
    assert links() == {(0, 239, 239, 240)}
    assert made() <= 4 * met  # 4 blocks of 64; 30 of 8 before
    monkeypatch.setattr(near_join, "BLOCK_GRAMS", 240 * 140 // 20)  # heavy sets: smaller blocks again
    assert links() == {(0, 239, 239, 240)}
