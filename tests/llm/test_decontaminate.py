"""Decontamination against brute force."""

import hashlib
import random
import re

from barloom.llm import decontaminate


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, span=10):
    windows = {}
    for item_id, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in df.collect()), key=repr)


def cases(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["der", "Über", "x1", "a", "b", "c", "Ünd", "q", "zz", "étå"])
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 8, 9, 10, 11, 25]))) for i in range(12)]
    items += [(3, items[0][1]), (None, text(12)), (90, None), (91, ""), (92, " ?! ")]
    docs = [(i, " ".join([text(rng.randint(0, 30)), rng.choice(items)[1] or "", text(rng.randint(0, 12))])) for i in range(40)]
    docs += [(0, docs[0][1]), (None, docs[1][1]), (70, None), (71, ""), (72, "..."), (73, text(30_000))]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontaminate.contamination(frame, bench)) == brute(docs, items)
    # Beyond the size that is broadcast: the same by shuffled joins.
    assert rows_of(decontaminate.contamination(frame, bench, broadcast_limit=0)) == brute(docs, items)
    clean = decontaminate.keep_clean(frame, bench)
    assert clean.columns == frame.columns
    assert clean.count() == sum(not r[2] for r in brute(docs, items))


def test_real_tables(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert rows_of(decontaminate.contamination(docs, bench)) == want
    assert sum(r[2] > 0 for r in want) >= 3


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(decontaminate.contamination(docs, none)) == brute([(1, "a b c")], [])
    assert decontaminate.contamination(docs.limit(0), none).collect() == []
