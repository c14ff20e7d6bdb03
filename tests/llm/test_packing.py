"""Packing: ids against the tokenizer itself, placement checked sequence by sequence."""

import random
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["İstanbul ΑΣ. ΟΔΟΣ, it's I'M x.%% a.b c., É. ﬁne <|startoftext|> <|endoftext|>x 12 345 ①② ½ µ ª ß. \x1c a\x0bb\x85c d é. É, ",
       "日本語 テスト. 한국어 don't 'S 're.", "", None, " \n ", "word%%% word*** <|x|> a'b can't've"]


def check(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(w[3] for w in want)


def test_ids_and_places(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["one", "Two,", "tres!", "x9y"]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    docs += [(500 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, docs[7][1]), (900, "long, " * 9000)]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, length int")
    sequences, total = check(packing.pack(frame, PATH, capacity=64, rounds=40).collect(), docs, 64)
    assert sequences <= -(-total // 64) + 1
    withed = packing.pack(frame, PATH, with_ids=True)
    assert all(len(r.ids) == r.length for r in withed.collect())


def test_real_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sequences, total = check(packing.pack(docs, PATH).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()], 4096)
    assert sequences == -(-total // 4096)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(101, np.int64)
    histogram[rng.integers(20, 100, 25)] = rng.integers(1, 100_000, 25)
    plan = packing.plan(histogram, 100, 1500)
    assert plan.bound <= plan.sequences <= 1.05 * plan.bound + 25


def test_price_is_the_best_configuration():
    rng = np.random.default_rng(3)
    value = np.zeros(13)
    value[2:] = rng.random(11)

    def best(room):
        return max([0.0, *(value[k] + best(room - k) for k in range(2, room + 1))])

    worth, counts = packing.price(value, 12)
    assert abs(worth - best(12)) < 1e-12 and abs((counts * value).sum() - worth) < 1e-12
    assert (counts * np.arange(13)).sum() <= 12


def test_strings_beyond_the_memo_cost_no_python_call_each(monkeypatch):
    """op1: once the memo was full, every word of every text was looked up by a Python function."""
    encoder = packing.Encoder(PATH)
    texts = [" ".join(f"zq{i}x{k}" for k in range(200)) for i in range(20)]
    want = [encoder([t])[0] for t in texts]
    monkeypatch.setattr(packing, "CACHE", 0)
    monkeypatch.setattr(encoder, "known", {})
    calls = Counter()
    sys.setprofile(lambda frame, event, _: calls.update([frame.f_code.co_name]) if event == "call" else None)
    try:
        got = encoder(texts)
    finally:
        sys.setprofile(None)
    assert got == want and not encoder.known  # 4000 words
    assert calls.total() < 500


def test_latin_letters_skip_the_steps_they_do_not_need(monkeypatch):
    """op1: every new string was composed, put to lower case and cut by patterns, and every text searched for punctuation."""
    encoder = packing.Encoder(PATH)
    monkeypatch.setattr(encoder, "known", {})
    tokenizer, seen = encoder.tokenizer, []

    class Watched:
        def __getattr__(self, name):
            return lambda texts, **k: (seen.extend([texts] if isinstance(texts, str) else texts), getattr(tokenizer, name)(texts, **k))[1]

    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) if rng.random() < 0.8 else rng.choice(" \n.,'-<|9\u0301") for _ in range(n)) for n in (0, 1, 5, 900, 900)]
    texts += [None, ",", "a", ",a", "a,b", "x <|startoftext|> y.z", *letters, *(f"a{c}" for c in map(chr, range(128)))]
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder(texts) == want
    encoder.tokenizer = Watched()
    encoder(["zqword ändern, niño. été", "Größe zqother 7"])
    assert set(seen) <= {",", ".", "7"}
