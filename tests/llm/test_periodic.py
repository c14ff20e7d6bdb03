"""Runs of repeated words against a search by every lag."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import periodic
from barloom.llm.queries import QUERIES


def plain_runs(words):
    """Every lag, every stretch; of equal stretches the smallest lag is their period."""
    n, found = len(words), {}
    for lag in range(1, n // 4 + 1):
        at = lag
        while at < n:
            first = at
            while at < n and words[at] == words[at - lag]:
                at += 1
            if at > first and at - first + lag >= max(6, 4 * lag):
                found.setdefault((first - lag, at), lag)
            at += at == first
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@st.composite
def repetitive(draw):
    words = []
    for kind, a, b in draw(st.lists(st.tuples(st.booleans(), st.integers(1, 9), st.integers(1, 40)), max_size=8)):
        if kind and words:
            for _ in range(b):
                words.append(words[-min(a, len(words))])
        else:
            words.append(a % 4)
    return words


@settings(max_examples=500, deadline=None)
@given(repetitive())
def test_runs_equal_those_of_every_lag(words):
    numbers = np.array(words, np.int64)
    assert periodic.runs_of(numbers) == plain_runs(words)


def test_runs_in_runs_and_of_equal_exponent():
    words = (["a", "a", "a", "a", "a", "a", "b"] * 5 + ["c"] + ["x", "y"] * 4 + ["z"] * 6)
    numbers, _ = periodic.word_numbers(" ".join(words).encode())
    assert periodic.runs_of(numbers) == plain_runs(words)


def test_words_end_at_the_six_blanks_only(monkeypatch):
    text = "a b\tc\x0bd\x0ce\x1cf g\r\nh  é"
    for chunk in (1, 2, 3, 1 << 20):
        parts = [w for piece in periodic.pieces_of(text.encode(), chunk) for w in piece.split()]
        assert [w.decode() for w in parts] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_no_bound_on_length_and_near_linear_work():
    n = 300_000
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    assert periodic.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.runs_of(np.arange(n) % (n // 5)) == [(0, n, n // 5)]
    assert periodic.runs_of(np.array(b[:n])) == []  # cubes everywhere, no fourth power


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a " * 9), (4, "x y " * 8), (4, "x y " * 8), (5, "w " * 50_000 + "é  z"),
            (6, "\u0000 " * 6)]
    frame = spark.createDataFrame([(i, t, "runs", 7) for i, t in rows], "doc_id long, text string, runs string, n_words int")
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.find_runs(frame).collect()}
    assert got == {(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (None, 9, ((0, 9, 1),), "a"), (4, 16, ((0, 16, 2),), "x y"),
                   (5, 50_002, ((0, 50_000, 1),), "w é  z"), (6, 6, ((0, 6, 1),), "\u0000")}
    assert periodic.find_runs(frame).count() == len(rows)
    assert periodic.find_runs(frame.where("false")).collect() == []


def test_query_against_every_lag(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op11_periodic_runs"](spark, sf_dir)
    assert dict(got.dtypes)["exponent_milli"] == "bigint"
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(plain_row(i, t) for i, t in texts.items())
    assert sum(r[1] > 0 for r in rows) >= len(rows) // 40
