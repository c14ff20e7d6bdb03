"""Stretches of a text that repeat with a small period.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are the same) and at least ``max(6, 4 * q)`` words, which no neighbouring
word extends. Words are read from first to last. For each word, its earlier
occurrences lengthen the matches on their diagonals (one diagonal for each lag);
a diagonal that ends with enough matches is a run and is emitted at once.

Only occurrences that can matter are looked up. A run of period ``q`` holds a
match of ``3 * q`` words at lag ``q``, so lags from ``2**k`` below ``2**(k + 1)``
are sought by repeated grams of ``3 * 2**k`` words. Inside a run every such gram
was last seen exactly ``q`` words before: an occurrence nearer than that, or a
second one in the same range of lags, would give the stretch a smaller period. So
a word has one earlier occurrence at most in each range, the diagonals at work are
few, and the grams of one range follow from those of the range before. Work is
``n log n`` for any text, and near ``n`` for texts without repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a text split at once.
CHUNK = 1 << 20
LEAST, PERIODS = 6, 4
_GAP = re.compile(rb"[\x20\x09-\x0D]")


class Numbering(dict):
    """Words by number, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def pieces_of(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """A text in pieces that end between words."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def word_numbers(data: bytes) -> tuple[np.ndarray, Numbering]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text (UTF-8) as numbers, and the words numbered."""
    words = Numbering()
    parts = [np.fromiter(map(words.__getitem__, found), np.int64, len(found))
             for found in (piece.split() for piece in pieces_of(data))]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), words


def longer_grams(grams: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams that are ``by`` words longer, from the grams ending at each word (-1: seen once only).

    Also the places whose gram was seen before, and how many words before.
    """
    longer, none = np.full(len(grams), -1, np.int64), np.zeros(0, np.int64)
    if len(grams) <= by:
        return longer, none, none
    places = np.flatnonzero((grams[by:] >= 0) & (grams[:-by] >= 0)) + by
    pairs = grams[places - by] * (int(grams.max()) + 1) + grams[places]
    order = np.argsort(pairs, kind="stable")
    pairs, places = pairs[order], places[order]
    same = pairs[1:] == pairs[:-1]
    new = np.concatenate([np.ones(min(1, len(pairs)), bool), ~same])
    often = ~new
    often[:-1] |= same
    longer[places[often]] = (np.cumsum(new) - 1)[often]
    return longer, places[1:][same], (places[1:] - places[:-1])[same]


def repeated_words(words: np.ndarray) -> np.ndarray:
    """The words, with -1 for those seen once only."""
    if not len(words):
        return words
    return np.where(np.bincount(words)[words] > 1, words, -1)


def repeated_triples(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of three words ending at each word (-1: seen once only), places seen before, and how many words before."""
    return longer_grams(longer_grams(repeated_words(words), 1)[0], 1)


def earlier_occurrences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order, the lag of the earlier occurrence there and the words that match up to there."""
    grams, places, lags = repeated_triples(words)
    length, least, found = 3, 1, []
    while len(places):
        inside = (lags >= least) & (lags < 2 * least)
        found.append((places[inside], lags[inside], np.full(int(inside.sum()), length)))
        least *= 2
        if PERIODS * least > len(words):
            break
        grams, places, lags = longer_grams(grams, length)
        length *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    columns = [np.concatenate(c) for c in zip(*found)]
    order = np.argsort(columns[0], kind="stable")
    return columns[0][order], columns[1][order], columns[2][order]


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start and period."""
    diagonals: dict[int, tuple[int, int]] = {}  # lag -> last word that matches, words that match
    runs: list[tuple[int, int, int]] = []

    def end(lag: int) -> None:
        last, matches = diagonals.pop(lag)
        if matches + lag >= max(LEAST, PERIODS * lag):
            runs.append((last + 1 - matches - lag, matches + lag, lag))

    now = -1
    for at, lag, length in zip(*(c.tolist() for c in earlier_occurrences(words))):
        if at != now:
            for other in [x for x, (last, _) in diagonals.items() if last < at - 1]:
                end(other)
            now = at
        if lag in diagonals:
            diagonals[lag] = at, diagonals[lag][1] + 1
        else:
            diagonals[lag] = at, length
    for lag in list(diagonals):
        end(lag)
    return sorted(runs, key=lambda run: (run[0], run[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: those of a run after its first period go."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        sizes, found, texts = [], [], []
        for data in batch.column("text").cast(pa.binary()):
            numbers, words = word_numbers(data.as_py())
            runs = runs_of(numbers)
            names, kept = list(words), numbers[kept_words(len(numbers), runs)] if runs else numbers
            sizes.append(len(numbers))
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            texts.append(b" ".join(map(names.__getitem__, kept.tolist())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, run), pa.array(texts, pa.binary()).view(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, collapsed``.

    ``runs`` lists ``start`` (word number from 0), ``length`` and ``period`` in
    words, by start and period; runs may overlap. ``collapsed`` is the text
    without the words that a run holds after its first period, joined by one
    space. A null, empty or blank text has no words, no runs and an empty
    ``collapsed``. Every row is judged by itself: rows without identifier and
    repeated rows stay, ties cannot arise, and an empty table gives an empty
    result. Other columns are ignored. No shuffle; a task holds one batch of texts.
    """
    kind = dict(docs.select(F.col(f"`{id_col}`").alias("doc_id")).dtypes)["doc_id"]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(_find, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
