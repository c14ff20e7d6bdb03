"""Quality of documents: plain rules, and an isolation forest over their statistics.

Each text gives a row of rule statistics (how many words, symbols, repeated lines
and windows, capitals, marks ...). An isolation forest splits the statistics of
labelled rows at random, each tree over its own draw of them; a document that few
splits set apart is unusual. Not all that is unusual is bad (a text with many
figures is not), so there is a threshold for each statistic that may set a document
apart. Half the labelled rows grow the trees, the other half calibrates how short a
path must be: as many bad rows as possible are caught while nearly all good ones
stay. All labelled rows take part, however many: trees draw from the whole of one
half, and every row of the other is scored and ranked in tasks. The forest has a
fixed size and is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.periodic import repeated_triples, word_numbers
from barloom.llm.shared import materialised, written
from barloom.operators import layout

TREES, DRAWN = 200, 256
#: Share of good labelled rows that the threshold may cost at most.
GOOD_LOST = 0.002
#: Bad labelled rows of a kind that a threshold needs at least.
LEAST_BAD = 3
LEAST_WORDS, MOST_REPEATED = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols", "dup_lines", "repeat_words", "capitals", "digits", "marks", "ends")

_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_KINDS = {
    "symbols": np.isin(np.arange(256), list(b"#*$%&|<>")),
    "capitals": np.isin(np.arange(256), list(range(ord("A"), ord("Z") + 1))),
    "digits": np.isin(np.arange(256), list(b"0123456789")),
    "marks": np.isin(np.arange(256), list(b"!?;:\"()[]{}=+/\\_~^@-")),
    "ends": np.isin(np.arange(256), list(b".,")),
    "later": (np.arange(256) & 0xC0) == 0x80,  # bytes of a character after its first
}


def statistics(data: bytes) -> tuple[list[int], list[float]]:
    """``COUNTS`` and ``FEATURES`` of one text (UTF-8)."""
    numbers, _ = word_numbers(data)
    n = len(numbers)
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    count = {kind: int(of[which].sum()) for kind, which in _KINDS.items()}
    chars = len(data) - count["later"] - int(of[_BLANK].sum())
    lines, seen, again = 0, set(), 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    ends = repeated_triples(numbers)[0] >= 0
    hit = ends.copy()
    hit[:-1] |= ends[1:]
    hit[:-2] |= ends[2:]
    repeated = int(hit.sum())
    counts = [n, chars, count["symbols"], again, repeated]
    features = [chars / max(1, n), count["symbols"] / max(1, n), again / max(1, lines), repeated / max(1, n),
                count["capitals"] / max(1, chars), count["digits"] / max(1, chars), count["marks"] / max(1, n),
                count["ends"] / max(1, n)]
    return counts, [float(x) for x in features]


def expected_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path to a row among ``n`` in a tree of random splits."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
        return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees in arrays of one row a tree: feature (-1: leaf), cut, left child (right is next), rows grown on, path to a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    size: np.ndarray
    path: np.ndarray
    drawn: int

    def judge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and kind of each row.

        The score is 2 ** (-mean path / expected path), near 1 for rows that few
        splits set apart. The kind is the statistic and side (2 * feature, + 1 for
        large values) that set the row apart from most other rows: a split counts
        the halvings by which it shrank the part that the row is in.
        """
        n, width = rows.shape
        trees = np.arange(len(self.feature))
        node = np.zeros((n, len(trees)), np.int64)
        apart = np.zeros(n * 2 * width)
        mine = np.broadcast_to(np.arange(n)[:, None], node.shape)
        for _ in range(self.path.shape[1]):
            feature = self.feature[trees, node]
            inner = feature >= 0
            if not inner.any():
                break
            right = np.take_along_axis(rows, np.maximum(feature, 0), 1) >= self.cut[trees, node]
            after = np.where(inner, self.left[trees, node] + right, node)
            halved = np.log2(self.size[trees, node] / self.size[trees, after])
            apart += np.bincount((mine * 2 * width + 2 * feature + right)[inner], halved[inner], n * 2 * width)
            node = after
        mean = self.path[trees, node].mean(axis=1) if n else np.zeros(0)
        return 2.0 ** (-mean / max(1e-9, float(expected_path(self.drawn)))), apart.reshape(n, 2 * width).argmax(axis=1)


def draws(n: int, trees: int = TREES, drawn: int = DRAWN, seed: int = 7) -> np.ndarray:
    """Which of ``n`` rows each tree is grown on: one row a tree, no row twice in a tree."""
    rng = np.random.default_rng(seed)
    return np.array([rng.choice(n, min(drawn, n), replace=False) for _ in range(trees)])


def grow(rows: np.ndarray, trees: int = TREES, drawn: int = DRAWN, seed: int = 7) -> Forest:
    """A forest over random draws of the rows."""
    rng, drawn = np.random.default_rng(seed), min(drawn, len(rows))
    return grow_on((rows[rng.choice(len(rows), drawn, replace=False)] for _ in range(trees)), trees, drawn, rng)


def grow_on(parts: Iterable[np.ndarray], trees: int, drawn: int, rng: np.random.Generator) -> Forest:
    """A tree for each part of ``drawn`` rows, cut at random until rows stand alone or the depth is log2 of the draw."""
    deepest = max(1, int(np.ceil(np.log2(max(2, drawn)))))
    nodes = 2 ** (deepest + 1) - 1
    feature, left = np.full((trees, nodes), -1), np.zeros((trees, nodes), np.int64)
    cut, path, size = np.zeros((trees, nodes)), np.zeros((trees, nodes)), np.ones((trees, nodes))
    for tree, rows in enumerate(parts):
        todo, used = [(0, 0, rows)], 1
        while todo:
            node, depth, part = todo.pop()
            size[tree, node] = len(part)
            low, high = part.min(axis=0), part.max(axis=0)
            differ = np.flatnonzero(high > low)
            if depth == deepest or len(part) < 2 or not len(differ):
                path[tree, node] = depth + expected_path(len(part))
                continue
            by = int(rng.choice(differ))
            at = rng.uniform(low[by], high[by])
            above = part[:, by] >= at
            if above.all():  # the cut fell on the least value
                at = np.nextafter(low[by], high[by])
                above = part[:, by] >= at
            feature[tree, node], cut[tree, node], left[tree, node] = by, at, used
            todo += [(used, depth + 1, part[~above]), (used + 1, depth + 1, part[above])]
            used += 2
    return Forest(feature, cut, left, size, path, drawn)


def calibrated(scores: np.ndarray, kinds: np.ndarray, good: np.ndarray, lost: float = GOOD_LOST) -> np.ndarray:
    """For each kind the score from which a row is taken for bad.

    It lies below as many bad rows of the kind as it may, while at most the share
    ``lost`` of the good ones reach it (of few good ones, none), and halfway to the
    next good row. A kind with fewer than ``LEAST_BAD`` bad rows above its good ones has
    no threshold.
    """
    out = np.full(2 * len(FEATURES), np.inf)
    for kind in np.unique(kinds):
        fine, poor = np.sort(scores[good & (kinds == kind)]), scores[~good & (kinds == kind)]
        below = fine[len(fine) - 1 - int(lost * len(fine))] if len(fine) else -np.inf
        poor = poor[poor > below]
        if len(poor):
            out[kind] = _threshold(below, len(poor), poor.min(), poor.max())
    return out


def _threshold(below: float, n: int, least: float, most: float) -> float:
    """From the good score that may not be reached, and how many bad ones above it there are, from where to where."""
    return (max(below, least - (most - least)) + least) / 2 if n >= LEAST_BAD else np.inf


def calibrated_over(scored: DataFrame, lost: float = GOOD_LOST) -> np.ndarray:
    """As `calibrated`, from any number of rows ``doc_id`` (unique), ``kind, score, good``; a row per kind reaches the driver."""
    of_kind = lambda values, none: F.get(F.array(*[F.lit(values.get(k, none)) for k in range(2 * len(FEATURES))]), F.col("kind").cast("int"))
    fine = layout.ranked(scored.where("good").select("kind", "score", "doc_id"), ("kind",), ["score", "doc_id"], "rank")
    sizes = {r.kind: r.n for r in fine.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = {k: n - 1 - int(lost * n) for k, n in sizes.items()}
    below = {r.kind: r.score for r in fine.where(F.col("rank") == of_kind(places, -1)).select("kind", "score").collect()}
    found = scored.where(~F.col("good") & (F.col("score") > of_kind(below, float("-inf")))).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))
    out = np.full(2 * len(FEATURES), np.inf)
    for row in found.collect():
        out[row.kind] = _threshold(below.get(row.kind, -np.inf), row.n, row.least, row.most)
    return out


_COUNT_TYPE, _FEATURE_TYPE = ", ".join(f"{c} long" for c in COUNTS), "features array<double>"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        measured = [statistics(data.as_py()) for data in batch.column("text").cast(pa.binary())]
        counts = np.array([m[0] for m in measured], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(pa.array, counts.T), pa.array([m[1] for m in measured], pa.list_(pa.float64()))],
            ["doc_id", *COUNTS, "features"])


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the `COUNTS` and the `FEATURES` (an array) of every row; a null text has no words. No shuffle."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(_measure, f"doc_id {dict(rows.dtypes)['doc_id']}, {_COUNT_TYPE}, {_FEATURE_TYPE}")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _scored(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, kind = forest.judge(_features(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kind, pa.int64()), pa.array(score), batch.column("good")],
                                             ["doc_id", "kind", "score", "good"])
    return run


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))


def _grown(rows: DataFrame, n: int, trees: int = TREES, drawn: int = DRAWN) -> Forest:
    """A forest grown on the ``n`` rows of even number; of more than all trees draw, only those drawn reach the driver."""
    even = rows.where("no % 2 = 0")
    if n <= trees * drawn:
        return grow(_by_number(even), trees, drawn)
    places = draws(n, trees, drawn)
    wanted = np.unique(places)
    numbers = rows.sparkSession.createDataFrame(pa.table({"no": 2 * wanted}))
    part = _by_number(even.join(F.broadcast(numbers), "no"))
    return grow_on((part[np.searchsorted(wanted, at)] for at in places), trees, drawn, np.random.default_rng(8))


def _by_number(rows: DataFrame) -> np.ndarray:
    found = rows.select("no", "features").toArrow().sort_by("no").combine_chunks()
    return found.column("features").combine_chunks().flatten().to_numpy().reshape(len(found), len(FEATURES))


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality") -> tuple[Forest, np.ndarray] | None:
    """A forest and its thresholds from all labelled rows of `rule_statistics`; None if no document is labelled.

    ``labels`` gives 1 for good and 0 for bad by document; nulls are ignored, and
    of contradicting labels of a document the bad one counts. Of documents that share
    an identifier one is taken. Labelled rows are numbered by a hash: the even ones are
    those that trees draw from, the odd ones are all scored for the thresholds. The driver
    holds the drawn rows and a row per kind.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{good_col}`").alias("good")).dropna()
    known = known.groupBy("doc_id").agg((F.min("good") > 0).alias("good"))
    labelled = measured.select("doc_id", "features", base_failed().alias("failed")).join(known, "doc_id")
    one = labelled.groupBy("doc_id").agg(F.min(F.struct("features", "failed", "good")).alias("one")).select(
        F.xxhash64("doc_id").alias("at"), "doc_id", "one.*")
    rows = materialised(layout.ranked(one, (), ["at", "doc_id"], "no"))
    n = rows.count()
    if not n:
        return None
    forest = _grown(rows, (n + 1) // 2)
    kind = dict(rows.dtypes)["doc_id"]
    checked = rows.where("no % 2 = 1 AND NOT failed").select("doc_id", "features", "good")
    scored = materialised(checked.mapInArrow(_scored(forest), f"doc_id {kind}, kind long, score double, good boolean"))
    return forest, calibrated_over(scored)


def _verdicts(forest: Forest | None, thresholds: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = _features(batch)
            if forest is None:
                score, kind, odd = np.zeros(len(features)), np.zeros(len(features), int), np.zeros(len(features), bool)
            else:
                score, kind = forest.judge(features)
                odd = score >= thresholds[kind]
            sides = [f"{'high' if k % 2 else 'low'} {FEATURES[k // 2]}" for k in kind.tolist()]
            kept = [c for c in batch.schema.names if c != "features"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(score), pa.array(sides, pa.string()), pa.array(odd)],
                [*kept, "score", "unusual_by", "unusual"])
    return run


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality") -> DataFrame:
    """One row per document: ``doc_id``, the `COUNTS`, ``score, unusual_by, unusual, base_failed, kept``.

    A document is kept unless it fails the base rules (fewer than 50 words, or more
    than half of them in repeated windows of three) or the forest finds it unusual
    as labelled bad ones are. Null, empty and blank texts have no words and fail.
    Every row is judged by itself, so repeated rows, ties and rows without
    identifier stay and agree. Without usable labels only the base rules count.
    An empty table gives an empty result. Other columns are ignored. Labels are
    cases of `fit`. Texts are measured once and their statistics written. The judging
    pass has no shuffle.
    """
    measured = written(rule_statistics(docs, id_col, text_col), "statistics")
    fitted = fit(measured, labels, id_col, good_col)
    kind = dict(measured.dtypes)["doc_id"]
    judged = measured.mapInArrow(_verdicts(*(fitted or (None, None))),
                                 f"doc_id {kind}, {_COUNT_TYPE}, score double, unusual_by string, unusual boolean")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.col("unusual"))
