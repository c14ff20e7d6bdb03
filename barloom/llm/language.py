"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are combined per text: the likelihood of its character
trigrams, the declared markup language, the address suffix, and a prior of its
host. The first comes from a model of every declared language, fitted on a bounded
sample of each one's rows and kept sparse (the trigrams seen); the others from counts over all rows, by grouped aggregation of
the text-only posteriors. Host priors are smoothed hierarchically: host towards
domain, domain towards suffix, suffix towards all rows; a row's own text does not
count towards its priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import located, materialised, settings, written

#: Hash values of character trigrams.
CODES = 1 << 16
#: Bound of the training sample: rows per declared language (expected).
SAMPLE_ROWS = 2000
#: Values handled at once: (trigram, language) pairs of a text, and (row, language) pairs of a batch.
PAIRS, CELLS = 1 << 20, 1 << 17
#: Trigrams overlap, so their log likelihoods count by a third.
TEMPER = 1 / 3
#: Rows a parent's distribution counts for in smoothing, and a pseudo-count for declared values and suffixes.
PARENT_ROWS, PSEUDO = 10.0, 0.5

#: Bytes a-z and those beyond ASCII stand for themselves, others are spaces.
LETTERS = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint32)
BLANK = (0x20 * (961 + 31 + 1)) % CODES


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of all texts in a row, each text's first, and each text's number of letter bytes."""
    data = [b"  " + (t or "").lower().encode("utf-8", "replace") + b" " for t in texts]
    flat = LETTERS[np.frombuffer(b"".join(data) + b"  ", np.uint8)]
    starts = np.cumsum([0] + [len(d) for d in data])[:-1]
    letters = np.add.reduceat(flat != 0x20, starts, dtype=np.int64) if len(data) else np.zeros(0, np.int64)
    return (flat[:-2] * 961 + flat[1:-1] * 31 + flat[2:]) % CODES, starts, letters


def histograms(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Per text: the codes seen, how often, and the number of letter bytes. One text at a time, so long ones stay apart."""
    for text in texts:
        c, _, letters = codes([text])
        found = np.bincount(c, minlength=CODES)
        found[BLANK] = 0
        seen = np.flatnonzero(found)
        yield seen, found[seen], int(letters[0])


def _count(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int, np.ndarray] = {}
            for name, (seen, n, _) in zip(batch.column("declared").to_pylist(), histograms(batch.column("text").to_pylist())):
                mine = counts.setdefault(index[name], np.zeros(CODES, np.int64))
                mine[seen] += n
            for at, total in counts.items():
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), at)), pa.array(used), pa.array(total[used])], ["language", "code", "n"])
    return run


@dataclass
class Model:
    """log P(code | language) is ``unseen`` of the language, plus ``more`` for the languages in which the code was seen.

    The latter lie by code: those of code c are at ``first[c]`` to ``first[c + 1]`` of ``language`` and ``more``.
    """
    languages: list[str]
    unseen: np.ndarray
    first: np.ndarray
    language: np.ndarray
    more: np.ndarray

    def logs(self, seen: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log likelihood of a text in every language."""
        total = n.sum() * self.unseen
        sizes = self.first[seen + 1] - self.first[seen]
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(seen):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
            size = sizes[begin:end]
            at = np.repeat(self.first[seen[begin:end]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            total += np.bincount(self.language[at], self.more[at] * np.repeat(n[begin:end], size), len(total))
            begin = end
        return total


def model_of(languages: list[str], language: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    """Model from how often each code was seen in each language."""
    order = np.argsort(code, kind="stable")
    language, code, n = language[order], code[order], n[order]
    totals = np.bincount(language, n, len(languages))
    return Model(languages, np.log(PSEUDO / (totals + PSEUDO * CODES)), np.searchsorted(code, np.arange(CODES + 1)),
                 language.astype(np.int32), np.log1p(n / PSEUDO).astype(np.float32))


def lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _likelihoods(shared):
    """Log likelihoods and text-only posteriors; a text without letters says nothing about its host."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            logs, letters = np.zeros((batch.num_rows, len(model.languages))), np.zeros(batch.num_rows, np.int64)
            for i, (seen, n, found) in enumerate(histograms(batch.column("text").to_pylist())):
                logs[i], letters[i] = model.logs(seen, n), found
            p = normal(TEMPER * logs) if len(logs) else logs
            p[letters == 0] = 0
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), lists(logs), pa.array(letters), lists(p)],
                                             [*keep, "logs", "letters", "p"])
    return run


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Trigram model of every declared language, from a bounded sample of its rows; None if none is declared."""
    spark = rows.sparkSession
    found = rows.where("declared is not null").groupBy("declared").count().orderBy("declared").toArrow()
    languages = found.column("declared").to_pylist()
    if not languages:
        return None
    sizes = spark.createDataFrame(found)
    draw = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) < F.least(F.lit(1.0), sample_rows / F.col("count")) * (1 << 20)
    sample = rows.join(sizes, "declared").where(draw).select("declared", "text")
    counted = (sample.mapInArrow(_count({name: i for i, name in enumerate(languages)}), "language long, code long, n long")
               .groupBy("language", "code").agg(F.sum("n").alias("n")).orderBy("language", "code").toArrow())
    return model_of(languages, *(counted.column(c).to_numpy() for c in ("language", "code", "n")))


def normal(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fuse(text, own, declared, suffix, domain, host, overall) -> np.ndarray:
    """Posteriors. ``text``: log likelihoods; ``own``: text-only posteriors; the others: counts per language and row.

    Counts are of all rows with the same declared language, suffix, domain, host;
    missing evidence is a row of zeros and then says nothing.
    """
    n = overall.sum()
    base = (overall + PSEUDO) / (n + PSEUDO * len(overall))

    def given(counts):  # P(value | language), up to a factor that is equal for all languages
        known = counts.sum(1, keepdims=True) > 0
        return np.where(known, np.log((np.maximum(counts - own, 0) + PSEUDO) / (overall + PSEUDO)[None, :]), 0.0)

    def smooth(counts, parent):
        counts = np.maximum(counts - own, 0)
        return (counts + PARENT_ROWS * parent) / (counts.sum(1, keepdims=True) + PARENT_ROWS)

    prior = np.repeat(base[None, :], len(text), 0)
    for counts in (suffix, domain, host):
        prior = np.where(counts.sum(1, keepdims=True) > 0, smooth(counts, prior), prior)
    return normal(TEMPER * text + given(declared) + np.log(prior))


def _fused(languages: list[str], overall: np.ndarray, least: float):
    levels = ["declared", "suffix", "domain", "host"]

    def stack(column: pa.Array) -> np.ndarray:
        """Arrays as rows; a missing one is a row of zeros."""
        out = np.zeros((len(column), len(languages)))
        there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        out[there] = column.drop_null().flatten().to_numpy().reshape(-1, len(languages))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = fuse(stack(batch.column("logs")), stack(batch.column("p")), *[stack(batch.column(f"{c}_counts")) for c in levels], overall)
            best, sure = p.argmax(1), p.max(1)
            letters = batch.column("letters").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.array(languages, object)[best], pa.string()), pa.array(sure), batch.column("letters"),
                 pa.array((letters > 0) & (sure >= least))], ["key", "language", "confidence", "letters", "accepted"])
    return run


def host_parts(host: Column) -> list[Column]:
    labels = F.split(host, r"\.")
    dotted = F.size(labels) > 1
    return [host.alias("host"),
            F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).alias("domain"),
            F.when(dotted, F.element_at(labels, -1)).alias("suffix")]


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    return F.when(host != "", F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", ""))


def declared_tag(value: Column) -> Column:
    tag = F.lower(F.regexp_extract(value, r"^\s*+([A-Za-z]{1,8})(?![A-Za-z])", 1))  # a primary tag has eight letters at most
    return F.when(tag != "", tag)


def markup_tag(html: Column) -> Column:
    return declared_tag(F.regexp_extract(html, r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([^\"'\s>]*)", 1))


def markup_text(html: Column) -> Column:
    """The text of a page for this purpose: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>", " ")
    return F.regexp_replace(bare, r"&#?\w+;", " ")


def identify(rows: DataFrame, least: float = 0.8, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Languages of ``rows`` (``key, text, declared, host``): ``key, language, confidence, letters, accepted``.

    ``key`` may be of any type. Missing (null) evidence of any kind says nothing.
    A text without letters has the language its other evidence gives and is not
    accepted; others are accepted if the best posterior reaches ``least``. Without
    any declared language no model can be fitted: the language is null and
    nothing is accepted. Ties go to the first language by name. Repeated rows are
    judged alike. An empty table gives an empty result. Every declared language has a
    model, however many there are and however few its rows.
    """
    spark = rows.sparkSession
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.select("key", "text", declared_tag(F.col("declared")).alias("declared"), *host_parts(F.col("host")))
    model = fit(rows, sample_rows)
    if model is None:
        return rows.select("key", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"),
                           F.lit(0).cast("long").alias("letters"), F.lit(False).alias("accepted"))
    parts = "declared string, host string, domain string, suffix string"
    batch = str(max(8, min(1000, CELLS // len(model.languages))))
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=batch):
        scored = written(rows.mapInArrow(_likelihoods(spark.sparkContext.broadcast(model)),
                                         f"key {kind}, {parts}, logs array<double>, letters long, p array<double>"), "language-scored")
    sums = vector_to_array(Summarizer.sum(array_to_vector("p")))
    first = scored.agg(sums.alias("n")).first().n
    overall = np.array(first if first else [0.0] * len(model.languages), float)
    joined = scored
    for level in ("declared", "suffix", "domain", "host"):
        counts = scored.where(F.col(level).isNotNull()).groupBy(level).agg(sums.alias(f"{level}_counts"))
        joined = joined.join(counts, level, "left")
    schema = f"key {kind}, language string, confidence double, letters long, accepted boolean"
    return joined.select("key", "logs", "p", "letters", *[f"{x}_counts" for x in ("declared", "suffix", "domain", "host")]
                         ).mapInArrow(_fused(model.languages, overall, least), schema)


def document_evidence(key: Column, row: str = "") -> list[Column]:
    """From a table of documents: the text, the declared language and the source as host."""
    return [key.alias("key"), F.col(f"{row}text").alias("text"), F.col(f"{row}lang").alias("declared"),
            F.col(f"{row}source").alias("host")]


def page_evidence(key: Column) -> list[Column]:
    """From a table of pages: the markup's text and language tag, and the address."""
    return [key.alias("key"), markup_text(F.col("html")).alias("text"), markup_tag(F.col("html")).alias("declared"),
            url_host(F.col("url")).alias("host")]


def keep_identified(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents whose language is accepted, with their columns; cases as in `identify`."""
    rows = located(docs)
    judged = identify(rows.select(*document_evidence(F.col("at"), "doc.")), least)
    bad = judged.where("not accepted").select(F.col("key").alias("at"))
    return rows.join(materialised(bad), "at", "left_anti").select("doc.*")

