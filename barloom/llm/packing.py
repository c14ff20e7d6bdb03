"""Best-fit packing of tokenised documents into sequences of bounded length.

The pieces' length histogram defines a configuration linear program: cover every
length's count with as few full sequences (configurations) as possible. It is
solved by multiplicative weights: prices per length fall as the length gets
covered, and each round a knapsack dynamic program finds the dearest
configuration at these prices. The fractional solution is rounded down and the
rest goes by best fit, longest first, into the gaps left and into new sequences.
Only the histogram (one row per length) reaches the driver; Spark encodes the
texts, ranks the pieces of each length and looks their places up.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import settings, worker_memo, written

CAPACITY = 4096
#: Rounds of the linear program.
ROUNDS = 250
#: Shares of the fractional solution that are tried in rounding.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.1)
#: Strings a Python worker remembers the ids of (some 150 bytes each, so 30 MB).
CACHE = 200_000
#: Letters below this one are Latin; one of them is two characters in lower case.
LATIN_END, DOTTED = "\u0250", "\u0130"
#: Rows of one length ranked in one task at most (about).
SHARD_ROWS = 200_000


#: Bytes with A-Z lower-cased, and whether a byte is a-z or ASCII punctuation.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A"):ord("Z") + 1] += 32
SMALL, MARK = np.zeros(256, bool), np.zeros(256, bool)
SMALL[ord("a"):ord("z") + 1] = True
MARK[np.frombuffer(string.punctuation.encode(), np.uint8)] = True


class Encoder:
    """Token ids as little-endian 32-bit bytes; equal strings between white space are encoded once.

    The tokenizer lower-cases, drops white space and never joins characters across
    it, so strings between white space can be encoded apart. ASCII punctuation after
    a-z begins a new piece and is cut off first, but for special tokens in a text.
    Strings of Latin letters are one piece each, whose last id carries the word-end
    mark, so many of them are encoded as one text and cut at these marks. Such letters
    need no composing and no pattern to cut them, so they go to the same model without
    these steps, if every one of them has the same ids so.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        memo = worker_memo(f"tokenizer {path}")
        if not memo:
            tokenizer = Tokenizer.from_file(path)
            vocabulary = tokenizer.get_vocab(with_added_tokens=True)
            ends = np.zeros(max(vocabulary.values()) + 1, bool)
            ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            plain = Tokenizer(tokenizer.model)
            plain.normalizer = normalizers.Lowercase()
            plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            letters = [c for c in map(chr, range(ord(LATIN_END))) if c.isalpha() and c != DOTTED]
            probe = " ".join([*letters, *map("".join, zip(letters, letters[1:]))])
            if len({tuple(t.encode(probe, add_special_tokens=False).ids) for t in (plain, tokenizer)}) > 1:
                plain = tokenizer
            memo.update(tokenizer=tokenizer, plain=plain, ends=ends, known={})
        self.tokenizer, self.plain, self.ends, self.known = memo["tokenizer"], memo["plain"], memo["ends"], memo["known"]

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        known: dict[bytes, bytes] = {}
        plain, rest = [], []
        for w in new:
            s = w.decode("utf-8")
            (plain if w.isalpha() or s.isalpha() and max(s) < LATIN_END and DOTTED not in s else rest).append((w, s))
        chunks = [plain[i:i + 512] for i in range(0, len(plain), 512)]
        texts = [" ".join([s for _, s in some]) for some in chunks]
        for some, encoded in zip(chunks, self.plain.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some) or cuts[-1] != 4 * len(ids):
                rest += some
                continue
            data, at = ids.tobytes(), 0
            for (w, _), cut in zip(some, cuts):
                known[w] = data[at:cut]
                at = cut
        for i in range(0, len(rest), 512):
            some = rest[i:i + 512]
            for (w, _), e in zip(some, self.tokenizer.encode_batch([s for _, s in some], add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()
        return known

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of strings without white space, A-Z lower-cased; their pieces are remembered."""
        return self._joined(self._split(words))

    def _joined(self, split: list[list[bytes]]) -> list[bytes]:
        known, full = self.known, len(self.known) >= CACHE
        learnt = self._learn(set().union(*split).difference(known))
        known.update(learnt)
        ids = [b"".join(map(known.__getitem__, parts)) for parts in split]
        if full:  # learnt for these texts only
            for w in learnt:
                del known[w]
        return ids

    @staticmethod
    def _split(texts: list[bytes]) -> list[list[bytes]]:
        flat = LOWERED[np.frombuffer(b"".join(texts), np.uint8)]
        cuts = np.flatnonzero(MARK[flat[1:]] & SMALL[flat[:-1]]) + 1
        ends = np.cumsum([len(t) for t in texts])
        ends = (ends + np.searchsorted(cuts, ends)).tolist()
        data = np.insert(flat, cuts, ord(" ")).tobytes()
        return [t.lower().split() if b"<|" in t else data[a:b].split() for t, a, b in zip(texts, [0, *ends], ends)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return self._joined(self._split([(t or "").encode("utf-8") for t in texts]))


def _encode(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, width = Encoder(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            row, piece, length, crc, ids = [], [], [], [], []
            for i, doc in enumerate(encoder(batch.column("text").to_pylist())):
                doc += end
                for k, at in enumerate(range(0, len(doc), width)):
                    part = doc[at:at + width]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                names.append("ids")
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encoded pieces of the documents: ``doc_id, piece, start, length, ids_crc32`` and, if wanted, ``ids``."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return source.mapInArrow(_encode(tokenizer_path, end_id, capacity, with_ids), schema)


def price(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest configuration at the given value per length, by dynamic programming: its value and counts per length."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = best[c - 1::-1] + value[1:c + 1]
        k = int(options.argmax())
        if options[k] > best[c - 1]:
            best[c], took[c] = options[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if took[c]:
            counts[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return best[capacity], counts


@dataclass
class Plan:
    """``table``: length, first rank, repeats per sequence, first sequence, offset. ``bound``: no packing has fewer."""
    table: np.ndarray
    sequences: int
    bound: float


def solve(histogram: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[float, np.ndarray]], float]:
    """Fractional configurations (copies, counts per length) and a lower bound on the number of sequences."""
    present = np.flatnonzero(histogram)
    if not len(present):
        return [], 0.0
    size, load = np.arange(capacity + 1, dtype=float), np.zeros(capacity + 1)
    chosen, bound = [], float((histogram * size).sum() / capacity)
    rate = min(3.0, max(0.1, 4 * len(present) / max(rounds, 1)))  # few rounds for many lengths: prices fall faster
    for _ in range(rounds):
        value = np.zeros(capacity + 1)
        value[present] = size[present] * np.exp(-rate * (load[present] - load[present].min()))
        worth, counts = price(value, capacity)
        bound = max(bound, float((histogram * value).sum() / worth))  # prices over their dearest configuration are a dual solution
        used = np.flatnonzero(counts)
        copies = float((histogram[used] / counts[used]).min())
        load[used] += copies * counts[used] / histogram[used]
        chosen.append((copies, counts))
    covered = max(1.0, float(load[present].min()))
    return [(copies / covered, counts) for copies, counts in chosen], bound


def plan(histogram: np.ndarray, capacity: int, rounds: int = ROUNDS) -> Plan:
    """Round the linear program's solution and fill up by best fit; work and size depend on lengths, not on pieces.

    The less of the solution is kept as it is, the more is left to best fit: the
    share that needs the fewest sequences is taken.
    """
    chosen, bound = solve(histogram, capacity, rounds)
    total: dict[bytes, float] = {}
    for copies, counts in chosen:
        total[counts.tobytes()] = total.get(counts.tobytes(), 0) + copies
    return min((_rounded(histogram, capacity, total, share, bound) for share in SHARES), key=lambda p: p.sequences)


def _rounded(histogram: np.ndarray, capacity: int, total: dict[bytes, float], share: float, bound: float) -> Plan:
    left = histogram.copy()
    by_free: list[list] = [[] for _ in range(capacity + 1)]  # groups of equal sequences: [copies, {length: repeats}]
    for key, copies in sorted(total.items(), key=lambda kv: -kv[1]):
        counts = np.frombuffer(key, np.int64)
        used = np.flatnonzero(counts)
        copies = min(int(share * copies), int((left[used] // counts[used]).min()))
        if copies > 0:
            left[used] -= copies * counts[used]
            by_free[capacity - int((counts * np.arange(capacity + 1)).sum())].append(
                [copies, {int(n): int(counts[n]) for n in used}])
    open_ = sum(1 << f for f in range(capacity + 1) if by_free[f])  # bit f: a group with f places free
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            fits = open_ >> length
            if fits:
                free = length + (fits & -fits).bit_length() - 1
                group = by_free[free].pop()
                if not by_free[free]:
                    open_ ^= 1 << free
                repeats = max(1, min(free // length, todo // group[0]))
                take = min(group[0], todo)
                if take < group[0]:
                    by_free[free].append([group[0] - take, dict(group[1])])
                    open_ |= 1 << free
                    repeats = 1
            else:
                free = capacity
                repeats = min(capacity // length, todo)
                take = max(1, todo // repeats)
                group = [take, {}]
            todo -= take * repeats
            group = [take, {**group[1], length: group[1].get(length, 0) + repeats}]
            free -= repeats * length
            by_free[free].append(group)
            open_ |= 1 << free
    rank, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for groups in by_free:
        for copies, config in groups:
            offset = 0
            for length, repeats in config.items():
                rows.append((length, rank[length], repeats, sequence, offset))
                rank[length] += copies * repeats
                offset += length * repeats
            sequence += copies
    assert (rank == histogram).all()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return Plan(table[np.lexsort((table[:, 1], table[:, 0]))], sequence, bound)


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = table[:, 0] * (1 << 50) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, first, repeats, sequence, offset = table[np.searchsorted(key, length * (1 << 50) + rank, "right") - 1].T
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(sequence + (rank - first) // repeats),
                 pa.array(offset + (rank - first) % repeats * length)], [*keep, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         capacity: int = CAPACITY, with_ids: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """Place every document into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset`` and, if wanted, ``ids``. A document is its ids and ``end_id``; only
    longer ones are cut. A null or empty text is the end id alone. Repeated rows
    and rows without identifier are packed like others. An empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="250"):
        cut = written(pieces(docs, tokenizer_path, id_col, text_col, end_id, capacity, with_ids), "packing-pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # a row per length
        histogram[length] = n
    shards = max(1, -(-int(histogram.max()) // SHARD_ROWS))
    sharded = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    ranked = sharded.withColumn("within", F.row_number().over(
        Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sharded.groupBy("length", "shard").count().withColumn(
        "before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = ranked.join(starts, ["length", "shard"]).select(
        *cut.columns, (F.col("before") + F.col("within") - 1).alias("rank"))
    places = spark.sparkContext.broadcast(plan(histogram, capacity, rounds).table)  # at most some 90 rows per group of sequences
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(places), schema)
