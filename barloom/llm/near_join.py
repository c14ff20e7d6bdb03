"""Similarity join on word n-grams by MinHash banding.

Every text becomes its set of hashed word n-grams. Texts with equal sets are one
node. A node's MinHash signature is cut into bands; nodes meet where a band's hash
is equal. Numbers of bands and rows follow from the wanted recall at the
threshold. Pairs that meet are verified on their full sets. A meeting place is
split into blocks of bounded size, and each pair of blocks is one unit of work
that holds its pairs in memory and gives back per node its number of links and an
edge to its group, never the pairs themselves.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import components, key_bits, located, materialised, maybe_in, settings, written

#: The most hash functions a signature may have, and nodes in a block.
MAX_HASHES, BLOCK = 256, 128
#: Where all pairs are held against each other a block has up to so many times the nodes, if their n-grams are not more than that.
WIDE, BLOCK_GRAMS = 8, 1 << 19
#: Distinct words a task remembers the hashes of.
WORD_CACHE = 100_000
#: Columns of the incidence matrix held at once.
MATRIX_COLUMNS = 4096
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def choose_bands(threshold: float, recall: float) -> tuple[int, int]:
    """Bands and rows per band: the most rows (fewest chance meetings) that reach ``recall`` at ``threshold``."""
    for rows in range(16, 0, -1):
        miss = 1 - threshold ** rows
        bands = 1 if miss <= 0 else math.ceil(math.log(1 - recall) / math.log(miss))
        if bands * rows <= MAX_HASHES:
            return max(1, bands), rows
    raise ValueError("no banding within the hash functions allowed; lower the recall or raise the threshold")


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, n: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; a shorter text is one n-gram, one without words none."""
    found = WORD.findall((text or "").encode("utf-8", "replace").lower())
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(n, len(found))
    total = np.full(len(found) - k + 1, k, np.uint64)
    for i in range(k):
        total = mixed(total + h[i:len(found) - k + 1 + i])
    return np.unique(total)


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        x = (mixed(grams) >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(least, (self.a * x[None, i:i + 1024] + self.b).min(axis=1), out=least)
        total = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in least.reshape(self.bands, self.rows).T.astype(np.uint64):
            total = mixed(total * np.uint64(0x100000001B3) + column)
        return total.view(np.int64)


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signer = _Words(), Signer(bands, rows)
        for batch in batches:
            digests, counts, signed = [], [], []
            for text in batch.column("text").to_pylist():
                grams = shingles(text, n, words)
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                counts.append(len(grams))
                signed.append(signer(grams) if len(grams) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), batch.column("doc_id"), pa.array(digests, pa.binary()),
                 pa.array(counts, pa.int64()), _lists(signed, pa.int64())], ["at", "doc_id", "digest", "n", "bands"])
    return run


def _shingle(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            grams = [shingles(t, n, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("at"), _lists(grams, pa.int64())], ["at", "grams"])
    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set."""
    sizes = [len(x) for x in left + right]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, ids, counts = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    keep = counts[ids] > 1
    owner, ids = owner[keep], np.unique(ids[keep], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, MATRIX_COLUMNS):
        a, b = np.searchsorted(ids, [lo, lo + MATRIX_COLUMNS])
        dense = np.zeros((len(sizes), MATRIX_COLUMNS), np.float32)
        dense[owner[a:b], ids[a:b] - lo] = 1
        out += dense[:len(left)] @ dense[len(left):].T
    return out.astype(np.int64)


def linked(band: int, mine: dict, theirs: dict | None, threshold: float):
    """Verify one unit of work: ``(index, links, partners, root)`` per node with links; indexes run over both blocks."""
    other = mine if theirs is None else theirs
    allowed = np.triu(np.ones((len(mine["n"]), len(mine["n"])), bool), 1) if theirs is None else np.ones(
        (len(mine["n"]), len(theirs["n"])), bool)
    for b in range(band):  # a pair counts only where it first meets
        allowed &= mine["bands"][:, None, b] != other["bands"][None, :, b]
    sizes = np.minimum.outer(mine["n"], other["n"]) >= threshold * np.maximum.outer(mine["n"], other["n"]) - 1e-9
    allowed &= sizes
    rows, cols = np.flatnonzero(allowed.any(1)), np.flatnonzero(allowed.any(0))
    if not len(rows):
        return []
    shared = _overlaps([mine["grams"][i] for i in rows], [other["grams"][j] for j in cols])
    union = mine["n"][rows][:, None] + other["n"][cols][None, :] - shared
    part = allowed[np.ix_(rows, cols)] & (shared >= threshold * union - 1e-9)
    if not part.any():
        return []
    offset = 0 if theirs is None else len(mine["n"])
    size = len(mine["n"]) + (0 if theirs is None else len(theirs["n"]))
    near = np.zeros((size, size), bool)
    near[np.ix_(rows, cols + offset)] = part
    near |= near.T
    weight = mine["weight"] if theirs is None else np.concatenate([mine["weight"], theirs["weight"]])
    links, partners = near @ weight, near.sum(1)
    root, todo = np.full(size, -1), partners > 0
    while todo.any():
        start = int(np.argmax(todo))
        group = np.zeros(size, bool)
        edge = group.copy()
        edge[start] = group[start] = True
        while edge.any():
            edge = near[edge].any(0) & ~group
            group |= edge
        root[group] = start
        todo &= ~group
    return [(int(i), int(links[i]), int(partners[i]), int(root[i])) for i in np.flatnonzero(partners)]


def _block(rows: list) -> dict:
    return {"node": [r[0] for r in rows], "n": np.array([len(r[1]) for r in rows], np.int64),
            "grams": [r[1] for r in rows], "bands": np.stack([r[2] for r in rows]),
            "weight": np.array([r[3] for r in rows], np.int64)}


UNIT = ["band", "meet", "p", "q"]
LINKS = "node long, links long, partners long, root long"


def _verify(threshold: float, classes_only: bool = False):
    def unit(key, rows):
        guests = [r[:4] for r in rows if r[4] == LEAST] if classes_only and key[2] == key[3] else []
        if guests:  # met before or not: this holds the blocks of a place together
            inside = [r for r in rows if r[4] != LEAST]
            names = [guests[0][0], *(r[0] for r in inside)]
            tied = linked(0, _block(guests), _block([r[:4] for r in inside]), threshold) if inside else []
            return unit(key, inside) + [(names[i], links, partners, names[root]) for i, links, partners, root in tied]
        own = [r[:4] for r in rows if r[4] == key[2]]
        far = [r[:4] for r in rows if r[4] != key[2]] if key[2] != key[3] else []
        if not own or (key[2] != key[3] and not far):
            return []
        names = [r[0] for r in own + far]
        return [(names[i], links, partners, names[root]) for i, links, partners, root in
                linked(key[0], _block(own), _block(far) if far else None, threshold)]

    def out(found):
        node, links, partners, root = zip(*found)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (node, links, partners, root)], ["node", "links", "partners", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        for batch in batches:  # sorted by unit, so one unit is held at a time
            lists = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("grams", "bands")}
            cut = lambda c, i: lists[c][1][lists[c][0][i]:lists[c][0][i + 1]]
            keys = list(zip(*(batch.column(c).to_pylist() for c in UNIT)))
            nodes, weights, own = (batch.column(c).to_pylist() for c in ("node", "weight", "block"))
            for i, now in enumerate(keys):
                if now != key:
                    found += unit(key, rows) if rows else []
                    key, rows = now, []
                    if len(found) > 5000:
                        yield out(found)
                        found = []
                rows.append((nodes[i], cut("grams", i).copy(), cut("bands", i).copy(), weights[i], own[i]))
        found += unit(key, rows) if rows else []
        if found:
            yield out(found)
    return run


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999, id_col: str = "doc_id",
         text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``at, doc_id, class_id, n_links, n_partners, class_size, kept``.

    ``class_id`` is the smallest identifier of the documents joined by links, the
    row with it (the first by file and row) is ``kept``. ``n_links`` counts the
    other documents of a Jaccard similarity of at least ``threshold``, copies
    included; ``n_partners`` the different texts among them. Words as in
    `decontaminate`. A text shorter than ``n`` words is one n-gram; null, empty and
    wordless texts have none and are one class. Null identifiers come after all
    others. An empty table gives an empty result. Other columns are ignored.
    """
    return _joined(located(docs), n, threshold, recall, id_col, text_col, block)


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("a"), F.col("root").alias("b"))


#: The block of a meeting place's least node, which every block of the place is held against.
LEAST = -1


def _own_blocks(members: DataFrame, blocks) -> DataFrame:
    """Units of one block each, with the least node of the place as a guest: a row per member, and one per block."""
    own = members.withColumns({"p": F.col("block"), "q": F.col("block")})
    guests = (own.where((blocks > 1) & (F.col("node") == F.col("least"))).withColumn("home", F.col("block"))
              .withColumn("p", F.explode(F.sequence(F.lit(0), blocks - 1))).where("p <> home")
              .withColumns({"q": F.col("p"), "block": F.lit(LEAST)}).drop("home"))
    return own.unionByName(guests)


def _across(members: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Units for the pairs of a place whose nodes are not yet in one class.

    A class with more members in a place than a block holds gets blocks of its own;
    the rest share blocks. Blocks of one class are not held against each other, so
    a place that is one class costs nothing, and a large class with few strays
    costs a row per member and stray block.
    """
    place = ["band", "meet"]
    known = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = known.groupBy(*place, "label").agg(F.count("*").alias("n"))
    large = F.when(F.col("n") > block, F.col("label"))
    of = (sizes.withColumn("of", large).groupBy(*place, "of").agg(F.sum("n").alias("n"), F.count("*").alias("classes"))
          .withColumn("parts", F.ceil(F.col("n") / block).cast("int")))
    mixed = of.groupBy(*place).agg(F.sum("classes").alias("all")).where("all > 1").drop("all")
    of = materialised(of.join(mixed, place))
    name = lambda of, part: F.xxhash64(of, part)
    every = of.select(*place, F.col("of").alias("to"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    every = every.select(*place, "to", name("to", "part").alias("other"))
    placed = (known.join(sizes, [*place, "label"]).withColumn("of", large).drop("n").alias("m")
              .join(of.alias("o"), (F.col("m.band") == F.col("o.band")) & (F.col("m.meet") == F.col("o.meet")) & F.col("m.of").eqNullSafe(F.col("o.of")))
              .select("m.node", "m.band", "m.meet", "m.of", name(F.col("m.of"), F.pmod(F.xxhash64("m.node", "m.band"), F.col("o.parts")).cast("int")).alias("block")))
    pairs = placed.join(every, place).where("of IS NULL OR to IS NULL OR of <> to")
    return pairs.select("node", *place, "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))


def _joined(rows, n, threshold, recall, id_col, text_col, block=BLOCK, classes_only=False) -> DataFrame:
    """As `join`. With ``classes_only`` links between texts that are in one class anyway are not all sought, so their numbers are too small."""
    spark = rows.sparkSession
    bands, per_band = choose_bands(threshold, recall)
    source = rows.select("at", F.col(f"doc.`{id_col}`").alias("doc_id"), F.col(f"doc.`{text_col}`").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    place = "at struct<file:string,row:bigint>"
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="128"):
        signed = written(source.mapInArrow(
            _sign(n, bands, per_band), f"{place}, doc_id {id_type}, digest binary, n long, bands array<long>"), "near-signed")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "at")).alias("first")
        # Nodes go by a number, not by their digest: Spark takes the least of numbers by hashing, of byte strings by sorting twice.
        nodes = written(signed.groupBy("digest").agg(first, F.count("*").alias("weight"), F.any_value("bands").alias("bands"), F.any_value("n").alias("n"))
                        .withColumn("node", F.monotonically_increasing_id()), "near-nodes")

        met = nodes.select("node", "n", F.posexplode("bands").alias("band", "meet"))
        places = (met.groupBy("band", "meet")
                  .agg(F.count("*").alias("members"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("x"),
                       F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.sum("n").alias("grams")).where("members > 1")
                  # Places with the same members are one; the lowest band keeps "first meeting" right.
                  .groupBy("members", "x", "y").agg(F.min(F.struct("band", "meet", "least", "grams")).alias("place"))
                  .select("place.band", "place.meet", "members", "place.least", "place.grams"))
        members = materialised(met.drop("n").join(places, ["band", "meet"]))
        wanted = materialised(members.select("node").distinct().join(nodes, "node")
                              .select("node", "bands", "weight", F.col("first.at").alias("at")))
        texts = maybe_in(source.select("at", "text"), F.col("at"), key_bits(wanted.select("at"), "at"))
        sets = texts.mapInArrow(_shingle(n), f"{place}, grams array<long>").join(wanted, "at").drop("at")

        def verified(units):
            units = units.select("node", *UNIT, "block").join(sets, "node")
            return materialised(units.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(_verify(threshold, classes_only), LINKS))

        blocks = F.ceil(F.col("members") / block)
        if not classes_only:  # a member makes a row for every block of its place: the fewer blocks, the fewer rows
            blocks = F.least(blocks, F.greatest(F.ceil(F.col("members") / (WIDE * block)), F.ceil(F.col("grams") / BLOCK_GRAMS)))
        blocks = blocks.cast("int")
        own = F.pmod(F.xxhash64("node", "band"), blocks).cast("int")
        members = members.withColumn("block", own)
        if not classes_only:
            found = verified(members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
                             .withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}))
            labels = components(_edges(found))
        else:
            found = verified(_own_blocks(members, blocks))
            labels = components(_edges(found))
            apart = materialised(_across(members.where(F.col("members") > block), labels, block))
            if apart.limit(1).count():
                found = found.unionByName(verified(apart))
                labels = components(_edges(found))

    # Numbers of links are whole only if all pairs were verified.
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))
    label = F.coalesce("label", "node")
    named = materialised(nodes.select("node", "digest", "first", "weight").join(labels, "node", "left").join(links, "node", "left")
                         .select("digest", label.alias("label"), "first", "weight",
                                 F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("partners", F.lit(0)).alias("partners")))
    classes = named.groupBy("label").agg(F.min("first").alias("head"), F.sum("weight").alias("class_size"))
    known = named.join(classes, "label").select("digest", "head", "class_size", "weight", "links", "partners")
    return signed.select("at", "doc_id", "digest").join(known, "digest").select(
        "at", "doc_id", F.col("head.id").alias("class_id"), (F.col("links") + F.col("weight") - 1).alias("n_links"),
        F.col("partners").alias("n_partners"), "class_size", (F.col("at") == F.col("head.at")).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999,
             id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with their columns; cases as in `join`.

    Only classes count here, so a large group of near copies is not compared pair by
    pair: within blocks, with one member of the group, and then only where two
    members of a meeting place are still in different classes.
    """
    rows = located(docs)
    dropped = _joined(rows, n, threshold, recall, id_col, text_col, block, True).where("not kept").select("at")
    return rows.join(dropped, "at", "left_anti").select("doc.*")
