"""Benchmark decontamination by winnowing.

Texts become arrays of words. A window is ``span`` consecutive item words (an item
of fewer words is one window of its own length). For windows of n words, k-gram
hashes are taken at each position and of every w = n - k + 1 neighbouring ones the
smallest is kept, so two texts that share n words keep the same hash inside them:
no shared window is missed. Kept hashes of documents and benchmark are joined,
and each hit is extended to the windows around it, which are compared as text.
JVM functions only; one pass over the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import located, materialised, small_enough, words_of, written

#: Bits of a position in a text of at most 2 GiB, kept below the hash bits.
POSITION_BITS = 30
#: Words in a fingerprint; shorter windows are fingerprinted whole.
GRAM = 6
#: Fingerprints of a benchmark up to this number are broadcast (16 bytes each); beyond, the join is shuffled.
BROADCAST_FINGERPRINTS = 1_000_000

def no_hashes() -> Column:
    return F.array().cast("array<long>")



def gram(length: int) -> int:
    return min(GRAM, length)


def _grams(k: int) -> Column:
    """Hash of the k words from each position, above the position."""
    n = F.size("words")
    one = lambda i: F.shiftleft(F.xxhash64(F.slice("words", i + 1, F.lit(k))), POSITION_BITS).bitwiseOR(i.cast("long"))
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), one)).otherwise(no_hashes())


def _least(grams: Column, w: int) -> Column:
    """The smallest of each w neighbouring hashes."""
    one = lambda i: F.least(*[F.get(grams, i + j) for j in range(w)]) if w > 1 else F.get(grams, i)
    return F.when(F.size(grams) >= w, F.transform(F.sequence(F.lit(0), F.size(grams) - w), one)).otherwise(no_hashes())


def with_winnowed(df: DataFrame, lengths: list[int], into: str) -> DataFrame:
    """Add the kept hashes (hash bits above position bits) of ``words`` for windows of each length."""
    grams = {k: f"_grams{k}" for k in sorted({gram(length) for length in lengths})}
    df = df.select("*", *[_grams(k).alias(name) for k, name in grams.items()])
    kept = [_least(F.col(grams[gram(length)]), length - gram(length) + 1) for length in lengths]
    return df.withColumn(into, F.array_distinct(F.concat(*kept))).drop(*grams.values())


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """Distinct windows of the items: ``window`` (words joined by a space), ``length, items`` (sorted ids as text)."""
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"),
                             words_of(F.col(f"`{text_col}`")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(span))
    return (items.withColumn("length", length)
            .select("item", "length", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("at"))
            .select("item", "length", F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("window"))
            .groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  broadcast_limit: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """Per row of ``docs``: ``at, doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Words are runs of a-z, digits and characters beyond ASCII, after A-Z became
    lower case. A document word is hit if it lies in an occurrence of a window.
    Null and empty texts have no words; a document without hits has the digest of
    an empty list. Repeated rows are judged one by one; items with the same id
    count once, an item without id under an empty id. An empty benchmark leaves
    every document clean, an empty table gives an empty result. Other columns are
    ignored.
    """
    return _judged(located(docs), benchmark, span, id_col, text_col, item_col, item_text_col, broadcast_limit)


def _judged(rows, benchmark, span=10, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
            broadcast_limit=BROADCAST_FINGERPRINTS) -> DataFrame:
    windows = materialised(benchmark_windows(benchmark, item_col, item_text_col, span))
    # At most ``span`` different lengths.
    lengths = sorted(r.length for r in windows.select("length").distinct().collect()) or [span]
    prints = materialised(
        with_winnowed(windows.select(F.split("window", " ").alias("words")), lengths, "kept")
        .select(F.explode("kept").alias("v")).select(_hash("v").alias("print")).distinct())

    source = rows.select("at", F.col(f"doc.`{id_col}`").alias("doc_id"),
                         words_of(F.col(f"doc.`{text_col}`")).alias("words"))
    # Each document also gets one row of its own, marked -1, which no real hash can be.
    marked = with_winnowed(source, lengths, "kept").select(
        "at", "doc_id", "words", F.explode(F.concat(F.array(F.lit(-1).cast("long")), "kept")).alias("v"))
    first = F.greatest(F.col("pos") - (span - 1), F.lit(0))
    placed = marked.withColumn("pos", F.col("v").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int"))
    n_words = F.when(F.col("v") == -1, F.size("words")).alias("n_words")
    around = F.when(F.col("v") != -1, F.slice("words", first + 1, F.lit(2 * span))).alias("around")
    thin = ["at", "doc_id", n_words, "pos", around]
    if small_enough(prints, broadcast_limit):
        hit = placed.withColumn("print", _hash("v")).join(F.broadcast(prints.withColumn("known", F.lit(True))), "print", "left")
        hit = written(hit.where("known or v = -1").select(*thin), "decon-hits")
    else:
        all_ = written(placed.select(_hash("v").alias("print"), *thin), "decon-prints")
        hit = all_.where("n_words is null").join(prints, "print").drop("print").unionByName(
            all_.where("n_words is not null").drop("print"))

    found = None
    for length in lengths:
        w = length - gram(length) + 1
        lo = F.greatest(F.col("pos") - (w - 1), F.lit(0))
        hi = F.least(F.col("pos"), first + F.size("around") - length)
        part = (hit.where("n_words is null").select("at", "around", first.alias("first"), lo.alias("lo"), hi.alias("hi"))
                .where("lo <= hi").select("at", "around", "first", F.explode(F.sequence("lo", "hi")).alias("start"))
                .select("at", "start", F.lit(length).alias("length"),
                        F.array_join(F.slice("around", F.col("start") - F.col("first") + 1, F.lit(length)), " ").alias("window")))
        found = part if found is None else found.unionByName(part)
    found = found.distinct().join(windows, ["window", "length"]).select("at", "start", "length", "items")
    found = materialised(found)

    before = Window.partitionBy("at").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    covered = (found.select("at", F.greatest(end - F.greatest(F.col("start"), reached), F.lit(0)).alias("new"))
               .groupBy("at").agg(F.sum("new").alias("n_hit")))
    items = (found.select("at", "items").distinct().groupBy("at")
             .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (hit.where("n_words is not null").select("at", "doc_id", F.col("n_words").cast("long"))
            .join(covered, "at", "left").join(items, "at", "left")
            .select("at", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                    F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")))


def _hash(v: str) -> Column:
    return F.shiftright(v, POSITION_BITS)


def keep_clean(docs: DataFrame, benchmark: DataFrame, span: int = 10, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns; cases as in `contamination`."""
    rows = located(docs)
    bad = _judged(rows, benchmark, span, id_col, text_col).where("contaminated").select("at")
    return rows.join(bad, "at", "left_anti").select("doc.*")
