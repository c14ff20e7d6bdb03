"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words (after A-Z are lower-cased), as a pattern.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session (a test) without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-llm-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, readable after lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet into the shared folder and read back (columnar, so later passes read only their columns)."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(docs: DataFrame) -> DataFrame:
    """``doc`` (the whole row) and ``at`` (file, row): where the content of each row lies.

    A table that is not read straight from Parquet files is written to the shared
    folder first, so that its rows have a place that does not change.
    """
    if re.search(r"\b(Join|Generate|Union|Expand|Aggregate|Window)\b", docs._jdf.queryExecution().analyzed().toString()):
        docs = written(docs, "content")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")
    try:
        return docs.select(row, place)
    except AnalysisException:  # not from files at all
        return written(docs, "content").select(row, place)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``__`` for ``.``) for the length of a block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; no empty strings."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows; reads no further than that."""
    return df.limit(limit + 1).count() <= limit


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows drawn by a hash of their values, twice as many at most; all of a smaller table."""
    share = min(1.0, rows / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * rows)


def broadcast_if(df: DataFrame, limit: int) -> DataFrame:
    """The table marked for broadcast if it has at most ``limit`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if small_enough(df, limit) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys the members of a label are dealt to.
SALTS = 16


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components: ``(node, label)``, the label being the smallest node of the component.

    ``edges`` has columns ``a, b``. Each round every node takes the smallest label
    around it and then the label of that label (pointer jumping), so the number of
    rounds grows with the logarithm of the longest chain. Each round is
    checkpointed; only a count of changes reaches the driver. Joins are on node
    keys; the neighbours of a hot node are reduced before the shuffle. The one join
    on labels takes only labels that have moved, and deals the members of a label
    to ``SALTS`` keys, as one label may have most nodes.
    """
    both = materialised(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
                        .where("a is not null and b is not null and a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = materialised(labels)
    for _ in range(max_rounds):
        around = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                  .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        # A label also hears what its members have heard, so whole trees hook at once.
        heard = (labels.join(around, "node").groupBy(F.col("label").alias("node")).agg(F.min("near").alias("via")))
        step = (labels.join(around, "node").join(heard, "node", "left")
                .select("node", F.least("label", "near", "via").alias("label"), F.col("label").alias("old")))
        step = materialised(step)
        moved = (step.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("far"))
                 .join(step.select("label").distinct(), "label", "left_semi")
                 .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        new = materialised(step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(moved, ["label", "salt"], "left")
                           .select("node", F.least("label", "far").alias("label"), "old"))
        labels = new.select("node", "label")
        if new.where("label <> old").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def worker_memo(name: str) -> dict:
    """A dictionary that a Python worker keeps from task to task."""
    holder = sys.modules.setdefault("_barloom_worker_memo", types.ModuleType("_barloom_worker_memo"))
    return holder.__dict__.setdefault(name, {})


def key_bits(keys: DataFrame, key: str, least: int = 1 << 18, most: int = 1 << 27) -> DataFrame:
    """A bitmap of hashed ``key`` values, one row per 4 KiB: at most ``most`` bits (16 MiB), so it may be broadcast."""
    bits = least
    wanted = 16 * keys.count()
    while bits < min(wanted, most):
        bits *= 2
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    rows = (keys.select(place.alias("_place"))
            .groupBy(F.bitmap_bucket_number("_place").alias("_part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
            .withColumn("_modulus", F.lit(bits)))
    return materialised(rows)


def maybe_in(df: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """Rows whose key may be in the bitmap; drops none whose key is. A false hit only costs later work."""
    first = bits.first()
    if first is None:
        return df.where("false")
    place = F.pmod(F.xxhash64(key), F.lit(first._modulus))
    at = F.bitmap_bit_position("_place").cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
    return (df.withColumn("_place", place).withColumn("_part", F.bitmap_bucket_number("_place"))
            .join(F.broadcast(bits.select("_part", "_bits")), "_part").where(hit).drop("_part", "_bits", "_place"))
