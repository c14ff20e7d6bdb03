"""Exact deduplication by a stateful stream.

A structured stream folds every row into keyed state held by RocksDB on disk and
checkpointed in the shared folder. The state has no expiry; per digest it keeps
the stable identifier and the content locator (file and row) of the row that
stays, and the number of rows. Rows whose digest is shared are then checked
against the located content byte for byte; rows that only share the digest are
grouped by their bytes. JVM functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import fresh_path, located, materialised, settings, written

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


#: Megabytes that the state stores of an executor may hold; the rest lies on disk.
STORE_MB = "128"


def fold(feed: DataFrame, files_per_batch: int) -> DataFrame:
    """Run the stream over ``feed`` and return its state: ``digest, keep, group_size``."""
    spark = feed.sparkSession
    path, state = fresh_path(spark, "dedup-feed"), fresh_path(spark, "dedup-state")
    feed.write.parquet(path)
    # Many small stores: without files allocated ahead, and with one bound on the memory of all stores of an executor.
    with settings(spark, spark__sql__streaming__stateStore__providerClass=STATE_STORE,
                  spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
                  spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
                  spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB=STORE_MB):
        rows = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        kept = rows.groupBy("digest").agg(F.min("row").alias("keep"), F.count("*").alias("group_size"))
        query = (kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", state)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        if query.lastProgress is None:  # an empty table: no batch ran, so there is no state
            return spark.createDataFrame([], kept.schema)
        store = spark.read.format("statestore").load(state)
        keep, size = store.schema["value"].dataType.names[:2]
        return materialised(store.select("key.digest", F.col("value")[keep].alias("keep"),
                                         F.col("value")[size].alias("group_size")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest=sha256, files_per_batch: int = 4096) -> DataFrame:
    """One row per row of ``docs``: ``at, doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of white space became one space;
    of equal texts the row with the smallest identifier stays, of rows with the
    same identifier the first by file and row. A null text counts as empty; a null
    identifier comes after all others. An empty table gives an empty result. Other
    columns are ignored, so their names cannot clash.
    """
    return _judged(located(docs), id_col, text_col, digest, files_per_batch)


def _judged(rows: DataFrame, id_col: str, text_col: str, digest=sha256, files_per_batch: int = 4096) -> DataFrame:
    source = rows.select(F.col(f"doc.`{id_col}`").alias("doc_id"), F.col(f"doc.`{text_col}`").alias("text"), "at")
    content = normalised(F.col("text"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("at").alias("at"))
    feed = written(source.select(digest(content).alias("digest"), row.alias("row"),
                                 F.sha2(content, 256).alias("text_sha256")), "dedup-rows")
    state = fold(feed.select("digest", "row"), files_per_batch)

    # Full bytes, for shared digests only: each row against the content at the locator.
    shared = state.where("group_size > 1").select("digest", "keep")
    hits = source.select(digest(content).alias("digest"), content.alias("content"), "at").join(shared, "digest")
    hits = written(hits.select("digest", "content", "at", (F.col("at") == F.col("keep.at")).alias("is_keep")),
                   "dedup-hits")
    keeper = hits.where("is_keep").select("digest", F.col("content").alias("kept_content"))
    others = hits.where("not is_keep").join(keeper, "digest")
    differs = materialised(others.where("content <> kept_content").select("digest", "content", F.col("at").alias("at")))

    result = feed.join(state, "digest", "left").select(
        "digest", "text_sha256", "row", F.col("keep").alias("first"), F.col("group_size").alias("n"))
    if differs.limit(1).count():
        result = _split(result, differs)
    return result.select(
        F.col("row.at"), F.col("row.id").alias("doc_id"), F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"), (F.col("row.at") == F.col("first.at")).alias("kept"), "text_sha256")


def _split(result: DataFrame, differs: DataFrame) -> DataFrame:
    """Take rows that share a digest but not their bytes out of the digest's group and group them by bytes."""
    odd = differs.join(result.select("digest", "row", F.col("row.at").alias("at")), ["digest", "at"])
    groups = odd.groupBy("digest", "content").agg(F.min("row").alias("own_first"), F.count("*").alias("own_n"))
    odd = odd.join(groups, ["digest", "content"]).select("digest", F.col("at").alias("odd_at"), "own_first", "own_n")
    gone = differs.groupBy("digest").agg(F.count("*").alias("gone"))
    return (result.join(gone, "digest", "left")
            .join(odd.withColumnRenamed("digest", "odd_digest"),
                  (F.col("digest") == F.col("odd_digest")) & (F.col("row.at") == F.col("odd_at")), "left")
            .select("digest", "text_sha256", "row", F.coalesce("own_first", "first").alias("first"),
                    F.coalesce(F.col("own_n"), F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; cases as in `deduplicate`."""
    rows = located(docs)
    dropped = _judged(rows, id_col, text_col).where("not kept").select("at")
    return rows.join(dropped, "at", "left_anti").select("doc.*")
