"""A bar table that is changed by commits: batches are taken in once, readers see whole commits only.

Rows lie in Parquet partitions of (partition columns, bucket, period, version): the
bucket is a hash of the rest of the key, the period a year or month of ``ts``, and
files are sorted by key. So there are few files of a good size however many
symbols there are, a symbol's rows lie in one bucket, and a symbol with a large
share of all rows is still split by period. A commit writes new versions of the
cells it touches, then a table of pointers (which version of each cell is valid),
and last a small file that names the pointers.
Only that file makes the commit visible: a run that is killed before leaves the old
table as it was, with files nobody points to. The file also records the last batch
of every source, so a batch given again changes nothing. Two writers cannot both
make the same commit, as the second fails to create its file.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from barloom.operators.layout import join_on
from barloom.operators.quality import one_per_key
from barloom.sources.bars import latest


class BarStore:
    """Bars of ``schema`` under ``path``, one row per ``key``, which holds ``ts`` (not null) and the ``partitions``.

    ``period`` is the date format of a period; ``buckets`` and ``period`` stay the same for the life of a table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: tuple[str, ...] = ("symbol", "ts"),
                 partitions: tuple[str, ...] = (), buckets: int = 16, period: str = "yyyy-MM"):
        self.spark, self.path, self.schema, self.key, self.partitions = spark, path.rstrip("/"), schema, list(key), list(partitions)
        self.buckets, self.period = buckets, period
        self.named = [c for c in self.key if c != "ts" and c not in self.partitions]
        self.places = [*self.partitions, "bucket", "period"]
        self.cells = [*self.places, "version"]

    def _bucket(self, values: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*values), F.lit(self.buckets)).cast("int")

    # --- the log ---

    def _file(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _log(self) -> tuple[int, dict]:
        """Number of the newest commit file, and the content of the newest that was written to its end."""
        fs, folder = self._file("commits")
        if not fs.exists(folder):
            return 0, {}
        names = sorted((f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().isdigit()), reverse=True)
        for name in names:
            with_stream = fs.open(self._file(f"commits/{name}")[1])
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
            finally:
                with_stream.close()
            try:
                return int(names[0]), json.loads(text)
            except ValueError:  # its writer was stopped while writing it
                continue
        return int(names[0]) if names else 0, {}

    def _publish(self, number: int, content: dict) -> None:
        fs, at = self._file(f"commits/{number:012d}")
        out = fs.create(at, False)  # fails if another writer made this commit
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    # --- reading ---

    def _data(self) -> DataFrame:
        typed = StructType([f for f in self.schema if f.name not in self.partitions])
        typed = reduce(lambda s, c: s.add(c, self.schema[c].dataType), self.partitions, typed)
        return self.spark.read.schema(typed.add("bucket", IntegerType()).add("period", StringType()).add("version", StringType())).parquet(f"{self.path}/data")

    def _pointers(self, content: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{content['pointers']}")

    def read(self, start: str | None = None, end: str | None = None, **equal) -> DataFrame:
        """Valid bars with start <= ts < end whose columns equal the given values.

        The conditions select cells (partition columns, the bucket if all of the rest
        of the key is given, periods) and reach the scan as partition and pushed
        filters; versions that are not pointed to are pruned by the join.
        """
        _, content = self._log()
        if not content:
            return self.spark.createDataFrame([], self.schema)
        data, pointers = self._data(), self._pointers(content)
        for name, value in equal.items():
            data = data.where(F.col(name) == value)
            if name in self.partitions:
                pointers = pointers.where(F.col(name) == value)
        if self.named and set(self.named) <= equal.keys():
            bucket = F.col("bucket") == self._bucket([F.lit(equal[c]).cast(self.schema[c].dataType) for c in self.named])
            data, pointers = data.where(bucket), pointers.where(bucket)
        kind = self.schema["ts"].dataType
        for value, keeps in ((start, lambda c, v: c >= v), (end, lambda c, v: c <= v)):
            if value is not None:
                inside = keeps(F.col("period"), F.date_format(F.lit(value).cast(kind), self.period))
                data, pointers = data.where(inside), pointers.where(inside)
        if start is not None:
            data = data.where(F.col("ts") >= F.lit(start).cast(kind))
        if end is not None:
            data = data.where(F.col("ts") < F.lit(end).cast(kind))
        return data.join(pointers, self.cells, "left_semi").select(*self.schema.names)

    # --- writing ---

    def upsert(self, new: DataFrame, source: str, batch: int, order: str | None = None) -> bool:
        """Take in batch number ``batch`` of ``source``; False if it was taken in before.

        A new row replaces the row of its key; of new rows with one key the last by
        ``order`` stays, without it the greatest. Only touched cells are rewritten.
        """
        number, content = self._log()
        taken = content.get("batches", {})
        if batch <= taken.get(source, -1):
            return False
        version = uuid.uuid4().hex
        only = new if order else new.select(*self.schema.names)
        fresh = (one_per_key(only, self.key, order, "last") if order else latest(only, self.key, None)).select(*self.schema.names)
        placed = {"bucket": self._bucket([F.col(c) for c in self.named]), "period": F.date_format("ts", self.period)}
        fresh = fresh.withColumns(placed)
        rows = fresh
        if content:
            # The cells follow from the keys, so repeated rows need not be told apart for them.
            touched = only.select(*self.key).withColumns(placed).select(*self.places).distinct()
            valid = join_on(self._pointers(content), touched, self.places, "left_semi")
            old = self._data().join(valid, self.cells, "left_semi").drop("version")
            rows = join_on(old, fresh.select(*self.key), self.key, "left_anti").unionByName(fresh)
        (rows.withColumn("version", F.lit(version)).repartition(*self.places)
         .sortWithinPartitions(*self.places, *self.named, "ts").write.mode("append").partitionBy(*self.cells).parquet(f"{self.path}/data"))
        if not content:  # the cells are those just written; the rows need not be made again to name them
            touched = self._data().where(F.col("version") == version).select(*self.places).distinct()
        pointers = touched.withColumn("version", F.lit(version))
        if content:
            kept = join_on(self._pointers(content), touched, self.places, "left_anti")
            pointers = kept.unionByName(pointers)
        name = f"pointers/{number + 1:012d}-{version}"
        pointers.write.parquet(f"{self.path}/{name}")
        self._publish(number + 1, {"pointers": name, "batches": {**taken, source: batch}})
        return True


def upsert_stream(stream: DataFrame, store: BarStore, checkpoint: str, source: str = "stream", order: str | None = None):
    """Start taking a stream of bars into a store, a commit per micro-batch; a batch replayed after a failure changes nothing."""
    def take(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch, source, number, order)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
