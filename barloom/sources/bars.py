"""Bar tables: files, keyed range scans, upserts, table creation and exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.quality import one_per_key
from barloom.schemas import PRICE_COLUMNS, TABLES, TIME_NAMES
from barloom.session import cut_lineage

BAR_KEY = ["exchange", "symbol", "timeframe", "ts"]


def normalise(frame: DataFrame) -> DataFrame:
    """Lower-case names; the first of ts / timestamp / time / date becomes ``ts`` in UTC."""
    named = next((c for c in TIME_NAMES if c in frame.columns), None)
    columns = []
    for c in frame.columns:
        if c == named:
            kind = frame.schema[c].dataType.typeName()
            stamp = F.col(c) if kind.startswith("timestamp") else F.to_timestamp(F.col(c))
            columns.append(stamp.alias("ts"))
        else:
            columns.append(F.col(c).alias(c.lower()))
    return frame.select(*columns)


def read_bars(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet or CSV (with header) bars; order is left to the ordered operators."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        return normalise(spark.read.parquet(path))
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return normalise(reader.csv(path))


def range_scan(
    bars: DataFrame, exchange: str | None = None, symbol: str | None = None, timeframe: str | None = None,
    start: datetime | str | None = None, end: datetime | str | None = None,
) -> DataFrame:
    """Bars of one key with start <= ts < end as doubles; the conditions reach the scan."""
    out = bars
    for name, value in (("exchange", exchange), ("symbol", symbol), ("timeframe", timeframe)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    kind = bars.schema["ts"].dataType
    if start is not None:
        out = out.filter(F.col("ts") >= F.lit(start).cast(kind))
    if end is not None:
        out = out.filter(F.col("ts") < F.lit(end).cast(kind))
    return out.select("ts", *[F.col(c).cast("double").alias(c) for c in PRICE_COLUMNS])


def before(bars: DataFrame, until: datetime | str) -> DataFrame:
    return bars.filter(F.col("ts") < F.lit(until).cast(bars.schema["ts"].dataType))


def latest(new: DataFrame, key: list[str], order: str | None) -> DataFrame:
    if order:
        return one_per_key(new, key, order, "last").select(*new.columns)
    others = [c for c in new.columns if c not in key]
    return new.groupBy(*key).agg(F.max(F.struct(*others)).alias("_row")).select(*key, "_row.*").select(*new.columns)


def merged(existing: DataFrame, new: DataFrame, key: list[str] = BAR_KEY, order: str | None = None) -> DataFrame:
    """Existing rows with new rows put in their place.

    Of new rows with one key the last by ``order`` stays, without it the greatest row.
    """
    fresh = latest(new, key, order)
    return existing.join(fresh, key, "left_anti").unionByName(fresh.select(*existing.columns))


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A partitioned bar table with the column types of ``like``.

    The types are given, not inferred: the partition value '1d' would be read as a number.
    """
    return spark.read.schema(like.schema).parquet(path)


def upsert(spark: SparkSession, new: DataFrame, path: str, key: list[str] = BAR_KEY,
           partitions: tuple[str, ...] = ("timeframe", "symbol"), order: str | None = None) -> int:
    """Write new bars into a partitioned parquet table, rewriting only touched partitions.

    Returns the number of rows given.  Rows of one key inside a batch leave one,
    as in ``merged``.  The merge is cut from its source before
    the partitions it was read from are overwritten.
    """
    written = new.count()
    if not written:
        return 0
    target = latest(new, key, order)
    if _has_files(spark, path):
        touched = new.select(*partitions).distinct()
        old = read_table(spark, path, new).join(touched, list(partitions), "left_semi")
        target = cut_lineage(merged(old.select(*new.columns), new, key, order))
    (target.repartition(*partitions, F.month("ts")).sortWithinPartitions(*partitions, "ts").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))
    return written


def _has_files(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the persistent tables that do not exist yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, (columns, partitions) in TABLES.items():
        by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{by}")
    return list(TABLES)


def quality_rows(reports: DataFrame, exchange: str, timeframe: str) -> DataFrame:
    """Report rows in the shape of ``data_quality_runs``; the whole report as JSON."""
    details = F.to_json(F.struct(*[c for c in reports.columns]))
    return reports.select(
        F.lit(exchange).alias("exchange"), "symbol", F.lit(timeframe).alias("timeframe"),
        F.lit(None).cast("timestamp").alias("range_start"), F.lit(None).cast("timestamp").alias("range_end"),
        "n_candles", "n_gaps", "n_duplicates", "n_anomalies", "passed", details.alias("details"))


def save_quality_run(reports: DataFrame, path: str, exchange: str, timeframe: str) -> None:
    rows = quality_rows(reports, exchange, timeframe).withColumn("created_at", F.current_timestamp())
    rows.write.mode("append").parquet(path)


def write_trades(blotter: DataFrame, path: str) -> None:
    blotter.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(metrics: DataFrame, path: str, keys: list[str], timeframe: str) -> None:
    """One JSON object per run: timeframe, metrics, n_trades."""
    values = [c for c in metrics.columns if c not in keys]
    metrics.select(*keys, F.lit(timeframe).alias("timeframe"), F.struct(*values).alias("metrics"),
                   F.col("n_trades")).write.mode("overwrite").json(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet or CSV by the name of the target."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        bars.write.mode("overwrite").parquet(path)
    else:
        bars.write.mode("overwrite").option("header", True).csv(path)


def params_of(raw: DataFrame, payload: str) -> DataFrame:
    """Parameter documents as a map: ``best_params`` of an optimiser result, or the document.

    A null or empty document gives an empty map, which means the defaults.
    """
    best = F.from_json(F.get_json_object(payload, "$.best_params"), "MAP<STRING,DOUBLE>")
    whole = F.from_json(F.col(payload), "MAP<STRING,DOUBLE>")
    has_best = F.array_contains(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), "best_params")
    empty = F.create_map().cast("map<string,double>")
    return raw.withColumn("params", F.coalesce(F.when(has_best, best).otherwise(whole), empty)).drop(payload)


def pair_params(symbols: DataFrame, params: DataFrame) -> DataFrame:
    """Symbols with their parameters; a symbol without any gets the empty map."""
    empty = F.create_map().cast("map<string,double>")
    return symbols.join(params, "symbol", "left").withColumn("params", F.coalesce("params", empty))
