"""Bar, candle and ledger tables derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import layout


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier: (symbol, ts, open, high, low, close, volume).

    The mean discount of a day less 0.05 is a zero-mean shock; its running sum is
    the log price.  Sums are over integers, so they do not depend on row order.

    A supplier has no more bars than items. If those fit in a block, items go to
    their supplier's task in one shuffle, and bars need no other; else days are added
    up first, wherever they are, so that no task holds a large supplier's items.
    """
    items = table(spark, sf_dir, "lineitem")
    most = layout.longest_series(items, ("l_suppkey",))
    short = most <= layout.BLOCK
    items = items.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.col("l_shipdate").alias("ts"),
        F.round(F.col("l_discount") * 100).cast("long").alias("ds"), F.round(F.col("l_tax") * 100).cast("long").alias("tx"),
        "l_quantity")
    daily = (items.repartition("symbol") if short else items).groupBy("symbol", "ts").agg(
        F.sum("ds").alias("ds"), F.count(F.lit(1)).alias("n"), F.max("tx").alias("tx"), F.sum("l_quantity").alias("volume"))
    series = layout.lay_out(layout.bounded(daily, ("symbol",), most), ("symbol",))
    shock = F.col("ds").cast("double") / (100.0 * F.col("n")) - 0.05
    series = layout.running(series, {"_log": ("sum", shock)})
    series = series.with_columns({"close": F.round(100.0 * F.exp("_log"), 6)})
    series = layout.previous(series, {"open": "close"})
    opened = F.coalesce(F.col("open"), F.lit(100.0))
    bars = series.df.select(
        "symbol", "ts", opened.alias("open"),
        F.round(F.greatest(opened, F.col("close")) * (1 + F.col("tx") / 2000.0), 6).alias("high"),
        F.round(F.least(opened, F.col("close")) * (1 - F.col("tx") / 2000.0), 6).alias("low"),
        "close", "volume")
    return layout.bounded(bars, ("symbol",), most)


WALK_BARS_SQL = """
  SELECT symbol, ts, open,
         round(greatest(open, close) * (1 + tx / 2000.0), 6) AS high,
         round(least(open, close) * (1 - tx / 2000.0), 6) AS low, close, volume
  FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 100.0) AS open
        FROM (SELECT symbol, ts, tx, volume,
                     round(100 * exp(sum(cast(ds AS double) / (100.0 * n) - 0.05)
                           OVER (PARTITION BY symbol ORDER BY ts)), 6) AS close
              FROM (SELECT concat('S', cast(l_suppkey AS varchar)) AS symbol, l_shipdate AS ts,
                           sum(cast(round(l_discount * 100) AS bigint)) AS ds, count(*) AS n,
                           max(cast(round(l_tax * 100) AS bigint)) AS tx, sum(l_quantity) AS volume
                    FROM lineitem GROUP BY 1, 2)))
"""


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type; gappy and dirty."""
    ticks = table(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    return (
        ticks.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar"))
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
             F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .withColumnRenamed("bar", "ts")
    )


EVENT_BARS_SQL = """
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         arg_min(value, {'t': ts, 'i': event_id}) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, {'t': ts, 'i': event_id}) AS close, cast(count(*) AS double) AS volume
  FROM events GROUP BY 1, 2
"""


def _epoch_ms(ts: str = "ts") -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _price_text(name: str) -> Column:
    return F.format_string("%.6f", F.col(name))


def candle_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk bars as exchange JSON: (symbol, seq, as_object, as_array).

    Every tenth day of the month is delivered twice, the second time with a
    higher close, as overlapping pages do.
    """
    bars = walk_bars(spark, sf_dir)
    copies = F.when(F.dayofmonth("ts") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = bars.withColumn("seq", F.explode(copies)).withColumn("close", F.col("close") + F.col("seq"))
    obj = F.format_string('{"t":%d,"o":"%s","h":"%s","l":"%s","c":"%s","v":"%s"}', _epoch_ms(),
                          *[_price_text(c) for c in ("open", "high", "low", "close", "volume")])
    arr = F.format_string("[%d,%s,%s,%s,%s,%s]", _epoch_ms(),
                          *[_price_text(c) for c in ("open", "high", "low", "close", "volume")])
    long_names = F.format_string('{"ts":%d,"open":%s,"high":%s,"low":%s,"close":%s,"volume":%s}', _epoch_ms(),
                                 *[_price_text(c) for c in ("open", "high", "low", "close", "volume")])
    return rows.select(
        "symbol", F.col("seq").cast("long").alias("seq"), obj.alias("as_object"),
        F.when(F.dayofmonth("ts") % 2 == 0, arr).otherwise(long_names).alias("as_mixed"))


def faulty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk bars with damage by day of month; ``ingest_seq`` is the delivery order."""
    day = F.dayofmonth("ts")
    copies = F.when(day == 28, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        walk_bars(spark, sf_dir).filter(day != 25)
        .withColumns({
            "high": F.when(day == 13, F.col("low") - 1).otherwise(F.col("high")),
            "volume": F.when(day == 17, -F.col("volume")).otherwise(F.col("volume")),
            "close": F.when(day != 21, F.col("close")),
            "_copy": F.explode(copies),
        })
        # Delivery order: by time, but bars of the 19th arrive a day late.
        .withColumn("ingest_seq", _epoch_ms() * 2 + F.col("_copy") + F.when(day == 19, 3 * 86_400_000).otherwise(0))
        .withColumn("close", F.col("close") + F.col("_copy"))
        .drop("_copy")
    )


FAULTY_BARS_SQL = f"""
  SELECT symbol, ts, open, CASE WHEN day(ts) = 13 THEN low - 1 ELSE high END AS high, low,
         CASE WHEN day(ts) <> 21 THEN close END + cp AS close,
         CASE WHEN day(ts) = 17 THEN -volume ELSE volume END AS volume,
         epoch_ms(ts) * 2 + cp + CASE WHEN day(ts) = 19 THEN 3 * 86400000 ELSE 0 END AS ingest_seq
  FROM ({WALK_BARS_SQL}), (VALUES (0), (1)) c(cp)
  WHERE day(ts) <> 25 AND (cp = 0 OR day(ts) = 28)
"""


def equity_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account snapshots from orders: (account, ts, equity, n_open), one per day."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.concat(F.lit("A"), (F.col("o_custkey") % 100).cast("string")).alias("account"),
                 F.col("o_orderdate").alias("ts"))
        .agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count(F.lit(1)) / 100.0).alias("_mean"),
             F.count(F.lit(1)).alias("n_open"))
        .select("account", "ts", F.round(200_000.0 + F.col("_mean") / 10, 4).alias("equity"), "n_open")
    )


EQUITY_SNAPSHOTS_SQL = """
  SELECT concat('A', cast(o_custkey % 100 AS varchar)) AS account, o_orderdate AS ts,
         round(200000.0 + sum(cast(round(o_totalprice * 100) AS bigint)) / count(*) / 100.0 / 10, 4) AS equity,
         count(*) AS n_open
  FROM orders GROUP BY 1, 2
"""


def ledger_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills from lineitem: (symbol, ts, seq, side, qty, price), one per order day.

    ``seq`` orders the fills of one symbol; rows of one symbol and day are merged
    into one buy and one sell so that the order is total.
    """
    side = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
                 F.col("l_shipdate").alias("ts"), side.alias("side"))
        .agg(F.sum("l_quantity").alias("qty"),
             F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("_cents"))
        .select("symbol", "ts",
                (F.unix_seconds(F.col("ts").cast("timestamp")) * 2 + F.when(F.col("side") == "sell", 1).otherwise(0))
                .alias("seq"),
                "side", "qty", F.round(F.col("_cents") / (100.0 * F.col("qty")), 9).alias("price"))
    )


LEDGER_FILLS_SQL = """
  SELECT symbol, ts, cast(epoch(ts) AS bigint) * 2 + CASE WHEN side = 'sell' THEN 1 ELSE 0 END AS seq,
         side, qty, round(cents / (100.0 * qty), 9) AS price
  FROM (SELECT concat('S', cast(l_suppkey AS varchar)) AS symbol, l_shipdate AS ts,
               CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
               sum(l_quantity) AS qty, sum(cast(round(l_extendedprice * 100) AS bigint)) AS cents
        FROM lineitem GROUP BY 1, 2, 3)
"""
