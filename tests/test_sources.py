import json

import pytest
from pyspark.sql import functions as F

from barloom.functions import scalars, venue
from barloom.schemas import TABLES
from barloom.sources import bars as io
from barloom.sources import fixtures as fx
from barloom.sources.store import BarStore


def test_csv_and_parquet_roundtrip(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1.0, 2.0, 0.5, 1.5, 10.0), ("2024-01-02 00:00:00", 1.5, 2.5, 1.0, 2.0, 11.0)]
    df = spark.createDataFrame(rows, "Time string, Open double, High double, Low double, Close double, Volume double")
    df = df.withColumnRenamed("Time", "timestamp")
    for name in ("b.csv", "b.parquet"):
        io.write_bars(df, str(tmp_path / name))
        got = io.read_bars(spark, str(tmp_path / name))
        assert got.columns == ["ts", "open", "high", "low", "close", "volume"]
        assert got.schema["ts"].dataType.typeName() == "timestamp"
        assert got.agg(F.sum("close")).first()[0] == 3.5


def test_upsert_is_idempotent_and_prunes(spark, sf_dir, tmp_path):
    path = str(tmp_path / "ohlcv")
    bars = fx.walk_bars(spark, sf_dir).withColumns({"exchange": F.lit("x"), "timeframe": F.lit("1d")}).persist()
    n = bars.count()
    assert io.upsert(spark, bars, path) == n
    changed = bars.filter("symbol = 'S1'").withColumn("close", F.lit(7.0))
    assert io.upsert(spark, changed, path) == io.upsert(spark, changed, path) == changed.count()
    table = io.read_table(spark, path, bars)
    assert table.count() == n and table.filter("close = 7.0").count() == changed.count()
    scan = io.range_scan(table, "x", "S1", "1d", "1996-01-01", "1998-01-01")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" in plan and "GreaterThanOrEqual(ts" in plan and scan.count() > 0
    assert io.upsert(spark, bars.limit(0), path) == 0


@pytest.mark.parametrize("first", [True, False])
def test_upsert_leaves_one_row_of_a_key(spark, sf_dir, tmp_path, first):
    path = str(tmp_path / "ohlcv")
    one = fx.walk_bars(spark, sf_dir).limit(1).withColumns({"exchange": F.lit("x"), "timeframe": F.lit("1d"), "at": F.lit(1)}).persist()
    twice = one.withColumn("close", F.lit(1.0)).unionByName(one.withColumns({"close": F.lit(0.5), "at": F.lit(2)}))
    if not first:
        io.upsert(spark, one, path)
    io.upsert(spark, twice, path, order="at")
    assert [r.close for r in io.read_table(spark, path, one).collect()] == [0.5]


def test_store_takes_each_batch_once_and_shows_whole_commits(spark, sf_dir, tmp_path, monkeypatch):
    bars = fx.walk_bars(spark, sf_dir).filter("symbol IN ('S1', 'S2', 'S3')").persist()
    store = BarStore(spark, str(tmp_path / "store"), bars.schema, buckets=2)
    assert store.read().count() == 0
    assert store.upsert(bars, "load", 0) and not store.upsert(bars.withColumn("close", F.lit(1.0)), "load", 0)
    n = bars.count()
    assert store.read().exceptAll(bars).count() == 0 and store.read().count() == n
    changed = bars.filter("symbol = 'S1' AND ts >= '1996-03-01' AND ts < '1996-04-01'").withColumn("close", F.lit(7.0)).persist()
    twice = changed.unionByName(changed.withColumn("close", F.lit(3.0)))
    # A run that is stopped before its commit leaves the table as it was.
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            store.upsert(twice, "feed", 0)
    assert store.read().exceptAll(bars).count() == 0 and store.read().count() == n
    # A commit file that was not written to its end is passed over.
    (tmp_path / "store" / "commits" / "000000000002").write_text('{"poin')
    assert store.read().count() == n
    assert store.upsert(twice, "feed", 0)
    assert store.read().count() == n and store.read().filter("close = 7.0").count() == changed.count()
    assert not store.upsert(changed.withColumn("close", F.lit(2.0)), "feed", 0)
    late = bars.limit(1).withColumn("ts", F.lit("2031-05-05").cast(bars.schema["ts"].dataType))
    assert store.upsert(late, "feed", 5) and store.read().count() == n + 1
    scan = store.read("1996-03-01", "1996-04-01", symbol="S1")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    partition, pushed = plan.split("PartitionFilters: [", 1)[1].split("PushedFilters: [", 1)
    assert "bucket" in partition and "period" in partition and "EqualTo(symbol,S1)" in pushed and "GreaterThanOrEqual(ts" in pushed
    assert scan.count() == changed.count() and scan.filter("close <> 7.0").count() == 0


def test_tables_and_exports(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS barloom_t LOCATION '{tmp_path}/db'")
    assert io.create_tables(spark, "barloom_t") == list(TABLES)
    io.create_tables(spark, "barloom_t")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN barloom_t").collect()} >= set(TABLES)
    spark.sql("DROP DATABASE barloom_t CASCADE")
    m = spark.createDataFrame([("X", 1.5, 3)], "symbol string, sharpe double, n_trades long")
    io.write_metrics(m, str(tmp_path / "m"), ["symbol"], "1d")
    lines = [line.value for line in spark.read.text(str(tmp_path / "m")).collect()]
    assert [json.loads(line) for line in lines] == [
        {"symbol": "X", "timeframe": "1d", "metrics": {"sharpe": 1.5, "n_trades": 3}, "n_trades": 3}]
    io.write_trades(m, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns == m.columns
    report = spark.createDataFrame([("X", 5, 1, 0, 0, True)], "symbol string, n_candles long, n_gaps long, n_duplicates long, n_anomalies long, passed boolean")
    for _ in range(2):
        io.save_quality_run(report, str(tmp_path / "q"), "x", "1d")
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    assert [one(spark, scalars.coin_of(F.lit(s))) for s in ("BTC/USDT", "eth-perp", "SOL")] == ["BTC", "ETH", "SOL"]
    assert one(spark, scalars.bars_per_year("9x")) == 365.0 and one(spark, scalars.timeframe_millis("5m")) == 300_000
    assert one(spark, scalars.to_millis("2024-01-01")) == 1704067200000 and one(spark, scalars.to_millis(5)) == 5
    size = one(spark, scalars.fixed_fractional_size(F.lit(10_000.0), F.lit(100.0), F.lit(95.0), F.lit(0.01)))
    assert (size.qty, size.risk_cash) == (20.0, 100.0)
    assert one(spark, scalars.fixed_fractional_size(F.lit(10_000.0), F.lit(100.0), F.lit(99.9), F.lit(0.01))).notional <= 10_000
    assert one(spark, scalars.fixed_fractional_size(F.lit(10_000.0), F.lit(100.0), F.lit(90.0), F.lit(0.05))).risk_cash == 100.0
    vol = lambda a: one(spark, scalars.volatility_adjusted_size(F.lit(10_000.0), F.lit(100.0), F.lit(a), F.lit(0.01))).qty
    assert vol(1.0) > vol(5.0) and vol(0.0) == 0.0


@pytest.mark.parametrize("payload,status,qty,reason", [
    ('{"status":"ok","response":{"data":{"statuses":[{"resting":{"oid":7}}]}}}', "submitted", 0.0, None),
    ('{"status":"ok","response":{"data":{"statuses":[{"filled":{"oid":8,"totalSz":"2","avgPx":"10"}}]}}}', "filled", 2.0, None),
    ('{"status":"ok","response":{"data":{"statuses":[{"error":"no"}]}}}', "rejected", 0.0, "no"),
    ('{"status":"ok","response":{"data":{"statuses":[]}}}', "submitted", 0.0, None),
    ('not json', "rejected", 0.0, "not json")])
def test_order_outcome(spark, payload, status, qty, reason):
    df = spark.createDataFrame([(payload, 3.0)], "payload string, qty double")
    r = venue.order_outcome(df, "payload", "qty").first()
    assert (r.status, r.filled_qty, r.reason) == (status, qty, reason)
