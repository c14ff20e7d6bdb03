"""What keeps tasks, shuffles and passes small as tables grow."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import session
from barloom.operators import layout, metrics, signals, trades
from barloom.plans import catalog, resample, segments, validation


@pytest.fixture(scope="module")
def curve(walk_df):
    return trades.backtest(signals.generate(layout.lay_out(walk_df, halo=64), "momentum_breakout", [{"channel": 10}, {"channel": 15}]))[1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffle_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.range(20_000).selectExpr("id", "uuid() AS u").write.parquet(str(tmp_path / "t.parquet"))
    monkeypatch.setattr(session, "INPUT_PER_PARTITION", 10_000)
    try:
        session.tune(spark, str(tmp_path))
        size = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file() and not f.name.startswith("."))
        assert size / 10_000 <= int(spark.conf.get(name)) <= size / 10_000 * 1.1 + 1
    finally:
        spark.conf.unset(name)


def test_arrow_batches_are_not_weighed_row_by_row(spark):
    assert session.tune(spark).conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(2**31 - 1)


def test_drawdown_comes_with_the_curve(curve):
    assert "Window" not in plan_of(metrics.summarize(curve)).split("FlatMapGroupsInArrow")[0]  # no pass over ordered rows behind the trades
    own = metrics.drawdown(curve.using(curve.df.withColumnRenamed("drawdown", "made"))).df
    assert own.filter(~F.col("made").eqNullSafe(F.col("drawdown"))).count() == 0
    again = metrics.summarize(curve.using(curve.df.drop("drawdown"))).toPandas().sort_values(["symbol", "param_id"], ignore_index=True)
    pd.testing.assert_frame_equal(metrics.summarize(curve).toPandas().sort_values(["symbol", "param_id"], ignore_index=True), again)


def test_sets_are_spread_over_partitions(walk_df, monkeypatch):
    monkeypatch.setattr(layout, "ROWS_PER_TASK", 100)
    laid = layout.lay_out(walk_df, halo=64)
    rows = laid.df.count()
    assert f", {-(-rows * 7 // 100)})" in plan_of(layout.spread(laid, 7).df)


def test_sets_take_their_lengths_by_place(walk_df):
    many = signals.generate(layout.lay_out(walk_df, halo=64), "momentum_breakout", [{"channel": n} for n in range(10, 30)])
    assert "CASE WHEN" not in plan_of(many.df.select("entry")).split("Generate")[0]
    one = signals.generate(layout.lay_out(walk_df, halo=64), "momentum_breakout", [{"channel": 17}])
    columns = ["symbol", "ts", "entry", "exit", "stop"]
    pd.testing.assert_frame_equal(*[s.df.select(*columns).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
                                    for s in (one, one.using(many.df.filter("param_id = 7")))])


def test_stitched_windows_by_one_shuffle(spark):
    rows = [(k, s, i, 3, 3, 10 * s, float(10 + s + i)) for k in ("a", "b", None) for s in range(3) for i in range(3)]
    df = spark.createDataFrame(rows, "symbol string, segment int, bar_no long, n_bars long, test_size long, seg_start long, equity double")
    pick = lambda d: d.select("symbol", "segment", "bar_no", "_first", "_grown").toPandas().sort_values(
        ["symbol", "segment", "bar_no"], ignore_index=True)
    short, long = (pick(f(df, ["symbol", "segment"], ("symbol",))) for f in (validation._scaled, validation._scaled_long))
    pd.testing.assert_frame_equal(short, long)
    assert len(short) == 18 and plan_of(validation._scaled(df, ["symbol", "segment"], ("symbol",))).count("Exchange") == 1


@pytest.mark.parametrize("runs", [2, 40])
def test_bootstrap_statistics_of_short_runs(spark, runs):
    rng = np.random.default_rng(3)
    rows = [(f"r{k}", i, float(x)) for k in range(runs) for i, x in enumerate(rng.normal(0, 0.05, 3 + k % 5))]
    df = spark.createDataFrame(rows, "run string, no long, return double")
    numbered, longest = resample._clean(df, ["run"], "no", "return", layout.BLOCK)
    paths, dealt = resample._short_paths(numbered, ["run"], 50, 42)
    assert dealt == (runs == 2)
    assert paths.count() == (runs if runs == 40 else 16 * runs)
    made = resample._short_stats(paths, dealt, ["run"], 100.0).toPandas().sort_values("run", ignore_index=True)
    by_sql = resample._long_stats(resample.trade_paths(df, ["run"], "no", n_sims=50), ["run"], 100.0).toPandas().sort_values("run", ignore_index=True)
    pd.testing.assert_frame_equal(made, by_sql, rtol=1e-12)


def test_stream_parts_are_written_by_all_tasks(spark, sf_dir, monkeypatch):
    def coalesce(self, n):
        raise AssertionError("one task makes all rows")

    bars = spark.range(1)
    monkeypatch.setattr(type(bars), "coalesce", coalesce)
    made, merged = (catalog.QUERIES[n](spark, sf_dir) for n in ("stream_upsert", "upsert_bars"))
    assert made.count() == merged.count() and made.exceptAll(merged.select(*made.columns)).isEmpty()


def test_short_runs_are_walked_in_one_stream(spark, walk_df):
    """No Arrow stream per run; runs that go on in the next batch, and those of a NULL key, are whole."""
    bars = walk_df.unionByName(walk_df.filter("symbol = 'BB'").withColumn("symbol", F.lit(None).cast("string")))
    at = ["symbol", "param_id", "bar_no"]

    def results():
        made = signals.generate(layout.lay_out(bars, ("symbol",), halo=64), "momentum_breakout", [{"channel": 5}, {"channel": 9}])
        blotter, curve = trades.backtest(made, stream=True)
        assert "FlatMapGroupsInArrow" not in plan_of(curve.df)
        rows = lambda df, no: sorted(map(str, df.orderBy("symbol", "param_id", no).collect()))
        return rows(blotter, "entry_no"), rows(curve.df.select(*at, "equity", "ret", "pnl", "drawdown"), "bar_no")

    whole = results()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert results() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    blotter, curve = whole
    _, grouped = trades.backtest(signals.generate(layout.lay_out(bars, ("symbol",), halo=64), "momentum_breakout", [{"channel": 5}, {"channel": 9}]))
    assert curve == sorted(map(str, grouped.df.select(*at, "equity", "ret", "pnl", "drawdown").collect()))
    windows, _, _ = validation.walk_forward(bars, ("symbol",), "momentum_breakout")
    assert "FlatMapGroupsInArrow" not in plan_of(windows)
    assert len(curve) == 2 * bars.count() and any("symbol=None" in row for row in blotter)
    named = [row.replace("symbol=None", "symbol='BB'") for row in curve if "symbol=None" in row]
    assert sorted(named) == [row for row in curve if "symbol='BB'" in row]


def test_segments_are_made_without_array_functions(walk_df):
    """Spark interprets filters over arrays for every row."""
    numbered, _ = layout.number_rows(walk_df, ("symbol",))
    for rows in (segments.in_out_of_sample(numbered, 0.7, 25), segments.walk_forward_windows(numbered),
                 segments.walk_forward_windows(numbered, train=True)):
        assert "lambda" not in plan_of(rows)
    got = segments.walk_forward_windows(numbered).filter("symbol = 'AA'").groupBy("segment").agg(
        F.min("ts").alias("first"), F.count("*").alias("n"), F.max("n_bars").alias("n_bars"), F.max("test_size").alias("size"))
    start = [0] * 5  # 150 bars: 12 a window behind 90, all within reach of the warm-up
    assert [(r.segment, r.n, r.n_bars, r["size"]) for r in got.orderBy("segment").collect()] == [
        (k, 90 + 12 * (k + 1) - start[k], 90 + 12 * (k + 1) - start[k], 12) for k in range(5)]
