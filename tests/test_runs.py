"""Many short runs walked at once, against each by itself, and sums of runs against sums of rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.operators import layout, metrics, signals, trades
from barloom.operators.arrays import Bars
from barloom.plans import sweep


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_bars(rng, sizes):
    n = sum(sizes)
    close = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.03, n))), 1)  # ties
    open_ = np.round(close * (1 + rng.normal(0, 0.01, n)), 1)
    columns = {"open": open_, "close": close, "high": np.maximum(open_, close) + rng.integers(0, 3, n) / 10,
               "low": np.minimum(open_, close) - rng.integers(0, 3, n) / 10}
    for c in columns:
        columns[c][rng.random(n) < 0.02] = np.nan
    return columns | {"ts": np.arange(n).astype("datetime64[us]"), "bar_no": np.concatenate([np.arange(s) for s in sizes]),
                      "n_bars": np.repeat(sizes, sizes)}


@pytest.mark.parametrize("trail", [True, False])
@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("latency", [1, 3])
def test_runs_at_once_are_blocks_one_by_one(trail, whole, latency):
    rng = np.random.default_rng(11)
    costs, account = trades.Costs(latency_bars=latency), trades.Account(allow_fractional=not whole, initial_cash=5_000.0)
    for round_ in range(30):
        sizes = rng.integers(1, 90, 12).tolist()
        columns = random_bars(rng, sizes)
        n = sum(sizes)
        entry, leave = rng.random(n) < 0.2, rng.random(n) < 0.05
        stop = np.where(rng.random(n) < 0.1, np.nan, columns["close"] - rng.integers(0, 8, n))
        target = None if round_ % 2 else np.where(rng.random(n) < 0.3, np.nan, columns["close"] + rng.integers(1, 9, n))
        bars = Bars(dict(columns), np.array(sizes))
        runs = trades.Runs(bars, (entry, leave, stop, target), trail, costs, account)
        walked = runs.walk()
        of, made = runs.blotter(walked)
        curve = runs.curve(walked)
        table = pa.table({**columns, "entry": entry, "exit": leave, "stop": stop,
                          "take_profit": np.full(n, np.nan) if target is None else target, "trail": np.full(n, trail)})
        assert len(of) > 5 or whole
        for run, (at, size) in enumerate(zip(bars.first, sizes)):
            block = trades.Block(table.slice(at, size), costs, account)
            own, behind = block.emit(trades.State(account.initial_cash))
            mine = np.flatnonzero(of == run)
            assert len(own) == len(mine)
            for c in trades._TRADE:
                assert pd.Series([t[c] for t in own], dtype=object).equals(pd.Series(list(np.array(made[c])[mine]), dtype=object)), c
            for c, v in block.curve(trades.State(account.initial_cash), own, behind).items():
                assert np.array_equal(v, curve[c][at:at + size], equal_nan=True), c


def test_sums_of_runs_are_those_of_their_rows(spark):
    rng = np.random.default_rng(4)
    sizes = [1, 2, 40, 90, 7, 30]
    bars = Bars(random_bars(rng, sizes), np.array(sizes))
    n = bars.size
    curve = {"equity": 100 + rng.normal(0, 1, n), "ret": rng.normal(0, 0.01, n), "pnl": np.where(rng.random(n) < 0.9, np.nan, rng.normal(0, 5, n)),
             "drawdown": -rng.random(n)}
    curve["ret"][bars.first] = np.nan
    curve["ret"][bars.run == 4], curve["pnl"][bars.run == 5] = np.nan, np.nan
    flat = (bars.run == 5) & (bars.place > 0)
    curve["ret"][flat] = 0.1  # equal returns do not vary at all
    df = spark.createDataFrame(pd.DataFrame({"run": bars.run, "bar_no": bars.place, **curve})).select(
        "run", "bar_no", *[F.nanvl(c, F.lit(None)).alias(c) for c in curve])
    rows = df.groupBy("run").agg(*metrics.equity_aggregates(*map(F.col, ("equity", "ret", "drawdown", "bar_no")), 0.0, F.lit(365.0)),
                                 *metrics.trade_aggregates(F.col("pnl"))).orderBy("run").toPandas()
    made = trades.run_sums(curve, bars.first)
    for c in trades._SUMS:
        np.testing.assert_allclose(np.asarray(made[c], float), rows[c].to_numpy(float), rtol=1e-9, atol=0, equal_nan=True, err_msg=c)
    assert made["_std"][5] == 0


@pytest.mark.parametrize("deals", [1, 4])
def test_sets_of_a_sweep_are_not_made_as_rows(spark, walk_df, deals):
    """Bars go to a task once, whatever the sets; metrics take a row per run from there."""
    sets = sweep.draw_parameters("momentum_breakout", 7)
    bars = walk_df.withColumn("volume", F.when(F.dayofyear("ts") % 97 != 9, F.col("volume"))).withColumn(
        "high", F.when(F.dayofyear("ts") % 89 != 17, F.col("high")))
    made = signals.generate(layout.lay_out(bars, halo=64), "momentum_breakout", sets, deals)
    blotter, curve = trades.backtest(made, stream=True)
    table = metrics.summarize(curve)
    assert plan_of(table).count("Generate explode") == (deals > 1)
    plain = made.using(made.df)  # by rows of signals
    rows, by_rows = trades.backtest(plain)
    keys = ["symbol", "param_id"]
    order = lambda df, more=(): df.toPandas().sort_values([*keys, *more], ignore_index=True)
    pd.testing.assert_frame_equal(order(table)[[*keys, *metrics.METRICS]], order(metrics.summarize(by_rows))[[*keys, *metrics.METRICS]], rtol=1e-9)
    pd.testing.assert_frame_equal(order(blotter, ["entry_no"]), order(rows, ["entry_no"]), rtol=1e-9)
    assert len(order(blotter)) > 15


def test_runs_that_miss_bars_are_walked_by_themselves(walk_df):
    laid = layout.lay_out(walk_df, halo=64)
    cut = laid.using(laid.df.filter("bar_no < 60"))
    made = signals.generate(cut, "momentum_breakout", [{"channel": 5}, {"channel": 9}])
    order = lambda c: metrics.summarize(c).toPandas().sort_values(["symbol", "param_id"], ignore_index=True)[["symbol", "param_id", *metrics.METRICS]]
    pd.testing.assert_frame_equal(order(trades.backtest(made, stream=True)[1]), order(trades.backtest(made.using(made.df))[1]), rtol=1e-9)


@pytest.mark.parametrize("name", signals.list_strategies())
def test_signals_as_arrays_are_those_of_rows(spark, walk_df, name):
    """Signals, trades and kept columns of every strategy, with values missing."""
    bars = walk_df
    for c, at in (("close", 101), ("high", 89), ("low", 83), ("volume", 97)):
        bars = bars.withColumn(c, F.when(F.dayofyear("ts") % at != 9, F.col(c)))
    strategy = signals.get_strategy(name)
    params = signals.with_defaults(strategy, {"ema_fast": 8, "ema_slow": 21} if name == "trend_following" else {})
    made = signals.generate(layout.lay_out(bars, halo=300), name, [params])
    pdf = made.df.orderBy("symbol", "bar_no").toPandas()
    b = Bars({c: pdf[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")}, pdf.groupby("symbol").size().to_numpy())
    entry, leave, stop, target, kept = strategy.arrays(b, params)
    assert (entry == pdf.entry).all() and (leave == pdf.exit).all() and entry.any()
    np.testing.assert_allclose(stop, pdf.stop.to_numpy(float), rtol=1e-10, equal_nan=True)
    if target is not None:
        np.testing.assert_allclose(target, pdf.take_profit.to_numpy(float), rtol=1e-10, equal_nan=True)
    assert set(kept) == set(strategy.keep) and all((kept[c] == pdf[c]).all() for c in kept)
    curves = [trades.backtest(s, carry=strategy.keep, stream=True)[1] for s in (made, made.using(made.df))]
    assert "_tr#" not in plan_of(curves[0].df)
    frames = [c.df.select("symbol", "bar_no", "ts", "equity", "ret", "pnl", *strategy.keep).toPandas().sort_values(
        ["symbol", "bar_no"], ignore_index=True) for c in curves]
    pd.testing.assert_frame_equal(*frames, rtol=1e-9)


def test_bars_are_shuffled_once(spark, sf_dir):
    """Items go to their supplier's task, where days, running values and bar numbers need no other shuffle."""
    from barloom.sources import fixtures

    series = layout.lay_out(fixtures.walk_bars(spark, sf_dir))
    assert plan_of(series.df).count("Exchange hashpartitioning") == 1
    assert series.longest >= series.df.groupBy("symbol").count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("few", [True, False])
def test_block_bootstrap_makes_no_copies_of_many_series(spark, few):
    """F8: simulations of arrays, without a copy of a series per bucket where series abound; as by the path of long series."""
    from barloom.plans import resample

    rng = np.random.default_rng(8)
    rows = []
    for k in range(2 if few else 12):
        n = 30 + 13 * k
        ret = [None, *rng.normal(0, 0.05, n - 1).round(4).tolist()]
        if k == 1:
            ret[5], ret[9] = -1.0, None
        rows += [(f"k{k}" if k else None, i, r) for i, r in enumerate(ret)]
    df = spark.createDataFrame(rows, "symbol string, ts int, ret double")
    short = resample.block_bootstrap(layout.lay_out(df, ("symbol",), "ts", 1, halo=8), length=8, n_sims=50)
    assert ("Generate explode" in plan_of(short)) == few and "ArrayAggregate" not in plan_of(short) and "aggregate(" not in plan_of(short)
    order = lambda d: d.toPandas().sort_values(["symbol", "sim"], ignore_index=True)
    got = order(short)
    assert len(got) == sum(n - 1 >= 16 for n in df.groupBy("symbol").count().toPandas()["count"]) * 50
    known = df.filter("symbol IS NOT NULL")
    long = order(resample.block_bootstrap(layout.lay_out(known, ("symbol",), "ts", 1, halo=8, block=128), length=8, n_sims=50)) if not few else None
    if long is not None:
        pd.testing.assert_frame_equal(got[got.symbol.notna()].reset_index(drop=True), long, rtol=1e-12)


def test_ranges_follow_the_rows_that_are_ranked(spark, monkeypatch):
    """borders of as many ranges as the input has megabytes would bring 300 rows a range to the driver."""
    asked = []
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("no"))
    own = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *columns: asked.append(n) or own(self, n, *columns))
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(name, "3000")
    try:
        got = layout.ranked(df, ("k",), ["no"]).toPandas()
    finally:
        spark.conf.unset(name)
    assert asked == [4] and (got.bar_no == got.no // 3).all() and len(got) == 20_000


def test_new_bars_and_cells_are_made_once(spark, sf_dir, monkeypatch):
    """two passes over the items: the old bars and the new ones."""
    from barloom.plans import catalog

    made = spark.sparkContext.accumulator(0)
    own = catalog.fx.walk_bars

    def counted(spark, sf_dir):
        def see(batches):
            made.add(1)
            yield from batches

        bars = own(spark, sf_dir)
        return bars.repartition(1).mapInArrow(see, bars.schema)

    monkeypatch.setattr(catalog.fx, "walk_bars", counted)
    got = catalog.QUERIES["stream_upsert"](spark, sf_dir)
    assert made.value == 2 and got.count() > 0
