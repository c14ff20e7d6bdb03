"""Whole plans give the same result whatever the block size, and known verdicts."""

import functools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import folds, layout, ledger, metrics, quality, risk, signals, trades
from barloom.plans import catalog, resample, segments, sweep, validation
from barloom.sources import fixtures as fx

SMALL = 256


@pytest.fixture(scope="module")
def bars(spark, sf_dir):
    return fx.walk_bars(spark, sf_dir).filter("symbol IN ('S1', 'S2')").repartition(2, "symbol").persist()


def same(a, b, keys, rtol=1e-9):
    a, b = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (a, b))
    assert len(a) == len(b) > 0
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c], b[c], rtol=rtol, atol=1e-9, err_msg=c)
        else:
            assert (a[c].fillna(0) == b[c].fillna(0)).all(), c


@pytest.mark.parametrize("name", ["regime_adaptive", "breakout_rr"])
def test_backtest_does_not_depend_on_blocks(bars, name):
    out = []
    for block in (layout.BLOCK, SMALL):
        strategy = signals.get_strategy(name)
        s = layout.lay_out(bars, ("symbol",), halo=signals.halo_of(strategy, [strategy.defaults]), block=block)
        _, curve = trades.backtest(signals.generate(s, name))
        out.append(metrics.summarize(curve))
    same(*out, ["symbol"])


def test_shared_and_own_smoothing_agree(bars, monkeypatch):
    sets = [{"channel": 15, "atr_period": 10, "atr_mult": 2.0}, {"channel": 20, "atr_period": 21}]
    run = lambda: signals.generate(layout.lay_out(bars, ("symbol",), halo=22), "momentum_breakout", sets).select(
        "ts", "entry", "exit", "stop")
    shared = run()
    monkeypatch.setattr(signals, "MAX_SHARED_COLUMNS", 0)
    same(shared, run(), ["symbol", "param_id", "ts"])


def test_two_hundred_lengths_in_one_plan(spark, walk):
    """Lengths as rows of a table: one frame a statistic, whatever their number; against pandas, over blocks too."""
    lengths = list(range(1, 201))
    frame = spark.createDataFrame(walk[walk.symbol != "BB"])
    plans = []
    for block, n in ((layout.BLOCK, 200), (layout.BLOCK, 2), (512, 200)):
        s = layout.lay_out(frame, ("symbol",), halo=201, block=block)
        table = spark.createDataFrame([(k,) for k in lengths[-n:]], "n int").withColumn("one", F.lit(1))
        joined = s.df.withColumn("one", F.lit(1)).join(F.broadcast(table), "one").drop("one")
        s = ind.rolling_by(s.using(joined, "n"), {
            "top": (ind.Rolling("max", "high", prior=True), F.col("n")), "low_": (ind.Rolling("min", "low"), F.col("n")),
            "mid": (ind.Rolling("avg", "close"), F.col("n")), "spread": (ind.Rolling("std", "close"), F.col("n"))})
        plans.append(s.df._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition"))
        if n < 200:
            continue
        got = s.core_rows().df.filter("n IN (1, 2, 7, 64, 65, 128, 199, 200)").toPandas()
        for (symbol, k), g in got.groupby(["symbol", "n"]):
            g, w = g.sort_values("bar_no").reset_index(drop=True), walk[walk.symbol == symbol].reset_index(drop=True)
            assert len(g) == len(w)
            for name, want in (("top", w.high.shift(1).rolling(k).max()), ("low_", w.low.rolling(k).min()),
                               ("mid", w.close.rolling(k).mean()), ("spread", w.close.rolling(k).std(ddof=0))):
                np.testing.assert_allclose(g[name].astype(float), want, rtol=1e-9, atol=1e-7, err_msg=f"{name} {k}")
    assert plans[0] == plans[1]


@pytest.mark.parametrize("name,sets", [
    ("momentum_breakout", [{"channel": 15, "atr_period": 10, "atr_mult": 2.0}, {"channel": 20, "atr_period": 21}, {"vol_mult": 1.0}]),
    ("regime_adaptive", [{"trend_ema_fast": 25}, {"mr_rsi_buy": 34.0, "adx_period": 10, "bb_period": 15}])])
def test_sets_from_a_table_equal_sets_from_a_list(spark, bars, name, sets):
    strategy = signals.get_strategy(name)
    columns = sorted({k for p in sets for k in p})
    kinds = ", ".join(f"{c} {'double' if isinstance(strategy.defaults[c], float) else 'int'}" for c in columns)
    table = spark.createDataFrame([(s, i, *(p.get(c) for c in columns)) for s in ("S1", "S2") for i, p in enumerate(sets)],
                                  f"symbol string, param_id int, {kinds}")
    shown = ["ts", "entry", "exit", "stop"]
    for block in (layout.BLOCK, SMALL):
        laid = layout.lay_out(bars, ("symbol",), halo=30, block=block)
        listed = signals.generate(laid, name, sets)
        same(signals.generate_for(laid, name, table, ("symbol",)).select(*shown), listed.select(*shown), ["symbol", "param_id", "ts"], rtol=1e-7)
    dealt = signals.generate(layout.lay_out(bars, ("symbol",), halo=30), name, sets, deals=2).select(*shown).drop("deal")
    same(dealt, listed.select(*shown), ["symbol", "param_id", "ts"], rtol=1e-7)


def test_deals_follow_the_number_of_keys(bars):
    cores = bars.sparkSession.sparkContext.defaultParallelism
    assert sweep.deals_for(bars, ("symbol",), 60) == cores and sweep.deals_for(bars, ("symbol",), 3) == min(3, cores)
    assert sweep.deals_for(bars, ("symbol", "ts"), 60) == 1


def test_regime_stretches_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({"symbol": "X", "ts": pd.date_range("2020-01-01", periods=n), "equity": 100 + np.cumsum(rng.normal(0, 1, n)),
                        "regime": np.repeat(rng.choice(["a", "b"], 30), 30)})
    got = []
    for block in (layout.BLOCK, 64):
        got.append(metrics.regime_drawdowns(layout.lay_out(spark.createDataFrame(pdf), ("symbol",), block=block), "regime"))
    same(*got, ["symbol", "regime"])
    stretch = (pdf.regime != pdf.regime.shift()).cumsum()
    pdf["fall"] = pdf.equity / pdf.groupby(stretch).equity.cummax() - 1
    want = pdf.groupby("regime").fall.min().to_dict()
    assert {r.regime: round(r.max_drawdown, 9) for r in got[0].collect()} == {k: round(v, 9) for k, v in want.items()}


def test_walk_forward_and_portfolio_do_not_depend_on_blocks(bars):
    stitched, pooled = [], []
    for block in (layout.BLOCK, SMALL):
        _, _, curve = validation.walk_forward(bars, ("symbol",), "momentum_breakout", block=block)
        stitched.append(metrics.summarize(curve))
        _, split = validation.run_split(bars, ("symbol",), "momentum_breakout", block=block)
        pooled.append(validation.portfolio_metrics(validation.portfolio(split)))
    same(*stitched, ["symbol"])
    same(*pooled, ["segment"])


def test_pooled_portfolio_is_the_mean_of_its_members(bars):
    blotter, curve = validation.run_split(bars, ("symbol",), "momentum_breakout")
    pooled = {r.segment: r for r in validation.portfolio_metrics(validation.portfolio(curve)).collect()}
    rows, made = curve.core_rows().df.toPandas(), blotter.toPandas()
    for segment, g in rows.groupby("segment"):
        wide = g.pivot(index="ts", columns="symbol", values="ret").sort_index().fillna(0.0)
        assert abs(pooled[segment].total_return - ((1 + wide.mean(axis=1)).prod() / (1 + wide.mean(axis=1).iloc[0]) - 1)) < 1e-9
        pnl = made[made.segment == segment].pnl
        assert pooled[segment].n_trades == len(pnl)
        assert abs(pooled[segment].avg_trade - pnl.mean()) < 1e-9
        assert abs(pooled[segment].profit_factor - pnl[pnl > 0].sum() / -pnl[pnl < 0].sum()) < 1e-9
    verdict = validation.portfolio_verdict(curve, criteria=validation.Criteria(min_trades=1, min_sharpe=-99.0)).collect()
    assert len(verdict) == 1 and verdict[0].checks["min_trades"] and verdict[0].checks["sharpe"]
    assert verdict[0].checks["oos_positive"] == (pooled["oos"].total_return > 0)


def test_ranking_over_ranges(spark):
    """Rows of a key, and all rows, numbered over many ranges."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 3000, p=[0.8, 0.1, 0.1]), "o": rng.permutation(3000), "x": 1})
    frame = spark.createDataFrame(pdf).repartition(5)
    for keys in ((), ("k",)):
        got = layout.ranked(frame, keys, ["o"], "no").toPandas()
        assert len(got) == 3000
        groups = got.groupby(list(keys), dropna=False) if keys else [(None, got)]
        for _, g in groups:
            assert g.sort_values("o").no.tolist() == list(range(len(g)))
    assert layout.ranked(frame.limit(0), ("k",), ["o"]).count() == 0


def test_bootstrap_paths(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"run": "R", "no": range(90), "return": rng.normal(0.01, 0.05, 90)})
    few = pd.DataFrame({"run": "F", "no": range(2), "return": [0.1, 0.2]})
    df = spark.createDataFrame(pd.concat([pdf, few]))
    wide = resample.trade_paths(df, ["run"], "no", n_sims=40)
    deep = resample.trade_paths(df, ["run"], "no", n_sims=40, block=16)
    same(wide, deep, ["run", "sim"])
    r = pdf["return"].to_numpy()
    for row in wide.filter("sim < 3").collect():
        path = np.cumprod([1 + r[resample.drawn_int(42, row.sim, j) % 90] for j in range(90)])
        full = np.concatenate([[1.0], path])
        assert abs(row.growth - path[-1]) < 1e-9
        assert abs(row.max_dd - (full / np.maximum.accumulate(full) - 1).min()) < 1e-9
    out = {x.run: x for x in resample.trade_bootstrap(df, df, ["run"], "no", n_sims=200).collect()}
    assert out["R"].terminal_p05 <= out["R"].terminal_p50 <= out["R"].terminal_p95 and out["R"].n_sims == 200
    assert (out["F"].n_sims, out["F"].terminal_p50, out["F"].prob_profit) == (0, 10000.0, 0.0)


def test_block_bootstrap_matches_brute_force(walk_df, walk):
    results = []
    for block in (layout.BLOCK, SMALL):
        s = layout.lay_out(walk_df, ("symbol",), halo=64, block=block)
        s = s.with_columns({"ret": F.col("close") / F.lag("close").over(s.order()) - 1})
        results.append(resample.block_bootstrap(s, n_sims=5))
    same(*results, ["symbol", "sim"])
    for symbol, g in walk.groupby("symbol"):
        r = g.close.pct_change().dropna().to_numpy()
        n, nb = len(r), -(-len(r) // 20)
        for sim in range(5):
            path = np.concatenate([r[s0:s0 + 20] for s0 in (resample.drawn_int(42, sim, b) % (n - 20) for b in range(nb))])[:n]
            got = results[0].filter((F.col("symbol") == symbol) & (F.col("sim") == sim)).first().terminal
            assert abs(got - np.prod(1 + path)) < 1e-9


def test_sensitivity_and_scores(spark):
    grid = sweep.sensitivity_sets("trend_following")
    assert len(grid) == 20 and grid[0][:2] == ("ema_fast", 38)
    drawn = sweep.draw_parameters("breakout_rr", 60)
    space = signals.get_strategy("breakout_rr").space
    assert all(space[k][1] <= v <= space[k][2] for p in drawn for k, v in p.items())
    rows = [("A", 0, 1.0, 0.5, -0.1, 30, 0.5), ("A", 1, 1.0, 0.5, -0.1, 30, 0.5), ("B", 0, 9.0, 0.5, -0.1, 3, 0.5)]
    df = spark.createDataFrame(rows, "symbol string, param_id int, is_sharpe double, is_cagr double, "
                                     "is_max_drawdown double, is_n_trades long, oos_sharpe double")
    best = {r.symbol: r for r in sweep.best_trial(df.withColumn("score", sweep.score(sweep.Objective())), ["symbol"]).collect()}
    assert best["A"].param_id == 0 and abs(best["A"].score - (1 + 0.25 - 0.1 - 0.25)) < 1e-12
    assert best["B"].param_id is None and best["B"].score == 0.0


def gate_row(spark, **changes):
    m = {"cagr": 0.3, "sharpe": 1.8, "sortino": 2.0, "calmar": 2.0, "max_drawdown": -0.12, "volatility": 0.2,
         "total_return": 0.4, "win_rate": 0.5, "profit_factor": 1.6, "avg_trade": 1.0, "expectancy": 1.0, "n_trades": 120}
    row = {**{f"is_{k}": v for k, v in m.items()}, **{f"oos_{k}": v for k, v in m.items()}, "symbol": "X", **changes}
    return spark.createDataFrame(pd.DataFrame([row]))


def test_gates(spark):
    good = validation.gates(gate_row(spark), ["symbol"]).first()
    assert good.passed and good.reasons == []
    bad = validation.gates(gate_row(spark, oos_max_drawdown=-0.35), ["symbol"]).first()
    assert not bad.passed and bad.checks["max_drawdown"] is False and bad.reasons == ["Max drawdown 35.00% > 20%"]
    regimes = spark.createDataFrame([("X", "bear", -0.3), ("X", "bull", -0.1)], "symbol string, regime string, max_drawdown double")
    mixed = validation.gates(gate_row(spark, is_sharpe=-1.0), ["symbol"], regimes=regimes).first()
    assert not mixed.passed and mixed.checks["regime_bull"] and not mixed.checks["regime_bear"]
    assert "is_oos_consistency" not in mixed.checks


def test_quality_report_blocks_and_missing_columns(spark, sf_dir):
    faulty = fx.faulty_bars(spark, sf_dir).persist()
    reports = [quality.report(faulty, ("symbol",), "1d", "ingest_seq", 2 * 86_400_000, block=b).withColumns(
        {"messages": F.concat_ws(";", "messages"), "gaps": F.to_json("gaps")}) for b in (layout.BLOCK, SMALL)]
    same(*reports, ["symbol"])
    lost = quality.report(faulty.drop("close"), ("symbol",), "1d").first()
    assert not lost.passed and lost.messages == ["missing columns: ['close']"]
    with pytest.raises(ValueError):
        signals.require_columns(layout.Series(faulty.drop("close"), ("symbol",), 10, 1))


def test_split_bounds(bars):
    numbered, _ = layout.number_rows(bars, ("symbol",))
    with pytest.raises(ValueError):
        segments.in_out_of_sample(numbered, 1.0)
    sizes = segments.in_out_of_sample(numbered, 0.7).groupBy("symbol", "segment").agg(F.count("*").alias("n"), F.max("n_bars").alias("m"))
    assert sizes.filter("n <> m").count() == 0


# --- risk and ledger ---------------------------------------------------------------

def risk_rows(spark, points, resets=()):
    pdf = pd.DataFrame([("A", pd.Timestamp(t), float(e), i in resets, 0) for i, (t, e) in enumerate(points)],
                       columns=["account", "ts", "equity", "reset", "n_open"])
    s = risk.risk_state(layout.lay_out(spark.createDataFrame(pdf), ("account",)), 10_000.0, reset="reset")
    return risk.entry_decisions(s).df.orderBy("ts").collect()


def test_risk_rules(spark):
    daily = risk_rows(spark, [("2024-01-01 10:00", 10_000), ("2024-01-01 12:00", 9_600), ("2024-01-02 09:00", 9_600)])
    assert [r.reason for r in daily] == ["ok", "daily_loss_limit", "ok"]
    kill = risk_rows(spark, [("2024-01-01", 12_000), ("2024-01-02", 9_000), ("2024-01-03", 11_900), ("2024-01-15", 11_000)], {2})
    assert [r.kill_switch for r in kill] == [False, True, True, False]
    assert kill[1].reason == "kill_switch_active" and kill[3].peak == 11_900


def fills_series(spark, rows, block=layout.BLOCK):
    pdf = pd.DataFrame(rows, columns=["symbol", "seq", "side", "qty", "price"])
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf.seq, unit="h")
    return layout.lay_out(spark.createDataFrame(pdf), ("symbol",), "seq", 1, block=block)


def test_positions_and_orders(spark):
    history = ledger.position_history(fills_series(spark, [("X", 0, "buy", 10.0, 100.0), ("X", 1, "sell", 10.0, 110.0)]))
    last = history.orderBy("seq").collect()[-1]
    assert (last.qty, last.realized_pnl) == (0.0, 100.0)
    assert ledger.current_positions(history, ["symbol"]).count() == 0

    def orders(rows, block=layout.BLOCK):
        pdf = pd.DataFrame(rows, columns=["account", "seq", "symbol", "side", "type", "qty", "limit_price", "price"])
        return layout.lay_out(spark.createDataFrame(pdf), ("account",), "seq", 1, block=block)

    free = trades.Costs(0.0, 0.0)
    flow = [("A", 0, "X", "sell", "market", 1.0, 0.0, 100.0), ("A", 1, "X", "buy", "market", 10.0, 0.0, 100.0),
            ("A", 2, "X", "buy", "market", 1000.0, 0.0, 100.0), ("A", 3, "X", "sell", "market", 50.0, 0.0, 110.0)]
    whole = ledger.admit_orders(orders(flow), costs=free).orderBy("seq").collect()
    assert [r.reason for r in whole] == ["no_position", None, "insufficient_cash", None]
    assert [r.cash_left for r in whole] == [10_000.0, 9_000.0, 9_000.0, 10_100.0] and whole[3].filled_qty == 50.0
    split = ledger.admit_orders(orders(flow, 1), costs=free).orderBy("seq").collect()
    assert [tuple(r) for r in split] == [tuple(r) for r in whole]


def test_close_based_fold_over_blocks(bars):
    out = []
    for block in (layout.BLOCK, SMALL):
        s = layout.lay_out(bars, ("symbol",), halo=22, block=block)
        s = signals.generate(s, "momentum_breakout").with_columns({"ts": F.col("ts").cast("timestamp_ntz")})
        out.append(folds.fold(s, trades.close_step, functools.partial(trades.close_start, 10_000.0), trades.CLOSE_INPUTS, trades.CLOSE_OUTPUT, trades.CLOSE_STATE))
    same(*out, ["symbol", "ts"])



def test_full_sweep_and_full_printed_table(spark, sf_dir):
    """60 trials a symbol, the best of them by plain search; all printed labels."""
    trials = catalog.QUERIES["sweep_trials"](spark, sf_dir).collect()
    best = {r.symbol: r for r in catalog.QUERIES["sweep_best"](spark, sf_dir).collect()}
    symbols = {r.symbol for r in trials}
    assert best.keys() == symbols and sorted((r.symbol, r.param_id) for r in trials) == sorted((s, i) for s in symbols for i in range(60))
    for s in symbols:
        top = min(((-r.score, r.param_id) for r in trials if r.symbol == s and r.score is not None), default=(0.0, None))
        assert (-best[s].score, best[s].param_id, best[s].n_trials) == (*top, 60)
    table = catalog.QUERIES["metrics_printed"](spark, sf_dir).collect()
    assert len(table) == 12 * len(symbols) and {r.metric for r in table} == {label for label, _, _ in metrics.LABELS}
