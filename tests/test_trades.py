"""Golden tiny frames and comparison with a plain bar loop."""

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.operators import layout, metrics, signals, trades
from barloom.operators.trades import Account, Costs

FREE = Costs(taker_fee=0.0, slippage_bps=0.0)


def run_of(spark, rows, trail=True, block=16_384):
    """rows: (open, high, low, close, entry, exit, stop, target)"""
    pdf = pd.DataFrame(rows, columns=["open", "high", "low", "close", "entry", "exit", "stop", "take_profit"])
    pdf["ts"] = pd.date_range("2024-01-01", periods=len(pdf), freq="h")
    pdf["symbol"] = "X"
    df = spark.createDataFrame(pdf).withColumns({
        "stop": F.nanvl("stop", F.lit(None)), "take_profit": F.nanvl("take_profit", F.lit(None)), "trail": F.lit(trail)})
    return layout.lay_out(df, ("symbol",), step_seconds=3600, block=block)


def bars(closes, entries=(), exits=(), stop=np.nan, tp=np.nan, highs=None, lows=None, pad=0.5):
    out, prev = [], closes[0]
    for i, c in enumerate(closes):
        hi = highs[i] if highs else max(prev, c) + pad
        lo = lows[i] if lows else min(prev, c) - pad
        out.append((prev, hi, lo, c, i in entries, i in exits, stop, tp))
        prev = c
    return out


def test_flat_and_next_bar_fill(spark):
    blotter, curve = trades.backtest(run_of(spark, bars([100, 101, 102, 103, 104])), FREE)
    assert blotter.count() == 0
    assert curve.df.agg(F.min("equity"), F.max("equity")).first()[:] == (10000.0, 10000.0)
    rows = [(100.0, 100.1, 99.9, 100.0, False, False, np.nan, np.nan),
            (100.0, 100.1, 99.9, 100.0, True, False, np.nan, np.nan),
            (200.0, 200.2, 199.8, 200.0, False, False, np.nan, np.nan),
            (200.0, 200.2, 199.8, 200.0, False, False, np.nan, np.nan)]
    blotter, _ = trades.backtest(run_of(spark, rows), FREE)
    t = blotter.first()
    assert (t.entry_price, t.reason) == (200.0, "eod")


def test_target_stop_priority_and_fixed_stop(spark):
    b, _ = trades.backtest(run_of(spark, bars([100, 100, 101, 105, 110, 116, 120], {1}, stop=95.0, tp=115.0), False), FREE)
    t = b.collect()
    assert len(t) == 1 and t[0].reason == "take_profit" and t[0].exit_price == 115.0
    assert abs(t[0]["return"] - 0.15) < 1e-9
    b, _ = trades.backtest(run_of(spark, bars(
        [100, 100, 100, 101, 102], {1}, stop=98.0, tp=103.0,
        highs=[100.5, 100.5, 100.5, 104.0, 102.5], lows=[99.5, 99.5, 99.5, 97.0, 101.5]), False), FREE)
    assert [r.reason for r in b.collect()] == ["stop"]
    b, _ = trades.backtest(run_of(spark, bars([100, 100, 108, 96, 112, 116], {1}, stop=95.0, tp=115.0), False), FREE)
    assert b.first().reason == "take_profit"


def test_costs_bite(spark):
    rows = bars(list(np.linspace(100, 110, 30)), {1})
    last = lambda c: trades.backtest(run_of(spark, rows), c)[1].df.agg(F.max_by("equity", "bar_no")).first()[0]
    assert last(Costs(0.001, 10.0)) < last(FREE)


def loop(g, costs, acc, trail):
    """Plain restatement of the trading rules, one bar after the other."""
    cash, qty, px, stop, tp, at, armed = acc.initial_cash, 0.0, 0.0, np.nan, np.nan, None, False
    out, curve, n = [], [], len(g)
    r = g.to_dict("records")

    def sell(i, price, reason):
        nonlocal cash, qty
        cash += qty * price * (1 - costs.taker_fee)
        out.append((at, i, round(px, 6), round(price, 6), round(qty, 6), reason))
        qty = 0.0

    for i, b in enumerate(r):
        if armed:
            fill, prior = b["open"] * (1 + costs.slip), r[i - 1]["stop"]
            if prior < fill:
                q = min(cash * acc.risk_per_trade / (fill - prior), cash / fill)
            else:
                q, prior = cash / fill, np.nan
            q = q if acc.allow_fractional else np.floor(q)
            if q > 0:
                cash -= q * fill * (1 + costs.taker_fee)
                qty, px, stop, tp, at = q, fill, prior, r[i - 1]["take_profit"], i
            armed = False
        if qty:
            if trail and b["stop"] == b["stop"]:
                stop = np.fmax(stop, b["stop"])
            if b["low"] <= stop:
                sell(i, min(b["open"], stop) * (1 - costs.slip), "stop")
            elif b["high"] >= tp:
                sell(i, max(b["open"], tp) * (1 - costs.slip), "take_profit")
            elif b["exit"] and i + 1 < n:
                sell(i + 1, r[i + 1]["open"] * (1 - costs.slip), "signal")
        if not qty and b["entry"] and i + costs.latency < n:
            armed = True
        curve.append(cash + qty * b["close"])
    if qty:
        sell(n - 1, r[-1]["close"] * (1 - costs.slip), "eod")
        curve[-1] = cash
    return out, curve


@pytest.mark.parametrize("block,trail,fractional", [
    (16_384, True, True), (16_384, False, True), (64, True, True), (64, False, True), (64, True, False)])
def test_walk_equals_plain_loop(spark, walk, block, trail, fractional):
    rng = np.random.default_rng(11)
    pdf = walk.copy()
    pdf["entry"] = rng.random(len(pdf)) < 0.15
    # A long stretch without exits forces positions over several blocks.
    pdf["exit"] = (rng.random(len(pdf)) < 0.05) & ~((pdf.symbol == "HOT") & (pdf.ts > "2020-09-01") & (pdf.ts < "2021-09-01"))
    pdf["stop"] = np.where(rng.random(len(pdf)) < 0.8, pdf.close * 0.7, np.nan)
    pdf["take_profit"] = np.where(rng.random(len(pdf)) < 0.5, pdf.close * 1.3, np.nan)
    costs, acc = Costs(), Account(allow_fractional=fractional)
    df = spark.createDataFrame(pdf).withColumns({
        "stop": F.nanvl("stop", F.lit(None)), "take_profit": F.nanvl("take_profit", F.lit(None)), "trail": F.lit(trail)})
    s = layout.lay_out(df, ("symbol",), block=block)
    blotter, curve = trades.backtest(s, costs, acc)
    got = blotter.orderBy("symbol", "entry_no").collect()
    equity = curve.select("bar_no", "equity").orderBy("symbol", "bar_no").toPandas()
    for symbol, g in pdf.groupby("symbol"):
        want, want_curve = loop(g.reset_index(drop=True), costs, acc, trail)
        mine = [(t.entry_no, t.exit_no, round(t.entry_price, 6), round(t.exit_price, 6), round(t.qty, 6), t.reason)
                for t in got if t.symbol == symbol]
        assert mine == want
        np.testing.assert_allclose(equity[equity.symbol == symbol].equity, want_curve, rtol=1e-10)


def test_metrics_known_values(spark):
    def of(values, pnl=None, tf="1d"):
        pdf = pd.DataFrame({"symbol": "X", "bar_no": range(len(values)), "equity": [float(v) for v in values]})
        pdf["pnl"] = (pnl or []) + [None] * (len(values) - len(pnl or []))
        pdf["pnl"] = pdf["pnl"].astype(float)
        df = spark.createDataFrame(pdf).withColumns({
            "blk": F.lit(0), "sub": F.lit(0), "core": F.lit(True), "pnl": F.nanvl("pnl", F.lit(None))})
        s = layout.Series(df, ("symbol",), 16_384, len(values))
        s = layout.previous(s, {"_b": "equity"}).with_columns({"ret": F.col("equity") / F.col("_b") - 1})
        return metrics.summarize(s, tf).first()

    assert abs(of([100, 120, 60, 90, 150]).max_drawdown + 0.5) < 1e-12
    assert abs(of(np.linspace(100, 200, 366)).cagr - 1.0) < 0.05
    flat = of([100] * 50)
    assert (flat.sharpe, flat.sortino, flat.calmar, flat.n_trades, flat.profit_factor) == (0, 0, 0, 0, 0)
    m = of([1, 2, 3, 4, 5], [10.0, -5.0, 20.0, -5.0, -5.0])
    assert (m.n_trades, m.profit_factor, round(m.win_rate, 9)) == (5, 2.0, 0.4)
    assert of([1, 2], [3.0]).profit_factor == float("inf")


def test_strategies_have_entries_and_registry(spark, walk_df):
    s = layout.lay_out(walk_df, ("symbol",), halo=64)
    for name in ("momentum_breakout", "mean_reversion", "breakout_rr"):
        out = signals.generate(s, name).core_rows().df
        assert out.filter("entry").count() > 0
        assert out.filter("entry AND bar_no < 15").count() == 0
    with pytest.raises(KeyError):
        signals.get_strategy("nope")
    with pytest.raises(ValueError):
        signals.signal(signals.Strategy("BREAKOUT_RR", {}, {}, {}, {}, None))
    assert len(signals.list_strategies()) == 5


def random_bars(rng, n):
    """Coarse prices (many ties), missing values, frequent signals."""
    close = 100 + np.cumsum(rng.integers(-2, 3, n)).astype(float)
    open_ = close + rng.integers(-1, 2, n)
    g = pd.DataFrame({"open": open_, "high": np.maximum(open_, close) + rng.integers(0, 2, n),
                      "low": np.minimum(open_, close) - rng.integers(0, 2, n), "close": close,
                      "entry": rng.random(n) < rng.choice([0.1, 0.6]), "exit": rng.random(n) < rng.choice([0.0, 0.1]),
                      "stop": np.where(rng.random(n) < 0.3, np.nan, close - rng.integers(-1, 8, n)),
                      "take_profit": np.where(rng.random(n) < 0.5, np.nan, close + rng.integers(0, 9, n))})
    for c in ("high", "low"):
        g.loc[rng.random(n) < 0.03, c] = np.nan
    return g


def blocks_of(g, size, trail, costs, acc):
    n = len(g)
    ts = pd.date_range("2024-01-01", periods=n, freq="h").to_numpy().astype("datetime64[us]")
    for a in range(0, n, size):
        b, part = min(n, a + size), g.iloc[a:a + size]
        yield trades.Block(pa.table({
            "bar_no": np.arange(a, b), "n_bars": np.full(b - a, n), "ts": ts[a:b], "trail": np.full(b - a, trail),
            **{c: pa.array(part[c].to_numpy()) for c in ("open", "high", "low", "close", "entry", "exit", "stop", "take_profit")},
            "next_open": np.full(b - a, g["open"].iloc[b] if b < n else np.nan),
            "next_ts": np.full(b - a, ts[b] if b < n else np.datetime64("NaT", "us"))}), costs, acc)


def test_blocks_of_any_size_equal_plain_loop():
    """Ends by lookup, chains by pointers and starts by summaries, against one bar after the other."""
    rng = np.random.default_rng(11)
    for case in range(400):
        g, trail, fractional = random_bars(rng, int(rng.integers(2, 70))), bool(case % 2), case % 3 > 0
        costs, acc = Costs(0.001, 10.0, int(rng.integers(1, 4))), Account(2_000.0, 0.02, fractional)
        want, curve = loop(g, costs, acc, trail)
        state, got, equity, ret = trades.State(acc.initial_cash), [], [], []
        through = state
        for block in blocks_of(g, int(rng.integers(1, 30)), trail, costs, acc):
            if fractional:  # the start found from the summaries before
                assert (state.position is None) == (through.position is None) and state.ruined == through.ruined
                np.testing.assert_allclose([through.cash, through.before], [state.cash, state.before], rtol=1e-9)
                if state.position:
                    a, b = state.position, through.position
                    assert (a.entry_no, a.level, a.target) == (b.entry_no, b.level, b.target)
                    np.testing.assert_allclose(a.qty, b.qty, rtol=1e-9)
                through = trades._through(through, pickle.loads(block.summary()), costs)
            done, behind = block.emit(state)
            made = block.curve(state, done, behind)
            equity += made["equity"].tolist()
            ret += made["ret"].tolist()
            got += [(t["entry_no"], t["exit_no"], round(t["entry_price"], 6), round(t["exit_price"], 6), round(t["qty"], 6), t["reason"])
                    for t in done]
            state = behind
        assert got == want
        np.testing.assert_allclose(equity, curve, rtol=1e-9)
        np.testing.assert_allclose(ret[1:], np.array(curve[1:]) / np.array(curve[:-1]) - 1, rtol=1e-6, atol=1e-9)
