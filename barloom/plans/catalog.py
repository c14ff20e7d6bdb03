"""Registered queries: name -> function of (session, table folder)."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import scalars, venue
from barloom.operators import indicators as ind
from barloom.operators import folds, layout, ledger, metrics, quality, risk, signals, trades
from barloom.operators.layout import Series
from barloom.plans import resample, segments, sweep, validation
from barloom.schemas import PRICE_COLUMNS
from barloom.session import shared_folder, tune
from barloom.sources import bars as bar_io
from barloom.sources import fixtures as fx
from barloom.sources.store import BarStore, upsert_stream
from barloom.streaming import bars as stream_ops

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark, sf_dir), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def rounded(digits: int = 6, **columns) -> list:
    return [F.round(c if not isinstance(c, str) else F.col(c), digits).alias(n) for n, c in columns.items()]


def walk_series(spark: SparkSession, sf_dir: str, halo: int = 64) -> Series:
    return layout.lay_out(fx.walk_bars(spark, sf_dir), ("symbol",), halo=halo)


# --- sources and scalar functions --------------------------------------------

@query
def bar_file_scan(spark, sf_dir):
    """Read a file as bars, normalise the names and summarise per key."""
    df = bar_io.read_bars(spark, f"{sf_dir}/events.parquet")
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"),
                                        F.max("ts").alias("last_ts"), F.round(F.max("value"), 6).alias("top"))


def _store(spark, schema) -> BarStore:
    return BarStore(spark, f"{_folder(spark)}/store", schema, buckets=8, period="yyyy")  # daily bars


@query
def range_scan(spark, sf_dir):
    """Bars of one key and range from a bar table kept by bucket of the symbol and year."""
    bars = fx.walk_bars(spark, sf_dir)
    store = _store(spark, bars.schema)
    store.upsert(bars, "load", 0)
    return store.read("1996-01-01", "1999-01-01", symbol="S7").drop("symbol")


@query
def stream_upsert(spark, sf_dir):
    """The old bars, then the new ones in three batches of a stream, one of them given twice; the table they leave."""
    old, new = _page(spark, sf_dir)
    store, folder = _store(spark, old.schema), _folder(spark)
    store.upsert(old, "load", 0)
    new.write.parquet(f"{folder}/new")  # made once, not once per part
    new = spark.read.schema(new.schema).parquet(f"{folder}/new")
    for part in range(3):  # the stream takes in all files of a part as one batch, then stops and goes on with the next part
        new.filter(F.pmod(F.year("ts"), F.lit(3)) == part).write.mode("append").parquet(f"{folder}/input")
        stream = spark.readStream.schema(new.schema).parquet(f"{folder}/input")
        upsert_stream(stream, store, f"{folder}/checkpoint").awaitTermination()
    store.upsert(old, "load", 0)  # taken in before
    return store.read()


def _page(spark, sf_dir):
    bars = fx.walk_bars(spark, sf_dir)
    new = bars.filter(F.col("ts") >= F.lit("2000-01-01").cast("timestamp_ntz")).withColumns(
        {"close": F.col("close") + 1, "high": F.col("high") + 1})
    return bars.filter(F.col("ts") < F.lit("2001-01-01").cast("timestamp_ntz")), new


@query
def upsert_bars(spark, sf_dir):
    old, new = _page(spark, sf_dir)
    return bar_io.merged(old, new, ["symbol", "ts"])


@query
def candle_objects(spark, sf_dir):
    raw = fx.candle_payloads(spark, sf_dir).select("symbol", "seq", "as_object")
    parsed = venue.candles_from_objects(raw, "as_object")
    kept = quality.one_per_key(parsed, ["symbol", "ts"], "seq", "last")
    return bar_io.before(kept, "2001-06-01").drop("seq")


@query
def candle_arrays(spark, sf_dir):
    raw = fx.candle_payloads(spark, sf_dir).select("symbol", "seq", "as_mixed")
    parsed = venue.candles_from_mixed(raw, "as_mixed")
    kept = quality.one_per_key(parsed, ["symbol", "ts"], "seq", "first")
    return bar_io.before(kept, "2001-06-01").drop("seq")


@query
def params_pairing(spark, sf_dir):
    suppliers = fx.table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    text = (F.when(F.col("s_suppkey") % 4 == 0, F.format_string('{"ema_fast": %d}', F.col("s_suppkey")))
            .when(F.col("s_suppkey") % 4 == 1,
                  F.format_string('{"backend": "x", "best_params": {"ema_fast": %d, "atr_mult": 2.5}}', F.col("s_suppkey")))
            .when(F.col("s_suppkey") % 4 == 2, F.lit('{"best_params": null}')))
    docs = suppliers.select(key.alias("symbol"), text.alias("doc")).filter("doc IS NOT NULL")
    paired = bar_io.pair_params(suppliers.select(key.alias("symbol")), bar_io.params_of(docs, "doc"))
    value = lambda name, default: F.coalesce(F.try_element_at("params", F.lit(name)), F.lit(default))
    return paired.select("symbol", value("ema_fast", 50.0).alias("ema_fast"), value("atr_mult", 3.0).alias("atr_mult"))


@query
def symbol_and_timeframe(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    frames = F.array(*[F.lit(t) for t in ("5m", "15m", "1h", "4h", "1d", "2w")])
    tf = F.element_at(frames, (F.col("o_orderkey") % 6 + 1).cast("int"))
    pair = F.concat(F.lit("c"), F.col("o_custkey").cast("string"),
                    F.when(F.col("o_orderkey") % 2 == 0, "/usdt").otherwise("-perp"))
    ms = scalars.to_millis(F.col("o_orderdate"))
    return orders.select(
        "o_orderkey", scalars.coin_of(pair).alias("coin"), tf.alias("timeframe"),
        scalars.timeframe_seconds(tf).alias("seconds"), scalars.timeframe_millis(tf).alias("millis"),
        scalars.bars_per_year(tf).alias("per_year"), ms.alias("ts_ms"), scalars.default_window(ms).alias("since_ms"))


def _responses(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    pick, key = F.col("o_orderkey") % 6, F.col("o_orderkey")
    body = lambda inner, *args: F.format_string('{"status":"ok","response":{"data":{"statuses":[' + inner + "]}}}", *args)
    text = (F.when(pick == 0, body('{"resting":{"oid":%d}}', key))
            .when(pick == 1, body('{"filled":{"oid":%d,"totalSz":"%d","avgPx":"%.2f"}}', key, key % 9 + 1, F.col("o_totalprice")))
            .when(pick == 2, body('{"error":"rejected by %s"}', F.col("o_orderpriority")))
            .when(pick == 3, F.lit('{"status":"err","response":"bad"}'))
            .when(pick == 4, F.lit('{"status":"ok","response":{"type":"cancel"}}'))
            .otherwise(body('{"filled":{"oid":%d}}', key)))
    return o.select("o_orderkey", (F.col("o_custkey") % 50).cast("double").alias("qty"), text.alias("payload"))


@query
def order_responses(spark, sf_dir):
    return venue.order_outcome(_responses(spark, sf_dir), "payload", "qty").drop("payload")


@query
def status_mapping(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("NEW", "Open", "partially_filled", "Closed", "canceled", "weird", "Rejected")])
    word = F.when(F.col("o_orderkey") % 8 < 7, F.element_at(words, (F.col("o_orderkey") % 8 + 1).cast("int")))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", venue.map_status(word).alias("status"))


def _account_states(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    text = F.format_string(
        '{"assetPositions":[{"position":{"coin":"A%d","szi":"%d","entryPx":"%.2f","unrealizedPnl":"%.2f"}},'
        '{"position":{"coin":"B","szi":"%d","entryPx":null}}],'
        '"marginSummary":{"accountValue":"%.2f"},"withdrawable":"%d"}',
        k % 7, k % 5 - 2, bal, -bal, k % 3, bal, k)
    return c.select("c_custkey", text.alias("state"))


@query
def account_positions(spark, sf_dir):
    return venue.open_positions(_account_states(spark, sf_dir), "state").select(
        "c_custkey", "symbol", *rounded(qty="qty", avg_price="avg_price", unrealized_pnl="unrealized_pnl"))


@query
def account_balances(spark, sf_dir):
    return venue.balances(_account_states(spark, sf_dir), "state")


@query
def position_sizing(spark, sf_dir):
    li = fx.table(spark, sf_dir, "orders")
    equity, price = F.lit(10_000.0) + F.col("o_custkey"), F.round(F.col("o_totalprice") / 1000, 2)
    stop = price * (0.9 + (F.col("o_orderkey") % 13) / 100.0)
    risk = (F.col("o_orderkey") % 20) / 1000.0
    fixed = scalars.fixed_fractional_size(equity, price, stop, risk)
    whole = scalars.fixed_fractional_size(equity, price, stop, risk, allow_fractional=False)
    vol = scalars.volatility_adjusted_size(equity, price, (F.col("o_orderkey") % 7).cast("double"), risk)
    return li.select("o_orderkey", *rounded(
        8, clamped=scalars.clamp_risk(risk), fixed_qty=fixed["qty"], fixed_notional=fixed["notional"],
        risk_cash=fixed["risk_cash"], whole_qty=whole["qty"], vol_qty=vol["qty"], vol_notional=vol["notional"]))


# --- quality -------------------------------------------------------------------

_FAULT_STEP = 2 * 86_400_000


def _report(spark, sf_dir):
    return quality.report(fx.faulty_bars(spark, sf_dir), ("symbol",), "1d", "ingest_seq", _FAULT_STEP)


@query
def quality_report(spark, sf_dir):
    df = _report(spark, sf_dir)
    return df.withColumns({"messages": F.concat_ws("; ", "messages"), "first_gap": F.get("gaps", F.lit(0))["gap_start"],
                           "kept_gaps": F.size("gaps").cast("long")}).drop("gaps")


@query
def quality_report_hourly(spark, sf_dir):
    """Gappy hourly bars; every event type is expected, and one that never occurs."""
    bars = fx.event_bars(spark, sf_dir)
    expected = bars.select("symbol").distinct().unionByName(
        fx.table(spark, sf_dir, "region").select(F.concat(F.lit("none-"), "r_name").alias("symbol")))
    df = quality.report(bars, ("symbol",), "1h", expected=expected)
    return df.withColumns({"messages": F.concat_ws("; ", "messages"), "kept_gaps": F.size("gaps").cast("long")}).drop("gaps")


@query
def quality_run_rows(spark, sf_dir):
    return bar_io.quality_rows(_report(spark, sf_dir), "testx", "1d").drop("details", "range_start", "range_end")


@query
def bar_gaps(spark, sf_dir):
    return quality.gaps(quality.delivered(fx.event_bars(spark, sf_dir), ("symbol",), "1h"))


@query
def return_anomalies(spark, sf_dir):
    s = quality.anomalies(quality.delivered(fx.walk_bars(spark, sf_dir), ("symbol",), "1d"), 1.6)
    return s.df.filter("is_anomaly").select("symbol", "ts", *rounded(log_ret="log_ret"))


@query
def clean_bars(spark, sf_dir):
    return quality.clean(fx.faulty_bars(spark, sf_dir), ("symbol",), "ingest_seq").select("symbol", "ts", *PRICE_COLUMNS)


# --- indicators ------------------------------------------------------------------

@query
def returns(spark, sf_dir):
    s = ind.returns(walk_series(spark, sf_dir))
    return s.core_rows().df.select(
        "symbol", "ts", *rounded(8, log_ret="log_ret", simple_ret="simple_ret", diff="diff"))


@query
def moving_averages(spark, sf_dir):
    s = ind.volume_filter(ind.sma(ind.ema(ind.ema(walk_series(spark, sf_dir), 50, out="ema50"), 20, out="ema20"), 20))
    return s.core_rows().df.select("symbol", "ts", *rounded(ema50="ema50", ema20="ema20"), *rounded(8, sma="sma"), "vol_ok")


@query
def true_range_atr(spark, sf_dir):
    s = ind.atr(ind.true_range(walk_series(spark, sf_dir)))
    return s.core_rows().df.select("symbol", "ts", *rounded(true_range="true_range", atr="atr"))


@query
def rsi(spark, sf_dir):
    return ind.rsi(walk_series(spark, sf_dir)).core_rows().df.select("symbol", "ts", *rounded(rsi="rsi"))


@query
def adx(spark, sf_dir):
    return ind.adx(walk_series(spark, sf_dir)).core_rows().df.select("symbol", "ts", *rounded(adx="adx"))


@query
def channels(spark, sf_dir):
    s = ind.donchian_channels(ind.bollinger_bands(walk_series(spark, sf_dir)))
    names = ("bb_lower", "bb_mid", "bb_upper", "dc_lower", "dc_mid", "dc_upper")
    return s.core_rows().df.select("symbol", "ts", *rounded(8, **{n: n for n in names}))


@query
def zscore_volatility(spark, sf_dir):
    s = ind.realized_volatility(ind.rolling_zscore(walk_series(spark, sf_dir), 20))
    return s.core_rows().df.select("symbol", "ts", *rounded(zscore="zscore", rvol="rvol"))


@query
def crosses(spark, sf_dir):
    """Closes crossing their 20-bar mean."""
    s = ind.sma(walk_series(spark, sf_dir), 20)
    s = s.with_columns({"above": F.coalesce(F.round(F.col("close") - F.col("sma"), 6) > 0, F.lit(False))})
    up, down = ind.crossed(s, "above")
    s = s.with_columns({"crossed_up": up, "crossed_down": down})
    return s.core_rows().df.filter("crossed_up OR crossed_down").select("symbol", "ts", "crossed_up", "crossed_down")


@query
def drawdown_compounding(spark, sf_dir):
    s = layout.previous(walk_series(spark, sf_dir, 0), {"prev": "close"})
    s = s.with_columns({"ret": F.col("close") / F.col("prev") - 1})
    s = metrics.compounded(metrics.drawdown(s, "close"), "ret")
    return s.df.select("symbol", "ts", *rounded(9, peak="peak", drawdown="drawdown", growth="growth"))


# --- signals, trades, metrics ------------------------------------------------------

def signals_of(spark, sf_dir, name, sets=None) -> Series:
    strategy = signals.get_strategy(name)
    chosen = [signals.with_defaults(strategy, p) for p in (sets or [{}])]
    return signals.generate(walk_series(spark, sf_dir, signals.halo_of(strategy, chosen)), name, sets)


def _signal_query(name):
    def run(spark, sf_dir):
        return signals_of(spark, sf_dir, name).core_rows().df.select(
            "symbol", "ts", "entry", "exit", *rounded(stop="stop", take_profit="take_profit"))

    run.__name__ = f"signals_{name}"
    return query(run)


def _blotter_query(name):
    def run(spark, sf_dir):
        s = signals_of(spark, sf_dir, name)
        return trades.blotter(s).select(
            "symbol", "entry_ts", "exit_ts", *rounded(entry_price="entry_price", exit_price="exit_price", qty="qty"),
            *rounded(4, pnl="pnl"), *rounded(8, trade_return="return"), "reason")

    run.__name__ = f"trades_{name}"
    return query(run)


def rounded_metrics() -> list:
    return [F.col(m) if m == "n_trades" else F.round(m, 6).alias(m) for m in metrics.METRICS]


def _metrics_query(name):
    def run(spark, sf_dir):
        return metrics.summarize(trades.backtest(signals_of(spark, sf_dir, name))[1], by=["symbol"]).select(
            "symbol", *rounded_metrics())

    run.__name__ = f"metrics_{name}"
    return query(run)


for _name in ("trend_following", "momentum_breakout", "mean_reversion", "regime_adaptive", "breakout_rr"):
    _signal_query(_name)
    _blotter_query(_name)
    _metrics_query(_name)


@query
def trades_whole_units(spark, sf_dir):
    s = signals_of(spark, sf_dir, "momentum_breakout")
    account = trades.Account(allow_fractional=False)
    return trades.blotter(s, account=account).select(
        "symbol", "entry_ts", "exit_ts", *rounded(entry_price="entry_price", exit_price="exit_price", qty="qty"),
        *rounded(4, pnl="pnl"), *rounded(8, trade_return="return"), "reason")


@query
def equity_curve(spark, sf_dir):
    _, curve = trades.backtest(signals_of(spark, sf_dir, "momentum_breakout"))
    return curve.df.select("symbol", "ts", *rounded(4, equity="equity"), *rounded(8, ret="ret"))


@query
def metrics_printed(spark, sf_dir):
    """Long-form metric table; counts and labels, values as printed text."""
    m = metrics.summarize(trades.backtest(signals_of(spark, sf_dir, "momentum_breakout"))[1], by=["symbol"])
    return metrics.metrics_table(m, ["symbol"]).select("symbol", F.col("line").cast("long").alias("line"), "metric", "value")


QUERIES["metrics_printed_full"] = QUERIES["metrics_printed"]  # its name while `metrics_printed` showed three labels


# --- validation, resampling, sweeps --------------------------------------------------

@query
def in_out_split(spark, sf_dir):
    numbered, _ = layout.number_rows(fx.walk_bars(spark, sf_dir), ("symbol",))
    return segments.in_out_of_sample(numbered, 0.7, 25).select("symbol", "segment", "ts", "bar_no", "n_bars")


@query
def walk_forward_windows(spark, sf_dir):
    numbered, _ = layout.number_rows(fx.walk_bars(spark, sf_dir), ("symbol",))
    return segments.walk_forward_windows(numbered).groupBy("symbol", F.col("segment").cast("long").alias("segment")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_rows"),
        F.max("test_size").alias("test_size"))


def _split_metrics(spark, sf_dir):
    _, curve = validation.run_split(fx.walk_bars(spark, sf_dir), ("symbol",), "momentum_breakout")
    return metrics.summarize(curve)


@query
def split_metrics(spark, sf_dir):
    return _split_metrics(spark, sf_dir).select("symbol", "segment", *rounded_metrics())


@query
def acceptance_gates(spark, sf_dir):
    loose = validation.Criteria(min_sharpe=0.2, min_profit_factor=1.0, min_trades=2, max_drawdown=0.05)
    wide = validation.side_by_side(_split_metrics(spark, sf_dir), ["symbol"])
    report = validation.gates(wide, ["symbol"], loose)
    return _shown_gates(report, ["symbol"])


@query
def trade_bootstrap(spark, sf_dir):
    s = signals_of(spark, sf_dir, "momentum_breakout")
    blotter = trades.blotter(s)
    out = resample.trade_bootstrap(fx.walk_bars(spark, sf_dir).select("symbol").distinct(), blotter, ["symbol"], "entry_no")
    return out.select("symbol", "n_sims", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("symbol", "n_sims")])


@query
def block_bootstrap(spark, sf_dir):
    s = walk_series(spark, sf_dir)
    s = ind.returns(s).with_columns({"ret": F.col("simple_ret")})
    return resample.block_bootstrap(s, n_sims=1000).select("symbol", "sim", F.round("terminal", 6).alias("terminal"))


#: Trials of a sweep, as many as the reference draws.
SWEEP_TRIALS = 60


def _trials(spark, sf_dir):
    sets = sweep.draw_parameters("momentum_breakout", SWEEP_TRIALS)
    return sweep.trials(fx.walk_bars(spark, sf_dir), ("symbol",), "momentum_breakout", sets,
                        sweep.Objective(min_trades=3))


def _shown_trials(trials):
    names = [f"{s}_{m}" for s in ("is", "oos") for m in ("sharpe", "cagr", "max_drawdown", "n_trades")]
    return trials.select("symbol", F.col("param_id").cast("long").alias("param_id"), *[F.round(n, 6).alias(n) for n in names],
                         F.round(F.nullif("score", F.lit(float("-inf"))), 6).alias("score"))


def _shown_best(trials):
    return sweep.best_trial(trials, ["symbol"]).select(
        "symbol", F.col("param_id").cast("long").alias("param_id"), F.round("score", 6).alias("score"), "n_trials")


@query
def sweep_trials(spark, sf_dir):
    return _shown_trials(_trials(spark, sf_dir))


@query
def sweep_best(spark, sf_dir):
    return _shown_best(_trials(spark, sf_dir))


# Their names while the others had four trials.
QUERIES["sweep_trials_full"], QUERIES["sweep_best_full"] = QUERIES["sweep_trials"], QUERIES["sweep_best"]


def _sensitivity(spark, sf_dir):
    return sweep.sensitivity(lambda halo: walk_series(spark, sf_dir, halo), "momentum_breakout")


@query
def sensitivity_table(spark, sf_dir):
    return _sensitivity(spark, sf_dir).select("symbol", "param", *rounded(value="value"), *rounded_metrics())


@query
def sensitivity_robustness(spark, sf_dir):
    return sweep.robustness(_sensitivity(spark, sf_dir), ["symbol"]).select("symbol", *rounded(robustness="robustness"))


def _walk_forward(spark, sf_dir, sets=None):
    return validation.walk_forward(fx.walk_bars(spark, sf_dir), ("symbol",), "momentum_breakout", sets)


@query
def walk_forward_equity(spark, sf_dir):
    _, _, stitched = _walk_forward(spark, sf_dir)
    return stitched.df.select("symbol", "ts", *rounded(4, equity="equity"))


@query
def walk_forward_metrics(spark, sf_dir):
    _, _, stitched = _walk_forward(spark, sf_dir)
    return metrics.summarize(stitched).select("symbol", *rounded_metrics())


@query
def walk_forward_fitted(spark, sf_dir):
    """Each window trades the set that did best on its own train rows."""
    windows, _, _ = _walk_forward(spark, sf_dir, [{"channel": 20}, {"channel": 30}])
    return windows.select("symbol", F.col("segment").cast("long").alias("segment"),
                          F.col("param_id").cast("long").alias("param_id"), *rounded_metrics())


def _window_channels(train, run_keys):
    """A channel length for each window, from its train rows: 10 and a number under 40 made of their rising bars."""
    rising = F.sum((F.col("close") > F.col("open")).cast("long"))
    return train.groupBy(*run_keys).agg((10 + rising % 40).cast("int").alias("channel"), (5 + rising % 12).cast("int").alias("exit_channel"))


@query
def walk_forward_fit_function(spark, sf_dir):
    """Each window trades the lengths that a function finds on its train rows."""
    windows, chosen, _ = validation.walk_forward(fx.walk_bars(spark, sf_dir), ("symbol",), "momentum_breakout", fit=_window_channels)
    return layout.join_on(windows, chosen.select("symbol", "segment", "channel", "exit_channel"), ["symbol", "segment"]).select(
        "symbol", F.col("segment").cast("long").alias("segment"), F.col("channel").cast("long").alias("channel"),
        F.col("exit_channel").cast("long").alias("exit_channel"), *rounded_metrics())


@query
def walk_forward_given(spark, sf_dir):
    """Each window trades the set that a table gives it; hourly metrics."""
    windows = segments.walk_forward_windows(layout.number_rows(fx.walk_bars(spark, sf_dir), ("symbol",))[0]).select("symbol", "segment").distinct()
    given = windows.withColumn("channel", (15 + 5 * F.col("segment")).cast("int"))
    shown, _, _ = validation.walk_forward(fx.walk_bars(spark, sf_dir), ("symbol",), "momentum_breakout", given=given, timeframe="1h")
    return shown.select("symbol", F.col("segment").cast("long").alias("segment"), *rounded_metrics())


@query
def regime_gates(spark, sf_dir):
    """Gates of the adaptive strategy with a check of each regime's out-of-sample drawdown."""
    _, curve = validation.run_split(fx.walk_bars(spark, sf_dir), ("symbol",), "regime_adaptive", carry=("is_trend",))
    named = F.when(F.col("is_trend"), "trend").otherwise("range")
    oos = curve.using(curve.df.filter("segment = 'oos'").withColumn("regime", named))
    regimes = metrics.regime_drawdowns(oos, "regime").drop("segment", "param_id")
    wide = validation.side_by_side(metrics.summarize(curve), ["symbol"])
    report = validation.gates(wide, ["symbol"], validation.Criteria(max_drawdown=0.005, regime_tolerance=0.0), regimes)
    check = lambda n: F.try_element_at("checks", F.lit(n)).alias(n)
    deep = F.filter("reasons", lambda r: r.startswith("Regime"))
    return report.select("symbol", check("regime_range"), check("regime_trend"), F.array_join(deep, "; ").alias("regimes_failed"), "passed")


@query
def portfolio_equity(spark, sf_dir):
    _, curve = validation.run_split(fx.walk_bars(spark, sf_dir), ("symbol",), "momentum_breakout")
    return validation.portfolio(curve).df.select("segment", "ts", *rounded(4, equity="equity"))


@query
def portfolio_metrics(spark, sf_dir):
    _, curve = validation.run_split(fx.walk_bars(spark, sf_dir), ("symbol",), "momentum_breakout")
    return validation.portfolio_metrics(validation.portfolio(curve)).select("segment", *rounded_metrics())


def _shown_gates(report, keys):
    check = lambda n: F.try_element_at("checks", F.lit(n)).alias(n)
    return report.select(*keys, "passed", F.size("reasons").cast("long").alias("n_reasons"), F.array_join("reasons", "; ").alias("reasons"),
                         *[check(n) for n in ("oos_positive", "sharpe", "profit_factor", "max_drawdown", "min_trades", "is_oos_consistency")])


@query
def portfolio_gates(spark, sf_dir):
    """The acceptance gates, with the usual criteria, of the pooled portfolio of all symbols."""
    _, curve = validation.run_split(fx.walk_bars(spark, sf_dir), ("symbol",), "momentum_breakout")
    return _shown_gates(validation.portfolio_verdict(curve), [])


@query
def portfolio_bootstrap(spark, sf_dir):
    """Bootstrap of the pooled out-of-sample trades of all symbols, numbered by symbol and entry."""
    made, _ = validation.run_split(fx.walk_bars(spark, sf_dir), ("symbol",), "momentum_breakout")
    pooled = made.filter("segment = 'oos'").select("segment", "symbol", "entry_no", "return")
    numbered = layout.ranked(pooled.filter("return IS NOT NULL AND NOT isnan(return)"), ("segment",), ["symbol", "entry_no"], "trade_no")
    out = resample.trade_bootstrap(spark.range(1).select(F.lit("oos").alias("segment")), numbered, ["segment"], "trade_no", n_sims=200)
    return out.select("segment", "n_sims", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("segment", "n_sims")])


@query
def strategy_leaderboard(spark, sf_dir):
    board = validation.leaderboard(lambda halo: walk_series(spark, sf_dir, halo), signals.list_strategies(), ("symbol",))
    return board.groupBy("strategy").agg(
        F.round(F.avg("sharpe"), 6).alias("mean_sharpe"), F.round(F.avg("total_return"), 6).alias("mean_return"),
        F.round(F.min("max_drawdown"), 6).alias("worst_drawdown"), F.sum("n_trades").alias("n_trades"))


# --- risk and ledger -------------------------------------------------------------------

def _risk(spark, sf_dir, with_resets=True):
    snaps = fx.equity_snapshots(spark, sf_dir).withColumn("reset", F.dayofmonth("ts") == 1)
    s = layout.lay_out(snaps, ("account",))
    limits = risk.Limits(max_positions=2, daily_loss=0.05, weekly_loss=0.06, kill_drawdown=0.17)
    return risk.risk_state(s, 210_000.0, limits, "reset" if with_resets else None), limits


@query
def risk_state(spark, sf_dir):
    s, _ = _risk(spark, sf_dir)
    names = ("day_start", "week_start", "peak", "drawdown", "daily_pnl", "weekly_pnl")
    return s.df.select("account", "ts", *rounded(**{n: n for n in names}), "kill_switch")


@query
def entry_decisions(spark, sf_dir):
    s, limits = _risk(spark, sf_dir)
    return risk.entry_decisions(s, limits).df.select("account", "ts", "allowed", "reason")


def _fills(spark, sf_dir) -> Series:
    return layout.lay_out(fx.ledger_fills(spark, sf_dir), ("symbol",), "seq", 86400)


@query
def position_history(spark, sf_dir):
    return ledger.position_history(_fills(spark, sf_dir)).select(
        "symbol", "seq", "ts", "qty", *rounded(4, avg_price="avg_price", realized_pnl="realized_pnl"))


@query
def marked_positions(spark, sf_dir):
    held = ledger.current_positions(ledger.position_history(_fills(spark, sf_dir)), ["symbol"])
    prices = fx.ledger_fills(spark, sf_dir).select("symbol", F.col("seq").alias("ts"), "price")
    return ledger.mark_to_market(held, prices).select(
        "symbol", "qty", *rounded(9, price="price"), *rounded(4, value="value", unrealized_pnl="unrealized_pnl"))


@query
def account_equity(spark, sf_dir):
    """Cash plus positions per group of ten symbols."""
    held = ledger.current_positions(ledger.position_history(_fills(spark, sf_dir)), ["symbol"])
    prices = fx.ledger_fills(spark, sf_dir).select("symbol", F.col("seq").alias("ts"), "price")
    marked = ledger.mark_to_market(held, prices).withColumn("venue", F.right("symbol", F.lit(1)))
    return ledger.account_equity(marked, F.lit(10_000.0), ["venue"]).select("venue", *rounded(2, equity="equity"))


def _order_flow(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("A"), (F.col("o_custkey") % 100).cast("string")).alias("account"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_custkey") % 3 == 0, "sell").otherwise("buy").alias("side"),
        F.when(F.col("o_orderkey") % 4 == 0, "limit").otherwise("market").alias("type"),
        (F.col("o_orderkey") % 7 + 1).cast("double").alias("qty"),
        F.when(F.col("o_orderkey") % 8 == 0, F.round(F.col("o_totalprice") / 2000, 2)).alias("limit_price"),
        F.round(F.col("o_totalprice") / 1000, 2).alias("price"))


@query
def order_admission(spark, sf_dir):
    s = layout.lay_out(_order_flow(spark, sf_dir), ("account",), "seq", 1)
    return ledger.admit_orders(s).select(
        "account", "seq", "status", "reason", "filled_qty",
        *rounded(9, fill_price="fill_price"), *rounded(11, fee="fee"), *rounded(4, cash_left="cash_left"))


@query
def idempotent_orders(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("client_id"), F.col("o_orderkey").alias("seq"),
        F.element_at(F.array(F.lit("rejected"), F.lit("filled"), F.lit("submitted"), F.lit("rejected")),
                     (F.col("o_orderkey") % 4 + 1).cast("int")).alias("status"), "o_totalprice")
    return ledger.first_submissions(o, "seq")


@query
def trade_history(spark, sf_dir):
    return ledger.last_fills(fx.ledger_fills(spark, sf_dir), ["symbol"], "seq", 100)


def _position_rows(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("A"), (F.col("o_custkey") % 100).cast("string")).alias("account"),
                    F.col("o_orderpriority").alias("strategy_name"), F.col("o_orderkey").alias("position_id"),
                    F.round(F.col("o_totalprice"), 2).alias("avg_price"),
                    F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("closed_at"))


@query
def open_positions(spark, sf_dir):
    return ledger.open_rows(_position_rows(spark, sf_dir)).drop("closed_at")


@query
def venue_summary(spark, sf_dir):
    s, _ = _risk(spark, sf_dir, False)
    out = ledger.venue_summary(s.df, _position_rows(spark, sf_dir), ["account"])
    return out.select("account", *rounded(equity="equity", drawdown="drawdown"), "n_positions",
                      F.concat_ws(",", "strategies").alias("strategies"))


@query
def alert_rows(spark, sf_dir):
    s, _ = _risk(spark, sf_dir, False)
    orders = fx.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("subject"), F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("filled").alias("status"))
    gaps = quality.gaps(quality.delivered(fx.event_bars(spark, sf_dir), ("symbol",), "1h"))
    return risk.alerts(s.df, ["account"], 0.12, 0.05, orders, gaps)


@query
def event_log_counts(spark, sf_dir):
    orders, fills = fx.table(spark, sf_dir, "orders"), fx.ledger_fills(spark, sf_dir)
    events = ledger.event_rows("order", orders, "o_orderdate", F.lit("order"), ["o_orderkey", "o_orderstatus"])
    events = events.unionByName(ledger.event_rows("fill", fills, "ts", F.lit("fill"), ["symbol", "side", "qty"]))
    events = events.unionByName(ledger.event_rows(
        "error", orders.filter("o_orderstatus = 'F'"), "o_orderdate", F.lit("error"), ["o_orderkey"], "error"))
    return ledger.event_counts(events)


@query
def close_based_trades(spark, sf_dir):
    s = signals_of(spark, sf_dir, "momentum_breakout").with_columns({"ts": F.col("ts").cast("timestamp_ntz")})
    step = functools.partial(trades.close_step, warmup=60)
    out = folds.fold(s, step, functools.partial(trades.close_start, 10_000.0), trades.CLOSE_INPUTS, trades.CLOSE_OUTPUT,
                     trades.CLOSE_STATE)
    return out.select("symbol", "ts", "action", *rounded(price="price", qty="qty"), *rounded(4, pnl="pnl", equity="equity"))


# --- streaming ----------------------------------------------------------------------------

def _folder(spark) -> str:
    """A new folder for one streaming run, in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _as_stream(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(f"{folder}/input")
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{folder}/input")


@query
def stream_tick_bars(spark, sf_dir):
    folder, name = _folder(spark), "events.parquet"
    schema = spark.read.parquet(f"{sf_dir}/{name}").schema
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(sf_dir)
    out = stream_ops.run_available(stream_ops.tick_bars(ticks, "event_type", "value", "event_id"), folder)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def stream_clean_bars(spark, sf_dir):
    folder = _folder(spark)
    faulty = fx.faulty_bars(spark, sf_dir).withColumn("close", F.when(F.dayofmonth("ts") != 28, F.col("close")).otherwise(1.0))
    out = stream_ops.run_available(stream_ops.ingest_bars(_as_stream(faulty.drop("ingest_seq"), folder), "3650 days"), folder)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _signal_stream(spark, sf_dir):
    folder = _folder(spark)
    bars = fx.walk_bars(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream_ops.run_available(stream_ops.momentum_signals(_as_stream(bars, folder)), folder)


@query
def stream_signals(spark, sf_dir):
    return _signal_stream(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "entry", "exit",
                                                *rounded(stop="stop"))


@query
def stream_positions(spark, sf_dir):
    folder = _folder(spark)
    found = _signal_stream(spark, sf_dir)
    out = stream_ops.run_available(stream_ops.manage_positions(_as_stream(found, folder), warmup=60), folder)
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "action", *rounded(price="price", qty="qty"),
                      *rounded(4, pnl="pnl", equity="equity"))


@query
def stream_risk(spark, sf_dir):
    folder = _folder(spark)
    snaps = fx.equity_snapshots(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).select("account", "ts", "equity")
    out = stream_ops.run_available(stream_ops.risk_monitor(_as_stream(snaps, folder), 210_000.0,
                                                        risk.Limits(kill_drawdown=0.17)), folder)
    return out.select("account", F.col("ts").cast("timestamp_ntz").alias("ts"),
                      *rounded(drawdown="drawdown", daily_pnl="daily_pnl", weekly_pnl="weekly_pnl"), "kill_switch")
