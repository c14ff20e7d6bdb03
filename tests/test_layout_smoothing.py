import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import layout, smoothing
from barloom.operators.smoothing import Smooth, smooth

# One block for everything; several sub-blocks; several blocks with copied tails.
BLOCKS = [16_384, 256]


def collect(series, *columns):
    return series.select("ts", *columns).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def per_symbol(walk, fn):
    parts = [fn(g.reset_index(drop=True)) for _, g in walk.groupby("symbol", sort=True)]
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("block", BLOCKS)
def test_numbering_running_and_previous(walk_df, walk, block):
    s = layout.lay_out(walk_df, ("symbol",), halo=30, block=block)
    assert s.multi == (block < 900)
    s = layout.running(s, {"cs": ("sum", F.col("volume")), "mx": ("max", F.col("close")),
                           "ls": ("last", F.when(F.col("volume") > 90, F.col("volume")))})
    s = layout.previous(s, {"pc": "close"})
    got = collect(s, "bar_no", "n_bars", "cs", "mx", "ls", "pc")
    want = per_symbol(walk, lambda g: pd.DataFrame({
        "bar_no": np.arange(len(g)), "n_bars": len(g), "cs": g.volume.cumsum(), "mx": g.close.cummax(),
        "ls": g.volume.where(g.volume > 90).ffill(), "pc": g.close.shift(1)}))
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-12)


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("tight", [False, True])
def test_smoothing_matches_ewm_with_gaps(walk_df, walk, block, tight, monkeypatch):
    if tight:  # force the stretch-and-carry form and a deep carry tree
        monkeypatch.setattr(smoothing, "_LOG_RANGE", 0.0)
        monkeypatch.setattr(smoothing, "FAN_OUT", 2)
    gappy = walk_df.withColumn("x", F.when(F.dayofmonth("ts") % 7 > 1, F.col("close")))
    gappy = gappy.withColumn("x", F.when((F.col("ts") < "2020-01-05") | (F.year("ts") == 2021) & (F.month("ts") < 8),
                                         None).otherwise(F.col("x")))
    s = layout.lay_out(gappy, ("symbol",), halo=30, block=block)
    s = smooth(s, {"e": Smooth("x", 2 / 11, 10), "w": Smooth("close", 1 / 14, 14), "fast": Smooth("close", 0.9, 0),
                   "own": Smooth("close", 1.0, 3)})
    got = collect(s, "e", "w", "fast", "own")

    def want_of(g):
        keep = (g.ts.dt.day % 7 > 1) & ~((g.ts < "2020-01-05") | ((g.ts.dt.year == 2021) & (g.ts.dt.month < 8)))
        x = g.close.where(keep)
        return pd.DataFrame({
            "e": x.ewm(span=10, adjust=False, min_periods=10).mean(),
            "w": g.close.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(),
            "fast": g.close.ewm(alpha=0.9, adjust=False).mean(),
            "own": g.close.where(np.arange(len(g)) >= 2)})

    want = per_symbol(walk, want_of)
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-11, err_msg=c)


def test_flat_series_stays_flat(spark):
    flat = spark.range(300).selectExpr("'F' AS symbol", "timestamp_seconds(id * 86400) AS ts", "101.37D AS close")
    for block in BLOCKS:
        s = layout.lay_out(flat, ("symbol",), block=block)
        s = smooth(s, {"a": Smooth("close", 2 / 51), "b": Smooth("close", 2 / 201)})
        assert s.core_rows().df.filter("a <> 101.37D OR b <> 101.37D").count() == 0


def wilder(x, p):
    return x.ewm(alpha=1 / p, adjust=False, min_periods=p).mean()


@pytest.mark.parametrize("block", BLOCKS)
def test_indicators_match_pandas(walk_df, walk, block):
    base = layout.lay_out(walk_df, ("symbol",), halo=40, block=block)
    base = base.using(base.df.persist())
    windows = ind.realized_volatility(ind.rolling_zscore(ind.returns(ind.true_range(ind.sma(base, 20))), 15))
    windows = ind.donchian_channels(ind.bollinger_bands(windows))
    cols = ["sma", "true_range", "bb_lower", "bb_mid", "bb_upper", "dc_lower", "dc_mid", "dc_upper", "zscore", "rvol",
            "log_ret", "simple_ret", "diff"]
    got = collect(windows, *cols)
    for name, make in (("ema", lambda s: ind.ema(s, 21)), ("atr", ind.atr), ("rsi", ind.rsi), ("adx", ind.adx)):
        got[name] = collect(make(base), name)[name]

    def want_of(g):
        h, l, c = g.high, g.low, g.close
        pc = c.shift(1)
        tr = pd.concat([h - l, (h - pc).abs(), (l - pc).abs()], axis=1).max(axis=1)
        up, dn, d = h.diff(), -l.diff(), c.diff()
        plus = (up.where((up > dn) & (up > 0), 0.0)).where(up.notna())
        minus = (dn.where((dn > up) & (dn > 0), 0.0)).where(dn.notna())
        atr = wilder(tr, 14)
        pdi = 100 * plus.ewm(alpha=1 / 14, adjust=False).mean() / atr
        mdi = 100 * minus.ewm(alpha=1 / 14, adjust=False).mean() / atr
        dx = 100 * (pdi - mdi).abs() / (pdi + mdi).replace(0, np.nan)
        mid, sd = c.rolling(20).mean(), c.rolling(20).std(ddof=0)
        gain, loss = wilder(d.clip(lower=0), 14), wilder(-d.clip(upper=0), 14)
        return pd.DataFrame({
            "ema": c.ewm(span=21, adjust=False, min_periods=21).mean(), "sma": mid, "true_range": tr, "atr": atr,
            "rsi": 100 - 100 / (1 + gain / loss), "adx": wilder(dx, 14),
            "bb_lower": mid - 2 * sd, "bb_mid": mid, "bb_upper": mid + 2 * sd,
            "dc_lower": l.rolling(20).min(), "dc_mid": (l.rolling(20).min() + h.rolling(20).max()) / 2,
            "dc_upper": h.rolling(20).max(),
            "zscore": (c - c.rolling(15).mean()) / c.rolling(15).std(ddof=0),
            "rvol": np.log(c / pc).rolling(20).std(ddof=0) * np.sqrt(365),
            "log_ret": np.log(c / pc), "simple_ret": c / pc - 1, "diff": d})

    want = per_symbol(walk, want_of)
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-8, atol=1e-9, err_msg=c)


def test_rsi_edges(spark):
    up = spark.range(59).selectExpr("'U' AS symbol", "timestamp_seconds(id * 86400) AS ts", "id + 1D AS close",
                                    "id + 1D AS high", "id + 1D AS low")
    s = ind.rsi(layout.lay_out(up, ("symbol",)))
    rows = s.select("bar_no", "rsi").orderBy("bar_no").collect()
    assert all(r.rsi is None for r in rows[:14]) and all(r.rsi > 95 for r in rows[14:])


@pytest.mark.parametrize("block", BLOCKS)
def test_null_keys_times_and_steps_keep_their_rows(walk_df, block):
    rows = walk_df.withColumns({"symbol": F.when(F.col("symbol") != "S1", F.col("symbol")),
                                "ts": F.when(F.dayofmonth("ts") != 3, F.col("ts"))}).withColumn("n", F.row_number().over(
                                    Window.orderBy("symbol", "ts", "close")))
    n = rows.count()
    for step in (86400, F.lit(None).cast("int")):
        s = layout.lay_out(rows, ("symbol",), step_seconds=step, block=block)
        s = layout.running(s, {"seen": ("count", F.lit(1))})
        got = s.select("n", "bar_no", "seen").toPandas()
        assert len(got) == n and got.n.nunique() == n
        assert (got.bar_no + 1 == got.seen).all()


def test_a_frame_longer_than_the_copied_tail_raises(walk_df):
    with pytest.raises(ValueError, match="halo"):
        ind.sma(layout.lay_out(walk_df, ("symbol",), halo=64, block=256), 200)
    with pytest.raises(ValueError, match="halo"):
        ind.returns(layout.lay_out(walk_df, ("symbol",), block=256))
