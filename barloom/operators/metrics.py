"""Performance metrics per run, as one aggregation over the equity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import bars_per_year
from barloom.operators import layout
from barloom.operators.layout import Series

METRICS = ("cagr", "sharpe", "sortino", "calmar", "max_drawdown", "volatility", "total_return", "win_rate",
           "profit_factor", "avg_trade", "expectancy", "n_trades")

# --- fixed values: row labels and number formats of the printed table ---------
LABELS = (("CAGR", "cagr", "%"), ("Total Return", "total_return", "%"), ("Sharpe", "sharpe", "f"),
          ("Sortino", "sortino", "f"), ("Calmar", "calmar", "f"), ("Max Drawdown", "max_drawdown", "%"),
          ("Volatility (ann.)", "volatility", "%"), ("Win Rate", "win_rate", "%"),
          ("Profit Factor", "profit_factor", "f"), ("Avg Trade", "avg_trade", "f"),
          ("Expectancy", "expectancy", "f"), ("# Trades", "n_trades", "d"))
# -----------------------------------------------------------------------------


def drawdown(series: Series, source: str = "equity") -> Series:
    """Running peak and the fall from it: adds ``peak`` and ``drawdown``."""
    s = layout.running(series, {"peak": ("max", F.col(source))})
    return s.with_columns({"drawdown": F.col(source) / F.nullif(F.col("peak"), F.lit(0.0)) - 1.0})


def regime_drawdowns(series: Series, regime: str, source: str = "equity") -> DataFrame:
    """(keys, regime, max_drawdown): the deepest fall inside any unbroken stretch of a regime.

    A stretch is numbered by the changes up to it, also across blocks, and its peak
    starts anew with it. Rows without regime form stretches of their own (NULL).
    """
    s = layout.previous(series, {"_was": regime})
    change = (~F.col(regime).eqNullSafe(F.col("_was"))).cast("long")
    s = layout.settle(layout.running(s, {"_stretch": ("sum", change)}))
    s = drawdown(s.using(s.df, "_stretch"), source)
    return s.df.groupBy(*series.keys, F.col(regime).alias("regime")).agg(F.min("drawdown").alias("max_drawdown"))


def compounded(series: Series, source: str = "ret", out: str = "growth") -> Series:
    """Running product of 1 + x per key, for any x: signs and zeros are counted apart."""
    factor = 1.0 + F.coalesce(F.col(source), F.lit(0.0))
    s = layout.running(series, {
        "_ln": ("sum", F.when(factor != 0, F.ln(F.abs(factor))).otherwise(0.0)),
        "_neg": ("sum", F.when(factor < 0, 1).otherwise(0)),
        "_zero": ("sum", F.when(factor == 0, 1).otherwise(0)),
    })
    product = F.exp("_ln") * F.when(F.col("_neg") % 2 == 0, 1.0).otherwise(-1.0)
    s = s.with_columns({out: F.when(F.col("_zero") > 0, 0.0).otherwise(product)})
    return s.using(s.df.drop("_ln", "_neg", "_zero"))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def trade_aggregates(pnl: Column) -> list[Column]:
    win, loss = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    return [F.count(pnl).alias("_n"), F.count(win).alias("_nw"), F.sum(win).alias("_sw"), F.sum(loss).alias("_sl"),
            F.avg(pnl).alias("_ap"), F.avg(win).alias("_aw"), F.avg(loss).alias("_al")]


def trade_metrics() -> dict[str, Column]:
    """Metrics from :func:`trade_aggregates`; a zero pnl is neither a win nor a loss."""
    share = F.col("_nw") / F.nullif(F.col("_n"), F.lit(0))
    won, lost = _or_zero(F.col("_sw")), -_or_zero(F.col("_sl"))
    return {
        "win_rate": _or_zero(share),
        "profit_factor": F.when(lost > 0, won / F.nullif(lost, F.lit(0.0)))
        .when(won > 0, F.lit(float("inf"))).otherwise(0.0),
        "avg_trade": _or_zero(F.col("_ap")),
        "expectancy": _or_zero(share * _or_zero(F.col("_aw")) + (1 - share) * _or_zero(F.col("_al"))),
        "n_trades": F.col("_n"),
    }


def equity_aggregates(equity: Column, ret: Column, dd: Column, order: Column, rf: float, ann: Column) -> list[Column]:
    return [
        F.count(equity).alias("_rows"), F.min_by(equity, order).alias("_first"), F.max_by(equity, order).alias("_last"),
        F.min(dd).alias("_mdd"), F.count(ret).alias("_nr"), F.avg(ret - rf / ann).alias("_mean"),
        F.stddev_pop(ret).alias("_std"), F.stddev_pop(F.when(ret < 0, ret)).alias("_down"),
        F.max(ann).alias("_ann"),
    ]


def equity_metrics() -> dict[str, Column]:
    growth = F.col("_last") / F.nullif(F.col("_first"), F.lit(0.0))
    cagr = (F.when((F.col("_rows") < 2) | (F.col("_first") <= 0), 0.0)
            .when(growth <= 0, -1.0)
            .otherwise(F.pow(growth, F.col("_ann") / F.nullif(F.col("_rows") - 1, F.lit(0))) - 1.0))
    ratio = lambda spread: F.when(
        (F.col("_nr") >= 2) & (spread > 0), F.col("_mean") / F.nullif(spread, F.lit(0.0)) * F.sqrt("_ann")).otherwise(0.0)
    mdd = _or_zero(F.col("_mdd"))
    return {
        "cagr": cagr,
        "sharpe": ratio(F.col("_std")),
        "sortino": ratio(F.col("_down")),
        "calmar": F.when(mdd == 0, 0.0).otherwise(cagr / F.nullif(F.abs(mdd), F.lit(0.0))),
        "max_drawdown": mdd,
        "volatility": F.when(F.col("_nr") > 1, F.col("_std") * F.sqrt("_ann")).otherwise(0.0),
        "total_return": F.when(F.col("_rows") >= 2, growth - 1.0).otherwise(0.0),
    }


def summarize(series: Series, timeframe: str | Column = "1d", by: list[str] | None = None, rf: float = 0.0) -> DataFrame:
    """The twelve metrics per run from rows with equity, ret and (where a trade is booked) pnl.

    One pass over the equity rows; runs without trades keep zeros. Rows that bring
    their drawdown (`trades.backtest`) are not ordered again, so only sums of runs
    are shuffled. A series of short runs straight from there brings these sums.
    """
    keys = by or list(series.keys)
    if series.made is not None and isinstance(timeframe, str) and set(keys) == set(series.keys):
        ann = bars_per_year(timeframe)
        sums = series.made.df.withColumn("_ann", ann).withColumn("_mean", F.col("_mean") - rf / F.col("_ann"))
        values = {**equity_metrics(), **trade_metrics()}
        return sums.select(*keys, *[values[m].alias(m) for m in METRICS])
    s = series.with_columns({"_ann_in": bars_per_year(timeframe)})
    s = s.core_rows() if "drawdown" in s.df.columns else drawdown(s)
    pnl = F.col("pnl") if "pnl" in s.df.columns else F.lit(None).cast("double")
    grouped = s.df.groupBy(*keys).agg(
        *equity_aggregates(F.col("equity"), F.col("ret"), F.col("drawdown"), F.col("bar_no"), rf, F.col("_ann_in")),
        *trade_aggregates(pnl))
    values = {**equity_metrics(), **trade_metrics()}
    return grouped.select(*keys, *[values[m].alias(m) for m in METRICS])


def metrics_table(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Long form with printed values: (keys, line, metric, value)."""
    rows = []
    for i, (label, column, kind) in enumerate(LABELS):
        c = F.col(column)
        if kind == "d":
            text = c.cast("string")
        else:
            shown = F.format_string("%.2f%%", c * 100) if kind == "%" else F.format_string("%.2f", c)
            text = F.when(c == F.lit(float("inf")), "inf").otherwise(shown)
        rows.append(F.struct(F.lit(i).alias("line"), F.lit(label).alias("metric"), text.alias("value")))
    return metrics.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")
