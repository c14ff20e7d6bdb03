"""Portfolio risk over equity snapshots: baselines, drawdown, kill switch, entry decision."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import layout
from barloom.operators.layout import Series


@dataclass(frozen=True)
class Limits:
    max_positions: int = 5
    daily_loss: float = 0.03
    weekly_loss: float = 0.08
    kill_drawdown: float = 0.20


def _iso_week(ts: str) -> Column:
    """Year and week together; the year is the one of the week's Thursday."""
    thursday = F.date_add(F.date_trunc("week", ts).cast("date"), 3)
    return F.year(thursday) * 100 + F.weekofyear(F.col(ts))


def risk_state(series: Series, initial: float | Column, limits: Limits = Limits(), reset: str | None = None) -> Series:
    """Adds day_start, week_start, peak, drawdown, daily_pnl, weekly_pnl and kill_switch.

    A period starts from the equity before its first snapshot.  The kill switch
    stays on until a row whose ``reset`` flag is set; that reset takes effect
    behind the row and restarts the peak from its equity.
    """
    start = F.lit(initial).cast("double") if isinstance(initial, (int, float)) else initial
    s = layout.previous(series, {"_pe": "equity", "_pt": "ts"})
    base = F.coalesce(F.col("_pe"), start)
    fresh = F.col("_pt").isNull()
    new_day = fresh | (F.col("_pt").cast("date") != F.col("ts").cast("date"))
    new_week = fresh | (_iso_week("_pt") != _iso_week("ts"))
    flag = F.coalesce(F.col(reset), F.lit(False)).cast("int") if reset else F.lit(0)
    s = layout.running(s, {
        "day_start": ("last", F.when(new_day, base)), "week_start": ("last", F.when(new_week, base)),
        "_resets": ("sum", flag)})
    s = s.with_columns({"_epoch": F.col("_resets") - flag})
    s = layout.previous(s, {"_pepoch": "_epoch"})
    opens = F.col("_pepoch").isNull() | (F.col("_pepoch") != F.col("_epoch"))
    epochs = replace(s, keys=(*s.keys, "_epoch"))
    epochs = layout.running(epochs, {"peak": ("max", F.greatest(F.col("equity"), F.when(opens, base)))})
    ratio = lambda value, over: F.when(over > 0, value / F.nullif(over, F.lit(0.0)) - 1.0).otherwise(0.0)
    epochs = epochs.with_columns({
        "drawdown": ratio(F.col("equity"), F.col("peak")),
        "daily_pnl": ratio(F.col("equity"), F.col("day_start")),
        "weekly_pnl": ratio(F.col("equity"), F.col("week_start")),
    })
    epochs = layout.running(epochs, {"_tripped": ("max", (F.col("drawdown") <= -limits.kill_drawdown).cast("int"))})
    out = epochs.df.withColumn("kill_switch", F.col("_tripped") > 0)
    return replace(s, df=out.drop("_pe", "_pt", "_resets", "_epoch", "_pepoch", "_tripped"))


def entry_reason(limits: Limits = Limits(), positions: str = "n_open") -> Column:
    """The first limit that blocks an entry, or ``ok``."""
    return (F.when(F.col("kill_switch"), "kill_switch_active")
            .when(F.col("drawdown") <= -limits.kill_drawdown, "kill_switch_drawdown_breach")
            .when(F.col(positions) >= limits.max_positions, "max_concurrent_positions")
            .when(F.col("daily_pnl") <= -limits.daily_loss, "daily_loss_limit")
            .when(F.col("weekly_pnl") <= -limits.weekly_loss, "weekly_loss_limit")
            .otherwise("ok"))


def entry_decisions(series: Series, limits: Limits = Limits(), positions: str = "n_open") -> Series:
    return series.with_columns({"reason": entry_reason(limits, positions)}).with_columns(
        {"allowed": F.col("reason") == "ok"})


def alerts(state: DataFrame, keys: list[str], drawdown: float = 0.12, daily: float = 0.02,
           orders: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """Alert rows (subject, ts, kind): deep drawdown, daily loss, rejected orders, data gaps."""
    subject = F.concat_ws("/", *keys)
    out = state.filter(F.col("drawdown") < -drawdown).select(subject.alias("subject"), "ts", F.lit("drawdown").alias("kind"))
    out = out.unionByName(state.filter(F.col("daily_pnl") < -daily).select(
        subject.alias("subject"), "ts", F.lit("daily_loss").alias("kind")))
    if orders is not None:
        out = out.unionByName(orders.filter(F.col("status") == "rejected").select(
            "subject", "ts", F.lit("rejected_order").alias("kind")))
    if gaps is not None:
        out = out.unionByName(gaps.select(F.col("symbol").alias("subject"), F.col("gap_end").alias("ts"),
                                          F.lit("data_gap").alias("kind")))
    return out
