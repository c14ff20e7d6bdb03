"""Column functions without state: symbols, timeframes, times, sizes."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.schemas import BARS_PER_YEAR, DEFAULT_BARS_PER_YEAR, TIMEFRAME_SECONDS

RISK_FLOOR, RISK_CAP = 0.005, 0.01


def coin_of(symbol: Column) -> Column:
    """'BTC/USDT' and 'btc-perp' are both BTC."""
    return F.upper(F.split_part(F.split_part(symbol, F.lit("/"), F.lit(1)), F.lit("-"), F.lit(1)))


def _lookup(timeframe: str | Column, values: dict[str, int], default: int | None) -> Column:
    if isinstance(timeframe, str):
        return F.lit(values.get(timeframe, default))
    pairs = F.create_map(*[F.lit(x) for item in values.items() for x in item])
    found = F.try_element_at(pairs, timeframe)
    return found if default is None else F.coalesce(found, F.lit(default))


def bars_per_year(timeframe: str | Column) -> Column:
    """Bars of a 24/7 year; unknown timeframes count as daily."""
    return _lookup(timeframe, BARS_PER_YEAR, DEFAULT_BARS_PER_YEAR).cast("double")


def timeframe_seconds(timeframe: str | Column) -> Column:
    return _lookup(timeframe, TIMEFRAME_SECONDS, None).cast("long")


def timeframe_millis(timeframe: str | Column) -> Column:
    return timeframe_seconds(timeframe) * 1000


def to_millis(value: str | int | datetime | Column) -> Column:
    """Epoch milliseconds (UTC) of a literal or of a string / timestamp column."""
    if isinstance(value, int):
        return F.lit(value).cast("long")
    if isinstance(value, datetime):
        at = value.replace(tzinfo=value.tzinfo or timezone.utc)
        return F.lit(int(at.timestamp() * 1000)).cast("long")
    column = F.lit(value) if isinstance(value, str) else value
    return F.unix_millis(column.cast("timestamp"))


def default_window(until: Column, days: int = 730) -> Column:
    """Start of the default history window, in milliseconds, for an end in milliseconds."""
    return until - F.lit(days * 86_400_000)


def clamp_risk(risk: Column) -> Column:
    return F.least(F.greatest(risk, F.lit(RISK_FLOOR)), F.lit(RISK_CAP))


def _sized(qty: Column, equity: Column, price: Column, leverage: float, fractional: bool) -> Column:
    qty = F.least(qty, equity * leverage / F.nullif(price, F.lit(0.0)))
    return qty if fractional else qty.cast("long").cast("double")


def fixed_fractional_size(
    equity: Column, entry_price: Column, stop_price: Column, risk_per_trade: Column,
    allow_fractional: bool = True, max_leverage: float = 1.0,
) -> Column:
    """struct(qty, notional, risk_cash): a stop-out loses about the risked share of equity."""
    risk_cash = equity * clamp_risk(risk_per_trade)
    per_unit = entry_price - stop_price
    raw = (F.when(per_unit > 0, risk_cash / F.nullif(per_unit, F.lit(0.0)))
           .otherwise(equity * max_leverage / F.nullif(entry_price, F.lit(0.0))))
    return _sizing(_sized(raw, equity, entry_price, max_leverage, allow_fractional), entry_price, risk_cash,
                   entry_price > 0)


def volatility_adjusted_size(
    equity: Column, entry_price: Column, atr: Column, risk_per_trade: Column, atr_stop_mult: float = 3.0,
    allow_fractional: bool = True, max_leverage: float = 1.0,
) -> Column:
    """struct(qty, notional, risk_cash): a move of ``atr_stop_mult`` ATRs costs the risked share."""
    risk_cash = equity * clamp_risk(risk_per_trade)
    raw = risk_cash / F.nullif(atr_stop_mult * atr, F.lit(0.0))
    return _sizing(_sized(raw, equity, entry_price, max_leverage, allow_fractional), entry_price, risk_cash,
                   (entry_price > 0) & (atr > 0))


def _sizing(qty: Column, price: Column, risk_cash: Column, valid: Column) -> Column:
    zero = F.lit(0.0)
    held = F.when(valid, qty).otherwise(zero)
    return F.struct(held.alias("qty"), (held * price).alias("notional"),
                    F.when(valid, risk_cash).otherwise(zero).alias("risk_cash"))
