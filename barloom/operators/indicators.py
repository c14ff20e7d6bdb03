"""Technical indicators: each adds columns to a :class:`~barloom.operators.layout.Series`.

``min_periods`` equals the window everywhere: a value appears once the frame
holds that many non-null inputs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barloom.operators.layout import Series
from barloom.operators.smoothing import Smooth, smooth, span_alpha, wilder_alpha


def framed(series: Series, n: int, value: Column, source: Column) -> Column:
    """A frame aggregate that is NULL until the frame holds n values of ``source``."""
    return F.when(F.count(source).over(series.rows(n)) == n, value)


def sma_of(series: Series, source: str, n: int) -> Column:
    return framed(series, n, F.avg(source).over(series.rows(n)), F.col(source))


def stddev_of(series: Series, source: str, n: int) -> Column:
    return framed(series, n, F.stddev_pop(source).over(series.rows(n)), F.col(source))


def highest_of(series: Series, source: str, n: int) -> Column:
    return framed(series, n, F.max(source).over(series.rows(n)), F.col(source))


def lowest_of(series: Series, source: str, n: int) -> Column:
    return framed(series, n, F.min(source).over(series.rows(n)), F.col(source))


#: Width of a range frame in scaled bar numbers; lengths up to 2 ** 20 fit.
_SCALE = 1 << 40
_STATISTIC = {"max": F.max, "min": F.min, "avg": F.avg, "std": F.stddev_pop}


@dataclass(frozen=True)
class Rolling:
    """A statistic (max, min, avg, std) of the last rows of a column, the current row included or, if ``prior``, left out."""

    kind: str
    source: str
    prior: bool = False

    def over(self, series: Series, n: int) -> Column:
        """Over ``n`` rows; NULL where fewer values are known."""
        series.need(n if self.prior else n - 1)
        frame = series.order().rowsBetween(-n, -1) if self.prior else series.rows(n)
        return F.when(F.count(self.source).over(frame) == n, _STATISTIC[self.kind](self.source).over(frame))


def rolling_by(series: Series, columns: dict[str, tuple[Rolling, Column]]) -> Series:
    """Rolling statistics whose length is a column, constant in every group: one frame for all lengths.

    Bar numbers are scaled by the length, so that a range frame of one fixed width
    holds exactly that many rows. The plan does not grow with the number of
    lengths, which may come from a table. The rows that the longest one reaches back
    must have been laid out (`Series.need`).
    """
    prior = {f"_prior_{r.source}": F.lag(r.source).over(series.order()) for r, _ in columns.values() if r.prior}
    s = series.with_columns(prior) if prior else series
    place = (F.col("bar_no") - F.col("blk") * s.block).cast("long")
    made = {}
    for name, (rolling, length) in columns.items():
        source = f"_prior_{rolling.source}" if rolling.prior else rolling.source
        step = (F.floor(F.lit(_SCALE) / length) + 1).cast("long")
        frame = Window.partitionBy(*s.group).orderBy(place * step).rangeBetween(-_SCALE, 0)
        made[name] = F.when(F.count(source).over(frame) == length, _STATISTIC[rolling.kind](source).over(frame))
    s = s.with_columns(made)
    return s.using(s.df.drop(*prior))


def before(series: Series, column: str | Column) -> Column:
    series.need(1)
    return F.lag(column).over(series.order())


def sma(series: Series, n: int, source: str = "close", out: str = "sma") -> Series:
    return series.with_columns({out: sma_of(series, source, n)})


def ema(series: Series, span: int, source: str = "close", out: str = "ema") -> Series:
    return smooth(series, {out: Smooth(source, span_alpha(span), span)})


def true_range_of(series: Series) -> Column:
    prior = before(series, "close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))


def true_range(series: Series, out: str = "true_range") -> Series:
    return series.with_columns({out: true_range_of(series)})


def atr(series: Series, period: int = 14, out: str = "atr") -> Series:
    s = true_range(series, "_tr")
    s = smooth(s, {out: Smooth("_tr", wilder_alpha(period), period)})
    return s.using(s.df.drop("_tr"))


def moves(series: Series) -> Series:
    """Gain and loss of the close, and the directional moves, against the row before.

    On the first row the price moves are missing, the directional moves too.
    """
    change = F.col("close") - before(series, "close")
    up = F.col("high") - before(series, "high")
    down = before(series, "low") - F.col("low")
    return series.with_columns({
        "_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
        "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
        "_plus": F.when(up.isNotNull() & down.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
        "_minus": F.when(up.isNotNull() & down.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
    })


MOVES = ("_gain", "_loss", "_plus", "_minus")


def rsi_from(avg_gain: Column, avg_loss: Column) -> Column:
    """No losses: 100 (also when there are no gains).  No gains: 0."""
    return (F.when(avg_gain.isNull() | avg_loss.isNull(), None)
            .when(avg_loss == 0, 100.0)
            .when(avg_gain == 0, 0.0)
            .otherwise(100.0 - 100.0 / (1.0 + avg_gain / avg_loss)))


def rsi(series: Series, period: int = 14, out: str = "rsi") -> Series:
    s = moves(series)
    a = wilder_alpha(period)
    s = smooth(s, {"_ag": Smooth("_gain", a, period), "_al": Smooth("_loss", a, period)})
    s = s.with_columns({out: rsi_from(F.col("_ag"), F.col("_al"))})
    return s.using(s.df.drop(*MOVES, "_ag", "_al"))


def bollinger_bands(series: Series, n: int = 20, n_std: float = 2.0, source: str = "close") -> Series:
    mid, std = sma_of(series, source, n), stddev_of(series, source, n)
    return series.with_columns({"bb_lower": mid - n_std * std, "bb_mid": mid, "bb_upper": mid + n_std * std})


def donchian_channels(series: Series, n: int = 20) -> Series:
    up, low = highest_of(series, "high", n), lowest_of(series, "low", n)
    return series.with_columns({"dc_lower": low, "dc_mid": (up + low) / 2.0, "dc_upper": up})


def rolling_zscore(series: Series, n: int, source: str = "close", out: str = "zscore") -> Series:
    spread = F.nullif(stddev_of(series, source, n), F.lit(0.0))
    return series.with_columns({out: (F.col(source) - sma_of(series, source, n)) / spread})


def dx_from(plus: Column, minus: Column, true_range_avg: Column) -> Column:
    base = F.nullif(true_range_avg, F.lit(0.0))
    plus_di, minus_di = 100 * (plus / base), 100 * (minus / base)
    return 100 * F.abs(plus_di - minus_di) / F.nullif(plus_di + minus_di, F.lit(0.0))


def adx(series: Series, period: int = 14, out: str = "adx") -> Series:
    s = true_range(moves(series), "_tr")
    a = wilder_alpha(period)
    s = smooth(s, {"_atr": Smooth("_tr", a, period), "_sp": Smooth("_plus", a), "_sm": Smooth("_minus", a)})
    s = s.with_columns({"_dx": dx_from(F.col("_sp"), F.col("_sm"), F.col("_atr"))})
    s = smooth(s, {out: Smooth("_dx", a, period)})
    return s.using(s.df.drop(*MOVES, "_tr", "_atr", "_sp", "_sm", "_dx"))


def log_return_of(series: Series, source: str = "close") -> Column:
    """ln(x / previous); NULL where either price is not positive."""
    prior = before(series, source)
    return F.when((F.col(source) > 0) & (prior > 0), F.ln(F.col(source) / prior))


def realized_volatility(series: Series, n: int = 20, periods_per_year: int = 365, out: str = "rvol") -> Series:
    s = series.with_columns({"_lr": log_return_of(series)})
    s = s.with_columns({out: stddev_of(s, "_lr", n) * math.sqrt(periods_per_year)})
    return s.using(s.df.drop("_lr"))


def returns(series: Series, source: str = "close") -> Series:
    prior = before(series, source)
    return series.with_columns({
        "log_ret": log_return_of(series, source),
        "simple_ret": F.col(source) / F.nullif(prior, F.lit(0.0)) - 1.0,
        "diff": F.col(source) - prior,
    })


def volume_filter(series: Series, n: int = 20, mult: float = 1.2, out: str = "vol_ok") -> Series:
    return series.with_columns({out: F.coalesce(F.col("volume") > mult * sma_of(series, "volume", n), F.lit(False))})


def crossed(series: Series, condition: str) -> tuple[Column, Column]:
    """(became true, became false) of a non-null boolean column; before the start it was false."""
    was = F.coalesce(before(series, condition), F.lit(False))
    return F.col(condition) & ~was, ~F.col(condition) & was
