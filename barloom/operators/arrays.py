"""Row frames and smoothings of whole short series as arrays.

Many series lie one behind the other in each array; a missing value is NaN. What a
task computes here is what `indicators` and `smoothing` compute in SQL: the values of
a frame are added in the same order, and a smoothing steps from bar to bar, for all
series at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def gathered(batches: Iterator[pa.RecordBatch], place: str, least: int) -> Iterator[pa.Table]:
    """Whole series, ``least`` rows of them or more at a time: ``place`` counts their rows from 1, and a batch may end inside one."""
    waiting, rows = [], 0
    for batch in batches:
        starts = np.flatnonzero(batch.column(place).to_numpy() == 1)
        if rows >= least and len(starts):
            if starts[0]:
                waiting.append(batch.slice(0, starts[0]))
            yield pa.Table.from_batches(waiting).combine_chunks()
            batch = batch.slice(starts[0])
            waiting, rows = [], 0
        waiting.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(waiting).combine_chunks()


def spans(values: np.ndarray, extreme, levels: int | None = None) -> list[np.ndarray]:
    """Extremes of all stretches of 1, 2, 4, ... values, at most ``levels`` tables."""
    table = [values]
    while 2 * (width := 1 << (len(table) - 1)) <= len(values) and len(table) != levels:
        table.append(extreme(table[-1][:-width], table[-1][width:]))
    return table


class Bars:
    """Columns of series of ``sizes`` rows each; frames and smoothings are made once per length."""

    def __init__(self, columns: dict[str, np.ndarray], sizes: np.ndarray):
        self.columns, self.sizes = columns, sizes
        self.first = np.cumsum(sizes) - sizes
        self.run = np.repeat(np.arange(len(sizes)), sizes)
        self.size = int(sizes.sum())
        self.place = np.arange(self.size) - self.first[self.run]
        self.longest = int(sizes.max()) if len(sizes) else 0
        self.known: dict = {}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def of(self, value):
        """A parameter of the series (a number, or one per series) as one for their rows."""
        return value[self.run] if isinstance(value, np.ndarray) else value

    def before(self, name: str) -> np.ndarray:
        out = np.full(self.size, np.nan)
        out[1:] = self[name][:-1]
        out[self.first] = np.nan
        return out

    def was(self, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The flag of the row before, and whether there is one."""
        out = np.zeros(self.size, bool)
        out[1:] = flag[:-1]
        out[self.first] = False
        return out, self.place > 0

    def inputs(self) -> None:
        """True range, moves and log returns, as columns."""
        if "_lr" in self.columns:
            return
        self.true_range()
        close, prior = self["close"], self.before("close")
        change, up, down = close - prior, self["high"] - self.before("high"), self.before("low") - self["low"]
        known = ~np.isnan(up) & ~np.isnan(down)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.columns |= {
                "_gain": np.maximum(change, 0.0), "_loss": np.maximum(-change, 0.0),
                "_plus": np.where(known, np.where((up > down) & (up > 0), up, 0.0), np.nan),
                "_minus": np.where(known, np.where((down > up) & (down > 0), down, 0.0), np.nan),
                "_lr": np.where((close > 0) & (prior > 0), np.log(close / prior), np.nan)}

    def true_range(self) -> np.ndarray:
        if "_tr" not in self.columns:
            prior, high, low = self.before("close"), self["high"], self["low"]
            self.columns["_tr"] = np.fmax(np.fmax(high - low, np.abs(high - prior)), np.abs(low - prior))
        return self.columns["_tr"]

    def rolling(self, kind: str, source: str, n, prior: bool = False) -> np.ndarray:
        """max, min, avg or std of ``n`` rows up to each (``prior``: up to the one before); NaN where fewer values are known."""
        if isinstance(n, np.ndarray):  # a length per series
            out = np.full(self.size, np.nan)
            for length in np.unique(n):
                mine = self.of(n == length)
                out[mine] = self.rolling(kind, source, int(length), prior)[mine]
            return out
        key = (kind, source, n, prior)
        if key not in self.known:
            self.known[key] = self._rolled(kind, source, n, prior)
        return self.known[key]

    def _rolled(self, kind: str, source: str, n: int, prior: bool) -> np.ndarray:
        out, values = np.full(self.size, np.nan), self[source]
        if 1 <= n <= self.size:
            ends = self.size - n + 1
            if kind == "std":
                mean, square = np.zeros(ends), np.zeros(ends)
                for k in range(n):
                    off = values[k:ends + k] - mean
                    step = off / (k + 1)
                    mean += step
                    square += off * (off - step)
                made = np.sqrt(square / n)
            elif kind == "avg":
                made = values[:ends].copy()
                for k in range(1, n):
                    made += values[k:ends + k]
                made /= n
            else:
                extreme = {"max": np.maximum, "min": np.minimum}[kind]  # NaN if any value is
                if (kind, source) not in self.known:
                    self.known[kind, source] = spans(values, extreme, max(1, self.longest.bit_length()))
                table = self.known[kind, source]
                if n > self.longest:
                    return out
                k = n.bit_length() - 1
                made = extreme(table[k][:ends], table[k][n - (1 << k):n - (1 << k) + ends])
            if prior:
                out[n:] = made[:-1]
            else:
                out[n - 1:] = made
        out[self.place < (n if prior else n - 1)] = np.nan
        return out

    def smoothed(self, source: str, alpha, needs) -> np.ndarray:
        """Exponential smoothing by weight ``alpha`` (a number, or one per series), NaN before ``needs`` values are known."""
        plain = not isinstance(alpha, np.ndarray) and not isinstance(needs, np.ndarray)
        if plain and (source, alpha, needs) in self.known:
            return self.known[source, alpha, needs]
        x = np.full((self.longest, len(self.sizes)), np.nan)
        x[self.place, self.run] = self[source]
        y = np.empty_like(x)
        seen = np.zeros(len(self.sizes), np.int64)
        count = np.empty(x.shape, np.int64)
        now, gap = np.full(len(self.sizes), np.nan), np.zeros(len(self.sizes))
        alpha = np.broadcast_to(np.asarray(alpha, float), now.shape)
        there = ~np.isnan(x)
        for t in range(len(x)):
            here = there[t]
            if t and here.all() and not gap.any() and seen.all():
                now = np.where(alpha >= 1, x[t], now + alpha * (x[t] - now))
                seen = seen + 1
            else:
                old = (1 - alpha) ** (gap + 1)
                with np.errstate(invalid="ignore"):
                    later = np.where(alpha >= 1, x[t], now + alpha / (old + alpha) * (x[t] - now))
                now = np.where(here, np.where(seen > 0, later, x[t]), now)
                seen = seen + here
                gap = np.where(here | (seen == 0), 0, gap + 1)
            y[t], count[t] = now, seen
        y[count < needs] = np.nan
        out = y[self.place, self.run]
        if plain:
            self.known[source, float(alpha[0]) if len(alpha) else 0.0, needs] = out
        return out
