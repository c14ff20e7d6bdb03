"""From signals to trades, equity and returns.

A trade is known from its entry alone: it ends on the first bar that stops it,
reaches its target, follows an exit signal or is the last. These ends are found for
all wanted entries of a block at once, by lookups instead of a step per bar:

* the first bar whose low is at or below the entry's own stop, and the first whose
  high reaches its target, by descent in tables of running extremes (doubled spans);
* for a trailing stop, each bar's last earlier bar whose stop reaches the bar's low;
  the first bar that points at or behind the entry ends the trade;
* the next exit signal, by a pointer per bar.

An ended trade points to the next wanted entry, so the trades of a run are a chain
of pointers. Runs longer than a block are cut. For each block a summary tells, for
whatever position comes in, where it ends and what the chain leads to: the lows and
highs that could end it (running records only), the first bar that ends any
position, and, by pointer doubling, the last entry of each chain and its growth. A
pass over the summaries in block order gives each block its true start; all blocks
then emit their trades and bars at once. With fractional units the traded share of
cash does not depend on cash. With whole units it does, so there a run goes through
one task as a stream of blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import layout, signals as signal_ops
from barloom.operators.arrays import Bars, gathered, spans
from barloom.operators.layout import Series
from barloom.schemas import INITIAL_CASH
from barloom.session import cut_lineage


@dataclass(frozen=True)
class Costs:
    """Per-side costs; signals act on the next bar, entries only if ``latency_bars`` bars remain."""

    taker_fee: float = 0.0005
    slippage_bps: float = 5.0
    latency_bars: int = 1

    @property
    def slip(self) -> float:
        return self.slippage_bps / 1e4

    @property
    def latency(self) -> int:
        return max(1, int(self.latency_bars))


@dataclass(frozen=True)
class Account:
    initial_cash: float = INITIAL_CASH
    risk_per_trade: float = 0.0075
    allow_fractional: bool = True


_BARS = ["bar_no", "n_bars", "ts", "open", "high", "low", "close", "entry", "exit", "stop", "take_profit", "trail"]
_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us"),
          "boolean": pa.bool_(), "binary": pa.binary()}
_TRADE = {"entry_no": "long", "exit_no": "long", "book_no": "long", "entry_ts": "timestamp_ntz", "exit_ts": "timestamp_ntz",
          "entry_price": "double", "exit_price": "double", "qty": "double", "pnl": "double", "return": "double",
          "reason": "string", "cash_before": "double", "cash_open": "double", "cash_after": "double"}
_STATE = {"cash": "double", "ruined": "boolean", "before": "double", "held": "boolean", "entry_no": "long",
          "entry_ts": "timestamp_ntz", "entry_price": "double", "qty": "double", "level": "double", "target": "double"}
#: Place of a bar in its run, from 1, by which runs are told apart in a stream of bars.
_PLACE = "_place"
STOP, TAKE, LEAVE, END, OPEN = range(5)
_REASON = ("stop", "take_profit", "signal", "eod")


def first_from(table: list[np.ndarray], at: np.ndarray, passes) -> np.ndarray:
    """First place from ``at`` on with a value that does not pass (their number: none); ``passes(span extreme, which)``."""
    size, at = len(table[0]), at.copy()
    for k in reversed(range(len(table))):
        fits = np.flatnonzero(at + (1 << k) <= size)
        at[fits[passes(table[k][at[fits]], fits)]] += 1 << k
    return at


def last_before(table: list[np.ndarray], end: np.ndarray, passes) -> np.ndarray:
    """Last place before ``end`` with a value that does not pass (-1: none)."""
    end = end.copy()
    for k in reversed(range(len(table))):
        fits = np.flatnonzero(end >= 1 << k)
        end[fits[passes(table[k][end[fits] - (1 << k)], fits)]] -= 1 << k
    return end - 1


def span_max(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Largest value from ``first`` to ``last`` (-inf for empty spans)."""
    length = last - first + 1
    out = np.full(len(first), -np.inf)
    level = np.zeros(len(first), np.int64)
    level[length > 0] = np.frexp(length[length > 0].astype(float))[1] - 1
    for k in np.unique(level[length > 0]):
        of = np.flatnonzero((length > 0) & (level == k))
        out[of] = np.maximum(table[k][first[of]], table[k][last[of] - (1 << k) + 1])
    return out


@dataclass(frozen=True)
class Position:
    """A position that comes into a block: entered at ``entry_no``, with its stop level and target."""

    entry_no: int
    entry_ts: np.datetime64
    entry_price: float
    qty: float
    level: float
    target: float


@dataclass(frozen=True)
class State:
    """How a run stands before a block: cash (without the position), equity of the bar before, position."""

    cash: float
    before: float = np.nan
    ruined: bool = False
    position: Position | None = None


class Block:
    """The bars of one block and the ends of all its wanted entries."""

    def __init__(self, bars: pa.Table, costs: Costs, account: Account):
        column = {c: bars.column(c).to_numpy() for c in _BARS}
        self.order = None
        if np.any(np.diff(column["bar_no"]) < 0):
            self.order = np.argsort(column["bar_no"])
            column = {c: v[self.order] for c, v in column.items()}
        self.costs, self.account = costs, account
        self.no, self.ts, self.open, self.close, self.stop = (column[c] for c in ("bar_no", "ts", "open", "close", "stop"))
        n, self.size, self.trail = int(column["n_bars"][0]), len(self.no), bool(column["trail"][0])
        edge = [bars.column(c)[0].as_py() if c in bars.column_names else None for c in ("next_open", "next_ts")]
        self.next_open = np.append(self.open[1:], np.nan if edge[0] is None else edge[0])
        self.next_ts = np.append(self.ts[1:], np.datetime64("NaT") if edge[1] is None else np.datetime64(edge[1], "us"))
        self.last = int(self.no[-1]) + 1 == n
        self.lows = np.where(np.isnan(column["low"]), np.inf, column["low"])
        self.highs = np.where(np.isnan(column["high"]), -np.inf, column["high"])
        self.low_spans, self.high_spans = spans(self.lows, np.minimum), spans(self.highs, np.maximum)
        self.stop_spans = spans(np.where(np.isnan(self.stop), -np.inf, self.stop), np.maximum)
        places = np.arange(self.size)
        none = np.full(self.size + 1, self.size)
        self.leaves, self.trailed = none.copy(), none.copy()
        out = np.flatnonzero(column["exit"].astype(bool) & (self.no + 1 < n))
        self.leaves[out] = out
        self.leaves = np.minimum.accumulate(self.leaves[::-1])[::-1]
        if self.trail:
            reached = last_before(self.stop_spans, places + 1, lambda level, j: level < self.lows[j])
            hit = np.flatnonzero(reached >= 0)[::-1]
            self.trailed[reached[hit]] = hit  # the first bar that points there
            self.trailed = np.minimum.accumulate(self.trailed[::-1])[::-1]
        # Wanted entries: signal bar, price, own stop (if below the price), target, units for one of cash.
        wanted = np.flatnonzero(column["entry"].astype(bool) & (self.no + costs.latency < n))
        fill = self.next_open[wanted] * (1 + costs.slip)
        self.at, self.fill = wanted[fill > 0], fill[fill > 0]
        own = self.stop[self.at]
        self.level = np.where(own < self.fill, own, -np.inf)
        target = column["take_profit"][self.at]
        self.target = np.where(np.isnan(target), np.inf, target)
        self.units = np.minimum(account.risk_per_trade / (self.fill - self.level), 1 / self.fill)
        self.units[np.isinf(self.level)] = 1 / self.fill[np.isinf(self.level)]
        self.end, self.kind, self.reached, self.price = self.ends(self.at + 1, self.level, self.target)

    def ends(self, start: np.ndarray, level: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where positions held from ``start`` end: bar, kind, stop level then, price."""
        stopped = np.minimum(first_from(self.low_spans, start, lambda low, i: low > level[i]), self.trailed[start])
        taken = first_from(self.high_spans, start, lambda high, i: high < target[i])
        last = np.full(len(start), self.size - 1 if self.last else self.size)
        ways = np.stack([stopped, taken, self.leaves[start], last])
        kind = ways.argmin(axis=0)
        end = ways.min(axis=0)
        kind[end >= self.size] = OPEN
        if self.trail:
            level = np.maximum(level, span_max(self.stop_spans, start, np.minimum(end, self.size - 1)))
        on = np.minimum(end, self.size - 1)
        price = np.select([kind == STOP, kind == TAKE, kind == LEAVE],
                          [np.minimum(self.open[on], level), np.maximum(self.open[on], target), self.next_open[on]], self.close[on])
        return end, kind, level, price * (1 - self.costs.slip)

    def after(self, end: np.ndarray | int) -> np.ndarray | int:
        """The wanted entry that follows an end on this bar."""
        return np.searchsorted(self.at, end)

    def emit(self, state: State) -> tuple[list[dict], State]:
        """Trades that end in this block, and the state behind it."""
        fee, whole = self.costs.taker_fee, not self.account.allow_fractional
        cash, ruined, held, trades = state.cash, state.ruined, state.position, []
        following = self.after(self.end).tolist()
        ends, kinds, prices = self.end.tolist(), self.kind.tolist(), self.price.tolist()
        if held is not None:
            end, kind, reached, price = (v[0] for v in self.ends(np.array([0]), np.array([held.level]), np.array([held.target])))
            if kind == OPEN:
                return trades, self._behind(cash, ruined, replace(held, level=float(reached)))
            cash, ruined = self._close(trades, held, cash, int(end), int(kind), float(price))
            at = int(self.after(int(end)))
        else:
            at = 0
        while at < len(self.at) and not ruined:
            fill, level = float(self.fill[at]), float(self.level[at])
            if whole:
                qty = float(np.floor(min(cash * self.account.risk_per_trade / (fill - level) if np.isfinite(level) else np.inf, cash / fill)))
            else:
                qty = cash * float(self.units[at])
            if not qty > 0:
                at += 1
                continue
            i = int(self.at[at])
            held = Position(int(self.no[i]) + 1, self.next_ts[i], fill, qty, level, float(self.target[at]))
            cash -= qty * fill * (1 + fee)
            if kinds[at] == OPEN:
                return trades, self._behind(cash, ruined, replace(held, level=float(self.reached[at])))
            cash, ruined = self._close(trades, held, cash, ends[at], kinds[at], prices[at])
            at = following[at]
        return trades, self._behind(cash, ruined, None)

    def _close(self, trades: list[dict], held: Position, cash: float, end: int, kind: int, price: float) -> tuple[float, bool]:
        paid = held.qty * held.entry_price * (1 + self.costs.taker_fee)
        after = cash + held.qty * price * (1 - self.costs.taker_fee)
        leaves = kind == LEAVE
        trades.append({
            "entry_no": held.entry_no, "exit_no": int(self.no[end]) + leaves, "book_no": int(self.no[end]), "entry_ts": held.entry_ts,
            "exit_ts": self.next_ts[end] if leaves else self.ts[end], "entry_price": held.entry_price, "exit_price": price,
            "qty": held.qty, "pnl": (price - held.entry_price) * held.qty, "return": price / held.entry_price - 1.0,
            "reason": _REASON[kind], "cash_before": cash + paid, "cash_open": cash, "cash_after": after})
        return after, not after > 0

    def _behind(self, cash: float, ruined: bool, held: Position | None) -> State:
        if held is None:
            return State(cash, cash, ruined)
        if held.entry_no > int(self.no[-1]):  # enters on the next block's first bar
            return State(cash, cash + held.qty * held.entry_price * (1 + self.costs.taker_fee), ruined, held)
        return State(cash, cash + held.qty * float(self.close[-1]), ruined, held)

    def curve(self, state: State, trades: list[dict], behind: State) -> dict[str, np.ndarray]:
        """Equity, return and booked trade of every bar. A bar takes the entry on it or, if a trade ends on it, the exit."""
        cash, held = np.full(self.size, np.nan), np.full(self.size, np.nan)
        pnl, gained = np.full(self.size, np.nan), np.full(self.size, np.nan)
        first = int(self.no[0])
        came = state.position
        cash[0], held[0] = state.cash, came.qty if came else 0.0
        if came and came.entry_no >= first:
            cash[0], held[0] = state.cash, came.qty
        now = behind.position
        for t in trades:
            if t["entry_no"] >= first:
                cash[t["entry_no"] - first], held[t["entry_no"] - first] = t["cash_open"], t["qty"]
        if now and first <= now.entry_no <= int(self.no[-1]):
            cash[now.entry_no - first], held[now.entry_no - first] = behind.cash, now.qty
        for t in trades:
            at = t["book_no"] - first
            cash[at], held[at], pnl[at], gained[at] = t["cash_after"], 0.0, t["pnl"], t["return"]
        known = np.maximum.accumulate(np.where(np.isnan(cash), 0, np.arange(self.size)))
        cash, held = cash[known], held[known]
        with np.errstate(invalid="ignore", divide="ignore"):
            equity = np.where(held == 0, cash, cash + held * self.close)
            before = np.append(state.before, equity[:-1])
            ret = np.where(before == 0, np.nan, equity / before - 1.0)
            peak = np.fmax.accumulate(equity)
            drawdown = np.where(peak == 0, np.nan, equity / peak - 1.0)
        return {"equity": equity, "ret": ret, "pnl": pnl, "trade_return": gained, "drawdown": drawdown}

    def summary(self) -> bytes:
        """What a position that comes in, or none, leads to in this block; for fractional units."""
        fee, n = self.costs.taker_fee, len(self.at)
        flat, ruined = n, n + 1
        growth = np.ones(n + 2)
        growth[:n] = 1 + self.units * (self.price * (1 - fee) - self.fill * (1 + fee))
        leads = np.append(np.minimum(self.after(self.end), flat), [flat, ruined])
        still = np.flatnonzero(self.kind == OPEN)
        leads[still], growth[still] = still, 1.0
        leads[:n][(growth[:n] <= 0) & (self.kind != OPEN)] = ruined
        while True:  # each step doubles the chain that a pointer spans
            further = leads[leads]
            if np.array_equal(further, leads):
                break
            growth *= np.where(leads == np.arange(n + 2), 1.0, growth[leads])
            leads = further
        bars = min(int(self.trailed[0]), int(self.leaves[0]), self.size - 1)
        lows, highs = self.lows[:bars + 1], self.highs[:bars + 1]
        low_at = np.flatnonzero(lows < np.minimum.accumulate(np.append(np.inf, lows[:-1])))
        high_at = np.flatnonzero(highs > np.maximum.accumulate(np.append(-np.inf, highs[:-1])))
        sure, kind = min((int(self.trailed[0]), STOP), (int(self.leaves[0]), LEAVE), (self.size - 1 if self.last else self.size, END))
        ends = np.unique(np.concatenate([low_at, high_at, [sure] if sure < self.size else []])).astype(int)
        zero = np.zeros(len(ends), int)
        lead = np.minimum(self.after(ends), flat)
        used = np.unique(np.append(leads[lead], leads[0] if n else flat))
        used = used[used < n]
        opened = {int(x): (int(self.no[self.at[x]]) + 1, self.next_ts[self.at[x]], float(self.fill[x]), float(self.units[x]),
                           float(self.reached[x]), float(self.target[x])) for x in used}
        return pickle.dumps({
            "first": int(self.no[0]), "last": int(self.no[-1]), "close": float(self.close[-1]), "flat": flat, "ruined": ruined,
            "low_at": low_at, "lows": lows[low_at], "high_at": high_at, "highs": highs[high_at], "sure": (sure, kind),
            "ends": ends, "lead": leads[lead], "growth": growth[lead], "open": self.open[ends], "next_open": self.next_open[ends],
            "closes": self.close[ends], "trailing": span_max(self.stop_spans, zero, ends) if self.trail else zero - np.inf,
            "start": (int(leads[0]), float(growth[0])) if n else (flat, 1.0), "opened": opened, "size": self.size,
            "all_stops": float(self.stop_spans[0].max()) if self.trail else -np.inf})


class Runs:
    """Whole short runs, one behind the other: what `Block` finds for one, a trade of each run at a time.

    Tables of extremes span the border of two runs, but what they find behind the
    last bar of a run comes after the end there, which ends the trade.
    """

    def __init__(self, bars: Bars, signals: tuple, trail: bool, costs: Costs, account: Account):
        entry, leave, stop, target = signals
        self.bars, self.costs, self.account = bars, costs, account
        self.open, self.close, self.stop = bars["open"], bars["close"], stop
        size, run = bars.size, bars.run
        self.final = (bars.first + bars.sizes - 1)[run]
        places = np.arange(size)
        self.next_open = np.append(self.open[1:], np.nan)
        self.next_open[self.final] = np.nan
        self.lows = np.where(np.isnan(bars["low"]), np.inf, bars["low"])
        levels = max(1, bars.longest.bit_length())
        if "spans" not in bars.known:
            highs = np.where(np.isnan(bars["high"]), -np.inf, bars["high"])
            bars.known["spans"] = spans(self.lows, np.minimum, levels), spans(highs, np.maximum, levels) if target is not None else None
        self.low_spans, self.high_spans = bars.known["spans"]
        self.trail, none = trail, np.full(size + 1, size)
        self.leaves, self.trailed = none.copy(), none.copy()
        out = np.flatnonzero(leave & (places < self.final))
        self.leaves[out] = out
        self.leaves = np.minimum.accumulate(self.leaves[::-1])[::-1]
        if trail:
            self.stop_spans = spans(np.where(np.isnan(stop), -np.inf, stop), np.maximum, levels)
            reached = last_before(self.stop_spans, places + 1, lambda level, j: level < self.lows[j])
            hit = np.flatnonzero(reached >= bars.first[run])[::-1]
            self.trailed[reached[hit]] = hit
            self.trailed = np.minimum.accumulate(self.trailed[::-1])[::-1]
        wanted = np.flatnonzero(entry & (places + costs.latency <= self.final))
        fill = self.next_open[wanted] * (1 + costs.slip)
        self.at, self.fill = wanted[fill > 0], fill[fill > 0]
        own = stop[self.at]
        self.level = np.where(own < self.fill, own, -np.inf)
        self.target = np.full(len(self.at), np.inf)
        if target is not None:
            self.target = np.where(np.isnan(target[self.at]), np.inf, target[self.at])
        self.units = np.minimum(account.risk_per_trade / (self.fill - self.level), 1 / self.fill)
        self.units[np.isinf(self.level)] = 1 / self.fill[np.isinf(self.level)]
        self.end, self.kind, self.price = self._ends()

    def _ends(self) -> tuple[np.ndarray, ...]:
        start, level, target = self.at + 1, self.level, self.target
        stopped = np.minimum(first_from(self.low_spans, start, lambda low, i: low > level[i]), self.trailed[start])
        ways = [stopped, self.leaves[start], self.final[self.at]]
        order = [STOP, LEAVE, END]
        if self.high_spans is not None:
            ways.insert(1, first_from(self.high_spans, start, lambda high, i: high < target[i]))
            order.insert(1, TAKE)
        ways = np.stack(ways)
        kind, end = np.array(order)[ways.argmin(axis=0)], ways.min(axis=0)
        if self.trail:
            level = np.maximum(level, span_max(self.stop_spans, start, end))
        price = np.select([kind == STOP, kind == TAKE, kind == LEAVE],
                          [np.minimum(self.open[end], level), np.maximum(self.open[end], target), self.next_open[end]], self.close[end])
        return end, kind, price * (1 - self.costs.slip)

    def walk(self) -> dict[str, np.ndarray]:
        """The trades by run and entry: their wanted entry (``of``), qty, cash while and after."""
        fee, bars = self.costs.taker_fee, self.bars
        following = np.searchsorted(self.at, self.end)
        at, behind = np.searchsorted(self.at, bars.first), np.searchsorted(self.at, bars.first + bars.sizes)
        cash = np.full(len(bars.sizes), float(self.account.initial_cash))
        made, active = [], np.flatnonzero(at < behind)
        while len(active):
            which, now = at[active], cash[active]
            fill = self.fill[which]
            if self.account.allow_fractional:
                qty = now * self.units[which]
            else:
                level = self.level[which]
                with np.errstate(invalid="ignore"):
                    by_risk = np.where(np.isfinite(level), now * self.account.risk_per_trade / (fill - level), np.inf)
                qty = np.floor(np.minimum(by_risk, now / fill))
            goes = qty > 0
            at[active[~goes]] += 1
            run, which, qty, fill = active[goes], which[goes], qty[goes], fill[goes]
            opened = now[goes] - qty * fill * (1 + fee)
            after = opened + qty * self.price[which] * (1 - fee)
            cash[run] = after
            at[run] = np.where(after > 0, following[which], behind[run])
            made.append((which, qty, opened, after))
            active = active[at[active] < behind[active]]
        which, qty, opened, after = (np.concatenate(c) if made else np.zeros(0) for c in (zip(*made) if made else [()] * 4))
        order = np.argsort(which, kind="stable")
        return {"of": which[order].astype(np.int64), "qty": qty[order], "cash_open": opened[order], "cash_after": after[order]}

    def blotter(self, trades: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Run and columns of `_TRADE` of each trade."""
        of, qty = trades["of"], trades["qty"]
        entry, end, fill, price = self.at[of] + 1, self.end[of], self.fill[of], self.price[of]
        leaves = self.kind[of] == LEAVE
        first, ts = self.bars.first[self.bars.run[entry]], self.bars["ts"]
        return self.bars.run[entry], {
            "entry_no": entry - first, "exit_no": end - first + leaves, "book_no": end - first, "entry_ts": ts[entry],
            "exit_ts": ts[end + leaves], "entry_price": fill, "exit_price": price, "qty": qty, "pnl": (price - fill) * qty,
            "return": price / fill - 1.0, "reason": np.array(_REASON, object)[self.kind[of]],
            "cash_before": trades["cash_open"] + qty * fill * (1 + self.costs.taker_fee), "cash_open": trades["cash_open"],
            "cash_after": trades["cash_after"]}

    def curve(self, trades: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """As `Block.curve`, for all runs."""
        bars, of = self.bars, trades["of"]
        cash, held, pnl, gained = (np.full(bars.size, np.nan) for _ in range(4))
        cash[bars.first], held[bars.first] = self.account.initial_cash, 0.0
        entry, end = self.at[of] + 1, self.end[of]
        cash[entry], held[entry] = trades["cash_open"], trades["qty"]
        cash[end], held[end] = trades["cash_after"], 0.0
        pnl[end], gained[end] = (self.price[of] - self.fill[of]) * trades["qty"], self.price[of] / self.fill[of] - 1.0
        known = np.maximum.accumulate(np.where(np.isnan(cash), 0, np.arange(bars.size)))
        cash, held = cash[known], held[known]
        with np.errstate(invalid="ignore", divide="ignore"):
            equity = np.where(held == 0, cash, cash + held * self.close)
            before = np.append(np.nan, equity[:-1])
            before[bars.first] = np.nan
            ret = np.where(before == 0, np.nan, equity / before - 1.0)
            runs = np.full((len(bars.sizes), bars.longest), np.nan)
            runs[bars.run, bars.place] = equity
            peak = np.fmax.accumulate(runs, axis=1)[bars.run, bars.place]
            drawdown = np.where(peak == 0, np.nan, equity / peak - 1.0)
        return {"equity": equity, "ret": ret, "pnl": pnl, "trade_return": gained, "drawdown": drawdown}


def _per_run(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and standard deviation of the known values of each run; equal values have none, exactly."""
    known = ~np.isnan(values)
    n = np.add.reduceat(known.astype(np.int64), first)
    at = np.minimum.reduceat(np.where(known, np.arange(len(values)), len(values)), first)
    base = np.append(values, np.nan)[at]
    sizes = np.diff(np.append(first, len(values)))
    with np.errstate(invalid="ignore", divide="ignore"):
        off = np.where(known, values - np.repeat(base, sizes), 0.0)
        mean = np.add.reduceat(off, first) / n
        wide = np.where(known, off - np.repeat(mean, sizes), 0.0)
        return n, base + mean, np.sqrt(np.add.reduceat(wide * wide, first) / n)


def run_sums(curve: dict[str, np.ndarray], first: np.ndarray) -> dict[str, np.ndarray]:
    """What `metrics` adds up over the rows of a run, a row per run (NaN: nothing there)."""
    equity, ret, pnl = curve["equity"], curve["ret"], curve["pnl"]
    last = np.append(first[1:], len(equity)) - 1
    n_ret, mean, std = _per_run(ret, first)
    out = {"_rows": np.add.reduceat((~np.isnan(equity)).astype(np.int64), first), "_first": equity[first], "_last": equity[last],
           "_mdd": np.fmin.reduceat(curve["drawdown"], first), "_nr": n_ret, "_mean": mean, "_std": std,
           "_down": _per_run(np.where(ret < 0, ret, np.nan), first)[2]}
    booked = np.flatnonzero(~np.isnan(pnl))
    run, gained = np.searchsorted(first, booked, side="right") - 1, pnl[booked]
    total = lambda which: (np.bincount(run[which], minlength=len(first)), np.bincount(run[which], gained[which], len(first)))
    (n, sum_all), (wins, won), (losses, lost) = total(gained == gained), total(gained > 0), total(gained < 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out | {"_n": n, "_nw": wins, "_sw": np.where(wins > 0, won, np.nan), "_sl": np.where(losses > 0, lost, np.nan),
                      "_ap": sum_all / n, "_aw": won / wins, "_al": lost / losses}


_SUMS = {c: "long" if c in ("_rows", "_nr", "_n", "_nw") else "double" for c in (
    "_rows", "_first", "_last", "_mdd", "_nr", "_mean", "_std", "_down", "_n", "_nw", "_sw", "_sl", "_ap", "_aw", "_al")}
#: Rows of whole runs that a task walks together.
TOGETHER = 1 << 15


def _through(state: State, block: dict, costs: Costs) -> State:
    """The state behind a block, from its summary."""
    fee = costs.taker_fee
    if state.ruined:
        return replace(state, before=state.cash)
    cash = state.cash
    held = state.position
    if held is None:
        lead, growth = block["start"]
    else:
        low = np.flatnonzero(block["lows"] <= held.level)
        high = np.flatnonzero(block["highs"] >= held.target)
        end, kind = min((int(block["low_at"][low[0]]) if len(low) else block["size"], STOP),
                        (int(block["high_at"][high[0]]) if len(high) else block["size"], TAKE), block["sure"])
        if end >= block["size"]:
            return State(cash, cash + held.qty * block["close"], False, replace(held, level=max(held.level, block["all_stops"])))
        at = int(np.searchsorted(block["ends"], end))
        level = max(held.level, float(block["trailing"][at]))
        price = {STOP: min(block["open"][at], level), TAKE: max(block["open"][at], held.target),
                 LEAVE: block["next_open"][at], END: block["closes"][at]}[kind] * (1 - costs.slip)
        cash += held.qty * price * (1 - fee)
        if not cash > 0:
            return State(cash, cash, True)
        lead, growth = int(block["lead"][at]), float(block["growth"][at])
    cash *= growth
    if lead == block["ruined"]:
        return State(cash, cash, True)
    if lead == block["flat"]:
        return State(cash, cash)
    entry_no, entry_ts, fill, units, level, target = block["opened"][lead]
    qty = cash * units
    paid = cash - qty * fill * (1 + fee)
    equity = cash if entry_no > block["last"] else paid + qty * block["close"]
    return State(paid, equity, False, Position(entry_no, entry_ts, fill, qty, level, target))


def _state_row(state: State) -> dict:
    p = state.position
    row = {"cash": state.cash, "ruined": state.ruined, "before": state.before, "held": p is not None}
    return row | ({c: getattr(p, c) for c in ("entry_no", "entry_ts", "entry_price", "qty", "level", "target")} if p else {})


def _state_of(row: dict) -> State:
    held = Position(row["entry_no"], np.datetime64(row["entry_ts"], "us"), *(row[c] for c in ("entry_price", "qty", "level", "target"))) \
        if row["held"] else None
    return State(row["cash"], np.nan if row["before"] is None else row["before"], row["ruined"], held)


def _table(key: dict[str, pa.Scalar], n: int, columns: dict[str, pa.Array]) -> pa.Table:
    return pa.table({**{c: pa.repeat(v, n) for c, v in key.items()}, **columns})


def _rows(kinds: dict[str, str], rows: list[dict]) -> dict[str, pa.Array]:
    return {c: pa.array([r.get(c) for r in rows], _ARROW[kind]) for c, kind in kinds.items()}


class _Walker:
    """What tasks do with the bars of a block; sent with the job."""

    def __init__(self, group: list[str], keys: list[str], costs: Costs, account: Account, per_bar: tuple[str, ...], carry: tuple[str, ...],
                 recipe: tuple | None = None, summed: bool = False):
        self.group, self.keys, self.costs, self.account, self.per_bar, self.carry = group, keys, costs, account, per_bar, carry
        self.recipe, self.summed = recipe, summed

    def result(self, key: dict[str, pa.Scalar], bars: pa.Table, state: State) -> tuple[pa.Table, State]:
        block = Block(bars, self.costs, self.account)
        trades, behind = block.emit(state)
        if not self.per_bar:
            return _table(key, len(trades), _rows(_TRADE, trades)), behind
        kept = {c: bars.column(c) if block.order is None else bars.column(c).take(pa.array(block.order))
                for c in ("sub", "core", "bar_no", "n_bars", "ts", "close", *self.carry) if c in bars.column_names}
        made = {c: pa.array(v, from_pandas=True) for c, v in block.curve(state, trades, behind).items() if c in self.per_bar}
        return _table(key, block.size, {**kept, **made}), behind

    def whole(self, key, bars):
        return self.result(dict(zip(self.group, key)), bars, State(self.account.initial_cash))[0]

    def runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole short runs, one behind the other: a batch holds many, its last one may go on in the next."""
        for rows in gathered(batches, _PLACE, TOGETHER):
            yield from self.together(rows)

    def grouped(self, rows: pa.Table) -> pa.Table:
        """One run by itself, under all its sets."""
        rows = rows.sort_by("bar_no").append_column(_PLACE, pa.array(np.arange(1, rows.num_rows + 1), pa.int32()))
        return pa.Table.from_batches(self.together(rows, empty=True))

    def together(self, rows: pa.Table, empty: bool = False) -> Iterator[pa.RecordBatch]:
        """Rows made of whole runs that lie one behind the other."""
        rows = rows.combine_chunks()
        place = rows.column(_PLACE).to_numpy()
        first = np.flatnonzero(place == 1)
        sizes = np.diff(np.append(first, len(place)))
        known = {c: rows.column(c).to_numpy() for c in rows.column_names if c in (*_BARS, "volume")}
        bars = Bars(known, sizes)
        whole = np.array_equal(known["bar_no"], place - 1) and np.array_equal(known["n_bars"], np.repeat(sizes, sizes))
        for param_id, some, mine, (*signals, extra), trail in self.signals(rows, bars, first):
            if whole:
                runs = Runs(some, signals, trail, self.costs, self.account)
                trades = runs.walk()
                of, made = runs.blotter(trades) if not (self.per_bar or self.summed) else (some.run, None)
                curve = None if made else runs.curve(trades)
            else:
                of, made, curve = self.by_block(some, signals, trail)
            table = self.rows_of(rows, some, mine, param_id, of, made, curve, extra)
            if table.num_rows:
                yield from table.combine_chunks().to_batches()
            elif empty:
                yield from (pa.record_batch([pa.array([], f.type) for f in table.schema], table.schema),)

    def signals(self, rows: pa.Table, bars: Bars, first: np.ndarray):
        """(param_id or None, bars, their rows' places or None for all, signals, whether stops trail) of each set to walk."""
        if self.recipe is None:
            target = bars["take_profit"]
            trails = rows.column("trail").to_numpy()
            yield (None, bars, None, (bars["entry"].astype(bool), bars["exit"].astype(bool), bars["stop"],
                                      None if np.isnan(target).all() else target, {}), bool(trails[0]))
            return
        name, sets, deals = self.recipe
        strategy = signal_ops.get_strategy(name)
        if sets is None:
            at = pa.array(first)
            params = {k: rows.column(f"_p_{k}").take(at).to_numpy() for k in strategy.defaults}
            yield None, bars, None, strategy.arrays(bars, params), strategy.trail
            return
        parts = [(None, bars, None)]
        if deals > 1:
            dealt = rows.column("deal").to_numpy()
            parts = [(d, *self._part(bars, dealt, d)) for d in np.unique(dealt)]
        for deal, some, mine in parts:
            for i, params in enumerate(sets):
                if deal is None or i % deals == deal:
                    yield i, some, mine, strategy.arrays(some, params), strategy.trail

    def _part(self, bars: Bars, dealt: np.ndarray, deal: int) -> tuple[Bars, np.ndarray | None]:
        mine = np.flatnonzero(dealt == deal)
        if len(mine) == bars.size:
            return bars, None
        return Bars({c: v[mine] for c, v in bars.columns.items()}, bars.sizes[dealt[bars.first] == deal]), mine

    def by_block(self, bars: Bars, signals: tuple, trail: bool):
        """Runs that do not hold all bars they count, each by itself."""
        entry, leave, stop, target = signals
        columns = {c: pa.array(bars[c]) for c in ("bar_no", "n_bars", "ts", "open", "high", "low", "close")} | {
            "entry": pa.array(entry), "exit": pa.array(leave), "stop": pa.array(stop),
            "take_profit": pa.array(np.full(bars.size, np.nan) if target is None else target), "trail": pa.repeat(trail, bars.size)}
        table, of, trades, curves = pa.table(columns), [], [], []
        for run, (at, n) in enumerate(zip(bars.first.tolist(), bars.sizes.tolist())):
            block = Block(table.slice(at, n), self.costs, self.account)
            mine, behind = block.emit(State(self.account.initial_cash))
            trades += mine
            of += [run] * len(mine)
            curves.append(block.curve(State(self.account.initial_cash), mine, behind))
        made = None if self.per_bar or self.summed else {c: [t[c] for t in trades] for c in _TRADE}
        return (np.array(of, np.int64) if made else bars.run), made, {c: np.concatenate([x[c] for x in curves]) for c in curves[0]}

    def rows_of(self, rows, bars, mine, param_id, of, made, curve, extra) -> pa.Table:
        """The rows asked for: of trades, of bars, or of runs."""
        places = (lambda at: at) if mine is None else (lambda at: mine[at])
        if self.summed:
            columns = {c: pa.array(v, _ARROW[_SUMS[c]], from_pandas=True) for c, v in run_sums(curve, bars.first).items()}
            at = places(bars.first)
        elif made is not None:
            columns = {c: pa.array(v, _ARROW[_TRADE[c]]) for c, v in made.items()}
            at = places(bars.first[of])
        else:
            at = None if mine is None else mine
            kept = [c for c in ("bar_no", "n_bars", "ts", "close", *self.carry) if c in rows.column_names or c in extra]
            columns = {c: pa.array(extra[c]) if c in extra else rows.column(c) if at is None else rows.column(c).take(pa.array(at)) for c in kept} | {
                c: pa.array(v, from_pandas=True) for c, v in curve.items() if c in self.per_bar}
        keyed = {}
        n = len(next(iter(columns.values())))
        for c in self.keys if self.summed else self.group:
            keyed[c] = pa.repeat(pa.scalar(param_id, pa.int32()), n) if c == "param_id" and param_id is not None else (
                rows.column(c) if at is None else rows.column(c).take(pa.array(at)))
        return pa.table({**keyed, **columns})

    def from_state(self, key, bars, state):
        return self.result(dict(zip(self.group, key)), bars, _state_of(state.to_pylist()[0]))[0]

    def summary(self, key, bars):
        made = Block(bars, self.costs, self.account).summary()
        return _table(dict(zip(self.group, key)), 1, {"summary": pa.array([made], pa.binary())})

    def starts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state before every block, from summaries sorted by run and block."""
        run, state = None, None
        for batch in batches:
            rows = []
            keyed = list(zip(*(batch.column(c).to_pylist() for c in self.keys)))
            for key, made in zip(keyed, batch.column("summary")):
                if run is None or key != run:
                    run, state = key, State(self.account.initial_cash)
                rows.append(_state_row(state))
                state = _through(state, pickle.loads(made.as_py()), self.costs)
            columns = {**{c: batch.column(c) for c in self.group}, **_rows(_STATE, rows)}
            yield pa.RecordBatch.from_pydict(columns)

    def stream(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs as streams of bars sorted by run and bar: one block is held at a time."""
        run, state, waiting = None, None, []

        def done():
            nonlocal run, state, waiting
            bars, waiting = pa.concat_tables(waiting), []
            at = {c: bars.column(c)[0] for c in self.group}
            key = tuple(at[c].as_py() for c in self.keys)
            if run is None or key != run:
                run, state = key, State(self.account.initial_cash)
            table, state = self.result(at, bars, state)
            return table.combine_chunks().to_batches()

        block = None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in self.group)))
            edges = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if waiting and places[a] != block:
                    yield from done()
                block = places[a]
                waiting.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if waiting:
            yield from done()


def _inputs(signals: Series, carry: tuple[str, ...] = (), stream: bool = False) -> DataFrame:
    placed = ("blk", "sub", "core") if signals.multi else ("blk", _PLACE) if stream else ("blk",)
    if stream and not signals.multi:
        # The window brings the rows of a run together, in order, without a shuffle if they already are.
        signals = signals.with_columns({_PLACE: F.row_number().over(signals.order())})
    bars = signals.select(*placed, *_BARS, *carry).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    bars = bars.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "stop", "take_profit")})
    if not signals.multi:
        return bars  # a run is one block: no bar follows, and its places follow from the bar number
    heads = bars.filter(F.col("bar_no") % signals.block == 0).select(
        *signals.keys, (F.col("blk") - 1).alias("blk"), F.col("open").alias("next_open"), F.col("ts").alias("next_ts"))
    return layout.join_on(bars, heads, signals.group, "left")


def _recipe_inputs(recipe: signal_ops.Recipe, stream: bool, carry: tuple[str, ...]) -> DataFrame:
    """Bars of short runs, in order if they are to be walked as a stream, without signals; parameters from a table come along."""
    bars = recipe.bars.with_columns({_PLACE: F.row_number().over(recipe.bars.order())}) if stream else recipe.bars
    own = [c for c in bars.df.columns if c.startswith("_p_") or c in carry]
    rows = bars.select("blk", *([_PLACE] if stream else []), "bar_no", "n_bars", "ts", "open", "high", "low", "close", "volume", *own)
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumns(
        {c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")})


def _starts(bars: DataFrame, signals: Series, costs: Costs, account: Account) -> DataFrame:
    """State before every block of long runs with fractional units."""
    walker = _Walker(signals.group, list(signals.keys), costs, account, (), ())
    key = ", ".join(f"`{c}` {bars.schema[c].dataType.simpleString()}" for c in signals.group)
    summaries = bars.groupBy(*signals.group).applyInArrow(lambda key, bars: walker.summary(key, bars), f"{key}, summary binary")
    ordered = summaries.repartition(*signals.keys).sortWithinPartitions(*signals.group)
    return cut_lineage(ordered.mapInArrow(walker.starts, key + "".join(f", {c} {k}" for c, k in _STATE.items())))


def _walked(bars: DataFrame, starts: DataFrame | None, signals: Series, costs: Costs, account: Account, per_bar: bool,
            carry: tuple[str, ...] = (), recipe: signal_ops.Recipe | None = None, summed: bool = False) -> DataFrame:
    # A block knows the peak of its run only if it is the whole run.
    curve = ("equity", "ret", "pnl", "trade_return", *(() if signals.multi else ("drawdown",))) if per_bar else ()
    how = (recipe.strategy, recipe.sets, recipe.deals) if recipe else None
    walker = _Walker(signals.group, list(signals.keys), costs, account, curve, carry, how, summed)
    types = {c: bars.schema[c].dataType.simpleString() for c in bars.columns} | ({"param_id": "int"} if recipe and recipe.sets else {})
    types |= {c: signals.df.schema[c].dataType.simpleString() for c in carry}
    typed = lambda names: [f"`{c}` {types[c]}" for c in names]
    if summed:
        return bars.mapInArrow(walker.runs, ", ".join(typed(signals.keys) + [f"`{c}` {k}" for c, k in _SUMS.items()]))
    made = {c: "double" for c in curve} if per_bar else _TRADE
    kept = tuple(c for c in ("sub", "core", "bar_no", "n_bars", "ts", "close", *carry) if c in bars.columns or c in carry) if per_bar else ()
    schema = ", ".join(typed(signals.group) + typed(kept) + [f"`{c}` {k}" for c, k in made.items()])
    if not signals.multi:
        if _PLACE in bars.columns:
            made = bars.mapInArrow(walker.runs, schema)
        elif recipe:
            made = bars.groupBy(*recipe.bars.group).applyInArrow(lambda bars: walker.grouped(bars), schema)
        else:
            made = bars.groupBy(*signals.group).applyInArrow(lambda key, bars: walker.whole(key, bars), schema)
        return made.withColumns({"sub": F.floor(F.col("bar_no") / layout.SUB).cast("long"), "core": F.lit(True)}) if per_bar else made
    if starts is None:
        return bars.repartition(*signals.keys).sortWithinPartitions(*signals.group, "bar_no").mapInArrow(walker.stream, schema)
    return bars.groupBy(*signals.group).cogroup(starts.groupBy(*signals.group)).applyInArrow(
        lambda key, bars, state: walker.from_state(key, bars, state), schema)


def backtest(signals: Series, costs: Costs = Costs(), account: Account = Account(),
             carry: tuple[str, ...] = (), stream: bool = False) -> tuple[DataFrame, Series]:
    """(blotter, equity series) of every run.

    The blotter has a row per trade: numbers, times and prices of entry and exit,
    qty, pnl (with slippage, without fees), return, reason, and cash before, while
    and after. The series has a row per bar: equity, ret, and pnl and trade_return
    of a trade booked there, on short series also drawdown, the fall from the run's
    peak so far; ``carry`` names further columns of the signals to
    keep. Each is one pass over the signals. A run whose cash is used up opens no
    further position. Signals at a missing or non-positive price are not filled.
    With ``stream`` short runs go to Python one behind the other instead of each by
    itself, which costs more than its trades where runs are many and short. Where
    the signals bring a recipe, they are made there too, and `metrics.summarize` of the
    series takes its sums of each run from the same pass instead of from the series' rows.
    """
    recipe = signals.made if not signals.multi else None
    if recipe and not {*recipe.bars.df.columns, *signal_ops.get_strategy(recipe.strategy).keep}.issuperset(carry):
        recipe = None
    bars, starts = _recipe_inputs(recipe, stream, carry) if recipe else _inputs(signals, carry, stream), None
    if signals.multi:
        bars = cut_lineage(bars)
        starts = _starts(bars, signals, costs, account) if account.allow_fractional else None
    curve = _walked(bars, starts, signals, costs, account, True, carry, recipe)
    series = Series(curve, signals.keys, signals.block, signals.longest)
    if stream and not signals.multi:
        series = replace(series, made=RunSums(_walked(bars, None, signals, costs, account, False, (), recipe, True)))
    return _walked(bars, starts, signals, costs, account, False, (), recipe).drop("blk"), layout.settle(series)


@dataclass(frozen=True)
class RunSums:
    """`run_sums` of the runs of an equity series: (keys, sums)."""

    df: DataFrame


def blotter(signals: Series, costs: Costs = Costs(), account: Account = Account()) -> DataFrame:
    """The trades of every run, as the first result of `backtest`."""
    bars, starts = _inputs(signals), None
    if signals.multi:
        bars = cut_lineage(bars)
        starts = _starts(bars, signals, costs, account) if account.allow_fractional else None
    return _walked(bars, starts, signals, costs, account, False).drop("blk")


# --- close-based variant: one decision per closed bar, orders at its close -----------

CLOSE_INPUTS = ["ts", "close", "entry", "exit", "stop", "take_profit", "trail"]
CLOSE_OUTPUT = {"ts": "timestamp_ntz", "action": "string", "price": "double", "qty": "double", "pnl": "double",
                "equity": "double"}
CLOSE_STATE = {"cash": "double", "held": "double", "entry_px": "double", "stop_px": "double", "target_px": "double",
               "peak": "double", "killed": "boolean"}


def close_start(cash: float) -> dict:
    return {"cash": cash, "held": 0.0, "entry_px": None, "stop_px": None, "target_px": None, "peak": cash, "killed": False}


def close_step(state: dict, rows: list[dict], costs: Costs = Costs(), risk: float = 0.0075, kill: float = 0.20,
               warmup: int = 0, safety: float = 0.95) -> list[dict]:
    """Manage the open position at each close, else consider an entry at the same close.

    A bar that closes a position opens none.  A missing stop becomes ``safety``
    times the price; an order the cash does not cover is not filled.
    """
    out = []
    share = min(max(risk, 0.005), 0.01)
    for r in rows:
        if r["bar_no"] < warmup:
            continue
        price, action, qty, pnl, fill = r["close"], None, None, None, None

        def mark() -> float:
            value = state["cash"] + state["held"] * price
            state["peak"] = max(state["peak"], value)
            if value / state["peak"] - 1.0 <= -kill:
                state["killed"] = True
            return value

        value = mark()
        if state["held"] > 0:
            if r["trail"] and r["stop"] is not None:
                state["stop_px"] = max(state["stop_px"], r["stop"])
            if price <= state["stop_px"]:
                action = "stop"
            elif state["target_px"] is not None and price >= state["target_px"]:
                action = "take_profit"
            elif r["exit"]:
                action = "signal"
            if action:
                qty, fill = state["held"], price * (1 - costs.slip)
                pnl = (fill - state["entry_px"]) * qty
                state["cash"] += qty * fill * (1 - costs.taker_fee)
                state["held"] = 0.0
                value = mark()
        elif r["entry"] and not state["killed"]:
            stop = r["stop"] if r["stop"] is not None else price * safety
            qty = value / price
            if price > stop:
                qty = min(value * share / (price - stop), qty)
            fill = price * (1 + costs.slip)
            cost = qty * fill * (1 + costs.taker_fee)
            if qty > 0 and cost <= state["cash"] + 1e-9:
                action = "open"
                state["cash"] -= cost
                state.update(held=qty, entry_px=fill, stop_px=stop, target_px=r["take_profit"])
        if action:
            out.append({"ts": r["ts"], "action": action, "price": fill, "qty": qty, "pnl": pnl,
                        "equity": state["cash"] + state["held"] * price})
    return out
