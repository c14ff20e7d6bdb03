"""SQL builders: indicators and trades as recursive queries over numbered bars."""

from __future__ import annotations

from barloom.sources.fixtures import WALK_BARS_SQL

BPY = 365.0


def numbered(bars: str = WALK_BARS_SQL) -> str:
    """Bars with i, n and the values of the row before."""
    return f"""
  SELECT *, greatest(high - low, abs(high - pclose), abs(low - pclose)) AS tr,
         close - pclose AS chg,
         CASE WHEN phigh IS NOT NULL THEN
           CASE WHEN high - phigh > plow - low AND high > phigh THEN high - phigh ELSE 0 END END AS pdm,
         CASE WHEN phigh IS NOT NULL THEN
           CASE WHEN plow - low > high - phigh AND plow > low THEN plow - low ELSE 0 END END AS mdm,
         CASE WHEN close > 0 AND pclose > 0 THEN ln(close / pclose) END AS lr
  FROM (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n,
               lag(close) OVER w AS pclose, lag(high) OVER w AS phigh, lag(low) OVER w AS plow
        FROM ({bars}) WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def step(value: str, alpha: str, old: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN {old} WHEN {old} IS NULL THEN {value} ELSE {old} + ({alpha}) * ({value} - {old}) END"


def smoothed(columns: dict[str, tuple[str, str]], adx: str | None = None, bars: str = WALK_BARS_SQL) -> str:
    """CTE list ``nb`` (numbered bars) and ``sm`` (symbol, i, smoothed columns).

    ``columns``: name -> (expression over b, weight); with ``adx`` (a weight) the
    columns must hold atr_, sp, sn; then adx and nadx (values seen) are added.
    """
    first = ", ".join(f"cast({x} AS double) AS {c}" for c, (x, _) in columns.items())
    then = ", ".join(f"{step(x, a, f's.{c}')} AS {c}" for c, (x, a) in columns.items())
    names = ", ".join(columns)
    if adx is None:
        extra0 = extra1 = outer0 = ""
        rec = f"SELECT b.symbol, b.i, {then} FROM sm s JOIN nb b ON b.symbol = s.symbol AND b.i = s.i + 1"
        start = f"SELECT symbol, i, {first} FROM nb b WHERE i = 0"
    else:
        start = f"SELECT symbol, i, {first}, cast(NULL AS double) AS adx, 0 AS nadx FROM nb b WHERE i = 0"
        dx = ("CASE WHEN i >= per - 1 THEN 100 * abs(100 * (sp / nullif(atr_, 0)) - 100 * (sn / nullif(atr_, 0))) / "
              "nullif(100 * (sp / nullif(atr_, 0)) + 100 * (sn / nullif(atr_, 0)), 0) END")
        rec = (f"SELECT symbol, i, {names}, {step('dx', adx, 'oadx')} AS adx, "
               f"onadx + CASE WHEN dx IS NULL THEN 0 ELSE 1 END AS nadx "
               f"FROM (SELECT *, {dx} AS dx FROM (SELECT b.symbol, b.i, 14 AS per, {then}, s.adx AS oadx, s.nadx AS onadx "
               f"FROM sm s JOIN nb b ON b.symbol = s.symbol AND b.i = s.i + 1))")
    return f"nb AS MATERIALIZED ({numbered(bars)}), sm AS ({start} UNION ALL {rec})"


def ema(span: str) -> str:
    return f"2.0 / ({span} + 1)"


def wilder(n: str) -> str:
    return f"1.0 / {n}"


GAIN, LOSS = "greatest(b.chg, 0) + 0 * b.chg", "greatest(-b.chg, 0) + 0 * b.chg"


def rsi_of(ag: str, al: str, i: str, n: int) -> str:
    return (f"CASE WHEN {i} < {n} THEN NULL WHEN {al} = 0 THEN 100.0 WHEN {ag} = 0 THEN 0.0 "
            f"ELSE 100.0 - 100.0 / (1.0 + {ag} / {al}) END")


def frame(agg: str, source: str, n: int, lag: int = 0) -> str:
    over = f"OVER (PARTITION BY b.symbol ORDER BY b.i ROWS BETWEEN {n - 1 + lag} PRECEDING AND {lag} PRECEDING)"
    if lag == 0:
        over = over.replace("0 PRECEDING)", "CURRENT ROW)")
    return f"CASE WHEN count(b.{source}) {over} = {n} THEN {agg}(b.{source}) {over} END"


ALL_SMOOTH = {
    "f50": ("b.close", ema("50")), "s200": ("b.close", ema("200")), "t100": ("b.close", ema("100")),
    "atr_": ("b.tr", wilder("14")), "ag": (GAIN, wilder("14")), "al": (LOSS, wilder("14")),
    "sp": ("b.pdm", wilder("14")), "sn": ("b.mdm", wilder("14")),
}


def signals_cte(strategy: str, bars: str = WALK_BARS_SQL, p: dict | None = None) -> str:
    """CTEs ending in ``sg``: symbol, i, n, ts, prices, entry, exit, stop, tp."""
    p = p or {}
    atr = "CASE WHEN b.i >= 13 THEN s.atr_ END"
    base = "b.symbol, b.i, b.n, b.ts, b.open, b.high, b.low, b.close"
    join = "FROM nb b JOIN sm s ON s.symbol = b.symbol AND s.i = b.i"
    none = "cast(NULL AS double)"

    if strategy == "momentum_breakout":
        sm = smoothed({"atr_": ("b.tr", wilder("14"))}, bars=bars)
        mult, ch = p.get("atr_mult", "3.0"), p.get("channel", 20)
        body = f"""SELECT {base},
          coalesce(b.close > {frame('max', 'high', ch, 1)} AND b.volume > 1.2 * {frame('avg', 'volume', 20)}, false) AS entry,
          coalesce(b.close < {frame('min', 'low', 10, 1)}, false) AS exit,
          b.close - {mult} * {atr} AS stop, {none} AS tp, true AS trail {join}"""
        return f"{sm}, sg AS MATERIALIZED ({body})"
    if strategy == "breakout_rr":
        sm = smoothed({"atr_": ("b.tr", wilder("14")), "t100": ("b.close", ema("100"))}, bars=bars)
        body = f"""SELECT {base},
          coalesce(b.close > {frame('max', 'high', 20, 1)} AND b.close > CASE WHEN b.i >= 99 THEN s.t100 END, false) AS entry,
          false AS exit, b.close - 1.5 * {atr} AS stop, b.close + 3.0 * (1.5 * {atr}) AS tp, false AS trail {join}"""
        return f"{sm}, sg AS MATERIALIZED ({body})"

    up = "coalesce(CASE WHEN b.i >= 49 THEN s.f50 END > CASE WHEN b.i >= 199 THEN s.s200 END, false)"
    if strategy == "trend_following":
        sm = smoothed({k: ALL_SMOOTH[k] for k in ("f50", "s200", "atr_")}, bars=bars)
        body = f"""SELECT * EXCLUDE (up, pup, st), up AND NOT pup AS entry, NOT up AND pup AS exit,
          CASE WHEN up THEN st END AS stop, {none} AS tp, true AS trail
          FROM (SELECT *, coalesce(lag(up) OVER (PARTITION BY symbol ORDER BY i), false) AS pup
                FROM (SELECT {base}, {up} AS up, b.close - 3.0 * {atr} AS st {join}))"""
        return f"{sm}, sg AS MATERIALIZED ({body})"

    rsi = rsi_of("s.ag", "s.al", "b.i", 14)
    mid, sd = frame("avg", "close", 20), frame("stddev_pop", "close", 20)
    m_entry = f"coalesce({rsi} < 30.0, false) AND coalesce(b.close < {mid} - 2.0 * {sd}, false)"
    m_exit = f"coalesce(b.close >= {mid}, false) OR coalesce({rsi} > 55.0, false)"
    if strategy == "mean_reversion":
        sm = smoothed({k: ALL_SMOOTH[k] for k in ("ag", "al", "atr_")}, bars=bars)
        body = f"""SELECT {base}, {m_entry} AS entry, {m_exit} AS exit, b.close - 2.5 * {atr} AS stop,
          {none} AS tp, true AS trail {join}"""
        return f"{sm}, sg AS MATERIALIZED ({body})"
    if strategy == "regime_adaptive":
        sm = smoothed({k: ALL_SMOOTH[k] for k in ("f50", "s200", "atr_", "ag", "al", "sp", "sn")}, wilder("14"), bars)
        body = f"""SELECT * EXCLUDE (up, pup, st, mst, me, mx, ptrend, calm),
          (CASE WHEN trend THEN up AND NOT pup ELSE me END) AND calm AS entry,
          (CASE WHEN trend THEN NOT up AND pup ELSE mx END) OR trend <> coalesce(ptrend, trend) AS exit,
          CASE WHEN trend THEN CASE WHEN up THEN st END ELSE mst END AS stop, {none} AS tp, true AS trail
          FROM (SELECT *, coalesce(lag(up) OVER w, false) AS pup, lag(trend) OVER w AS ptrend
                FROM (SELECT {base}, {up} AS up, b.close - 3.0 * {atr} AS st, b.close - 2.5 * {atr} AS mst,
                             {m_entry} AS me, {m_exit} AS mx,
                             coalesce(CASE WHEN s.nadx >= 14 THEN s.adx END >= 25.0, false) AS trend,
                             coalesce({frame('stddev_pop', 'lr', 20)} * sqrt(365.0) <= 2.5, true) AS calm {join})
                WINDOW w AS (PARTITION BY symbol ORDER BY i))"""
        return f"{sm}, sg AS MATERIALIZED ({body})"
    raise ValueError(strategy)


def signals(strategy: str, bars: str = WALK_BARS_SQL) -> str:
    return f"""WITH RECURSIVE {signals_cte(strategy, bars)}
      SELECT symbol, ts, entry, exit, round(stop, 6) AS stop, round(tp, 6) AS take_profit FROM sg"""


def trades_cte(fee: float = 0.0005, slip: float = 0.0005, risk: float = 0.0075, cash: float = 10000.0,
               whole: bool = False) -> str:
    """CTEs over ``sg``: ``rn`` walks the bars; one row per bar with what happened on it."""
    q = f"CASE WHEN pstop < fill THEN least(cash * {risk} / (fill - pstop), cash / fill) ELSE cash / fill END"
    if whole:
        q = f"floor({q})"
    return f"""
  sb AS MATERIALIZED (SELECT *, lag(stop) OVER w AS pstop, lag(tp) OVER w AS ptp, lead(open) OVER w AS nopen,
                             lead(ts) OVER w AS nts, open * (1 + {slip}) AS fill
                      FROM sg WINDOW w AS (PARTITION BY symbol ORDER BY i)),
  rn AS (
    SELECT symbol, cast(-1 AS bigint) AS i, cast({cash} AS double) AS cash, cast(0 AS double) AS qty,
           cast(NULL AS double) AS px, cast(NULL AS double) AS st, cast(NULL AS double) AS tgt,
           cast(NULL AS bigint) AS eno, cast(NULL AS timestamp) AS ets, false AS armed,
           cast(NULL AS varchar) AS how, cast(NULL AS double) AS xpx, cast(0 AS double) AS xqty,
           cast(NULL AS bigint) AS xno, cast(NULL AS timestamp) AS xts, cast(NULL AS double) AS equity,
           cast(NULL AS timestamp) AS ts, cast(0 AS double) AS close
    FROM (SELECT DISTINCT symbol FROM sg)
    UNION ALL
    SELECT symbol, i, cash2, CASE WHEN how IS NULL THEN qty1 ELSE 0 END, px1, st2, tgt1, eno1, ets1,
           (qty1 = 0 OR how IS NOT NULL) AND entry AND i + 1 < n, how, xpx, qty1,
           CASE WHEN how = 'signal' THEN i + 1 WHEN how IS NOT NULL THEN i END,
           CASE WHEN how = 'signal' THEN nts WHEN how IS NOT NULL THEN ts END,
           CASE WHEN how IS NULL AND qty1 > 0 THEN cash2 + qty1 * close ELSE cash2 END, ts, close
    FROM (SELECT *, CASE WHEN how IS NULL THEN cash1 ELSE cash1 + qty1 * xpx * (1 - {fee}) END AS cash2
      FROM (SELECT *, CASE how WHEN 'stop' THEN least(open, st2) * (1 - {slip})
                               WHEN 'take_profit' THEN greatest(open, tgt1) * (1 - {slip})
                               WHEN 'signal' THEN nopen * (1 - {slip}) WHEN 'eod' THEN close * (1 - {slip}) END AS xpx
        FROM (SELECT *, CASE WHEN qty1 = 0 THEN NULL WHEN low <= st2 THEN 'stop' WHEN high >= tgt1 THEN 'take_profit'
                             WHEN exit AND i + 1 < n THEN 'signal' WHEN i + 1 = n THEN 'eod' END AS how
          FROM (SELECT *, CASE WHEN trail AND stop IS NOT NULL THEN greatest(st1, stop) ELSE st1 END AS st2
            FROM (SELECT * EXCLUDE (cash), cash,
                         CASE WHEN got THEN q ELSE qty END AS qty1, CASE WHEN got THEN fill ELSE px END AS px1,
                         CASE WHEN got THEN CASE WHEN pstop < fill THEN pstop END ELSE st END AS st1,
                         CASE WHEN got THEN ptp ELSE tgt END AS tgt1, CASE WHEN got THEN i ELSE eno END AS eno1,
                         CASE WHEN got THEN ts ELSE ets END AS ets1,
                         CASE WHEN got THEN cash - q * fill * (1 + {fee}) ELSE cash END AS cash1
              FROM (SELECT *, armed AND q > 0 AS got
                FROM (SELECT b.*, r.cash, r.qty, r.px, r.st, r.tgt, r.eno, r.ets, r.armed, {q} AS q
                      FROM rn r JOIN sb b ON b.symbol = r.symbol AND b.i = r.i + 1))))))))"""


BLOTTER = """SELECT symbol, ets AS entry_ts, xts AS exit_ts, round(px, 6) AS entry_price, round(xpx, 6) AS exit_price,
   round(xqty, 6) AS qty, round((xpx - px) * xqty, 4) AS pnl, round(xpx / px - 1, 8) AS trade_return, how AS reason
   FROM rn WHERE how IS NOT NULL"""


def blotter(strategy: str, bars: str = WALK_BARS_SQL, **costs) -> str:
    return f"WITH RECURSIVE {signals_cte(strategy, bars)}, {trades_cte(**costs)} {BLOTTER}"


EQ = """eq AS (SELECT symbol, i AS bar_no, ts, equity,
                equity / nullif(lag(equity) OVER w, 0) - 1 AS ret,
                CASE WHEN how IS NOT NULL THEN (xpx - px) * xqty END AS pnl,
                CASE WHEN how IS NOT NULL THEN xpx / px - 1 END AS tret
         FROM rn WHERE i >= 0 WINDOW w AS (PARTITION BY symbol ORDER BY i))"""


def equity(strategy: str, bars: str = WALK_BARS_SQL) -> str:
    return f"""WITH RECURSIVE {signals_cte(strategy, bars)}, {trades_cte()}, {EQ}
      SELECT symbol, ts, round(equity, 4) AS equity, round(ret, 8) AS ret FROM eq"""


def metrics_of(eq: str, key: str = "symbol", order: str = "bar_no", ann: str = "365.0") -> str:
    """Twelve metrics per key over a relation with equity, ret, pnl."""
    return f"""
  SELECT {key}, cagr, sharpe, sortino, CASE WHEN mdd = 0 THEN 0 ELSE cagr / abs(mdd) END AS calmar, mdd AS max_drawdown,
         volatility, total_return, win_rate, profit_factor, avg_trade, expectancy, n_trades
  FROM (SELECT {key}, mdd,
          CASE WHEN rows_ < 2 OR first_ <= 0 THEN 0 WHEN last_ / first_ <= 0 THEN -1
               ELSE pow(last_ / first_, {ann} / (rows_ - 1)) - 1 END AS cagr,
          CASE WHEN nr >= 2 AND sd > 0 THEN mean_ / sd * sqrt({ann}) ELSE 0 END AS sharpe,
          CASE WHEN nr >= 2 AND down > 0 THEN mean_ / down * sqrt({ann}) ELSE 0 END AS sortino,
          CASE WHEN nr > 1 THEN sd * sqrt({ann}) ELSE 0 END AS volatility,
          CASE WHEN rows_ >= 2 THEN last_ / first_ - 1 ELSE 0 END AS total_return,
          CASE WHEN n_ > 0 THEN nw / n_ ELSE 0 END AS win_rate,
          CASE WHEN sl < 0 THEN coalesce(sw, 0) / -sl WHEN sw > 0 THEN cast('inf' AS double) ELSE 0 END AS profit_factor,
          coalesce(ap, 0) AS avg_trade,
          CASE WHEN n_ > 0 THEN nw / n_ * coalesce(aw, 0) + (1 - nw / n_) * coalesce(al, 0) ELSE 0 END AS expectancy,
          cast(n_ AS bigint) AS n_trades
        FROM (SELECT {key}, count(equity) AS rows_, arg_min(equity, {order}) AS first_, arg_max(equity, {order}) AS last_,
                     min(equity / nullif(peak, 0) - 1) AS mdd, count(ret) AS nr, avg(ret) AS mean_,
                     stddev_pop(ret) AS sd, coalesce(stddev_pop(ret) FILTER (ret < 0), 0) AS down,
                     count(pnl) AS n_, cast(count(*) FILTER (pnl > 0) AS double) AS nw, sum(pnl) FILTER (pnl > 0) AS sw,
                     sum(pnl) FILTER (pnl < 0) AS sl, avg(pnl) AS ap, avg(pnl) FILTER (pnl > 0) AS aw,
                     avg(pnl) FILTER (pnl < 0) AS al
              FROM (SELECT *, max(equity) OVER (PARTITION BY {key} ORDER BY {order}) AS peak FROM {eq})
              GROUP BY {key}))"""


ROUNDED = ", ".join([f"round({m}, 6) AS {m}" for m in (
    "cagr", "sharpe", "sortino", "calmar", "max_drawdown", "volatility", "total_return", "win_rate",
    "profit_factor", "avg_trade", "expectancy")] + ["n_trades"])


def metrics(strategy: str, bars: str = WALK_BARS_SQL) -> str:
    return f"""WITH RECURSIVE {signals_cte(strategy, bars)}, {trades_cte()}, {EQ},
      mt AS ({metrics_of('eq')}) SELECT symbol, {ROUNDED} FROM mt"""


def split_bars(fraction: float = 0.7, warm: int = 0) -> str:
    """Walk bars per segment; the key is 'symbol|segment'."""
    return f"""
  SELECT concat(symbol, '|', seg) AS symbol, ts, open, high, low, close, volume
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i0,
               cast(floor(count(*) OVER (PARTITION BY symbol) * cast({fraction} AS double)) AS bigint) AS cut FROM ({WALK_BARS_SQL})),
       (VALUES ('is'), ('oos')) g(seg)
  WHERE CASE WHEN seg = 'is' THEN i0 < cut ELSE i0 >= cut - {warm} END"""


def window_bars(k: int = 5, train_fraction: float = 0.6, warm: int = 250, train: bool = False) -> str:
    """Walk bars per walk-forward window; the key is 'symbol|window'; size is the test size."""
    inside = "i0 < first_" if train else f"i0 >= greatest(first_ - {warm}, 0) AND i0 < first_ + size"
    return f"""
  SELECT concat(symbol, '|', w) AS symbol, ts, open, high, low, close, volume, size
  FROM (SELECT *, n0 - size * {k} + w * size AS first_
        FROM (SELECT *, CASE WHEN sized < 1 THEN greatest(1, n0 // ({k} + 2)) ELSE sized END AS size
              FROM (SELECT *, cast(floor(n0 * (1 - cast({train_fraction} AS double)) / {k}) AS bigint) AS sized
                    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i0,
                                 count(*) OVER (PARTITION BY symbol) AS n0 FROM ({WALK_BARS_SQL})))),
             range({k}) g(w))
  WHERE n0 >= {k} * 4 AND first_ >= 50 AND first_ + size - greatest(first_ - {warm}, 0) >= 5 AND {inside}"""


def with_sets(bars: str, sets: list[dict]) -> str:
    """Bars repeated per momentum parameter set; the key is 'key#set'."""
    rows = ", ".join(
        f"({i}, {p.get('channel', 20)}, {p.get('exit_channel', 10)}, {p.get('atr_period', 14)}, "
        f"cast({p.get('atr_mult', 3.0)!r} AS double), cast({p.get('vol_mult', 1.2)!r} AS double))" for i, p in enumerate(sets))
    return f"""SELECT concat(symbol, '#', pid) AS symbol, * EXCLUDE (symbol)
      FROM ({bars}), (VALUES {rows}) p(pid, ch, xc, ap, am, vm)"""


def momentum_sets_cte(bars: str, sets: list[dict], own: bool = False) -> str:
    """Signals with the parameters of ``sets``, or (``own``) with columns ch, xc, ap, am, vm of the bars; ``sets`` then lists their lengths."""
    top = " ".join(f"WHEN {n} THEN {frame('max', 'high', n, 1)}" for n in sorted({p.get('channel', 20) for p in sets}))
    low = " ".join(f"WHEN {n} THEN {frame('min', 'low', n, 1)}" for n in sorted({p.get('exit_channel', 10) for p in sets}))
    return f"""{smoothed({'atr_': ('b.tr', '1.0 / b.ap')}, bars=bars if own else with_sets(bars, sets))},
      sg AS MATERIALIZED (SELECT b.symbol, b.i, b.n, b.ts, b.open, b.high, b.low, b.close,
        coalesce(b.close > CASE b.ch {top} END AND b.volume > b.vm * {frame('avg', 'volume', 20)}, false) AS entry,
        coalesce(b.close < CASE b.xc {low} END, false) AS exit,
        b.close - b.am * CASE WHEN b.i >= b.ap - 1 THEN s.atr_ END AS stop, cast(NULL AS double) AS tp, true AS trail
        FROM nb b JOIN sm s ON s.symbol = b.symbol AND s.i = b.i)"""


def draw_columns(relation: str, seed: int, sim: str, draw: str, size: str) -> str:
    """The relation with the drawn index ``pick`` added, by nested selects."""
    return f"""SELECT * EXCLUDE (x1, x2, x3), cast(((x3 * x3 + 777) % 2147483647) % ({size}) AS bigint) AS pick
      FROM (SELECT *, (x2 * 48271 + x1) % 2147483647 AS x3
        FROM (SELECT *, (x1 * x1 + 12345) % 2147483647 AS x2
          FROM (SELECT *, cast({seed * 97} + cast({sim} AS bigint) * 2654435761 + cast({draw} AS bigint) * 40503 AS bigint) % 2147483647 AS x1
                FROM ({relation}))))"""
