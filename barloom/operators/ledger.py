"""Fills, positions, orders and the monitoring queries on them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import folds
from barloom.operators.layout import SUB, Series, join_on, running, settle
from barloom.operators.trades import Costs
from barloom.schemas import EVENT_CATEGORIES

_FLAT = 1e-12


# Maps folded together at one level of the tree.
_FAN_OUT = 256


def _compose(maps: Column) -> Column:
    """The affine map ``y -> m * y + c`` that a list of such maps, first one first, comes to."""
    return F.aggregate(maps, F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("c")), lambda before, step: F.struct(
        (step.getField("m") * before.getField("m")).alias("m"),
        (step.getField("m") * before.getField("c") + step.getField("c")).alias("c")))


def _maps_before(records: DataFrame, keys: list[str], idx: str, count: int) -> DataFrame:
    """(keys, idx, front): the map of all records (keys, idx, map) of a key before ``idx``.

    At most ``_FAN_OUT`` records are composed in one go; groups of them are the next level.
    """
    up = f"{idx}_up"
    records = records.withColumn(up, F.floor(F.col(idx) / _FAN_OUT).cast("long"))
    earlier = Window.partitionBy(*keys, up).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    inside = records.withColumn("front", _compose(F.collect_list("map").over(earlier)))
    if count > _FAN_OUT:
        groups = records.groupBy(*keys, up).agg(_compose(F.transform(
            F.array_sort(F.collect_list(F.struct(idx, "map"))), lambda r: r.getField("map"))).alias("map"))
        above = _maps_before(groups, keys, up, -(-count // _FAN_OUT)).withColumnRenamed("front", "_above")
        inside = join_on(inside, above, [*keys, up]).withColumn("front", _compose(F.array("_above", "front")))
    return inside.select(*keys, idx, "front")


def position_history(fills: Series) -> DataFrame:
    """Position of each symbol after every fill: quantity, average price, realised pnl.

    Fills carry seq, ts, side, qty, price.  Adding moves the average price;
    reducing a long realises pnl; crossing zero keeps the old average.  Quantities
    are added as decimals of 12 digits, so that a position closed is exactly flat.
    The average price is an affine map of the one before: maps are composed within
    sub-blocks, then over them.
    """
    size = F.coalesce(F.col("qty"), F.lit(0.0)).cast("decimal(26,12)")
    s = running(fills.with_columns({"_move": F.when(F.col("side") == "buy", size).otherwise(-size)}), {"_held": ("sum", F.col("_move"))})
    s = s.with_columns({"_had": (F.col("_held") - F.col("_move")).cast("double"), "_held": F.col("_held").cast("double"),
                        "_move": F.col("_move").cast("double"), "ts": F.col("ts").cast("timestamp_ntz")})
    fresh, adds = F.col("_had") == 0, F.signum("_had") == F.signum("_move")
    s = settle(s.with_columns({"map": F.struct(
        F.when(fresh, 0.0).when(adds, F.col("_had") / F.col("_held")).otherwise(1.0).alias("m"),
        F.when(fresh, F.col("price")).when(adds, F.col("price") * F.col("_move") / F.col("_held")).otherwise(0.0).alias("c"))}))
    upto = Window.partitionBy(*s.group, "sub").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = s.df.withColumn("map", _compose(F.collect_list("map").over(upto)))
    ends = rows.groupBy(*s.keys, "sub").agg(F.max_by("map", "bar_no").alias("map"))
    fronts = _maps_before(ends, list(s.keys), "sub", -(-s.longest // SUB))
    # The first fill of a key is fresh, so its map does not look back.
    average = F.col("map.m") * F.col("front.c") + F.col("map.c")
    s = s.using(join_on(rows, fronts, [*s.keys, "sub"]).withColumn("_average", average))
    sold = F.when((F.col("_had") > 0) & (F.col("_move") < 0), F.least(-F.col("_move"), F.col("_had"))).otherwise(0.0)
    s = running(s, {"realized_pnl": ("sum", sold * (F.col("price") - F.col("_average")))})
    return s.select("seq", "ts", F.col("_held").alias("qty"), F.when(F.col("_held") != 0, F.col("_average")).alias("avg_price"), "realized_pnl")


def current_positions(history: DataFrame, keys: list[str]) -> DataFrame:
    """The open position per key: the state behind its last fill."""
    last = history.groupBy(*keys).agg(F.max_by(F.struct("qty", "avg_price", "realized_pnl"), "seq").alias("_p"))
    return last.select(*keys, "_p.*").filter(F.abs("qty") >= _FLAT)


def mark_to_market(positions: DataFrame, prices: DataFrame, key: str = "symbol") -> DataFrame:
    """Adds price, value and unrealised pnl; without a price the average price counts."""
    last = prices.groupBy(key).agg(F.max_by("price", "ts").alias("_last"))
    price = F.coalesce(F.col("_last"), F.col("avg_price"))
    return positions.join(last, key, "left").withColumns({
        "price": price, "value": F.col("qty") * price,
        "unrealized_pnl": (price - F.col("avg_price")) * F.col("qty")}).drop("_last")


def account_equity(marked: DataFrame, cash: Column, by: list[str] | None = None) -> DataFrame:
    """Cash plus the value of all positions."""
    return marked.groupBy(*(by or [])).agg((cash + F.coalesce(F.sum("value"), F.lit(0.0))).alias("equity"))


# Reasons of a rejected order.
REASONS = {"buy": "insufficient_cash", "sell": "no_position"}


def _admit_step(state: dict, rows: list[dict]) -> list[dict]:
    """Which orders leave neither cash nor a holding below zero; ``state['held']`` is a JSON text."""
    held, out = json.loads(state["held"]), []
    for r in rows:
        sign, have = r["sign"], held.get(r["symbol"], 0.0)
        size = r["qty"] if sign > 0 else min(r["qty"], have)
        left = state["cash"] - sign * size * r["unit"]
        ok = left >= -1e-9 if sign > 0 else size > 0
        if ok:
            state["cash"], held[r["symbol"]] = left, have + sign * size
        out.append({"seq": r["seq"], "ok": ok, "cash_left": state["cash"]})
    state["held"] = json.dumps({k: v for k, v in held.items() if abs(v) >= _FLAT})
    return out


def admit_orders(orders: Series, starting_cash: float = 10_000.0, costs: Costs = Costs()) -> DataFrame:
    """Outcome of each order of an account in order of arrival.

    Orders carry seq, symbol, side, type, qty, limit_price and the market price.
    A buy needs cash for value and fee; a sell is cut to the held quantity (the
    answer still reports the full quantity) and rejected if nothing is held.
    Prices, fees and texts are columns; only the balances are folded.
    """
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    limit = F.when((F.col("type") == "limit") & (F.col("limit_price") != 0), F.col("limit_price"))
    s = orders.with_columns({"sign": sign, "fill": F.coalesce(limit, F.col("price")) * (1 + sign * costs.slip)})
    s = s.with_columns({"unit": F.col("fill") * (1 + F.col("sign") * costs.taker_fee)})
    told = folds.fold(s, _admit_step, lambda: {"cash": float(starting_cash), "held": "{}"}, ["seq", "symbol", "sign", "qty", "unit"],
                      {"seq": "bigint", "ok": "boolean", "cash_left": "double"}, {"cash": "double", "held": "string"})
    both = join_on(s.select("seq", "sign", "qty", "fill"), told, [*s.keys, "seq"])
    when_ok = lambda c: F.when(F.col("ok"), c).otherwise(0.0)
    return both.select(
        *s.keys, "seq", F.when(F.col("ok"), "filled").otherwise("rejected").alias("status"),
        F.when(~F.col("ok"), F.when(F.col("sign") > 0, REASONS["buy"]).otherwise(REASONS["sell"])).alias("reason"),
        when_ok(F.col("qty")).alias("filled_qty"), when_ok(F.col("fill")).alias("fill_price"),
        when_ok(F.col("qty") * F.col("fill") * costs.taker_fee).alias("fee"), "cash_left")


def first_submissions(orders: DataFrame, order: str, client: str = "client_id") -> DataFrame:
    """One row per client id: the first one acted upon (filled or submitted), else the last attempt."""
    done = F.col("status").isin("filled", "submitted")
    others = [c for c in orders.columns if c != client]
    row = F.struct(*others)
    picked = orders.groupBy(client).agg(
        F.min_by(F.when(done, row), F.when(done, F.col(order))).alias("_done"), F.max_by(row, F.col(order)).alias("_last"))
    return picked.select(client, F.coalesce("_done", "_last").alias("_r")).select(client, "_r.*")


def last_fills(fills: DataFrame, keys: list[str], order: str, limit: int = 100) -> DataFrame:
    """The last ``limit`` fills per key; Spark cuts each partition to ``limit`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return fills.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def open_rows(positions: DataFrame) -> DataFrame:
    return positions.filter(F.col("closed_at").isNull())


def venue_summary(curve: DataFrame, positions: DataFrame, by: list[str]) -> DataFrame:
    """Latest equity and drawdown, number of open positions and their strategies, per venue."""
    latest = curve.groupBy(*by).agg(F.max_by("equity", "ts").alias("equity"), F.max_by("drawdown", "ts").alias("drawdown"))
    held = open_rows(positions).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_positions"), F.array_sort(F.collect_set("strategy_name")).alias("strategies"))
    return latest.join(held, by, "full").select(
        *by, F.coalesce("equity", F.lit(0.0)).alias("equity"), F.coalesce("drawdown", F.lit(0.0)).alias("drawdown"),
        F.coalesce("n_positions", F.lit(0)).alias("n_positions"),
        F.coalesce("strategies", F.array().cast("array<string>")).alias("strategies"))


def event_rows(category: str, rows: DataFrame, ts: str, message: Column, context: list[str], level: str = "info") -> DataFrame:
    """Typed rows as event-log entries."""
    if category not in EVENT_CATEGORIES:
        raise ValueError(f"unknown event category '{category}'")
    return rows.select(F.lit(level).alias("level"), F.lit(category).alias("category"), message.alias("message"),
                       F.to_json(F.struct(*context)).alias("context"), F.col(ts).alias("created_at"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("category", F.col("created_at").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_at"))
