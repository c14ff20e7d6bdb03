"""Venue payloads as column expressions: candles, order responses, account state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: status names and their meaning -----------------------------
STATUS_MAP = {
    "new": "new", "open": "submitted", "submitted": "submitted", "partially_filled": "partial",
    "partial": "partial", "filled": "filled", "closed": "filled", "canceled": "cancelled",
    "cancelled": "cancelled", "rejected": "rejected",
}
# -----------------------------------------------------------------------------

_CANDLE = "t BIGINT, o STRING, h STRING, l STRING, c STRING, v STRING"
_LONG_CANDLE = "ts BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
_RESPONSE = ("status STRING, response STRUCT<data: STRUCT<statuses: ARRAY<STRUCT<error: STRING, "
             "resting: STRUCT<oid: STRING>, filled: STRUCT<oid: STRING, totalSz: STRING, avgPx: STRING>>>>>")
_ACCOUNT = ("assetPositions ARRAY<STRUCT<position: STRUCT<coin: STRING, szi: STRING, entryPx: STRING, "
            "unrealizedPnl: STRING>>>, marginSummary STRUCT<accountValue: STRING>, withdrawable STRING")


def _ts(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def candles_from_objects(raw: DataFrame, payload: str) -> DataFrame:
    """``{t,o,h,l,c,v}`` with numbers as strings."""
    parsed = raw.withColumn("_c", F.from_json(payload, _CANDLE))
    return parsed.select(*[c for c in raw.columns if c != payload], _ts(F.col("_c.t")).alias("ts"), *[
        F.col(f"_c.{short}").cast("double").alias(name)
        for short, name in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))])


def candles_from_mixed(raw: DataFrame, payload: str) -> DataFrame:
    """``[ms,o,h,l,c,v]`` or ``{ts,open,...}``; the array form is tried first."""
    is_list = F.ltrim(F.col(payload)).startswith("[")
    parsed = raw.withColumns({
        "_a": F.when(is_list, F.from_json(payload, "ARRAY<DOUBLE>")),
        "_o": F.when(~is_list, F.from_json(payload, _LONG_CANDLE)),
    })
    value = lambda i, name: F.coalesce(F.get("_a", F.lit(i)), F.col(f"_o.{name}"))
    return parsed.select(
        *[c for c in raw.columns if c != payload],
        _ts(F.coalesce(F.get("_a", F.lit(0)).cast("long"), F.col("_o.ts"))).alias("ts"),
        *[value(i + 1, name).alias(name) for i, name in enumerate(("open", "high", "low", "close", "volume"))])


def map_status(status: Column) -> Column:
    """Venue status text to ours; unknown text counts as submitted."""
    pairs = F.create_map(*[F.lit(x) for item in STATUS_MAP.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.coalesce(status, F.lit("submitted")))), F.lit("submitted"))


def order_outcome(responses: DataFrame, payload: str, qty: str) -> DataFrame:
    """Adds status, venue_order_id, filled_qty, avg_fill_price and reason.

    Anything but an ok answer is a rejection with the answer as reason; an ok
    answer without a readable status list leaves the order submitted.
    """
    df = responses.withColumn("_r", F.from_json(payload, _RESPONSE))
    st = F.get(F.col("_r.response.data.statuses"), F.lit(0))
    ok = F.coalesce(F.col("_r.status") == "ok", F.lit(False))
    error, resting, filled = st["error"], st["resting"], st["filled"]
    is_error, is_resting = ok & error.isNotNull(), ok & error.isNull() & resting.isNotNull()
    is_filled = ok & error.isNull() & resting.isNull() & filled.isNotNull()
    return df.withColumns({
        "status": F.when(~ok | is_error, "rejected").when(is_filled, "filled").otherwise("submitted"),
        "venue_order_id": F.when(is_resting, F.coalesce(resting["oid"], F.lit("")))
        .when(is_filled, F.coalesce(filled["oid"], F.lit(""))),
        "filled_qty": F.when(is_filled, F.coalesce(F.nullif(filled["totalSz"], F.lit("")).cast("double"), F.col(qty)))
        .otherwise(0.0),
        "avg_fill_price": F.when(is_filled, F.coalesce(F.nullif(filled["avgPx"], F.lit("")).cast("double"), F.lit(0.0)))
        .otherwise(0.0),
        "reason": F.when(~ok, F.col(payload)).when(is_error, error),
    }).drop("_r")


def open_positions(states: DataFrame, payload: str) -> DataFrame:
    """One row per non-zero position; the quantity is signed."""
    number = lambda name: F.coalesce(F.nullif(F.col(f"_p.position.{name}"), F.lit("")).cast("double"), F.lit(0.0))
    return (
        states.withColumn("_s", F.from_json(payload, _ACCOUNT))
        .withColumn("_p", F.explode("_s.assetPositions"))
        .select(*[c for c in states.columns if c != payload],
                F.coalesce(F.col("_p.position.coin"), F.lit("")).alias("symbol"), number("szi").alias("qty"),
                number("entryPx").alias("avg_price"), number("unrealizedPnl").alias("unrealized_pnl"))
        .filter(F.col("qty") != 0)
    )


def balances(states: DataFrame, payload: str, currency: str = "USDC") -> DataFrame:
    """Free and total quote balance per account state."""
    df = states.withColumn("_s", F.from_json(payload, _ACCOUNT))
    number = lambda path: F.coalesce(F.nullif(F.col(path), F.lit("")).cast("double"), F.lit(0.0))
    return df.select(*[c for c in states.columns if c != payload], F.lit(currency).alias("currency"),
                     number("_s.withdrawable").alias("free"), number("_s.marginSummary.accountValue").alias("total"))
