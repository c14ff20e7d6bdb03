"""Fixed table schemas and constant maps."""

from __future__ import annotations

# --- fixed values: timeframe lengths and 24/7 annualisation ------------------
TIMEFRAME_SECONDS = {"5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
BARS_PER_YEAR = {"5m": 105120, "15m": 35040, "1h": 8760, "4h": 2190, "1d": 365}
DEFAULT_BARS_PER_YEAR = 365
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
TIME_NAMES = ("ts", "timestamp", "time", "date")
EVENT_CATEGORIES = ("signal", "order", "fill", "risk", "strategy", "error")
# -----------------------------------------------------------------------------

INITIAL_CASH = 10_000.0

# Columns of the tables, as DDL, then partition columns.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "instruments": (
        "exchange STRING, symbol STRING, base STRING, quote STRING, active BOOLEAN, created_at TIMESTAMP",
        (),
    ),
    "ohlcv": (
        "exchange STRING, ts TIMESTAMP, open DECIMAL(38,12), high DECIMAL(38,12), low DECIMAL(38,12), "
        "close DECIMAL(38,12), volume DECIMAL(38,12), ingested_at TIMESTAMP, timeframe STRING, symbol STRING",
        ("timeframe", "symbol"),
    ),
    "data_quality_runs": (
        "exchange STRING, symbol STRING, timeframe STRING, range_start TIMESTAMP, range_end TIMESTAMP, "
        "n_candles BIGINT, n_gaps BIGINT, n_duplicates BIGINT, n_anomalies BIGINT, passed BOOLEAN, "
        "details STRING, created_at TIMESTAMP",
        (),
    ),
    "strategies": ("name STRING, version STRING, description STRING, created_at TIMESTAMP", ()),
    "optimization_runs": (
        "run_id STRING, strategy_name STRING, symbol STRING, timeframe STRING, objective STRING, "
        "n_trials INT, started_at TIMESTAMP, finished_at TIMESTAMP",
        (),
    ),
    "optimization_trials": (
        "run_id STRING, trial_no INT, params MAP<STRING,DOUBLE>, metrics MAP<STRING,DOUBLE>, "
        "objective_value DOUBLE, is_oos_valid BOOLEAN, created_at TIMESTAMP",
        (),
    ),
    "approved_strategies": (
        "strategy_name STRING, symbol STRING, timeframe STRING, params MAP<STRING,DOUBLE>, "
        "is_metrics MAP<STRING,DOUBLE>, oos_metrics MAP<STRING,DOUBLE>, wf_metrics MAP<STRING,DOUBLE>, "
        "mc_metrics MAP<STRING,DOUBLE>, approved BOOLEAN, approved_at TIMESTAMP, created_at TIMESTAMP",
        (),
    ),
    "accounts": (
        "venue STRING, mode STRING, equity DECIMAL(38,12), peak_equity DECIMAL(38,12), updated_at TIMESTAMP",
        (),
    ),
    "orders": (
        "client_id STRING, venue STRING, strategy_name STRING, symbol STRING, side STRING, type STRING, "
        "qty DECIMAL(38,12), limit_price DECIMAL(38,12), status STRING, venue_order_id STRING, reason STRING, "
        "created_at TIMESTAMP, updated_at TIMESTAMP",
        (),
    ),
    "fills": (
        "order_id STRING, venue STRING, symbol STRING, side STRING, qty DECIMAL(38,12), price DECIMAL(38,12), "
        "fee DECIMAL(38,12), ts TIMESTAMP",
        (),
    ),
    "positions": (
        "venue STRING, strategy_name STRING, symbol STRING, qty DECIMAL(38,12), avg_price DECIMAL(38,12), "
        "stop_price DECIMAL(38,12), take_profit DECIMAL(38,12), opened_at TIMESTAMP, updated_at TIMESTAMP, "
        "closed_at TIMESTAMP, realized_pnl DECIMAL(38,12)",
        (),
    ),
    "equity_curve": ("ts TIMESTAMP, equity DECIMAL(38,12), drawdown DOUBLE, venue STRING", ("venue",)),
    "risk_events": (
        "venue STRING, kind STRING, severity STRING, message STRING, payload STRING, created_at TIMESTAMP",
        (),
    ),
    "event_log": (
        "level STRING, message STRING, context STRING, created_at TIMESTAMP, category STRING",
        ("category",),
    ),
}
