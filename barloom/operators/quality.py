"""Data-quality checks and cleaning of keyed bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import timeframe_seconds
from barloom.operators import layout
from barloom.operators.layout import BLOCK, Series
from barloom.schemas import PRICE_COLUMNS

REPORT = ("n_candles", "n_duplicates", "n_gaps", "n_ohlc_violations", "n_nan", "n_negative_volume", "n_anomalies",
          "passed", "messages", "gaps")


def finite(name: str) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ohlc_violation() -> Column:
    """Comparisons with a missing value do not count."""
    h, l, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    return F.coalesce(h < l, F.lit(False)) | F.coalesce(h < o, F.lit(False)) | F.coalesce(h < c, F.lit(False)) | \
        F.coalesce(l > o, F.lit(False)) | F.coalesce(l > c, F.lit(False)) | \
        F.coalesce(o <= 0, F.lit(False)) | F.coalesce(c <= 0, F.lit(False))


def missing_cells() -> Column:
    """Cells of the five columns of a row that are not finite numbers."""
    return sum((F.when(finite(c).isNull(), 1).otherwise(0) for c in PRICE_COLUMNS), F.lit(0))


def delivered(
    bars: DataFrame, keys: tuple[str, ...], timeframe: str | Column, order: str = "ts",
    step: int | Column | None = None, block: int = BLOCK,
) -> Series:
    """Bars laid out in delivery order with the timestamp and close of the row before."""
    step = timeframe_seconds(timeframe) if step is None else step
    s = layout.lay_out(bars, keys, order, step, block=block)
    s = layout.previous(s, {"prev_ts": "ts", "prev_close": "close"})
    gap_seconds = F.col("ts").cast("timestamp").cast("double") - F.col("prev_ts").cast("timestamp").cast("double")
    good = (F.col("close") > 0) & (F.col("prev_close") > 0)
    return s.with_columns({
        "is_gap": F.coalesce(gap_seconds > timeframe_seconds(timeframe) * 1.5, F.lit(False)),
        "is_late": F.coalesce(F.col("prev_ts") > F.col("ts"), F.lit(False)),
        "log_ret": F.when(good, F.ln(finite("close") / finite("prev_close"))),
    })


def gaps(series: Series) -> DataFrame:
    """One row per gap: (keys, gap_start, gap_end)."""
    return series.df.filter("is_gap").select(*series.keys, F.col("prev_ts").alias("gap_start"), F.col("ts").alias("gap_end"))


def anomalies(series: Series, z: float = 12.0) -> Series:
    """Flag returns more than ``z`` population deviations from the mean of their key.

    Statistics of long keys are combined from one record per block.
    """
    r = F.col("log_ret")
    if not series.multi:
        whole = Window.partitionBy(*series.group)
        s = series.with_columns({"_n": F.count(r).over(whole), "_m": F.avg(r).over(whole),
                                 "_sd": F.stddev_pop(r).over(whole)})
    else:
        key = Window.partitionBy(*series.keys)
        per_block = series.df.groupBy(*series.group).agg(
            F.count(r).alias("_bn"), F.avg(r).alias("_bm"), F.var_pop(r).alias("_bv"))
        mean = F.sum(F.col("_bn") * F.col("_bm")).over(key) / F.nullif(F.sum("_bn").over(key), F.lit(0))
        stats = per_block.withColumns({"_n": F.sum("_bn").over(key), "_m": mean}).withColumn(
            "_sd", F.sqrt(F.sum(F.col("_bn") * (F.col("_bv") + F.pow(F.col("_bm") - F.col("_m"), 2))).over(key)
                          / F.nullif(F.col("_n"), F.lit(0))))
        s = series.using(layout.join_on(series.df, stats.select(*series.group, "_n", "_m", "_sd"), series.group))
    spread = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    s = s.with_columns({"is_anomaly": F.coalesce((F.col("_n") > 20) & (F.abs((r - F.col("_m")) / spread) > z),
                                                 F.lit(False))})
    return s.using(s.df.drop("_n", "_m", "_sd"))


def duplicate_counts(bars: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows beyond the first per timestamp; combined per (key, ts) before per key."""
    return (bars.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_c"))
            .groupBy(*keys).agg(F.sum(F.col("_c") - 1).alias("n_duplicates")))


def report(
    bars: DataFrame, keys: tuple[str, ...], timeframe: str | Column, order: str = "ts",
    step: int | Column | None = None, anomaly_z: float = 12.0, block: int = BLOCK,
    expected: DataFrame | None = None,
) -> DataFrame:
    """One quality row per key.

    Out-of-order rows, price violations, missing cells and negative volumes fail
    the key; duplicates, gaps and anomalies are only reported.  ``expected`` keys
    without rows get a failed row.
    """
    absent = missing_columns(bars, keys)
    if absent is not None:
        return absent
    s = delivered(bars, keys, timeframe, order, step, block)
    s = anomalies(s, anomaly_z)
    s = layout.running(s, {"_gap_no": ("count", F.when(F.col("is_gap"), 1))})
    seen_before = s.df.groupBy(*keys, "ts").agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.col("is_gap").cast("long")).alias("_gaps"),
        F.sum(ohlc_violation().cast("long")).alias("_ohlc"), F.sum(missing_cells().cast("long")).alias("_nan"),
        F.sum(F.coalesce(F.col("volume") < 0, F.lit(False)).cast("long")).alias("_neg"),
        F.sum(F.col("is_anomaly").cast("long")).alias("_anom"), F.max("is_late").alias("_late"),
        F.collect_list(F.when(F.col("is_gap") & (F.col("_gap_no") <= 50), F.struct(
            F.col("_gap_no").alias("gap_no"), F.col("prev_ts").alias("gap_start"), F.col("ts").alias("gap_end"))))
        .alias("_first_gaps"))
    total = seen_before.groupBy(*keys).agg(
        F.sum("_c").alias("n_candles"), F.sum(F.col("_c") - 1).alias("n_duplicates"), F.sum("_gaps").alias("n_gaps"),
        F.sum("_ohlc").alias("n_ohlc_violations"), F.sum("_nan").alias("n_nan"),
        F.sum("_neg").alias("n_negative_volume"), F.sum("_anom").alias("n_anomalies"), F.max("_late").alias("_late"),
        F.flatten(F.collect_list(F.when(F.size("_first_gaps") > 0, F.col("_first_gaps")))).alias("_g"))
    if expected is not None:
        total = layout.join_on(expected.select(*keys).distinct(), total, list(keys), "left")
    empty = F.col("n_candles").isNull()
    say = lambda name, text: F.when(F.col(name) > 0, F.concat(F.col(name).cast("string"), F.lit(f" {text}")))
    # The texts of the messages are fixed values.
    notes = F.array_compact(F.array(
        F.when(empty, "empty dataframe"), say("n_duplicates", "duplicate timestamps"),
        F.when(F.col("_late"), "timestamps not strictly increasing"),
        say("n_ohlc_violations", "OHLC sanity violations"), say("n_nan", "NaN/non-finite values"),
        say("n_negative_volume", "negative volumes"), say("n_anomalies", "anomalous return spikes (review)")))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    counts = ("n_candles", "n_duplicates", "n_gaps", "n_ohlc_violations", "n_nan", "n_negative_volume", "n_anomalies")
    passed = ~empty & ~F.col("_late") & (F.col("n_ohlc_violations") == 0) & (F.col("n_nan") == 0) & \
        (F.col("n_negative_volume") == 0)
    ordered = F.transform(F.array_sort("_g"), lambda g: F.struct(g["gap_start"].alias("gap_start"),
                                                                  g["gap_end"].alias("gap_end")))
    return total.select(*keys, *[zero(c) for c in counts], F.coalesce(passed, F.lit(False)).alias("passed"),
                        notes.alias("messages"), F.coalesce(ordered, F.array()).alias("gaps"))


def missing_columns(bars: DataFrame, keys: tuple[str, ...]) -> DataFrame | None:
    """A failed report row per key if a price column or a usable time column is absent."""
    lost = sorted(set(PRICE_COLUMNS) - set(bars.columns))
    timed = "ts" in bars.columns and bars.schema["ts"].dataType.typeName().startswith("timestamp")
    if not lost and timed:
        return None
    note = f"missing columns: {lost}" if lost else "time column is not a timestamp"
    counts = ["n_duplicates", "n_gaps", "n_ohlc_violations", "n_nan", "n_negative_volume", "n_anomalies"]
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_candles")).select(
        *keys, "n_candles", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit(False).alias("passed"),
        F.array(F.lit(note)).alias("messages"),
        F.array().cast("array<struct<gap_start:timestamp,gap_end:timestamp>>").alias("gaps"))


def one_per_key(bars: DataFrame, keys: list[str], order: str, keep: str = "last") -> DataFrame:
    """The first or last delivered row per key; combined map-side, not windowed."""
    others = [c for c in bars.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    return (bars.groupBy(*keys).agg(pick(F.struct(*others), F.col(order)).alias("_row"))
            .select(*keys, "_row.*"))


def clean(bars: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Last row per timestamp, then rows with a missing price or volume dropped."""
    return one_per_key(bars, [*keys, "ts"], order, "last").filter(missing_cells_null() == 0)


def missing_cells_null() -> Column:
    """Cells that are NULL or NaN (infinite values stay)."""
    return sum((F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0) for c in PRICE_COLUMNS),
               F.lit(0))
