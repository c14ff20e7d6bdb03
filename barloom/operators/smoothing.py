"""Exponential smoothing as a two-level scan of window functions.

The recurrence is ``y = (1 - a) * y_before + a * x`` started at the first value.
A missing ``x`` keeps ``y`` but ages it: after g missing rows the old value has
weight ``(1-a)**(g+1)`` against ``a`` for the new one.  Each step is an affine
map of ``y``, so a stretch of rows is one affine map too.  Inside a stretch the
maps are composed by running sums; between stretches by a fold over one small
record per stretch.  Deviations from the first value of the stretch are smoothed
rather than the values, so a flat series comes out exactly flat.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.layout import SUB, Series, join_on

# Largest total decay, in log units, that one stretch of running sums may span.
_LOG_RANGE = 400.0
# Stretch records folded together at one level of the carry tree.
FAN_OUT = 1024


@dataclass(frozen=True)
class Smooth:
    """One smoothing: input column, weight of the new value, values needed.

    ``alpha`` may be a column (one weight per parameter set); ``alpha_max`` then
    bounds it.
    """

    source: str
    alpha: float | Column
    min_periods: int | Column = 0
    alpha_max: float | None = None

    @property
    def weight(self) -> Column:
        return F.lit(float(self.alpha)) if isinstance(self.alpha, (int, float)) else self.alpha

    @property
    def bound(self) -> float:
        if isinstance(self.alpha, (int, float)):
            return float(self.alpha)
        if self.alpha_max is None:
            raise ValueError("alpha_max is needed when alpha is a column")
        return self.alpha_max


def span_alpha(span: int | Column) -> float | Column:
    return 2.0 / (span + 1.0)


def wilder_alpha(period: int | Column) -> float | Column:
    return 1.0 / period


def smooth(series: Series, specs: dict[str, Smooth]) -> Series:
    """Add one smoothed column per spec: {new name: Smooth}."""
    plain = {n: s for n, s in specs.items() if s.bound >= 1.0}
    specs = {n: s for n, s in specs.items() if s.bound < 1.0}
    if plain:
        # Weight 1 forgets the past: the last value itself.
        upto = series.order().rowsBetween(Window.unboundedPreceding, 0)
        series = series.with_columns({
            n: F.when(F.count(F.col(s.source)).over(upto) >= s.min_periods,
                      F.last(F.col(s.source), ignorenulls=True).over(upto))
            for n, s in plain.items()
        })
    if not specs:
        return series
    decay = max(-math.log1p(-s.bound) for s in specs.values())
    if not series.multi and decay * series.longest <= _LOG_RANGE:
        return _single_stretch(series, specs)
    return _many_stretches(series, specs)


def _stretch_columns(df: DataFrame, part: list[str], specs: dict[str, Smooth]) -> DataFrame:
    """Per row and spec: first value, decay since it (log), deviation and counts."""
    order = Window.partitionBy(*part).orderBy("bar_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    step1, step2, step3, step4 = {}, {}, {}, {}
    for n, s in specs.items():
        x, a = F.col(s.source).cast("double"), s.weight
        step1[f"_x_{n}"] = x
        step1[f"_a_{n}"] = a.cast("double")
        step2[f"_p_{n}"] = F.max(F.when(F.col(f"_x_{n}").isNotNull(), F.col("bar_no"))).over(before)
        step2[f"_f_{n}"] = F.first(F.col(f"_x_{n}"), ignorenulls=True).over(upto)
        step2[f"_n_{n}"] = F.count(F.col(f"_x_{n}")).over(upto)
        old = F.pow(1.0 - F.col(f"_a_{n}"), F.col("bar_no") - F.col(f"_p_{n}"))
        keep = old / (old + F.col(f"_a_{n}"))
        step3[f"_k_{n}"] = F.when(F.col(f"_x_{n}").isNotNull(), keep)
        step4[f"_s_{n}"] = F.coalesce(F.sum(F.ln(F.col(f"_k_{n}"))).over(upto), F.lit(0.0))
    out = df.withColumns(step1).withColumns(step2).withColumns(step3).withColumns(step4)
    return out.withColumns({
        f"_d_{n}": F.exp(F.col(f"_s_{n}")) * F.coalesce(
            F.sum((1.0 - F.col(f"_k_{n}")) * (F.col(f"_x_{n}") - F.col(f"_f_{n}")) * F.exp(-F.col(f"_s_{n}")))
            .over(upto), F.lit(0.0))
        for n in specs
    })


def _scratch(specs: dict[str, Smooth]) -> list[str]:
    return [f"_{c}_{n}" for n in specs for c in "xapfnksd"]


def _single_stretch(series: Series, specs: dict[str, Smooth]) -> Series:
    df = _stretch_columns(series.df, series.group, specs)
    df = df.withColumns({
        n: F.when(F.col(f"_n_{n}") >= s.min_periods, F.col(f"_f_{n}") + F.col(f"_d_{n}"))
        for n, s in specs.items()
    })
    return series.using(df.drop(*_scratch(specs)))


# --- stretch records ---------------------------------------------------------
# n: values seen; lead / trail: missing rows in front of the first and behind the
# last value; first: first value; p, d: end value = first + p * (start - first) + d;
# len: rows; a: weight of the spec.

def _record(n, lead, first, p, d, trail, length, a) -> Column:
    return F.struct(
        n.cast("long").alias("n"), lead.cast("long").alias("lead"), first.cast("double").alias("first"),
        p.cast("double").alias("p"), d.cast("double").alias("d"), trail.cast("long").alias("trail"),
        length.cast("long").alias("len"), a.cast("double").alias("a"))


def _empty() -> Column:
    zero, zed = F.lit(0), F.lit(0.0)
    return _record(zero, zero, zed, zed, zed, zero, zero, zed)


def _then(left: Column, right: Column) -> Column:
    """Record of the rows of ``left`` followed by those of ``right``."""
    f = lambda rec, name: rec.getField(name)
    old = F.pow(1.0 - f(right, "a"), f(left, "trail") + f(right, "lead") + 1)
    m = f(right, "p") * old / (old + f(right, "a"))
    both = _record(
        f(left, "n") + f(right, "n"), f(left, "lead"), f(left, "first"), m * f(left, "p"),
        f(right, "first") - f(left, "first") + m * (f(left, "first") + f(left, "d") - f(right, "first")) + f(right, "d"),
        f(right, "trail"), f(left, "len") + f(right, "len"), f(right, "a"))
    only_left = _record(
        f(left, "n"), f(left, "lead"), f(left, "first"), f(left, "p"), f(left, "d"),
        f(left, "trail") + f(right, "len"), f(left, "len") + f(right, "len"), f(right, "a"))
    only_right = _record(
        f(right, "n"), f(left, "len") + f(right, "lead"), f(right, "first"), f(right, "p"), f(right, "d"),
        f(right, "trail"), f(left, "len") + f(right, "len"), f(right, "a"))
    return F.when(f(left, "n") == 0, only_right).when(f(right, "n") == 0, only_left).otherwise(both)


def _then_all(left: Column, right: Column, names: list[str]) -> Column:
    return F.struct(*[_then(left.getField(n), right.getField(n)).alias(n) for n in names])


def _empty_all(names: list[str]) -> Column:
    return F.struct(*[_empty().alias(n) for n in names])


def _gather(records: DataFrame, group: list[str], idx: str) -> DataFrame:
    return records.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(idx, "rec"))).alias("recs"))


def _total(names: list[str]) -> Column:
    return F.aggregate("recs", _empty_all(names), lambda acc, r: _then_all(acc, r.getField("rec"), names))


def _in_front(idx: str, names: list[str], start: Column) -> Column:
    """Array of (idx, record of everything before idx), seeded with ``start``."""
    nothing = F.array().cast(_front_type(idx, names))
    seed = F.struct(start.alias("cur"), nothing.alias("out"))
    step = lambda acc, r: F.struct(
        _then_all(acc.getField("cur"), r.getField("rec"), names).alias("cur"),
        F.concat(acc.getField("out"),
                 F.array(F.struct(r.getField(idx).alias(idx), acc.getField("cur").alias("carry")))).alias("out"))
    return F.aggregate("recs", seed, step, lambda acc: acc.getField("out"))


def _front_type(idx: str, names: list[str]) -> str:
    rec = "struct<n:bigint,lead:bigint,first:double,p:double,d:double,trail:bigint,len:bigint,a:double>"
    return f"array<struct<{idx}:bigint,carry:struct<{','.join(f'{n}:{rec}' for n in names)}>>>"


def _carries(records: DataFrame, keys: list[str], idx: str, names: list[str], rows: int) -> DataFrame:
    """(keys, idx, carry): the record of all stretches of the key before ``idx``.

    Records are folded ``FAN_OUT`` at a time; groups of them form the next level,
    so no array grows with the length of the series.
    """
    up = "_up_" + idx
    grouped = _gather(records.withColumn(up, F.floor(F.col(idx) / FAN_OUT).cast("long")), [*keys, up], idx)
    if rows <= FAN_OUT:
        start = _empty_all(names)
    else:
        totals = grouped.select(*keys, up, _total(names).alias("rec"))
        grouped = join_on(
            grouped, _carries(totals, keys, up, names, -(-rows // FAN_OUT)).withColumnRenamed("carry", "_start"),
            [*keys, up])
        start = F.col("_start")
    return (grouped.select(*keys, F.explode(_in_front(idx, names, start)).alias("_e"))
            .select(*keys, f"_e.{idx}", "_e.carry"))


def _many_stretches(series: Series, specs: dict[str, Smooth]) -> Series:
    s, names = series, list(specs)
    part = [*s.group, "sub"]
    rows = _stretch_columns(s.df, part, specs)
    start = F.col("sub") * SUB
    # Rows in front of the first value seen in this stretch.
    lead = {n: F.min(F.when(F.col(f"_x_{n}").isNotNull(), F.col("bar_no")))
            .over(Window.partitionBy(*part).orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)) - start
            for n in names}
    rows = rows.withColumns({f"_l_{n}": c for n, c in lead.items()})

    here = {}
    for n in names:
        last_no = F.when(F.col(f"_x_{n}").isNotNull(), F.col("bar_no")).otherwise(F.col(f"_p_{n}"))
        length = F.col("bar_no") - start + 1
        seen = F.col(f"_n_{n}")
        zero = F.lit(0.0)
        here[n] = _record(
            seen, F.coalesce(F.col(f"_l_{n}"), length), F.coalesce(F.col(f"_f_{n}"), zero),
            F.exp(F.col(f"_s_{n}")), F.col(f"_d_{n}"), F.coalesce(F.col("bar_no") - last_no, length), length,
            F.col(f"_a_{n}"))
    tails = (rows.filter("core").groupBy(*part)
             .agg(F.max_by(F.struct(*[c.alias(n) for n, c in here.items()]), F.col("bar_no")).alias("rec")))

    in_block = _gather(tails, s.group, "sub")
    if s.multi:
        totals = in_block.select(*s.group, _total(names).alias("rec"))
        blocks = -(-s.longest // s.block)
        in_block = join_on(
            in_block, _carries(totals, list(s.keys), "blk", names, blocks).withColumnRenamed("carry", "_start"), s.group)
        first = F.col("_start")
    else:
        first = _empty_all(names)
    carry = (in_block.select(*s.group, F.explode(_in_front("sub", names, first)).alias("_e"))
             .select(*s.group, "_e.sub", "_e.carry"))
    if s.multi:
        # Copied rows of the previous block need the carry of their own stretch.
        carry = carry.withColumn("blk", F.explode(F.array("blk", F.col("blk") + 1)))
    rows = join_on(rows, carry, part)

    out = {}
    for n, spec in specs.items():
        c = F.col("carry").getField(n)
        old = F.pow(1.0 - F.col(f"_a_{n}"), c.getField("trail") + F.col(f"_l_{n}") + 1)
        end = c.getField("first") + c.getField("d")
        from_carry = F.when(
            c.getField("n") > 0,
            F.exp(F.col(f"_s_{n}")) * old / (old + F.col(f"_a_{n}")) * (end - F.col(f"_f_{n}"))
        ).otherwise(0.0)
        value = (F.when(F.col(f"_n_{n}") > 0, F.col(f"_f_{n}") + from_carry + F.col(f"_d_{n}"))
                 .when(c.getField("n") > 0, end))
        out[n] = F.when(F.col(f"_n_{n}") + c.getField("n") >= spec.min_periods, value)
    df = rows.withColumns(out).drop("carry", *_scratch(specs), *[f"_l_{n}" for n in names])
    return s.using(df)
