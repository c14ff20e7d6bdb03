"""Ordered, bounded layout of keyed time series.

Every ordered operator works on *blocks*: at most ``block`` consecutive rows of
one key.  A key whose series fits in one block is windowed as it stands; longer
keys are split, so that a key holding a large share of the data is spread over
many tasks.  Which layout is used follows from a count of the rows per key.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.session import cut_lineage

BLOCK = 16_384
SUB = 64


@dataclass(frozen=True)
class Series:
    """Rows with ``bar_no`` (0-based per key), ``n_bars``, ``blk``, ``sub`` and ``core``.

    Rows with ``core = false`` are copies of the tail of the previous block, so
    that row frames reach back across the block edge.
    """

    df: DataFrame
    keys: tuple[str, ...]
    block: int
    longest: int
    halo: int = 0
    #: How an operator made these very rows, so that the next one may go on from there in the same pass; gone once they are changed.
    made: Any = field(default=None, compare=False, repr=False)

    @property
    def multi(self) -> bool:
        return self.longest > self.block

    @property
    def group(self) -> list[str]:
        return [*self.keys, "blk"]

    def order(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy("sub", "bar_no")

    def rows(self, n: int) -> WindowSpec:
        """The current row and the n - 1 rows before it."""
        self.need(n - 1)
        return self.order().rowsBetween(-(n - 1), 0)

    def need(self, n: int) -> None:
        """Raise if rows ``n`` back may lie in a block whose tail was not copied."""
        if self.multi and n > reach(self.halo):
            raise ValueError(f"{n} rows back are needed, the layout copies {reach(self.halo)}; lay out with halo={n}")

    def with_columns(self, columns: dict[str, Column]) -> Series:
        return replace(self, df=self.df.withColumns(columns), made=None)

    def using(self, df: DataFrame, *extra_keys: str) -> Series:
        return replace(self, df=df, keys=(*self.keys, *extra_keys), made=None)

    def core_rows(self) -> Series:
        return replace(self, df=self.df.filter("core"), made=None)

    def select(self, *columns: str) -> DataFrame:
        return self.df.filter("core").select(*self.keys, *columns)


def reach(halo: int) -> int:
    """Rows of a block copied into the next."""
    return SUB + -(-halo // SUB) * SUB if halo else 0


def join_on(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where NULL equals NULL, so that rows of a NULL key or time stay."""
    named = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(named, same, how).drop(*[f"_on_{c}" for c in on])


def settle(series: Series) -> Series:
    """Write a blocked series once where several passes read it; short series stay lazy.

    The carry across blocks needs a summary pass and a row pass; without this,
    every further step would repeat all the steps before it.
    """
    return series.using(cut_lineage(series.df)) if series.multi else series


# Rows of a task where each bar is repeated, e.g. for every parameter set.
ROWS_PER_TASK = 1 << 19


def spread(series: Series, copies: int) -> Series:
    """Deal the keys of a short series to as many partitions as its rows need once each is repeated ``copies`` times."""
    if series.multi:
        return series
    spark = series.df.sparkSession
    wanted = -(-series.df.count() * copies // ROWS_PER_TASK)
    if wanted <= max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))):
        return series
    return series.using(series.df.repartition(wanted, *series.keys))


#: Bounds on the rows of a key that the maker of a table knows, by the table.
_BOUNDS: WeakKeyDictionary = WeakKeyDictionary()


def bounded(df: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """The table, with no more than ``most`` rows a key: it need not be made once more to count them."""
    _BOUNDS[df] = tuple(keys), most
    return df


def longest_series(df: DataFrame, keys: tuple[str, ...]) -> int:
    """Rows of the longest key, or a bound known to fit a block; else one map-side combined aggregate, one number back."""
    known, most = _BOUNDS.get(df, ((), 0))
    if known == tuple(keys) and most <= BLOCK:
        return most
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def number_rows(
    df: DataFrame,
    keys: tuple[str, ...],
    ts: str = "ts",
    step_seconds: int | Column = 86400,
    block: int = BLOCK,
    longest: int | None = None,
) -> tuple[DataFrame, int]:
    """Add ``bar_no`` and ``n_bars`` per key in ``ts`` order.

    ``ts`` is a timestamp or an integer sequence (``step_seconds`` is then its
    step), unique per key.  Keys longer than ``block`` are numbered in slices of
    ``block`` steps: rows in front of a slice come from the slice counts, so no
    task sorts more than one slice.
    """
    keys = tuple(keys)
    longest = longest_series(df, keys) if longest is None else longest
    if longest <= block:
        whole = Window.partitionBy(*keys)
        return df.withColumns({
            "bar_no": (F.row_number().over(whole.orderBy(ts)) - 1).cast("long"),
            "n_bars": F.count(F.lit(1)).over(whole),
        }), longest

    # A step that is not known only decides how wide the slices are.
    step = F.lit(step_seconds) if isinstance(step_seconds, int) else F.coalesce(step_seconds, F.lit(86400))
    is_time = df.schema[ts].dataType.typeName().startswith("timestamp")
    epoch = F.col(ts).cast("timestamp").cast("long") if is_time else F.col(ts).cast("long")
    sliced = df.withColumn("_slice", F.floor(epoch / (step.cast("long") * block)).cast("long"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({
            "_off": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "n_bars": F.sum("_n").over(Window.partitionBy(*keys)),
        })
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts)
    numbered = (
        join_on(sliced.withColumn("_rn", F.row_number().over(inside) - 1), offsets, [*keys, "_slice"])
        .withColumn("bar_no", (F.col("_off") + F.col("_rn")).cast("long"))
        .drop("_slice", "_off", "_rn")
    )
    return numbered, longest


#: Rows of a range that a task numbers.
RANGE_ROWS = 1 << 18


def ranked(df: DataFrame, keys: tuple[str, ...], order: list[str], out: str = "bar_no") -> DataFrame:
    """Number the rows of each key from 0 by ``order``, however many a key (or no key: all rows) has.

    The rows are dealt by ranges of (keys, order) and written; a range is numbered
    by itself, behind the counts of the ranges before it. No task sorts more than
    a range. ``order`` is unique per key. The ranges follow the number of rows, not the
    input behind them: Spark brings 100 rows and more a range to the driver to find their
    borders. For that, and to be dealt, rows are made once.
    """
    df = cut_lineage(df)
    rows = df.count()
    ranges = max(1, min(-(-rows // 4096), max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // RANGE_ROWS))))
    dealt = df.repartitionByRange(ranges, *keys, *order)
    dealt = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    numbered = join_on(dealt.withColumn("_inside", inside), offsets, [*keys, "_range"])
    return numbered.withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_before", "_inside")


def block_rows(
    numbered: DataFrame, keys: tuple[str, ...], longest: int, halo: int = 0, block: int = BLOCK
) -> Series:
    """Assign blocks; with ``halo`` also copy the last rows of a block into the next.

    The copied stretch covers whole sub-blocks plus one, see ``smoothing``.
    """
    keys = tuple(keys)
    home = F.floor(F.col("bar_no") / block).cast("long")
    sub = F.floor(F.col("bar_no") / SUB).cast("long")
    if longest <= block:
        df = numbered.withColumns({"blk": F.lit(0).cast("long"), "sub": sub, "core": F.lit(True)})
        return Series(df, keys, block, longest)
    if not halo:
        df = numbered.withColumns({"blk": home, "sub": sub, "core": F.lit(True)})
        return Series(df.repartition(*keys, "blk"), keys, block, longest)
    copied = reach(halo)
    if copied > block:
        raise ValueError(f"frame of {halo} rows does not fit blocks of {block}")
    repeated = (F.col("bar_no") % block >= block - copied) & ((home + 1) * block < F.col("n_bars"))
    df = (
        numbered.withColumns({"sub": sub, "_home": home})
        .withColumn("blk", F.explode(F.sequence(home, home + repeated.cast("long"))))
        .withColumn("core", F.col("blk") == F.col("_home"))
        .drop("_home")
        .repartition(*keys, "blk")
    )
    return Series(df, keys, block, longest, halo)


def lay_out(
    bars: DataFrame,
    keys: tuple[str, ...] = ("symbol",),
    ts: str = "ts",
    step_seconds: int | Column = 86400,
    halo: int = 0,
    block: int = BLOCK,
) -> Series:
    numbered, longest = number_rows(bars, keys, ts, step_seconds, block)
    return block_rows(numbered, keys, longest, halo, block)


_LOCAL = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count,
          "last": lambda c: F.last(c, ignorenulls=True)}


def running(series: Series, columns: dict[str, tuple[str, Column]]) -> Series:
    """Cumulative sum / max / min / count / last non-null per key, first row to current.

    Works on core rows.  Across blocks the carry is an exclusive prefix over one
    summary row per block, joined back on the block.
    """
    s = series.core_rows()
    upto = s.order().rowsBetween(Window.unboundedPreceding, 0)
    inputs = {f"_in_{name}": column for name, (_, column) in columns.items()}
    s = s.with_columns(inputs)
    if not s.multi:
        s = s.with_columns({n: _LOCAL[kind](F.col(f"_in_{n}")).over(upto) for n, (kind, _) in columns.items()})
        return s.using(s.df.drop(*inputs))

    summary = s.df.groupBy(*s.group).agg(*[
        (F.max_by(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), F.col("bar_no")))
         if kind == "last" else _LOCAL[kind](F.col(f"_in_{n}"))).alias(f"_blk_{n}")
        for n, (kind, _) in columns.items()
    ])
    earlier = Window.partitionBy(*s.keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*s.group, *[
        (F.sum if kind == "count" else _LOCAL[kind])(F.col(f"_blk_{n}")).over(earlier).alias(f"_carry_{n}")
        for n, (kind, _) in columns.items()
    ])
    joined = join_on(s.df, carry, s.group)
    out = {}
    for n, (kind, _) in columns.items():
        local, front = _LOCAL[kind](F.col(f"_in_{n}")).over(upto), F.col(f"_carry_{n}")
        if kind in ("sum", "count"):
            out[n] = F.when(front.isNull(), local).otherwise(front + F.coalesce(local, F.lit(0)))
        elif kind == "max":
            out[n] = F.greatest(local, front)
        elif kind == "min":
            out[n] = F.least(local, front)
        else:
            out[n] = F.coalesce(local, front)
    df = joined.withColumns(out).drop(*inputs, *[f"_carry_{n}" for n in columns])
    return s.using(df)


def previous(series: Series, columns: dict[str, str]) -> Series:
    """Value of the row before, per key: {new name: column}.  Core rows only."""
    s = series.core_rows()
    if not s.multi:
        return s.with_columns({n: F.lag(c).over(s.order()) for n, c in columns.items()})
    tails = s.df.groupBy(*s.group).agg(
        *[F.max_by(F.col(c), F.col("bar_no")).alias(f"_tail_{n}") for n, c in columns.items()]
    ).withColumn("blk", F.col("blk") + 1)
    edge = F.col("bar_no") % s.block == 0
    df = join_on(s.df, tails, s.group, "left").withColumns({
        n: F.when(edge, F.col(f"_tail_{n}")).otherwise(F.lag(c).over(s.order())) for n, c in columns.items()
    })
    return s.using(df.drop(*[f"_tail_{n}" for n in columns]))
