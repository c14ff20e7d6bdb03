"""Chronological segments of numbered bars: in/out of sample, walk-forward windows.

Segments are found by arithmetic on ``bar_no`` and ``n_bars``; a row is repeated
once per segment it belongs to, and numbering restarts inside each segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WARMUP_ROWS = 250


def _repeat(numbered: DataFrame, names: list, start: Callable[[Column], Column], length: Callable[[Column], Column],
            usable: Column | None = None, **extra: Column) -> DataFrame:
    """Every row once per segment of ``names`` that holds it, numbered from the segment's ``start``.

    Start and length are expressions of the segment's name. No array of segments is
    made and filtered per row: Spark interprets functions over arrays, which took
    most of the time of these plans.
    """
    others = [c for c in numbered.columns if c not in ("bar_no", "n_bars")]
    name = F.col("segment")
    rows = numbered.withColumn("segment", F.explode(F.array(*[F.lit(n) for n in names])))
    rows = rows if usable is None else rows.filter(usable)
    rows = rows.select(*others, "bar_no", "segment", start(name).cast("long").alias("seg_start"),
                       length(name).cast("long").alias("seg_len"), *[c.cast("long").alias(n) for n, c in extra.items()])
    rows = rows.filter((F.col("bar_no") >= F.col("seg_start")) & (F.col("bar_no") < F.col("seg_start") + F.col("seg_len")))
    return rows.select(*others, "segment", (F.col("bar_no") - F.col("seg_start")).alias("bar_no"),
                       F.col("seg_len").alias("n_bars"), "seg_start", *extra)


def in_out_of_sample(numbered: DataFrame, in_fraction: float = 0.7, warmup: int = 0) -> DataFrame:
    """Segments ``is`` (the first rows) and ``oos`` (the rest, with ``warmup`` rows of the first in front)."""
    if not 0.0 < in_fraction < 1.0:
        raise ValueError("in_fraction must lie between 0 and 1")
    n = F.col("n_bars")
    cut = F.floor(n * F.lit(in_fraction)).cast("long")
    start = F.greatest(cut - warmup, F.lit(0).cast("long"))
    first = lambda name: name == "is"
    return _repeat(numbered, ["is", "oos"], lambda name: F.when(first(name), F.lit(0)).otherwise(start),
                   lambda name: F.when(first(name), cut).otherwise(n - start))


def walk_forward_windows(
    numbered: DataFrame, n_splits: int = 5, train_fraction: float = 0.6, train: bool = False,
) -> DataFrame:
    """Test windows ``segment`` 0..k-1 with warm-up rows, or the anchored train rows before them.

    Adds ``test_size``.  Windows with fewer than 50 train rows or 5 test rows
    are left out, and keys with fewer than four rows per split altogether.
    """
    n = F.col("n_bars")
    sized = F.floor(n * F.lit(1 - train_fraction) / n_splits).cast("long")
    size = F.when(sized < 1, F.greatest(F.lit(1).cast("long"), F.floor(n / (n_splits + 2)).cast("long"))).otherwise(sized)

    first = lambda k: n - size * n_splits + k * size
    start = lambda k: F.greatest(F.lit(0).cast("long"), first(k) - WARMUP_ROWS)
    length = lambda k: first(k) + size - start(k)
    k = F.col("segment")
    usable = (n >= n_splits * 4) & (first(k) >= 50) & (length(k) >= 5)
    if train:
        return _repeat(numbered, list(range(n_splits)), lambda k: F.lit(0), first, usable, test_size=size)
    return _repeat(numbered, list(range(n_splits)), start, length, usable, test_size=size)
