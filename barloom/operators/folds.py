"""Ordered folds with a carried state, block by block.

For rules whose next step needs everything before it (cash that decides whether
an order passes).  All keys advance together; a key longer than a block takes
one round per block, each round reading only that block and a small state table.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.layout import Series, join_on
from barloom.session import cut_lineage

_TYPES = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(),
          "timestamp_ntz": pa.timestamp("us"), "int": pa.int32()}


def _table(rows: list[dict], group: list[str], key: tuple, columns: dict[str, str]) -> pa.Table:
    arrays = {g: pa.array([k.as_py()] * len(rows), type=k.type) for g, k in zip(group, key)}
    arrays.update({c: pa.array([r.get(c) for r in rows], type=_TYPES[t]) for c, t in columns.items()})
    return pa.table(arrays)


def fold(series: Series, step: Callable[[dict, list[dict]], list[dict]], start: Callable[[], dict],
         inputs: list[str], output: dict[str, str], state: dict[str, str]) -> DataFrame:
    """Rows of ``step`` over the bars of each key in order.

    ``step(state, rows)`` changes the state in place and returns output rows;
    ``state`` maps scalar state fields to types, so that it fits a table column.
    """
    s = series.core_rows()
    group, keys = s.group, list(s.keys)
    rows = s.df.select(*group, "bar_no", *inputs)
    columns = {"_kind": "string", **output, **state}
    schema = ", ".join([f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group]
                       + [f"`{c}` {t}" for c, t in columns.items()])

    def advance(key, current: dict, table: pa.Table) -> pa.Table:
        out = [{"_kind": "row", **r} for r in step(current, table.sort_by("bar_no").to_pylist())]
        out.append({"_kind": "state", **current})
        return _table(out, group, key, columns)

    def first(key, table):
        return advance(key, start(), table)

    def later(key, table, states):
        return advance(key, {c: states.column(c)[0].as_py() for c in state}, table)

    if not s.multi:
        done = rows.groupBy(*group).applyInArrow(first, schema)
        return done.filter("_kind = 'row'").select(*keys, *output)

    at = cut_lineage(rows.filter("blk = 0").groupBy(*group).applyInArrow(first, schema))
    parts = at
    for blk in range(1, -(-s.longest // s.block)):
        states = at.filter("_kind = 'state'").select(*keys, F.lit(blk).cast("bigint").alias("blk"), *state)
        current = rows.filter(F.col("blk") == blk)
        at = cut_lineage(current.groupBy(*group).cogroup(
            join_on(states, current.select(*group).distinct(), group, "left_semi").groupBy(*group)).applyInArrow(later, schema))
        parts = parts.unionByName(at)
    return parts.filter("_kind = 'row'").select(*keys, *output)
