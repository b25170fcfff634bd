"""Running totals and numbers over groups of any size.

A window over a group sorts the whole group in one task.  Here a group is cut into blocks of ``2 ** bits`` consecutive
values of a whole number ``at``; the totals of blocks are themselves summed up block by block, ``levels`` times, and each
block's start comes back to it as one more row, ahead of its own.  Rows are shuffled once, by group and block, so a group
of a third of all rows is spread over as many tasks as it has blocks.  The block of a row depends on its value alone,
so a task that runs again finds the same.

The last level is one window for each group, over ``2 ** (bits * levels)`` values of ``at`` a row: with two levels of 12
bits, 60,000 rows for a group of 10 ** 12.  A block must be small: ``at`` may repeat, but not without bound.  Rows whose
``at`` is null come first and share a block; null keys are keys like others; ties in ``at`` and ``order`` are numbered in
any order.  An empty table gives an empty one.  Names that begin with ``_run`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, LEVELS = 12, 2


def running(
    rows: DataFrame, keys: list[str], at: str, sums: dict[str, Column] | None = None, latest: dict[str, Column] | None = None, order: tuple[str, ...] = (), bits: int = BITS, levels: int = LEVELS
) -> DataFrame:
    """``rows`` with what comes before each among the rows of its keys, by ``at`` and then ``order``: for each name of
    ``sums`` the sum of its column (0 at first), for each of ``latest`` its last value that isn't null."""
    sums, latest = sums or {}, latest or {}
    by = ["_run_at", *order]  # by the rows' own columns: copies of them would be shuffled too
    values = {f"_run_s{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    values |= {f"_run_l{i}": F.when(c.isNotNull(), F.struct(F.col(at).cast("long"), *order, c.alias("_run_value"))) for i, c in enumerate(latest.values())}
    read = rows.withColumns({"_run_at": F.col(at).cast("long")} | values)
    out = _before(read, keys, list(values), by, bits, levels)
    found = {n: F.coalesce(F.col(f"_run_before_s{i}"), F.lit(0)) for i, n in enumerate(sums)} | {n: F.col(f"_run_before_l{i}")["_run_value"] for i, n in enumerate(latest)}
    return out.withColumns(found).select(*(F.col(f"`{c}`") for c in dict.fromkeys([*rows.columns, *found])))


def number(rows: DataFrame, keys: list[str], at: str, name: str, order: tuple[str, ...] = (), bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """``rows`` numbered from 0 within their keys."""
    return running(rows, keys, at, {name: F.lit(1).cast("long")}, order=order, bits=bits, levels=levels)


def _merge(name: str) -> Column:
    return F.max(name) if name.startswith("_run_l") else F.sum(name)  # of two latest values, the one further on


def _before(rows: DataFrame, keys: list[str], values: list[str], by: list[str], bits: int, levels: int) -> DataFrame:
    """``rows`` with ``_run_before_*``: the values of earlier rows, merged."""
    before = {v: v.replace("_run_", "_run_before_") for v in values}
    group = Window.partitionBy(*keys)
    if not levels:
        past = group.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({b: _merge(v).over(past) for v, b in before.items()})
    block = F.shiftright("_run_at", bits)
    upper = rows.groupBy(*keys, block.alias("_run_at")).agg(*(_merge(v).alias(v) for v in values))
    starts = _before(upper, keys, values, ["_run_at"], bits, levels - 1)
    starts = starts.select(*keys, F.col("_run_at").alias("_run_block"), F.lit(True).alias("_run_start"), *(F.col(b).alias(v) for v, b in before.items()))
    both = rows.withColumns({"_run_block": block, "_run_start": F.lit(False)}).unionByName(starts, allowMissingColumns=True)
    past = Window.partitionBy(*keys, "_run_block").orderBy(F.desc("_run_start"), *by).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumns({b: _merge(v).over(past) for v, b in before.items()}).where(~F.col("_run_start")).drop("_run_block", "_run_start")
