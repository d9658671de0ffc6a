"""Order-dependent computations that never sort a whole column in one task.

Rows are written once, dealt to ranges of (keys, order) and numbered by range: Spark chooses the range
bounds from a sample, and since the table is written, a recomputed task sees the same ranges. Inside a
range a window does the work; what a range passes on to the next ones is one row per key and range,
carried forward by a window over those few rows and joined back. A key that holds most rows lies in
many ranges, keys with few rows share one. Bounds affect only the size of the pieces, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.functions.scalar import col
from keepwell.functions.stored import stored

RANGE = "_range"


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, descending: bool = False
           ) -> DataFrame:
    """df, written in ranges of (keys, order), with the range number."""
    by = [*(col(k).asc() for k in keys), *(col(o).desc() if descending else col(o).asc() for o in order)]
    return stored(df.repartitionByRange(*by).withColumn(RANGE, F.spark_partition_id()))


def _carry(cut: DataFrame, keys: Sequence[str], totals: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """keys, range and what the ranges before it pass on: aggregates of a range, then of all before."""
    before = Window.partitionBy(*map(col, keys)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    each = cut.groupBy(*map(col, keys), RANGE).agg(*[c.alias(n) for n, c in totals.items()])
    return each.select(*map(col, keys), RANGE, *[c.over(before).alias(n) for n, c in over.items()])


def _joined(local: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [local[p].eqNullSafe(carried[p]) for p in keys] + [local[RANGE] == carried[RANGE]]
    return local.join(carried, on, "left")


def running_over(cut: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], *,
                 descending: bool = False) -> DataFrame:
    """Inclusive running totals {new column: summed column} of a table that ranged() has cut."""
    by = col(order).desc() if descending else col(order).asc()
    inner = (Window.partitionBy(*map(col, [*keys, RANGE])).orderBy(by)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = cut.select("*", *[F.sum(col(c)).over(inner).alias(new) for new, c in sums.items()])
    carried = _carry(cut, keys, {f"_t_{new}": F.sum(col(c)) for new, c in sums.items()},
                     {f"_b_{new}": F.sum(col(f"_t_{new}")) for new in sums})
    return _joined(local, carried, keys).select(*[local[c] for c in cut.columns], *[
        (local[new] + F.coalesce(carried[f"_b_{new}"], F.lit(0))).alias(new) for new in sums])


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], *,
                 descending: bool = False) -> DataFrame:
    """Inclusive running totals {new column: summed column} per key in value order. The order
    values must be distinct within a key (aggregate to distinct values first)."""
    cut = ranged(df, keys, [order], descending=descending)
    return running_over(cut, keys, order, sums, descending=descending).drop(RANGE)


def previous_values(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    values: dict[str, str]) -> DataFrame:
    """Values of the preceding row of the same key {new column: source column}; the first row of a
    range takes them from the last row of the ranges before it."""
    cut = ranged(df, keys, order)
    by = [col(o).asc() for o in order]
    inner = Window.partitionBy(*map(col, [*keys, RANGE])).orderBy(*by)
    local = cut.select("*", F.row_number().over(inner).alias("__pos"), *[
        F.lag(col(c)).over(inner).alias(new) for new, c in values.items()])
    packed = F.struct(*map(col, order), *[col(c).alias(f"__v{i}") for i, c in enumerate(values.values())])
    carried = _carry(cut, keys, {"__last": F.max(packed)}, {"__carry": F.last("__last")})
    return _joined(local, carried, keys).select(*[local[c] for c in df.columns], *[
        F.when(local["__pos"] == 1, F.col(f"__carry.__v{i}")).otherwise(local[new]).alias(new)
        for i, new in enumerate(values)])


def greatest_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                    new: str) -> DataFrame:
    """Largest value among the rows before the current one (running maximum, exclusive)."""
    cut = ranged(df, keys, order)
    inner = (Window.partitionBy(*map(col, [*keys, RANGE])).orderBy(*[col(o).asc() for o in order])
             .rowsBetween(Window.unboundedPreceding, -1))
    local = cut.select("*", F.max(col(value)).over(inner).alias(new))
    carried = _carry(cut, keys, {"_top": F.max(col(value))}, {"_carry": F.max("_top")})
    return _joined(local, carried, keys).select(
        *[local[c] for c in df.columns], F.greatest(local[new], carried["_carry"]).alias(new))


def value_counts(df: DataFrame, keys: Sequence[str], value: str,
                 tallies: dict[str, Column]) -> DataFrame:
    """Distinct values with their tallies: the map-side combined input of every rank."""
    return (df.where(col(value).isNotNull()).groupBy(*map(col, keys), col(value))
            .agg(*[c.alias(name) for name, c in tallies.items()]))


def numbered(df: DataFrame, keys: Sequence[str], order: str, new: str, *,
             descending: bool = False) -> DataFrame:
    """Row number in order of a column whose values are distinct within a key."""
    cut = ranged(df, keys, [order], descending=descending)
    by = col(order).desc() if descending else col(order).asc()
    local = cut.withColumn(new, F.row_number().over(Window.partitionBy(*map(col, [*keys, RANGE])).orderBy(by)))
    carried = _carry(cut, keys, {"_n": F.count("*")}, {"_before": F.sum("_n")})
    return _joined(local, carried, keys).select(*[local[c] for c in df.columns], (
        local[new] + F.coalesce(carried["_before"], F.lit(0))).alias(new))


def evenly_spaced(df: DataFrame, keys: Sequence[str], position: str, length: Column,
                  points: int) -> DataFrame:
    """At most `points` rows per key at evenly spaced positions, keeping both ends. A row is kept
    when some grid index (half-even rounded) falls on its zero-based position."""
    pos = col(position) - 1
    step = F.greatest(length - 1, F.lit(1)) / F.lit(float(points - 1))
    guess = F.floor(pos / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1, 2):
        i = guess + shift
        hit = hit | ((i >= 0) & (i <= points - 1) & (F.bround(i * step, 0).cast("long") == pos))
    return df.where((length <= points) | hit)
