"""Isotonic regression by pooling adjacent violators on range-partitioned scores.

Scores are counted per distinct value, dealt to ranges in order, and every range pools what violates the
order inside it. Pools are (from, to, weight, sum), and pooling is associative, so only ranges whose ends
still violate the order meet again: two neighbours at a time go to one task, which pools over their
common bound and leaves the pools on either side of it where they were. Rounds go on until no bound
violates the order. No task holds more than two ranges, and the driver sees two numbers per range.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwell.functions.ordered import RANGE, ranged
from keepwell.functions.scalar import col
from keepwell.functions.stored import stored

POOLS = f"{RANGE} int, low double, high double, weight double, total double"
#: A curve of up to so many points is sent to the rows; a longer one meets them in ranges.
SENT_POINTS = 100_000


def pool(low: list, high: list, weight: list, total: list, onto: tuple[list, list, list, list] | None = None
         ) -> tuple[list, list, list, list]:
    """Pools of a rising sequence, after those of onto: neighbours whose means do not rise are one."""
    out: tuple[list, list, list, list] = onto or ([], [], [], [])
    for a, b, w, s in zip(low, high, weight, total):
        while out[0] and out[3][-1] * w >= s * out[2][-1]:  # the mean before is not below this one
            a, w, s = out[0].pop(), w + out[2].pop(), s + out[3].pop()
            out[1].pop()
        for column, x in zip(out, (a, b, w, s)):
            column.append(x)
    return out


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pools of each sorted partition; a pool that may still grow is held back."""
    held: tuple[list, list, list, list] = ([], [], [], [])
    at = None
    for batch in batches:
        get = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        if not get["low"]:
            continue
        at = get[RANGE][0]
        held = pool(*(get[c] for c in ("low", "high", "weight", "total")), held)
    if at is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([at] * len(held[0]), pa.int32()), *[pa.array(h, pa.float64()) for h in held]],
            names=[RANGE, "low", "high", "weight", "total"])


def _met(group: pa.Table) -> pa.Table:
    """Pools of two neighbouring ranges; what was pooled over the bound goes to the upper one."""
    group = group.sort_by("low")
    names = ("low", "high", "weight", "total")
    ranges = group.column(RANGE).to_pylist()
    low, high, weight, total = pool(*(group.column(c).to_pylist() for c in names))
    lower = max((x for x, r in zip(group.column("high").to_pylist(), ranges) if r == ranges[0]), default=-np.inf)
    upper = max(ranges)
    return pa.table({RANGE: pa.array([ranges[0] if b <= lower else upper for b in high], pa.int32()),
                     **{c: pa.array(x, pa.float64()) for c, x in zip(names, (low, high, weight, total))}})


def _violations(pools: DataFrame) -> list[tuple[int, int]]:
    """Neighbouring ranges whose bound violates the order, no range twice."""
    mean = F.col("total") / F.col("weight")
    ends = sorted(pools.groupBy(RANGE).agg(F.min_by(mean, "low").alias("a"), F.max_by(mean, "low").alias("b")).collect())
    out: list[tuple[int, int]] = []
    for left, right in itertools.pairwise(ends):  # one row per range
        if left["b"] >= right["a"] and not (out and out[-1][1] == left[RANGE]):
            out.append((left[RANGE], right[RANGE]))
    return out


def isotonic(scores: DataFrame, x: str, y: str) -> DataFrame:
    """low, high, value: the rising steps that fit y (mean of equal x) best, one row per pool, stored."""
    counts = scores.where(col(x).isNotNull() & col(y).isNotNull()).groupBy(col(x).cast("double").alias("low")).agg(
        F.count("*").cast("double").alias("weight"), F.sum(col(y).cast("double")).alias("total"))
    cut = ranged(counts, [], ["low"])
    cut = cut.select(F.col(RANGE).cast("int").alias(RANGE), "low", F.col("low").alias("high"), "weight", "total")
    # a file may be read in pieces: each range is one partition again
    parts = cut.groupBy(RANGE).agg(F.count("*")).count()
    pools = stored(cut.repartition(max(parts, 1), RANGE).sortWithinPartitions(RANGE, "low").mapInArrow(_by_range, POOLS))
    while pairs := _violations(pools):
        named = pools.sparkSession.createDataFrame([(r, a) for a, b in pairs for r in (a, b)], "of int, _group int")
        marked = pools.join(named, pools[RANGE] == named["of"], "left").drop("of")
        met = marked.where("_group IS NOT NULL").groupBy("_group").applyInArrow(_met, POOLS)
        pools = stored(marked.where("_group IS NULL").drop("_group").unionByName(met))
    return pools.select("low", "high", (F.col("total") / F.col("weight")).alias("value"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_pooled for partitions that hold several whole ranges, one after the other."""
    waiting: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        ranges = batch.column(RANGE).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        for a, b in itertools.pairwise(cuts):
            if a == b:
                continue
            if at is not None and ranges[a] != at:
                yield from _pooled(iter(waiting))
                waiting = []
            at = ranges[a]
            waiting.append(batch.slice(a, b - a))
            if len(waiting) > 8:  # pool as rows come, so that a range is held as its pools only
                waiting = list(_pooled(iter(waiting)))
    if waiting:
        yield from _pooled(iter(waiting))


def _points(curve: DataFrame) -> DataFrame:
    """Corners of the steps: px, pv."""
    both = F.array_distinct(F.array(F.struct(F.col("low").alias("px"), F.col("value").alias("pv")),
                                    F.struct(F.col("high").alias("px"), F.col("value").alias("pv"))))
    return curve.select(F.explode(both).alias("p")).select("p.*")


def interpolated(df: DataFrame, x: str, curve: DataFrame, name: str) -> DataFrame:
    """df with the value of the curve at x, straight between the steps and level beyond its ends; null
    where x is null or the curve has no points."""
    points = _points(curve)
    n = points.limit(SENT_POINTS + 1).count()
    if n <= SENT_POINTS:
        rows = sorted((r.px, r.pv) for r in points.collect())
        xs, vs = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

        @F.pandas_udf("double")
        def read(values):
            if not len(xs):
                return values * np.nan
            return values.where(values.isna(), np.interp(values.to_numpy(float), xs, vs))

        return df.withColumn(name, F.nanvl(read(col(x).cast("double")), F.lit(None).cast("double")))
    return _met_in_ranges(df, x, points, name)


def _met_in_ranges(df: DataFrame, x: str, points: DataFrame, name: str) -> DataFrame:
    """Rows and points in one order: each distinct x takes the points next to it on either side."""
    wanted = df.select(col(x).cast("double").alias("px")).where("px IS NOT NULL").distinct()
    both = points.unionByName(wanted.withColumn("pv", F.lit(None).cast("double"))).groupBy("px").agg(F.max("pv").alias("pv"))
    cut = ranged(both, [], ["px"])
    point = F.when(F.col("pv").isNotNull(), F.struct("px", "pv"))
    ends = cut.groupBy(RANGE).agg(F.max(point).alias("last"), F.min(point).alias("first"))
    order = Window.partitionBy(F.lit(0)).orderBy(RANGE)  # one row per range
    ends = ends.select(F.col(RANGE).alias("_of"), F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"),
                       F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    inner = Window.partitionBy(RANGE).orderBy("px")
    near = cut.withColumns({"_b": F.last(point, True).over(inner.rowsBetween(Window.unboundedPreceding, 0)),
                            "_a": F.first(point, True).over(inner.rowsBetween(0, Window.unboundedFollowing))})
    near = near.join(ends, F.col(RANGE) == F.col("_of"), "left").select(
        "px", F.coalesce("_b", "_below").alias("b"), F.coalesce("_a", "_above").alias("a"))
    share = (F.col("px") - F.col("b.px")) / (F.col("a.px") - F.col("b.px"))
    value = F.when(F.col("b").isNull(), F.col("a.pv")).when(F.col("a").isNull() | (F.col("a.px") == F.col("b.px")), F.col("b.pv")
                                                             ).otherwise(F.col("b.pv") + share * (F.col("a.pv") - F.col("b.pv")))
    found = near.select(F.col("px").alias("_px"), value.alias("_value"))
    return df.join(found, col(x).cast("double") == F.col("_px"), "left").select(
        *[df[c] for c in df.columns], F.col("_value").alias(name))
