"""Exact quantiles (linear interpolation) without holding a column in one task.

The column is bracketed first: one sketch pass gives a narrow value interval around every wanted
rank; a second pass counts what lies below and keeps only the counts inside the interval, from which
the two neighbouring order statistics are read. A bracket that misses its rank is widened, so
results are always exact. Nulls and NaN are no values; a group without values has a null result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell.functions.scalar import col, no_nan

_ACCURACY = 10_000


def quantiles(df: DataFrame, values: Sequence[str], probs: Sequence[float],
              keys: Sequence[str] = ()) -> DataFrame:
    """Long table: keys, variable, q (array in the order of `probs`). Groups must be few
    (columns, outcome classes, levels)."""
    keys = list(keys)
    if not values:
        raise ValueError("no columns given")
    return _bracketed(df, list(values), list(probs), keys)


def _bracketed(df: DataFrame, values: list[str], probs: list[float], keys: list[str]) -> DataFrame:
    spark = df.sparkSession
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), no_nan(col(v).cast("double")).alias("value"))
                      for v in values])
    tall = (df.select(*map(col, keys), F.explode(pairs).alias("_p"))
            .select(*map(col, keys), "_p.variable", "_p.value"))
    by = [*keys, "variable"]
    found: dict[tuple, dict[int, float]] = {}
    wanted: dict[tuple, set[int]] | None = None
    slack = 4.0 / _ACCURACY
    while wanted is None or any(wanted.values()):
        edges = sorted({max(0.0, p - slack) for p in probs} | {min(1.0, p + slack) for p in probs})
        sketch = tall.groupBy(*map(col, by)).agg(
            F.count("value").alias("n"),
            F.min("value").alias("lo"), F.max("value").alias("hi"),
            F.percentile_approx("value", F.array(*map(F.lit, edges)),
                                F.lit(_ACCURACY)).alias("e")).collect()
        rows = []
        for r in sketch:
            key = tuple(r[k] for k in by)
            if not r["n"]:
                found[key] = {}
                continue
            todo = set(range(len(probs))) if wanted is None else wanted.get(key, set())
            at = dict(zip(edges, r["e"], strict=True))
            for i in sorted(todo):
                lo, hi = max(0.0, probs[i] - slack), min(1.0, probs[i] + slack)
                rows.append((*key, i, r["n"], r["lo"] if lo == 0 else at[lo],
                             r["hi"] if hi == 1 else at[hi]))
        if not rows:
            break
        schema = T.StructType([*[tall.schema[k] for k in by],
                               T.StructField("_i", T.IntegerType()),
                               T.StructField("_n", T.LongType()),
                               T.StructField("_lo", T.DoubleType()),
                               T.StructField("_hi", T.DoubleType())])
        brackets = F.broadcast(spark.createDataFrame(rows, schema))
        cond = [tall[k].eqNullSafe(brackets[k]) for k in by] + [tall["value"] <= brackets["_hi"]]
        near = (tall.join(brackets, cond, "inner")
                .select(*[tall[k] for k in by], "_i", "_n",
                        F.when(F.col("value") >= F.col("_lo"), F.col("value")).alias("v"))
                .groupBy(*map(col, by), "_i", "_n", "v").agg(F.count("*").alias("c")))
        w = (Window.partitionBy(*map(col, by), "_i").orderBy(F.col("v").asc_nulls_first())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = near.withColumn("_upto", F.sum("c").over(w))
        prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
        target = prob * (F.col("_n") - 1)
        at_rank = {name: F.min(F.when(F.col("v").isNotNull() & (F.col("_upto") > rank),
                                      F.col("v"))) for name, rank in
                   (("a", F.floor(target)), ("b", F.ceil(target)))}
        picked = ranked.groupBy(*map(col, by), "_i", "_n").agg(
            at_rank["a"].alias("a"), at_rank["b"].alias("b"),
            F.coalesce(F.min(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below")
        ).collect()
        got = {(tuple(r[k] for k in by), r["_i"]): r for r in picked}
        missing: dict[tuple, set[int]] = {}
        for row in rows:
            key, i, n = tuple(row[:len(by)]), row[len(by)], row[len(by) + 1]
            rank = probs[i] * (n - 1)
            r = got.get((key, i))
            if r is None or r["a"] is None or r["b"] is None or r["below"] > math.floor(rank):
                missing.setdefault(key, set()).add(i)
                continue
            low, high = math.floor(rank), math.ceil(rank)
            found.setdefault(key, {})[i] = r["a"] if low == high else (
                (high - rank) * r["a"] + (rank - low) * r["b"])
        wanted = missing
        slack = min(1.0, slack * 16)
    out = T.StructType([*[tall.schema[k] for k in by],
                        T.StructField("q", T.ArrayType(T.DoubleType()))])
    data = [(*key, [got_q.get(i) for i in range(len(probs))] if got_q else None)
            for key, got_q in found.items()]
    return spark.createDataFrame(data, out)
