"""Description of the base: summaries, histograms, category rates, correlations, tenure bands."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwell.functions.quantiles import quantiles
from keepwell.functions.scalar import col, no_nan
from keepwell.functions.stored import stored
from keepwell.operators.clean import spread, tall

# Limits of the description.
MAX_LEVELS = 20
OTHER = "Other"
MISSING = "Missing"
HISTOGRAM_BINS = 20
MONTH_EDGES = (0.0, 6.0, 12.0, 24.0, 48.0)
MONTHS_LIMIT = 120
TOP_CORRELATIONS = 12


def overview(df: DataFrame, y: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.sum(col(y)).alias("churned"),
                  F.avg(col(y)).alias("churn_rate"))


def numeric_summary(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Moments in one wide aggregate, quartiles beside it: one row per (feature, group)."""
    groups = {"all": F.lit(True), "churned": col(y) == 1, "retained": col(y) == 0}
    aggs, outs = [], {}
    for i, c in enumerate(columns):
        for g, cond in groups.items():
            v, t = F.when(cond, col(c).cast("double")), f"{i}_{g}"
            aggs += [F.count(v).alias(f"n{t}"),
                     F.count_if(cond & col(c).isNull()).alias(f"x{t}"), F.avg(v).alias(f"m{t}"),
                     F.stddev_samp(v).alias(f"s{t}"), F.min(v).alias(f"a{t}"),
                     F.max(v).alias(f"b{t}")]
            outs[f"{c}\t{g}"] = {"n": f"n{t}", "missing": f"x{t}", "mean": f"m{t}",
                                 "sd": f"s{t}", "min": f"a{t}", "max": f"b{t}"}
    moments = spread(df.agg(*aggs), outs, "_key").withColumn("_parts", F.split("_key", "\t"))
    name = F.when(col(y) == 1, "churned").when(col(y) == 0, "retained")
    both = df.withColumn("_group", F.explode(F.array_compact(F.array(F.lit("all"), name))))
    q = quantiles(both, columns, [0.25, 0.5, 0.75], ["_group"])
    q = F.broadcast(q)  # three rows per feature
    m = moments.select(F.col("_parts")[0].alias("feature"), F.col("_parts")[1].alias("group"),
                       "n", "missing", "mean", "sd", "min", "max")
    return (m.join(q, (m["feature"] == q["variable"]) & (m["group"] == q["_group"]), "left")
            .select("feature", "group", "n", "missing", "mean", "sd", "min",
                    F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"),
                    F.col("q")[2].alias("q75"), "max"))


def _bin_plan(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, float, float, int]]:
    """Range and bin count per column. Only columns with few values need an exact distinct count,
    and those are cheap to count."""
    aggs = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"),
                 F.approx_count_distinct(v).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    few = [i for i in range(len(columns)) if row[f"d{i}"] <= 2 * HISTOGRAM_BINS]
    exact = df.agg(*[F.count_distinct(col(columns[i])).alias(f"e{i}") for i in few]).first() \
        if few else {}
    plan = []
    for i, c in enumerate(columns):
        lo, hi = row[f"a{i}"], row[f"b{i}"]
        if lo is None:
            continue
        bins = min(HISTOGRAM_BINS, exact[f"e{i}"] if i in few else HISTOGRAM_BINS)
        plan.append((c, lo, hi, bins) if lo < hi else (c, lo - 0.5, hi + 0.5, bins))
    return plan


def histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Equal-width bins between minimum and maximum (last one closed), empty bins included."""
    spark = df.sparkSession
    plan = _bin_plan(df, columns)
    bins = {}
    for c, lo, hi, k in plan:
        x, step = col(c).cast("double"), (hi - lo) / k
        b = F.least(F.floor((x - lo) / (hi - lo) * k), F.lit(k - 1))
        b = b - (x < lo + b * step).cast("long")
        bins[c] = b + ((x >= lo + (b + 1) * step) & (b != k - 1)).cast("long")
    counts = (tall(df, bins, ("feature", "bin")).where("bin is not null")
              .groupBy("feature", "bin").agg(F.count("*").alias("n")))
    edges = spark.createDataFrame(
        [(c, i, lo + i * (hi - lo) / k, hi if i == k - 1 else lo + (i + 1) * (hi - lo) / k)
         for c, lo, hi, k in plan for i in range(k)],
        "feature string, bin long, lo double, hi double")
    return (edges.join(counts, ["feature", "bin"], "left")
            .select("feature", "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n")))


def category_rates(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Size and churn rate per level; beyond 20 levels the 19 most frequent stay."""
    values = tall(df, {c: F.coalesce(col(c).cast("string"), F.lit(MISSING)) for c in columns},
                  ("feature", "level"), keep=[y])
    levels = values.groupBy("feature", "level").agg(F.count("*").alias("n"),
                                                    F.sum(col(y)).alias("churned"))
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "level")
    top = (levels.withColumn("_k", F.row_number().over(order))
           .where(F.col("_k") <= MAX_LEVELS))
    many = levels.groupBy("feature").agg((F.count("*") > MAX_LEVELS).alias("_fold"))
    kept = (top.join(F.broadcast(many), "feature")
            .where(~F.col("_fold") | (F.col("_k") < MAX_LEVELS))
            .groupBy("feature").agg(F.collect_list("level").alias("_kept")))
    kept = F.broadcast(kept)  # at most twenty names per feature
    named = levels.join(kept, "feature").withColumn(
        "level", F.when(F.array_contains("_kept", F.col("level")), F.col("level"))
        .otherwise(OTHER))
    return (named.groupBy("feature", "level").agg(F.sum("n").alias("n"),
                                                  F.sum("churned").alias("churned"))
            .withColumn("churn_rate", F.col("churned") / F.col("n")))


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least two different values."""
    row = df.agg(*[(F.min(col(c)) < F.max(col(c))).alias(f"v{i}")
                   for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"v{i}"]]


def _gram(centres: np.ndarray):
    """Per task and column a: for every column b the count, sums, squares and products of rows that have both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(centres)
        sums = np.zeros((4, c, c))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(c)]) - centres
            there = np.isfinite(x)
            x[~there] = 0.0
            mask = there.astype(float)
            sums += [mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x]
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(c), pa.int32()), pa.array([sums[:, a].tobytes() for a in range(c)], pa.binary())],
                                             names=["a", "sums"])

    return run


def _added(width: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros((4, width))
        for part in group.column("sums"):
            total += np.frombuffer(part.as_buffer()).reshape(4, width)
        return pa.table({"a": pa.array([key[0].as_py()] * width, pa.int32()), **{
            n: pa.array(x, pa.float64()) for n, x in zip(("n", "x", "xx", "xy"), total)}, "b": pa.array(range(width), pa.int32())}).select(
            ["a", "b", "n", "x", "xx", "xy"])

    return run


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every pair over the rows that have both (NaN counts as missing); null where one of
    them does not vary there. One pass forms the products of all columns as matrices, centred first; a
    task passes on one row per column."""
    names = list(columns)
    means = df.agg(*[F.struct(F.avg(no_nan(col(c).cast("double"))).alias("m"), (F.min(no_nan(col(c).cast("double"))) < F.max(
        no_nan(col(c).cast("double")))).alias("v")).alias(f"s{i}") for i, c in enumerate(names)]).first()
    used = [(c, means[i]["m"]) for i, c in enumerate(names) if means[i]["v"]]
    spark = df.sparkSession
    if not used:
        return spark.createDataFrame([], "a string, b string, r double")
    rows = df.select(*[col(c).cast("double").alias(f"x{i}") for i, (c, _) in enumerate(used)])
    sums = rows.mapInArrow(_gram(np.array([m for _, m in used])), "a int, sums binary").groupBy("a").applyInArrow(
        _added(len(used)), "a int, b int, n double, x double, xx double, xy double")
    sums = stored(sums)  # read for both sides of a pair
    other = sums.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("x").alias("y"), F.col("xx").alias("yy"))
    n = F.col("n")
    vx, vy = (F.greatest(F.col(q) - F.col(s) * F.col(s) / n, F.lit(0.0)) for q, s in (("xx", "x"), ("yy", "y")))
    # what is left of a column that does not vary is rounding only
    flat = (vx <= 1e-12 * F.col("xx")) | (vy <= 1e-12 * F.col("yy"))
    r = F.when(F.col("a") == F.col("b"), 1.0).when((n > 1) & ~flat, (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(vx * vy))
    name = F.array(*[F.lit(c) for c, _ in used])
    return sums.join(other, ["a", "b"]).select(F.get(name, F.col("a")).alias("a"), F.get(name, F.col("b")).alias("b"), r.alias("r"))


def correlation_with_target(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    used = varying(df, columns)
    row = df.agg(*[F.corr(col(c).cast("double"), col(y).cast("double")).alias(f"r{i}")
                   for i, c in enumerate(used)])
    return spread(row, {c: {"r": f"r{i}"} for i, c in enumerate(used)}, "feature")


def top_correlations(matrix: DataFrame, with_target: DataFrame,
                     limit: int = TOP_CORRELATIONS) -> DataFrame:
    """The part of the matrix between the columns most correlated with the target."""
    best = F.broadcast(with_target.orderBy(F.desc(F.abs("r")), "feature").limit(limit)
                       .select("feature"))
    return (matrix.join(best, matrix["a"] == best["feature"], "left_semi")
            .join(best, F.col("b") == best["feature"], "left_semi"))


def order_by_evidence(tests: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns by adjusted p (untested last), then name, with their place."""
    p = (columns.join(tests.select(F.col("variable").alias("column"), "p_adjusted"), "column",
                      "left").withColumn("p_adjusted", F.coalesce("p_adjusted", F.lit(1.0))))
    place = F.row_number().over(Window.orderBy("p_adjusted", "column"))  # one row per column
    return p.select("column", "p_adjusted", place.alias("place"))


def tenure_edges(df: DataFrame, time: str) -> list[float]:
    top = df.agg(F.max(col(time))).first()[0]
    if top is None:
        return []
    if top <= MONTHS_LIMIT:
        return list(MONTH_EDGES)
    row = quantiles(df, [time], [0.0, 0.2, 0.4, 0.6, 0.8]).first()
    return sorted(set(row["q"]))


def tenure_bands(df: DataFrame, time: str, y: str) -> DataFrame:
    """Left-closed bands of the time column; the last one is open upwards."""
    edges = tenure_edges(df, time)
    lo = F.lit(None).cast("double")
    hi = F.lit(None).cast("double")
    for i, e in enumerate(edges):
        lo = F.when(col(time) >= e, F.lit(e)).otherwise(lo)
        hi = F.when(col(time) >= e, F.lit(edges[i + 1] if i + 1 < len(edges) else None)
                    .cast("double")).otherwise(hi)
    return (df.select(lo.alias("lo"), hi.alias("hi"), col(y).alias("_y")).where("lo is not null")
            .groupBy("lo", "hi").agg(F.count("*").alias("n"), F.sum("_y").alias("churned"),
                                     F.avg("_y").alias("churn_rate")))
