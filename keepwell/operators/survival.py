"""Kaplan-Meier curves and log-rank tests from counts per distinct time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions.dist import chi2_sf
from keepwell.functions.ordered import RANGE, evenly_spaced, numbered, ranged, running_over, value_counts
from keepwell.functions.scalar import col
from keepwell.functions.stored import stored
from keepwell.operators.clean import tall

# Curve size, horizons, limits of the grouping columns, normal 97.5 % point.
CURVE_POINTS = 200
HORIZONS = (6, 12, 24)
MIN_LEVELS, MAX_LEVELS = 2, 6
TOP_COLUMNS = 3
MIN_GROUP = 5
Z95 = 1.959963984540054
#: Counts (level and time) of a column that one task solves a log-rank test from, at most.
IN_ONE_TASK = 1 << 20


def durations(df: DataFrame, time: str) -> DataFrame:
    """Rows with a usable duration."""
    t = col(time).try_cast("double") if df.schema[time].dataType.typeName() == "string" \
        else col(time).cast("double")
    return df.withColumn(time, t).where(col(time) >= 0)


def dropped_durations(df: DataFrame, time: str) -> DataFrame:
    t = col(time).try_cast("double") if df.schema[time].dataType.typeName() == "string" \
        else col(time).cast("double")
    return df.agg(F.count_if(t.isNull() | (t < 0)).alias("rows_dropped"))


def kaplan_meier(df: DataFrame, time: str, event: str, keys: Sequence[str] = ()) -> DataFrame:
    """Survival at every distinct time with its 95 % band (log-minus-log scale)."""
    keys = list(keys)
    counts = value_counts(df, keys, time, {"d": F.sum(col(event)).cast("long"),
                                           "c": F.count("*")}).withColumnRenamed(time, "t")
    zero = counts.groupBy(*map(col, keys)).agg(F.count("*")).select(
        *map(col, keys), F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("c"))
    counts = (counts.withColumn("t", F.col("t").cast("double")).unionByName(zero)
              .groupBy(*map(col, keys), "t").agg(F.sum("d").alias("d"), F.sum("c").alias("c")))
    cut = ranged(counts, keys, ["t"])
    ran = running_over(cut, keys, "t", {"_gone": "c"})
    sizes = cut.groupBy(*map(col, keys)).agg(F.sum("c").alias("_size"))
    ran = ran.join(sizes, [ran[k].eqNullSafe(sizes[k]) for k in keys] or F.lit(True)).select(
        *[ran[c] for c in ran.columns], "_size")
    at_risk = F.col("_size") - F.col("_gone") + F.col("c")
    ran = ran.withColumn("n", at_risk)
    all_gone = (F.col("d") == F.col("n")) & (F.col("d") > 0)
    part = F.when(all_gone | (F.col("d") == 0), 0.0).otherwise(
        F.log1p(-F.col("d") / F.col("n")))
    var = F.when(all_gone | (F.col("d") == 0), 0.0).otherwise(
        F.col("d") / (F.col("n").cast("double") * (F.col("n") - F.col("d"))))
    ran = ran.withColumns({"_log": part, "_var": var, "_end": all_gone.cast("int")})
    ran = running_over(ran.drop("_gone", "_size"), keys, "t",
                       {"_slog": "_log", "_svar": "_var", "_over": "_end"})
    s = F.when(F.col("_over") > 0, 0.0).otherwise(F.exp("_slog"))
    half = Z95 * F.sqrt("_svar") / -F.col("_slog")
    centre = F.log(-F.col("_slog"))
    flat = (F.col("_over") > 0) | (F.col("_slog") == 0)
    return ran.select(*map(col, keys), "t", "n", "d", s.alias("s"),
                      F.when(flat, s).otherwise(F.exp(-F.exp(centre + half))).alias("lo"),
                      F.when(flat, s).otherwise(F.exp(-F.exp(centre - half))).alias("hi"))


def survival_summary(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median and survival at the horizons (the last step at or before each)."""
    picks = [F.when(F.max("t") >= h, F.max_by(F.when(F.col("t") <= h, F.col("s")),
                                              F.when(F.col("t") <= h, F.col("t"))))
             .alias(f"s{h}") for h in HORIZONS]
    return curve.groupBy(*map(col, keys)).agg(
        F.max("n").alias("n"), F.sum("d").alias("events"),
        F.min(F.when(F.col("s") <= 0.5, F.col("t"))).alias("median"), *picks)


def downsample(curve: DataFrame, keys: Sequence[str] = (), points: int = CURVE_POINTS) -> DataFrame:
    """At most `points` evenly spaced rows of each curve, both ends kept."""
    keys = list(keys)
    placed = numbered(curve, keys, "t", "_pos")
    length = curve.groupBy(*map(col, keys)).agg(F.count("*").alias("_len"))
    placed = placed.join(length, [placed[k].eqNullSafe(length[k]) for k in keys] or F.lit(True)).select(
        *[placed[c] for c in placed.columns], "_len")
    return evenly_spaced(placed, keys, "_pos", F.col("_len"), points).drop("_pos", "_len")


def level_counts(df: DataFrame, columns: Sequence[str], y: str, missing: str | None = None
                 ) -> DataFrame:
    """variable, level, retained, churned for every column in one pass."""
    exprs = {c: col(c).cast("string") for c in columns}
    if missing is not None:
        exprs = {c: F.coalesce(e, F.lit(missing)) for c, e in exprs.items()}
    return (tall(df, exprs, ("variable", "level"), keep=[y]).where("level is not null")
            .groupBy("variable", "level")
            .agg(F.count_if(col(y) == 0).alias("retained"),
                 F.count_if(col(y) == 1).alias("churned")))


def association(levels: DataFrame, keys: Sequence[str] = ("variable",)) -> DataFrame:
    """Chi-square and Cramer's V of each variable against the 0/1 outcome. Totals are one row
    per variable, so even a column with very many levels is summed without a window."""
    keys = list(keys)
    totals = F.broadcast(levels.groupBy(*map(col, keys)).agg(
        F.sum("retained").alias("_r"), F.sum("churned").alias("_c"), F.count("*").alias("levels")))
    n = F.col("_r") + F.col("_c")
    size = F.col("retained") + F.col("churned")
    e0, e1 = size * F.col("_r") / n, size * F.col("_c") / n
    cell = F.coalesce(F.try_divide(F.pow(F.col("retained") - e0, 2), e0), F.lit(0.0)) + F.coalesce(
        F.try_divide(F.pow(F.col("churned") - e1, 2), e1), F.lit(0.0))
    out = (levels.join(totals, keys).groupBy(*map(col, keys), "levels", "_r", "_c")
           .agg(F.sum(cell).alias("chi2"), F.min(F.least(e0, e1)).alias("min_expected")))
    usable = (F.col("levels") >= 2) & (F.col("_r") > 0) & (F.col("_c") > 0)
    return out.select(
        *map(col, keys), n.alias("n"), "levels", F.when(usable, F.col("chi2")).alias("chi2"),
        "min_expected", (F.col("levels") - 1).alias("df"),
        F.when(usable, F.sqrt(F.col("chi2") / n)).otherwise(0.0).alias("cramers_v"))


def pick_group_columns(association_table: DataFrame) -> DataFrame:
    """The three columns with two to six levels that are most associated with the outcome."""
    return (association_table.where(F.col("levels").between(MIN_LEVELS, MAX_LEVELS))
            .orderBy(F.desc("cramers_v"), "variable").limit(TOP_COLUMNS)
            .select("variable", "cramers_v"))


def by_level(df: DataFrame, columns: Sequence[str], time: str, event: str) -> DataFrame:
    """variable, level and the two outcome columns, for levels with enough rows."""
    long = tall(df, {c: col(c).cast("string") for c in columns}, ("variable", "level"),
                keep=[time, event]).where("level is not null")
    big = (long.groupBy("variable", "level").agg(F.count("*").alias("_n"))
           .where(F.col("_n") >= MIN_GROUP).select("variable", "level"))
    return long.join(big, ["variable", "level"], "left_semi")


def logrank_counts(df: DataFrame, columns: Sequence[str], time: str, event: str) -> DataFrame:
    """variable, level, t, c (rows), d (events) and, of all levels of the variable up to t, the running
    totals h of d / n, s1 of s / n and s2 of s / n^2; n: rows at risk, s: the hypergeometric scale. One
    stored row per time that a level has; its width does not depend on the number of levels."""
    long = by_level(df, columns, time, event)
    counts = long.groupBy("variable", "level", col(time).cast("double").alias("t")).agg(
        F.count("*").alias("c"), F.sum(col(event)).cast("long").alias("d"))
    cut = ranged(counts, ["variable"], ["t"])
    times = cut.groupBy("variable", "t", RANGE).agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    size = cut.groupBy("variable").agg(F.sum("c").alias("_size"))
    ran = running_over(times, ["variable"], "t", {"_gone": "c"}).join(size, "variable")
    n, d = F.col("n"), F.col("d").cast("double")
    scale = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(0.0)
    ran = ran.withColumn("n", (F.col("_size") - F.col("_gone") + F.col("c")).cast("double")).withColumns(
        {"_h": d / n, "_1": scale / n, "_2": scale / (n * n)})
    ran = running_over(ran.select("variable", "t", RANGE, "_h", "_1", "_2"), ["variable"], "t",
                       {"h": "_h", "s1": "_1", "s2": "_2"})
    ran = ran.select(F.col("variable").alias("_v"), F.col("t").alias("_t"), "_2", "h", "s1", "s2")
    joined = cut.join(ran, (F.col("variable") == F.col("_v")) & (F.col("t") == F.col("_t")))
    return stored(joined.select("variable", "level", "t", RANGE, "c", "d", "h", "s1", F.col("_2").alias("step"), "s2"))


def logrank_table(counts: DataFrame) -> DataFrame:
    """Observed and expected events and the variance of their gap per level. Everyone of a level adds what
    the totals have reached by their own time, so no level needs the times of the others."""
    size = counts.groupBy("variable", "level").agg(F.sum("c").alias("_z"))
    ran = running_over(counts, ["variable", "level"], "t", {"_gone": "c"}).join(size, ["variable", "level"])
    n = (F.col("_z") - F.col("_gone") + F.col("c")).cast("double")  # at risk in the level
    rest = n - F.col("c")
    return ran.groupBy("variable", "level").agg(
        F.sum("d").alias("observed"), F.sum(F.col("c") * F.col("h")).alias("expected"),
        F.sum(F.col("c") * F.col("s1") - F.col("s2") * (n * n - rest * rest)).alias("variance"))


def _conjugate(gap: np.ndarray, diagonal: np.ndarray, product) -> float:
    """gap . x where the covariance times x is gap, by preconditioned conjugate gradients."""
    live = diagonal > 1e-12 * max(diagonal.max(initial=0.0), 1e-300)
    gap = np.where(live, gap, 0.0)
    inverse = np.where(live, 1.0 / np.where(live, diagonal, 1.0), 0.0)
    x, r = np.zeros_like(gap), gap.copy()
    z = inverse * r
    p, rz = z.copy(), float(r @ z)
    first = rz
    for _ in range(4 * len(gap) + 20):
        if rz <= 1e-24 * first or rz == 0.0:
            break
        q = product(p)
        a = rz / float(p @ q)
        x, r = x + a * p, r - a * q
        z = inverse * r
        rz, old = float(r @ z), rz
        p = z + (rz / old) * p
    return float(gap @ x)


def _solve_group(key: tuple, group: pa.Table) -> pa.Table:
    """The statistic of one variable from its counts. The covariance is applied, never written out: the
    weighted rows at risk at a time are a reversed running total over the times."""
    get = {c: group.column(c).to_numpy() for c in ("t", "c", "d", "h", "s1", "step", "s2")}
    levels, g = np.unique(group.column("level").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    times, at = np.unique(get["t"], return_inverse=True)
    step = np.zeros(len(times))
    step[at] = get["step"]
    c, k = get["c"].astype(float), len(levels)
    plain = np.bincount(g, c * get["s1"], k)

    def product(x: np.ndarray) -> np.ndarray:
        risk = np.cumsum(np.bincount(at, c * x[g], len(times))[::-1])[::-1]
        return plain * x - np.bincount(g, c * np.cumsum(step * risk)[at], k)

    order = np.lexsort((get["t"], g))
    left = np.cumsum(c[order][::-1])[::-1]  # of the level and those after it
    ends = np.append(np.flatnonzero(np.diff(g[order])), len(g) - 1)
    after = np.append(left, 0.0)[ends + 1]
    n = left - np.repeat(after, np.diff(np.append(-1, ends)))
    square = np.bincount(g[order], get["s2"][order] * (n * n - (n - c[order]) ** 2), k)
    gap = np.bincount(g, get["d"] - c * get["h"], k)
    stat = _conjugate(gap, plain - square, product) if k > 1 else None
    return pa.table({"variable": [key[0].as_py()], "statistic": pa.array([stat], pa.float64()), "df": pa.array([k - 1], pa.int32())})


def _spread_statistics(counts: DataFrame, table: DataFrame) -> list[tuple]:
    """As _solve_group for variables of any size: levels stay a table, a product is two running totals
    over the times, and the driver sees a few numbers per variable."""
    now = stored(table.select("variable", "level", (F.col("observed") - F.col("expected")).alias("r"), F.lit(0.0).alias("x"),
                              F.when(F.col("variance") > 1e-9, 1.0 / F.col("variance")).otherwise(0.0).alias("inverse")).withColumn(
        "r", F.when(F.col("inverse") > 0, F.col("r")).otherwise(0.0)).withColumn("p", F.col("r") * F.col("inverse")).withColumn("gap", F.col("r")))
    sizes = {r.variable: (r.n, r.rz) for r in now.groupBy("variable").agg(
        F.count("*").alias("n"), F.sum(F.col("r") * F.col("p")).alias("rz")).collect()}
    first, spark = {v: rz for v, (_, rz) in sizes.items()}, counts.sparkSession
    plain = counts.groupBy("variable", "level").agg(F.sum(F.col("c") * F.col("s1")).alias("plain"))
    total = dict(first)
    for _ in range(4 * max((n for n, _ in sizes.values()), default=0) + 20):
        if all(rz <= 1e-20 * first[v] for v, rz in total.items()):
            break
        marked = counts.join(now.select("variable", "level", "p"), ["variable", "level"])
        times = marked.groupBy("variable", "t", RANGE, "step").agg(F.sum(F.col("c") * F.col("p")).alias("w"))
        whole = times.groupBy("variable").agg(F.sum("w").alias("_all"))
        risk = running_over(times, ["variable"], "t", {"_upto": "w"}).join(whole, "variable").withColumn(
            "q", F.col("step") * (F.col("_all") - F.col("_upto") + F.col("w")))
        reached = running_over(risk.select("variable", "t", RANGE, "q"), ["variable"], "t", {"reached": "q"}).select("variable", "t", "reached")
        pulled = counts.join(reached, ["variable", "t"]).groupBy("variable", "level").agg(F.sum(F.col("c") * F.col("reached")).alias("pull"))
        step = stored(now.join(plain, ["variable", "level"]).join(pulled, ["variable", "level"]).withColumn(
            "q", F.col("plain") * F.col("p") - F.col("pull")))
        pq = {r.variable: r.pq for r in step.groupBy("variable").agg(F.sum(F.col("p") * F.col("q")).alias("pq")).collect()}
        length = spark.createDataFrame([(v, total[v] / pq[v] if pq[v] and total[v] > 1e-20 * first[v] else 0.0) for v in pq],
                                       "variable string, a double")
        moved = step.join(length, "variable").withColumns(
            {"x": F.col("x") + F.col("a") * F.col("p"), "r": F.col("r") - F.col("a") * F.col("q")})
        moved = stored(moved.select("variable", "level", "gap", "x", "r", "p", "inverse"))
        old, total = total, {r.variable: r.rz for r in moved.groupBy("variable").agg(
            F.sum(F.col("r") * F.col("r") * F.col("inverse")).alias("rz")).collect()}
        turn = spark.createDataFrame([(v, total[v] / old[v] if old[v] else 0.0) for v in total], "variable string, b double")
        now = moved.join(turn, "variable").withColumn("p", F.col("r") * F.col("inverse") + F.col("b") * F.col("p")).drop("b")
    return [(r.variable, r.stat, r.n - 1) for r in now.groupBy("variable").agg(
        F.sum(F.col("gap") * F.col("x")).alias("stat"), F.count("*").alias("n")).collect()]


def logrank_statistics(counts: DataFrame, in_one: int = IN_ONE_TASK) -> DataFrame:
    """variable, statistic, df of every variable with two levels or more. Variables of up to in_one counts
    are solved in a task each, larger ones as tables by the same steps."""
    sizes = counts.groupBy("variable").agg(F.count("*").alias("n"))
    small = counts.join(sizes.where(F.col("n") <= in_one), "variable", "left_semi").groupBy("variable").applyInArrow(
        _solve_group, "variable string, statistic double, df int")
    large = [r.variable for r in sizes.where(F.col("n") > in_one).collect()]  # names of columns
    if large:
        mine = counts.where(F.col("variable").isin(large))
        found = _spread_statistics(mine, logrank_table(mine))
        small = small.unionByName(counts.sparkSession.createDataFrame(found, "variable string, statistic double, df int"))
    return small.where("df > 0")


def logrank_tests(counts: DataFrame) -> DataFrame:
    """Statistic, df and p per column."""
    rows = [(r.variable, r.statistic, r.df, chi2_sf(r.statistic, r.df))
            for r in logrank_statistics(counts).collect()]  # one per column
    return counts.sparkSession.createDataFrame(
        rows, "variable string, statistic double, df int, p_value double")
