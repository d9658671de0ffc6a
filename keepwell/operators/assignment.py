"""Randomised assignment: hash split, balance, segments, busy customers, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.functions.scalar import col, hash_unit, no_nan, ratio
from keepwell.operators.clean import spread, tall
from keepwell.operators.filters import Filter, segment_predicate

# Balance threshold and levels, filter-builder levels, running statuses, plan hints.
SMD_LIMIT = 0.1
ACTIVE = ("running", "results_uploaded")
PLAN_HINTS = ("contract", "plan", "tier", "package", "subscription")


def assign_arms(df: DataFrame, experiment_id: int | Column, id_column: str,
                control_share: float | Column) -> DataFrame:
    """arm = control when the customer's hash falls below the control share. No shuffle, and the
    same customer always lands in the same arm."""
    key = experiment_id if isinstance(experiment_id, Column) else F.lit(experiment_id)
    draw = hash_unit(key, col(id_column))
    return df.withColumn("arm", F.when(draw < control_share, "control").otherwise("treatment"))


def snapshot_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-independent fingerprint: the 256-bit row hashes are added up in four 64-bit lanes,
    so it combines map-side and never gathers rows."""
    text = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(col(c).cast("string"), F.lit("")))
                              for c in sorted(columns)])
    digest = F.sha2(text, 256)
    lanes = [F.sum(F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)"))
             .cast("decimal(38,0)").cast("string").alias(f"lane{i}") for i in range(4)]
    sums = df.agg(F.count("*").cast("string").alias("n"), *lanes)
    return sums.select(F.sha2(F.concat_ws("|", "n", *[f"lane{i}" for i in range(4)]), 256)
                       .alias("snapshot_hash"), F.col("n").cast("long").alias("rows"))


def balance_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardised mean difference (treatment minus control) per numeric covariate."""
    aggs, outs = [], {}
    for i, c in enumerate(columns):
        outs[c] = {}
        for arm in ("treatment", "control"):
            x = F.when(F.col("arm") == arm, no_nan(col(c).cast("double")))
            for name, e in (("n", F.count(x)), ("m", F.avg(x)), ("v", F.var_samp(x))):
                aggs.append(e.alias(f"{name}{i}{arm}"))
                outs[c][f"{name}_{arm}"] = f"{name}{i}{arm}"
    s = spread(df.agg(*aggs), outs, "covariate")
    gap = F.col("m_treatment") - F.col("m_control")
    pooled = F.sqrt((F.col("v_treatment") + F.col("v_control")) / 2)
    smd = (F.when((F.col("n_treatment") < 2) | (F.col("n_control") < 2), None)
           .when(pooled == 0, F.when(gap == 0, 0.0)).otherwise(gap / pooled))
    return _flagged(s.select("covariate", F.lit(None).cast("string").alias("level"),
                             smd.alias("smd"), F.col("m_treatment").alias("treatment_mean"),
                             F.col("m_control").alias("control_mean")))


def balance_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One difference in proportions per level."""
    long = tall(df, {c: col(c).cast("string") for c in columns}, ("covariate", "level"),
                keep=["arm"]).where("level is not null")
    counts = long.groupBy("covariate", "level").agg(
        F.count_if(F.col("arm") == "treatment").alias("t"),
        F.count_if(F.col("arm") == "control").alias("c"))
    totals = F.broadcast(counts.groupBy("covariate").agg(F.sum("t").alias("nt"),
                                                         F.sum("c").alias("nc")))
    pt, pc = ratio(F.col("t"), F.col("nt")), ratio(F.col("c"), F.col("nc"))
    pooled = F.sqrt((pt * (1 - pt) + pc * (1 - pc)) / 2)
    both = (F.col("nt") > 0) & (F.col("nc") > 0)
    smd = F.when(both, F.when(pooled == 0, 0.0).otherwise((pt - pc) / pooled))
    return _flagged(counts.join(totals, "covariate").select(
        "covariate", "level", smd.alias("smd"), F.when(both, pt).alias("treatment_mean"),
        F.when(both, pc).alias("control_mean")))


def _flagged(df: DataFrame) -> DataFrame:
    return df.withColumn("flagged", F.coalesce(F.abs("smd") > SMD_LIMIT, F.lit(False)))


def apply_segment(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    return df.where(segment_predicate(df, filters))


def segment_membership(df: DataFrame, segments: dict[str, Sequence[Filter]]) -> DataFrame:
    """Adds `segments`: the names of the pre-registered segments a row belongs to."""
    names = [F.when(segment_predicate(df, f), F.lit(n)) for n, f in segments.items()]
    empty = F.array().cast("array<string>")
    return df.withColumn("segments", F.array_compact(F.array(*names)) if names else empty)


def experiment_customers(clean: DataFrame, predictions: DataFrame, id_column: str,
                         row_id: str | None = None) -> DataFrame:
    """Cleaned rows joined to the first (highest) prediction, one row per customer."""
    first = predictions.groupBy(F.col("customer_id").cast("string").alias("customer_id")).agg(
        F.max(F.struct("churn_probability", "risk_band", "actual_churn")).alias("_p"))
    keyed = clean.withColumn("customer_id", col(id_column).cast("string"))
    if row_id is not None:
        rest = [c for c in keyed.columns if c != "customer_id"]
        keyed = keyed.groupBy("customer_id").agg(
            F.min_by(F.struct(*map(col, rest)), col(row_id)).alias("_r")).select(
            "customer_id", "_r.*")
    return keyed.join(first, "customer_id").select(
        *[keyed[c] for c in keyed.columns if c not in ("churn_probability", "risk_band",
                                                      "actual_churn")],
        "_p.churn_probability", "_p.risk_band", "_p.actual_churn")


def exclude_busy(df: DataFrame, assignments: DataFrame, experiments: DataFrame,
                 experiment_id: int) -> DataFrame:
    """Leave out customers in another running experiment that is no demonstration."""
    live = experiments.where(
        F.col("status").isin(*ACTIVE) & ~F.col("demo") & (F.col("experiment_id") != experiment_id)
    ).select("experiment_id")
    busy = assignments.join(live, "experiment_id", "left_semi").select("customer_id")
    return df.join(busy, "customer_id", "left_anti")


def assign_experiment(customers: DataFrame, experiment_id: int, control_share: float,
                      filters: Sequence[Filter] = (),
                      segments: dict[str, Sequence[Filter]] | None = None,
                      assignments: DataFrame | None = None,
                      experiments: DataFrame | None = None) -> DataFrame:
    """The assignment table of one experiment; write it partitioned by experiment_id."""
    eligible = apply_segment(customers, filters)
    if assignments is not None and experiments is not None:
        eligible = exclude_busy(eligible, assignments, experiments, experiment_id)
    marked = segment_membership(eligible, segments or {})
    out = assign_arms(marked, experiment_id, "customer_id", control_share)
    return out.withColumn("experiment_id", F.lit(experiment_id).cast("long"))


def assignment_warnings(assigned: DataFrame, balance: DataFrame, need_treatment: int,
                        need_control: int, segment_customers: int) -> list[str]:
    """Under-powered arms, customers left out and covariates that differ."""
    counts = {r["arm"]: r["n"] for r in
              assigned.groupBy("arm").agg(F.count("*").alias("n")).collect()}
    t, c = counts.get("treatment", 0), counts.get("control", 0)
    out = []
    if t < need_treatment or c < need_control:
        out.append(f"Under-powered: {t:,} treatment / {c:,} control assigned, but the design "
                   f"needs {need_treatment:,} / {need_control:,}.")
    if segment_customers > t + c:
        out.append(f"{segment_customers - t - c:,} segment customers were left out because they "
                   "are already in another running experiment.")
    bad = [r["covariate"] + ("" if r["level"] is None else f"={r['level']}")
           for r in balance.where("flagged").orderBy("covariate", "level").collect()]
    if bad:
        out.append(f"Groups differ on {', '.join(bad)} (|SMD| > {SMD_LIMIT}).")
    return out


def write_assignment(assigned: DataFrame, path: str) -> None:
    assigned.write.mode("append").partitionBy("experiment_id").parquet(path)


def segment_options(df: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """What a filter builder can offer: a range per numeric column, levels otherwise (all, or the
    `most` common ones)."""
    numeric = [c for c in columns if df.schema[c].dataType.typeName()
               in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    if numeric:
        ends = df.agg(*[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(numeric)
                        for k, f in (("a", F.min), ("b", F.max))]).first()
        more = df.agg(*[F.bool_or((col(c) > ends[f"a{i}"]) & (col(c) < ends[f"b{i}"])).alias(f"m{i}")
                        if ends[f"a{i}"] is not None else F.lit(False).alias(f"m{i}")
                        for i, c in enumerate(numeric)]).first()
        numeric = [c for i, c in enumerate(numeric) if more[f"m{i}"]]
    words = [c for c in columns if c not in numeric]
    spark = df.sparkSession
    schema = ("column string, kind string, level string, n long, min double, max double")
    out = spark.createDataFrame([], schema)
    if words:
        counts = (tall(df, {c: col(c).cast("string") for c in words}, ("column", "level"))
                  .where("level is not null").groupBy("column", "level")
                  .agg(F.count("*").alias("n")))
        if most is not None:
            order = Window.partitionBy("column").orderBy(F.desc("n"), "level")
            counts = counts.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
        out = out.unionByName(counts.select(
            "column", F.lit("categorical").alias("kind"), "level", "n",
            F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max")))
    if numeric:
        row = df.agg(*[f(col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(numeric)
                       for k, f in (("a", F.min), ("b", F.max))])
        ends = spread(row, {c: {"min": f"a{i}", "max": f"b{i}"} for i, c in enumerate(numeric)})
        out = out.unionByName(ends.select(
            "column", F.lit("numeric").alias("kind"), F.lit(None).cast("string").alias("level"),
            F.lit(None).cast("long").alias("n"), "min", "max"))
    return out


def plan_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The text column that looks most like a plan or contract, hints in order of priority."""
    words = [c for c in candidates if df.schema[c].dataType.typeName() == "string"]
    return next((c for hint in PLAN_HINTS for c in words if hint in c.lower()), None)


def customer_value_estimate(customers: DataFrame, revenue: str, horizon: int = 12) -> DataFrame:
    return customers.agg((F.avg(no_nan(col(revenue).cast("double"))) * horizon)
                         .alias("customer_value"))
