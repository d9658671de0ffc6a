"""Experiment results: reading the file, checking it against the assignment, analysing it.

Every analysis aggregates all experiments at once, one row per experiment (or per experiment and
segment); only those rows are turned into probabilities.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell.functions.dist import normal_quantile, normal_sf2
from keepwell.functions.scalar import col, no_nan, ratio, wilson
from keepwell.operators.hypothesis import benjamini_hochberg

# Required and optional columns, flag words, examples shown, split threshold,
# arm-interval level.
REQUIRED = ("customer_id", "group", "churned")
OPTIONAL = ("offer_accepted", "revenue", "complaints", "churn_date")
ONE_WORDS = ("1", "true", "yes", "1.0")
ZERO_WORDS = ("0", "false", "no", "0.0")
EXAMPLES = 5
SRM_LIMIT = 0.001
Z95 = 1.959963984540054
ARMS = ("treatment", "control")


class ResultsError(ValueError):
    """The results file cannot be used."""


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Normal probability of each |z|; runs on aggregated rows only."""
    return z.map(lambda x: None if pd.isna(x) else normal_sf2(x))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every cell as text and lower-cased headers."""
    raw = spark.read.csv(path, header=True, inferSchema=False, nullValue=None, emptyValue="")
    names = [c.strip().lstrip("﻿").lower() for c in raw.columns]
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ResultsError(f"Missing required columns: {', '.join(missing)}.")
    return raw.toDF(*names)


def flag_word(name: str) -> Column:
    text = F.lower(F.trim(col(name)))
    return F.when(text.isin(*ONE_WORDS), 1).when(text.isin(*ZERO_WORDS), 0)


def normalise_results(raw: DataFrame) -> DataFrame:
    """Typed results beside the text they came from (missing optional columns are blank)."""
    df = raw
    for c in OPTIONAL:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    df = df.withColumns({c: F.coalesce(col(c), F.lit("")) for c in (*REQUIRED, *OPTIONAL)})
    arm = F.lower(F.trim("group"))
    treated = arm == "treatment"
    accepted = F.when(F.trim("offer_accepted") == "", 0).otherwise(flag_word("offer_accepted"))
    return df.select(
        F.trim("customer_id").alias("customer_id"), arm.alias("arm"),
        flag_word("churned").alias("churned"),
        F.when(treated, accepted).alias("offer_accepted"),
        (~treated & F.coalesce(flag_word("offer_accepted") == 1, F.lit(False)))
        .alias("_control_took"),
        (treated & accepted.isNull()).alias("_bad_accept"),
        *[no_nan(F.trim(c).try_cast("double")).alias(c) for c in ("revenue", "complaints")],
        *[((F.trim(c) != "") & no_nan(F.trim(c).try_cast("double")).isNull()).alias(f"_bad_{c}")
          for c in ("revenue", "complaints")],
        F.try_to_timestamp(F.trim("churn_date"), F.lit("yyyy-MM-dd")).cast("date")
        .alias("churn_date"))


# Checks and whether each rejects the file.
CHECKS = {
    "duplicate_id": True, "bad_group": True, "never_assigned": True, "missing_from_file": False,
    "wrong_arm": True, "bad_churned": True, "bad_offer_accepted": True, "control_accepted": True,
    "bad_revenue": True, "bad_complaints": True, "negative_complaints": True,
    "churn_date_outside_window": True,
}


def check_results(results: DataFrame, assignment: DataFrame, planned_start: dt.date | None = None,
                  window_days: int = 30) -> DataFrame:
    """check, rejects, n, examples: every kind of row that does not fit the assignment.

    Each row lists the checks it fails, so one join and one small count cover all of them; only
    the five first ids per check are ever kept."""
    a = assignment.select(F.col("customer_id").cast("string").alias("_id"),
                          F.col("arm").alias("_arm"))
    copies = results.groupBy("customer_id").agg(F.count("*").alias("_n"))
    repeated = copies.where("_n > 1").select("customer_id", F.lit("duplicate_id").alias("check"))
    j = results.join(a, results["customer_id"] == a["_id"], "full")
    given = F.col("customer_id").isNotNull()
    good_arm = F.col("arm").isin(*ARMS)

    def fails(name: str, cond: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(name))

    tests = [
        fails("bad_group", given & ~good_arm),
        fails("missing_from_file", ~given),
        fails("wrong_arm", given & F.col("_id").isNotNull() & good_arm
              & (F.col("arm") != F.col("_arm"))),
        fails("bad_churned", given & F.col("churned").isNull()),
        fails("bad_offer_accepted", F.col("_bad_accept")),
        fails("control_accepted", F.col("_control_took")),
        fails("bad_revenue", F.col("_bad_revenue")),
        fails("bad_complaints", F.col("_bad_complaints")),
        fails("negative_complaints", F.col("complaints") < 0)]
    if planned_start is not None:
        end = planned_start + dt.timedelta(days=window_days)
        tests.append(fails("churn_date_outside_window", (F.col("churned") == 1) & (
            (F.col("churn_date") < F.lit(planned_start)) | (F.col("churn_date") > F.lit(end)))))
    named = j.select(F.coalesce("customer_id", "_id").alias("customer_id"),
                     F.explode(F.array_compact(F.array(*tests))).alias("check"))
    known = copies.join(a, copies["customer_id"] == a["_id"], "left_anti").select(
        "customer_id", F.lit("never_assigned").alias("check"))
    bad = named.unionByName(repeated).unionByName(known)
    counts = bad.groupBy("check").agg(F.count("*").alias("n"))
    first = (bad.distinct().withColumn("_k", F.row_number().over(
        Window.partitionBy("check").orderBy("customer_id"))).where(F.col("_k") <= EXAMPLES)
        .groupBy("check").agg(F.array_sort(F.collect_list("customer_id")).alias("examples")))
    kinds = F.broadcast(results.sparkSession.createDataFrame(
        list(CHECKS.items()), "check string, rejects boolean"))
    return kinds.join(F.broadcast(counts), "check").join(F.broadcast(first), "check")


def outcome_rows(results: DataFrame, experiment_id: int) -> DataFrame:
    return results.select(F.lit(experiment_id).cast("long").alias("experiment_id"), "customer_id",
                          "arm", "offer_accepted", "churned", "revenue", "complaints")


def early_look(experiments: DataFrame, today: Column) -> DataFrame:
    """Experiments whose results came before their planned end."""
    end = F.coalesce("planned_end", F.date_add("planned_start", F.col("window_days")))
    return experiments.select("experiment_id", end.alias("ends"),
                              F.coalesce(today < end, F.lit(False)).alias("early_look"))


def arm_sums(outcomes: DataFrame, keys: Sequence[str] = ("experiment_id",)) -> DataFrame:
    """Everything later steps need, in one aggregate: sizes, churners, acceptors, guardrails."""
    aggs = []
    for a in ARMS:
        here = F.col("arm") == a
        aggs += [F.count_if(here).alias(f"n_{a}"),
                 F.sum(F.when(here, F.col("churned"))).alias(f"x_{a}")]
        for g in ("complaints", "revenue"):
            v = F.when(here, no_nan(col(g).cast("double")))
            aggs += [F.count(v).alias(f"{g}_n_{a}"), F.avg(v).alias(f"{g}_m_{a}"),
                     F.var_samp(v).alias(f"{g}_v_{a}")]
    took = (F.col("arm") == "treatment") & (F.col("offer_accepted") == 1)
    aggs += [F.count_if(took).alias("acceptors"),
             F.sum(F.when(took, F.col("churned"))).alias("x_acceptors")]
    return outcomes.groupBy(*map(col, keys)).agg(*aggs)


def analysis_frame(sums: DataFrame, designs: DataFrame) -> DataFrame:
    """Every statistic of every experiment as columns beside its sums. One row per experiment, one
    aggregate over the outcomes: the steps below only pick columns from here."""
    j = sums.join(designs, "experiment_id")
    n = F.col("n_treatment") + F.col("n_control")
    et, ec = n * (1 - F.col("control_share")), n * F.col("control_share")
    chi2 = F.pow(F.col("n_treatment") - et, 2) / et + F.pow(F.col("n_control") - ec, 2) / ec
    limit = normal_quantile(1 - SRM_LIMIT / 2) ** 2
    j = j.withColumns({
        "expected_treatment": et, "expected_control": ec, "chi2": chi2, "failed": chi2 > limit,
        "observed_control_share": ratio(F.col("n_control"), n)})
    j = j.withColumns(rate_comparison(j))
    nt = F.col("n_treatment")
    saved, low, high = -F.col("difference") * nt, -F.col("ci_high") * nt, -F.col("ci_low") * nt
    cost, value = F.col("offer_cost") * F.col("acceptors"), F.col("customer_value")
    j = j.withColumns({
        "customers_saved": saved, "saved_low": low, "saved_high": high,
        "acceptance_rate": ratio(F.col("acceptors"), nt), "total_offer_cost": cost,
        "net_value": saved * value - cost, "net_low": low * value - cost,
        "net_high": high * value - cost})
    j = j.withColumn("guards", F.filter(F.array(
        _guard("complaints", "complaints", "watch_complaints", "complaints_tolerance"),
        _guard("arpu", "revenue", "watch_arpu", "arpu_tolerance")),
        lambda g: g["watched"] & (g["n"] > 0)))
    return j.withColumn("breached", F.array_sort(F.transform(
        F.filter("guards", lambda g: g["breached"]), lambda g: g["guardrail"])))


def _guard(name: str, g: str, watch: str, tolerance: str) -> Column:
    nt, nc = F.col(f"{g}_n_treatment"), F.col(f"{g}_n_control")
    mt, mc = F.col(f"{g}_m_treatment"), F.col(f"{g}_m_control")
    vt, vc = F.col(f"{g}_v_treatment"), F.col(f"{g}_v_control")
    ok = (nt > 1) & (nc > 1)
    half = F.when(ok, F.col("z") * F.sqrt(vt / nt + vc / nc))
    d = F.when(ok, mt - mc)
    margin = F.col(tolerance) * F.abs(F.coalesce(mc, F.lit(0.0)))
    breach = (d - half > margin) if name == "complaints" else (d + half < -margin)
    reach_t = F.when(nt > 1, F.col("z") * F.sqrt(vt / nt))
    reach_c = F.when(nc > 1, F.col("z") * F.sqrt(vc / nc))
    return F.struct(
        F.lit(name).alias("guardrail"), F.col(watch).alias("watched"), (nt + nc).alias("n"),
        mt.alias("treatment_mean"), mc.alias("control_mean"),
        (mt - reach_t).alias("treatment_low"), (mt + reach_t).alias("treatment_high"),
        (mc - reach_c).alias("control_low"), (mc + reach_c).alias("control_high"),
        d.alias("difference"), (d - half).alias("ci_low"), (d + half).alias("ci_high"),
        F.coalesce(breach, F.lit(False)).alias("breached"))


def srm_check(sums: DataFrame, designs: DataFrame) -> DataFrame:
    """Chi-square of the arm sizes against the planned split; failed beyond the 0.1 % point."""
    return analysis_frame(sums, designs).select(
        "experiment_id", "n_treatment", "n_control", "expected_treatment", "expected_control",
        "observed_control_share", "chi2", "failed")


def rate_comparison(df: DataFrame, treated: tuple[str, str] = ("x_treatment", "n_treatment"),
                    control: tuple[str, str] = ("x_control", "n_control"), z: str = "z"
                    ) -> dict[str, Column]:
    """Rates with Wilson intervals (95 %), difference with its Newcombe interval at the design's
    level, relative lift and pooled z. Null when an arm is empty."""
    xt, nt, xc, nc = (F.nullif(col(c).cast("double"), F.lit(-1.0)) for c in (*treated, *control))
    nt, nc = F.nullif(nt, F.lit(0.0)), F.nullif(nc, F.lit(0.0))
    pt, pc = xt / nt, xc / nc
    lt95, ut95 = wilson(xt, nt, Z95)
    lc95, uc95 = wilson(xc, nc, Z95)
    lt, ut = wilson(xt, nt, col(z))
    lc, uc = wilson(xc, nc, col(z))
    both = nt.isNotNull() & nc.isNotNull()
    d = pt - pc
    pooled = (xt + xc) / (nt + nc)
    se = F.sqrt(pooled * (1 - pooled) * (1 / nt + 1 / nc))
    return {
        "treatment_rate": pt, "control_rate": pc,
        "treatment_low": F.when(nt.isNotNull(), lt95), "treatment_high": F.when(nt.isNotNull(), ut95),
        "control_low": F.when(nc.isNotNull(), lc95), "control_high": F.when(nc.isNotNull(), uc95),
        "difference": d,
        "ci_low": F.when(both, d - F.sqrt(F.pow(pt - lt, 2) + F.pow(uc - pc, 2))),
        "ci_high": F.when(both, d + F.sqrt(F.pow(ut - pt, 2) + F.pow(pc - lc, 2))),
        "relative_lift": F.when(pc > 0, d / pc),
        "z_stat": F.when((pooled > 0) & (pooled < 1), d / se)}


RATE_COLUMNS = ("treatment_rate", "control_rate", "treatment_low", "treatment_high", "control_low",
                "control_high", "difference", "ci_low", "ci_high", "relative_lift", "z_stat")


def compare_rates(sums: DataFrame, designs: DataFrame) -> DataFrame:
    """Intention-to-treat comparison per experiment."""
    return analysis_frame(sums, designs).select("experiment_id", *RATE_COLUMNS)


def per_protocol(sums: DataFrame, designs: DataFrame) -> DataFrame:
    """Acceptors against control: biased, a secondary view."""
    j = sums.join(designs.select("experiment_id", "z"), "experiment_id").where("acceptors > 0")
    cols = rate_comparison(j, ("x_acceptors", "acceptors"))
    return j.select("experiment_id", *[e.alias(n) for n, e in cols.items()])


def guardrails(sums: DataFrame, designs: DataFrame) -> DataFrame:
    """Mean per arm and interval of the difference; breached beyond the tolerated share of the
    control mean (complaints up, revenue down)."""
    return (analysis_frame(sums, designs).select("experiment_id", F.explode("guards").alias("g"))
            .select("experiment_id", "g.*").drop("watched", "n"))


def segment_breakdown(outcomes: DataFrame, designs: DataFrame) -> DataFrame:
    """Rates per pre-registered segment; corrected over the segments tested per experiment."""
    long = outcomes.select("*", F.explode("segments").alias("segment"))
    sums = arm_sums(long, ["experiment_id", "segment"])
    j = sums.join(designs.select("experiment_id", "z", "alpha"), "experiment_id")
    cols = rate_comparison(j)
    rows = j.select("experiment_id", "segment", "alpha",
                    (F.col("n_treatment") + F.col("n_control")).alias("n"),
                    *[e.alias(n) for n, e in cols.items()])
    tested = rows.withColumn("p_value", two_sided_p("z_stat"))
    out = benjamini_hochberg(tested, by=["experiment_id"])
    return out.withColumn("significant", F.coalesce(F.col("p_adjusted") < F.col("alpha"),
                                                    F.lit(False))).drop("alpha")


def experiment_impact(sums: DataFrame, designs: DataFrame) -> DataFrame:
    """Customers saved, acceptance and money, with the interval carried through."""
    return analysis_frame(sums, designs).select(
        "experiment_id", "customers_saved", "saved_low", "saved_high", "acceptors",
        "acceptance_rate", "total_offer_cost", "net_value", "net_low", "net_high")


def with_verdict(j: DataFrame) -> DataFrame:
    """Adds verdict, reasons and the extra sample an open test still needs."""
    good, bad = F.col("ci_high") < 0, F.col("ci_low") > 0
    value = F.col("net_value")
    breach = F.size("breached") > 0
    loses = F.coalesce(value < 0, F.lit(False))
    verdict = (F.when(F.col("failed"), "untrustworthy").when(bad | loses, "dont_ship")
               .when(good & F.coalesce(value > 0, F.lit(False)) & ~breach, "ship")
               .otherwise("inconclusive"))
    more_t = F.greatest(F.lit(0), F.col("need_treatment") - F.col("n_treatment"))
    more_c = F.greatest(F.lit(0), F.col("need_control") - F.col("n_control"))
    j = j.withColumn("verdict", verdict)
    v, open_end = F.col("verdict"), (F.col("verdict") == "inconclusive") & ~good
    reasons = F.array_compact(F.array(
        F.when(v == "untrustworthy", "arms are not split as planned"),
        F.when((v == "dont_ship") & bad, "churn rose: the whole interval lies above zero"),
        F.when((v == "dont_ship") & loses, "net value is below zero"),
        F.when(v == "ship", "churn fell at a gain, within all guardrails"),
        F.when(open_end, "the interval leaves the sign of the change open"),
        F.when((v == "inconclusive") & value.isNull(), "no net value: customer value or cost is missing"),
        F.when((v == "inconclusive") & breach,
               F.concat(F.lit("guardrails crossed: "), F.array_join("breached", ", "))),
        F.when(open_end & (more_t == 0) & (more_c == 0),
               "planned size reached: what is left to find is below the planned effect")))
    return j.withColumns({"reasons": reasons, "extra_treatment": F.when(open_end, more_t),
                          "extra_control": F.when(open_end, more_c)})


def decision_helper(sums: DataFrame, designs: DataFrame) -> DataFrame:
    """A suggestion per experiment with its reasons; a person decides."""
    return with_verdict(analysis_frame(sums, designs)).select(
        "experiment_id", "verdict", "reasons", "breached", "extra_treatment", "extra_control")


def analyse(outcomes: DataFrame, designs: DataFrame) -> DataFrame:
    """One row per experiment: split check, comparison, impact and verdict. Calling it again with
    other designs re-uses the same outcomes with new assumptions."""
    j = with_verdict(analysis_frame(arm_sums(outcomes), designs))
    return j.select(
        "experiment_id", "n_treatment", "n_control", F.col("chi2").alias("srm_chi2"),
        F.col("failed").alias("srm_failed"), *RATE_COLUMNS, "customers_saved", "saved_low",
        "saved_high", "acceptance_rate", "total_offer_cost", "net_value", "net_low", "net_high",
        "verdict", "reasons", two_sided_p(F.sqrt("chi2")).alias("srm_p"),
        two_sided_p("z_stat").alias("p_value"))


def offer_evidence(analysis: DataFrame, experiments: DataFrame) -> DataFrame:
    """Latest measured evidence per offer from decided experiments whose split held."""
    j = analysis.join(experiments.where((F.col("status") == "decided") & ~F.col("demo")),
                      "experiment_id").where(~F.col("srm_failed"))
    drop = F.col("control_rate") - F.col("treatment_rate")
    lift = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio(drop, F.col("acceptance_rate"))))
    lift = F.when(F.col("acceptance_rate") > 0, lift)
    rows = j.select("experiment_id", "offer", "decided_at",
                    F.col("treatment_rate").alias("treatment_churn"),
                    F.col("control_rate").alias("control_churn"), "difference", "ci_low",
                    "ci_high", "acceptance_rate", lift.alias("retention_lift_per_acceptor"))
    newest = Window.partitionBy(F.lower("offer")).orderBy(F.desc("decided_at"),
                                                          F.desc("experiment_id"))
    return (rows.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") == 1).drop("_k"))
