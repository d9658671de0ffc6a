"""The whole analysis of one customer table, as a chain of tables.

clean -> {describe, segment, survive, test} -> model -> {impact, offers} -> facts. The cleaned
table is written once and read back (columns pruned) by every later stage; independent stages are
submitted together; each result is one table under the output folder.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions.scalar import col
from keepwell.operators import describe, explain, facts, hypothesis, impact, metrics, model, nbo
from keepwell.operators import offers as offer_ops
from keepwell.operators import segment as segments
from keepwell.operators import survival
from keepwell.operators.clean import clean
from keepwell.roles import Roles
from keepwell.sources.files import read_table, write_table


@dataclass(frozen=True)
class Options:
    min_rows: int = 100
    starts: int = segments.STARTS
    ks: tuple[int, ...] = tuple(segments.K_RANGE)
    trees: int = 50
    learners: tuple[str, ...] = model.LEARNERS
    repeats: int = model.REPEATS
    high: float = 0.6
    medium: float = 0.3


def describe_stage(df: DataFrame, roles: Roles) -> dict[str, Callable[[], DataFrame]]:
    """The description tables as independent steps."""
    f, y = roles.features(df.columns), roles.target
    out = {"overview": lambda: describe.overview(df, y)}
    if f["numeric"]:
        out |= {"numeric_summary": lambda: describe.numeric_summary(df, f["numeric"], y),
                "histogram": lambda: describe.histogram(df, f["numeric"]),
                "correlation": lambda: describe.correlation_matrix(df, f["numeric"])}
    if f["categorical"]:
        out["category_rates"] = lambda: describe.category_rates(df, f["categorical"], y)
    if roles.time:
        out["tenure_bands"] = lambda: describe.tenure_bands(df, roles.time, y)
    return out


def survival_stage(df: DataFrame, roles: Roles) -> dict[str, DataFrame]:
    if not roles.time:
        return {}
    y, words = roles.target, roles.features(df.columns)["categorical"]
    usable = survival.durations(df, roles.time)
    curve = survival.kaplan_meier(usable, roles.time, y)
    out = {"survival_curve": survival.downsample(curve),
           "survival_summary": survival.survival_summary(curve)}
    if words:
        strength = survival.association(survival.level_counts(usable, words, y))
        picked = [r["variable"] for r in survival.pick_group_columns(strength).collect()]
        if picked:
            long = survival.by_level(usable, picked, roles.time, y)
            curves = survival.kaplan_meier(long, roles.time, y, ["variable", "level"])
            out["survival_by_level"] = survival.downsample(curves, ["variable", "level"])
            out["logrank"] = survival.logrank_tests(
                survival.logrank_counts(usable, picked, roles.time, y))
    return out


def run(df: DataFrame, roles: Roles, out: str, row_id: str = "row_id",
        options: Options = Options()) -> dict[str, str]:
    """Run every stage; returns {table: path}."""
    spark = df.sparkSession
    done: dict[str, str] = {}

    def keep(name: str, table: DataFrame) -> DataFrame:
        done[name] = f"{out}/{name}"
        write_table(table, done[name])
        return read_table(spark, done[name])

    cleaned = clean(df, roles, row_id, options.min_rows)
    keep("cleaning_log", cleaned.log)
    health = keep("data_health", cleaned.health)
    base = keep("clean", cleaned.frame)
    cleaned.release()
    y = roles.target
    key = roles.ids[0] if roles.ids else row_id
    f = roles.features(base.columns)
    numeric, words = f["numeric"], f["categorical"]

    extra, long = None, None
    if roles.offers:
        long = keep("offer_long", offer_ops.reshape_offers(base, roles.offers, key, row_id))
        people = base.select(col(key).cast("string").alias("customer_id"), col(y).alias("churned"))
        extra = offer_ops.offer_tests(long, people)

    def described() -> None:
        steps = describe_stage(base, roles)
        with ThreadPoolExecutor(len(steps)) as inner:
            list(inner.map(lambda item: keep(item[0], item[1]()), steps.items()))

    def segmented() -> DataFrame | None:
        result = segments.segment(base, numeric, key, roles.time, ks=options.ks,
                                  starts=options.starts)
        if result.frame is None:
            return None
        member = keep("segment_assignment", result.frame.select(key, "segment"))
        joined = base.select(key, y, *map(col, result.features)).join(member, key)
        scale = segments.scales(base, result.features)
        return keep("segment_profile", segments.segment_profile(
            joined, "segment", result.features, y, scale))

    def survived() -> None:
        for name, table in survival_stage(base, roles).items():
            keep(name, table)

    def tested() -> DataFrame:
        return keep("tests", hypothesis.run_tests(base, words, numeric, y, extra=extra))

    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(step) for step in (described, segmented, survived, tested)]
        results = [j.result() for j in jobs]
    profile, tests = results[1], results[3]

    trained = model.train_and_evaluate(base, numeric, words, y, key, learners=options.learners,
                                       trees=options.trees)
    evaluation = keep("model_metrics", trained.metrics)
    keep("cross_validation", trained.cv)
    test = trained.frame.where("is_test")
    long_scores = metrics.long_scores(test, y, {"raw": "p_raw", "calibrated": "p_calibrated"}, key)
    keep("deciles", metrics.deciles(long_scores))
    keep("calibration", metrics.calibration_bins(long_scores))
    train = trained.frame.where("not is_test")
    explained = explain.contributions(trained.fitted, trained.frame, train)
    predictions = keep("predictions", explain.score_customers(
        explained, trained.fitted, key, y, "p_raw", "p_calibrated", options.high, options.medium))
    strength = explain.global_importance(explained.where("is_test"), [*numeric, *words])
    odds, left_out = explain.odds_ratios(train, numeric, words, y)
    keep("odds_ratios", odds)
    keep("odds_ratio_terms_left_out", left_out)
    rank = model.permutation_importance(trained.fitted, test, y, key, options.repeats)
    drivers = keep("drivers", explain.driver_impact(rank, strength, odds, tests))

    significant = [r["variable"] for r in impact.significant_columns(tests).collect()]
    whole = impact.overall_impact(base, y, roles.revenue)
    if significant:
        items = impact.impact_by_level(base, significant, y, roles.revenue)
        keep("impact", impact.impact_top(items, whole))
    else:
        keep("impact", whole)

    parts = [facts.health_facts(health), facts.test_facts(tests), facts.driver_facts(drivers),
             facts.impact_facts(read_table(spark, done["impact"])),
             facts.model_facts(evaluation, explain.band_counts(predictions))]
    if profile is not None:
        parts.append(facts.segment_facts(profile))
    if long is not None:
        member = (read_table(spark, done["segment_assignment"]) if profile is not None else
                  base.select(key, F.lit(0).alias("segment")))
        money = [roles.revenue] if roles.revenue else []
        people = base.select(key, y, *money).join(member, key).select(
            col(key).cast("string").alias("customer_id"), "segment", col(y).alias("churned"), *money)
        effect = keep("offer_effectiveness", offer_ops.offer_effectiveness(long, people, "segment"))
        parts.append(facts.offer_facts(effect.where("scope = 'offer'")))
        ready = people.join(predictions.select("customer_id", "churn_probability", "risk_band"),
                            "customer_id")
        keep("next_best_offer", nbo.score_next_best_offers(
            ready, nbo.offer_rates(long, people), None, nbo.declined_recently(long),
            revenue=roles.revenue))
    keep("facts", facts.facts_table(parts))
    return done
