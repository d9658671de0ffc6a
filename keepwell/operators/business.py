"""Money from assumptions: revenue at risk, expected saving, best offer, return by segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.functions.scalar import col, no_nan, ratio
from keepwell.operators.design import plan_columns
from keepwell.operators.filters import is_numeric_column, number
from keepwell.sources.catalogue import Offer, Rule

# Months of revenue, their range, the default lift to detect, rows of the top list.
NO_OFFER = "No offer"
DEFAULT_MONTHS = 12
MONTHS_RANGE = (1, 60)
DEFAULT_LIFT = 0.2
TOP_OFFERS = 50
TERMS = ("acceptance", "save_rate", "cost")


def check_months(months: float) -> None:
    if not MONTHS_RANGE[0] <= months <= MONTHS_RANGE[1]:
        raise ValueError(f"months must be between {MONTHS_RANGE[0]} and {MONTHS_RANGE[1]}.")


def amount(name: str) -> Column:
    return F.coalesce(no_nan(col(name).cast("double")), F.lit(0.0))


def revenue_at_risk(df: DataFrame, p: str, revenue: str, months: float = DEFAULT_MONTHS
                    ) -> DataFrame:
    check_months(months)
    return df.withColumn("revenue_at_risk", col(p) * amount(revenue) * months)


def expected_saving(p: Column, arpu: Column, months: float, offer: Offer) -> Column:
    return p * offer.acceptance * offer.save_rate * arpu * months - expected_cost(offer)


def expected_cost(offer: Offer) -> float:
    return offer.acceptance * offer.cost if offer.cost_basis == "per_accepted" else offer.cost


def rule_predicate(df: DataFrame, rule: Rule) -> Column:
    """One eligibility rule as a predicate (false for nulls)."""
    if rule.risk_band:
        hit = F.col("risk_band").isin(*rule.risk_band)
    elif rule.values:
        numbers = [number(v) for v in rule.values]
        if is_numeric_column(df, rule.column) and all(x is not None for x in numbers):
            hit = col(rule.column).cast("double").isin(*numbers)
        else:
            hit = col(rule.column).cast("string").isin(*[str(v) for v in rule.values])
    else:
        x = col(rule.column).try_cast("double")
        hit = x.isNotNull()
        hit = hit & (x >= rule.low) if rule.low is not None else hit
        hit = hit & (x <= rule.high) if rule.high is not None else hit
    return F.coalesce(hit, F.lit(False))


def eligibility(df: DataFrame, offers: Sequence[Offer]) -> tuple[dict[str, Column], list[str]]:
    """({offer: predicate}, warnings). Offers whose rules name an absent column are skipped."""
    out, warnings = {}, []
    for o in offers:
        absent = sorted({r.column for r in o.rules if r.column and r.column not in df.columns})
        if absent:
            warnings.append(f"Offer '{o.name}' skipped: its rules use {', '.join(absent)}, which "
                            "is not in this data.")
            continue
        ok = F.lit(True)
        for r in o.rules:
            ok = ok & rule_predicate(df, r)
        out[o.name] = ok
    return out, warnings


def eligible_pairs(df: DataFrame, offers: Sequence[Offer]) -> DataFrame:
    """customer_id, offer for every offer a customer may get."""
    ok, _ = eligibility(df, offers)
    names = F.array_compact(F.array(*[F.when(e, F.lit(n)) for n, e in ok.items()]))
    return df.select("customer_id", F.explode(names).alias("offer"))


def next_best_offer(df: DataFrame, p: str, revenue: str, offers: Sequence[Offer],
                    months: float = DEFAULT_MONTHS) -> DataFrame:
    """Best offer and runner-up by expected saving; ties go to the first in the catalogue. One
    projection over the customers: the offers are constants of the plan."""
    check_months(months)
    ok, _ = eligibility(df, offers)
    arpu, prob = amount(revenue), col(p)
    options = []
    for i, o in enumerate(o for o in offers if o.name in ok):
        s = expected_saving(prob, arpu, months, o)
        options.append(F.when(ok[o.name], F.struct(
            (-s).alias("rank"), F.lit(i).alias("place"), F.lit(o.name).alias("offer"),
            s.alias("saving"), F.lit(float(expected_cost(o))).alias("cost"))))
    kind = "array<struct<rank:double,place:int,offer:string,saving:double,cost:double>>"
    sorted_options = (F.sort_array(F.array_compact(F.array(*options))) if options
                      else F.array().cast(kind))
    out = df.withColumn("_options", sorted_options)
    best, second = F.get("_options", F.lit(0)), F.get("_options", F.lit(1))
    has = F.coalesce(best["saving"] > 0, F.lit(False))
    two = has & F.coalesce(second["saving"] > 0, F.lit(False))
    return out.select(
        *[c for c in df.columns], prob.alias("p_churn"), arpu.alias("arpu"),
        F.when(has, best["offer"]).otherwise(NO_OFFER).alias("best_offer"),
        F.when(has, best["saving"]).otherwise(0.0).alias("expected_saving"),
        F.when(has, best["cost"]).otherwise(0.0).alias("expected_cost"),
        F.size("_options").alias("eligible_offers"),
        F.when(two, second["offer"]).alias("runner_up"),
        F.when(two, second["saving"]).alias("runner_up_saving"))


def segment_key(plan: str | None = None) -> Column:
    band = F.col("risk_band").cast("string")
    return band if plan is None else F.concat_ws(" / ", band, col(plan).cast("string"))


def roi_by_segment(table: DataFrame, segment: Column) -> DataFrame:
    g = (table.where(F.col("best_offer") != NO_OFFER).groupBy(segment.alias("segment"))
         .agg(F.count("*").alias("customers"), F.sum("expected_saving").alias("total_saving"),
              F.sum("expected_cost").alias("total_cost")))
    return g.withColumn("roi", F.when(F.col("total_cost") > 0,
                                      F.col("total_saving") / F.col("total_cost"))
                        ).orderBy(F.desc("total_saving"))


def data_overrides(effectiveness: DataFrame, costs: DataFrame | None = None,
                   evidence: DataFrame | None = None) -> DataFrame:
    """Measured acceptance, save rate and cost per lower-cased offer; experiment evidence
    replaces what offer data suggest. One row per offer."""
    dec, acc = F.col("decliners_churn_rate"), F.col("acceptors_churn_rate")
    drop = F.when(dec > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (dec - acc) / dec)))
    obs = effectiveness.select(F.lower("offer").alias("key"), F.col("offer").alias("_offer"),
                               F.col("acceptance_rate").alias("acceptance"),
                               drop.alias("save_rate"))
    if costs is not None:
        c = costs.select(F.col("offer").alias("_offer"),
                         F.nullif("offer_cost", F.lit(0.0)).alias("cost"))
        obs = obs.join(F.broadcast(c), "_offer", "left")
    else:
        obs = obs.withColumn("cost", F.lit(None).cast("double"))
    obs = obs.drop("_offer")
    if evidence is None:
        return obs.withColumn("label", F.lit("observational"))
    lift = ratio(F.col("retention_lift_per_acceptor"), F.col("control_churn"))
    exp = evidence.select(F.lower("offer").alias("_key"), F.col("acceptance_rate").alias("_a"),
                          F.when(lift.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), lift)))
                          .alias("_s"))
    j = obs.join(exp, obs["key"] == exp["_key"], "full")
    return j.select(F.coalesce("key", "_key").alias("key"),
                    F.coalesce("_a", "acceptance").alias("acceptance"),
                    F.coalesce("_s", "save_rate").alias("save_rate"), "cost",
                    F.when(F.col("_key").isNotNull(), "experiment-proven")
                    .otherwise("observational").alias("label"))


def offer_terms(catalogue: DataFrame, overrides: DataFrame, user: DataFrame | None = None
                ) -> DataFrame:
    """Numbers in force and where each came from: user, then data, then catalogue."""
    o = overrides.select("key", *[F.col(t).alias(f"_d_{t}") for t in TERMS])
    j = catalogue.withColumn("key", F.lower("name")).join(o, "key", "left")
    if user is not None:
        u = user.select(F.lower("name").alias("key"), *[F.col(t).alias(f"_u_{t}") for t in TERMS])
        j = j.join(u, "key", "left")
    else:
        j = j.withColumns({f"_u_{t}": F.lit(None).cast("double") for t in TERMS})
    value = [F.coalesce(f"_u_{t}", f"_d_{t}", t).alias(t) for t in TERMS]
    source = [F.when(F.col(f"_u_{t}").isNotNull(), "user").when(F.col(f"_d_{t}").isNotNull(), "data")
              .otherwise("default").alias(f"{t}_source") for t in TERMS]
    return j.select("position", "name", "cost_basis", *value, *source)


def terms_to_offers(terms: DataFrame, catalogue: Sequence[Offer]) -> list[Offer]:
    """Catalogue entries with the numbers in force (one row per offer)."""
    from dataclasses import replace

    rows = {r["name"]: r for r in terms.collect()}
    return [replace(o, **{t: rows[o.name][t] for t in TERMS}) for o in catalogue]


def assumptions_block(terms: DataFrame, months: float, months_source: str) -> DataFrame:
    """Every number used: name, value, unit, source."""
    spark: SparkSession = terms.sparkSession
    first = spark.createDataFrame([("months_remaining", float(months), "months", months_source)],
                                  "name string, value double, unit string, source string")
    rows = F.array(*[F.struct(
        F.concat(F.col("name"), F.lit(f": {label}")).alias("name"), F.col(t).alias("value"),
        (F.regexp_replace("cost_basis", "_", " ") if t == "cost" else F.lit("share")).alias("unit"),
        F.col(f"{t}_source").alias("source"))
        for t, label in (("acceptance", "acceptance"), ("save_rate", "save rate"), ("cost", "cost"))])
    return first.unionByName(terms.select(F.explode(rows).alias("r")).select("r.*"))


def business_kpis(table: DataFrame, months: float = DEFAULT_MONTHS) -> DataFrame:
    has = F.col("best_offer") != NO_OFFER
    saving = F.coalesce(F.sum(F.when(has, F.col("expected_saving"))), F.lit(0.0))
    cost = F.coalesce(F.sum(F.when(has, F.col("expected_cost"))), F.lit(0.0))
    return table.agg(
        F.sum(F.col("p_churn") * F.col("arpu") * months).alias("revenue_at_risk"),
        saving.alias("expected_saving"), F.count_if(has).alias("customers_with_offer"),
        F.count("*").alias("customers_scored"),
        F.when(cost > 0, saving / cost).alias("overall_roi"))


def by_offer(table: DataFrame) -> DataFrame:
    return (table.where(F.col("best_offer") != NO_OFFER).groupBy("best_offer")
            .agg(F.count("*").alias("customers"), F.sum("expected_saving").alias("expected_saving"),
                 F.sum("expected_cost").alias("expected_cost")))


def top_offers(table: DataFrame, limit: int = TOP_OFFERS) -> DataFrame:
    return table.orderBy(F.desc("expected_saving"), "customer_id").limit(limit)


def ab_plan(table: DataFrame, y: str, lift: float = DEFAULT_LIFT, alpha: float = 0.05,
            power: float = 0.8, segment: Column | None = None) -> DataFrame:
    """Test size per segment (default: customers with an offer), p1 = its observed churn rate."""
    if segment is None:
        table = table.where(F.col("best_offer") != NO_OFFER)
        segment = F.lit("customers with an offer")
    g = table.groupBy(segment.alias("segment")).agg(F.count("*").alias("segment_customers"),
                                                    F.avg(col(y)).alias("p1"))
    plan = plan_columns(F.col("p1"), lift, alpha, power)
    out = g.select("segment", "segment_customers", "p1", *[e.alias(n) for n, e in plan.items()])
    return out.withColumn("too_few", F.coalesce(F.col("segment_customers") < F.col("total_n"),
                                                F.lit(False)))
