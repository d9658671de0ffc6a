"""Next best offer from measured acceptance and retention.

Offers are few, so each customer's options are one array built in a projection: no customer-by-
offer cross product is ever shuffled or ranked with a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions.scalar import col, half_even, no_nan, offer_discount, smoothed
from keepwell.functions.stored import stored

# Defaults of the measured next best offer.
NO_OFFER = "No offer"
PROVEN, OBSERVED = "experiment-proven", "observational"
JOBS = 4  # models trained side by side


@dataclass(frozen=True)
class NboConfig:
    horizon_months: int = 12
    max_discount: float = 0.20
    decline_days: int = 30
    min_exposures: int = 50
    smoothing: float = 1.0
    bands: tuple[str, ...] = ("High", "Medium")
    measured_lift: dict[str, float] = field(default_factory=dict)  # lower-cased offer -> lift


def offer_rates(long: DataFrame, customers: DataFrame, strength: float = 1.0) -> DataFrame:
    """Smoothed acceptance and stay rates per (offer, segment) and, with a null segment, per
    offer: one aggregate over both grouping sets. `customers`: customer_id, segment, churned."""
    j = long.join(customers.select("customer_id", "segment", "churned"), "customer_id", "left")
    took, stays = F.col("accepted") == 1, F.col("churned") == 0
    g = j.groupingSets([["offer", "segment"], ["offer"]], "offer", "segment").agg(
        F.count("*").alias("shown"), F.count_if(took).alias("accepted"),
        F.count_if(took & stays).alias("stay_accepted"),
        F.count_if(~took & stays).alias("stay_declined"), F.grouping_id().alias("_level"))
    g = g.where((F.col("_level") != 0) | F.col("segment").isNotNull())
    return g.select("offer", "segment", "shown", "accepted",
                    smoothed(F.col("accepted"), F.col("shown"), strength).alias("p_accept"),
                    smoothed(F.col("stay_accepted"), F.col("accepted"), strength)
                    .alias("stay_if_accepted"),
                    smoothed(F.col("stay_declined"), F.col("shown") - F.col("accepted"), strength)
                    .alias("stay_if_declined"))


def retention_lift(rates: DataFrame, measured: dict[str, float] | None = None) -> DataFrame:
    gain = F.greatest(F.lit(0.0), F.col("stay_if_accepted") - F.col("stay_if_declined"))
    known = {k.lower(): v for k, v in (measured or {}).items()}
    if known:
        table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        gain = F.coalesce(F.element_at(table, F.lower("offer")), gain)
    return rates.withColumn("retention_lift", gain)


def offer_costs(long: DataFrame, customers: DataFrame, cost: str) -> DataFrame:
    """Mean cost among the acceptors of each offer, 0 when there is none."""
    j = long.join(customers.select("customer_id", no_nan(col(cost).cast("double")).alias("_c")),
                  "customer_id", "left")
    return j.groupBy("offer").agg(F.coalesce(
        F.avg(F.when(F.col("accepted") == 1, F.col("_c"))), F.lit(0.0)).alias("offer_cost"))


def customer_value(revenue: str | None, horizon: int = 12) -> Column:
    """Revenue over the horizon, or one customer when no revenue is known."""
    if revenue is None:
        return F.lit(1.0)
    return F.coalesce(no_nan(col(revenue).cast("double")), F.lit(0.0)) * horizon


def declined_recently(long: DataFrame, cutoffs: DataFrame | None = None, days: int = 30
                      ) -> DataFrame:
    """(customer, offer) pairs not to repeat. A decline with an unknown date counts as recent."""
    declined = long.where("accepted = 0")
    if cutoffs is not None:
        j = declined.join(cutoffs, "customer_id", "left")
    else:
        last = declined.agg(F.max("offer_date").alias("cutoff"))
        j = declined.crossJoin(F.broadcast(last))
    age = F.floor((F.unix_micros(F.col("cutoff").cast("timestamp"))
                   - F.unix_micros(F.col("offer_date").cast("timestamp"))) / F.lit(86_400_000_000))
    return j.where(age.isNull() | (age <= days)).select("customer_id", "offer")


def eligible_offers(catalog: DataFrame, max_discount: float = 0.20) -> DataFrame:
    """Offers without a too generous discount in their name."""
    share = F.coalesce(offer_discount("offer"), F.lit(0.0))
    return catalog.where(share <= max_discount + 1e-12)


def score_next_best_offers(customers: DataFrame, rates: DataFrame, costs: DataFrame | None,
                           declined: DataFrame | None, cfg: NboConfig = NboConfig(),
                           revenue: str | None = None,
                           acceptance: dict[str, str] | None = None) -> DataFrame:
    """Best offer, runner-up and inputs for every Medium or High risk customer.

    `customers`: customer_id, segment, churn_probability, risk_band[, revenue][, one column of
    predicted acceptance per offer named in `acceptance`]. Rates over all segments are one array of
    offers in one row, those of a segment one map, joined by segment; an offer without a cost costs
    nothing."""
    rated = retention_lift(rates, cfg.measured_lift).where(
        F.coalesce(offer_discount("offer"), F.lit(0.0)) <= cfg.max_discount + 1e-12)
    names = ("p_accept", "stay_if_accepted", "stay_if_declined", "retention_lift")
    whole = rated.where("segment IS NULL").select("offer", *names)
    if costs is None:
        whole = whole.withColumn("cost", F.lit(0.0))
    else:
        price = costs.groupBy(F.col("offer").alias("_o")).agg(F.min("offer_cost").cast("double").alias("cost"))
        whole = whole.join(price, F.col("offer") == F.col("_o"), "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    one = whole.agg(F.sort_array(F.collect_list(F.struct("offer", *names, "cost"))).alias("_all"))  # one row
    if whole.isEmpty():
        raise ValueError("no offer is eligible")
    each = rated.where("segment IS NOT NULL").groupBy(F.col("segment").alias("_segment")).agg(
        F.map_from_entries(F.collect_list(F.struct("offer", F.struct(*names)))).alias("_rates"))
    c = customers.where(F.col("risk_band").isin(*cfg.bands)).join(each, F.col("segment") == F.col("_segment"), "left")
    if declined is not None:
        refused = declined.groupBy("customer_id").agg(F.collect_set("offer").alias("_refused"))
        c = c.join(refused, "customer_id", "left")
    else:
        c = c.withColumn("_refused", F.lit(None).cast("array<string>"))
    c = c.withColumn("_value", customer_value(revenue, cfg.horizon_months)).crossJoin(one)
    p = F.col("churn_probability")
    predicted = F.create_map(*[x for o, name in acceptance.items() for x in (F.lit(o), col(name))]) if acceptance else None
    lifted = F.array(*map(F.lit, cfg.measured_lift)).cast("array<string>")

    def option(b: Column) -> Column:
        r = F.try_element_at("_rates", b["offer"])
        accept, modelled = F.coalesce(r["p_accept"], b["p_accept"]), F.lit(False)
        if predicted is not None:
            modelled = b["offer"].isin(*acceptance)
            accept = F.when(modelled, F.try_element_at(predicted, b["offer"])).otherwise(accept)
        lift, cost = F.coalesce(r["retention_lift"], b["retention_lift"]), b["cost"]
        ev = p * accept * lift * F.col("_value") - accept * cost
        return F.struct(
            (-ev).alias("rank"), b["offer"].alias("offer"), ev.alias("ev"), accept.alias("p_accept"),
            F.coalesce(r["stay_if_accepted"], b["stay_if_accepted"]).alias("stay_accepted"),
            F.coalesce(r["stay_if_declined"], b["stay_if_declined"]).alias("stay_declined"),
            lift.alias("lift"), cost.alias("cost"),
            F.array_contains(lifted, F.lower(b["offer"])).alias("proven"), (~modelled).alias("low_data"))

    allowed = F.filter(F.transform("_all", option), lambda x: ~F.coalesce(
        F.array_contains("_refused", x["offer"]), F.lit(False)))
    c = c.withColumn("_options", F.sort_array(allowed))
    best, second = F.get("_options", F.lit(0)), F.get("_options", F.lit(1))
    has = F.coalesce(best["ev"] > 0, F.lit(False))
    two = has & F.coalesce(second["ev"] > 0, F.lit(False))

    def chosen(name: str) -> Column:
        return F.when(has, best[name])

    return c.select(
        "customer_id", F.when(has, best["offer"]).otherwise(NO_OFFER).alias("best_offer"),
        F.when(has, half_even(best["ev"], 4)).otherwise(0.0).alias("expected_value"),
        F.when(two, second["offer"]).alias("runner_up"),
        F.when(two, half_even(second["ev"], 4)).alias("runner_up_value"), p.alias("p_churn"),
        chosen("p_accept").alias("p_accept"), chosen("stay_accepted").alias("p_stay_if_accepted"),
        chosen("stay_declined").alias("p_stay_if_declined"), chosen("lift").alias("retention_lift"),
        F.when(has, F.when(best["proven"], PROVEN).otherwise(OBSERVED)).alias("evidence"),
        half_even(F.col("_value"), 2).alias("customer_value"),
        F.when(has, half_even(best["cost"], 2)).alias("offer_cost"),
        F.coalesce(chosen("low_data"), F.lit(False)).alias("low_data"),
        F.size("_options").alias("eligible_offers"),
        F.when(~has, F.when(F.size("_options") > 0,
                            "every eligible offer has a negative expected value")
               .otherwise("no eligible offers")).alias("no_offer_reason"))


def nbo_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("best_offer").agg(F.count("*").alias("customers"),
                                            F.sum("expected_value").alias("expected_value"))


def excluded_by_discount(catalog: DataFrame, max_discount: float = 0.20) -> DataFrame:
    kept = F.broadcast(eligible_offers(catalog, max_discount).select("offer"))
    return catalog.select("offer").join(kept, "offer", "left_anti")


def acceptance_models(data: DataFrame, long: DataFrame, numeric: Sequence[str],
                      categorical: Sequence[str], id_column: str = "customer_id",
                      cfg: NboConfig = NboConfig()) -> tuple[DataFrame, DataFrame]:
    """(customers with one predicted-acceptance column per modelled offer, table of the models).

    Offers shown at least `min_exposures` times with both outcomes get an unweighted logistic
    model on the customer features; the others keep the smoothed segment rate. Customers meet what they were
    shown once, for all offers; every fit reads its offer from that table."""
    from keepwell.operators import model as ml

    long = stored(long.select("offer", "customer_id", "accepted"))

    catalog = long.groupBy("offer").agg(F.count("*").alias("shown"),
                                        F.sum("accepted").alias("accepted"))
    offers = catalog.orderBy("offer").collect()  # one short row per offer
    seen = long.select(F.col("offer").alias("_offer"), F.col("customer_id").cast("string").alias("_shown_to"), "accepted")
    features = dict.fromkeys([id_column, *numeric, *categorical])
    shown = stored(data.select(*map(col, features)).join(
        seen, data[id_column].cast("string") == seen["_shown_to"]).drop("_shown_to"))

    def trained(r):
        if r["shown"] < cfg.min_exposures or not 0 < r["accepted"] < r["shown"]:
            return None, None
        train = shown.where(F.col("_offer") == r["offer"])
        same = dict(learner="logistic", balanced=False)
        return (ml.fit(train, numeric, categorical, "accepted", **same),
                ml.cross_validated_auc(train, numeric, categorical, "accepted", id_column, **same))

    with ThreadPoolExecutor(JOBS) as pool:
        found = list(pool.map(trained, offers))
    rows, scored = [], data
    for i, (r, (fitted, auc)) in enumerate(zip(offers, found)):
        name = f"accept_{i}" if fitted else None
        if fitted:
            scored = ml.score(fitted, scored, name)
        rows.append((r["offer"], r["shown"], r["accepted"], name, auc, fitted is None))
    table = data.sparkSession.createDataFrame(
        rows, "offer string, shown long, accepted long, column string, roc_auc double, "
        "low_data boolean")
    return scored, table
