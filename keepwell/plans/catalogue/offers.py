"""Offer, next-best-offer, business, impact and ad-hoc queries."""

import datetime as dt

from pyspark.sql import functions as F

from keepwell.functions.scalar import col, formula_safe, offer_discount, risk_band
from keepwell.operators import adhoc as q
from keepwell.operators import business as b
from keepwell.operators import explain as x
from keepwell.operators import hypothesis as h
from keepwell.operators import impact as t
from keepwell.operators import nbo
from keepwell.operators import offers as o
from keepwell.operators.filters import Filter
from keepwell.plans import views as v
from keepwell.plans.catalogue.description import _LEVELS, base, rounded, with_wealth
from keepwell.plans.views import oracle
from keepwell.roles import OfferRoles
from keepwell.sources.catalogue import Offer, Rule, catalogue_frame

CATALOGUE = [
    Offer("Loyalty discount", 60000, 0.35, 0.5, rules=(Rule(risk_band=("High", "Medium")),)),
    Offer("Free month", 150000, 0.25, 0.6, rules=(Rule("segment", ("BUILDING", "MACHINERY")),)),
    Offer("Data booster", 20000, 0.45, 0.3),
    Offer("Priority support", 40000, 0.3, 0.4, rules=(Rule("balance", low=0, high=5000),)),
    Offer("Win-back call", 50000, 0.6, 0.25, "per_targeted", (Rule(risk_band=("High",)),)),
    Offer("Annual plan", 1, 0.9, 0.9, rules=(Rule("Contract", ("Month-to-month",)),)),
]
_TERMS = """terms(position, name, cost, basis, a, sv) AS (VALUES
  (0, 'Loyalty discount', 60000.0::DOUBLE, 'per_accepted', 0.35::DOUBLE, 0.5::DOUBLE),
  (1, 'Free month', 150000.0, 'per_accepted', 0.25, 0.6), (2, 'Data booster', 20000.0, 'per_accepted', 0.45, 0.3),
  (3, 'Priority support', 40000.0, 'per_accepted', 0.3, 0.4), (4, 'Win-back call', 50000.0, 'per_targeted', 0.6, 0.25))"""
_ELIGIBLE = """CASE position WHEN 0 THEN risk_band IN ('High', 'Medium')
  WHEN 1 THEN segment IN ('BUILDING', 'MACHINERY') WHEN 2 THEN true
  WHEN 3 THEN coalesce(balance BETWEEN 0 AND 5000, false) ELSE risk_band = 'High' END"""
_BASE = "bc AS (SELECT c.*, p.churn_probability, p.risk_band, p.actual_churn FROM customers c JOIN predictions p USING (customer_id))"
_SAVINGS = f"""{_BASE}, {_TERMS}, opt AS (SELECT customer_id, name, position,
    churn_probability * a * sv * coalesce(avg_order, 0) * 12 - CASE WHEN basis = 'per_accepted' THEN a * cost ELSE cost END AS s,
    CASE WHEN basis = 'per_accepted' THEN a * cost ELSE cost END AS ec FROM bc, terms WHERE {_ELIGIBLE}),
  rnk AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY s DESC, position) AS k,
    count(*) OVER (PARTITION BY customer_id) AS n FROM opt),
  nb AS (SELECT bc.customer_id, risk_band, segment, actual_churn, churn_probability AS p_churn,
    coalesce(avg_order, 0) AS arpu, CASE WHEN x.s > 0 THEN x.name ELSE 'No offer' END AS best_offer,
    CASE WHEN x.s > 0 THEN x.s ELSE 0 END AS expected_saving, CASE WHEN x.s > 0 THEN x.ec ELSE 0 END AS expected_cost,
    coalesce(x.n, 0)::INTEGER AS eligible_offers, CASE WHEN x.s > 0 AND y.s > 0 THEN y.name END AS runner_up,
    CASE WHEN x.s > 0 AND y.s > 0 THEN y.s END AS runner_up_saving
    FROM bc LEFT JOIN rnk x ON x.customer_id = bc.customer_id AND x.k = 1
    LEFT JOIN rnk y ON y.customer_id = bc.customer_id AND y.k = 2)"""
SNAP = dt.datetime(2001, 2, 1)
_RATES = """sh AS (SELECT l.*, c.segment, c.churned FROM offer_history l JOIN planted c USING (customer_id)),
  rt AS (SELECT offer, segment, count(*) AS shown, sum(accepted)::BIGINT AS accepted,
    (sum(accepted) + 1.0::DOUBLE) / (count(*) + 2) AS p_accept,
    (count(*) FILTER (accepted = 1 AND churned = 0) + 1.0::DOUBLE) / (sum(accepted) + 2) AS sa,
    (count(*) FILTER (accepted = 0 AND churned = 0) + 1.0::DOUBLE) / (count(*) - sum(accepted) + 2) AS sd
    FROM sh GROUP BY GROUPING SETS ((offer, segment), (offer)))"""
_EFF = """count(*) AS shown, sum(accepted)::BIGINT AS accepted, avg(accepted) AS acceptance_rate,
  count(*) FILTER (accepted = 1) AS acceptors_n, coalesce(sum(churned) FILTER (accepted = 1), 0)::BIGINT AS acceptors_churned,
  avg(churned) FILTER (accepted = 1) AS acceptors_churn_rate, count(*) FILTER (accepted = 0) AS decliners_n,
  coalesce(sum(churned) FILTER (accepted = 0), 0)::BIGINT AS decliners_churned,
  avg(churned) FILTER (accepted = 0) AS decliners_churn_rate"""
_DECLINED = "SELECT customer_id, offer FROM offer_history WHERE accepted = 0 AND date_diff('day', offer_date, TIMESTAMP '2001-02-01') <= 30"


def history(s, d):
    return v.offer_history(s, d)


def people(s, d):
    return base(s, d).select("customer_id", "segment", "churned")


def cutoffs(s, d):
    return v.table(s, d, "customer").select(F.col("c_custkey").alias("customer_id"),
                                            F.lit(SNAP).alias("cutoff"))


def by_name(s, d):
    """One row per offer shown, yes/no acceptance, some names in lower case."""
    k = col("customer_id")
    return history(s, d).select(
        (k * 10 + F.substring("offer", 1, 1).cast("long")).alias("row_id"), k.alias("id"),
        F.when(k % 20 == 0, F.lower("offer")).otherwise(F.concat(F.lit(" "), "offer")).alias("Offer"),
        F.when(col("accepted") == 1, "Yes").otherwise("no").alias("Accepted"),
        col("offer_date").alias("Sent"))


def by_list(s, d):
    """One row per customer with delimited lists of offers and of accepted offers."""
    g = history(s, d).groupBy("customer_id").agg(
        F.array_sort(F.collect_list("offer")).alias("o"),
        F.array_sort(F.collect_list(F.when(col("accepted") == 1, F.lower("offer")))).alias("a"))
    return g.select(col("customer_id").alias("row_id"), col("customer_id").alias("id"),
                    F.array_join("o", " ; ").alias("Offers"), F.array_join("a", "|").alias("Taken"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def by_column(s, d):
    """One 0/1 column per offer and one per acceptance."""
    g = history(s, d).groupBy("customer_id").agg(
        *[F.max(F.when(col("offer") == p, 1)).alias(p) for p in PRIORITIES],
        *[F.max(F.when(col("offer") == p, col("accepted"))).alias(f"{p} taken") for p in PRIORITIES])
    return g.withColumnsRenamed({"customer_id": "id"}).withColumn("row_id", col("id"))


def scored_customers(s, d):
    c = base(s, d)
    p = v.predictions(s, d).select("customer_id", "churn_probability", "risk_band", "actual_churn")
    return c.join(p, "customer_id")


def business_base(s, d):
    c = v.customers(s, d, returns=False)
    p = v.predictions(s, d).select("customer_id", "churn_probability", "risk_band", "actual_churn")
    return c.join(p, "customer_id")


def best(s, d):
    return b.next_best_offer(business_base(s, d), "churn_probability", "avg_order", CATALOGUE)


def _nbo(s, d):
    c = scored_customers(s, d)
    cost = c.withColumn("cost", 100.0 + col("customer_id") % 7)
    return nbo.score_next_best_offers(
        c, nbo.offer_rates(history(s, d), people(s, d)),
        nbo.offer_costs(history(s, d), cost, "cost"),
        nbo.declined_recently(history(s, d), cutoffs(s, d)), revenue="avg_order")


_NBO = f"""{_RATES}, lf AS (SELECT *, greatest(0, sa - sd) AS lift FROM rt),
  cost AS (SELECT offer, coalesce(avg(100.0::DOUBLE + customer_id % 7) FILTER (accepted = 1), 0) AS c
           FROM offer_history GROUP BY 1),
  op AS (SELECT c.customer_id, r.offer, r.p_accept, r.lift, cost.c,
      churn_probability * r.p_accept * r.lift * (coalesce(avg_order, 0) * 12) - r.p_accept * cost.c AS ev
    FROM planted c JOIN predictions p USING (customer_id) JOIN lf r ON r.segment = c.segment JOIN cost ON cost.offer = r.offer
    WHERE risk_band IN ('High', 'Medium') AND (c.customer_id, r.offer) NOT IN ({_DECLINED})),
  rk AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ev DESC, offer) AS k,
         count(*) OVER (PARTITION BY customer_id) AS n FROM op),
  nbo AS (SELECT c.customer_id, CASE WHEN x.ev > 0 THEN x.offer ELSE 'No offer' END AS best_offer,
      CASE WHEN x.ev > 0 THEN x.ev ELSE 0 END AS expected_value,
      CASE WHEN x.ev > 0 AND y.ev > 0 THEN y.offer END AS runner_up,
      CASE WHEN x.ev > 0 AND y.ev > 0 THEN y.ev END AS runner_up_value,
      CASE WHEN x.ev > 0 THEN x.p_accept END AS p_accept, CASE WHEN x.ev > 0 THEN x.lift END AS retention_lift,
      coalesce(x.n, 0)::INTEGER AS eligible_offers, CASE WHEN x.ev > 0 THEN NULL WHEN x.n > 0
        THEN 'every eligible offer has a negative expected value' ELSE 'no eligible offers' END AS no_offer_reason
    FROM (SELECT customer_id FROM predictions WHERE risk_band IN ('High', 'Medium')) c
    LEFT JOIN rk x ON x.customer_id = c.customer_id AND x.k = 1
    LEFT JOIN rk y ON y.customer_id = c.customer_id AND y.k = 2)"""


def _effectiveness(s, d):
    return o.offer_effectiveness(history(s, d), people(s, d))


def _user(s):
    return s.createDataFrame([("2-HIGH", None, 0.9, None)],
                             "name string, acceptance double, save_rate double, cost double")


def _offer_terms(s, d):
    names = [Offer(p, 100.0, 0.4, 0.5) for p in (*PRIORITIES, "6-NEW")]
    cost = people(s, d).withColumn("cost", 100.0 + col("customer_id") % 7)
    over = b.data_overrides(_effectiveness(s, d), nbo.offer_costs(history(s, d), cost, "cost"))
    return b.offer_terms(catalogue_frame(s, names), over, _user(s))


_OFFER_TERMS = f"""sh AS (SELECT l.*, c.churned FROM offer_history l JOIN planted c USING (customer_id)),
  ef AS (SELECT offer, avg(accepted) AS a, avg(churned) FILTER (accepted = 1) AS ca,
    avg(churned) FILTER (accepted = 0) AS cd, coalesce(avg(100.0::DOUBLE + customer_id % 7) FILTER (accepted = 1), 0) AS c
    FROM sh GROUP BY 1),
  ov AS (SELECT lower(offer) AS key, a AS acceptance, CASE WHEN cd > 0 THEN least(1, greatest(0, (cd - ca) / cd)) END
    AS save_rate, nullif(c, 0) AS cost FROM ef),
  names(position, name) AS (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'), (4, '5-LOW'), (5, '6-NEW')),
  tm AS (SELECT position, name, 'per_accepted' AS cost_basis, coalesce(acceptance, 0.4) AS acceptance,
    CASE WHEN name = '2-HIGH' THEN 0.9 ELSE coalesce(save_rate, 0.5) END AS save_rate, coalesce(cost, 100) AS cost,
    CASE WHEN acceptance IS NOT NULL THEN 'data' ELSE 'default' END AS acceptance_source,
    CASE WHEN name = '2-HIGH' THEN 'user' WHEN save_rate IS NOT NULL THEN 'data' ELSE 'default' END AS save_rate_source,
    CASE WHEN cost IS NOT NULL THEN 'data' ELSE 'default' END AS cost_source FROM names LEFT JOIN ov ON key = lower(name))"""


def _impact_levels(s, d):
    df = with_wealth(s, d)
    return t.impact_by_level(df, ["region", "segment", "nation", "wealth"], "churned", "avg_order")


_SCEN = "(VALUES ('reduce_10pct', 0.10::DOUBLE), ('reduce_25pct', 0.25::DOUBLE)) sc(scenario, sh)"


def _impact_sql(src, idexpr, kind, label, having):
    return f"""SELECT {idexpr} AS id, '{kind}' AS kind, {label} AS label, n AS customers, n / tn AS share,
    x::BIGINT AS churners, x / n AS churn_rate, (x / n) / tr AS lift, round_even(round(r, 6), 2) AS revenue_at_risk,
    scenario, round_even(x * sh, 1) AS churners_saved, round_even(round(r * sh, 6), 2) AS revenue_saved
    FROM {src}, (SELECT count(*) AS tn, avg(churned) AS tr FROM planted), {_SCEN} {having}"""


_G = """count(*) AS n, sum(churned) AS x, coalesce(sum(avg_order) FILTER (churned = 1), 0) AS r"""
_LEVEL_ITEMS = f"""lv AS (SELECT variable, level, {_G} FROM (SELECT region, segment, nation, CASE WHEN balance
  >= 5000 THEN 'rich' ELSE 'other' END AS wealth, churned, avg_order FROM planted) UNPIVOT (level FOR variable
  IN (region, segment, nation, wealth)) GROUP BY 1, 2), items AS ({_impact_sql('lv', "variable || '=' || level",
  'category', "variable || ' = ' || level", 'WHERE n >= 30 AND (x / n) / tr >= 1.1')})"""
_OVERALL = f"""ov AS (SELECT {_G} FROM planted), overall AS ({_impact_sql('ov', "'overall'", 'overall',
  "'All customers'", '')})"""


def _pred(s, d):
    return v.predictions(s, d)


def _small_nbo(s, d):
    return best(s, d).select("customer_id", "best_offer", F.col("expected_saving").alias("expected_value"),
                             "runner_up", F.col("runner_up_saving").alias("runner_up_value"))


QUERIES = {
    "reshape_offers_names": (
        lambda s, d: o.reshape_offers(by_name(s, d), OfferRoles("Offer", "Accepted", "Sent"), "id", "row_id"),
        oracle("offer_history", """SELECT customer_id::VARCHAR AS customer_id, offer, accepted, offer_date
  FROM offer_history""")),
    "reshape_offers_delimited": (
        lambda s, d: o.reshape_offers(by_list(s, d), OfferRoles("Offers", "Taken"), "id", "row_id")
        .drop("offer_date"),
        oracle("offer_history", """SELECT customer_id::VARCHAR AS customer_id, offer, accepted
  FROM offer_history""")),
    "reshape_offers_wide": (
        lambda s, d: o.reshape_offers(by_column(s, d), OfferRoles(
            PRIORITIES, tuple(f"{p} taken" for p in PRIORITIES)), "id", "row_id").drop("offer_date"),
        oracle("offer_history", """SELECT customer_id::VARCHAR AS customer_id, offer, accepted
  FROM offer_history""")),
    "canonical_offer_names": (
        lambda s, d: o.canonical_offers(by_name(s, d).select(
            "row_id", F.trim("Offer").alias("offer"))),
        oracle("offer_history", """SELECT customer_id * 10 + left(offer, 1)::BIGINT AS row_id, offer
  FROM offer_history""")),
    "offer_flag": (
        lambda s, d: by_name(s, d).select("row_id", o.flag("Accepted").alias("flag"),
                                          o.flag("Offer").alias("no_flag")),
        oracle("offer_history", """SELECT customer_id * 10 + left(offer, 1)::BIGINT AS row_id,
  accepted AS flag, NULL::INTEGER AS no_flag FROM offer_history""")),
    "offer_catalog": (
        lambda s, d: o.offer_catalog(history(s, d)),
        oracle("offer_history", """SELECT offer, count(*) AS customers_shown, sum(accepted)::BIGINT AS accepted
  FROM offer_history GROUP BY 1""")),
    "customers_offered": (
        lambda s, d: o.customers_offered(history(s, d)),
        oracle("offer_history", "SELECT count(DISTINCT customer_id) AS customers_offered FROM offer_history")),
    "drop_after_cutoff": (
        lambda s, d: o.drop_after_cutoff(history(s, d), cutoffs(s, d)),
        oracle("offer_history", "SELECT * FROM offer_history WHERE offer_date <= TIMESTAMP '2001-02-01'")),
    "offer_effectiveness": (
        _effectiveness,
        oracle("offer_history planted", f"""SELECT offer, {_EFF} FROM offer_history JOIN planted
  USING (customer_id) GROUP BY 1""")),
    "offer_effectiveness_by_segment": (
        lambda s, d: o.offer_effectiveness(history(s, d), people(s, d), "segment"),
        oracle("offer_history planted", f"""SELECT offer, segment, {_EFF}, CASE WHEN segment IS NULL THEN 'offer'
  ELSE 'segment' END AS scope FROM offer_history JOIN planted USING (customer_id)
  GROUP BY GROUPING SETS ((offer, segment), (offer))""")),
    "offer_test_counts": (
        lambda s, d: o.offer_counts(history(s, d), people(s, d)),
        oracle("offer_history planted", """SELECT offer,
  count(*) FILTER (accepted = 1 AND churned = 0) AS accepted_retained,
  count(*) FILTER (accepted = 1 AND churned = 1) AS accepted_churned,
  count(*) FILTER (accepted = 0 AND churned = 0) AS declined_retained,
  count(*) FILTER (accepted = 0 AND churned = 1) AS declined_churned
  FROM offer_history JOIN planted USING (customer_id) GROUP BY 1 HAVING count(*) >= 20""")),
    "offer_tests": (lambda s, d: h.run_tests(with_wealth(s, d), ["region", "segment"], ["balance"],
                                             "churned", extra=o.offer_tests(history(s, d), people(s, d))),
                    None),
    "never_offered": (
        lambda s, d: o.never_offered(people(s, d), history(s, d)),
        oracle("offer_history planted", """SELECT customer_id IN (SELECT customer_id FROM offer_history) AS offered, count(*) AS n, sum(churned)::BIGINT AS churned,
  avg(churned) AS churn_rate FROM planted GROUP BY 1""")),
    "selection_bias": (
        lambda s, d: rounded(o.selection_bias(_pred(s, d), history(s, d)),
                             "offered_mean_risk", "never_offered_mean_risk", "gap"),
        oracle("offer_history predictions", """SELECT round(a, 9) AS offered_mean_risk,
  round(b, 9) AS never_offered_mean_risk, round(a - b, 9) AS gap, a - b >= 0.05 AS flagged FROM (
  SELECT avg(churn_probability) FILTER (o) AS a, avg(churn_probability) FILTER (NOT o) AS b FROM (
  SELECT churn_probability, customer_id IN (SELECT customer_id FROM offer_history) AS o
  FROM predictions))""")),
    "offer_discount": (
        lambda s, d: v.table(s, d, "orders").select(F.concat_ws(
            "", "o_orderpriority", F.lit(" "), (col("o_orderkey") % 45).cast("string"),
            F.lit("% Discount")).alias("offer")).distinct().transform(lambda t: t.select(
                "offer", offer_discount("offer").alias("discount")).join(
                    nbo.eligible_offers(t).withColumn("_in", F.lit(True)), "offer", "left").select(
                        "offer", "discount", F.coalesce("_in", F.lit(False)).alias("eligible"))),
        """SELECT DISTINCT o_orderpriority || ' ' || (o_orderkey % 45) || '% Discount' AS offer,
  (o_orderkey % 45)::DOUBLE / 100 AS discount, (o_orderkey % 45)::DOUBLE / 100 <= 0.2 AS eligible FROM orders"""),
    "discount_cap": (
        lambda s, d: nbo.eligible_offers(history(s, d).select(F.concat_ws(
            "", "offer", F.lit(" "), (col("customer_id") % 45).cast("string"), F.lit("% off"))
            .alias("offer")).distinct()),
        oracle("offer_history", """SELECT DISTINCT offer || ' ' || (customer_id % 45) || '% off' AS offer
  FROM offer_history WHERE customer_id % 45 <= 20""")),
    "segment_acceptance": (
        lambda s, d: rounded(nbo.offer_rates(history(s, d), people(s, d)).select(
            "offer", "segment", "shown", "accepted", "p_accept"), "p_accept"),
        oracle("offer_history planted", f"""WITH {_RATES} SELECT offer, segment, shown, accepted,
  round(p_accept, 9) AS p_accept FROM rt""")),
    "stay_rates": (
        lambda s, d: rounded(nbo.offer_rates(history(s, d), people(s, d)).select(
            "offer", "segment", "stay_if_accepted", "stay_if_declined"), "stay_if_accepted",
            "stay_if_declined"),
        oracle("offer_history planted", f"""WITH {_RATES} SELECT offer, segment, round(sa, 9) AS stay_if_accepted,
  round(sd, 9) AS stay_if_declined FROM rt""")),
    "retention_lift": (
        lambda s, d: rounded(nbo.retention_lift(nbo.offer_rates(history(s, d), people(s, d)),
                                                {"5-low": 0.123}).select(
            "offer", "segment", "retention_lift"), "retention_lift"),
        oracle("offer_history planted", f"""WITH {_RATES} SELECT offer, segment, CASE WHEN offer = '5-LOW'
  THEN 0.123 ELSE round(greatest(0, sa - sd), 9) END AS retention_lift FROM rt""")),
    "offer_cost": (
        lambda s, d: rounded(nbo.offer_costs(history(s, d), people(s, d).withColumn(
            "cost", 100.0 + col("customer_id") % 7), "cost"), "offer_cost"),
        oracle("offer_history", """SELECT offer, round(coalesce(avg(100.0::DOUBLE + customer_id % 7)
  FILTER (accepted = 1), 0), 9) AS offer_cost FROM offer_history GROUP BY 1""")),
    "customer_value": (
        lambda s, d: base(s, d).select("customer_id", nbo.customer_value("avg_order").alias("value")),
        oracle("planted", "SELECT customer_id, coalesce(avg_order, 0) * 12 AS value FROM planted")),
    "declined_recently": (
        lambda s, d: nbo.declined_recently(history(s, d), cutoffs(s, d)),
        oracle("offer_history", _DECLINED)),
    "next_best_offer_measured": (
        lambda s, d: rounded(_nbo(s, d).select(
            "customer_id", "best_offer", "expected_value", "runner_up", "runner_up_value", "p_accept",
            "retention_lift", "eligible_offers", "no_offer_reason"), "p_accept", "retention_lift"),
        oracle("offer_history planted predictions", f"""WITH {_NBO} SELECT customer_id, best_offer,
  round_even(expected_value, 4) AS expected_value, runner_up,
  round_even(runner_up_value, 4) AS runner_up_value, round(p_accept, 9) AS p_accept,
  round(retention_lift, 9) AS retention_lift, eligible_offers, no_offer_reason FROM nbo""")),
    "nbo_summary": (
        lambda s, d: rounded(nbo.nbo_summary(_nbo(s, d)), "expected_value", places=1),
        oracle("offer_history planted predictions", f"""WITH {_NBO} SELECT best_offer, count(*) AS customers,
  round(sum(round_even(expected_value, 4)), 1) AS expected_value FROM nbo GROUP BY 1""")),
    "revenue_at_risk": (
        lambda s, d: b.revenue_at_risk(business_base(s, d), "churn_probability", "avg_order").select(
            "customer_id", "revenue_at_risk"),
        oracle("customers predictions", f"""WITH {_BASE} SELECT customer_id,
  churn_probability * coalesce(avg_order, 0) * 12 AS revenue_at_risk FROM bc""")),
    "offer_eligibility": (
        lambda s, d: b.eligible_pairs(business_base(s, d), CATALOGUE),
        oracle("customers predictions", f"""WITH {_BASE}, {_TERMS} SELECT customer_id, name AS offer
  FROM bc, terms WHERE {_ELIGIBLE}""")),
    "next_best_offer_assumed": (
        lambda s, d: best(s, d).select(
            "customer_id", "risk_band", "p_churn", "arpu", "best_offer", "expected_saving", "expected_cost",
            "eligible_offers", "runner_up", "runner_up_saving"),
        oracle("customers predictions", f"""WITH {_SAVINGS} SELECT customer_id, risk_band, p_churn,
  arpu, best_offer, expected_saving, expected_cost, eligible_offers, runner_up, runner_up_saving FROM nb""")),
    "roi_by_segment": (
        lambda s, d: rounded(b.roi_by_segment(best(s, d), b.segment_key("segment")), "total_saving",
                             "total_cost", "roi", places=3),
        oracle("customers predictions", f"""WITH {_SAVINGS} SELECT risk_band || ' / ' || segment AS segment,
  count(*) AS customers, round(sum(expected_saving), 3) AS total_saving, round(sum(expected_cost), 3) AS total_cost,
  round(sum(expected_saving) / sum(expected_cost), 3) AS roi FROM nb WHERE best_offer <> 'No offer' GROUP BY 1""")),
    "offer_terms": (
        lambda s, d: rounded(_offer_terms(s, d), "acceptance", "save_rate", "cost"),
        oracle("offer_history planted", f"""WITH {_OFFER_TERMS} SELECT position, name, cost_basis,
  round(acceptance, 9) AS acceptance, round(save_rate, 9) AS save_rate, round(cost, 9) AS cost,
  acceptance_source, save_rate_source, cost_source FROM tm""")),
    "data_overrides": (
        lambda s, d: rounded(b.data_overrides(_effectiveness(s, d), None, s.createDataFrame(
            [("5-Low", 0.4, 0.25, 0.05)], "offer string, acceptance_rate double, control_churn double, "
            "retention_lift_per_acceptor double")).drop("cost"), "acceptance", "save_rate"),
        oracle("offer_history planted", f"""WITH {_OFFER_TERMS} SELECT key,
  round(CASE WHEN key = '5-low' THEN 0.4 ELSE acceptance END, 9) AS acceptance,
  round(CASE WHEN key = '5-low' THEN 0.2 ELSE save_rate END, 9) AS save_rate,
  CASE WHEN key = '5-low' THEN 'experiment-proven' ELSE 'observational' END AS label FROM ov""")),
    "assumptions_block": (
        lambda s, d: rounded(b.assumptions_block(_offer_terms(s, d), 12, "default"), "value"),
        oracle("offer_history planted", f"""WITH {_OFFER_TERMS}
  SELECT 'months_remaining' AS name, 12.0::DOUBLE AS value, 'months' AS unit, 'default' AS source
  UNION ALL SELECT name || ': acceptance', round(acceptance, 9), 'share', acceptance_source FROM tm
  UNION ALL SELECT name || ': save rate', round(save_rate, 9), 'share', save_rate_source FROM tm
  UNION ALL SELECT name || ': cost', round(cost, 9), 'per accepted', cost_source FROM tm""")),
    "business_kpis": (
        lambda s, d: rounded(b.business_kpis(best(s, d)), "revenue_at_risk", "expected_saving", "overall_roi",
                             places=2),
        oracle("customers predictions", f"""WITH {_SAVINGS} SELECT round(sum(p_churn * arpu * 12), 2) AS revenue_at_risk,
  round(sum(expected_saving), 2) AS expected_saving, count(*) FILTER (best_offer <> 'No offer') AS customers_with_offer,
  count(*) AS customers_scored, round(sum(expected_saving) / sum(expected_cost), 2) AS overall_roi FROM nb""")),
    "business_by_offer": (
        lambda s, d: rounded(b.by_offer(best(s, d)), "expected_saving", "expected_cost", places=2),
        oracle("customers predictions", f"""WITH {_SAVINGS} SELECT best_offer, count(*) AS customers,
  round(sum(expected_saving), 2) AS expected_saving, round(sum(expected_cost), 2) AS expected_cost
  FROM nb WHERE best_offer <> 'No offer' GROUP BY 1""")),
    "top_offers": (
        lambda s, d: rounded(b.top_offers(best(s, d)).select("customer_id", "best_offer", "expected_saving"),
                             "expected_saving", places=3),
        oracle("customers predictions", f"""WITH {_SAVINGS} SELECT customer_id, best_offer,
  round(expected_saving, 3) AS expected_saving FROM nb ORDER BY nb.expected_saving DESC, customer_id LIMIT 50""")),
    "ab_plan": (
        lambda s, d: rounded(b.ab_plan(best(s, d), "actual_churn"), "p1", "p2", "cohens_h"),
        oracle("customers predictions", f"""WITH {_SAVINGS}, g AS (SELECT count(*) AS n, avg(actual_churn) AS p FROM nb
    WHERE best_offer <> 'No offer'), hh AS (SELECT n, p, p * (1 - 0.2::DOUBLE) AS p2,
    abs(2 * asin(sqrt(p)) - 2 * asin(sqrt(p * (1 - 0.2::DOUBLE)))) AS h FROM g),
  pl AS (SELECT *, ceil(((1.959963984540054::DOUBLE + 0.8416212335729143) / h)^2 * 2)::BIGINT AS m FROM hh)
  SELECT 'customers with an offer' AS segment, n AS segment_customers, round(p, 9) AS p1, round(p2, 9) AS p2,
    round(h, 9) AS cohens_h, m AS n_per_arm, m AS n_second_arm, 2 * m AS total_n, n < 2 * m AS too_few FROM pl""")),
    "impact_by_level": (
        lambda s, d: rounded(_impact_levels(s, d), "lift"),
        oracle("planted", f"WITH {_LEVEL_ITEMS} SELECT * REPLACE (round(lift, 9) AS lift) FROM items")),
    "impact_by_segment": (
        lambda s, d: rounded(t.impact_by_segment(base(s, d), "segment", "churned", "avg_order"), "lift"),
        oracle("planted", f"""WITH sg AS (SELECT segment, {_G} FROM planted GROUP BY 1), items AS ({_impact_sql(
            'sg', "'segment_' || segment", 'segment', 'segment', 'WHERE n >= 30')})
  SELECT * REPLACE (round(lift, 9) AS lift) FROM items""")),
    "impact_top": (
        lambda s, d: rounded(t.impact_top(_impact_levels(s, d), t.overall_impact(
            base(s, d), "churned", "avg_order"), 5), "lift"),
        oracle("planted", f"""WITH {_LEVEL_ITEMS}, {_OVERALL}, top AS (SELECT DISTINCT id, churners FROM items
    ORDER BY churners DESC, id LIMIT 5)
  SELECT * REPLACE (round(lift, 9) AS lift) FROM items WHERE id IN (SELECT id FROM top)
  UNION ALL SELECT * REPLACE (round(lift, 9) AS lift) FROM overall""")),
    "risk_band": (
        lambda s, d: _pred(s, d).select("customer_id", risk_band(col("churn_probability"), 0.7, 0.2)
                                        .alias("risk_band")),
        oracle("predictions", """SELECT customer_id, CASE WHEN churn_probability >= 0.7 THEN 'High'
  WHEN churn_probability >= 0.2 THEN 'Medium' ELSE 'Low' END AS risk_band FROM predictions""")),
    "filter_and_aggregate": (
        lambda s, d: rounded(q.filter_and_aggregate(
            base(s, d), "mean", filters=[Filter("balance", ">=", 0), Filter("segment", "in", values=(
                "BUILDING", "MACHINERY"))], column="revenue", group_by="nation"), "value", places=4),
        oracle("planted", """WITH g AS (SELECT nation AS "group", count(*) AS n, round(avg(revenue), 4) AS value
    FROM planted WHERE balance >= 0 AND segment IN ('BUILDING', 'MACHINERY') GROUP BY 1)
  SELECT *, count(*) OVER () AS groups_total, false AS truncated FROM g""")),
    "filter_and_aggregate_median": (
        lambda s, d: rounded(q.filter_and_aggregate(
            base(s, d), "median", filters=[Filter("churned", "==", 1)], column="balance",
            group_by="segment"), "value", places=6),
        oracle("planted", """SELECT segment AS "group", count(*) AS n, round(quantile_cont(balance, 0.5), 6) AS value,
  5::BIGINT AS groups_total, false AS truncated FROM planted WHERE churned = 1 GROUP BY 1""")),
    "churn_rate_question": (
        lambda s, d: q.filter_and_aggregate(
            base(s, d).withColumn("n_orders", col("n_orders").cast("double")), "churn_rate",
            filters=[Filter("region", "!=", "ASIA")], group_by="n_orders", target="churned"),
        oracle("planted", """WITH g AS (SELECT coalesce(n_orders || '.0', 'nan') AS "group", count(*) AS n,
    avg(churned) AS value FROM planted WHERE region <> 'ASIA' GROUP BY 1)
  SELECT *, count(*) OVER () AS groups_total, false AS truncated FROM g""")),
    "compare_semantics": (
        lambda s, d: q.filter_and_aggregate(
            v.dirty(s, d), "count", filters=[Filter("customer_id", "==", "7.0"),
                                             Filter("segment", "!=", " ")]).drop("group"),
        oracle("dirty", """SELECT count(*) AS n, count(*)::DOUBLE AS value, 1::BIGINT AS groups_total,
  false AS truncated FROM dirty WHERE TRY_CAST(customer_id AS DOUBLE) = 7 AND segment <> ' '""")),
    "customer_risk": (
        lambda s, d: q.customer_risk(_pred(s, d), 42),
        oracle("predictions", "SELECT * FROM predictions WHERE customer_id = 42")),
    "get_test_result": (
        lambda s, d: rounded(q.lookup(h.association(h.contingency_table(with_wealth(s, d), [
            "region", "segment", "nation", "wealth"], "churned")).select("variable", "n", "levels", "chi2"),
            "variable", "SEGMENT"), "chi2", places=6),
        oracle("planted", f"""WITH l AS ({_LEVELS}), w AS (SELECT *, sum(retained) OVER () AS r, sum(churned) OVER () AS c
    FROM l WHERE lower(variable) = lower('SEGMENT'))
  SELECT variable, sum(retained + churned)::BIGINT AS n, count(*) AS levels, round(sum((retained - (retained + churned) * r / (r + c))^2
    / ((retained + churned) * r / (r + c)) + (churned - (retained + churned) * c / (r + c))^2
    / ((retained + churned) * c / (r + c))), 6) AS chi2 FROM w GROUP BY 1""")),
    "get_segment": (
        lambda s, d: q.lookup(t.group_impact(base(s, d), "segment", "churned").select(
            "label", "customers", "churners", "scenario"), "label", "building"),
        oracle("planted", f"""SELECT segment AS label, count(*) AS customers, sum(churned)::BIGINT AS churners, scenario
  FROM planted, {_SCEN} WHERE segment = 'BUILDING' GROUP BY 1, 4""")),
    "customer_frame": (
        lambda s, d: q.customer_frame(v.dirty(s, d), _pred(s, d),
                                      "customer_id").select("row_id", "customer_id", "churn_probability",
                                                            "risk_band"),
        oracle("dirty predictions", """SELECT row_id, d.customer_id, churn_probability, risk_band FROM dirty d
  LEFT JOIN predictions p ON d.customer_id = p.customer_id::VARCHAR""")),
    "predictions_page": (
        lambda s, d: rounded(q.predictions_page(_pred(s, d), _small_nbo(s, d), band="High", query="1", page=2),
                             "expected_value", "runner_up_value", places=3),
        oracle("customers predictions", f"""WITH {_SAVINGS}, pg AS (SELECT * FROM predictions WHERE risk_band = 'High'
    AND contains(customer_id::VARCHAR, '1') ORDER BY churn_probability DESC, customer_id LIMIT 50 OFFSET 50)
  SELECT pg.*, best_offer, round(expected_saving, 3) AS expected_value, runner_up,
    round(runner_up_saving, 3) AS runner_up_value FROM pg LEFT JOIN nb ON nb.customer_id = pg.customer_id""")),
    "page_count": (
        lambda s, d: q.page_count(_pred(s, d), band="High", query="1"),
        oracle("predictions", """SELECT count(*) AS total, greatest(1, ceil(count(*) / 50))::BIGINT AS pages
  FROM predictions WHERE risk_band = 'High' AND contains(customer_id::VARCHAR, '1')""")),
    "offer_detail": (
        lambda s, d: rounded(q.offer_detail(_small_nbo(s, d), _pred(s, d), 42), "expected_value",
                             "runner_up_value", places=3),
        oracle("customers predictions", f"""WITH {_SAVINGS} SELECT nb.customer_id, best_offer,
  round(expected_saving, 3) AS expected_value, runner_up, round(runner_up_saving, 3) AS runner_up_value,
  churn_probability, p.risk_band, p.actual_churn FROM nb JOIN predictions p ON p.customer_id = nb.customer_id
  WHERE nb.customer_id = 42""")),
    "band_counts": (
        lambda s, d: x.band_counts(_pred(s, d)),
        oracle("predictions", """SELECT b.risk_band, count(p.customer_id) AS n FROM (VALUES ('High'), ('Medium'),
  ('Low')) b(risk_band) LEFT JOIN predictions p ON p.risk_band = b.risk_band GROUP BY 1""")),
    "formula_safe_text": (
        lambda s, d: v.table(s, d, "documents").select("doc_id", formula_safe("text").alias("text"), formula_safe(
            F.concat(F.lit("="), col("source"))).alias("source")),
        r"""SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END AS text,
  '''=' || source AS source FROM documents"""),
}
