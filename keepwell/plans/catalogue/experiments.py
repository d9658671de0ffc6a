"""Experiment queries: assignment, results checks and analysis of two experiments at once."""

import datetime as dt

from pyspark.sql import functions as F

from keepwell.functions.scalar import col, hash_unit
from keepwell.operators import assignment as a
from keepwell.operators import design as ds
from keepwell.operators import results as r
from keepwell.operators.filters import Filter
from keepwell.plans import views as v
from keepwell.plans.catalogue.description import rounded
from keepwell.plans.views import oracle

Z = "1.959963984540054::DOUBLE"
ZSUM = f"({Z} + 0.8416212335729143)"
FILTERS = [Filter("segment", "in", ("BUILDING", "MACHINERY", "HOUSEHOLD")),
           Filter("region", "ne", "ASIA"), Filter("balance", "gte", 0)]
SEGMENTS = {"building": [Filter("segment", "eq", "BUILDING")],
            "rich": [Filter("balance", "gte", 5000)]}
_WHERE = "segment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND region <> 'ASIA' AND balance >= 0"
DESIGNS = [ds.Design(1, "Data booster", customer_value=840.0, offer_cost=20.0),
           ds.Design(2, "Data Booster", customer_value=840.0, offer_cost=20.0)]
_BOTH = """both_runs AS (SELECT * FROM outcomes UNION ALL
  SELECT * REPLACE (2::BIGINT AS experiment_id) FROM outcomes_broken)"""


def customers(s, d):
    return v.customers(s, d, returns=False)


def both(s, d):
    second = v.outcomes(s, d, broken=True).withColumn("experiment_id", F.lit(2).cast("long"))
    return v.outcomes(s, d).unionByName(second)


def designs(s):
    return ds.designs_frame(s, DESIGNS)


def sums(s, d):
    return r.arm_sums(both(s, d))


def _arms(s, d):
    return a.assign_arms(customers(s, d), 1, "customer_id", 0.5)


def _experiments(s):
    """Two other experiments: one running, one decided."""
    return s.createDataFrame([(7, "running", False), (8, "decided", False), (9, "running", True)],
                             "experiment_id long, status string, demo boolean")


def _others(s, d):
    c = v.table(s, d, "customer").select(F.col("c_custkey").alias("customer_id"))
    x = F.when(col("customer_id") % 5 == 0, 7).when(col("customer_id") % 3 == 0, 8).otherwise(9)
    return c.withColumn("experiment_id", x.cast("long"))


def raw_results(s, d):
    """The outcome file as text, with planted faults."""
    k = col("customer_id")
    o = v.outcomes(s, d).withColumn("_c", F.explode(F.when(
        k % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    arm = (F.when(k % 103 == 0, "other").when((k % 109 == 0) & (col("arm") == "control"), "treatment")
           .when(k % 109 == 0, "control").otherwise(F.upper("arm")))
    taken = F.when((col("arm") == "control") & (k % 113 == 0), "yes").otherwise(
        F.coalesce(col("offer_accepted").cast("string"), F.lit("")))
    return o.select(
        F.when(k % 107 == 0, F.concat(F.lit("X"), k)).otherwise(k.cast("string")).alias("customer_id"),
        arm.alias("group"),
        F.when(k % 101 == 0, "maybe").when(k % 2 == 0, col("churned").cast("string"))
        .otherwise(F.when(col("churned") == 1, " Yes").otherwise("no")).alias("churned"),
        taken.alias("offer_accepted"),
        F.when(k % 127 == 0, "n/a").otherwise(" 70").alias("revenue"),
        F.when(k % 131 == 0, "-1").otherwise(col("complaints").cast("string")).alias("complaints"),
        F.when(k % 137 == 0, "2001-06-01").otherwise("2001-02-10").alias("churn_date"))


_RAW = """raw AS (SELECT CASE WHEN k % 107 = 0 THEN 'X' || k ELSE k::VARCHAR END AS customer_id,
    CASE WHEN k % 103 = 0 THEN 'other' WHEN k % 109 = 0 AND arm = 'control' THEN 'treatment'
         WHEN k % 109 = 0 THEN 'control' ELSE arm END AS arm,
    CASE WHEN k % 101 <> 0 THEN churned END AS churned,
    CASE WHEN arm = 'control' AND k % 113 = 0 THEN 1 ELSE offer_accepted END AS took,
    CASE WHEN k % 127 <> 0 THEN 70.0::DOUBLE END AS revenue,
    CASE WHEN k % 131 = 0 THEN -1.0::DOUBLE ELSE complaints END AS complaints,
    CASE WHEN k % 137 = 0 THEN DATE '2001-06-01' ELSE DATE '2001-02-10' END AS churn_date
  FROM (SELECT *, customer_id AS k FROM outcomes) JOIN (VALUES (0), (1)) c(copy)
    ON copy = 0 OR k % 97 = 0)"""


def _wilson(x, n, z):
    centre = f"(({x} / {n} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}))"
    half = (f"({z} * sqrt({x} / {n} * (1 - {x} / {n}) / {n} + {z} * {z} / (4.0::DOUBLE * {n} * {n}))"
            f" / (1 + {z} * {z} / {n}))")
    return f"greatest(0, {centre} - {half})", f"least(1, {centre} + {half})"


def _rates(table, keys, xt="x_treatment", nt="n_treatment", xc="x_control", nc="n_control"):
    lt, ut = _wilson(xt, nt, Z)
    lc, uc = _wilson(xc, nc, Z)
    return f"""SELECT {keys}, pt AS treatment_rate, pc AS control_rate, lt AS treatment_low,
      ut AS treatment_high, lc AS control_low, uc AS control_high, pt - pc AS difference,
      pt - pc - sqrt((pt - lt)^2 + (uc - pc)^2) AS ci_low,
      pt - pc + sqrt((ut - pt)^2 + (pc - lc)^2) AS ci_high, (pt - pc) / pc AS relative_lift,
      (pt - pc) / sqrt(pp * (1 - pp) * (1.0::DOUBLE / n_t + 1.0::DOUBLE / n_c)) AS z_stat FROM (
      SELECT {keys}, {xt} / {nt} AS pt, {xc} / {nc} AS pc, {lt} AS lt, {ut} AS ut, {lc} AS lc,
        {uc} AS uc, {nt} AS n_t, {nc} AS n_c, ({xt} + {xc}) / ({nt} + {nc}) AS pp FROM {table})"""


_SUMS = f"""{_BOTH}, sums AS (SELECT experiment_id,
    count(*) FILTER (arm = 'treatment') AS n_treatment, count(*) FILTER (arm = 'control') AS n_control,
    sum(churned) FILTER (arm = 'treatment') AS x_treatment, sum(churned) FILTER (arm = 'control') AS x_control,
    count(*) FILTER (arm = 'treatment' AND offer_accepted = 1) AS acceptors,
    sum(churned) FILTER (arm = 'treatment' AND offer_accepted = 1) AS x_acceptors,
    avg(complaints) FILTER (arm = 'treatment') AS cmt, avg(complaints) FILTER (arm = 'control') AS cmc,
    var_samp(complaints) FILTER (arm = 'treatment') AS cvt, var_samp(complaints) FILTER (arm = 'control') AS cvc,
    avg(revenue) FILTER (arm = 'treatment') AS rmt, avg(revenue) FILTER (arm = 'control') AS rmc,
    var_samp(revenue) FILTER (arm = 'treatment') AS rvt, var_samp(revenue) FILTER (arm = 'control') AS rvc
  FROM both_runs GROUP BY 1)"""
_ITT = f"{_SUMS}, itt AS ({_rates('sums', 'experiment_id')})"
RATES = ["treatment_rate", "control_rate", "treatment_low", "treatment_high", "control_low",
         "control_high", "difference", "ci_low", "ci_high", "relative_lift", "z_stat"]
_R9 = ", ".join(f"round({c}, 9) AS {c}" for c in RATES)
_GUARD = """g AS (SELECT experiment_id, 'complaints' AS guardrail, cmt AS mt, cmc AS mc, cvt / n_treatment AS a,
    cvc / n_control AS b FROM sums UNION ALL
  SELECT experiment_id, 'arpu', rmt, rmc, rvt / n_treatment, rvc / n_control FROM sums),
  guard AS (SELECT *, mt - mc AS d, 1.959963984540054 * sqrt(a + b) AS h FROM g),
  gd AS (SELECT *, CASE WHEN guardrail = 'complaints' THEN d - h > 0 ELSE d + h < -0.05 * abs(mc) END
    AS breached FROM guard)"""
_SRM = f"""srm AS (SELECT experiment_id, n_treatment, n_control, (n_treatment + n_control) * 0.5::DOUBLE AS e,
    (n_treatment - (n_treatment + n_control) / 2.0::DOUBLE)^2 / ((n_treatment + n_control) / 2.0::DOUBLE) * 2
    AS chi2 FROM sums)"""
_IMPACT = """imp AS (SELECT experiment_id, -difference * n_treatment AS saved, -ci_high * n_treatment AS lo,
    -ci_low * n_treatment AS hi, acceptors, acceptors / n_treatment AS rate, 20.0::DOUBLE * acceptors AS cost
  FROM sums JOIN itt USING (experiment_id))"""
_VERDICT = f"""{_ITT}, {_SRM}, {_IMPACT}, {_GUARD},
  v AS (SELECT *, saved * 840 - cost AS net, coalesce((SELECT bool_or(breached) FROM gd
           WHERE gd.experiment_id = itt.experiment_id), false) AS br
    FROM itt JOIN srm USING (experiment_id) JOIN imp USING (experiment_id)),
  verdicts AS (SELECT *, CASE WHEN chi2 > 10.827566170662733 THEN 'untrustworthy'
    WHEN ci_low > 0 OR net < 0 THEN 'dont_ship' WHEN ci_high < 0 AND net > 0 AND NOT br THEN 'ship'
    ELSE 'inconclusive' END AS verdict FROM v)"""


def _plans(s, d):
    g = customers(s, d).groupBy("nation").agg(F.avg("churned").alias("p1"), F.count("*").alias("n"))
    return g


def _design_table(s, d):
    plan = ds.required_columns(ds.Design(1, mde=0.05), col("p1"), monthly_volume=500)
    need = plan["n_treatment"] + plan["n_control"]
    return _plans(s, d).where(col("p1") > 0.05).select(
        "nation", "n", *[e.alias(k) for k, e in plan.items()], (col("n") >= need).alias("feasible"))


QUERIES = {
    "hash_unit": (
        lambda s, d: customers(s, d).select("customer_id",
                                            hash_unit(F.lit(1), col("customer_id")).alias("u")),
        oracle("customers", "SELECT customer_id, unit('1:' || customer_id) AS u FROM customers")),
    "assign_groups": (
        lambda s, d: _arms(s, d).select("customer_id", "arm"),
        oracle("assignment", "SELECT customer_id, arm FROM assignment")),
    "snapshot_hash": (
        lambda s, d: a.snapshot_hash(customers(s, d), ["customer_id", "segment", "region"]),
        oracle("customers", """
  WITH h AS (SELECT sha256('customer_id=' || customer_id || '|region=' || region || '|segment=' || segment)
             AS h FROM customers)
  SELECT sha256(count(*) || '|' || """ + " || '|' || ".join(
            f"sum(('0x' || substr(h, {1 + 16 * i}, 16))::UBIGINT::HUGEINT)" for i in range(4))
            + ") AS snapshot_hash, count(*) AS rows FROM h")),
    "balance_numeric": (
        lambda s, d: rounded(a.balance_numeric(_arms(s, d), ["balance", "tenure", "revenue"]),
                             "smd", "treatment_mean", "control_mean", places=6),
        oracle("customers assignment", """
  WITH t AS (SELECT covariate, x, arm FROM (SELECT balance, tenure, revenue, arm FROM customers
     JOIN assignment USING (customer_id)) UNPIVOT (x FOR covariate IN (balance, tenure, revenue))),
  g AS (SELECT covariate, avg(x) FILTER (arm = 'treatment') AS mt, avg(x) FILTER (arm = 'control') AS mc,
     var_samp(x) FILTER (arm = 'treatment') AS vt, var_samp(x) FILTER (arm = 'control') AS vc
     FROM t GROUP BY 1)
  SELECT covariate, NULL::VARCHAR AS level, round((mt - mc) / sqrt((vt + vc) / 2), 6) AS smd,
    round(mt, 6) AS treatment_mean, round(mc, 6) AS control_mean,
    abs((mt - mc) / sqrt((vt + vc) / 2)) > 0.1 AS flagged FROM g""")),
    "balance_categorical": (
        lambda s, d: rounded(a.balance_categorical(_arms(s, d), ["segment", "nation"]), "smd",
                             "treatment_mean", "control_mean"),
        oracle("customers assignment", """
  WITH t AS (SELECT covariate, level, arm FROM (SELECT segment, nation, arm FROM customers
     JOIN assignment USING (customer_id)) UNPIVOT (level FOR covariate IN (segment, nation))),
  g AS (SELECT covariate, level, count(*) FILTER (arm = 'treatment') AS t, count(*) FILTER (arm = 'control') AS c
     FROM t GROUP BY 1, 2),
  p AS (SELECT *, t / sum(t) OVER (PARTITION BY covariate) AS pt, c / sum(c) OVER (PARTITION BY covariate) AS pc
     FROM g),
  q AS (SELECT *, (pt - pc) / sqrt((pt * (1 - pt) + pc * (1 - pc)) / 2) AS smd FROM p)
  SELECT covariate, level, round(smd, 9) AS smd, round(pt, 9) AS treatment_mean,
    round(pc, 9) AS control_mean, abs(smd) > 0.1 AS flagged FROM q""")),
    "segment_filter": (
        lambda s, d: a.apply_segment(customers(s, d), FILTERS).select("customer_id"),
        oracle("customers", f"SELECT customer_id FROM customers WHERE {_WHERE}")),
    "segment_membership": (
        lambda s, d: a.segment_membership(customers(s, d), SEGMENTS).select(
            "customer_id", F.concat_ws(",", "segments").alias("segments")),
        oracle("assignment", """SELECT customer_id, array_to_string(segments, ',') AS segments
  FROM assignment""")),
    "experiment_customers": (
        lambda s, d: a.experiment_customers(
            v.dirty(s, d), v.predictions(s, d), "customer_id",
            "row_id").select("customer_id", "row_id", "region", "churn_probability", "risk_band"),
        oracle("dirty predictions", """
  SELECT d.customer_id, row_id, region, churn_probability, risk_band FROM dirty d
  JOIN predictions p ON d.customer_id = p.customer_id::VARCHAR
  QUALIFY row_number() OVER (PARTITION BY d.customer_id ORDER BY row_id) = 1""")),
    "exclude_busy": (
        lambda s, d: a.exclude_busy(customers(s, d), _others(s, d), _experiments(s), 1)
        .select("customer_id"),
        oracle("customers", "SELECT customer_id FROM customers WHERE customer_id % 5 <> 0")),
    "assign_experiment": (
        lambda s, d: a.assign_experiment(customers(s, d), 1, 0.5, FILTERS, SEGMENTS, _others(s, d),
                                         _experiments(s)).select(
            "experiment_id", "customer_id", "arm", F.concat_ws(",", "segments").alias("segments")),
        oracle("customers assignment", f"""
  SELECT experiment_id, customer_id, arm, array_to_string(segments, ',') AS segments
  FROM customers JOIN assignment USING (customer_id) WHERE {_WHERE} AND customer_id % 5 <> 0""")),
    "segment_options": (
        lambda s, d: a.segment_options(customers(s, d), ["segment", "nation", "balance", "churned"]),
        oracle("customers", """
  SELECT "column", 'categorical' AS kind, level, n, NULL::DOUBLE AS min, NULL::DOUBLE AS max FROM (
    SELECT "column", level, count(*) AS n, row_number() OVER (PARTITION BY "column"
      ORDER BY count(*) DESC, level) AS k FROM (SELECT segment, nation, churned::VARCHAR AS churned
      FROM customers) UNPIVOT (level FOR "column" IN (segment, nation, churned)) GROUP BY 1, 2) WHERE k <= 30
  UNION ALL SELECT 'balance', 'numeric', NULL, NULL, min(balance), max(balance) FROM customers""")),
    "sample_size": (
        _design_table,
        oracle("customers", f"""
  WITH g AS (SELECT nation, avg(churned) AS p, count(*) AS n FROM customers GROUP BY 1),
  m AS (SELECT *, ceil(({ZSUM} / abs(2 * asin(sqrt(p)) - 2 * asin(sqrt(p - 0.05))))^2 * 2)::BIGINT AS need
        FROM g WHERE p > 0.05)
  SELECT nation, n, need AS n_treatment, need AS n_control, n >= 2 * need AS feasible,
         ceil(2 * need / 500::DOUBLE * 30.4375)::BIGINT AS duration_days FROM m""")),
    "sample_size_relative": (
        lambda s, d: rounded(_plans(s, d).select("nation", *[
            e.alias(n) for n, e in ds.plan_columns(col("p1"), 0.2, ratio=0.5).items()]),
            "p2", "cohens_h"),
        oracle("customers", f"""
  WITH g AS (SELECT nation, avg(churned) AS p FROM customers GROUP BY 1),
  h AS (SELECT nation, p * (1 - 0.2::DOUBLE) AS p2, abs(2 * asin(sqrt(p)) - 2 * asin(sqrt(p * (1 - 0.2::DOUBLE))))
        AS h FROM g), m AS (SELECT *, ({ZSUM} / h)^2 * 3 AS n FROM h)
  SELECT nation, round(p2, 9) AS p2, round(h, 9) AS cohens_h, ceil(n)::BIGINT AS n_per_arm,
         ceil(n * 0.5)::BIGINT AS n_second_arm, (ceil(n) + ceil(n * 0.5))::BIGINT AS total_n FROM m""")),
    "detectable_effect": (
        lambda s, d: rounded(_plans(s, d).select("nation", *[
            e.alias(n) for n, e in ds.detectable_columns(col("p1"), col("n")).items()]),
            "effect_h", "treatment_rate", "absolute", "relative"),
        oracle("customers", f"""
  WITH g AS (SELECT nation, avg(churned) AS p, count(*) AS n FROM customers GROUP BY 1),
  h AS (SELECT *, {ZSUM} * sqrt(2 / (n * 0.5::DOUBLE)) AS h FROM g),
  m AS (SELECT *, CASE WHEN asin(sqrt(p)) - h / 2 > 0 THEN sin(asin(sqrt(p)) - h / 2)^2 END AS q FROM h)
  SELECT nation, round(h, 9) AS effect_h, round(q, 9) AS treatment_rate, round(p - q, 9) AS absolute,
         round((p - q) / p, 9) AS relative FROM m""")),
    "results_normalise": (
        lambda s, d: r.normalise_results(raw_results(s, d)).select(
            "customer_id", "arm", "churned", "offer_accepted", "revenue", "complaints", "churn_date"),
        oracle("outcomes", f"""WITH {_RAW} SELECT customer_id, arm, churned, CASE WHEN arm = 'treatment'
  THEN coalesce(took, 0) END AS offer_accepted, revenue, complaints, churn_date FROM raw""")),
    "results_checks": (
        lambda s, d: r.check_results(r.normalise_results(raw_results(s, d)), v.assignment(s, d),
                                     dt.date(2001, 2, 1), 30).select(
            "check", "rejects", "n", F.concat_ws(",", "examples").alias("examples")),
        oracle("outcomes assignment", f"""
  WITH {_RAW}, asg AS (SELECT customer_id::VARCHAR AS id, arm AS plan FROM assignment),
  j AS (SELECT * FROM raw FULL JOIN asg ON raw.customer_id = asg.id),
  c AS (SELECT 'duplicate_id' AS "check", customer_id AS id FROM raw GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'bad_group', customer_id FROM raw WHERE arm NOT IN ('treatment', 'control')
    UNION ALL SELECT DISTINCT 'never_assigned', customer_id FROM raw WHERE customer_id NOT IN (SELECT id FROM asg)
    UNION ALL SELECT 'missing_from_file', id FROM j WHERE customer_id IS NULL
    UNION ALL SELECT 'wrong_arm', id FROM j WHERE arm IN ('treatment', 'control') AND arm <> plan
    UNION ALL SELECT 'bad_churned', customer_id FROM raw WHERE churned IS NULL
    UNION ALL SELECT 'control_accepted', customer_id FROM raw WHERE arm <> 'treatment' AND took = 1
    UNION ALL SELECT 'bad_revenue', customer_id FROM raw WHERE revenue IS NULL
    UNION ALL SELECT 'negative_complaints', customer_id FROM raw WHERE complaints < 0
    UNION ALL SELECT 'churn_date_outside_window', customer_id FROM raw WHERE churned = 1
      AND churn_date > DATE '2001-03-03'),
  n AS (SELECT "check", count(*) AS n FROM c GROUP BY 1),
  e AS (SELECT "check", id, row_number() OVER (PARTITION BY "check" ORDER BY id) AS k
        FROM (SELECT DISTINCT * FROM c))
  SELECT n."check", n."check" <> 'missing_from_file' AS rejects, any_value(n.n) AS n,
         string_agg(id, ',' ORDER BY k) AS examples
  FROM n JOIN e ON e."check" = n."check" AND k <= 5 GROUP BY 1""")),
    "early_look": (
        lambda s, d: r.early_look(
            v.table(s, d, "orders").groupBy((col("o_custkey") % 50).alias("experiment_id")).agg(
                F.min("o_orderdate").cast("date").alias("planned_start"),
                F.lit(None).cast("date").alias("planned_end"), F.lit(10).alias("window_days")),
            F.lit(dt.date(1995, 1, 12))),
        """SELECT o_custkey % 50 AS experiment_id, min(o_orderdate)::DATE + 10 AS ends,
  DATE '1995-01-12' < min(o_orderdate)::DATE + 10 AS early_look FROM orders GROUP BY 1"""),
    "srm_check": (
        lambda s, d: rounded(r.srm_check(sums(s, d), designs(s)), "chi2", "observed_control_share"),
        oracle("outcomes outcomes_broken", f"""WITH {_SUMS}, {_SRM} SELECT experiment_id, n_treatment,
  n_control, e AS expected_treatment, e AS expected_control,
  round(n_control / (n_treatment + n_control), 9) AS observed_control_share, round(chi2, 9) AS chi2,
  chi2 > 10.827566170662733 AS failed FROM srm""")),
    "compare_rates": (
        lambda s, d: rounded(r.compare_rates(sums(s, d), designs(s)), *RATES),
        oracle("outcomes outcomes_broken", f"WITH {_ITT} SELECT experiment_id, {_R9} FROM itt")),
    "per_protocol": (
        lambda s, d: rounded(r.per_protocol(sums(s, d), designs(s)), *RATES),
        oracle("outcomes outcomes_broken", f"""WITH {_SUMS}, pp AS ({_rates(
            'sums', 'experiment_id', 'x_acceptors', 'acceptors')}) SELECT experiment_id, {_R9} FROM pp""")),
    "wilson_interval": (
        lambda s, d: rounded(r.compare_rates(sums(s, d), designs(s)).select(
            "experiment_id", "treatment_low", "treatment_high", "control_low", "control_high"),
            "treatment_low", "treatment_high", "control_low", "control_high"),
        oracle("outcomes outcomes_broken", f"""WITH {_ITT} SELECT experiment_id,
  round(treatment_low, 9) AS treatment_low, round(treatment_high, 9) AS treatment_high,
  round(control_low, 9) AS control_low, round(control_high, 9) AS control_high FROM itt""")),
    "newcombe_interval": (
        lambda s, d: rounded(r.compare_rates(sums(s, d), designs(s)).select(
            "experiment_id", "difference", "ci_low", "ci_high"), "difference", "ci_low", "ci_high"),
        oracle("outcomes outcomes_broken", f"""WITH {_ITT} SELECT experiment_id,
  round(difference, 9) AS difference, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM itt""")),
    "guardrails": (
        lambda s, d: rounded(r.guardrails(sums(s, d), designs(s)).select(
            "experiment_id", "guardrail", "treatment_mean", "control_mean", "difference", "ci_low",
            "ci_high", "breached"), "treatment_mean", "control_mean", "difference", "ci_low", "ci_high"),
        oracle("outcomes outcomes_broken", f"""WITH {_SUMS}, {_GUARD} SELECT experiment_id, guardrail,
  round(mt, 9) AS treatment_mean, round(mc, 9) AS control_mean, round(d, 9) AS difference,
  round(d - h, 9) AS ci_low, round(d + h, 9) AS ci_high, breached FROM gd""")),
    "segment_breakdown": (
        lambda s, d: rounded(r.segment_breakdown(both(s, d), designs(s)).select(
            "experiment_id", "segment", "n", *RATES), *RATES),
        oracle("outcomes outcomes_broken", f"""WITH {_BOTH}, l AS (SELECT experiment_id, arm, churned,
     unnest(segments) AS segment FROM both_runs),
  q AS (SELECT experiment_id, segment, count(*) AS n, count(*) FILTER (arm = 'treatment') AS n_treatment,
     count(*) FILTER (arm = 'control') AS n_control, sum(churned) FILTER (arm = 'treatment') AS x_treatment,
     sum(churned) FILTER (arm = 'control') AS x_control FROM l GROUP BY 1, 2),
  rr AS ({_rates('q', 'experiment_id, segment, n')}) SELECT experiment_id, segment, n, {_R9} FROM rr""")),
    "experiment_impact": (
        lambda s, d: rounded(r.experiment_impact(sums(s, d), designs(s)), "customers_saved", "saved_low",
                             "saved_high", "acceptance_rate", "net_value", "net_low", "net_high", places=6),
        oracle("outcomes outcomes_broken", f"""WITH {_ITT}, {_IMPACT} SELECT experiment_id,
  round(saved, 6) AS customers_saved, round(lo, 6) AS saved_low, round(hi, 6) AS saved_high, acceptors,
  round(rate, 6) AS acceptance_rate, cost AS total_offer_cost, round(saved * 840 - cost, 6) AS net_value,
  round(lo * 840 - cost, 6) AS net_low, round(hi * 840 - cost, 6) AS net_high FROM imp""")),
    "decision_helper": (
        lambda s, d: r.decision_helper(sums(s, d), designs(s)).select("experiment_id", "verdict"),
        oracle("outcomes outcomes_broken", f"WITH {_VERDICT} SELECT experiment_id, verdict FROM verdicts")),
    "analyse_experiment": (
        lambda s, d: rounded(r.analyse(both(s, d), designs(s)).select(
            "experiment_id", "n_treatment", "n_control", "srm_failed", "difference", "customers_saved",
            "net_value", "verdict"), "difference", "customers_saved", "net_value", places=6),
        oracle("outcomes outcomes_broken", f"""WITH {_VERDICT} SELECT experiment_id, n_treatment, n_control,
  chi2 > 10.827566170662733 AS srm_failed, round(difference, 6) AS difference,
  round(saved, 6) AS customers_saved, round(net, 6) AS net_value, verdict FROM verdicts""")),
    "experiment_probabilities": (
        lambda s, d: r.analyse(both(s, d), designs(s)).select("experiment_id", "srm_p", "p_value"), None),
    "offer_evidence": (
        lambda s, d: rounded(r.offer_evidence(
            r.analyse(both(s, d), designs(s)), s.createDataFrame(
                [(1, "Data booster", "decided", False, dt.date(2001, 3, 1)),
                 (2, "Data Booster", "decided", False, dt.date(2001, 4, 1))],
                "experiment_id long, offer string, status string, demo boolean, decided_at date"))
            .select("experiment_id", "offer", "control_churn", "acceptance_rate",
                    "retention_lift_per_acceptor"), "control_churn", "acceptance_rate",
            "retention_lift_per_acceptor"),
        oracle("outcomes outcomes_broken", f"""WITH {_VERDICT}, ex(experiment_id, offer, decided_at) AS (
    VALUES (1, 'Data booster', DATE '2001-03-01'), (2, 'Data Booster', DATE '2001-04-01'))
  SELECT experiment_id, offer, round(control_rate, 9) AS control_churn, round(rate, 9) AS acceptance_rate,
    round(least(1, greatest(0, (control_rate - treatment_rate) / rate)), 9) AS retention_lift_per_acceptor
  FROM verdicts JOIN ex USING (experiment_id) WHERE chi2 <= 10.827566170662733
  QUALIFY row_number() OVER (PARTITION BY lower(offer) ORDER BY decided_at DESC, experiment_id DESC) = 1""")),
    "customer_value_estimate": (
        lambda s, d: rounded(a.customer_value_estimate(customers(s, d), "revenue"), "customer_value", places=4),
        oracle("customers", "SELECT round(avg(revenue) * 12, 4) AS customer_value FROM customers")),
}
