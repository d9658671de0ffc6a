"""Fact, claim-check, run-log, event-feature and export queries."""

import datetime as dt

from pyspark.sql import functions as F

from keepwell.functions.scalar import col
from keepwell.operators import describe as e
from keepwell.operators import facts as k
from keepwell.operators import features as l
from keepwell.operators import impact as t
from keepwell.operators import telemetry as tel
from keepwell.plans import views as v
from keepwell.plans.catalogue.description import base, rounded, with_wealth
from keepwell.plans.catalogue.offers import _LEVEL_ITEMS
from keepwell.plans.views import oracle
from keepwell.sources.files import safe_columns

WORDS = ["region", "segment", "wealth"]


def facts(s, d):
    """Category and impact facts of the planted base."""
    df = with_wealth(s, d)
    rates = e.category_rates(df, WORDS, "churned")
    items = t.impact_by_level(df, [*WORDS, "nation"], "churned", "avg_order")
    return k.facts_table([k.category_facts(rates), k.impact_facts(items)])


_SIG = "CASE WHEN x = 0 THEN 0 ELSE round_even(x * power(10.0::DOUBLE, 3 - floor(log10(abs(x)))), 0) / power(10.0::DOUBLE, 3 - floor(log10(abs(x)))) END"
_FACTS = f"""lr AS (SELECT feature, level, count(*) AS n, avg(churned) AS r FROM (SELECT region, segment, CASE WHEN balance
    >= 5000 THEN 'rich' ELSE 'other' END AS wealth, churned FROM planted) UNPIVOT (level FOR feature IN (region, segment, wealth))
    GROUP BY 1, 2),
  {_LEVEL_ITEMS},
  ti AS MATERIALIZED (SELECT * FROM items),
  rw AS (
   SELECT 'churn_by_category' AS section, 'categorical.' || feature || '.' || level || '.churn_rate' AS key, r AS x, NULL AS g FROM lr
   UNION ALL SELECT 'churn_by_category', 'categorical.' || feature || '.' || level || '.n', n, NULL FROM lr
   UNION ALL SELECT DISTINCT 'impact', 'impact.' || id || '.customers', customers, id FROM ti
   UNION ALL SELECT DISTINCT 'impact', 'impact.' || id || '.churners', churners, id FROM ti
   UNION ALL SELECT DISTINCT 'impact', 'impact.' || id || '.churn_rate', churn_rate, id FROM ti
   UNION ALL SELECT DISTINCT 'impact', 'impact.' || id || '.revenue_at_risk', revenue_at_risk, id FROM ti
   UNION ALL SELECT 'impact', 'impact.' || id || '.' || scenario || '.churners_saved', churners_saved, id FROM ti
   UNION ALL SELECT 'impact', 'impact.' || id || '.' || scenario || '.revenue_saved', revenue_saved, id FROM ti),
  facts AS MATERIALIZED (SELECT section, key, {_SIG} AS value, g AS group_id FROM rw)"""


def claims(s, d):
    """Every fact claimed again: some as percent, some slightly off, some wrong, some unknown."""
    kind = F.pmod(F.length("key"), F.lit(5))
    return facts(s, d).select(
        F.col("section").alias("item"),
        F.when(kind == 4, F.concat("key", F.lit(".x"))).otherwise(F.col("key")).alias("key"),
        F.when(kind == 0, F.col("value") * 100).when(kind == 1, F.col("value") * 1.005)
        .when(kind == 2, F.col("value") * 1.5 + 1).otherwise(F.col("value")).alias("claimed"))


_CLAIMS = """cl AS MATERIALIZED (SELECT section AS item, CASE WHEN length(key) % 5 = 4 THEN key || '.x' ELSE key END AS key,
    CASE length(key) % 5 WHEN 0 THEN value * 100 WHEN 1 THEN value * 1.005 WHEN 2 THEN value * 1.5 + 1 ELSE value END AS claimed
    FROM facts),
  ck AS (SELECT cl.item, cl.key, claimed, value AS actual, CASE WHEN value IS NULL THEN 'no such fact'
    WHEN abs(claimed - value) <= greatest(.005, .01 * abs(value)) OR abs(claimed - value * 100) <= greatest(.005, .01 * abs(value * 100))
      OR abs(claimed / 100 - value) <= greatest(.005, .01 * abs(value)) THEN NULL ELSE 'value does not match' END AS problem
    FROM cl LEFT JOIN facts USING (key))"""


def _group_claims(s, d):
    f = facts(s, d).where("section = 'impact'")
    rank = F.pmod(F.length("key"), F.lit(3))
    impact = f.where(F.col("key").endswith("revenue_at_risk")).select(
        F.col("group_id").alias("item"), F.lit("impact").alias("role"), "key")
    people = f.where(F.col("key").endswith("customers")).select(
        F.when(rank == 0, F.lit("region=ASIA")).otherwise(F.col("group_id")).alias("item"),
        F.lit("customers").alias("role"), "key")
    return impact.unionByName(people)


def documents(s, d):
    return v.table(s, d, "documents").select(F.col("doc_id").alias("item"), "text")


def figures(s, d):
    """Declared figures: every second number of each document's own text."""
    n = k.numbers_in(documents(s, d)).distinct()
    return n.where(F.floor("number") % 2 == 0).select("item", F.col("number").alias("value"))


def contacts(s, d):
    ev = v.table(s, d, "events").withColumn("resolved", col("event_type") != "error")
    return l.repeat_contacts(ev, "user_id", "event_type", "ts", "event_id")


UNTIL = dt.datetime(2024, 1, 25)
TYPES = ["click", "error", "purchase", "signup", "view"]
_REPEAT = """rp AS (SELECT *, coalesce(lag(event_type) OVER w = event_type
    AND floor((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000) <= 7, false) AS is_repeat
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _tokens(s, d):
    return v.intervals(s, d).select("model", (col("event_id") % 1000).alias("input_tokens"),
                                    (col("user_id") * 2).alias("output_tokens"))


QUERIES = {
    "facts_table": (
        lambda s, d: facts(s, d).drop("label"),
        oracle("planted", f"WITH {_FACTS} SELECT section, key, value, group_id FROM facts")),
    "resolve_path": (
        lambda s, d: k.resolve_paths(facts(s, d), claims(s, d)),
        oracle("planted", f"""WITH {_FACTS}, {_CLAIMS} SELECT DISTINCT cl.key, value FROM cl LEFT JOIN facts
  USING (key)""")),
    "check_figures": (
        lambda s, d: rounded(k.check_figures(claims(s, d), facts(s, d)), "claimed", places=6),
        oracle("planted", f"""WITH {_FACTS}, {_CLAIMS} SELECT item, key, round(claimed, 6) AS claimed, actual,
  problem FROM ck""")),
    "validation_report": (
        lambda s, d: k.validation_report(
            claims(s, d).select(F.col("key").alias("item")), k.check_figures(
                claims(s, d).withColumn("item", col("key")), facts(s, d)).where("problem is not null")),
        oracle("planted", f"""WITH {_FACTS}, {_CLAIMS} SELECT count(*) AS checked,
  count(*) FILTER (problem IS NULL) AS passed, count(problem) AS failed FROM ck""")),
    "valid_items": (
        lambda s, d: k.valid_items(
            claims(s, d).withColumn("item", col("key")).select("item"), k.check_figures(
                claims(s, d).withColumn("item", col("key")), facts(s, d)).where("problem is not null")),
        oracle("planted", f"WITH {_FACTS}, {_CLAIMS} SELECT key AS item FROM ck WHERE problem IS NULL")),
    "check_impact_group": (
        lambda s, d: k.check_impact_group(_group_claims(s, d), facts(s, d)).drop("customer_group"),
        oracle("planted", f"""WITH {_FACTS}, gc AS (
    SELECT group_id AS item, 'impact' AS role, group_id AS g FROM facts WHERE section = 'impact' AND ends_with(key, 'revenue_at_risk')
    UNION ALL SELECT CASE WHEN length(key) % 3 = 0 THEN 'region=ASIA' ELSE group_id END, 'customers', group_id FROM facts
    WHERE section = 'impact' AND ends_with(key, '.customers')),
  a AS (SELECT item, max(g) FILTER (role = 'impact') AS ig, max(g) FILTER (role = 'customers') AS cg FROM gc GROUP BY 1)
  SELECT item, ig AS impact_group, CASE WHEN ig <> cg THEN 'impact and customers are of different groups' END AS problem FROM a""")),
    "check_text_numbers": (lambda s, d: k.check_text_numbers(documents(s, d), figures(s, d)), None),
    "latency_by_step": (
        lambda s, d: rounded(tel.latency_by_step(v.intervals(s, d)), "latency_ms", places=3),
        oracle("intervals", """SELECT node, round(sum(latency_ms), 3) AS latency_ms, count(*) AS runs,
  last(status ORDER BY started_at, event_id) AS status, sum(retries)::BIGINT AS retries FROM intervals GROUP BY 1""")),
    "busy_time": (
        lambda s, d: rounded(tel.busy_time(v.intervals(s, d)), "busy_ms", places=1),
        oracle("intervals", """WITH x AS (SELECT epoch_us(started_at) / 1000.0::DOUBLE AS a,
    epoch_us(started_at) / 1000.0::DOUBLE + latency_ms AS b, event_id, started_at FROM intervals),
  y AS (SELECT *, max(b) OVER (ORDER BY started_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
  i AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (ORDER BY started_at, event_id) AS isl FROM y)
  SELECT round(sum(l), 1) AS busy_ms FROM (SELECT max(b) - min(a) AS l FROM i GROUP BY isl)""")),
    "token_cost": (
        lambda s, d: rounded(tel.token_cost(_tokens(s, d), s.createDataFrame(
            [("model-0", 1.5, 6.0), ("model-1", 0.25, 2.0)],
            "model string, input_per_1m double, output_per_1m double"), 0.1, 0.2), "cost"),
        oracle("intervals", """WITH t AS (SELECT model, sum(event_id % 1000)::BIGINT AS input_tokens,
    sum(user_id * 2)::BIGINT AS output_tokens FROM intervals GROUP BY 1),
  p(model, i, o) AS (VALUES ('model-0', 1.5::DOUBLE, 6.0::DOUBLE), ('model-1', 0.25, 2.0))
  SELECT t.*, round((input_tokens * coalesce(i, 0.1) + output_tokens * coalesce(o, 0.2)) / 1000000, 9) AS cost
  FROM t LEFT JOIN p USING (model)""")),
    "run_history": (
        lambda s, d: tel.run_history(v.intervals(s, d).select("event_id", "node", "started_at", "user_id"), 7, 20,
                                     "user_id", "event_id"),
        oracle("intervals", """SELECT event_id, node, started_at, user_id FROM intervals WHERE user_id = 7
  ORDER BY event_id DESC LIMIT 20""")),
    "usage_trend": (
        lambda s, d: rounded(l.usage_trend(v.usage_monthly(s, d), dt.date(2001, 1, 1), "spend"), "recent",
                             "previous", places=4),
        oracle("usage_monthly", """SELECT customer_id, round(a, 4) AS recent, round(b, 4) AS previous,
  round(100 * (a / nullif(b, 0) - 1), 1) AS change_pct FROM (SELECT customer_id,
    avg(spend) FILTER ("month" > DATE '2000-10-01') AS a, avg(spend) FILTER ("month" <= DATE '2000-10-01') AS b
    FROM usage_monthly WHERE "month" > DATE '2000-07-01' AND "month" <= DATE '2001-01-01' GROUP BY 1)""")),
    "downtrade_flag": (
        lambda s, d: l.usage_trend(v.usage_monthly(s, d), dt.date(2001, 1, 1), "spend").select(
            "customer_id", l.downtrade(col("recent"), col("previous")).alias("downtrade")),
        oracle("usage_monthly", """SELECT customer_id, CASE WHEN a < 0.85 * b THEN 'Yes' ELSE 'No' END AS downtrade
  FROM (SELECT customer_id, avg(spend) FILTER ("month" > DATE '2000-10-01') AS a,
    avg(spend) FILTER ("month" <= DATE '2000-10-01') AS b FROM usage_monthly
    WHERE "month" > DATE '2000-07-01' AND "month" <= DATE '2001-01-01' GROUP BY 1)""")),
    "repeat_within_7d": (
        lambda s, d: contacts(s, d).select("event_id", "is_repeat"),
        f"WITH {_REPEAT} SELECT event_id, is_repeat FROM rp"),
    "contact_rollup": (
        lambda s, d: l.contact_rollup(contacts(s, d), v.table(s, d, "customer").select(
            col("c_custkey").alias("customer_id")), "user_id", "event_type", "ts", UNTIL, TYPES, "value", 90),
        f"""WITH {_REPEAT}, g AS (SELECT user_id, count(*) AS contacts, """ + ", ".join(
            f"count(*) FILTER (event_type = '{c}') AS n_{c}" for c in TYPES) + """,
    count(*) FILTER (is_repeat) AS repeats, round(avg((event_type <> 'error')::INT), 2) AS resolution_rate,
    round(avg(value), 2) AS mean_score FROM rp WHERE ts > TIMESTAMP '2023-10-27' AND ts <= TIMESTAMP '2024-01-25' GROUP BY 1)
  SELECT c_custkey AS customer_id, coalesce(contacts, 0) AS contacts, """ + ", ".join(
            f"coalesce(n_{c}, 0) AS n_{c}" for c in TYPES) + """, coalesce(repeats, 0) AS repeats, resolution_rate,
    mean_score FROM customer LEFT JOIN g ON user_id = c_custkey"""),
    "modal_channel": (
        lambda s, d: l.modal_value(v.table(s, d, "events"), "user_id", "event_type"),
        """SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS modal FROM (SELECT user_id, event_type,
  count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"""),
    "offers_received": (
        lambda s, d: l.offers_received(v.table(s, d, "customer").select(col("c_custkey").alias("customer_id")),
                                       v.offer_history(s, d)),
        oracle("offer_history", """SELECT c_custkey AS customer_id, count(h.customer_id) AS offers_received
  FROM customer LEFT JOIN offer_history h ON h.customer_id = c_custkey GROUP BY 1""")),
    "price_gap": (
        lambda s, d: l.price_gap(v.customers(s, d, False), v.customers(s, d, False).groupBy("region").agg(
            F.min("avg_order").alias("price")), "region", "avg_order"),
        oracle("customers", """SELECT customer_id, round(100 * (avg_order / price - 1), 1) AS price_gap_pct
  FROM customers JOIN (SELECT region, min(avg_order) AS price FROM customers GROUP BY 1) USING (region)""")),
    "export_predictions": (
        lambda s, d: safe_columns(v.predictions(s, d).withColumn("note", F.concat(F.lit("-"), "risk_band"))),
        oracle("predictions", "SELECT *, '''-' || risk_band AS note FROM predictions")),
    "export_customers": (
        lambda s, d: safe_columns(base(s, d)), oracle("planted", "SELECT * EXCLUDE (returned_share) FROM planted")),
    "pruned_scan": (
        lambda s, d: v.table(s, d, "lineitem").select("l_orderkey", "l_quantity").where("l_quantity > 45"),
        "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45"),
}
