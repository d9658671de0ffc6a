"""Profiling and cleaning queries over the planted-fault table."""

from pyspark.sql import functions as F

from keepwell.functions.scalar import squeeze, to_number, to_time
from keepwell.operators import clean as c
from keepwell.operators import profile as p
from keepwell.plans import views as v
from keepwell.plans.views import oracle
from keepwell.roles import Roles

TEXT = ["customer_id", "segment", "balance", "region", "last_order", "Churn"]
NUMBERS = ["balance", "n_orders", "revenue", "avg_order", "tenure", "recency"]
_UNPIVOT = """SELECT "column", value, row_id FROM (SELECT * FROM dirty) UNPIVOT INCLUDE NULLS
  (value FOR "column" IN (customer_id, segment, balance, region, last_order, "Churn"))"""
_NUM = "TRY_CAST(nullif(replace(trim({0}), ',', ''), '') AS DOUBLE)"
_SQUEEZE = r"nullif(trim(regexp_replace(segment, '\s+', ' ', 'g')), '')"
_TALL = """SELECT "column", value FROM (SELECT balance, n_orders::DOUBLE AS n_orders, revenue,
  avg_order, tenure, recency FROM customers) UNPIVOT INCLUDE NULLS (value FOR "column" IN (balance,
  n_orders, revenue, avg_order, tenure, recency))"""
_TYPES = f"""u AS ({_UNPIVOT}), g AS (
    SELECT "column", count(DISTINCT value) AS nd, count(*) AS n, count(value) AS f,
           count(DISTINCT trim(value)) FILTER (trim(value) <> '') AS nt,
           avg((TRY_CAST(trim(value) AS DOUBLE) IS NOT NULL)::INT) FILTER (trim(value) <> '') AS ns,
           avg((TRY_CAST(trim(value) AS DATE) IS NOT NULL)::INT) FILTER (trim(value) <> '') AS ds
    FROM u GROUP BY 1),
  st AS (SELECT "column", CASE WHEN nd / n > 0.95 AND ns < 0.9 THEN 'id' WHEN nt = 2 THEN 'binary'
           WHEN ns > 0.95 THEN 'numeric' WHEN ds > 0.95 THEN 'datetime'
           WHEN nd <= greatest(20, floor(0.05 * f)) THEN 'categorical' ELSE 'text' END
           AS semantic_type FROM g)"""
_MINORITY = "least(avg(churned), 1 - avg(churned))"


def _facts(s, d):
    return p.column_facts(v.dirty(s, d), TEXT, "row_id")


def _column_facts(s, d):
    return p.collect_facts(v.dirty(s, d), TEXT, "row_id")


def _likely_columns(s, facts):
    found = [("target", c) for c in p.likely_targets(facts)]
    found += [(role, c) for role, c in (("time", p.likely_time(facts)), ("revenue", p.likely_revenue(facts))) if c]
    return s.createDataFrame(found, "role string, column string")


def _target_feasible(s, facts):
    """What the rule sees in every column that holds a value, and what it says of the table."""
    feasible = p.target_problem(facts) is None
    rows = [(f.column, f.is_binary, f.single_value, feasible) for f in facts if f.low is not None]
    out = s.createDataFrame(rows, "column string, is_binary boolean, single_value boolean, feasible boolean")
    return out.select("column", "is_binary", "single_value",
                      F.col("column").rlike("(?i)" + p.TARGET_NAME).alias("named_like_target"), "feasible")


def _typed(s, d):
    return v.dirty(s, d).withColumn("balance", to_number("balance"))


def _likely_ids(s, d):
    df = v.table(s, d, "orders").withColumn("row_id", F.col("o_orderkey"))
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    return p.likely_id_columns(p.column_facts(df, cols, "row_id"))


def _role_diff(s, d):
    """Proposal of the rules against the roles a person confirmed."""
    facts = p.semantic_types(_facts(s, d)).select(
        F.col("column").alias("field"), F.col("semantic_type").alias("value"))
    confirmed = s.createDataFrame([("customer_id", "id"), ("segment", "categorical"),
                                   ("balance", "numeric"), ("region", "text"),
                                   ("last_order", "datetime"), ("tenure", "numeric")],
                                  "field string, value string")
    return p.role_diff(facts, confirmed)


def _log(s, d):
    roles = Roles("Churn", "Yes", ("customer_id",), types={
        "customer_id": "id", "segment": "categorical", "balance": "numeric",
        "region": "categorical", "last_order": "datetime"})
    return c.clean(v.dirty(s, d), roles, "row_id").log.drop("detail")


def _health(s, d):
    df = v.customers(s, d)
    cols = [x for x in df.columns if x != "customer_id"]
    miss = c.missing_report(df, cols).agg(F.avg("missing_pct").alias("m"))
    out = c.outlier_counts(df, NUMBERS).agg(F.avg("iqr_share").alias("o"))
    bal = df.agg(F.count("*").alias("n"), F.avg("churned").alias("r"))
    dup = v.dirty(s, d).withColumn("segment", squeeze("segment"))
    dups = c.duplicate_rows(dup, "row_id")
    return miss.crossJoin(out).crossJoin(bal).crossJoin(dups).select(
        c.health_score(F.col("m"), F.col("duplicates"), F.col("n"), F.col("o"),
                       F.least(F.col("r"), 1 - F.col("r"))).alias("health_score"))


QUERIES = {
    "profile_columns": (
        lambda s, d: p.profile_columns(v.dirty(s, d), TEXT, "row_id").drop("dtype").withColumn(
            "samples", F.concat_ws("|", "samples")),
        oracle("dirty", f"""
  WITH u AS ({_UNPIVOT}),
  g AS (SELECT "column", value, count(*) AS n, min(row_id) AS f FROM u GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY f, value) AS k
        FROM g WHERE trim(value) <> '')
  SELECT g."column", round(100 * sum(CASE WHEN value IS NULL THEN n ELSE 0 END)::DOUBLE / sum(n), 2)
           AS null_pct, count(value) AS n_distinct, any_value(samples) AS samples
  FROM g JOIN (SELECT "column", string_agg(left(trim(value), 60), '|' ORDER BY k) AS samples
               FROM k WHERE k <= 5 GROUP BY 1) s ON s."column" = g."column" GROUP BY 1""")),
    "numeric_share": (
        lambda s, d: _facts(s, d).select("column", "numeric_share"),
        oracle("dirty", f"""
  SELECT "column", avg((TRY_CAST(trim(value) AS DOUBLE) IS NOT NULL)::INT) AS numeric_share
  FROM ({_UNPIVOT}) WHERE trim(value) <> '' GROUP BY 1""")),
    "likely_ids": (
        _likely_ids,
        """WITH o AS (SELECT *, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS pk,
                             lag(o_custkey) OVER (ORDER BY o_orderkey) AS pc FROM orders),
  s AS (SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey) / count(*) AS r,
               bool_and(coalesce(pk <= o_orderkey, true)) AS up, false AS named FROM o
        UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) / count(*),
               bool_and(coalesce(pc <= o_custkey, true)), false FROM o)
  SELECT "column" FROM s WHERE r > 0.95 AND (up OR named)"""),
    "binary_values": (
        lambda s, d: _facts(s, d).where("is_binary").select("column", "low", "high"),
        oracle("dirty", f"""
  SELECT "column", min(trim(value)) AS low, max(trim(value)) AS high FROM ({_UNPIVOT})
  WHERE trim(value) <> '' GROUP BY 1 HAVING count(DISTINCT trim(value)) = 2""")),
    "minority_label": (
        lambda s, d: s.createDataFrame([(f.column, p.positive_label(f)) for f in _column_facts(s, d) if f.is_binary],
                                       "column string, minority string"),
        oracle("dirty", f"""
  WITH g AS (SELECT "column", trim(value) AS t, count(*) AS n FROM ({_UNPIVOT})
             WHERE trim(value) <> '' GROUP BY 1, 2)
  SELECT "column", first(t ORDER BY coalesce(list_position({list(p.POSITIVE_WORDS)!r}, lower(t)), 99), n, t DESC) AS minority
  FROM g GROUP BY 1 HAVING count(*) = 2""")),
    "likely_columns": (
        lambda s, d: _likely_columns(s, _column_facts(s, d)),
        oracle("dirty", f"""
  WITH o AS (SELECT * FROM (VALUES {", ".join(f"({c!r}, {i})" for i, c in enumerate(TEXT))}) t("column", i)),
  f AS (SELECT "column", count(DISTINCT trim(value)) = 2 AS two,
      avg((TRY_CAST(trim(value) AS DOUBLE) IS NOT NULL)::INT) AS ns FROM ({_UNPIVOT}) WHERE trim(value) <> '' GROUP BY 1)
  SELECT 'target' AS role, "column" FROM f JOIN o USING ("column") WHERE two AND regexp_matches("column", '(?i){p.TARGET_NAME}')
  UNION ALL (SELECT 'time', "column" FROM f JOIN o USING ("column")
    WHERE ns > {p.TYPE_SHARE} AND regexp_matches("column", '(?i){p.TIME_NAME}') ORDER BY i LIMIT 1)
  UNION ALL (SELECT 'revenue', "column" FROM f JOIN o USING ("column")
    WHERE ns > {p.TYPE_SHARE} AND regexp_matches("column", '(?i){p.REVENUE_NAME}') ORDER BY i LIMIT 1)""")),
    "semantic_types": (
        lambda s, d: p.semantic_types(_facts(s, d)),
        oracle("dirty", f"""
  WITH {_TYPES} SELECT * FROM st""")),
    "target_feasible": (
        lambda s, d: _target_feasible(s, _column_facts(s, d)),
        oracle("dirty", f"""
  WITH f AS (SELECT "column", count(DISTINCT trim(value)) AS n, regexp_matches("column", '(?i){p.TARGET_NAME}') AS named
    FROM ({_UNPIVOT}) WHERE trim(value) <> '' GROUP BY "column")
  SELECT "column", n = 2 AS is_binary, n = 1 AS single_value, named AS named_like_target,
         bool_or(n = 2) OVER () AND (bool_or(n = 2 AND named) OVER () OR NOT bool_or(n = 1 AND named) OVER ()) AS feasible
  FROM f""")),
    "role_diff": (
        _role_diff,
        oracle("dirty", f"""
  WITH {_TYPES}, c AS (SELECT * FROM (VALUES ('customer_id', 'id'), ('segment', 'categorical'),
    ('balance', 'numeric'), ('region', 'text'), ('last_order', 'datetime'), ('tenure', 'numeric'))
    t(field, value))
  SELECT coalesce(field, "column") AS field, semantic_type AS proposed, value AS confirmed
  FROM st FULL JOIN c ON field = "column" WHERE semantic_type IS DISTINCT FROM value""")),
    "coerce_numeric": (
        lambda s, d: _typed(s, d).select("row_id", "balance"),
        oracle("dirty", f"SELECT row_id, {_NUM.format('balance')} AS balance FROM dirty")),
    "numeric_issues": (
        lambda s, d: c.numeric_issues(v.dirty(s, d), ["balance", "segment"]),
        oracle("dirty", " UNION ALL ".join(f"""
  SELECT '{x}' AS "column", count(*) FILTER (trim({x}) = '') AS blanks,
         count(*) FILTER (trim({x}) <> '' AND {_NUM.format(x)} IS NULL) AS unparseable FROM dirty"""
                                           for x in ("balance", "segment")))),
    "coerce_datetime": (
        lambda s, d: v.dirty(s, d).select("row_id", to_time("last_order").alias("last_order")),
        oracle("dirty", """SELECT row_id, coalesce(try_strptime(last_order, '%Y-%m-%d'), try_strptime(last_order, '%m/%d/%Y'),
    try_strptime(last_order, '%d %b %Y'), try_strptime(last_order, '%b %d, %Y')) AS last_order FROM dirty""")),
    "normalise_text": (
        lambda s, d: v.dirty(s, d).select("row_id", squeeze("segment").alias("segment")),
        oracle("dirty", f"SELECT row_id, {_SQUEEZE} AS segment FROM dirty")),
    "whitespace_changes": (
        lambda s, d: c.whitespace_changes(v.dirty(s, d), ["segment", "region"]),
        oracle("dirty", f"""
  SELECT 'segment' AS "column", count(*) FILTER (segment <> {_SQUEEZE}) AS rows_affected FROM dirty
  UNION ALL SELECT 'region', count(*) FILTER (region <> trim(region)) FROM dirty""")),
    "unify_case": (
        lambda s, d: c.unify_case(v.dirty(s, d), "segment").select("row_id", "segment"),
        oracle("dirty", f"""
  WITH t AS (SELECT row_id, {_SQUEEZE} AS sp FROM dirty),
  b AS (SELECT lower(sp) AS k, first(sp ORDER BY n DESC, sp) AS canon
        FROM (SELECT sp, count(*) AS n FROM t WHERE sp IS NOT NULL GROUP BY 1) GROUP BY 1)
  SELECT row_id, canon AS segment FROM t LEFT JOIN b ON lower(sp) = k""")),
    "spelling_changes": (
        lambda s, d: c.spelling_changes(v.dirty(s, d), "segment"),
        oracle("dirty", f"""
  WITH n AS (SELECT sp, count(*) AS n FROM (SELECT {_SQUEEZE} AS sp FROM dirty)
             WHERE sp IS NOT NULL GROUP BY 1),
  b AS (SELECT lower(sp) AS k, first(sp ORDER BY n DESC, sp) AS canon FROM n GROUP BY 1)
  SELECT sp AS spelling, canon AS canonical, n FROM n JOIN b ON lower(sp) = k WHERE sp <> canon""")),
    "drop_exact_duplicates": (
        lambda s, d: c.drop_exact_duplicates(v.dirty(s, d), "row_id"),
        oracle("dirty", """
  SELECT min(row_id) AS row_id, customer_id, segment, balance, region, last_order, "Churn"
  FROM dirty GROUP BY ALL""")),
    "duplicate_rows": (
        lambda s, d: c.duplicate_rows(v.dirty(s, d), "row_id"),
        oracle("dirty", """SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE
  (row_id) FROM dirty)))::BIGINT AS duplicates FROM dirty""")),
    "shared_ids": (
        lambda s, d: c.shared_ids(v.dirty(s, d), "customer_id"),
        oracle("dirty", """SELECT sum(n)::BIGINT AS rows_affected FROM
  (SELECT count(*) AS n FROM dirty GROUP BY customer_id HAVING count(*) > 1)""")),
    "map_target": (
        lambda s, d: c.map_target(v.dirty(s, d), "Churn", "Yes").select("row_id", "Churn"),
        oracle("dirty", """SELECT row_id, (trim("Churn") = 'Yes')::INTEGER AS "Churn" FROM dirty
  WHERE trim("Churn") <> ''""")),
    "invalid_negatives": (
        lambda s, d: c.negative_shares(
            v.customers(s, d).withColumn("credit", F.col("balance") + 950), ["balance", "credit"]),
        oracle("customers", """
  SELECT 'balance' AS "column", count(*) FILTER (balance < 0) AS negatives, count(balance) AS filled,
         false AS invalid FROM customers
  UNION ALL SELECT 'credit', count(*) FILTER (balance + 950 < 0), count(balance),
         count(*) FILTER (balance + 950 < 0) / count(balance) BETWEEN 1e-12 AND 0.005
  FROM customers""")),
    "outlier_flags": (
        lambda s, d: c.outlier_flags(v.customers(s, d, False), ["revenue", "recency"]).select(
            "customer_id", "revenue_iqr", "revenue_z", "recency_iqr", "recency_z"),
        oracle("customers", """
  SELECT customer_id,
    coalesce(revenue < a - 1.5 * (b - a) OR revenue > b + 1.5 * (b - a), false) AS revenue_iqr,
    coalesce(abs(revenue - m) / s > 3, false) AS revenue_z,
    coalesce(recency < e - 1.5 * (f - e) OR recency > f + 1.5 * (f - e), false) AS recency_iqr,
    coalesce(abs(recency - m2) / s2 > 3, false) AS recency_z
  FROM customers, (SELECT quantile_cont(revenue, .25) AS a, quantile_cont(revenue, .75) AS b,
    avg(revenue) AS m, stddev_pop(revenue) AS s, quantile_cont(recency, .25) AS e,
    quantile_cont(recency, .75) AS f, avg(recency) AS m2, stddev_pop(recency) AS s2
    FROM customers)""")),
    "outlier_counts": (
        lambda s, d: c.outlier_counts(v.customers(s, d, False), NUMBERS),
        oracle("customers", f"""
  WITH t AS ({_TALL}), q AS (SELECT "column" AS k, quantile_cont(value, .25) AS a,
    quantile_cont(value, .75) AS b, avg(value) AS m, stddev_pop(value) AS s FROM t GROUP BY 1),
  z AS (SELECT "column", coalesce(value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a), false) AS i,
               coalesce(abs(value - m) / s > 3, false) AS z FROM t JOIN q ON k = "column")
  SELECT "column", count(*) FILTER (i) AS iqr, count(*) FILTER (z) AS zscore,
         count(*) FILTER (i OR z) AS either, count(*) FILTER (i) / count(*) AS iqr_share
  FROM z GROUP BY 1""")),
    "fill_unknown": (
        lambda s, d: c.fill_unknown(v.dirty(s, d).withColumn("segment", squeeze("segment")),
                                    ["segment"]).select("row_id", "segment"),
        oracle("dirty", f"SELECT row_id, coalesce({_SQUEEZE}, 'Unknown') AS segment FROM dirty")),
    "missing_report": (
        lambda s, d: c.missing_report(v.customers(s, d, False), NUMBERS),
        oracle("customers", f"""SELECT "column", round(100 * avg((value IS NULL)::INT), 2)
  AS missing_pct FROM ({_TALL}) GROUP BY 1""")),
    "class_balance": (
        lambda s, d: c.class_balance(v.customers(s, d, False), "churned"),
        oracle("customers", """SELECT count(*) FILTER (churned = 1) AS positive,
  count(*) FILTER (churned = 0) AS negative, round_even(avg(churned), 4) AS positive_rate
  FROM customers""")),
    "health_score": (
        _health,
        oracle("customers dirty", f"""
  WITH m AS (SELECT avg(p) AS m FROM (SELECT round(100 * avg((v IS NULL)::INT), 2) AS p FROM
    (SELECT * FROM (SELECT COLUMNS(* EXCLUDE (customer_id))::VARCHAR FROM customers)
     UNPIVOT INCLUDE NULLS (v FOR k IN (region, nation, segment, balance, n_orders, revenue,
     avg_order, returned_share, tenure, recency, churned))) GROUP BY k)),
  q AS (SELECT "column" AS k, quantile_cont(value, .25) AS a, quantile_cont(value, .75) AS b
        FROM ({_TALL}) GROUP BY 1),
  o AS (SELECT avg(f) AS o FROM (SELECT count(*) FILTER (value < a - 1.5 * (b - a)
          OR value > b + 1.5 * (b - a)) / count(*) AS f FROM ({_TALL}) JOIN q ON k = "column"
          GROUP BY k)),
  d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT customer_id, {_SQUEEZE}, balance,
        region, last_order, "Churn" FROM dirty)) AS d FROM dirty),
  b AS (SELECT count(*) AS n, {_MINORITY} AS r FROM customers)
  SELECT round_even(least(100, greatest(0, 100 - 40 * m / 100 - 20 * least(1, 10.0 * d / n)
    - 20 * least(1, 5 * o) - 20 * least(1, greatest(0, 0.5 - r) / 0.45))), 0)::INTEGER
    AS health_score FROM m, o, d, b""")),
    "cleaning_log": (
        _log,
        oracle("dirty", f"""
  WITH t AS (SELECT row_id, customer_id, {_SQUEEZE} AS sp, {_NUM.format('balance')} AS bal, region,
             last_order, "Churn" AS ch, segment, balance FROM dirty),
  b AS (SELECT lower(sp) AS k, first(sp ORDER BY n DESC, sp) AS canon
        FROM (SELECT sp, count(*) AS n FROM t WHERE sp IS NOT NULL GROUP BY 1) GROUP BY 1),
  f AS (SELECT DISTINCT customer_id, canon, bal, region, last_order, ch
        FROM t LEFT JOIN b ON lower(sp) = k),
  q AS (SELECT quantile_cont(bal, .25) AS a, quantile_cont(bal, .75) AS e, avg(bal) AS m,
               stddev_pop(bal) AS s FROM f),
  l AS (
   SELECT 'blank_to_missing' AS step, 'balance' AS "column", count(*) FILTER (trim(balance) = '') AS n
     FROM t
   UNION ALL SELECT 'coerce_numeric', 'balance', count(*) FILTER (trim(balance) <> '' AND bal IS NULL)
     FROM t
   UNION ALL SELECT 'trim_whitespace', 'segment', count(*) FILTER (segment <> sp) FROM t
   UNION ALL SELECT 'unify_case', 'segment', count(*) FILTER (sp <> canon) FROM t JOIN b ON lower(sp) = k
   UNION ALL SELECT 'drop_duplicates', NULL, (SELECT count(*) FROM t) - (SELECT count(*) FROM f)
   UNION ALL SELECT 'map_target', 'Churn', count(*) FROM f
   UNION ALL SELECT 'flag_outliers', 'balance', count(*) FILTER (bal < a - 1.5 * (e - a)
     OR bal > e + 1.5 * (e - a) OR abs(bal - m) / s > 3) FROM f, q
   UNION ALL SELECT 'missing_left_for_model', 'balance', count(*) FILTER (bal IS NULL) FROM f
   UNION ALL SELECT 'fill_unknown', 'segment', count(*) FILTER (canon IS NULL) FROM f)
  SELECT step, "column", n::BIGINT AS rows_affected FROM l WHERE n > 0""")),
}
