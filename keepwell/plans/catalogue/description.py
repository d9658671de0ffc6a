"""Description and survival queries."""

from pyspark.sql import functions as F

from keepwell.functions.scalar import col
from keepwell.operators import describe as e
from keepwell.operators import survival as sv
from keepwell.plans import views as v
from keepwell.plans.views import oracle

NUMBERS = ["balance", "n_orders", "revenue", "avg_order", "tenure", "recency"]
_TALL = """SELECT feature, value, churned FROM (SELECT balance, n_orders::DOUBLE AS n_orders,
  revenue, avg_order, tenure, recency, churned FROM {0}) UNPIVOT (value FOR feature IN (balance,
  n_orders, revenue, avg_order, tenure, recency))"""
_LEVELS = """SELECT variable, level, count(*) FILTER (churned = 0) AS retained,
  count(*) FILTER (churned = 1) AS churned FROM (SELECT region, segment, nation, CASE WHEN balance
  >= 5000 THEN 'rich' ELSE 'other' END AS wealth, churned FROM planted) UNPIVOT (level FOR variable
  IN (region, segment, nation, wealth)) GROUP BY 1, 2"""


def base(s, d):
    return v.planted(s, d, returns=False)


def with_wealth(s, d):
    return base(s, d).withColumn("wealth", F.when(col("balance") >= 5000, "rich")
                                 .otherwise("other"))


def rounded(df, *names, places=9):
    return df.withColumns({n: F.round(n, places) for n in names})


_CURVE = """
  {pre} g AS (SELECT {k} tenure AS t, sum(churned)::BIGINT AS d, count(*) AS c FROM {src}
             WHERE tenure >= 0 GROUP BY ALL
        UNION ALL SELECT DISTINCT {k} 0.0::DOUBLE, 0, 0 FROM {src} WHERE tenure >= 0),
  h AS (SELECT {k} t, sum(d) AS d, sum(c) AS c FROM g GROUP BY ALL),
  n AS (SELECT *, sum(c) OVER ({p} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
        FROM h),
  r AS (SELECT *, sum(CASE WHEN d > 0 AND d < n THEN ln(1 - d / n) ELSE 0 END) OVER w AS sl,
               sum(CASE WHEN d > 0 AND d < n THEN d / (n::DOUBLE * (n - d)) ELSE 0 END) OVER w AS sv,
               sum(CASE WHEN d = n AND d > 0 THEN 1 ELSE 0 END) OVER w AS ov
        FROM n WINDOW w AS ({p} ORDER BY t ROWS UNBOUNDED PRECEDING)),
  curve AS (SELECT {k} t, n::BIGINT AS n, d::BIGINT AS d,
    CASE WHEN ov > 0 THEN 0 ELSE exp(sl) END AS s,
    CASE WHEN ov > 0 THEN 0 WHEN sl = 0 THEN 1
         ELSE exp(-exp(ln(-sl) + 1.959963984540054 * sqrt(sv) / -sl)) END AS lo,
    CASE WHEN ov > 0 THEN 0 WHEN sl = 0 THEN 1
         ELSE exp(-exp(ln(-sl) - 1.959963984540054 * sqrt(sv) / -sl)) END AS hi FROM r)"""
_ONE = _CURVE.format(pre="WITH", k="", p="", src="planted")
_BY = _CURVE.format(pre="""WITH lv AS (SELECT variable, level, tenure, churned FROM (SELECT region,
    segment, tenure, churned FROM planted) UNPIVOT (level FOR variable IN (region, segment))),""",
                    k="variable, level,", p="PARTITION BY variable, level", src="lv")
_SUMMARY = """max(n) AS n, sum(d)::BIGINT AS events, min(t) FILTER (s <= 0.5) AS median,
  CASE WHEN max(t) >= 6 THEN arg_max(s, t) FILTER (t <= 6) END AS s6,
  CASE WHEN max(t) >= 12 THEN arg_max(s, t) FILTER (t <= 12) END AS s12,
  CASE WHEN max(t) >= 24 THEN arg_max(s, t) FILTER (t <= 24) END AS s24"""


def _curve(s, d):
    return sv.kaplan_meier(sv.durations(base(s, d), "tenure"), "tenure", "churned")


def _curves(s, d):
    long = sv.by_level(sv.durations(base(s, d), "tenure"), ["region", "segment"], "tenure",
                       "churned")
    return sv.kaplan_meier(long, "tenure", "churned", ["variable", "level"])


def _counts(s, d):
    return sv.logrank_counts(sv.durations(with_wealth(s, d), "tenure"),
                           ["region", "segment", "wealth"], "tenure", "churned")


_RISK = """
  WITH lv AS (SELECT variable, level, tenure AS t, churned AS d FROM (SELECT region, segment,
     CASE WHEN balance >= 5000 THEN 'rich' ELSE 'other' END AS wealth, tenure, churned FROM planted
     WHERE tenure >= 0) UNPIVOT (level FOR variable IN (region, segment, wealth))),
  g AS (SELECT variable, level, count(*) AS z FROM lv GROUP BY 1, 2 HAVING count(*) >= 5),
  ts AS (SELECT DISTINCT variable, t FROM lv),
  a AS (SELECT ts.variable, g.level, ts.t, coalesce(sum(d), 0) AS dg, count(lv.t) AS cg
        FROM ts JOIN g ON g.variable = ts.variable
        LEFT JOIN lv ON lv.variable = ts.variable AND lv.level = g.level AND lv.t = ts.t
        GROUP BY 1, 2, 3),
  r AS (SELECT *, sum(cg) OVER (PARTITION BY variable, level ORDER BY t
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ng FROM a),
  m AS (SELECT *, sum(ng) OVER v AS n, sum(dg) OVER v AS d FROM r
        WINDOW v AS (PARTITION BY variable, t))"""


def _logrank_form(pivots: int) -> str:
    """The form gap . inverse covariance . gap for up to pivots + 1 levels: the covariance, bordered by the
    gaps, is eliminated level by level, and the corner is left."""
    steps = ",\n".join(f"""  e{p + 1} AS MATERIALIZED (SELECT a.variable, a.i, a.j, a.v - coalesce(b.v * c.v / nullif(d.v, 0), 0) AS v FROM e{p} a
    LEFT JOIN e{p} b ON b.variable = a.variable AND b.i = a.i AND b.j = {p}
    LEFT JOIN e{p} c ON c.variable = a.variable AND c.i = {p} AND c.j = a.j
    LEFT JOIN e{p} d ON d.variable = a.variable AND d.i = {p} AND d.j = {p} WHERE a.i > {p} AND a.j > {p})"""
                       for p in range(pivots))
    return f""",
  w AS (SELECT *, dense_rank() OVER (PARTITION BY variable ORDER BY level) - 1 AS i,
    CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END AS s FROM m),
  z AS (SELECT variable, max(i) AS top FROM w GROUP BY 1),
  gap AS (SELECT variable, i, sum(dg - d * ng / n) AS v FROM w GROUP BY 1, 2),
  e0 AS MATERIALIZED (SELECT a.variable, a.i, b.i AS j, sum(a.s * (a.ng / a.n) * ((a.i = b.i)::INT - b.ng / b.n)) AS v
    FROM w a JOIN w b ON a.variable = b.variable AND a.t = b.t JOIN z ON z.variable = a.variable
    WHERE a.i < top AND b.i < top GROUP BY 1, 2, 3
    UNION ALL SELECT gap.variable, i, 999, v FROM gap JOIN z ON z.variable = gap.variable WHERE i < top
    UNION ALL SELECT gap.variable, 999, i, v FROM gap JOIN z ON z.variable = gap.variable WHERE i < top
    UNION ALL SELECT variable, 999, 999, 0 FROM z),
{steps}
  SELECT e.variable, round(-v, 6) AS statistic, top::INTEGER AS df FROM e{pivots} e JOIN z ON z.variable = e.variable
  WHERE i = 999 AND j = 999"""


def _association(s, d):
    return sv.association(sv.level_counts(with_wealth(s, d),
                                          ["region", "segment", "nation", "wealth"], "churned"))


QUERIES = {
    "overview": (lambda s, d: e.overview(base(s, d), "churned"), oracle("planted", """
  SELECT count(*) AS rows, sum(churned)::BIGINT AS churned, avg(churned) AS churn_rate
  FROM planted""")),
    "numeric_summary": (
        lambda s, d: rounded(e.numeric_summary(base(s, d), NUMBERS, "churned"), "mean", "sd", "q25",
                             "median", "q75", places=6),
        oracle("planted", f"""
  WITH t AS ({_TALL.format('planted').replace('UNPIVOT', 'UNPIVOT INCLUDE NULLS')}),
  g AS (SELECT feature, value, 'all' AS "group" FROM t UNION ALL
        SELECT feature, value, CASE WHEN churned = 1 THEN 'churned' ELSE 'retained' END FROM t)
  SELECT feature, "group", count(value) AS n, count(*) - count(value) AS missing,
         round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min,
         round(quantile_cont(value, .25), 6) AS q25, round(quantile_cont(value, .5), 6) AS median,
         round(quantile_cont(value, .75), 6) AS q75, max(value) AS max FROM g GROUP BY 1, 2""")),
    "histogram": (
        lambda s, d: e.histogram(base(s, d), NUMBERS),
        oracle("planted", f"""
  WITH t AS ({_TALL.format('planted')}),
  m AS (SELECT feature AS f, min(value) AS lo, max(value) AS hi,
               least(20, count(DISTINCT value)) AS k FROM t GROUP BY 1),
  b AS (SELECT *, least(floor((value - lo) / (hi - lo) * k), k - 1) AS b0 FROM t JOIN m ON f = feature),
  b1 AS (SELECT *, b0 - (value < lo + b0 * ((hi - lo) / k))::INT AS b1 FROM b),
  b2 AS (SELECT *, b1 + (value >= lo + (b1 + 1) * ((hi - lo) / k) AND b1 <> k - 1)::INT AS b2 FROM b1),
  e AS (SELECT f, lo, hi, k, unnest(range(k)) AS i FROM m)
  SELECT e.f AS feature, i AS bin, e.lo + i * (e.hi - e.lo) / e.k AS lo,
         CASE WHEN i = e.k - 1 THEN e.hi ELSE e.lo + (i + 1) * (e.hi - e.lo) / e.k END AS hi,
         count(b2.feature) AS n
  FROM e LEFT JOIN b2 ON b2.f = e.f AND b2.b2 = i GROUP BY ALL""")),
    "category_rates": (
        lambda s, d: e.category_rates(base(s, d), ["region", "segment", "nation"], "churned"),
        oracle("planted", """
  WITH l AS (SELECT feature, level, count(*) AS n, sum(churned) AS churned FROM (SELECT region,
    segment, nation, churned FROM planted) UNPIVOT (level FOR feature IN (region, segment, nation))
    GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, level) AS k,
               count(*) OVER (PARTITION BY feature) AS c FROM l)
  SELECT feature, CASE WHEN c > 20 AND k > 19 THEN 'Other' ELSE level END AS level,
         sum(n)::BIGINT AS n, sum(churned)::BIGINT AS churned, sum(churned) / sum(n) AS churn_rate
  FROM k GROUP BY 1, 2""")),
    "correlation_matrix": (
        lambda s, d: rounded(e.correlation_matrix(base(s, d), NUMBERS), "r"),
        oracle("planted", "\nUNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM planted"
            for a in NUMBERS for b in NUMBERS))),
    "correlation_with_target": (
        lambda s, d: rounded(e.correlation_with_target(base(s, d), NUMBERS, "churned"), "r"),
        oracle("planted", f"""SELECT feature, round(corr(value, churned), 9) AS r
  FROM ({_TALL.format('planted')}) GROUP BY 1""")),
    "tenure_bands": (
        lambda s, d: e.tenure_bands(base(s, d), "tenure", "churned"),
        oracle("planted", """
  SELECT lo, hi, count(*) AS n, sum(churned)::BIGINT AS churned, avg(churned) AS churn_rate
  FROM planted JOIN (VALUES (0.0::DOUBLE, 6.0::DOUBLE), (6, 12), (12, 24), (24, 48), (48, NULL))
    b(lo, hi) ON tenure >= lo AND (hi IS NULL OR tenure < hi)
  WHERE (SELECT max(tenure) FROM planted) <= 120 GROUP BY 1, 2""")),
    "quantile_bands": (
        lambda s, d: e.tenure_bands(base(s, d), "recency", "churned"),
        oracle("planted", """
  WITH q AS (SELECT DISTINCT unnest(quantile_cont(recency, [0, .2, .4, .6, .8])) AS lo FROM planted),
  b AS (SELECT lo, lead(lo) OVER (ORDER BY lo) AS hi FROM q)
  SELECT lo, hi, count(*) AS n, sum(churned)::BIGINT AS churned, avg(churned) AS churn_rate
  FROM planted JOIN b ON recency >= lo AND (hi IS NULL OR recency < hi) GROUP BY 1, 2""")),
    "top_correlations": (
        lambda s, d: rounded(e.top_correlations(
            e.correlation_matrix(base(s, d), NUMBERS),
            e.correlation_with_target(base(s, d), NUMBERS, "churned"), 3), "r"),
        oracle("planted", "WITH m AS (" + "\nUNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM planted"
            for a in NUMBERS for b in NUMBERS) + f"""),
  k AS (SELECT feature FROM (SELECT feature, corr(value, churned) AS r FROM
        ({_TALL.format('planted')}) GROUP BY 1) ORDER BY abs(r) DESC, feature LIMIT 3)
  SELECT * FROM m WHERE a IN (FROM k) AND b IN (FROM k)""")),
    "duration_filter": (
        lambda s, d: sv.dropped_durations(base(s, d), "tenure"),
        oracle("planted", """SELECT count(*) FILTER (tenure IS NULL OR tenure < 0) AS rows_dropped
  FROM planted""")),
    "kaplan_meier": (lambda s, d: rounded(_curve(s, d), "s", "lo", "hi"), oracle("planted", _ONE + """
  SELECT t, n, d, round(s, 9) AS s, round(lo, 9) AS lo, round(hi, 9) AS hi FROM curve""")),
    "survival_summary": (
        lambda s, d: rounded(sv.survival_summary(_curve(s, d)), "s6", "s12", "s24"),
        oracle("planted", _ONE + f"""SELECT n, events, median, round(s6, 9) AS s6,
  round(s12, 9) AS s12, round(s24, 9) AS s24 FROM (SELECT {_SUMMARY} FROM curve)""")),
    "curve_downsample": (
        lambda s, d: rounded(sv.downsample(_curve(s, d)), "s", "lo", "hi"),
        oracle("planted", _ONE + """,
  o AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS len FROM curve),
  grid AS (SELECT DISTINCT round_even(k * ((len - 1) / 199.0::DOUBLE), 0)::BIGINT AS i
        FROM (SELECT DISTINCT len FROM o), range(200) r(k))
  SELECT t, n, d, round(s, 9) AS s, round(lo, 9) AS lo, round(hi, 9) AS hi FROM o
  WHERE len <= 200 OR i IN (SELECT i FROM grid)""")),
    "survival_by_level": (
        lambda s, d: rounded(_curves(s, d), "s", "lo", "hi"),
        oracle("planted", _BY + """SELECT variable, level, t, n, d, round(s, 9) AS s,
  round(lo, 9) AS lo, round(hi, 9) AS hi FROM curve""")),
    "survival_summary_by_level": (
        lambda s, d: rounded(sv.survival_summary(_curves(s, d), ["variable", "level"]),
                             "s6", "s12", "s24"),
        oracle("planted", _BY + f"""SELECT variable, level, n, events, median, round(s6, 9) AS s6,
  round(s12, 9) AS s12, round(s24, 9) AS s24
  FROM (SELECT variable, level, {_SUMMARY} FROM curve GROUP BY 1, 2)""")),
    "cramers_v": (
        lambda s, d: rounded(_association(s, d).select("variable", "n", "levels", "cramers_v"),
                             "cramers_v"),
        oracle("planted", f"""
  WITH l AS ({_LEVELS}), w AS (SELECT *, sum(retained) OVER v AS r, sum(churned) OVER v AS c,
    count(*) OVER v AS k FROM l WINDOW v AS (PARTITION BY variable)),
  x AS (SELECT variable, k, r + c AS n, (retained + churned) * r / (r + c) AS e0,
               (retained + churned) * c / (r + c) AS e1, retained, churned FROM w)
  SELECT variable, any_value(x.n)::BIGINT AS n, k AS levels, round(sqrt(sum((retained - e0)^2 / e0 + (churned - e1)^2 / e1)
    / any_value(x.n)), 9) AS cramers_v FROM x GROUP BY variable, k, x.n""")),
    "pick_group_columns": (
        lambda s, d: rounded(sv.pick_group_columns(_association(s, d)), "cramers_v"),
        oracle("planted", f"""
  WITH l AS ({_LEVELS}), w AS (SELECT *, sum(retained) OVER v AS r, sum(churned) OVER v AS c,
    count(*) OVER v AS k FROM l WINDOW v AS (PARTITION BY variable)),
  x AS (SELECT variable, r + c AS n, (retained + churned) * r / (r + c) AS e0,
               (retained + churned) * c / (r + c) AS e1, retained, churned
        FROM w WHERE k BETWEEN 2 AND 6)
  SELECT variable, round(sqrt(sum((retained - e0)^2 / e0 + (churned - e1)^2 / e1) / n), 9)
    AS cramers_v FROM x GROUP BY variable, n ORDER BY cramers_v DESC, variable LIMIT 3""")),
    "logrank_table": (
        lambda s, d: rounded(sv.logrank_table(_counts(s, d)), "expected", "variance", places=6),
        oracle("planted", _RISK + """
  SELECT variable, level, sum(dg)::BIGINT AS observed, round(sum(d * ng / n), 6) AS expected,
    round(sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * (ng / n) * (1 - ng / n) ELSE 0 END), 6)
    AS variance FROM m GROUP BY 1, 2""")),
    "logrank_statistic": (
        lambda s, d: rounded(sv.logrank_statistics(_counts(s, d)), "statistic", places=6),
        oracle("planted", _RISK + _logrank_form(5))),
    "logrank_test": (lambda s, d: sv.logrank_tests(_counts(s, d)), None),
}
