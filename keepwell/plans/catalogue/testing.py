"""Hypothesis-test and model-metric queries."""

from pyspark.sql import functions as F

from keepwell.functions.scalar import col
from keepwell.operators import describe
from keepwell.operators import hypothesis as h
from keepwell.operators import metrics as m
from keepwell.plans import views as v
from keepwell.plans.catalogue.description import _LEVELS, _TALL, NUMBERS, base, rounded, with_wealth
from keepwell.plans.views import oracle

WORDS = ["region", "segment", "nation", "wealth"]
_P = _TALL.format("planted")


def levels(s, d):
    return h.contingency_table(with_wealth(s, d), WORDS, "churned")


def moments(s, d):
    return h.group_moments(base(s, d), NUMBERS, "churned")


def scores(s, d):
    t = v.scored(s, d).withColumn("q", F.round(F.sqrt("p"), 3))
    return m.long_scores(t, "y", {"raw": "p", "calibrated": "q"}, "id")


def _tests(s, d):
    return h.run_tests(with_wealth(s, d), WORDS, NUMBERS, "churned")


def _family(s, d):
    """A family of p-values taken from the data itself: one per nation."""
    return (v.planted(s, d, False).groupBy("nation").agg(F.avg("balance").alias("b"))
            .select(F.col("nation").alias("variable"),
                    F.round(F.abs(F.sin("b")), 6).alias("p_value")))


_FAMILY = """f AS (SELECT nation AS variable, round(abs(sin(avg(balance))), 6) AS p_value FROM planted
  GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m FROM f),
  bh AS (SELECT variable, p_value, least(1.0::DOUBLE, min(p_value * m / k) OVER (ORDER BY k DESC
    ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM r)"""
_X = f"""l AS ({_LEVELS}), w AS (SELECT *, sum(retained) OVER v AS r, sum(churned) OVER v AS c,
    count(*) OVER v AS k FROM l WINDOW v AS (PARTITION BY variable)),
  x AS (SELECT variable, level, k, r + c AS n, (retained + churned) * r / (r + c) AS e0,
               (retained + churned) * c / (r + c) AS e1, retained, churned FROM w)"""
_M = f"""t AS ({_P}), g AS (SELECT feature AS variable,
   count(*) FILTER (churned = 0) AS n0, avg(value) FILTER (churned = 0) AS mean0,
   stddev_samp(value) FILTER (churned = 0) AS sd0, stddev_pop(value) FILTER (churned = 0) AS sp0,
   count(*) FILTER (churned = 1) AS n1, avg(value) FILTER (churned = 1) AS mean1,
   stddev_samp(value) FILTER (churned = 1) AS sd1, stddev_pop(value) FILTER (churned = 1) AS sp1
   FROM t GROUP BY 1)"""
_SC = """sc AS (SELECT id AS row_id, y, p, kind FROM (SELECT id, y, p AS raw, round(sqrt(p), 3) AS calibrated
  FROM scored) UNPIVOT (p FOR kind IN (raw, calibrated))),
  st AS (SELECT kind, p, count(*) AS n, sum(y) AS pos FROM sc GROUP BY 1, 2),
  rk AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY p DESC, row_id) AS k,
                count(*) OVER (PARTITION BY kind) AS tot, sum(y) OVER (PARTITION BY kind) AS pt FROM sc)"""


def _grid(rows, points):
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o) AS k,
    count(*) OVER (PARTITION BY kind) AS len FROM {rows}),
  gr AS (SELECT DISTINCT kind, round_even(i * ((len - 1) / {points - 1}.0::DOUBLE), 0)::BIGINT + 1 AS k
         FROM (SELECT DISTINCT kind, len FROM o), range({points}) r(i)),
  th AS (SELECT * FROM o WHERE len <= {points} OR (kind, k) IN (SELECT (kind, k) FROM gr))"""


QUERIES = {
    "contingency_table": (levels, oracle("planted", f"SELECT * FROM ({_LEVELS})")),
    "expected_counts": (
        lambda s, d: rounded(h.expected_counts(levels(s, d)), "expected_retained",
                             "expected_churned"),
        oracle("planted", f"""WITH {_X} SELECT variable, level, retained, churned,
  round(e0, 9) AS expected_retained, round(e1, 9) AS expected_churned, least(e0, e1) >= 5 AS enough
  FROM x""")),
    "chi_square_test": (
        lambda s, d: rounded(h.association(levels(s, d)).select(
            "variable", "n", "df", "chi2", "cramers_v", "min_expected"),
            "chi2", "cramers_v", "min_expected", places=6),
        oracle("planted", f"""WITH {_X} SELECT variable, n::BIGINT AS n, k - 1 AS df,
  round(q, 6) AS chi2, round(sqrt(q / n), 6) AS cramers_v, round(me, 6) AS min_expected FROM (
  SELECT variable, x.n AS n, k, sum((retained - e0)^2 / e0 + (churned - e1)^2 / e1) AS q,
         min(least(e0, e1)) AS me FROM x GROUP BY variable, x.n, k)""")),
    "chi_square_cells": (
        lambda s, d: rounded(h.cell_contributions(levels(s, d)), "retained", "churned"),
        oracle("planted", f"""WITH {_X} SELECT variable, level, round((retained - e0)^2 / e0, 9)
  AS retained, round((churned - e1)^2 / e1, 9) AS churned FROM x""")),
    "group_stats": (
        lambda s, d: rounded(describe.numeric_summary(base(s, d), NUMBERS, "churned")
                             .where(F.col("group") != "all")
                             .select("feature", "group", "n", "mean", "median", "sd"),
                             "mean", "sd", "median", places=6),
        oracle("planted", f"""SELECT feature, CASE WHEN churned = 1 THEN 'churned' ELSE 'retained'
  END AS "group", count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, .5), 6) AS median,
  round(stddev_samp(value), 6) AS sd FROM ({_P}) GROUP BY 1, 2""")),
    "normality_check": (
        lambda s, d: rounded(h.normality(moments(s, d)), "jb0", "jb1", "p_normal0", "p_normal1",
                             places=6),
        oracle("planted", f"""WITH {_M}, q AS (SELECT variable, churned, n,
     m3 / power(m2, 1.5) AS sk, m4 / (m2 * m2) - 3 AS ku FROM (
     SELECT variable, churned, count(*) AS n, avg((value - mu)^2) AS m2, avg((value - mu)^3) AS m3,
            avg((value - mu)^4) AS m4 FROM (SELECT variable, churned, value,
              CASE WHEN churned = 1 THEN mean1 ELSE mean0 END AS mu FROM t JOIN g ON variable = feature)
     GROUP BY 1, 2)),
  j AS (SELECT variable, churned, n / 6 * (sk^2 + ku^2 / 4) AS jb FROM q)
  SELECT a.variable, round(a.jb, 6) AS jb0, round(exp(-a.jb / 2), 6) AS p_normal0,
    round(b.jb, 6) AS jb1, round(exp(-b.jb / 2), 6) AS p_normal1,
    exp(-a.jb / 2) >= 0.05 AND exp(-b.jb / 2) >= 0.05 AS normal
  FROM j a JOIN j b ON a.variable = b.variable AND a.churned = 0 AND b.churned = 1""")),
    "levene_test": (
        lambda s, d: rounded(h.levene(base(s, d), NUMBERS, "churned"), "w", places=6),
        oracle("planted", f"""WITH t AS ({_P}), q AS (SELECT feature AS f, churned AS c,
     quantile_cont(value, .5) AS md FROM t GROUP BY 1, 2),
  z AS (SELECT feature, churned, abs(value - md) AS z FROM t JOIN q ON f = feature AND c = churned),
  g AS (SELECT feature, churned, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY 1, 2),
  a AS (SELECT feature AS f, count(*) AS n, avg(z) AS m FROM z GROUP BY 1)
  SELECT f AS variable, a.n AS n, round((a.n - 2) * sum(g.n * (g.m - a.m)^2) / sum(g.n * g.v), 6) AS w
  FROM g JOIN a ON f = feature GROUP BY f, a.n""")),
    "welch_t_test": (
        lambda s, d: rounded(h.welch(moments(s, d)), "t", "df", "cohens_d", places=6),
        oracle("planted", f"""WITH {_M}, k AS (SELECT *, sd1^2 / n1 AS a, sd0^2 / n0 AS b FROM g)
  SELECT variable, round((mean1 - mean0) / sqrt(a + b), 6) AS t,
    round((a + b)^2 / (a^2 / (n1 - 1) + b^2 / (n0 - 1)), 6) AS df,
    round((mean1 - mean0) / sqrt(((n1 - 1) * sd1^2 + (n0 - 1) * sd0^2) / (n1 + n0 - 2)), 6) AS cohens_d
  FROM k""")),
    "mann_whitney_u": (
        lambda s, d: rounded(h.mann_whitney(base(s, d), NUMBERS, "churned"), "rank_biserial", "z"),
        oracle("planted", f"""WITH t AS ({_P}), r AS (SELECT feature, churned,
    rank() OVER (PARTITION BY feature ORDER BY value) AS r, count(*) OVER (PARTITION BY feature, value) AS c
    FROM t), s AS (SELECT feature, sum(churned)::BIGINT AS n1, sum(1 - churned)::BIGINT AS n0,
    sum(CASE WHEN churned = 1 THEN r + (c - 1) / 2.0::DOUBLE ELSE 0 END) AS r1,
    sum(c::DOUBLE * c - 1) AS tt, count(*) AS n, max(c) > 1 AS ties FROM r GROUP BY 1),
  u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u,
        sqrt(n1::DOUBLE * n0 / 12 * (n + 1 - tt / (n::DOUBLE * (n - 1)))) AS sd FROM s)
  SELECT feature AS variable, n1, n0, u, round(2 * u / (n1 * n0) - 1, 9) AS rank_biserial,
    round((greatest(u, n1 * n0 - u) - n1 * n0 / 2.0::DOUBLE - 0.5) / sd, 9) AS z, ties FROM u""")),
    "effect_band": (
        lambda s, d: h.with_bands(describe.correlation_with_target(base(s, d), NUMBERS, "churned")
                                  .select(F.col("feature").alias("variable"),
                                          (F.abs("r") * 2).alias("effect"),
                                          F.lit("cramers_v").alias("effect_name")))
        .select("variable", "band"),
        oracle("planted", f"""SELECT feature AS variable, CASE WHEN e < .1 THEN 'negligible'
  WHEN e < .3 THEN 'small' WHEN e < .5 THEN 'medium' ELSE 'large' END AS band
  FROM (SELECT feature, 2 * abs(corr(value, churned)) AS e FROM ({_P}) GROUP BY 1)""")),
    "benjamini_hochberg": (
        lambda s, d: rounded(h.benjamini_hochberg(_family(s, d)), "p_adjusted"),
        oracle("planted", f"""WITH {_FAMILY} SELECT variable, p_value, round(p_adjusted, 9) AS p_adjusted,
  p_adjusted < 0.05 AS significant FROM bh""")),
    "resignify": (
        lambda s, d: h.resignify(h.benjamini_hochberg(_family(s, d)), [0.01, 0.05, 0.1, 0.5, 0.9]),
        oracle("planted", f"""WITH {_FAMILY} SELECT a AS alpha, count(*) FILTER (p_adjusted < a)
  AS n_significant FROM bh, (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.5), (0.9)) v(a) GROUP BY 1""")),
    "order_by_evidence": (
        lambda s, d: describe.order_by_evidence(
            h.benjamini_hochberg(_family(s, d)).where("p_adjusted < 0.9"),
            v.table(s, d, "nation").select(F.col("n_name").alias("column"))).select("column", "place"),
        oracle("planted", f"""WITH {_FAMILY} SELECT n_name AS "column",
  row_number() OVER (ORDER BY coalesce(p_adjusted, 1), n_name)::INTEGER AS place
  FROM nation LEFT JOIN (SELECT * FROM bh WHERE p_adjusted < 0.9) ON variable = n_name""")),
    "skip_rules": (
        lambda s, d: h.skip_reasons(
            with_wealth(s, d).withColumns({"fixed": F.lit("a"), "zero": F.lit(0.0)}),
            [*WORDS, "fixed"], ["balance", "tenure", "zero"], "churned"),
        oracle("planted", """
  SELECT variable, 'categorical' AS kind, CASE WHEN k < 2 THEN 'constant column' END AS reason FROM (SELECT variable, count(DISTINCT level) AS k FROM (
    SELECT region, segment, nation, CASE WHEN balance >= 5000 THEN 'rich' ELSE 'other' END AS wealth,
    'a' AS fixed FROM planted) UNPIVOT (level FOR variable IN (region, segment, nation, wealth, fixed))
    GROUP BY 1)
  UNION ALL SELECT variable, 'numeric', CASE WHEN a = b THEN 'constant column' END FROM (
    SELECT variable, min(x) AS a, max(x) AS b FROM (SELECT balance, tenure, 0.0::DOUBLE AS zero
    FROM planted) UNPIVOT (x FOR variable IN (balance, tenure, zero)) GROUP BY 1)""")),
    "hypothesis_tests": (_tests, None),
    "test_family_counts": (lambda s, d: h.family_counts(_tests(s, d)), None),
    "roc_auc": (
        lambda s, d: rounded(m.roc_auc(scores(s, d)), "roc_auc"),
        oracle("scored", f"""WITH {_SC}, r AS (SELECT kind, y, rank() OVER (PARTITION BY kind ORDER BY p)
    + (count(*) OVER (PARTITION BY kind, p) - 1) / 2.0::DOUBLE AS r FROM sc)
  SELECT kind, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE)
    / (sum(y)::DOUBLE * sum(1 - y)), 9) AS roc_auc FROM r GROUP BY 1""")),
    "pr_auc": (
        lambda s, d: rounded(m.pr_auc(scores(s, d)), "pr_auc"),
        oracle("scored", f"""WITH {_SC}, c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen
    FROM st WINDOW w AS (PARTITION BY kind ORDER BY p DESC))
  SELECT kind, round(sum(pos * tp / seen) / sum(pos), 9) AS pr_auc FROM c GROUP BY 1""")),
    "brier": (
        lambda s, d: rounded(m.brier(scores(s, d)), "brier"),
        oracle("scored", f"WITH {_SC} SELECT kind, round(avg((p - y)^2), 9) AS brier FROM sc GROUP BY 1")),
    "precision_at_top": (
        lambda s, d: m.at_top(scores(s, d)),
        oracle("scored", f"""WITH {_SC} SELECT kind, count(*) AS k, sum(y)::BIGINT AS churners_in_top,
  sum(y) / count(*) AS precision, sum(y) / any_value(pt) AS recall FROM rk
  WHERE k <= ceil(0.10 * tot) GROUP BY 1""")),
    "deciles": (
        lambda s, d: m.deciles(scores(s, d)),
        oracle("scored", f"""WITH {_SC}, n AS (SELECT kind, y, tot, pt, ntile(10) OVER (PARTITION BY kind
    ORDER BY p DESC, row_id) AS dc FROM rk),
  g AS (SELECT kind, dc, count(*) AS n, sum(y) AS c, any_value(tot) AS tot, any_value(pt) AS pt
        FROM n GROUP BY 1, 2)
  SELECT kind, dc::INTEGER AS decile, n, c::BIGINT AS churners, c / n AS churn_rate,
    (c / n) / (pt / tot) AS lift, sum(c) OVER w / pt AS cumulative_gain,
    sum(n) OVER w / tot AS cumulative_share FROM g WINDOW w AS (PARTITION BY kind ORDER BY dc)""")),
    "calibration_bins": (
        lambda s, d: rounded(m.calibration_bins(scores(s, d)), "mean_predicted", "observed_rate"),
        oracle("scored", f"""WITH {_SC}, e AS (SELECT i, i * 0.1::DOUBLE AS lo,
    CASE WHEN i = 9 THEN 1.0::DOUBLE ELSE (i + 1) * 0.1::DOUBLE END AS hi FROM range(10) r(i))
  SELECT k.kind, (i + 1)::INTEGER AS bin, lo AS low, hi AS high, count(p) AS n,
    round(avg(p), 9) AS mean_predicted, round(avg(y), 9) AS observed_rate
  FROM (SELECT DISTINCT kind FROM sc) k CROSS JOIN e LEFT JOIN sc ON sc.kind = k.kind
    AND (p > lo OR i = 0) AND (p <= hi OR i = 9) GROUP BY ALL""")),
    "roc_points": (
        lambda s, d: rounded(m.roc_points(scores(s, d)), "fpr", "tpr"),
        oracle("scored", f"""WITH {_SC}, c AS (SELECT kind, p, pos, n - pos AS neg,
    sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, lead(pos) OVER w AS np, lead(n - pos) OVER w AS nn
    FROM st WINDOW w AS (PARTITION BY kind ORDER BY p DESC)),
  b AS (SELECT kind, -p AS o, tp, fp FROM c WHERE np IS NULL OR np <> pos OR nn <> neg
        UNION ALL SELECT DISTINCT kind, '-infinity'::DOUBLE, 0, 0 FROM st), {_grid('b', 100)},
  mx AS (SELECT kind AS mk, max(tp) AS a, max(fp) AS z FROM b GROUP BY 1)
  SELECT kind, k AS point, round(fp / z, 9) AS fpr, round(tp / a, 9) AS tpr FROM th JOIN mx ON mk = kind""")),
    "pr_points": (
        lambda s, d: rounded(m.pr_points(scores(s, d), 40), "recall", "precision"),
        oracle("scored", f"""WITH {_SC}, b AS (SELECT kind, p AS o, sum(pos) OVER w AS tp, sum(n) OVER w AS seen
    FROM st WINDOW w AS (PARTITION BY kind ORDER BY p DESC)
    UNION ALL SELECT DISTINCT kind, 'infinity'::DOUBLE, 0, 0 FROM st), {_grid('b', 40)},
  mx AS (SELECT kind AS mk, max(tp) AS a FROM b GROUP BY 1)
  SELECT kind, k AS point, round(tp / a, 9) AS recall,
    round(CASE WHEN seen = 0 THEN 1 ELSE tp / seen END, 9) AS precision FROM th JOIN mx ON mk = kind""")),
    "threshold_metrics": (
        lambda s, d: rounded(m.threshold_metrics(scores(s, d)), "accuracy", "precision", "recall", "f1"),
        oracle("scored", f"""WITH {_SC}, g AS (SELECT kind, count(*) FILTER (p >= .5 AND y = 1) AS tp,
    count(*) FILTER (p >= .5 AND y = 0) AS fp, count(*) FILTER (p < .5 AND y = 1) AS fn,
    count(*) FILTER (p < .5 AND y = 0) AS tn FROM sc GROUP BY 1)
  SELECT *, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision,
    round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM g""")),
    "evaluate_scores": (
        lambda s, d: rounded(m.evaluate(scores(s, d)), "churn_rate", "roc_auc", "pr_auc", "brier"),
        oracle("scored", f"""WITH {_SC}, r AS (SELECT kind, y, p, rank() OVER (PARTITION BY kind ORDER BY p)
    + (count(*) OVER (PARTITION BY kind, p) - 1) / 2.0::DOUBLE AS r FROM sc),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen
    FROM st WINDOW w AS (PARTITION BY kind ORDER BY p DESC)),
  pr AS (SELECT kind AS pk, sum(pos * tp / seen) / sum(pos) AS ap FROM c GROUP BY 1)
  SELECT kind, count(*) AS n, round(avg(y), 9) AS churn_rate,
    round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE)
      / (sum(y)::DOUBLE * sum(1 - y)), 9) AS roc_auc, round(any_value(ap), 9) AS pr_auc,
    round(avg((p - y)^2), 9) AS brier FROM r JOIN pr ON pk = kind GROUP BY 1""")),
    "split_overlap": (
        lambda s, d: m.split_overlap(
            v.scored(s, d).where(v.unit("t", "id") >= 0.2),
            v.scored(s, d).where(v.unit("t", "id") < 0.2), "id"),
        oracle("scored", """SELECT count(*) AS overlap FROM scored WHERE unit('t:' || id) < 0.2
  AND id IN (SELECT id FROM scored WHERE unit('t:' || id) >= 0.2)""")),
}
