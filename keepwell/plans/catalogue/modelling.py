"""Segmentation, model, calibration and explanation queries on the planted outcome."""

from pyspark.sql import functions as F

from keepwell.functions.scalar import col
from keepwell.functions.stored import stored
from keepwell.operators import explain as x
from keepwell.operators import hypothesis as h
from keepwell.operators import metrics as m
from keepwell.operators import model as ml
from keepwell.operators.isotonic import isotonic
from keepwell.operators import nbo
from keepwell.operators import segment as g
from keepwell.plans import views as v
from keepwell.plans.catalogue.description import base, rounded
from keepwell.plans.views import oracle

NUM = ["balance", "revenue", "recency"]
CAT = ["segment", "region"]
SEG = ["balance", "revenue", "recency"]
_FILL = """f AS (SELECT customer_id, segment, churned, coalesce(balance, a) AS balance, coalesce(revenue, b) AS revenue,
    coalesce(recency, c) AS recency FROM planted, (SELECT quantile_cont(balance, .5) AS a, quantile_cont(revenue, .5) AS b,
    quantile_cont(recency, .5) AS c FROM planted)),
  st AS (SELECT avg(balance) AS m1, stddev_pop(balance) AS s1, avg(revenue) AS m2, stddev_pop(revenue) AS s2,
    avg(recency) AS m3, stddev_pop(recency) AS s3, avg(churned) AS r, count(*) AS n FROM f),
  z AS (SELECT customer_id, segment, churned, (balance - m1) / s1 AS balance_z, (revenue - m2) / s2 AS revenue_z,
    (recency - m3) / s3 AS recency_z FROM f, st)"""


def split(s, d):
    return ml.stratified_split(base(s, d), "churned", "customer_id")


def train(s, d):
    return split(s, d).where(~col("is_test"))


def _parts(s, d):
    """(training part, test part, all customers), written once for all passes over them."""
    rows = stored(base(s, d).select("customer_id", *NUM, *CAT, "churned"))
    both = stored(ml.stratified_split(rows, "churned", "customer_id"))
    return both.where(~col("is_test")), both.where(col("is_test")), rows


def _fit(known, learner="logistic", trees=10):
    return ml.fit(known, NUM, CAT, "churned", learner=learner, trees=trees)


def _explained(s, d, learner="logistic"):
    known, held, _ = _parts(s, d)
    f = _fit(known, learner, 50)
    return f, x.contributions(f, held, known)


def _scaled(s, d):
    df = base(s, d)
    return g.impute_and_scale(df, SEG, g.scales(df, SEG))


def _silhouette(s, d):
    df = _scaled(s, d).withColumn("group", F.floor(v.unit("g", "customer_id") * 3).cast("int"))
    return g.silhouettes(df, [f"{c}_z" for c in SEG], ["group"])


def _profile(s, d):
    df = base(s, d)
    return g.segment_profile(df, "segment", SEG, "churned", g.scales(df, SEG))


def _segmentation(s, d):
    """Segments found by k-means: size and churn of each, with the chosen k."""
    out = g.segment(base(s, d), SEG, "customer_id")
    return out.frame.groupBy("segment").agg(
        F.count("*").alias("size"), F.avg("churned").alias("churn_rate")).withColumn("k", F.lit(out.k))


def _scores(s, d):
    known, held, _ = _parts(s, d)
    f = _fit(known)
    c = ml.calibrate(known, NUM, CAT, "churned", "customer_id")
    out = ml.score_calibrated(c, ml.score(f, held, "raw"), "calibrated")
    return m.evaluate(m.long_scores(out, "churned", {"raw": "raw", "calibrated": "calibrated"},
                                    "customer_id"))


def _platt(s, d):
    known, held, _ = _parts(s, d)
    c = ml.calibrate(known, NUM, CAT, "churned", "customer_id", method="sigmoid")
    return ml.score_calibrated(c, held, "p").select("customer_id", "p")


def _held_scores(s, d, learner, trees=10):
    known, held, _ = _parts(s, d)
    f = _fit(known, learner, trees)
    long = m.long_scores(ml.score(f, held, "p"), "churned", {learner: "p"}, "customer_id")
    return m.evaluate(long)


def _importance(s, d):
    known, held, _ = _parts(s, d)
    return ml.permutation_importance(_fit(known), held, "churned", "customer_id")


def _drivers(s, d):
    known, held, rows = _parts(s, d)
    f = _fit(known, trees=50)
    ex = x.contributions(f, held, known)
    imp = ml.permutation_importance(f, held, "churned", "customer_id")
    odds, _ = x.odds_ratios(known, NUM, CAT, "churned")
    tests = h.run_tests(rows, CAT, NUM, "churned")
    return x.driver_impact(imp, x.global_importance(ex, [*NUM, *CAT]), odds, tests)


def _predictions(s, d):
    known, _, rows = _parts(s, d)
    f = _fit(known)
    scored = ml.score(f, rows, "p")
    ex = x.contributions(f, scored, known)
    return x.score_customers(ex, f, "customer_id", "churned", "p").withColumn(
        "reasons", F.concat_ws(" | ", "reasons"))


def _acceptance(s, d):
    data = base(s, d).withColumn("customer_id", col("customer_id").cast("string"))
    long = v.offer_history(s, d).withColumn("customer_id", col("customer_id").cast("string"))
    _, table = nbo.acceptance_models(data, long, NUM, CAT)
    return table


_CUT = """sp AS (SELECT customer_id, churned, unit('split42:' || customer_id) AS u FROM planted),
  cu AS (SELECT churned AS y, quantile_cont(u, 0.2) AS q FROM sp GROUP BY 1)"""
_TRAIN = f"{_CUT}, tr AS (SELECT planted.* FROM planted JOIN sp USING (customer_id) JOIN cu ON y = sp.churned WHERE u >= q)"


QUERIES = {
    "impute_and_scale": (
        lambda s, d: rounded(_scaled(s, d).select("customer_id", *[f"{c}_z" for c in SEG]),
                             *[f"{c}_z" for c in SEG]),
        oracle("planted", f"""WITH {_FILL} SELECT customer_id, round(balance_z, 9) AS balance_z,
  round(revenue_z, 9) AS revenue_z, round(recency_z, 9) AS recency_z FROM z""")),
    "silhouette": (
        lambda s, d: rounded(_silhouette(s, d), "silhouette", places=7),
        oracle("planted", f"""WITH {_FILL}, p AS (SELECT *, floor(unit('g:' || customer_id) * 3)::INTEGER AS k,
    balance_z^2 + revenue_z^2 + recency_z^2 AS q FROM z),
  c AS (SELECT k, count(*) AS n, sum(q) AS q, sum(balance_z) AS s1, sum(revenue_z) AS s2, sum(recency_z) AS s3 FROM p GROUP BY 1),
  w AS (SELECT customer_id AS i, p.k AS own, c.k AS other, n,
    p.q + c.q / n - 2 * (balance_z * s1 + revenue_z * s2 + recency_z * s3) / n AS d FROM p, c),
  s AS (SELECT i, max(d * n / (n - 1)) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM w GROUP BY 1)
  SELECT 'group' AS label, round(avg((b - a) / greatest(a, b)), 7) AS silhouette, count(*) AS n FROM s""")),
    "segment_profile": (
        lambda s, d: rounded(_profile(s, d), "churn_rate", "lift", *[f"{p}_{c}" for p in ("mean", "z") for c in SEG],
                             places=6),
        oracle("planted", f"""WITH {_FILL}, g AS (SELECT segment, count(*) AS size, avg(churned) AS cr,
    avg(balance) AS b, avg(revenue) AS v, avg(recency) AS c FROM f GROUP BY 1),
  q AS (SELECT *, (b - m1) / s1 AS zb, (v - m2) / s2 AS zv, (c - m3) / s3 AS zc FROM g, st),
  l AS (SELECT segment, string_agg(w, ', ' ORDER BY k) AS label FROM (SELECT segment,
    CASE WHEN z > 0 THEN 'High ' ELSE 'Low ' END || ft AS w, row_number() OVER (PARTITION BY segment ORDER BY abs(z) DESC, ft) AS k
    FROM (SELECT segment, zb AS balance, zv AS revenue, zc AS recency FROM q) UNPIVOT (z FOR ft IN (balance, revenue, recency)))
    WHERE k <= 2 GROUP BY 1)
  SELECT q.segment, label, size, size / n AS share, round(cr, 6) AS churn_rate, round(cr / r, 6) AS lift,
    round(b, 6) AS mean_balance, round(v, 6) AS mean_revenue, round(c, 6) AS mean_recency, round(zb, 6) AS z_balance,
    round(zv, 6) AS z_revenue, round(zc, 6) AS z_recency FROM q JOIN l ON l.segment = q.segment""")),
    "kmeans_segments": (_segmentation, None),
    "stratified_split": (
        lambda s, d: split(s, d).select("customer_id", "is_test"),
        oracle("planted", f"WITH {_CUT} SELECT customer_id, u < q AS is_test FROM sp JOIN cu ON y = churned")),
    "class_weights": (
        lambda s, d: ml.class_weights(base(s, d), "churned"),
        oracle("planted", """SELECT churned AS y, count(*) AS n, (SELECT count(*) FROM planted) / (2 * count(*)) AS weight
  FROM planted GROUP BY 1""")),
    "leakage_warnings": (
        lambda s, d: rounded(ml.leakage_warnings(train(s, d).withColumn(
            "near", col("churned") + col("balance") / 1e6), [*NUM, "near"], CAT, "churned", 0.2), "value"),
        oracle("planted", f"""WITH {_TRAIN}, r AS (SELECT corr(balance, churned) AS a, corr(revenue, churned) AS b,
    corr(recency, churned) AS c, corr(churned + balance / 1e6, churned) AS e FROM tr),
  t AS (SELECT "column", 'Pearson r' AS measure, value FROM (SELECT a AS balance, b AS revenue, c AS recency, e AS near FROM r)
    UNPIVOT (value FOR "column" IN (balance, revenue, recency, near))),
  l AS (SELECT variable, level, count(*) FILTER (churned = 0) AS n0, count(*) FILTER (churned = 1) AS n1 FROM
    (SELECT segment, region, churned FROM tr) UNPIVOT (level FOR variable IN (segment, region)) GROUP BY 1, 2),
  w AS (SELECT *, sum(n0) OVER v AS r0, sum(n1) OVER v AS r1 FROM l WINDOW v AS (PARTITION BY variable)),
  cv AS (SELECT variable, sqrt(sum((n0 - (n0 + n1) * r0 / (r0 + r1))^2 / ((n0 + n1) * r0 / (r0 + r1))
    + (n1 - (n0 + n1) * r1 / (r0 + r1))^2 / ((n0 + n1) * r1 / (r0 + r1))) / any_value(r0 + r1)) AS value FROM w GROUP BY 1)
  SELECT "column", measure, round(value, 9) AS value FROM t WHERE abs(value) > 0.2
  UNION ALL SELECT variable, 'Cramér''s V', round(value, 9) FROM cv WHERE value > 0.2""")),
    "logistic_regression": (lambda s, d: _held_scores(s, d, "logistic"), None),
    "gradient_boosting": (lambda s, d: _held_scores(s, d, "boosting", 50), None),
    "cross_validation": (
        lambda s, d: ml.cross_validate(_parts(s, d)[0], NUM, CAT, "churned", "customer_id"), None),
    "permutation_importance": (_importance, None),
    "calibration_raw_vs_isotonic": (_scores, None),
    "calibration_sigmoid": (_platt, None),
    "isotonic_steps": (
        lambda s, d: rounded(isotonic(base(s, d), "tenure", "churned"), "value"),
        oracle("planted", """
  WITH x AS (SELECT tenure::DOUBLE AS x, count(*) AS n, sum(churned) AS y FROM planted WHERE tenure IS NOT NULL GROUP BY 1),
  r AS (SELECT x, n, y, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS cn, sum(y) OVER (ORDER BY x) AS cy FROM x),
  ab AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS m FROM r a JOIN r b ON b.i >= a.i),
  lo AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM ab),
  v AS (SELECT i, max(m) AS v FROM lo GROUP BY 1)
  SELECT min(x) AS low, max(x) AS high, round(v, 9) AS value FROM v JOIN r USING (i) GROUP BY round(v, 9)""")),
    "contributions_linear": (
        lambda s, d: (lambda f, e: x.global_importance(e, [*f.numeric, *f.categorical]))(*_explained(s, d)),
        None),
    "contributions_tree": (
        lambda s, d: (lambda f, e: x.global_importance(e, [*f.numeric, *f.categorical]))(
            *_explained(s, d, "boosting")), None),
    "contribution_sample": (
        lambda s, d: (lambda f, e: x.contribution_sample(e, f, x.global_importance(
            e, [*f.numeric, *f.categorical]), "customer_id"))(*_explained(s, d)), None),
    "odds_ratio_design": (
        lambda s, d: (lambda t: rounded(t.select("customer_id", *[e.alias(n) for n, e in x.odds_ratio_design(
            t, NUM, ["segment"])[0].items()]), *NUM))(train(s, d)),
        oracle("planted", f"""WITH {_TRAIN}, f AS (SELECT customer_id, segment, coalesce(balance, a) AS b, coalesce(revenue, v) AS r,
    coalesce(recency, c) AS e FROM tr, (SELECT quantile_cont(balance, .5) AS a, quantile_cont(revenue, .5) AS v,
    quantile_cont(recency, .5) AS c FROM tr)),
  st AS (SELECT avg(b) AS m1, stddev_pop(b) AS s1, avg(r) AS m2, stddev_pop(r) AS s2, avg(e) AS m3, stddev_pop(e) AS s3 FROM f)
  SELECT customer_id, round((b - m1) / s1, 9) AS balance, round((r - m2) / s2, 9) AS revenue, round((e - m3) / s3, 9) AS recency,
    {{levels}} FROM f, st""")),
    "odds_ratios": (lambda s, d: x.odds_ratios(_parts(s, d)[0], NUM, CAT, "churned")[0], None),
    "forest_rows": (lambda s, d: x.forest_rows(x.odds_ratios(_parts(s, d)[0], NUM, CAT, "churned")[0]), None),
    "driver_impact": (_drivers, None),
    "score_customers": (_predictions, None),
    "acceptance_models": (_acceptance, None),
}
# The design leaves out the most frequent level, which depends on the data: the four other levels
# are compared in long form instead of by column name.
QUERIES["odds_ratio_design"] = (
    lambda s, d: _design_long(s, d),
    QUERIES["odds_ratio_design"][1].replace("{levels}", """segment,
    CASE WHEN segment = (SELECT segment FROM tr GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1) THEN 0.0::DOUBLE
         ELSE 1.0::DOUBLE END AS n_dummies"""))


def _design_long(s, d):
    t = train(s, d)
    cols, _ = x.odds_ratio_design(t, NUM, ["segment"])
    dummies = [e for n, e in cols.items() if n not in NUM]
    out = t.select("customer_id", "segment", *[cols[n].alias(n) for n in NUM],
                   sum(dummies[1:], dummies[0]).alias("n_dummies"))
    return rounded(out, *NUM)
