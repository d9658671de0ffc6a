"""Offers, money, models, explanations, claim checks and the whole analysis."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from keepwell.operators import adhoc, business, describe, explain, facts, features, impact, metrics, model, nbo
from keepwell.operators import isotonic as iso
from keepwell.operators import offers as o
from keepwell.operators import segment as seg
from keepwell.operators import telemetry
from keepwell.operators.filters import Filter, FilterError
from keepwell.plans import analysis, views
from keepwell.roles import OfferRoles, Roles
from keepwell.sources.catalogue import Offer, Rule


def test_three_layouts_give_one_table(spark):
    one = spark.createDataFrame(
        [(1, "a", "Data pack", "Yes"), (2, "a", "cashback", "no"), (3, "b", "data  pack", "1"),
         (4, "c", None, None), (5, "a", "Data Pack", "no"), (6, "d", "Data pack", "0")],
        "row_id long, id string, Offer string, Accepted string")
    two = spark.createDataFrame(
        [(1, "a", "Data pack; Cashback", "data pack"), (2, "b", "Data pack", "DATA PACK"),
         (3, "c", " ", None), (4, "d", "Data pack |", "")],
        "row_id long, id string, Offers string, Taken string")
    three = spark.createDataFrame(
        [(1, "a", 1, 1, "yes", "no"), (2, "b", 1, 0, "true", ""), (3, "c", 0, 0, "", ""),
         (4, "d", 1, 0, "no", "")],
        "row_id long, id string, `Data pack` int, Cashback int, t1 string, t2 string")

    def rows(df, roles):
        out = o.reshape_offers(df, roles, "id", "row_id").collect()
        return sorted((r["customer_id"], r["offer"].lower(), r["accepted"]) for r in out)

    want = [("a", "cashback", 0), ("a", "data pack", 1), ("b", "data pack", 1), ("d", "data pack", 0)]
    assert rows(one, OfferRoles("Offer", "Accepted")) == want
    assert rows(two, OfferRoles("Offers", "Taken")) == want
    assert rows(three, OfferRoles(("Data pack", "Cashback"), ("t1", "t2"))) == want


def test_cutoff_column_needs_dates(spark):
    df = spark.createDataFrame([("2024-01-01", "n")] * 3, "SnapshotDate string, as_of string")
    assert o.cutoff_column(df) == "SnapshotDate"
    assert o.cutoff_column(df, {"SnapshotDate"}) is None


def test_savings_by_hand(spark):
    df = spark.createDataFrame(
        [("c1", "High", "M", 0.8, 100.0), ("c2", "Medium", "Y", 0.4, 50.0),
         ("c3", "Low", "M", 0.05, 10.0)], "customer_id string, risk_band string, plan string, p double, "
                                          "arpu double")
    offers = [Offer("A", 20, 0.5, 0.5, rules=(Rule(risk_band=("High", "Medium")),)),
              Offer("B", 60, 0.25, 0.6, "per_targeted", (Rule("plan", ("M",)),)),
              Offer("C", 1, 1.0, 1.0, rules=(Rule("gone", ("x",)),))]
    ok, warnings = business.eligibility(df, offers)
    assert set(ok) == {"A", "B"} and "gone" in warnings[0]
    got = {r["customer_id"]: r for r in business.next_best_offer(df, "p", "arpu", offers).collect()}
    a1 = 0.8 * 0.5 * 0.5 * 100 * 12 - 10
    b1 = 0.8 * 0.25 * 0.6 * 100 * 12 - 60
    assert (got["c1"]["best_offer"], got["c1"]["runner_up"]) == ("A", "B")
    assert got["c1"]["expected_saving"] == pytest.approx(a1)
    assert got["c1"]["runner_up_saving"] == pytest.approx(b1)
    assert got["c2"]["best_offer"] == "A" and got["c2"]["runner_up"] is None
    assert got["c3"]["best_offer"] == "No offer" and got["c3"]["eligible_offers"] == 1
    with pytest.raises(ValueError):
        business.revenue_at_risk(df, "p", "arpu", 61)


def test_ties_go_to_the_first_offer(spark):
    df = spark.createDataFrame([("c", "High", 0.5, 10.0)],
                               "customer_id string, risk_band string, p double, arpu double")
    two = [Offer("Z", 1, 0.5, 0.5), Offer("A", 1, 0.5, 0.5)]
    assert business.next_best_offer(df, "p", "arpu", two).first()["best_offer"] == "Z"


def test_measured_lift_and_declines(spark):
    people = spark.createDataFrame(
        [(str(i), "s", "High", 0.9, i % 2, 10.0) for i in range(40)],
        "customer_id string, segment string, risk_band string, churn_probability double, churned int, "
        "rev double")
    long = people.select("customer_id", F.lit("30% off").alias("offer"), F.lit(1).alias("accepted"),
                         F.lit(None).cast("timestamp").alias("offer_date")).unionByName(
        people.select("customer_id", F.lit("Gift").alias("offer"),
                      (F.col("customer_id") != "3").cast("int").alias("accepted"),
                      F.lit(None).cast("timestamp").alias("offer_date")))
    rates = nbo.offer_rates(long, people)
    got = {r["customer_id"]: r for r in nbo.score_next_best_offers(
        people, rates, None, nbo.declined_recently(long),
        nbo.NboConfig(measured_lift={"gift": 0.5}), revenue="rev").collect()}
    assert got["1"]["best_offer"] == "Gift" and got["1"]["evidence"] == nbo.PROVEN
    assert got["1"]["expected_value"] == pytest.approx(0.9 * 40 / 42 * 0.5 * 120, abs=1e-4)
    assert got["3"]["best_offer"] == "No offer" and got["3"]["no_offer_reason"] == "no eligible offers"
    assert nbo.excluded_by_discount(rates.select("offer").distinct()).collect()[0]["offer"] == "30% off"


def test_impact_by_hand(spark):
    df = spark.createDataFrame([("a", i % 2, 10.0) for i in range(40)] + [("b", 0, 5.0)] * 40,
                               "g string, y int, rev double")
    rows = impact.impact_by_level(df, ["g"], "y", "rev").orderBy("scenario").collect()
    assert {(r["id"], r["customers"], r["churners"], r["lift"]) for r in rows} == {("g=a", 40, 20, 2.0)}
    assert [r["churners_saved"] for r in rows] == [2.0, 5.0]
    assert [r["revenue_saved"] for r in rows] == [20.0, 50.0]
    assert impact.impact_by_level(df, ["g"], "y", merged_other=["g"]).count() == 2


def test_questions_are_checked(spark):
    df = spark.createDataFrame([("1", "x", 1), ("2", "y", 0), (None, "x", 1)], "n string, g string, y int")
    assert adhoc.filter_and_aggregate(df, "count", filters=[Filter("n", "==", 1.0)]).first()["n"] == 1
    rate = {r["group"]: r["value"] for r in adhoc.filter_and_aggregate(
        df, "churn_rate", group_by="g", target="y").collect()}
    assert rate == {"x": 1.0, "y": 0.0}
    for bad in (dict(metric="mean"), dict(metric="mean", column="g"), dict(metric="count", group_by="q"),
                dict(metric="churn_rate")):
        with pytest.raises(FilterError):
            adhoc.filter_and_aggregate(df, **bad).collect()


def test_text_numbers_against_brute_force(spark):
    rnd = random.Random(2)
    texts, figs, want = [], [], set()
    for i in range(40):
        nums = [round(rnd.choice([1, 10, 1000]) * rnd.random(), rnd.randint(0, 3)) for _ in range(6)]
        declared = [n * rnd.choice([1, 1.004, 0.01, 1.3]) for n in nums[:4]]
        texts.append((i, "About " + ", ".join(f"{n:,}" for n in nums) + " on 5G, Q1 and 90d."))
        figs += [(i, d) for d in declared]

        def near(a, b):
            return abs(a - b) <= max(0.005, 0.01 * abs(b))
        for n in nums:
            if not any(near(n, d) or near(n, 100 * d) or near(n / 100, d) for d in declared):
                want.add((i, n))
    got = facts.check_text_numbers(spark.createDataFrame(texts, "item int, text string"),
                                   spark.createDataFrame(figs, "item int, value double"))
    assert {(r["item"], r["number"]) for r in got.collect()} == want
    less = spark.createDataFrame([(1, "p < 0.001 and less than 7 points")], "item int, text string")
    fig = spark.createDataFrame([(1, 0.0002)], "item int, value double")
    assert facts.check_text_numbers(less, fig).count() == 0


def test_claims_may_state_the_size_of_a_drop(spark):
    f = spark.createDataFrame([("s", "k", -0.05, "", None)],
                              "section string, key string, value double, label string, group_id string")
    c = spark.createDataFrame([("i", "k", 5.0)], "item string, key string, claimed double")
    assert facts.check_figures(c, f).first()["problem"] is not None
    assert facts.check_figures(c, f, sizes=True).first()["problem"] is None


def test_hot_customer_in_event_helpers(spark):
    rnd = random.Random(4)
    rows = [(i, 1 if i % 3 else i, rnd.choice("ab"), 86_400 * rnd.randint(0, 200)) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, user long, kind string, s long").withColumn(
        "ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["is_repeat"] for r in features.repeat_contacts(
        df, "user", "kind", "ts", "event_id").collect()}
    last = {}
    for e, u, kind, s in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        p = last.get(u)
        assert got[e] == bool(p and p[0] == kind and (s - p[1]) // 86_400 <= 7)
        last[u] = (kind, s)
    spans = df.select("event_id", F.col("ts").alias("started_at"), F.lit(3.6e6).alias("latency_ms"))
    busy = telemetry.busy_time(spans).first()["busy_ms"]
    assert busy == pytest.approx(len({r[3] for r in rows}) * 3.6e6)


@pytest.fixture(scope="module")
def planted(spark):
    return views.planted(spark, "/root/testdata/sf0.01", returns=False).persist()


@pytest.fixture(scope="module")
def parts(planted):
    both = model.stratified_split(planted, "churned", "customer_id").persist()
    return both.where("not is_test"), both.where("is_test")


def test_split_is_stratified_and_stable(planted, parts):
    train, test = parts
    share = {r["churned"]: r["s"] for r in test.unionByName(train).groupBy("churned").agg(
        F.avg(F.col("is_test").cast("int")).alias("s")).collect()}
    assert all(abs(s - 0.2) < 0.005 for s in share.values())
    again = model.stratified_split(planted.repartition(3), "churned", "customer_id")
    assert again.where("is_test").join(test, "customer_id").count() == test.count()


@pytest.mark.parametrize("learner", ["logistic", "boosting"])
def test_contributions_add_up(parts, learner):
    train, test = parts
    f = model.fit(train, ["balance", "revenue"], ["segment"], "churned", learner=learner, trees=4)
    ex = explain.contributions(f, model.margin(f, test, "m"), train).collect()
    gap = [r["m"] - sum(r["contributions"]) for r in ex]
    # Contributions differ from the log-odds by one constant, the base value.
    assert np.ptp(gap) < 1e-6
    assert len(ex[0]["contributions"]) == 3
    auc = metrics.roc_auc(metrics.long_scores(model.score(f, test, "p"), "churned", {"m": "p"},
                                              "customer_id")).first()["roc_auc"]
    assert auc > 0.55


def test_odds_ratios_find_the_planted_segment(parts):
    train, _ = parts
    doubled = train.withColumn("twice", F.col("balance") * 2)
    odds, notes = explain.odds_ratios(doubled, ["balance", "twice"], ["segment"], "churned")
    rows = {r["term"]: r for r in odds.collect()}
    assert [n["term"] for n in notes.collect()] == ["twice"]
    assert rows["balance"]["ci_lower"] > 1 and rows["balance"]["p_value"] < 1e-4
    building = [r for r in rows.values() if "BUILDING" in r["label"]]
    assert building and all(abs(r["coef"]) > 0.5 for r in building)
    assert explain.forest_rows(odds).first()["whisker_low"] > 0


def test_separated_terms_are_dropped(spark):
    rows = [(i, float(i % 7), "yes" if i % 2 else "no", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, leak string, y int")
    odds, notes = explain.odds_ratios(df, ["x"], ["leak"], "y")
    assert any("leak" in n["term"] for n in notes.collect())
    assert [r["term"] for r in odds.collect()] == ["x"]


def test_odds_ratios_equal_a_dense_fit(spark):
    """Absorbed levels, contrasts and errors against Newton steps on the full dummy design."""
    rng = np.random.default_rng(5)
    n = 3000
    x, level, kind = rng.normal(size=n), rng.integers(0, 40, n), rng.integers(0, 3, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x + 0.05 * (level - 20) + 0.4 * (kind == 1))))).astype(int)
    rows = [(float(a), f"l{b:02d}", f"k{c}", int(d)) for a, b, c, d in zip(x, level, kind, y)]
    df = spark.createDataFrame(rows, "x double, level string, kind string, y int")
    odds, notes = explain.odds_ratios(df, ["x"], ["kind", "level"], "y")
    got = {r["term"]: (r["coef"], r["se"]) for r in odds.collect()}
    assert notes.isEmpty()
    names = [t for t in got if t != "x"]
    design = np.column_stack([np.ones(n), (x - x.mean()) / x.std(ddof=0)] + [
        [1.0 if f"{c} = {v}" == t else 0.0 for v in (r[i] for r in rows)] for t in names
        for c, i in [("level", 1) if t.startswith("level") else ("kind", 2)]])
    beta = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        info = (design * (p * (1 - p))[:, None]).T @ design
        beta = beta + np.linalg.solve(info, design.T @ (y - p))
    errors = np.sqrt(np.diag(np.linalg.inv(info)))
    for i, t in enumerate(["x", *names], start=1):
        assert abs(got[t][0] - beta[i]) < 1e-3 * (1 + abs(beta[i])) if t == "x" else abs(got[t][0] - beta[i]) < 1e-6, t
        assert abs(got[t][1] - errors[i]) < 1e-3, t


def test_odds_ratios_of_twenty_thousand_levels(spark):
    df = spark.range(120_000).select(
        F.concat(F.lit("l"), F.col("id") % 20_000).alias("level"),
        F.when(F.col("id") < 20_000, F.col("id") % 2).when(F.col("id") < 40_000, 1 - F.col("id") % 2)
        .otherwise((F.xxhash64("id") % 2 == 0).cast("long")).alias("y"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("x"))
    odds, notes = explain.odds_ratios(df, ["x"], ["level"], "y")
    assert notes.isEmpty() and odds.count() == 20_000
    assert odds.where("coef IS NULL OR isnan(coef) OR NOT se > 0 OR p_value IS NULL").isEmpty()


def test_leak_stops_the_run():
    with pytest.raises(model.LeakageError):
        model.check_leakage(0.995)
    model.check_leakage(0.8)


def test_importance_ranks_the_signal_first(parts):
    train, test = parts
    f = model.fit(train, ["balance", "recency"], ["segment"], "churned")
    rows = model.permutation_importance(f, test, "churned", "customer_id", 3).orderBy("rank").collect()
    assert rows[-1]["feature"] == "recency" and rows[0]["importance_mean"] > 0.02


@pytest.mark.parametrize("learner", ["logistic", "boosting"])
def test_importance_equals_scored_copies(parts, learner):
    """One repeat, one group: the loss equals that of scoring a copy whose column has moved one row on."""
    train, test = parts
    test = test.limit(1500).cache()
    f = model.fit(train, ["balance", "recency"], ["segment"], "churned", learner=learner, trees=5)
    got = {r["feature"]: r["importance_mean"] for r in
           model.permutation_importance(f, test, "churned", "customer_id", 1).collect()}
    order = F.xxhash64("customer_id", F.lit("order"), F.lit(0))
    rows = test.select("customer_id", "churned", "balance", "recency", "segment").orderBy(order).collect()

    def auc(data):
        frame = test.sparkSession.createDataFrame(data, "customer_id long, churned int, balance double, recency double, segment string")
        return metrics.roc_auc(metrics.long_scores(model.score(f, frame, "p"), "churned", {"m": "p"}, "customer_id")).first()["roc_auc"]

    plain = [(int(r[0]), int(r[1]), *(None if v is None else float(v) for v in r[2:4]), r[4]) for r in rows]
    for at, feature in ((2, "balance"), (3, "recency"), (4, "segment")):
        moved = [(*r[:at], plain[i - 1][at], *r[at + 1:]) for i, r in enumerate(plain)]
        assert abs(auc(plain) - auc(moved) - got[feature]) < 1e-9, feature


def test_calibration_lowers_brier(parts):
    train, test = parts
    f = model.fit(train, ["balance"], ["segment"], "churned")
    c = model.calibrate(train, ["balance"], ["segment"], "churned", "customer_id")
    assert c.method == "isotonic"
    out = model.score_calibrated(c, model.score(f, test, "raw"), "cal")
    b = {r["kind"]: r["brier"] for r in metrics.brier(metrics.long_scores(
        out, "churned", {"raw": "raw", "cal": "cal"}, "customer_id")).collect()}
    assert b["cal"] < b["raw"]


def test_saved_model_scores_the_same(parts, tmp_path):
    train, test = parts
    f = model.fit(train, ["balance"], ["segment"], "churned")
    c = model.calibrate(train, ["balance"], ["segment"], "churned", "customer_id", method="sigmoid")
    model.save(f, str(tmp_path / "m"), c)
    g = model.load(str(tmp_path / "m"))
    assert (g.learner, g.numeric, g.categorical, g.scales, g.levels) == (f.learner, f.numeric, f.categorical, f.scales, f.levels)
    back = model.load_calibrated(str(tmp_path / "m"))
    one, two = (model.score_calibrated(x, test, "p").select("customer_id", F.col("p").alias(n)) for x, n in ((c, "p"), (back, "q")))
    assert one.join(two, "customer_id").where("abs(p - q) > 1e-12").count() == 0
    a = model.score(f, test, "p").select("customer_id", "p")
    b = model.score(g, test, "p").select("customer_id", F.col("p").alias("q"))
    assert a.join(b, "customer_id").where("abs(p - q) > 1e-12").count() == 0


def test_blobs_give_three_segments(spark):
    rnd = random.Random(1)
    rows = [(i, cx + rnd.gauss(0, 1), cy + rnd.gauss(0, 1), i % 2)
            for i, (cx, cy) in enumerate([(0, 0), (10, 10), (0, 10)] * 100)]
    df = spark.createDataFrame(rows, "id int, a double, b double, churn int")
    out = seg.segment(df, ["a", "b"], "id", ks=(2, 3, 4), starts=2)
    assert out.k == 3
    sizes = sorted(r["count"] for r in out.frame.groupBy("segment").count().collect())
    assert sizes == [100, 100, 100]
    assert seg.segment(df, ["a"], "id").skipped is not None
    assert seg.select_k({2: 0.5, 3: 0.5}) == 2


def test_reason_numbers(spark):
    df = spark.createDataFrame([(70.0,), (1234.5678,), (0.01234567,), (12345.678,), (0.0,), (-3.5,)],
                               "x double")
    got = [r["t"] for r in df.select(explain.four_digits(F.col("x")).alias("t")).collect()]
    assert got[0] == "70" and got[2] == "0.01235" and got[3] == "1.235e+04"
    assert got[4] == "0" and got[5] == "-3.5" and got[1] in ("1235", "1,235")


def test_whole_analysis(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    base = views.planted(spark, sf, returns=False)
    offers = views.offer_history(spark, sf).groupBy("customer_id").agg(
        F.array_join(F.array_sort(F.collect_list("offer")), ";").alias("Offers"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("accepted") == 1, F.col("offer")))),
                     ";").alias("OffersAccepted"))
    df = base.join(offers, "customer_id", "left").select(
        F.col("customer_id").alias("row_id"), F.concat(F.lit("C"), "customer_id").alias("cid"),
        "segment", "region", "balance", "revenue", "tenure",
        F.when(F.col("churned") == 1, "Yes").otherwise("No").alias("Churn"), "Offers",
        "OffersAccepted")
    roles = Roles("Churn", "Yes", ("cid",), "tenure", "revenue",
                  OfferRoles("Offers", "OffersAccepted"),
                  {"segment": "categorical", "region": "categorical", "balance": "numeric",
                   "revenue": "numeric", "tenure": "numeric"})
    done = analysis.run(df, roles, str(tmp_path), options=analysis.Options(
        starts=1, ks=(2, 3), trees=2, learners=("logistic",), repeats=2))
    for name in ("clean", "tests", "predictions", "drivers", "impact", "facts", "survival_curve",
                 "segment_profile", "offer_effectiveness", "next_best_offer", "deciles"):
        assert spark.read.parquet(done[name]).count() > 0, name
    p = spark.read.parquet(done["predictions"])
    assert p.count() == 150 and p.where("size(reasons) = 3").count() == 150
    assert p.where("churn_probability between 0 and 1").count() == 150
    assert not math.isnan(spark.read.parquet(done["model_metrics"]).first()["roc_auc"])


@pytest.mark.parametrize("kind", ["binary", "real", "rising", "falling", "one"])
def test_isotonic_pools_across_ranges(spark, kind):
    rnd = random.Random(3)
    xs = [round(rnd.random() * 40, 2) for _ in range(3000)]
    ys = {"binary": [float(rnd.random() < x / 40) for x in xs], "real": [x + rnd.gauss(0, 30) for x in xs],
          "rising": xs, "falling": [-x for x in xs], "one": [1.0] * len(xs)}[kind]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double").repartition(5)
    counts = {}
    for x, y in zip(xs, ys):
        n, s = counts.get(x, (0, 0.0))
        counts[x] = (n + 1, s + y)
    blocks = []  # low, high, n, sum
    for x in sorted(counts):
        blocks.append([x, x, *counts[x]])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            _, high, n, s = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + n, blocks[-1][3] + s]
    curve = iso.isotonic(df, "x", "y")
    got = [tuple(r) for r in curve.orderBy("low").collect()]
    assert [g[:2] for g in got] == [tuple(b[:2]) for b in blocks] or kind in ("rising", "one", "falling")
    px, pv = zip(*sorted({(x, b[3] / b[2]) for b in blocks for x in b[:2]}))
    ask = [-1.0, 0.0, 3.333, 20.005, 39.99, 50.0, None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(ask)], "i int, m double")
    for limit in (100_000, 0):  # sent to the rows, met in ranges
        before, iso.SENT_POINTS = iso.SENT_POINTS, limit
        try:
            found = {r["i"]: r["c"] for r in iso.interpolated(rows, "m", curve, "c").collect()}
        finally:
            iso.SENT_POINTS = before
        assert [found[i] for i in range(6)] == pytest.approx([float(np.interp(a, px, pv)) for a in ask[:6]], abs=1e-9)
        assert found[6] is None


def test_correlation_blocks_with_missing_cells(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(1e6, 3, (400, 6))
    x[:, 1] += x[:, 0]
    x[rnd.random((400, 6)) < 0.2] = np.nan
    x[:, 5] = 7.0
    df = spark.createDataFrame([tuple(None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(r)) for r in x],
                               ", ".join(f"c{i} double" for i in range(6)))
    got = {(r["a"], r["b"]): r["r"] for r in describe.correlation_matrix(df, [f"c{i}" for i in range(6)]).collect()}
    assert len(got) == 25
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got[(f"c{i}", f"c{j}")] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)


def test_all_starts_share_the_passes(spark):
    rnd = np.random.default_rng(1)
    rows = np.concatenate([rnd.normal(c, 0.3, (60, 2)) for c in ((0, 0), (5, 5), (0, 6), (7, 0))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double")
    begin = {m: seg.spread_centres(rows, 4, np.random.default_rng(m)) for m in range(5)}
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    done = seg.lloyd(df, begin, 15)
    jobs = len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before))
    assert jobs <= 2 * 16
    for m, (cost, centres) in done.items():
        now = begin[m]
        for _ in range(40):
            at = ((rows[:, None] - now[None]) ** 2).sum(axis=2).argmin(axis=1)
            now = np.array([rows[at == k].mean(axis=0) if (at == k).any() else now[k] for k in range(4)])
        assert cost == pytest.approx(((rows[:, None] - now[None]) ** 2).sum(axis=2).min(axis=1).sum(), rel=1e-6)
        assert centres == pytest.approx(now, abs=1e-3)


def test_contributions_of_rows_that_repeat_an_id(parts):
    train, test = parts
    f = model.fit(train, ["balance"], ["segment"], "churned", learner="boosting", trees=3)
    few = test.orderBy("customer_id").limit(6).withColumn("no", F.monotonically_increasing_id())
    alone = {r["no"]: r["contributions"] for r in explain.contributions(f, few, train).collect()}
    same = few.withColumn("customer_id", F.lit(None).cast(few.schema["customer_id"].dataType))
    got = {r["no"]: r["contributions"] for r in explain.contributions(f, same, train).collect()}
    assert len(got) == 6 and all(got[k] == pytest.approx(alone[k]) for k in alone)
    more = {r["no"]: r["contributions"] for r in explain.contributions(f, few, train, orders=3).collect()}
    assert all(sum(more[k]) == pytest.approx(sum(alone[k])) for k in alone)


def test_tree_contributions_are_the_mean_over_all_orders(spark):
    rnd = np.random.default_rng(8)
    raw = [(float(rnd.normal()), float(rnd.normal()), *map(str, rnd.integers(0, 3, 3))) for _ in range(400)]
    rows = [(*r, int((r[0] > 0) ^ (r[1] > 0.3) ^ (r[2] == "2") if r[3] != "1" else (r[4] == "2") ^ (r[0] > 0.5))) for r in raw]
    kinds = "a double, b double, c string, d string, e string"
    f = model.fit(spark.createDataFrame(rows, f"{kinds}, y int"), ["a", "b"], ["c", "d", "e"], "y", learner="boosting", trees=6)
    back = spark.createDataFrame(raw[:300], kinds)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate([*raw[:12], (None, 0.1, "2", None, "new"), raw[0]])], f"no int, {kinds}")
    cells = model.transform(f, df).orderBy("no").select("_features", "_o_c", "_o_d", "_o_e").collect()
    at = np.cumsum([0, 1, 1, *[r.size for r in cells[0][1:]]])
    own = np.array([r[0].toArray() for r in cells])
    mean = np.mean([r[0].toArray() for r in model.transform(f, back).select("_features").collect()], axis=0)

    def mixed(row, mine):
        return Vectors.dense([row[j] if any(at[i] <= j < at[i + 1] for i in mine) else mean[j] for j in range(at[-1])])

    sets = [frozenset(s) for n in range(6) for s in itertools.combinations(range(5), n)]
    steps = spark.createDataFrame([(no, k, mixed(row, s)) for no, row in enumerate(own) for k, s in enumerate(sets)],
                                  ["no", "k", "_features"])
    odds = {(r["no"], sets[r["k"]]): 2 * r["_raw"][1] for r in f.model.stages[-1].transform(steps).collect()}
    orders = list(itertools.permutations(range(5)))
    got = {r["no"]: r["contributions"] for r in explain.contributions(f, df, back).collect()}
    assert len(got) == len(own)
    for no in got:
        want = [np.mean([odds[no, frozenset(o[:o.index(i) + 1])] - odds[no, frozenset(o[:o.index(i)])] for o in orders]) for i in range(5)]
        assert got[no] == pytest.approx(want, abs=1e-9)
        assert sum(got[no]) == pytest.approx(odds[no, sets[-1]] - odds[no, frozenset()])
    assert sum(abs(v) > 0.01 for v in got[0]) >= 4
    assert got[0] == got[13]


def test_offers_without_a_bound_on_rates_and_costs(spark):
    customers = spark.createDataFrame([("a", "s1", 0.9, "High", 100.0), ("b", "s9", 0.8, "High", 100.0)],
                                      "customer_id string, segment string, churn_probability double, risk_band string, arpu double")
    n = 100_100
    rates = spark.range(n).selectExpr("concat('offer ', id) AS offer", "CAST(NULL AS string) AS segment", "0.1 AS p_accept",
                                      "0.9 AS stay_if_accepted", "0.5 AS stay_if_declined").selectExpr(
        "offer", "segment", "CAST(p_accept AS double) AS p_accept", "CAST(stay_if_accepted AS double) AS stay_if_accepted",
        "CAST(stay_if_declined AS double) AS stay_if_declined")
    costs = spark.range(n).selectExpr("concat('offer ', id) AS offer", "CAST(IF(id = 77, 1, 500) AS double) AS offer_cost")
    got = nbo.score_next_best_offers(customers, rates, costs, None, revenue="arpu").collect()
    assert {(r["customer_id"], r["best_offer"], r["offer_cost"], r["eligible_offers"]) for r in got} == {
        ("a", "offer 77", 1.0, n), ("b", "offer 77", 1.0, n)}


def test_median_of_a_group(spark):
    rows = [("a", float(i % 7)) for i in range(1001)] + [("b", 1.0), ("b", 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["group"]: r["value"] for r in adhoc.filter_and_aggregate(df, "median", column="v", group_by="g").collect()}
    assert got == {"a": 3.0, "b": 2.5, "c": None}


def _customers(spark, n=400):
    """Rows of their own with a counter of how often a cell of `balance` was computed."""
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rng = np.random.default_rng(12)
    rows = [(i, float(b), float(r), float(c), f"s{i % 3}", f"r{i % 2}", int(b + e > 0)) for i, (b, r, c, e) in
            enumerate(rng.normal(size=(n, 4)))]
    df = spark.createDataFrame(rows, "customer_id long, _b double, revenue double, recency double, segment string, "
                               "region string, churned int")
    return df.withColumn("balance", F.udf(counted, "double").asNondeterministic()("_b")).drop("_b"), seen


@pytest.mark.parametrize("learner", ["logistic", "boosting"])
def test_learners_read_few_partitions(spark, monkeypatch, learner):
    kind, parts = {"logistic": model.LogisticRegression, "boosting": model.GBTClassifier}[learner], []
    fit = kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, rows: parts.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    df, _ = _customers(spark)
    rows = df.repartition(60).persist()
    model.fit(rows, ["balance"], ["segment"], "churned", learner=learner, trees=2)
    assert parts and max(parts) <= spark.sparkContext.defaultParallelism


def test_offer_models_join_customers_once(spark):
    df, seen = _customers(spark)
    rows = [(i, f"offer {k}", (i * 7 + k) % 3 // 2) for i in range(400) for k in range(2)]
    long = spark.createDataFrame(rows, "customer_id long, offer string, accepted int")
    _, table = nbo.acceptance_models(df, long, ["balance"], ["segment"])
    got = {r["offer"]: (r["shown"], r["low_data"]) for r in table.collect()}
    assert got == {"offer 0": (400, False), "offer 1": (400, False)}
    assert seen.value == 400


def test_model_queries_build_customers_once(spark, monkeypatch):
    from keepwell.plans.catalogue import modelling

    df, seen = _customers(spark)
    monkeypatch.setattr(modelling, "base", lambda s, d: df)
    known, held, rows = modelling._parts(spark, "")
    assert known.count() + held.count() == rows.count() == 400 and held.count() > 40
    assert seen.value == 400


def test_metrics_score_once(spark):
    df, seen = _customers(spark)
    long = metrics.long_scores(df, "churned", {"raw": "balance"}, "customer_id")
    assert metrics.evaluate(long).first()["n"] == 400
    assert seen.value == 400
