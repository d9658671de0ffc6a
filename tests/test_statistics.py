"""Tests, survival, metrics and experiments on hand-worked or planted cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.functions import dist
from keepwell.operators import assignment as a
from keepwell.operators import describe, metrics, survival
from keepwell.operators import design as ds
from keepwell.operators import hypothesis as h
from keepwell.operators import results as r
from keepwell.operators.filters import Filter, FilterError


@pytest.fixture(scope="module")
def people(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        churn = int(rnd.random() < (0.5 if i % 3 == 0 else 0.2))
        rows.append((i, ["month", "year", "two"][i % 3], rnd.choice(["x", "y"]),
                     rnd.gauss(60 + 8 * churn, 10), rnd.expovariate(1) ** 2, 5.0, churn,
                     float(min(72, int(rnd.expovariate(1 / 30))))))
    return spark.createDataFrame(rows, "id long, contract string, paper string, charges double, "
                                       "tickets double, flat double, churn int, tenure double")


def test_chi_square_by_hand():
    row = h.chi_square_row("v", "categorical", {"a": (30, 10), "b": (20, 40)})
    # expected 20/20 and 30/30: 100/20 * 2 + 100/30 * 2
    assert row[3] == pytest.approx(50 / 3) and row[4] == 1
    assert row[7] == pytest.approx(math.sqrt(50 / 3 / 100))
    assert row[5] == pytest.approx(dist.chi2_sf(50 / 3, 1))


def test_rare_levels_are_folded():
    merged, folded = h.merge_rare_levels({"a": (50, 50), "b": (40, 30), "c": (6, 5), "d": (3, 2)})
    assert folded == ["d", "c"] and merged == {"a": (50, 50), "b": (40, 30), "Other": (9, 7)}
    two, none = h.merge_rare_levels({"a": (3, 0), "b": (1, 1)})
    assert none == [] and set(two) == {"a", "b"}
    row = h.chi_square_row("v", "categorical", {"a": (3, 1), "b": (1, 3)})
    assert row[2].startswith("Fisher") and row[5] == pytest.approx(34 / 70)


def test_exact_rank_test():
    # Two groups of three without ties, fully separated: 2 / C(6,3).
    assert h.mann_whitney_p(9, 3, 3, None, False) == pytest.approx(0.1)
    assert h.mann_whitney_p(4.5, 3, 3, None, False) == 1.0


def test_merged_levels_of_wide_columns(spark):
    rng, rows = random.Random(3), []
    for v in range(60):
        k = rng.randrange(1, 40)
        rows += [(f"v{v}", "Other" if i == 3 and v % 4 == 0 else f"l{i:02}", rng.choice([0, 1, 3, 20, 90]),
                  rng.choice([0, 1, 2, 9, 40])) for i in range(k)]
    rows = [r for r in rows if r[2] + r[3]]
    got = {}
    for r in h.merged_levels(spark.createDataFrame(
            rows, "variable string, level string, retained long, churned long")).collect():
        got.setdefault(r["variable"], {})[r["level"]] = (r["retained"], r["churned"])
    for v in {r[0] for r in rows}:
        counts = {r[1]: (r[2], r[3]) for r in rows if r[0] == v}
        if min(sum(x[i] for x in counts.values()) for i in (0, 1)):
            assert got[v] == h.merge_rare_levels(counts)[0], v


def test_family_finds_planted_effects(spark, people):
    tests = {t["variable"]: t for t in h.run_tests(
        people, ["contract", "paper"], ["charges", "tickets", "flat"], "churn").collect()}
    assert set(tests) == {"contract", "paper", "charges", "tickets"}
    assert tests["contract"]["significant"] and tests["charges"]["significant"]
    assert not tests["paper"]["significant"]
    assert tests["charges"]["test"] == "Welch's t-test"
    assert tests["tickets"]["test"] == "Mann-Whitney U test"
    told = {r["variable"]: r["conclusion"] for r in h.with_conclusion(spark.createDataFrame(
        list(tests.values()))).collect()}
    assert told["charges"].startswith("churn differs by charges (adjusted p ")
    assert told["paper"].startswith("no difference shown by paper")
    both = h.numeric_tests(people, ["charges"], "churn", chosen_only=False).collect()
    assert {b["note"] for b in both} == {"chosen", None}


def test_benjamini_hochberg_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)],
                               "variable string, p_value double")
    got = {x["variable"]: x["p_adjusted"] for x in h.benjamini_hochberg(df).collect()}
    assert got["a"] == pytest.approx(0.04) and got["c"] == pytest.approx(0.04 * 4 / 3)
    assert got["b"] == pytest.approx(0.04 * 4 / 3) and got["d"] == pytest.approx(0.5)


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1), (3.0, 1), (5.0, 0)], "t0 double, e int")
    curve = {x["t"]: x for x in survival.kaplan_meier(df, "t0", "e").collect()}
    assert curve[0.0]["s"] == 1 and curve[0.0]["lo"] == 1
    assert curve[1.0]["s"] == pytest.approx(0.8)
    assert curve[3.0]["s"] == pytest.approx(0.8 / 3)
    v = 1 / (5 * 4) + 2 / (3 * 1)
    c = math.log(-math.log(0.8 / 3))
    half = 1.959963984540054 * math.sqrt(v) / math.log(0.8 / 3)
    assert curve[3.0]["lo"] == pytest.approx(math.exp(-math.exp(c - half)))
    s = survival.survival_summary(survival.kaplan_meier(df, "t0", "e")).first()
    assert s["median"] == 3.0 and s["s6"] is None and s["events"] == 3


def test_all_events_end_at_zero(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "t0 double, e int")
    last = survival.kaplan_meier(df, "t0", "e").orderBy(F.desc("t")).first()
    assert (last["s"], last["lo"], last["hi"]) == (0.0, 0.0, 0.0)


def test_logrank_two_groups_by_hand(spark):
    rows = [("g1", t, 1) for t in (1.0, 2.0, 3.0, 4.0, 5.0)] + [
        ("g2", t, e) for t, e in ((2.5, 1), (6.0, 1), (7.0, 0), (8.0, 1), (9.0, 0))]
    df = spark.createDataFrame(rows, "g string, t0 double, e int")
    n = {"g1": 5, "g2": 5}
    expect = var = 0.0
    for g, t, e in sorted(rows, key=lambda x: x[1]):
        total = n["g1"] + n["g2"]
        if e and total > 0:
            share = n["g1"] / total
            expect += share
            var += share * (1 - share) if total > 1 else 0
        n[g] -= 1
    stat = (5 - expect) ** 2 / var
    got = survival.logrank_tests(survival.logrank_counts(df, ["g"], "t0", "e")).first()
    assert got["statistic"] == pytest.approx(stat) and got["df"] == 1
    assert got["p_value"] == pytest.approx(dist.chi2_sf(stat, 1))


def _dense_logrank(rows):
    """The statistic from the written-out covariance."""
    levels = sorted({g for g, _, _ in rows})
    k = {g: i for i, g in enumerate(levels)}
    left = np.zeros(len(levels))
    for g, _, _ in rows:
        left[k[g]] += 1
    gap, cov = np.zeros(len(levels)), np.zeros((len(levels), len(levels)))
    by_time = {}
    for g, t, e in rows:
        by_time.setdefault(t, []).append((k[g], e))
    for t in sorted(by_time):
        n, d = left.sum(), sum(e for _, e in by_time[t])
        for i, e in by_time[t]:
            gap[i] += e
        gap -= d * left / n
        if n > 1:
            cov += d * (n - d) / (n - 1) * (np.diag(left / n) - np.outer(left, left) / n ** 2)
        for i, _ in by_time[t]:
            left[i] -= 1
    return gap @ np.linalg.pinv(cov) @ gap, np.diag(cov)


@pytest.mark.parametrize("levels", [2, 5, 60])
def test_logrank_in_a_task_and_as_tables(spark, levels):
    rnd = random.Random(levels)
    rows = [(f"l{rnd.randrange(levels):03d}", float(rnd.randrange(40)), int(rnd.random() < 0.6)) for _ in range(levels * 30)]
    rows += [("early", 0.5, 0)] * 6  # gone before the first event that others see
    df = spark.createDataFrame(rows, "g string, t0 double, e int").repartition(3)
    stat, diagonal = _dense_logrank(rows)
    counts = survival.logrank_counts(df, ["g"], "t0", "e")
    one = survival.logrank_statistics(counts).first()
    assert one["statistic"] == pytest.approx(stat, rel=1e-8) and one["df"] == len(diagonal) - 1
    table = survival.logrank_table(counts).orderBy("level").collect()
    assert [r["variance"] for r in table] == pytest.approx(list(diagonal[np.argsort(sorted({g for g, _, _ in rows}))]), abs=1e-9)
    if levels <= 5:
        spread = survival.logrank_statistics(counts, in_one=0).first()
        assert spread["statistic"] == pytest.approx(stat, rel=1e-8)


def test_logrank_of_thousands_of_levels(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 5000).cast("string").alias("g"), F.pmod(F.xxhash64("id"), F.lit(70)).cast("double").alias("t0"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("e"))
    got = survival.logrank_tests(survival.logrank_counts(df, ["g"], "t0", "e")).first()
    assert got["df"] == 4999 and 4000 < got["statistic"] < 6000  # no level differs: about its df


def test_many_levels_fold_into_other(spark):
    rows = [(f"l{i:02d}", i % 2) for i in range(25) for _ in range(30 - i)]
    df = spark.createDataFrame(rows, "level string, y int")
    got = {x["level"]: x["n"] for x in describe.category_rates(df, ["level"], "y").collect()}
    assert len(got) == 20 and got["Other"] == sum(30 - i for i in range(19, 25))


def test_constant_column_has_one_bin(spark):
    df = spark.createDataFrame([(7.0, None)] * 4, "x double, y double")
    rows = describe.histogram(df, ["x", "y"]).collect()
    assert [(x["lo"], x["hi"], x["n"]) for x in rows] == [(6.5, 7.5, 4)]


@pytest.fixture(scope="module")
def tied(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(997):
        p = rnd.randint(0, 12) / 12 if i % 3 else 0.5
        rows.append(("raw", i, int(rnd.random() < p), p))
    return rows, spark.createDataFrame(rows, "kind string, row_id long, y int, p double")


def test_deciles_split_ties_by_row(tied):
    rows, df = tied
    ranked = sorted(rows, key=lambda x: (-x[3], x[1]))
    got = metrics.deciles(df).orderBy("decile").collect()
    at = 0
    for i, d in enumerate(got):
        size = 997 // 10 + (1 if i < 7 else 0)
        part = ranked[at:at + size]
        assert (d["n"], d["churners"]) == (size, sum(x[2] for x in part))
        at += size
    top = metrics.at_top(df).first()
    assert top["k"] == 100 and top["churners_in_top"] == sum(x[2] for x in ranked[:100])


def test_auc_and_curves_by_pairs(tied):
    rows, df = tied
    pos = [x[3] for x in rows if x[2]]
    neg = [x[3] for x in rows if not x[2]]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx(
        wins / len(pos) / len(neg), abs=1e-12)
    pts = metrics.roc_points(df).orderBy("point").collect()
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(pts, pts[1:]))
    assert area == pytest.approx(wins / len(pos) / len(neg), abs=1e-9)
    assert (pts[0]["fpr"], pts[-1]["tpr"]) == (0, 1)


def test_sample_sizes_match_published_plans():
    assert ds.relative_plan(0.20, 0.25)["n_per_arm"] == 903
    assert ds.relative_plan(0.26, 0.20)["n_per_arm"] == 1038
    d = ds.Design(1, baseline_rate=0.26, mde=0.05)
    t, c = d.required()
    assert t == c and ds.achieved_power(d, t, c) == pytest.approx(0.8, abs=2e-3)
    small = ds.detectable(d, t + c)
    assert small["absolute"] == pytest.approx(0.05, abs=1e-3)
    assert ds.detectable(d, 2) is None
    for bad in (dict(mde=0.3), dict(alpha=0.5), dict(power=0.2), dict(control_share=0.99),
                dict(mde_type="relative", mde=1.2)):
        with pytest.raises(ds.DesignError):
            ds.Design(1, **{**dict(baseline_rate=0.26), **bad}).required()


def test_newcombe_textbook(spark):
    # Newcombe (1998), method 10: 56/70 against 48/80 gives 0.0524 to 0.3339.
    df = spark.createDataFrame([(56, 70, 48, 80, 1.959963984540054)],
                               "x_treatment int, n_treatment int, x_control int, n_control int, z double")
    c = r.rate_comparison(df)
    got = df.select(*[e.alias(n) for n, e in c.items()]).first()
    assert got["ci_low"] == pytest.approx(0.0524, abs=5e-5)
    assert got["ci_high"] == pytest.approx(0.3339, abs=5e-5)


def _outcomes(spark, effect, broken=False, n=6000):
    df = spark.range(n).select(F.lit(5).cast("long").alias("experiment_id"),
                               F.col("id").cast("string").alias("customer_id"))
    df = a.assign_arms(df, 5, "customer_id", 0.5)
    if broken:
        df = df.where((F.col("arm") == "treatment") | (F.col("customer_id").cast("long") % 3 > 0))
    u = a.hash_unit(F.lit("c"), F.col("customer_id"))
    took = (F.col("arm") == "treatment") & (a.hash_unit(F.lit("a"), F.col("customer_id")) < 0.5)
    return df.withColumns({
        "churned": (u < F.when(F.col("arm") == "treatment", 0.3 - effect).otherwise(0.3)).cast("int"),
        "offer_accepted": F.when(F.col("arm") == "treatment", took.cast("int")),
        "revenue": F.lit(50.0) + a.hash_unit(F.lit("r"), F.col("customer_id")),
        "complaints": F.lit(0), "segments": F.array(F.lit("all"))})


@pytest.mark.parametrize("effect,broken,verdict", [(0.1, False, "ship"), (0.0, False, "inconclusive"),
                                                   (-0.1, False, "dont_ship"),
                                                   (0.1, True, "untrustworthy")])
def test_planted_experiments_get_their_verdict(spark, effect, broken, verdict):
    designs = ds.designs_frame(spark, [ds.Design(5, "X", customer_value=900.0, offer_cost=5.0)])
    row = r.analyse(_outcomes(spark, effect, broken), designs).first()
    assert row["verdict"] == verdict
    assert (row["srm_p"] < 0.001) == broken == row["srm_failed"]
    if effect > 0:
        assert row["p_value"] < 0.001 and row["customers_saved"] > 0


def test_assignment_is_stable_and_balanced(spark):
    import hashlib

    df = spark.range(4000).withColumn("customer_id", F.concat(F.lit("C"), "id"))
    one = {x["customer_id"]: x["arm"] for x in a.assign_arms(df, 9, "customer_id", 0.3).collect()}
    two = {x["customer_id"]: x["arm"] for x in
           a.assign_arms(df.repartition(3), 9, "customer_id", 0.3).collect()}
    assert one == two
    for cid in ("C0", "C17", "C3999"):
        head = hashlib.sha256(f"9:{cid}".encode()).digest()[:8]
        assert one[cid] == ("control" if int.from_bytes(head, "big") / 2**64 < 0.3 else "treatment")
    share = sum(v == "control" for v in one.values()) / 4000
    assert abs(share - 0.3) < 0.03
    h1 = a.snapshot_hash(df, ["customer_id", "id"]).first()[0]
    assert h1 == a.snapshot_hash(df.repartition(5), ["id", "customer_id"]).first()[0]
    assert h1 != a.snapshot_hash(df.where("id > 0"), ["customer_id", "id"]).first()[0]
    balance = a.balance_numeric(a.assign_arms(df, 9, "customer_id", 0.3), ["id"])
    assert not balance.first()["flagged"]
    warnings = a.assignment_warnings(a.assign_arms(df, 9, "customer_id", 0.3), balance, 5000, 10, 4100)
    assert len(warnings) == 2


def test_assignment_is_written_by_experiment(spark, tmp_path):
    df = a.assign_experiment(spark.range(50).select(F.col("id").cast("string").alias("customer_id")),
                             3, 0.5)
    a.write_assignment(df, str(tmp_path / "assignments"))
    back = spark.read.parquet(str(tmp_path / "assignments"))
    assert back.count() == 50 and (tmp_path / "assignments" / "experiment_id=3").exists()


def test_segment_filters(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "p string, x double")

    def n(*filters):
        return a.apply_segment(df, filters).count()

    assert n(Filter("p", "ne", "a")) == 1 and n(Filter("p", "not_in", ("a",))) == 1
    assert n(Filter("x", "gte", 1)) == 2 and n(Filter("x", "eq", 1.0)) == 1
    for bad in (Filter("q", "eq", 1), Filter("p", "gt", 1), Filter("x", "gt", "many"),
                Filter("p", "eq", ["a"])):
        with pytest.raises(FilterError):
            a.apply_segment(df, [bad])


def test_results_file_is_read_as_text(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text("Customer_ID,Group,CHURNED,offer_accepted\n 7 ,Treatment,YES,\n8,control,0,1\n")
    rows = r.normalise_results(r.read_results(spark, str(f)))
    got = {x["customer_id"]: x for x in rows.collect()}
    assert (got["7"]["arm"], got["7"]["churned"], got["7"]["offer_accepted"]) == ("treatment", 1, 0)
    plan = spark.createDataFrame([("7", "control"), ("9", "control")], "customer_id string, arm string")
    checks = {x["check"]: x["n"] for x in r.check_results(rows, plan, dt.date(2024, 1, 1)).collect()}
    assert checks == {"wrong_arm": 1, "never_assigned": 1, "missing_from_file": 1,
                      "control_accepted": 1}
    f.write_text("customer_id,churned\n1,0\n")
    with pytest.raises(r.ResultsError, match="group"):
        r.read_results(spark, str(f))


def test_design_limits_are_inclusive():
    for alpha, fits in ((0.2, True), (0.20000005, False)):
        d = ds.Design(experiment_id=1, alpha=alpha)
        if fits:
            d.check()
        else:
            with pytest.raises(ds.DesignError):
                d.check()
    for share in (0.05, 0.95):
        ds.Design(experiment_id=1, control_share=share).check()
    with pytest.raises(ds.DesignError):
        ds.Design(experiment_id=1, control_share=0.0499999999).check()
