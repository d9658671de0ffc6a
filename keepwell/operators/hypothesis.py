"""Tests of every column against the 0/1 outcome, with one multiple-testing correction.

Counts, moments and ranks come from a few distributed aggregates over all columns at once; the
driver only turns one row per test into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepwell.functions import dist
from keepwell.functions.ordered import running_sums, value_counts
from keepwell.functions.quantiles import quantiles
from keepwell.functions.scalar import col, effect_band
from keepwell.operators.clean import spread, tall
from keepwell.operators.survival import association, level_counts

# Level of the family, least expected count of a cell.
ALPHA = 0.05
MIN_EXPECTED = 5
OTHER = "Other"
MISSING = "Missing"

TEST_SCHEMA = ("variable string, kind string, test string, statistic double, df double, "
               "p_value double, effect_name string, effect double, n long, note string")


def contingency_table(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    return level_counts(df, columns, y, missing=MISSING)


def expected_counts(levels: DataFrame) -> DataFrame:
    totals = F.broadcast(levels.groupBy("variable").agg(F.sum("retained").alias("_r"),
                                                        F.sum("churned").alias("_c")))
    size, n = F.col("retained") + F.col("churned"), F.col("_r") + F.col("_c")
    out = levels.join(totals, "variable").withColumns({
        "expected_retained": size * F.col("_r") / n, "expected_churned": size * F.col("_c") / n})
    enough = F.least("expected_retained", "expected_churned") >= MIN_EXPECTED
    return out.select("variable", "level", "retained", "churned", "expected_retained",
                      "expected_churned", enough.alias("enough"))


def cell_contributions(levels: DataFrame) -> DataFrame:
    e = expected_counts(levels)
    return e.select("variable", "level", *[
        (F.pow(F.col(c) - F.col(f"expected_{c}"), 2) / F.col(f"expected_{c}")).alias(c)
        for c in ("retained", "churned")])


def merge_rare_levels(table: dict[str, tuple[int, int]]
                      ) -> tuple[dict[str, tuple[int, int]], list[str]]:
    """Fold the smallest level into Other until all expected counts reach five or two levels are
    left. Works on the counts of one short table; `merged_levels` is the same for whole columns."""
    now, folded = dict(table), []
    while len(now) > 2:
        r, c = (sum(v[i] for v in now.values()) for i in (0, 1))
        if all(sum(v) * min(r, c) / (r + c) >= MIN_EXPECTED for v in now.values()):
            break
        rare = min((k for k in now if k != OTHER), key=lambda k: (sum(now[k]), k))
        add, old = now.pop(rare), now.get(OTHER, (0, 0))
        now[OTHER] = (old[0] + add[0], old[1] + add[1])
        folded.append(rare)
    return now, folded


def chi_square_row(variable: str, kind: str, table: dict[str, tuple[int, int]]) -> tuple:
    """One finished test from the counts of one variable."""
    merged, folded = merge_rare_levels(table)
    r, c = (sum(v[i] for v in merged.values()) for i in (0, 1))
    n = r + c
    chi2, least = 0.0, math.inf
    for a, b in merged.values():
        for seen, side in ((a, r), (b, c)):
            e = (a + b) * side / n
            least = min(least, e)
            chi2 += (seen - e) ** 2 / e if e else 0.0
    v = math.sqrt(chi2 / n) if len(merged) > 1 and r and c else 0.0
    note = f"merged into {OTHER}: {', '.join(folded)}" if folded else None
    if len(merged) == 2 and least < MIN_EXPECTED:
        (a, b), (x, y) = (merged[k] for k in sorted(merged))
        odds, p = dist.fisher_2x2(a, b, x, y)
        return (variable, kind, "Fisher's exact test", odds, None, p, "cramers_v", v, n, note)
    df = len(merged) - 1
    return (variable, kind, "Chi-square test of independence", chi2, float(df),
            dist.chi2_sf(chi2, df), "cramers_v", v, n, note)


def skip_reasons(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], y: str
                 ) -> DataFrame:
    """variable, kind, reason (null = testable)."""
    spark, parts = df.sparkSession, []
    if categorical:
        levels = level_counts(df, categorical, y).groupBy("variable").agg(F.count("*").alias("k"))
        names = F.broadcast(spark.createDataFrame([(c,) for c in categorical], "variable string"))
        k = F.coalesce("k", F.lit(0))
        parts.append(names.join(levels, "variable", "left").select(
            "variable", F.lit("categorical").alias("kind"),
            F.when(k < 2, "constant column").alias("reason")))
    if numeric:
        aggs, outs = [], {}
        for i, c in enumerate(numeric):
            v = col(c).cast("double")
            outs[c] = {}
            for g in (0, 1):
                x = F.when(col(y) == g, v)
                aggs += [F.count(x).alias(f"n{i}{g}"), F.min(x).alias(f"a{i}{g}"),
                         F.max(x).alias(f"b{i}{g}")]
                outs[c] |= {f"n{g}": f"n{i}{g}", f"a{g}": f"a{i}{g}", f"b{g}": f"b{i}{g}"}
        s = spread(df.agg(*aggs), outs, "variable")
        lo, hi = F.least("a0", "a1"), F.greatest("b0", "b1")
        flat = (F.coalesce(F.col("a0") == F.col("b0"), F.lit(True))
                & F.coalesce(F.col("a1") == F.col("b1"), F.lit(True)))
        parts.append(s.select(
            "variable", F.lit("numeric").alias("kind"),
            F.when(F.coalesce(lo == hi, F.lit(True)), "constant column")
            .when(F.least("n0", "n1") < 2, "fewer than 2 values in a group")
            .when(flat, "no variation within groups").alias("reason")))
    out = parts[0]
    return out.unionByName(parts[1]) if len(parts) > 1 else out


def group_moments(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Per variable: size, mean, sd, skewness and excess kurtosis of both outcome groups."""
    aggs, outs = [], {}
    for i, c in enumerate(columns):
        outs[c] = {}
        for g in (0, 1):
            x = F.when(col(y) == g, col(c).cast("double"))
            for name, e in (("n", F.count(x)), ("mean", F.avg(x)), ("sd", F.stddev_samp(x)),
                            ("skew", F.skewness(x)), ("kurt", F.kurtosis(x))):
                aggs.append(e.alias(f"{name}_{i}_{g}"))
                outs[c][f"{name}{g}"] = f"{name}_{i}_{g}"
    return spread(df.agg(*aggs), outs, "variable")


def _jarque_bera(g: int) -> Column:
    return F.col(f"n{g}") / 6 * (F.pow(f"skew{g}", F.lit(2)) + F.pow(f"kurt{g}", F.lit(2)) / 4)


def with_normality(moments: DataFrame) -> DataFrame:
    """Adds the Jarque-Bera statistic and its exact df-2 probability per group (all rows count)."""
    return moments.withColumns({
        "jb0": _jarque_bera(0), "jb1": _jarque_bera(1),
        "p_normal0": F.exp(-_jarque_bera(0) / 2), "p_normal1": F.exp(-_jarque_bera(1) / 2)
    }).withColumn("normal", (F.col("p_normal0") >= ALPHA) & (F.col("p_normal1") >= ALPHA))


def normality(moments: DataFrame) -> DataFrame:
    return with_normality(moments).select("variable", "jb0", "p_normal0", "jb1", "p_normal1",
                                          "normal")


def levene(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Brown-Forsythe form: spread around the group medians. Two aggregates over the data."""
    known = df.where(col(y).isin(0, 1))
    med = {(r["variable"], r[y]): r["q"][0] for r in
           quantiles(known, columns, [0.5], [y]).collect()}
    aggs, outs = [], {}
    for i, c in enumerate(columns):
        outs[c] = {}
        for g in (0, 1):
            m = med.get((c, g))
            z = F.when(col(y) == g, F.abs(col(c).cast("double") - m)) if m is not None \
                else F.lit(None).cast("double")
            for name, e in (("n", F.count(z)), ("z", F.avg(z)), ("v", F.var_pop(z))):
                aggs.append(e.alias(f"{name}_{i}_{g}"))
                outs[c][f"{name}{g}"] = f"{name}_{i}_{g}"
    s = spread(df.agg(*aggs), outs, "variable")
    n = F.col("n0") + F.col("n1")
    mean = (F.col("n0") * F.col("z0") + F.col("n1") * F.col("z1")) / n
    between = (F.col("n0") * F.pow(F.col("z0") - mean, 2)
               + F.col("n1") * F.pow(F.col("z1") - mean, 2))
    within = F.col("n0") * F.col("v0") + F.col("n1") * F.col("v1")
    return s.select("variable", n.alias("n"),
                    F.try_divide((n - 2) * between, within).alias("w"))


def with_welch(moments: DataFrame) -> DataFrame:
    """Adds t and Welch-Satterthwaite df (churned minus retained) and Cohen's d."""
    a = F.pow("sd1", F.lit(2)) / F.nullif(F.col("n1"), F.lit(0))
    b = F.pow("sd0", F.lit(2)) / F.nullif(F.col("n0"), F.lit(0))
    gap = F.col("mean1") - F.col("mean0")
    spread_of = F.pow(a, F.lit(2)) / F.nullif(F.col("n1") - 1, F.lit(0)) + F.pow(
        b, F.lit(2)) / F.nullif(F.col("n0") - 1, F.lit(0))
    pooled = F.sqrt(((F.col("n1") - 1) * F.pow("sd1", F.lit(2))
                     + (F.col("n0") - 1) * F.pow("sd0", F.lit(2)))
                    / F.nullif(F.col("n1") + F.col("n0") - 2, F.lit(0)))
    return moments.withColumns({
        "t": F.try_divide(gap, F.sqrt(a + b)),
        "df": F.try_divide(F.pow(a + b, F.lit(2)), spread_of),
        "cohens_d": F.coalesce(F.try_divide(gap, pooled), F.lit(0.0))})


def welch(moments: DataFrame) -> DataFrame:
    return with_welch(moments).where("n0 > 1 and n1 > 1").select("variable", "t", "df", "cohens_d")


def mann_whitney(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """U of the churned group with mid-ranks, rank-biserial r and the tie-corrected z."""
    long = tall(df.where(col(y).isin(0, 1)), {c: col(c).cast("double") for c in columns},
                ("variable", "value"), keep=[y])
    return rank_sums(long, ["variable"], "value", y)


def rank_sums(long: DataFrame, keys: Sequence[str], value: str, y: str) -> DataFrame:
    """Rank-sum statistics per key from counts of distinct values."""
    counts = value_counts(long, keys, value, {"c": F.count("*"),
                                              "c1": F.sum(col(y)).cast("long")})
    ran = running_sums(counts, keys, value, {"upto": "c"})
    c = F.col("c").cast("double")
    mid = F.col("upto") - (c - 1) / 2
    g = ran.groupBy(*map(col, keys)).agg(
        F.sum(F.col("c1") * mid).alias("_r1"), F.sum("c1").alias("n1"), F.sum("c").alias("_n"),
        F.sum(c * c * c - c).alias("_ties"))
    n1, n0 = F.col("n1").cast("double"), (F.col("_n") - F.col("n1")).cast("double")
    n = F.col("_n").cast("double")
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    var = n1 * n0 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1)))
    centre = n1 * n0 / 2
    far = F.greatest(u, n1 * n0 - u)
    return g.select(*map(col, keys), "n1", (F.col("_n") - F.col("n1")).alias("n0"),
                    u.alias("u"), F.try_divide(2 * u, n1 * n0).alias("_rb"),
                    F.try_divide(far - centre - 0.5, F.sqrt(var)).alias("z"),
                    (F.col("_ties") > 0).alias("ties")).withColumn(
        "_rb", F.col("_rb") - 1).withColumnRenamed("_rb", "rank_biserial")


def mann_whitney_p(u: float, n1: int, n0: int, z: float | None, ties: bool) -> float:
    """Two-sided p: exact for small groups without ties, else the normal approximation."""
    if not ties and min(n1, n0) <= 8 and n1 * n0 <= 20_000:
        far = int(max(u, n1 * n0 - u))
        ways = [1] + [0] * (n1 * n0)
        for j in range(1, n1 + 1):
            for s in range(n1 * n0, n0 + j - 1, -1):
                ways[s] -= ways[s - n0 - j]
            for s in range(j, n1 * n0 + 1):
                ways[s] += ways[s - j]
        return min(1.0, 2 * sum(ways[far:]) / math.comb(n1 + n0, n1))
    return 1.0 if z is None else min(1.0, 2 * dist.normal_sf(z))


def merged_levels(levels: DataFrame) -> DataFrame:
    """variable, level, retained, churned, folded after rare levels went into Other, for columns with
    any number of levels: all that are too small fold, and the next larger one too where they would
    not be enough together; the largest always stays."""
    size = F.col("retained") + F.col("churned")
    totals = levels.groupBy("variable").agg(F.sum("retained").alias("_r"), F.sum("churned").alias("_c"))
    least = MIN_EXPECTED * (F.col("_r") + F.col("_c")) / F.least("_r", "_c")
    sized = levels.join(totals, "variable").withColumns({
        "_other": F.col("level") == OTHER, "_small": F.coalesce(size < least, F.lit(True)),
        "_place": F.struct(size.alias("n"), F.col("level"))})
    plain, small = ~F.col("_other"), F.col("_small")
    sums = sized.groupBy("variable").agg(
        F.sum(F.when(F.col("_other") | small, size)).alias("_folded"),
        F.bool_or(small).alias("_any"), F.count_if(plain & ~small).alias("_large"),
        F.min(F.when(plain & ~small, F.col("_place"))).alias("_next"),
        F.max(F.when(plain, F.col("_place"))).alias("_top"), F.first(least).alias("_least"))
    short = F.col("_any") & (F.col("_folded") < F.col("_least")) & (F.col("_large") > 1)
    goes = plain & F.coalesce((small | (short & (F.col("_place") == F.col("_next"))))
                              & (F.col("_place") != F.col("_top")), F.lit(False))
    out = sized.join(sums, "variable").withColumn("_goes", goes)
    counts = levels.groupBy("variable").agg(F.count("*").alias("_k"))
    out = out.join(counts, "variable").withColumn("_goes", F.col("_goes") & (F.col("_k") > 2))
    name = F.when(F.col("_goes"), OTHER).otherwise(F.col("level"))
    return out.groupBy("variable", name.alias("level")).agg(
        F.sum("retained").alias("retained"), F.sum("churned").alias("churned"),
        F.count_if("_goes").alias("folded"))


def categorical_tests(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Chi-square or Fisher per column with at least two levels. The sums are one distributed
    aggregate; the driver sees one row per column."""
    merged = merged_levels(contingency_table(df, columns, y))
    found = association(merged)
    cells = F.sort_array(F.collect_list(F.when(F.col("_k") == 2, F.struct("level", "retained", "churned"))))
    both = merged.join(found.select("variable", F.col("levels").alias("_k")), "variable")
    pairs = both.groupBy("variable").agg(F.sum("folded").alias("folded"), cells.alias("cells"))
    rows = {}
    for r in found.join(pairs, "variable").where("levels >= 2").collect():
        note = f"{r['folded']} levels merged into {OTHER}" if r["folded"] else None
        if r["levels"] == 2 and r["min_expected"] < MIN_EXPECTED:
            (_, a, b), (_, c, d) = r["cells"]
            odds, p = dist.fisher_2x2(a, b, c, d)
            row = ("Fisher's exact test", odds, None, p)
        else:
            chi2 = r["chi2"] or 0.0
            row = ("Chi-square test of independence", chi2, float(r["df"]), dist.chi2_sf(chi2, r["df"]))
        rows[r["variable"]] = (r["variable"], "categorical", *row, "cramers_v", r["cramers_v"], r["n"], note)
    return df.sparkSession.createDataFrame([rows[c] for c in columns if c in rows], TEST_SCHEMA)


def numeric_tests(df: DataFrame, columns: Sequence[str], y: str, *, chosen_only: bool = True) -> DataFrame:
    """Welch where both groups look normal, Mann-Whitney elsewhere (or both rows of each)."""
    moments = with_welch(with_normality(group_moments(df, columns, y)))
    ranks = mann_whitney(df, columns, y)
    with ThreadPoolExecutor(2) as pool:  # two independent aggregates, one short row per column
        found, placed = pool.map(lambda t: {r["variable"]: r for r in t.collect()},
                                 (moments, ranks))
    rows = []
    for c in columns:
        if c not in placed:
            continue
        r, u = found[c], placed[c]
        n = r["n0"] + r["n1"]
        if r["normal"] or not chosen_only:
            rows.append((c, "numeric", "Welch's t-test", r["t"], r["df"],
                         dist.t_sf2(r["t"], r["df"]), "cohens_d", r["cohens_d"], n,
                         "chosen" if r["normal"] else None))
        if not r["normal"] or not chosen_only:
            rows.append((c, "numeric", "Mann-Whitney U test", u["u"], None,
                         mann_whitney_p(u["u"], u["n1"], u["n0"], u["z"], u["ties"]),
                         "rank_biserial", u["rank_biserial"], n, None if r["normal"] else "chosen"))
    return df.sparkSession.createDataFrame(rows, TEST_SCHEMA)


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", alpha: float = ALPHA,
                       by: Sequence[str] = ()) -> DataFrame:
    """Adjusted p over the whole family. The table holds one row per test."""
    family = Window.partitionBy(*map(col, by))
    ordered = family.orderBy(col(p).asc_nulls_last())
    back = family.orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding,
                                                        Window.currentRow)
    ranked = tests.withColumns({"_place": F.row_number().over(ordered),
                                "_m": F.count(col(p)).over(family)})
    adjusted = F.least(F.lit(1.0), F.min(col(p) * F.col("_m") / F.col("_place")).over(back))
    out = ranked.withColumn("p_adjusted", F.when(col(p).isNotNull(), adjusted)).drop("_place", "_m")
    return out.withColumn("significant", F.coalesce(F.col("p_adjusted") < alpha, F.lit(False)))


def with_bands(tests: DataFrame) -> DataFrame:
    e = F.col("effect")
    return tests.withColumn("band", F.when(
        F.col("effect_name") == "cohens_d", effect_band(e, "cohens_d")).otherwise(
        effect_band(e, "cramers_v")))


def rank_tests(tests: DataFrame) -> DataFrame:
    return tests.orderBy("p_adjusted", F.desc(F.abs("effect")), "variable")


def family_counts(tests: DataFrame) -> DataFrame:
    return tests.agg(F.count("*").alias("n_tests"),
                     F.count_if(F.col("significant")).alias("n_significant"))


def resignify(tests: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """How many tests are significant at other levels."""
    table = F.broadcast(tests.sparkSession.createDataFrame([(float(a),) for a in alphas],
                                                           "alpha double"))
    return (tests.crossJoin(table).groupBy("alpha")
            .agg(F.count_if(F.col("p_adjusted") < F.col("alpha")).alias("n_significant")))


_EFFECT_TITLES = {"cramers_v": "Cramér's V", "cohens_d": "Cohen's d",
                  "rank_biserial": "rank-biserial r"}


def with_conclusion(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Adds a reading of each result in words."""
    titles = F.create_map(*[F.lit(x) for pair in _EFFECT_TITLES.items() for x in pair])
    found = F.format_string("adjusted p %.4g, level %s; %s %.4g, a %s effect", F.col("p_adjusted"),
                            F.lit(str(alpha)), titles[F.col("effect_name")], F.col("effect"), F.col("band"))
    verdict = F.when(F.col("significant"), "churn differs by ").otherwise("no difference shown by ")
    return tests.withColumn("conclusion", F.when(F.col("p_adjusted").isNotNull(), F.concat(
        verdict, F.col("variable"), F.lit(" ("), found, F.lit(")"))))


def run_tests(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], y: str, *,
              extra: DataFrame | None = None, alpha: float = ALPHA) -> DataFrame:
    """The full family (every usable column, plus offer tests given as `extra`), corrected together
    and ranked."""
    spark: SparkSession = df.sparkSession
    usable = {r["variable"] for r in
              skip_reasons(df, categorical, numeric, y).where("reason is null").collect()}
    order = [c for c in [*categorical, *numeric] if c in usable]
    cats, nums = [c for c in categorical if c in order], [c for c in numeric if c in order]
    steps = []
    if cats:
        steps.append(lambda: categorical_tests(df, cats, y))
    if nums:
        steps.append(lambda: numeric_tests(df, nums, y))
    tests = spark.createDataFrame([], TEST_SCHEMA)
    with ThreadPoolExecutor(2) as pool:
        for part in pool.map(lambda step: step(), steps):
            tests = tests.unionByName(part)
    if extra is not None:
        tests = tests.unionByName(extra)
    return rank_tests(with_bands(benjamini_hochberg(tests, alpha=alpha)))
