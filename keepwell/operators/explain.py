"""Explanations: contributions per feature, odds ratios, drivers, scored customers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from keepwell.functions.scalar import col, half_even, hash_unit, risk_band
from keepwell.functions.stored import shared_folder, stored
from keepwell.operators.clean import spread, tall
from keepwell.operators.logit import contrasts, fit_absorbed
from keepwell.operators.model import Fitted, owners, transform
from keepwell.operators.segment import filled, scales

# Plotted features and points, diverging coefficient, refits,
# reasons per customer, forest rows, 97.5 % normal point.
SAMPLE_FEATURES = 10
SAMPLE_POINTS = 200
MAX_COEF = 15.0
TOP_REASONS = 3
FOREST_ROWS = 15
MAX_TERMS = 4096  # terms beside the absorbed column: their matrix is dense
Z95 = 1.959963984540054
MISSING = "Missing"

erfc_of = np.vectorize(math.erfc, otypes=[float])


def contributions(fitted: Fitted, df: DataFrame, background: DataFrame, orders: int | None = None) -> DataFrame:
    """The frame with `contributions`: log-odds pushed by every feature, in feature order (orders: see
    path_contributions)."""
    if fitted.learner == "boosting":
        return path_contributions(fitted, df, background, orders)
    mean = transform(fitted, background).agg(Summarizer.mean(F.col("_features")).alias("m")).first()["m"]
    coef = fitted.model.stages[-1].coefficients.toArray()
    mean = mean.toArray()
    size = sum(w for _, _, w in owners(fitted))
    out = transform(fitted, df).withColumn("_a", vector_to_array("_features"))
    parts = []
    for _, at, width in owners(fitted):
        if width == 1:
            parts.append((F.get("_a", F.lit(at)) - float(mean[at])) * float(coef[at]))
            continue
        hi = min(at + width, size, len(coef))
        weights = F.array(*[F.lit(float(c)) for c in coef[at:hi]])
        offset = float(np.dot(coef[at:hi], mean[at:hi]))
        parts.append(F.aggregate(F.zip_with(F.slice("_a", at + 1, hi - at), weights,
                                            lambda x, c: x * c), F.lit(0.0), lambda s, v: s + v)
                     - offset)
    return out.select(*map(col, df.columns), F.array(*parts).alias("contributions"))


def _left(split: Row, v: float) -> bool:
    """Whether the value goes left, as Spark decides it, also for a mean that is no category."""
    values, n = split["leftCategoriesOrThreshold"], split["numCategories"]
    if n < 0:
        return v <= values[0]
    return v in values if len(values) <= n // 2 else v in values or v not in range(n)


def _leaves(spark: SparkSession, fitted: Fitted, mean: np.ndarray) -> list[tuple[list, list]]:
    """(splits, leaves) of every tree. A split is (feature, None, threshold), or (feature, level, whether other levels
    and this one go left). A leaf is (log-odds, needs, keeps), the features on its path with their [(split, goes left)]:
    the mean passes those of `keeps`, but not those of `needs`. The driver reads the nodes that Spark saves, some
    dozens a tree whatever the rows."""
    learner = fitted.model.stages[-1]
    places: list[tuple[int, int | None]] = [(i, None) for i in range(len(fitted.numeric))]
    if fitted.categorical:  # a place for each level, one for unknown levels, one for invalid ones
        for i, n in enumerate(fitted.model.stages[2].categorySizes, len(fitted.numeric)):
            places += [(i, level) for level in range(n + 1)]
    folder = shared_folder(spark)
    learner.write().save(folder)
    nodes: dict[int, dict[int, Row]] = {}
    for r in spark.read.parquet(f"{folder}/data").select("treeID", "nodeData").collect():
        nodes.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    out = []
    for tree, weight in enumerate(learner.treeWeights):
        splits, leaves, open_paths = [], [], [(0, {}, {})]
        while open_paths:
            at, steps, passes = open_paths.pop()
            node = nodes[tree][at]
            if node["leftChild"] < 0:
                leaves.append((2.0 * weight * node["prediction"], [(f, own) for f, own in steps.items() if not passes[f]],
                               [(f, own) for f, own in steps.items() if passes[f]]))
                continue
            split = node["split"]
            place = split["featureIndex"]
            f, level = places[place]
            for child, go in ((node["leftChild"], True), (node["rightChild"], False)):
                met = passes.get(f, True) and _left(split, float(mean[place])) == go
                open_paths.append((child, steps | {f: [*steps.get(f, []), (len(splits), go)]}, passes | {f: met}))
            splits.append((f, level, split["leftCategoriesOrThreshold"][0] if level is None else (
                _left(split, 0.0), _left(split, 1.0))))
        out.append((splits, leaves))
    return out


def _shapley(trees: list[tuple[list, list]]):
    """(feature, row) scaled values and numbers of levels -> (feature, row) contributions. With the mean for all but
    some own features, a row is in a leaf if they include all of `needs`, which the row passes, and none of `keeps`
    that it fails; the mean gain over all orders is a closed form of how many there are of both."""
    def run(x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for splits, leaves in trees:
            left = [x[f] <= rule if level is None else np.where(x[f] == level, rule[1], rule[0]) for f, level, rule in splits]
            sides = [(~go, go) for go in left]
            for value, needs, keeps in leaves:
                passed = np.ones(x.shape[1], bool)
                for _, own in needs:
                    for n, go in own:
                        passed &= sides[n][go]
                at = np.flatnonzero(passed)
                if not len(at):
                    continue
                failed = [~np.logical_and.reduce([sides[n][go][at] for n, go in own]) for _, own in keeps]
                b = sum((g.astype(int) for g in failed), np.zeros(len(at), int))
                a, ways = len(needs), [math.comb(len(needs) + n, n) for n in range(len(keeps) + 1)]
                for f, _ in needs:
                    out[f, at] += np.array([value / (a * w) for w in ways])[b]
                lost = np.array([0.0, *[value / (n * w) for n, w in enumerate(ways[1:], 1)]])[b]
                for (f, _), g in zip(keeps, failed, strict=True):
                    out[f, at] -= np.where(g, lost, 0.0)
        return out

    return run


def path_contributions(fitted: Fitted, df: DataFrame, background: DataFrame, orders: int | None = None) -> DataFrame:
    """Contributions of a model that is no sum of its features: the log-odds gained as features, one
    after the other, take their value instead of the training mean, averaged over all k! orders of the
    features (Shapley values). They are exact, leaf by leaf, at a cost that does not grow with k!, and add up to
    the row's log-odds less those of the mean. A row is scored where it lies: nothing is joined by its id.
    `orders` was the number of orders to average; all of them are taken now, whatever it says."""
    mean = transform(fitted, background).agg(Summarizer.mean(F.col("_features")).alias("m")).first()["m"].toArray()
    shapley = _shapley(_leaves(df.sparkSession, fitted, mean))

    @F.pandas_udf("array<double>")
    def pushed(x: pd.DataFrame) -> pd.Series:
        return pd.Series([*shapley(x.to_numpy(dtype=float).T.copy()).T])

    own = [*[f"_z_{c}" for c in fitted.numeric], *[f"_i_{c}" for c in fitted.categorical]]
    return transform(fitted, df).select(*map(col, df.columns), pushed(F.struct(*[
        col(c).alias(f"x{i}") for i, c in enumerate(own)])).alias("contributions"))


def global_importance(explained: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature over all explained rows."""
    row = explained.agg(*[F.avg(F.abs(F.get("contributions", F.lit(i)))).alias(f"c{i}")
                          for i in range(len(features))])
    return spread(row, {f: {"mean_abs": f"c{i}"} for i, f in enumerate(features)}, "feature")


def contribution_sample(explained: DataFrame, fitted: Fitted, importance: DataFrame,
                        id_column: str) -> DataFrame:
    """Up to 200 (value, contribution) points for each of the ten strongest features."""
    features = [*fitted.numeric, *fitted.categorical]
    best = F.broadcast(importance.orderBy(F.desc("mean_abs"), "feature").limit(SAMPLE_FEATURES)
                       .select("feature"))
    points = F.array(*[F.struct(F.lit(f).alias("feature"), col(f).cast("string").alias("value"),
                                F.get("contributions", F.lit(i)).alias("contribution"))
                       for i, f in enumerate(features)])
    long = explained.select(col(id_column).alias("id"), F.explode(points).alias("p")).select(
        "id", "p.*").join(best, "feature", "left_semi")
    order = Window.partitionBy("feature").orderBy(hash_unit(F.col("feature"), F.col("id")), "id")
    return (long.withColumn("_k", F.row_number().over(order))
            .where(F.col("_k") <= SAMPLE_POINTS).select("feature", "id", "value", "contribution"))


def reference_levels(df: DataFrame, categorical: Sequence[str]) -> dict[str, list[str]]:
    """Levels per column, the most frequent one (the reference) first."""
    if not categorical:
        return {}
    counts = (tall(df, {c: F.coalesce(col(c).cast("string"), F.lit(MISSING)) for c in categorical},
                   ("c", "v")).groupBy("c", "v").agg(F.count("*").alias("n")))
    out: dict[str, list[tuple[int, str]]] = {}
    rows = counts.limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} levels; leave out columns with very many levels")
    for r in rows:
        out.setdefault(r["c"], []).append((r["n"], r["v"]))
    levels = {}
    for c, seen in out.items():
        ref = min(seen, key=lambda t: (-t[0], t[1]))[1]
        levels[c] = [ref, *sorted(v for _, v in seen if v != ref)]
    return levels


def odds_ratio_design(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
                      ) -> tuple[dict[str, Column], dict[str, dict]]:
    """Columns of the design (numerics per sd, levels against the most frequent one) and what
    each stands for."""
    cols: dict[str, Column] = {}
    terms: dict[str, dict] = {}
    fit = scales(train, numeric) if numeric else {}
    for c, s in fit.items():
        cols[c] = (filled(c, s) - s.mean) / s.sd
        terms[c] = {"feature": c, "label": f"{c} (per 1 SD)"}
    for c, names in reference_levels(train, categorical).items():
        for level in names[1:]:
            name = f"{c} = {level}"
            value = F.coalesce(col(c).cast("string"), F.lit(MISSING))
            cols[name] = (value == level).cast("double")
            terms[name] = {"feature": c, "label": f"{c}: {level} vs {names[0]}"}
    return cols, terms


def separated_terms(wide: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns that tell the outcomes apart by themselves: the ranges of the two outcomes do not
    overlap, or a 0/1 column has only one outcome where it is 1 (one aggregate)."""
    ends = [f(F.when(F.col("_y") == y, F.col(c))).alias(f"{tag}{y}{i}") for i, c in enumerate(names)
            for y in (0, 1) for tag, f in (("a", F.min), ("b", F.max))]
    marks = [F.bool_and(F.col(c).isin(0.0, 1.0)).alias(f"m{i}") for i, c in enumerate(names)]
    row = wide.agg(*ends, *marks).first()
    out = []
    for i, c in enumerate(names):
        low0, high0, low1, high1 = (row[f"{t}{y}{i}"] for y in (0, 1) for t in ("a", "b"))
        if None in (low0, low1):
            continue
        apart = high0 < low1 or high1 < low0
        if apart or row[f"m{i}"] and (low0, low1) == (0, 0) and high0 != high1:
            out.append(c)
    return out


def _widest(train: DataFrame, categorical: Sequence[str]) -> str | None:
    """The column of the most levels (estimated, one aggregate), the first of equal ones."""
    if not categorical:
        return None
    row = train.agg(*[F.approx_count_distinct(col(c)).alias(f"n{i}") for i, c in enumerate(categorical)]).first()
    return categorical[max(range(len(categorical)), key=lambda i: (row[i], -i))]


def _level_table(train: DataFrame, column: str, y: str) -> tuple[DataFrame, str]:
    """(level, apart: one outcome only), written once; and the most frequent level."""
    counts = stored(train.groupBy(F.coalesce(col(column).cast("string"), F.lit(MISSING)).alias("level")).agg(
        F.count("*").alias("n"), F.sum(col(y).cast("double")).alias("ones")))
    first = counts.agg(F.min_by("level", F.struct(-F.col("n"), "level"))).first()[0]
    apart = (F.col("level") != first) & ((F.col("ones") == 0) | (F.col("ones") == F.col("n")))
    return counts.select("level", apart.alias("apart")), first


def _wald(rows: DataFrame) -> DataFrame:
    """rows: feature, term, label, coef, se."""
    @F.pandas_udf("double")
    def p_value(coef: pd.Series, se: pd.Series) -> pd.Series:
        return pd.Series(erfc_of(np.abs(coef.to_numpy() / se.to_numpy()) / math.sqrt(2)))

    return rows.select(
        "feature", "term", "label", "coef", "se", F.exp("coef").alias("odds_ratio"),
        F.exp(F.col("coef") - Z95 * F.col("se")).alias("ci_lower"),
        F.exp(F.col("coef") + Z95 * F.col("se")).alias("ci_upper"), p_value("coef", "se").alias("p_value"))


def odds_ratios(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str
                ) -> tuple[DataFrame, DataFrame]:
    """(unpenalised logit terms with Wald intervals; term, reason of the terms left out). The categorical
    column of the most levels is absorbed (`logit`), so it may have any number of them and stays a table;
    all other terms together are at most MAX_TERMS. Left out are terms that separate the outcomes by
    themselves, terms that the levels or earlier terms explain, and, after a fit, those whose coefficients
    run away; rows of a level that is left out count as the reference level."""
    spark, wide_column = train.sparkSession, _widest(train, categorical)
    cols, terms = odds_ratio_design(train, numeric, [c for c in categorical if c != wide_column])
    short = {f"t{i}": t for i, t in enumerate(cols)}
    if wide_column:
        levels, first = _level_table(train, wide_column, y)
        level = F.coalesce(col(wide_column).cast("string"), F.lit(MISSING))
    else:
        levels, first, level = spark.createDataFrame([], "level string, apart boolean"), "", F.lit("")
    wide = stored(train.select(col(y).cast("double").alias("_y"), level.alias("_of"),
                               *[cols[t].alias(c) for c, t in short.items()]))
    apart = separated_terms(wide, list(short))
    kept = [c for c in short if c not in apart]
    notes = [(short[c], "separates the outcomes") for c in apart]
    gone = levels.where("apart").select("level", F.lit("separates the outcomes").alias("reason"))
    while True:
        merged = wide.join(gone.select(F.col("level").alias("_gone")), F.col("_of") == F.col("_gone"), "left")
        x = F.array(*map(F.col, kept)) if kept else F.array().cast("array<double>")
        found = fit_absorbed(merged.select(F.col("_y").alias("y"), F.when(F.col("_gone").isNotNull(), first).otherwise(
            F.col("_of")).alias("level"), x.alias("x")), len(kept))
        used = [kept[i] for i in found.kept]
        notes += [(short[c], "depends on other terms") for c in kept if c not in used]
        se = np.sqrt(np.maximum(np.diag(found.inverse), 0.0))
        wild = [c for c, b, s in zip(used, found.coef, se) if abs(b) > MAX_COEF or not s > 0]
        against = stored(contrasts(found, first))
        far = against.where((F.abs("coef") > MAX_COEF) | F.isnan("se"))
        if not wild and far.isEmpty():
            break
        together = "separates the outcomes together with others"
        notes += [(short[c], together) for c in wild]
        kept = [c for c in used if c not in wild]
        gone = gone.unionByName(far.select("level", F.lit(together).alias("reason")))
    rows = [(terms[short[c]]["feature"], short[c], terms[short[c]]["label"], float(b), float(s))
            for c, b, s in zip(used, found.coef, se)]
    out = spark.createDataFrame(rows, "feature string, term string, label string, coef double, se double")
    left_out = spark.createDataFrame(notes, "term string, reason string")
    if wide_column:
        name = lambda text, c: F.concat(F.lit(text), F.col(c))
        out = out.unionByName(against.select(
            F.lit(wide_column).alias("feature"), name(f"{wide_column} = ", "level").alias("term"),
            F.concat(F.lit(f"{wide_column}: "), "level", F.lit(f" vs {first}")).alias("label"), "coef", "se"))
        left_out = left_out.unionByName(gone.select(name(f"{wide_column} = ", "level").alias("term"), "reason"))
    return _wald(out), left_out


def driver_impact(importance: DataFrame, mean_abs: DataFrame, odds: DataFrame, tests: DataFrame
                  ) -> DataFrame:
    """Everything known about each feature: rank, contribution, strongest odds ratio, test."""
    strongest = odds.groupBy("feature").agg(F.max_by(F.struct(
        "odds_ratio", "ci_lower", "ci_upper", "label"), F.abs("coef")).alias("_o"))
    t = tests.select(F.col("variable").alias("feature"), F.col("test").alias("test_name"),
                     "p_adjusted", "significant")
    return (importance.join(mean_abs, "feature", "left").join(strongest, "feature", "left")
            .join(t, "feature", "left").select(
        "feature", F.col("rank").alias("permutation_rank"),
        F.col("importance_mean").alias("permutation_importance"), "mean_abs",
        "_o.odds_ratio", F.col("_o.ci_lower").alias("or_ci_lower"),
        F.col("_o.ci_upper").alias("or_ci_upper"), F.col("_o.label").alias("or_label"),
        "test_name", "p_adjusted", "significant"))


def forest_rows(odds: DataFrame, limit: int = FOREST_ROWS) -> DataFrame:
    """Terms with a complete interval, strongest evidence first, with whisker lengths."""
    ok = (F.col("odds_ratio") > 0) & (F.col("ci_lower") > 0) & F.col("ci_upper").isNotNull()
    return (odds.where(ok).orderBy(F.coalesce("p_value", F.lit(1.0)), "label").limit(limit)
            .select("label", "odds_ratio", "ci_lower", "ci_upper", "p_value",
                    (F.col("odds_ratio") - F.col("ci_lower")).alias("whisker_low"),
                    (F.col("ci_upper") - F.col("odds_ratio")).alias("whisker_high")))


def four_digits(x: Column) -> Column:
    """Number with four significant digits, without trailing zeros."""
    size = F.abs(x)
    shown = F.lit(None).cast("string")
    for power in range(-4, 4):
        text = F.bround(x, 3 - power).cast("decimal(30,8)").cast("string")
        shown = F.when(size >= F.lit(10.0 ** power), text).otherwise(shown)
    shown = F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    sci = F.regexp_replace(F.regexp_replace(F.format_string("%.3e", x), r"(\.\d*?)0+e", "$1e"),
                           r"\.e", "e")
    return F.when(x == 0, "0").when((size >= 9999.5) | (size < 1e-4), sci).otherwise(shown)


def top_reasons(fitted: Fitted, reasons: int = TOP_REASONS) -> Column:
    """The strongest upward contributions as text, from `contributions` and the feature values."""
    items = []
    for i, f in enumerate([*fitted.numeric, *fitted.categorical]):
        c = F.get("contributions", F.lit(i))
        if f in fitted.numeric:
            value, sep = F.coalesce(four_digits(col(f).cast("double")), F.lit("missing")), " = "
        else:
            value, sep = F.coalesce(col(f).cast("string"), F.lit("missing")), ": "
        text = F.concat(F.lit(f + sep), value, F.lit(" ("), F.format_string("%+.2f", c), F.lit(")"))
        items.append(F.struct((-c).alias("o"), F.lit(i).alias("i"), text.alias("t")))
    ranked = F.slice(F.sort_array(F.array(*items)), 1, reasons)
    return F.transform(ranked, lambda r: r["t"])


def score_customers(explained: DataFrame, fitted: Fitted, id_column: str, y: str, raw: str,
                    calibrated: str | None = None, high: float = 0.6, medium: float = 0.3
                    ) -> DataFrame:
    """customer_id, probabilities, band, outcome and the three reasons of the raw model."""
    p = col(calibrated or raw)
    return explained.select(
        col(id_column).cast("string").alias("customer_id"),
        half_even(p, 3).alias("churn_probability"), half_even(col(raw), 3)
        .alias("churn_probability_raw"), risk_band(p, high, medium).alias("risk_band"),
        col(y).cast("int").alias("actual_churn"), top_reasons(fitted).alias("reasons"))


def band_counts(predictions: DataFrame) -> DataFrame:
    """Customers per band, all three bands present."""
    bands = F.broadcast(predictions.sparkSession.createDataFrame(
        [("High",), ("Medium",), ("Low",)], "risk_band string"))
    counts = predictions.groupBy("risk_band").agg(F.count("*").alias("n"))
    return bands.join(counts, "risk_band", "left").select("risk_band",
                                                          F.coalesce("n", F.lit(0)).alias("n"))
