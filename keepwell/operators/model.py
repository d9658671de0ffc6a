"""Churn models: hash split, feature pipeline, two learners, selection, calibration."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepwell.functions.quantiles import quantiles
from keepwell.functions.scalar import col, hash_unit
from keepwell.functions.stored import stored
from keepwell.operators import metrics
from keepwell.operators.describe import correlation_with_target
from keepwell.operators.isotonic import interpolated, isotonic
from keepwell.operators.segment import Scale, scales
from keepwell.operators.survival import association, level_counts

# Seed, test share, folds, leakage limits, shuffles, inverse penalty.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
LEAK_AUC = 0.99
LEAK_R = 0.9
REPEATS = 10
C = 1.0
LEARNERS = ("logistic", "boosting")
GROUP_ROWS = 2000
BASE = "\t"  # the score without a swap, among features
JOBS = 5  # folds fitted at the same time
ROWS_A_TASK = 250_000  # rows that a task of a learner's pass reads, about


class LeakageError(ValueError):
    """The test score is too good to be true."""


def stratified_split(df: DataFrame, y: str, id_column: str, share: float = TEST_SHARE,
                     seed: int = SEED) -> DataFrame:
    """Adds `is_test`: the rows of each class whose hash lies below the exact quantile of the
    class. Two numbers reach the driver; rows stay where they are."""
    u = hash_unit(F.lit(f"split{seed}"), col(id_column))
    drawn = df.withColumn("_u", u)
    cuts = {r[y]: r["q"][0] for r in
            quantiles(drawn.select(y, "_u"), ["_u"], [share], [y]).collect()}
    cut = F.lit(None).cast("double")
    for value, q in cuts.items():
        cut = F.when(col(y) == value, F.lit(q)).otherwise(cut)
    return drawn.withColumn("is_test", F.col("_u") < cut).drop("_u")


def fold_column(id_column: str, folds: int = FOLDS, seed: int = SEED) -> Column:
    return F.floor(hash_unit(F.lit(f"fold{seed}"), col(id_column)) * folds).cast("int")


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """n / (2 n_class) per class."""
    g = df.groupBy(col(y).alias("y")).agg(F.count("*").alias("n"))
    total = F.broadcast(g.agg(F.sum("n").alias("_n")))
    return g.crossJoin(total).select("y", "n", (F.col("_n") / (2 * F.col("n"))).alias("weight"))


@dataclass
class Fitted:
    model: PipelineModel
    learner: str
    numeric: list[str]
    categorical: list[str]
    scales: dict[str, Scale]
    levels: dict[str, list[str]]


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent level per column, ties to the first in order."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v"))
                      for c in columns])
    counts = (df.select(F.explode(pairs).alias("p")).where("p.v is not null")
              .groupBy("p.c", "p.v").agg(F.count("*").alias("n")))
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("o"), "v")).alias("b"))
    return {r["c"]: r["b"]["v"] for r in best.collect()}


def feature_pipeline(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
                     ) -> tuple[list, dict[str, Scale]]:
    """Unfitted stages: median and mode filling with population scaling (as constants of one SQL
    stage), one-hot levels (unknown ones are zeros), one vector."""
    fit = scales(df, numeric) if numeric else {}
    modes = _modes(df, categorical)
    parts = [f"(coalesce(nanvl(cast({_quote(c)} as double), null), {s.median!r}D) - ({s.mean!r}D))"
             f" / {s.sd!r}D AS {_quote('_z_' + c)}" for c, s in fit.items()]
    parts += [f"coalesce(cast({_quote(c)} as string), {_text(modes.get(c, ''))}) AS "
              f"{_quote('_w_' + c)}" for c in categorical]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")]
    if categorical:
        stages += [StringIndexer(inputCols=[f"_w_{c}" for c in categorical],
                                 outputCols=[f"_i_{c}" for c in categorical],
                                 handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical],
                                 outputCols=[f"_o_{c}" for c in categorical], dropLast=False,
                                 handleInvalid="keep")]
    stages.append(VectorAssembler(inputCols=[f"_z_{c}" for c in numeric]
                                  + [f"_o_{c}" for c in categorical], outputCol="_features"))
    return stages, fit


def fit(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str, *,
        learner: str = "logistic", balanced: bool = True, trees: int = 50) -> Fitted:
    """Fill, scale, encode and learn on this frame only. The encoded rows are written once: a learner passes over
    them many times, and what its tasks send to the driver grows with their number, so that follows the rows."""
    counts = {r["y"]: r["n"] for r in class_weights(df, y).collect()}
    n = sum(counts.values())
    stages, scale = feature_pipeline(df, numeric, categorical)
    weight = F.lit(1.0)
    if balanced and len(counts) == 2:
        weight = F.when(col(y) == 1, F.lit(n / (2 * counts[1]))).otherwise(
            F.lit(n / (2 * counts[0])))
    train = df.withColumns({"_weight": weight, "_label": col(y).cast("double")})
    common = {"featuresCol": "_features", "labelCol": "_label", "weightCol": "_weight",
              "predictionCol": "_prediction", "probabilityCol": "_probability",
              "rawPredictionCol": "_raw"}
    if learner == "logistic":
        learning = LogisticRegression(maxIter=2000, elasticNetParam=0.0, regParam=1.0 / (C * n),
                                      standardization=False, tol=1e-6, **common)
    elif learner == "boosting":
        learning = GBTClassifier(maxIter=trees, maxDepth=5, stepSize=0.1, seed=SEED,
                                 featuresCol="_features", labelCol="_label",
                                 predictionCol="_prediction", weightCol="_weight")
        learning.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    else:
        raise ValueError(f"unknown learner '{learner}'")
    shaped = Pipeline(stages=stages).fit(train)
    rows = stored(shaped.transform(train).select("_features", "_label", "_weight"))
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK))
    model = PipelineModel([*shaped.stages, learning.fit(rows.coalesce(tasks))])
    levels: dict[str, list[str]] = {}
    if categorical:
        for c, names in zip(categorical, model.stages[1].labelsArray, strict=True):
            levels[c] = list(names)
    return Fitted(model, learner, list(numeric), list(categorical), scale, levels)


def owners(fitted: Fitted) -> list[tuple[str, int, int]]:
    """(feature, first position, width) of every feature in the model vector. One-hot blocks have
    a place for each level and one for unknown levels."""
    out, at = [], 0
    for c in fitted.numeric:
        out.append((c, at, 1))
        at += 1
    for c in fitted.categorical:
        width = len(fitted.levels[c]) + 1
        out.append((c, at, width))
        at += width
    return out


def transform(fitted: Fitted, df: DataFrame) -> DataFrame:
    return fitted.model.transform(df)


def score(fitted: Fitted, df: DataFrame, name: str = "p") -> DataFrame:
    """The frame with the churn probability of the model."""
    out = transform(fitted, df)
    return out.select(*map(col, df.columns), vector_to_array("_probability")[1].alias(name))


def margin(fitted: Fitted, df: DataFrame, name: str) -> DataFrame:
    """The frame with the model's log-odds (the boosting margin counts double)."""
    out = transform(fitted, df)
    m = vector_to_array("_raw")[1] * (2.0 if fitted.learner == "boosting" else 1.0)
    return out.select(*map(col, df.columns), m.alias(name))


def save(fitted: Fitted, path: str, calibrated: Calibrated | None = None) -> None:
    """The whole model below path: pipeline, names, scales and levels, and the calibrating models with
    their curves or slopes, if given."""
    spark = SparkSession.active()
    fitted.model.write().overwrite().save(f"{path}/pipeline")
    about = {"learner": fitted.learner, "numeric": fitted.numeric, "categorical": fitted.categorical, "levels": fitted.levels,
             "scales": {c: [s.median, s.mean, s.sd] for c, s in fitted.scales.items()}}
    if calibrated is not None:
        about |= {"method": calibrated.method, "folds": len(calibrated.models)}
        for k, (model, cal) in enumerate(zip(calibrated.models, calibrated.calibrators, strict=True)):
            save(model, f"{path}/fold-{k}")
            rows = cal if calibrated.method == "isotonic" else spark.createDataFrame([cal], "slope double, intercept double")
            rows.write.mode("overwrite").parquet(f"{path}/curve-{k}")
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load(path: str) -> Fitted:
    about = _about(path)
    return Fitted(PipelineModel.load(f"{path}/pipeline"), about["learner"], about["numeric"], about["categorical"],
                  {c: Scale(*s) for c, s in about["scales"].items()}, about["levels"])


def load_calibrated(path: str) -> Calibrated | None:
    """The calibrating models that were saved with the model, None if there were none."""
    about, spark = _about(path), SparkSession.active()
    if "method" not in about:
        return None
    curves = [spark.read.parquet(f"{path}/curve-{k}") for k in range(about["folds"])]
    if about["method"] != "isotonic":
        curves = [tuple(c.select("slope", "intercept").first()) for c in curves]
    return Calibrated([load(f"{path}/fold-{k}") for k in range(about["folds"])], curves, about["method"])


def _about(path: str) -> dict:
    return json.loads(SparkSession.active().read.schema("about string").json(f"{path}/about").first()["about"])


def fold_scores(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str,
                id_column: str, learners: Sequence[str] = LEARNERS, *, balanced: bool = True,
                trees: int = 50) -> DataFrame:
    """Held-out scores of every learner and fold: kind 'learner|fold', row_id, y, p."""
    df = stored(df.select(id_column, y, *map(col, [*numeric, *categorical]), fold_column(id_column).alias("_fold")))

    def held_out(task: tuple[str, int]) -> DataFrame:
        learner, k = task
        model = fit(df.where(F.col("_fold") != k), numeric, categorical, y, learner=learner,
                    balanced=balanced, trees=trees)
        return score(model, df.where(F.col("_fold") == k), "p").select(
            F.lit(f"{learner}|{k}").alias("kind"), col(id_column).alias("row_id"),
            col(y).cast("int").alias("y"), "p")

    with ThreadPoolExecutor(JOBS) as pool:
        parts = list(pool.map(held_out, [(name, k) for name in learners for k in range(FOLDS)]))
    return reduce(DataFrame.unionByName, parts)


def cross_validate(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str,
                   id_column: str, learners: Sequence[str] = LEARNERS, *, balanced: bool = True,
                   trees: int = 50) -> DataFrame:
    """Mean and sd over folds of ROC-AUC and average precision per learner."""
    scores = fold_scores(df, numeric, categorical, y, id_column, learners, balanced=balanced,
                         trees=trees)
    m = metrics.roc_auc(scores).join(metrics.pr_auc(scores), "kind")
    return m.groupBy(F.split("kind", r"\|")[0].alias("learner")).agg(
        F.avg("roc_auc").alias("roc_auc_mean"), F.stddev_samp("roc_auc").alias("roc_auc_sd"),
        F.avg("pr_auc").alias("pr_auc_mean"), F.stddev_samp("pr_auc").alias("pr_auc_sd"))


def cross_validated_auc(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str,
                        id_column: str, learner: str, balanced: bool = True) -> float | None:
    row = cross_validate(df, numeric, categorical, y, id_column, [learner],
                         balanced=balanced).first()
    return row["roc_auc_mean"] if row else None


def choose(cv: DataFrame) -> str:
    """Learner with the best mean average precision (one row per learner)."""
    return max(cv.collect(), key=lambda r: (r["pr_auc_mean"], r["learner"]))["learner"]


def check_leakage(auc: float) -> None:
    if auc > LEAK_AUC:
        raise LeakageError(f"Test ROC-AUC is {auc:.3f}, which is too good to be true. A column "
                           "probably records the outcome itself; mark it as an id or remove it.")


def leakage_warnings(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str,
                     limit: float = LEAK_R) -> DataFrame:
    """Features that nearly are the outcome: column, measure, value."""
    out = train.sparkSession.createDataFrame([], "column string, measure string, value double")
    if numeric:
        r = correlation_with_target(train, numeric, y)
        out = out.unionByName(r.where(F.abs("r") > limit).select(
            F.col("feature").alias("column"), F.lit("Pearson r").alias("measure"),
            F.col("r").alias("value")))
    if categorical:
        v = association(level_counts(train, categorical, y))
        out = out.unionByName(v.where(F.col("cramers_v") > limit).select(
            F.col("variable").alias("column"), F.lit("Cramér's V").alias("measure"),
            F.col("cramers_v").alias("value")))
    return out


def _swapped_scores(fitted: Fitted, df: DataFrame) -> tuple[DataFrame, list[Column], Column]:
    """(df with what a row passes on, `_own`; score of every feature with the value of `_next`; own score).
    A linear model passes on one log-odds term per feature, trees the feature vector."""
    blocks, out = owners(fitted), transform(fitted, df)
    learner, keep = fitted.model.stages[-1], [*map(col, df.columns)]
    if fitted.learner == "logistic":
        coef, x = learner.coefficients.toArray(), vector_to_array("_features")
        terms = [F.aggregate(F.zip_with(F.slice(x, at + 1, width), F.array(*[F.lit(float(c)) for c in coef[at:at + width]]),
                                        lambda v, c: F.coalesce(v * c, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
                 for _, at, width in blocks]

        def chance(changed: int | None) -> Column:
            """Terms are added in one order, so that equal rows have equal scores whatever was swapped."""
            m = F.lit(float(learner.intercept))
            for i in range(len(blocks)):
                m = m + F.get("_next" if i == changed else "_own", F.lit(i))
            return 1 / (1 + F.exp(-m))

        return out.select(*keep, F.array(*terms).alias("_own")), [chance(i) for i in range(len(blocks))], chance(None)
    used = set(learner.featureImportances.indices.tolist())
    names = [f"_swap_{i}" for i, (_, at, width) in enumerate(blocks) if used & set(range(at, at + width))]
    scores = [F.col(f"_swap_{i}") if f"_swap_{i}" in names else F.col("_base") for i in range(len(blocks))]
    return out.select(*keep, vector_to_array("_features").alias("_own")), scores, F.col("_base")


def _tree_scores(fitted: Fitted, moved: DataFrame) -> DataFrame:
    """moved with the score of every feature that the trees use, swapped, and of the row as it is."""
    learner = fitted.model.stages[-1].copy()
    learner.setFeaturesCol("_step").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_chance")
    used = set(learner.featureImportances.indices.tolist())
    size = learner.numFeatures
    tried = [("_base", range(0))] + [(f"_swap_{i}", range(at, min(at + width, size))) for i, (_, at, width) in
                                     enumerate(owners(fitted)) if used & set(range(at, at + width))]
    for name, span in tried:
        mine = F.array(*[F.get("_next" if j in span else "_own", F.lit(j)) for j in range(size)])
        moved = learner.transform(moved.withColumn("_step", array_to_vector(mine))).withColumn(
            name, F.get(vector_to_array("_chance"), F.lit(1))).drop("_step", "_chance")
    return moved


def permutation_importance(fitted: Fitted, test: DataFrame, y: str, id_column: str,
                           repeats: int = REPEATS) -> DataFrame:
    """ROC-AUC lost when one column is shuffled: mean, sd and rank per feature.

    Rows are dealt into random groups of about 2,000 per repeat and take over the values of the row
    before them in random order, so a shuffle is a small window, not a global sort. A row is shuffled
    once a repeat, as one array, and all features are scored beside each other where it then lies; trees are
    asked only about features that they use."""
    features = [*fitted.numeric, *fitted.categorical]
    groups = max(1, test.count() // GROUP_ROWS)
    rows, scores, own = _swapped_scores(fitted, test.select(id_column, y, *map(col, features)))
    dealt = rows.select(col(id_column).alias("row_id"), col(y).cast("int").alias("y"), "_own", F.explode(
        F.array(*[F.lit(r) for r in range(repeats)])).alias("_r"))
    dealt = dealt.withColumns({
        "_g": F.pmod(F.xxhash64("row_id", F.lit("group"), F.col("_r")), F.lit(groups)),
        "_o": F.xxhash64("row_id", F.lit("order"), F.col("_r"))})
    w = Window.partitionBy("_r", "_g").orderBy("_o", "row_id", "y", "_own")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = dealt.withColumn("_next", F.coalesce(F.lag("_own").over(w), F.last("_own").over(every)))
    if fitted.learner != "logistic":
        moved = _tree_scores(fitted, moved)
    repeat = F.col("_r").cast("string")
    kinds = [F.struct(F.concat_ws("\t", F.lit(f), repeat).alias("kind"), p.alias("p")) for f, p in zip(features, scores)]
    kinds.append(F.struct(F.when(F.col("_r") == 0, BASE).alias("kind"), own.alias("p")))
    long = moved.select("row_id", "y", F.explode(F.array(*kinds)).alias("_s")).select("_s.kind", "row_id", "y", "_s.p")
    auc = stored(metrics.roc_auc(long.where("kind IS NOT NULL")))  # one row per feature and repeat
    base = F.broadcast(auc.where(F.col("kind") == BASE).select(F.col("roc_auc").alias("_base")))
    loss = auc.where(F.col("kind") != BASE).crossJoin(base).select(
        F.split("kind", "\t")[0].alias("feature"), (F.col("_base") - F.col("roc_auc")).alias("loss"))
    out = loss.groupBy("feature").agg(F.avg("loss").alias("importance_mean"),
                                      F.stddev_pop("loss").alias("importance_sd"))
    place = F.row_number().over(Window.orderBy(F.desc("importance_mean"), "feature"))
    return out.withColumn("rank", place)  # one row per feature


@dataclass
class Calibrated:
    models: list[Fitted]
    calibrators: list
    method: str


def calibrate(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str,
              id_column: str, *, learner: str = "logistic", trees: int = 50,
              method: str = "isotonic") -> Calibrated:
    """Five (model, calibrator) pairs: each model learns on four folds, its calibrator on the
    scores of the fifth (method: isotonic, or Platt's sigmoid)."""
    if method not in ("isotonic", "sigmoid"):
        raise ValueError(f"unknown calibration method '{method}'")
    df = stored(train.withColumn("_fold", fold_column(id_column)))

    def pair(k: int):
        model = fit(df.where(F.col("_fold") != k), numeric, categorical, y, learner=learner,
                    trees=trees)
        held = margin(model, df.where(F.col("_fold") == k), "_m").select(
            "_m", col(y).cast("double").alias("_y"))
        return model, isotonic(held, "_m", "_y") if method == "isotonic" else _sigmoid(held)

    with ThreadPoolExecutor(JOBS) as pool:
        pairs = list(pool.map(pair, range(FOLDS)))
    return Calibrated([p[0] for p in pairs], [p[1] for p in pairs], method)


def _sigmoid(held: DataFrame) -> tuple[float, float]:
    """Slope and intercept on Platt's softened targets, as two weighted rows per score."""
    n = {r["_y"]: r["n"] for r in held.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1.0, 0), n.get(0.0, 0)
    t = F.when(F.col("_y") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    rows = held.withColumn("_t", t).select("_m", F.explode(F.array(
        F.struct(F.lit(1.0).alias("l"), F.col("_t").alias("w")),
        F.struct(F.lit(0.0).alias("l"), (1 - F.col("_t")).alias("w")))).alias("r"))
    vec = VectorAssembler(inputCols=["_m"], outputCol="_v").transform(rows.select("_m", "r.*"))
    lr = LogisticRegression(featuresCol="_v", labelCol="l", weightCol="w", maxIter=200,
                            standardization=False).fit(vec)
    return float(lr.coefficients[0]), float(lr.intercept)


def score_calibrated(c: Calibrated, df: DataFrame, name: str = "p_calibrated") -> DataFrame:
    """Mean of the five calibrated probabilities."""
    out, parts = df, []
    for i, (model, cal) in enumerate(zip(c.models, c.calibrators, strict=True)):
        out = margin(model, out, "_m")
        if c.method == "isotonic":
            out = interpolated(out, "_m", cal, f"_c{i}").drop("_m")
        else:
            a, b = cal
            out = out.withColumn(f"_c{i}", 1 / (1 + F.exp(-(a * F.col("_m") + b)))).drop("_m")
        parts.append(F.col(f"_c{i}"))
    mean = sum(parts[1:], parts[0]) / len(parts)
    return out.select(*map(col, df.columns), mean.alias(name))


@dataclass
class Trained:
    fitted: Fitted
    calibrated: Calibrated
    cv: DataFrame
    frame: DataFrame
    metrics: DataFrame


def train_and_evaluate(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str,
                       id_column: str, *, learners: Sequence[str] = LEARNERS, trees: int = 50
                       ) -> Trained:
    """Split, select by cross-validation on the training part, fit, check for leakage, calibrate,
    and evaluate raw and calibrated scores once on the test part."""
    if not [*numeric, *categorical]:
        raise ValueError("No usable feature columns for the model.")
    keep = df.select(id_column, y, *map(col, [*numeric, *categorical]))
    both = stored(stratified_split(keep, y, id_column))
    train = both.where(~F.col("is_test"))
    cv = cross_validate(train, numeric, categorical, y, id_column, learners, trees=trees)
    best = choose(cv)
    fitted = fit(train, numeric, categorical, y, learner=best, trees=trees)
    calibrated = calibrate(train, numeric, categorical, y, id_column, learner=best, trees=trees)
    scored = score_calibrated(calibrated, score(fitted, both, "p_raw"), "p_calibrated")
    long = metrics.long_scores(scored.where("is_test"), y,
                               {"raw": "p_raw", "calibrated": "p_calibrated"}, id_column)
    result = metrics.evaluate(long)
    auc = {r["kind"]: r["roc_auc"] for r in result.collect()}
    check_leakage(auc["raw"] or 0.0)
    return Trained(fitted, calibrated, cv, scored, result)
