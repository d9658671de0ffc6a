"""Model metrics from scores: exact rank statistics, lift, calibration bins and curves.

All inputs are long: one row per (kind, row), with a 0/1 outcome and a score. Metrics of several
score kinds (raw, calibrated) are computed together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwell.functions.ordered import (evenly_spaced, numbered, previous_values, running_sums,
                                        value_counts)
from keepwell.functions.scalar import col, ratio
from keepwell.functions.stored import stored

# Top share, bins, deciles, curve sizes, classification threshold.
TOP_SHARE = 0.10
BINS = 10
DECILES = 10
ROC_POINTS = 100
PR_POINTS = 100
THRESHOLD = 0.5
KIND = "kind"


def long_scores(df: DataFrame, y: str, scores: dict[str, str], row_id: str) -> DataFrame:
    """kind, row_id, y, p for every score column."""
    pairs = F.array(*[F.struct(F.lit(k).alias(KIND), col(c).cast("double").alias("p"))
                      for k, c in scores.items()])
    return (df.select(col(row_id).alias("row_id"), col(y).cast("int").alias("y"),
                      F.explode(pairs).alias("_s"))
            .select("_s.kind", "row_id", "y", "_s.p"))


def score_table(long: DataFrame) -> DataFrame:
    """Distinct scores with their outcomes: the input of every rank metric."""
    return value_counts(long, [KIND], "p", {"n": F.count("*"), "pos": F.sum("y").cast("long")})


def roc_auc(long: DataFrame) -> DataFrame:
    ran = running_sums(score_table(long), [KIND], "p", {"upto": "n"})
    mid = F.col("upto") - (F.col("n") - 1) / 2.0
    g = ran.groupBy(KIND).agg(F.sum(F.col("pos") * mid).alias("r"), F.sum("pos").alias("a"),
                              F.sum(F.col("n") - F.col("pos")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return g.select(KIND, ratio(F.col("r") - a * (a + 1) / 2, a * b).alias("roc_auc"))


def pr_auc(long: DataFrame) -> DataFrame:
    """Average precision: each distinct score adds its share of the positives times the
    precision at that score."""
    ran = running_sums(score_table(long), [KIND], "p", {"tp": "pos", "seen": "n"},
                       descending=True)
    g = ran.groupBy(KIND).agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("s"),
                              F.sum("pos").alias("a"))
    return g.select(KIND, ratio(F.col("s"), F.col("a")).alias("pr_auc"))


def brier(long: DataFrame) -> DataFrame:
    return long.groupBy(KIND).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def rank_groups(long: DataFrame, ends: Callable[[int], Sequence[int]]) -> DataFrame:
    """Outcomes per block of ranks (score descending, ties by row number).

    `ends(n)` gives the last rank of each block. Scores wholly inside a block are added from
    their counts; only scores that straddle a block end are split by row number."""
    table = running_sums(score_table(long), [KIND], "p", {"stop": "n"}, descending=True).withColumn("start", F.col("stop") - F.col("n"))
    blocks = _blocks(long, ends)
    inside = (table.join(blocks, KIND)
              .where((F.col("start") >= F.col("low")) & (F.col("stop") <= F.col("high")))
              .select(KIND, "g", "n", "pos"))
    cut = (table.join(blocks, KIND)
           .where((F.col("start") < F.col("high")) & (F.col("stop") > F.col("high")))
           .select(KIND, "p", "start").distinct())
    tied = long.join(F.broadcast(cut), [KIND, "p"])  # at most one score per block end
    placed = numbered(tied, [KIND, "p"], "row_id", "_k")
    rank = F.col("start") + F.col("_k")
    split = (placed.join(blocks, KIND)
             .where((rank > F.col("low")) & (rank <= F.col("high")))
             .select(KIND, "g", F.lit(1).cast("long").alias("n"), F.col("y").cast("long").alias("pos")))
    sums = inside.unionByName(split).groupBy(KIND, "g").agg(F.sum("n").alias("n"),
                                                            F.sum("pos").alias("churners"))
    return _with_empty(blocks, sums)


def _blocks(long: DataFrame, ends: Callable[[int], Sequence[int]]) -> DataFrame:
    rows = []
    for r in long.groupBy(KIND).agg(F.count("*").alias("n")).collect():  # one row per kind
        low = 0
        for g, hi in enumerate(ends(r["n"]), start=1):
            rows.append((r[KIND], g, low, hi))
            low = hi
    return F.broadcast(long.sparkSession.createDataFrame(
        rows, f"{KIND} string, g int, low long, high long"))


def _with_empty(blocks: DataFrame, sums: DataFrame) -> DataFrame:
    return blocks.join(sums, [KIND, "g"], "left").select(
        KIND, "g", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("churners", F.lit(0)).alias("churners"))


def at_top(long: DataFrame, share: float = TOP_SHARE) -> DataFrame:
    """Precision and recall among the top ceil(share * n) rows."""
    top = rank_groups(long, lambda n: [-int(-(share * n) // 1)])
    total = F.broadcast(long.groupBy(KIND).agg(F.sum("y").alias("_pos")))
    return top.join(total, KIND).select(
        KIND, F.col("n").alias("k"), F.col("churners").alias("churners_in_top"),
        ratio(F.col("churners"), F.col("n")).alias("precision"),
        ratio(F.col("churners"), F.col("_pos")).alias("recall"))


def _even_split(n: int, parts: int = DECILES) -> list[int]:
    ends, at = [], 0
    for i in range(parts):
        at += n // parts + (1 if i < n % parts else 0)
        ends.append(at)
    return ends


def deciles(long: DataFrame) -> DataFrame:
    """Lift and cumulative gains by score decile (1 = highest)."""
    d = rank_groups(long, _even_split).withColumnRenamed("g", "decile")
    # Ten rows per kind from here on.
    w = Window.partitionBy(KIND).orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(KIND)
    total, pos = F.sum("n").over(every), F.sum("churners").over(every)
    rate = ratio(F.col("churners"), F.col("n"))
    return d.select(KIND, "decile", "n", "churners", rate.alias("churn_rate"),
                    ratio(rate, pos / total).alias("lift"),
                    ratio(F.sum("churners").over(w), pos).alias("cumulative_gain"),
                    ratio(F.sum("n").over(w), total).alias("cumulative_share"))


def bin_edges() -> list[float]:
    return [i * (1.0 / BINS) for i in range(BINS)] + [1.0]


def calibration_bins(long: DataFrame) -> DataFrame:
    """Ten right-closed probability bins, empty ones included."""
    edges = bin_edges()
    b = sum(((F.col("p") > e).cast("int") for e in edges[2:-1]),
            (F.col("p") > edges[1]).cast("int")) + 1
    sums = long.withColumn("bin", b).groupBy(KIND, "bin").agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_predicted"),
        F.avg("y").alias("observed_rate"))
    grid = F.broadcast(long.sparkSession.createDataFrame(
        [(i + 1, edges[i], edges[i + 1]) for i in range(BINS)], "bin int, low double, high double"))
    kinds = long.select(KIND).distinct()
    return kinds.crossJoin(grid).join(sums, [KIND, "bin"], "left").select(
        KIND, "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted",
        "observed_rate")


def roc_points(long: DataFrame, points: int = ROC_POINTS) -> DataFrame:
    """Corners of the ROC curve, thinned to evenly spaced points."""
    t = score_table(long).withColumn("neg", F.col("n") - F.col("pos"))
    ran = running_sums(t, [KIND], "p", {"tp": "pos", "fp": "neg"}, descending=True)
    # Ascending predecessors are the next points of the descending curve.
    nxt = previous_values(ran, [KIND], ["p"], {"_pos": "pos", "_neg": "neg"})
    corner = F.col("_pos").isNull() | ~(F.col("_pos").eqNullSafe(F.col("pos"))
                                        & F.col("_neg").eqNullSafe(F.col("neg")))
    kept = nxt.where(corner).select(KIND, (-F.col("p")).alias("_o"), "tp", "fp")
    start = long.select(KIND).distinct().select(
        KIND, F.lit(float("-inf")).alias("_o"), F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"))
    return _thin(kept.unionByName(start), points,
                 lambda tot: {"fpr": ratio(F.col("fp"), tot["fp"]),
                              "tpr": ratio(F.col("tp"), tot["tp"])}, ("tp", "fp"))


def _thin(curve: DataFrame, points: int, rates, totals) -> DataFrame:
    placed = numbered(curve, [KIND], "_o", "_at")
    size = F.broadcast(placed.groupBy(KIND).agg(
        F.count("*").alias("_len"), *[F.max(t).alias(f"_max_{t}") for t in totals]))
    joined = placed.join(size, KIND)
    named = rates({t: F.col(f"_max_{t}") for t in totals})
    out = evenly_spaced(joined, [KIND], "_at", F.col("_len"), points)
    return out.select(KIND, F.col("_at").alias("point"), *[e.alias(n) for n, e in named.items()])


def pr_points(long: DataFrame, points: int = PR_POINTS) -> DataFrame:
    """Precision-recall curve from the lowest threshold up, closed at (recall 0, precision 1)."""
    ran = running_sums(score_table(long), [KIND], "p", {"tp": "pos", "seen": "n"},
                       descending=True).select(
        KIND, F.col("p").alias("_o"), "tp", "seen")
    close = long.select(KIND).distinct().select(
        KIND, F.lit(float("inf")).alias("_o"), F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("seen"))
    return _thin(ran.unionByName(close), points, lambda tot: {
        "recall": ratio(F.col("tp"), tot["tp"]),
        "precision": F.coalesce(ratio(F.col("tp"), F.col("seen")), F.lit(1.0))}, ("tp",))


def threshold_metrics(long: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    g = long.groupBy(KIND).agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return g.select(KIND, "tp", "fp", "fn", "tn",
                    ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
                    F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
                    F.coalesce(ratio(tp, tp + fn), zero).alias("recall"),
                    F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero).alias("f1"))


def evaluate(long: DataFrame) -> DataFrame:
    """Headline metrics per score kind. The scores are written once: models do not score again for every metric."""
    long = stored(long)
    size = long.groupBy(KIND).agg(F.count("*").alias("n"), F.avg("y").alias("churn_rate"))
    out = size
    for part in (roc_auc(long), pr_auc(long), brier(long)):
        out = out.join(F.broadcast(part), KIND)
    return out


def split_overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Rows present in both splits; must be empty."""
    return test.join(train.select(key), key, "left_semi").agg(F.count("*").alias("overlap"))
