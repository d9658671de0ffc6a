"""Segments: scaled features, k-means over several k and starts, silhouette, profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions.quantiles import quantiles
from keepwell.functions.scalar import col, no_nan, ratio
from keepwell.functions.stored import stored
from keepwell.operators.describe import varying

# Seed, range of k, starts, fewest features, label length.
SEED = 42
K_RANGE = range(2, 9)
STARTS = 10
SAMPLE = 10_000  # rows that starting centres are drawn from, about
TOLERANCE = 1e-4  # a start rests once its centres move less
MIN_FEATURES = 2
LABEL_FEATURES = 2


def segment_features(df: DataFrame, numeric: Sequence[str], time: str | None = None) -> list[str]:
    """Numeric columns that vary, without the time column."""
    names = [c for c in numeric if c != time]
    return varying(df, names) if names else []


@dataclass(frozen=True)
class Scale:
    median: float
    mean: float
    sd: float


def scales(df: DataFrame, features: Sequence[str]) -> dict[str, Scale]:
    """Median, and mean and population sd after median filling (three numbers per feature)."""
    med = {r["variable"]: r["q"][0] for r in
           quantiles(df, features, [0.5]).collect()}
    aggs = []
    for i, f in enumerate(features):
        v = F.coalesce(no_nan(col(f).cast("double")), F.lit(float(med[f])))
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {f: Scale(float(med[f]), row[f"m{i}"], row[f"s{i}"] or 1.0)
            for i, f in enumerate(features)}


def filled(f: str, s: Scale) -> Column:
    return F.coalesce(no_nan(col(f).cast("double")), F.lit(s.median))


def impute_and_scale(df: DataFrame, features: Sequence[str], fitted: dict[str, Scale]
                     ) -> DataFrame:
    return df.withColumns({f"{f}_z": (filled(f, fitted[f]) - fitted[f].mean) / fitted[f].sd
                           for f in features})


def silhouettes(df: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Mean silhouette of each label column over all rows, in squared Euclidean distances.

    The mean squared distance of a row to a cluster follows from the cluster's size, sum and sum of
    squares, so two passes score every label column, whatever their number, and no pairs are made.
    Label columns with fewer than two clusters have no row."""
    square = sum((col(f) * col(f) for f in features), F.lit(0.0))
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), col(c).cast("int").alias("cluster")) for c in labels])
    sums = (df.select(F.explode(pairs).alias("_p"), square.alias("_q"), *map(col, features))
            .groupBy("_p.label", "_p.cluster").agg(
                F.count("*").alias("n"), F.sum("_q").alias("q"),
                *[F.sum(col(f)).alias(f"s{i}") for i, f in enumerate(features)]))
    clusters: dict[str, list] = {}
    for r in sums.where("cluster is not null").collect():  # one row per label column and cluster
        clusters.setdefault(r["label"], []).append(r)

    def width(label: str) -> Column:
        own = col(label).cast("int")
        inside, outside, alone = F.lit(None).cast("double"), [], F.lit(False)
        for r in clusters[label]:
            n, here = r["n"], own == r["cluster"]
            dot = sum((col(f) * (r[f"s{i}"] / n) for i, f in enumerate(features)), F.lit(0.0))
            mean = F.greatest(F.lit(0.0), square + r["q"] / n - 2 * dot)
            inside = F.when(here, mean * n / max(n - 1, 1)).otherwise(inside)
            outside.append(F.when(~here, mean))
            alone = alone | (here & F.lit(n == 1))
        other = F.array_min(F.array(*outside))
        return F.when(own.isNull(), None).when(alone, 0.0).otherwise(
            (other - inside) / F.greatest(inside, other, F.lit(1e-300)))

    usable = [c for c in labels if len(clusters.get(c, ())) > 1]
    if not usable:
        return df.sparkSession.createDataFrame([], "label string, silhouette double, n long")
    row = df.agg(*[f(width(c)).alias(f"{k}{i}") for i, c in enumerate(usable)
                   for k, f in (("m", F.avg), ("n", F.count))])
    each = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"m{i}").alias("silhouette"),
                              F.col(f"n{i}").alias("n")) for i, c in enumerate(usable)])
    return row.select(F.explode(each).alias("r")).select("r.*")


def select_k(scores: dict[int, float]) -> int | None:
    """Highest silhouette, ties to the smaller k."""
    return min(scores, key=lambda k: (-scores[k], k)) if scores else None


def spread_centres(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k starting centres, each drawn by its squared distance to those before it."""
    centres = [rows[rng.integers(len(rows))]]
    far = ((rows - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = far.sum()
        at = rng.integers(len(rows)) if total <= 0 else min(int(np.searchsorted(np.cumsum(far), rng.random() * total)), len(rows) - 1)
        centres.append(rows[at])
        far = np.minimum(far, ((rows - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy() for i in range(width)]).reshape(-1, width)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance) of every row."""
    far = (centres ** 2).sum(axis=1) - 2 * (rows @ centres.T)
    at = far.argmin(axis=1)
    return at, np.maximum(far[np.arange(len(rows)), at] + (rows ** 2).sum(axis=1), 0.0)


def _step(models: dict[int, np.ndarray], width: int):
    """Per task, model and cluster: size, squared distances and sum of the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: np.zeros((len(c), width + 2)) for m, c in models.items()}
        for batch in batches:
            rows = _matrix(batch, width)
            for m, centres in models.items():
                at, far = _nearest(rows, centres)
                sums[m][:, 0] += np.bincount(at, minlength=len(centres))
                sums[m][:, 1] += np.bincount(at, far, len(centres))
                for d in range(width):
                    sums[m][:, d + 2] += np.bincount(at, rows[:, d], len(centres))
        flat = [(m, k, row) for m, table in sums.items() for k, row in enumerate(table) if row[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.int32()),
             *[pa.array([f[2][i] for f in flat], pa.float64()) for i in range(width + 2)]],
            names=["model", "cluster", "n", "cost", *[f"s{d}" for d in range(width)]])

    return run


def lloyd(rows: DataFrame, starts: dict[int, np.ndarray], max_iter: int, tolerance: float = TOLERANCE
          ) -> dict[int, tuple[float, np.ndarray]]:
    """(cost, centres) of every start after its iterations. All starts, whatever their k, share the pass
    over the rows, so the number of jobs is that of the iterations; the driver sees one row per centre.
    Empty clusters keep their centre. The cost is that of the last pass."""
    width = len(rows.columns)
    kind = "model int, cluster int, n double, cost double" + "".join(f", s{d} double" for d in range(width))
    now, rest, cost = dict(starts), set(), {}
    for turn in range(max_iter + 1):  # the last pass only measures
        live = {m: c for m, c in now.items() if m not in rest}
        if not live:
            break
        step = rows.mapInArrow(_step(live, width), kind).groupBy("model", "cluster").agg(
            *[F.sum(c).alias(c) for c in ("n", "cost", *[f"s{d}" for d in range(width)])]).collect()
        for m in live:
            mine = [r for r in step if r["model"] == m]
            cost[m] = sum(r["cost"] for r in mine)
            if turn == max_iter:
                continue
            centres = now[m].copy()
            for r in mine:
                centres[r["cluster"]] = [r[f"s{d}"] / r["n"] for d in range(width)]
            if ((centres - now[m]) ** 2).sum(axis=1).max() <= tolerance ** 2:
                rest.add(m)
            now[m] = centres
    return {m: (cost.get(m, math.inf), now[m]) for m in starts}


def clusters(df: DataFrame, columns: Sequence[str], models: dict[str, np.ndarray]) -> DataFrame:
    """df with the nearest centre of every model {new column: centres}, in one pass."""
    wanted = list(models)
    out = df
    for name in wanted:
        far = F.array(*[F.struct(sum(((col(c) - F.lit(float(x))) * (col(c) - F.lit(float(x))) for c, x in zip(columns, centre)),
                                     F.lit(0.0)).alias("d"), F.lit(k).alias("k")) for k, centre in enumerate(models[name])])
        out = out.withColumn(name, F.array_min(far)["k"])
    return out


@dataclass
class Segmentation:
    frame: DataFrame | None
    k: int | None
    scores: dict[int, float]
    features: list[str]
    skipped: str | None = None


def segment(df: DataFrame, numeric: Sequence[str], id_column: str, time: str | None = None, *,
            ks: Sequence[int] = tuple(K_RANGE), starts: int = STARTS, max_iter: int = 20) -> Segmentation:
    """k-means for every k and start on the scaled features, all in the same passes; the start of least
    cost per k is scored by silhouette. Starting centres come from a hash sample of about SAMPLE rows.
    Adds `segment` to the frame."""
    features = segment_features(df, numeric, time)
    if len(features) < MIN_FEATURES:
        return Segmentation(None, None, {}, features,
                            f"Segmentation needs at least {MIN_FEATURES} varying numeric features "
                            f"(found {len(features)}).")
    fit = scales(df, features)
    z = [f"{f}_z" for f in features]
    scaled = impute_and_scale(df, features, fit)
    rows = stored(scaled.select(col(id_column).alias("_id"), *z))
    total = rows.count()
    part = F.pmod(F.xxhash64(F.lit("start"), "_id"), F.lit(1 << 40)) < int(2 ** 40 * min(1.0, SAMPLE / max(total, 1)))
    sample = rows.where(part).orderBy(F.xxhash64("_id"), *z).select(*z).toPandas().to_numpy(float)
    ks = [k for k in ks if k < total and k <= len(sample)]
    begin = {k * 1000 + s: spread_centres(sample, k, np.random.default_rng((SEED, k, s))) for k in ks for s in range(starts)}
    done = lloyd(rows.select(*z), begin, max_iter)
    best = {k: min((done[m] for m in done if m // 1000 == k), key=lambda r: r[0])[1] for k in ks}
    marked = clusters(rows, z, {f"k{k}": c for k, c in best.items()})
    scores = {int(r["label"][1:]): r["silhouette"] for r in silhouettes(marked, z, [f"k{k}" for k in ks]).collect()}
    k = select_k(scores)
    if k is None:
        return Segmentation(None, None, scores, features, "Clustering found no separable groups.")
    kept = [col(c) for c in df.columns if c != "segment"]
    out = clusters(scaled, z, {"_cluster": best[k]}).select(*kept, F.col("_cluster").alias("segment"))
    return Segmentation(out, k, scores, features)


def segment_profile(df: DataFrame, segment_column: str, features: Sequence[str], y: str,
                    fitted: dict[str, Scale]) -> DataFrame:
    """Size, churn rate, lift, feature means and z against the whole base, with a label made of
    the two features that differ most."""
    g = df.groupBy(col(segment_column).alias("segment")).agg(
        F.count("*").alias("size"), F.avg(col(y)).alias("churn_rate"),
        *[F.avg(filled(f, fitted[f])).alias(f"mean_{f}") for f in features])
    total = F.broadcast(df.agg(F.count("*").alias("_n"), F.avg(col(y)).alias("_rate")))
    z = {f: (col(f"mean_{f}") - fitted[f].mean) / fitted[f].sd for f in features}
    g = g.crossJoin(total).withColumns({f"z_{f}": e for f, e in z.items()})
    ranked = F.sort_array(F.array(*[F.struct(
        (-F.abs(col(f"z_{f}"))).alias("o"), F.lit(f).alias("f"),
        F.when(col(f"z_{f}") > 0, "High ").otherwise("Low ").alias("w")) for f in features]))
    label = F.array_join(F.transform(F.slice(ranked, 1, LABEL_FEATURES),
                                     lambda t: F.concat(t["w"], t["f"])), ", ")
    return g.select("segment", label.alias("label"), "size", (F.col("size") / F.col("_n"))
                    .alias("share"), "churn_rate",
                    ratio(F.col("churn_rate"), F.col("_rate")).alias("lift"),
                    *[f"mean_{f}" for f in features], *[f"z_{f}" for f in features])
