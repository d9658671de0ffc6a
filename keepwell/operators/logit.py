"""Unpenalised logistic regression with one column of any number of levels.

Every level of the absorbed column has an intercept of its own, so their block of the information matrix
is diagonal. A Newton step therefore needs no solver over levels: each level gives its weight, its weighted
means of the other terms and its residual; what is left (the Schur complement) is a matrix over the other
terms only, summed over levels where they lie. Level intercepts stay a table; the driver sees one row per
other term. A task adds up its own rows first, so a level that holds most rows meets as one row a batch.

Defined cases: rows with a null outcome or term are left out; without rows, no step is made; terms that
the levels or earlier terms explain are left out before the first step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions.stored import stored

STEPS, TOLERANCE = 60, 1e-8  # Newton steps at most; largest change of a coefficient at the end
RUNAWAY = 20.0  # log-odds beyond which a coefficient has no finite value
RANK_LOSS = 1e-9  # share of a term's variance that must be left beside levels and earlier terms
_KIND = "level string, i int, a double, d double, g double, v array<double>"


@dataclass
class LogitFit:
    """coef, se: of the terms kept (their positions); levels: level, a (intercept), d (weight), g (residual), v
    (weighted sums of the terms); inverse: of the Schur complement."""
    kept: list[int]
    coef: np.ndarray
    inverse: np.ndarray
    levels: DataFrame


def _batch(level, i, a, d, g, v: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(0, v.size + 1, v.shape[1]) if v.shape[1] else np.zeros(len(v) + 1)
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v.ravel()))
    return pa.RecordBatch.from_arrays(
        [pa.array(level, pa.string()), pa.array(i, pa.int32()), pa.array(a, pa.float64()), pa.array(d, pa.float64()),
         pa.array(g, pa.float64()), lists], names=["level", "i", "a", "d", "g", "v"])


def _matrix(lists: pa.Array, k: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), k)


def _rows_of(matrix: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    n = len(matrix)
    return _batch([None] * n, np.arange(n), np.zeros(n), np.zeros(n), right, matrix)


def _information(beta: np.ndarray):
    """Sums of a task: per level of a batch, and one row per term of the terms' own block."""
    k = len(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, right = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, a, y = _matrix(batch.column("x"), k), *(batch.column(c).to_numpy() for c in ("a", "y"))
            p = 1 / (1 + np.exp(-np.clip(a + x @ beta, -500, 500)))
            w, r = np.maximum(p * (1 - p), 1e-12), y - p
            own += (x * w[:, None]).T @ x
            right += x.T @ r
            names = batch.column("level").dictionary_encode()
            at, n = names.indices.to_numpy(), len(names.dictionary)
            first = np.zeros(n)
            first[at] = a
            v = np.zeros((n, k))
            np.add.at(v, at, x * w[:, None])
            yield _batch(names.dictionary, [0] * n, first, np.bincount(at, w, n), np.bincount(at, r, n), v)
        if k:
            yield _rows_of(own, right)

    return run


def _added(k: int):
    """Sums of runs of one (level, i); batches come sorted by both, so a task holds one run at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("level").to_pylist(), batch.column("i").to_pylist()))
            begin = np.array([n for n, key in enumerate(keys) if not n or key != keys[n - 1]])
            sums = [np.add.reduceat(batch.column(c).to_numpy(), begin) for c in "dg"]
            firsts = batch.column("a").to_numpy()[begin]
            v = np.add.reduceat(_matrix(batch.column("v"), k), begin, axis=0) if k else np.zeros((len(begin), 0))
            if held is not None and last == keys[0]:
                sums[0][0] += held[2]
                sums[1][0] += held[3]
                v[0] += held[4]
            elif held is not None:
                yield _batch([last[0]], [last[1]], [held[1]], [held[2]], [held[3]], held[4][None, :])
            n = len(begin) - 1
            if n:
                yield _batch([keys[b][0] for b in begin[:n]], [keys[b][1] for b in begin[:n]], firsts[:n],
                             sums[0][:n], sums[1][:n], v[:n])
            last, held = keys[-1], (None, firsts[n], sums[0][n], sums[1][n], v[n].copy())
        if held is not None:
            yield _batch([last[0]], [last[1]], [held[1]], [held[2]], [held[3]], held[4][None, :])

    return run


def _summed(rows: DataFrame, k: int) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(parts, "level", "i").sortWithinPartitions("level", "i")
    return met.mapInArrow(_added(k), _KIND)


def _explained(k: int):
    """What the levels of a task explain of the terms: sums of v v' / d and v g / d."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, right = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            v, d, g = _matrix(batch.column("v"), k), *(batch.column(c).to_numpy() for c in "dg")
            own += (v / d[:, None]).T @ v
            right += v.T @ (g / d)
        yield _rows_of(own, right)

    return run


def _collected(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of a matrix and of its right side, at most one per term."""
    matrix, right = np.zeros((k, k)), np.zeros(k)
    for r in rows.collect():
        matrix[r["i"]], right[r["i"]] = r["v"], r["g"]
    return matrix, right


def _moved(delta: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, a, d, g = _matrix(batch.column("v"), len(delta)), *(batch.column(c).to_numpy() for c in "adg")
            step = (g - v @ delta) / d
            yield pa.RecordBatch.from_arrays([batch.column("level"), pa.array(a + step), pa.array(np.abs(step))],
                                             names=["level", "a", "step"])

    return run


def _independent(schur: np.ndarray, own: np.ndarray) -> list[int]:
    """Terms, in order, of which levels and earlier terms leave some variance."""
    kept: list[int] = []
    low = np.zeros((0, 0))
    for i in range(len(own)):
        part = np.linalg.solve(low, schur[i, kept]) if kept else np.zeros(0)
        rest = schur[i, i] - part @ part
        if rest > RANK_LOSS * own[i, i]:
            grown = np.zeros((len(kept) + 1, len(kept) + 1))
            grown[:-1, :-1], grown[-1, :-1], grown[-1, -1] = low, part, np.sqrt(rest)
            low = grown
            kept.append(i)
    return kept


def _tables(rows: DataFrame, beta: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(levels, own block, Schur complement, its right side) at the intercepts in rows and at beta."""
    k = len(beta)
    both = stored(_summed(rows.mapInArrow(_information(beta), _KIND), k))
    levels = both.where("level IS NOT NULL").select("level", "a", "d", "g", "v")
    own, right = _collected(both.where("level IS NULL"), k)
    if not k:
        return levels, own, own, right
    less, less_right = _collected(_summed(levels.mapInArrow(_explained(k), _KIND), k), k)
    return levels, own, own - less, right - less_right


def fit_absorbed(rows: DataFrame, k: int) -> LogitFit:
    """rows: y (0/1), level (no nulls), x: array of k terms."""
    rows = rows.select(F.col("y").cast("double").alias("y"), "level", "x").where(
        "y IS NOT NULL AND level IS NOT NULL AND NOT exists(x, t -> t IS NULL)")
    kept, rows = list(range(k)), stored(rows)
    start = rows.withColumn("a", F.lit(0.0))
    levels, own, schur, right = _tables(start, np.zeros(k))
    left = _independent(schur, own)
    if len(left) < k:
        at = F.array(*[F.lit(i) for i in left]) if left else F.array().cast("array<int>")
        rows = stored(rows.withColumn("x", F.transform(at, lambda i: F.get("x", i))))
        kept = left
        levels, own, schur, right = _tables(rows.withColumn("a", F.lit(0.0)), np.zeros(len(kept)))
    beta = np.zeros(len(kept))
    for _ in range(STEPS):
        delta = np.linalg.solve(schur, right) if len(kept) else np.zeros(0)
        beta = beta + delta
        moved = stored(levels.mapInArrow(_moved(delta), "level string, a double, step double"))
        ends = moved.agg(F.max("step").alias("step"), F.max(F.abs("a")).alias("a")).first()
        most = max(ends["step"] or 0.0, np.abs(delta).max(initial=0.0))
        far = max(ends["a"] or 0.0, np.abs(beta).max(initial=0.0))
        now = rows.join(moved.select("level", "a"), "level")
        levels, own, schur, right = _tables(now, beta)
        if most < TOLERANCE or far > RUNAWAY or not np.isfinite(most) or np.linalg.matrix_rank(schur) < len(kept):
            break
    return LogitFit(kept, beta, np.linalg.pinv(schur), levels)


def contrasts(fit: LogitFit, reference: str) -> DataFrame:
    """level, coef, se of every other level against the reference."""
    ref = fit.levels.where(F.col("level") == reference).select("a", "d", "v").first()
    base, inverse = np.array(ref["v"]) / ref["d"], fit.inverse

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, a, d = _matrix(batch.column("v"), len(inverse)), *(batch.column(c).to_numpy() for c in "ad")
            apart = v / d[:, None] - base
            variance = 1 / d + 1 / ref["d"] + ((apart @ inverse) * apart).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("level"), pa.array(a - ref["a"]), pa.array(np.sqrt(variance))],
                                             names=["level", "coef", "se"])

    others = fit.levels.where(F.col("level") != reference)
    return others.mapInArrow(run, "level string, coef double, se double")
