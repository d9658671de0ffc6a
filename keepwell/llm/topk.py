"""Exact top-k search by inner product over norm-sorted blocks.

Components are made whole numbers. Vectors are sorted by descending length and packed into blocks;
the right singular vectors of the whole matrix (from its Gram matrix, summed over all rows) give a
rotation that moves most of an inner product into the first few places. Every query first meets the
block of the longest vectors, which gives it a score to beat. The other blocks are searched in order
of length: a slice of vectors ends the search of a query when |query| times the longest length left is
below its score to beat, and a pair is scored only if the inner product over the first places plus the
product of the two remaining lengths (Cauchy-Schwarz) reaches it. Scores are exact integers.

Defined cases: rows with a null id, a null vector, or a null or non-finite component take no part;
shorter vectors count as filled up with zeros; a query's own id is no candidate, also in rows that
repeat it; rows that repeat a query's id are queries of their own; ties go to the smaller id; with
fewer than k candidates all are returned; an empty table gives an empty result; other columns are not
looked at. Products beyond 63 bits wrap around, as Spark's own long arithmetic does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.store import shared_folder, stored

SCALE = 256
BLOCK, QUERIES, SLICE = 4096, 1024, 512
FOUND = "query_row long, query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of long), squared length; rows that take part only."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(~bad)
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"),
                        F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return whole.withColumn("square", square)


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of equal width, filled up with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                m = _matrix(batch.column("v").slice(at, BLOCK), width).astype(np.float64)
                total += m.T @ m
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())],
                                         names=["i", "j", "x"])

    return run


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors, the largest singular value first."""
    cells = rows.select("v").mapInArrow(_gram(width), "i long, j long, x double")
    gram = np.zeros((width, width))
    for r in cells.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # width ** 2 rows
        gram[r.i, r.j] = r.x
    values, turned = np.linalg.eigh(gram)
    return turned[:, np.argsort(-values)]


def _packed(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n, part_no = [], [], 0, 0
        done = False
        batches = iter(batches)
        place = None
        while not done:
            batch = next(batches, None)
            done = batch is None
            if not done and batch.num_rows:
                place = batch.column("part")[0].as_py() if place is None else place
                ids.append(batch.column("vec_id").to_numpy())
                parts.append(_matrix(batch.column("v"), width))
                n += batch.num_rows
            while n >= size or done and n:
                all_ids, all_parts = np.concatenate(ids), np.concatenate(parts)
                own, m = all_ids[:size], all_parts[:size]
                ids, parts, n = [all_ids[size:]], [all_parts[size:]], max(0, n - size)
                length = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place * (1 << 30) + part_no]), pa.array([float(length.max(initial=0.0))]),
                     pa.array([own.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())],
                    names=["block", "longest", "ids", "vectors"])
                part_no += 1

    return run


def blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """block, longest (length), ids, vectors: up to size rows each, in the order of rows' partitions."""
    return rows.withColumn("part", F.spark_partition_id()).select("part", "vec_id", "v").mapInArrow(
        _packed(width, size), "block long, longest double, ids binary, vectors binary")


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of (query position, id, score) the k best of each query, ties to the smaller id."""
    if not found:
        return (np.zeros(0, np.int64),) * 3
    q, ids, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], ids[rank < k], score[rank < k]


def search_block(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, vectors: np.ndarray,
                 ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query position, id, score) of what may be among the k best. floor: scores to reach."""
    lead = max(1, turn.shape[1] // 4)
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    q_turn = q @ turn
    q_len = np.sqrt((q ** 2).sum(axis=1))
    q_rest = np.sqrt((q_turn[:, lead:] ** 2).sum(axis=1))
    v_len = np.sqrt((v ** 2).sum(axis=1))
    order = np.argsort(-v_len, kind="stable")
    v, vectors, ids, v_len = v[order], vectors[order], ids[order], v_len[order]
    exact = q_len.max(initial=0) * v_len.max(initial=0) < 2.0 ** 52  # sums of doubles are whole numbers
    floor, best = floor.copy(), []
    for at in range(0, len(v), SLICE):
        slack = 0.5 + 1e-9 * q_len * v_len[at]
        open_ = np.flatnonzero(q_len * v_len[at] >= floor - slack)
        if not len(open_):
            break  # all later vectors are shorter still
        part = slice(at, at + SLICE)
        v_turn = v[part] @ turn
        bound = q_turn[open_, :lead] @ v_turn[:, :lead].T
        bound += q_rest[open_, None] * np.sqrt((v_turn[:, lead:] ** 2).sum(axis=1))
        likely = bound >= (floor - slack)[open_, None]
        likely &= query_ids[open_, None] != ids[part]
        cols = np.flatnonzero(likely.any(axis=0))
        if not len(cols):
            continue
        if exact:
            score = np.rint(q[open_] @ v[part][cols].T).astype(np.int64)
        else:
            score = queries[open_] @ vectors[part][cols].T
        i, j = np.nonzero(likely[:, cols] & (score >= floor[open_, None]))
        best = [_best([*best, (open_[i], ids[part][cols[j]], score[i, j])], k)]
        count = np.bincount(best[0][0], minlength=len(floor))
        full = np.flatnonzero(count >= k)
        last = np.cumsum(count)[full] - 1
        floor[full] = np.maximum(floor[full], best[0][2][last])
    return best[0] if best else _best([], k)


def _search(turn: np.ndarray, k: int, per_block: int):
    width = len(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {c: batch.column(c)[row] for c in batch.schema.names}
                q_ids = np.frombuffer(get["q_ids"].as_buffer(), np.int64)
                floor = (np.frombuffer(get["floor"].as_buffer(), np.float64) if get["floor"].is_valid
                         else np.full(len(q_ids), -np.inf))
                q = np.frombuffer(get["queries"].as_buffer(), np.int64).reshape(len(q_ids), width)
                ids = np.frombuffer(get["ids"].as_buffer(), np.int64)
                v = np.frombuffer(get["vectors"].as_buffer(), np.int64).reshape(len(ids), width)
                at, found, score = search_block(q, q_ids, floor, v, ids, turn, k)
                first = get["q_block"].as_py() * per_block
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + at), pa.array(q_ids[at]), pa.array(found), pa.array(score)],
                    names=["query_row", "query_id", "vec_id", "score"])

    return run


def _with_floors(per_block: int):
    """Adds to each block of queries the scores to reach, and the least length that can matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {c: batch.column(c)[row] for c in batch.schema.names}
                n = len(get["q_ids"].as_buffer()) // 8
                floor = np.full(n, -np.inf)
                for x in get["floors"].as_py() or []:
                    floor[x["query_row"] - get["q_block"].as_py() * per_block] = x["floor"]
                m = np.frombuffer(get["queries"].as_buffer(), np.int64).reshape(n, -1).astype(np.float64)
                length = np.sqrt((m ** 2).sum(axis=1))
                need = np.where(floor > 0, (floor - 0.5) / np.maximum(length, 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([get["q_block"].as_py()]), pa.array([get["q_ids"].as_py()], pa.binary()),
                     pa.array([get["queries"].as_py()], pa.binary()), pa.array([floor.tobytes()], pa.binary()),
                     pa.array([float(need.min(initial=np.inf)) * (1 - 1e-9)])],
                    names=["q_block", "q_ids", "queries", "floor", "need"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score; is_query: a condition on vec_id that chooses the query rows. block
    and queries: vectors in a block, and in a block of queries."""
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession)
    rows = stored(whole_vectors(vectors, id_col, vector_col), folder, "rows")
    width, n_queries = rows.agg(F.max(F.size("v")), F.count_if(is_query)).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n_queries:
        return empty
    width = max(width, 1)
    turn = rotation(rows, width)
    by_length = rows.repartitionByRange(F.desc("square")).sortWithinPartitions(F.desc("square"))
    stock = stored(blocks(by_length, width, block), folder, "stock")
    asked = rows.where(is_query).repartition(math.ceil(n_queries / queries))
    asked = blocks(asked, width, queries).select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("queries"))
    asked = stored(asked, folder, "asked")
    names = "q_block", "q_ids", "queries", "floor", "ids", "vectors"
    # the longest vectors first: one block against all blocks of queries
    longest = stock.select(F.max_by("block", "longest")).first()[0]
    head = stock.where(F.col("block") == longest)
    first = asked.withColumn("floor", F.lit(None).cast("binary")).crossJoin(head)
    first = stored(first.select(*names).mapInArrow(_search(turn, k, queries), FOUND), folder, "first")
    floors = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(
        F.col("n") >= k).select("query_row", "floor")
    floors = floors.groupBy(F.expr(f"query_row div {queries}").alias("q_block")).agg(
        F.collect_list(F.struct("query_row", "floor")).alias("floors"))
    ready = stored(asked.join(floors, "q_block", "left").mapInArrow(
        _with_floors(queries), "q_block long, q_ids binary, queries binary, floor binary, need double"), folder, "ready")
    rest = stock.where(F.col("block") != longest)
    pairs = rest.join(ready, rest["longest"] >= ready["need"])  # blocks against blocks of queries
    found = first.unionByName(pairs.select(*names).mapInArrow(_search(turn, k, queries), FOUND))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
