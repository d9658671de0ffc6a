"""Product codes of vectors by whole-number k-means over per-dimension value dictionaries.

A component x becomes the integer floor(1024 x); a vector is cut into equal consecutive parts, and a
part's code is its nearest entry in the codebook of that part. Vectors are stored in blocks: each
dimension of a block as its distinct integers and a code per vector. A round tabulates the squared
differences of every distinct integer to all entries once per dimension; the distances of all parts of
the block are then gathers and additions over the codes, without another multiplication. Sums and
counts per entry are added up inside a task before they are shuffled: 256 rows a part from a task.

Every figure is a whole number of 64 bits, so results do not depend on how rows are dealt out.

Defined cases: rows whose vector is null, empty or holds null or non-finite components are left out;
so are vectors of another length than the first kept one (that of the least id, null ids last); a
length that the parts do not divide is cut at floor(part x length / parts); fewer vectors than entries give a
codebook of that many; rows that repeat an id each get a code, and codebooks begin with them in
order of their components; integers are held within 2 ** 26, so that no sum leaves 64 bits; null
labels are one label; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.store import shared_folder, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LARGEST = 1 << 26
BLOCK = 4096  # vectors of a block


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v: array of integers."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(
        F.least(F.greatest(c, F.lit(-1e12)), F.lit(1e12)) * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), whole.alias("v"))


# -- blocks of dictionary codes -------------------------------------------------------------------

def encode(whole: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct integers of each dimension, codes by dimension and vector)."""
    values, codes = zip(*(np.unique(column, return_inverse=True) for column in whole.T))
    return list(values), np.array(codes, np.uint16)


def _encoded(batches: Iterator[pa.RecordBatch]):
    """(rows, distinct integers of each dimension, codes), a block at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, *encode(part.column("v").flatten().to_numpy().reshape(part.num_rows, -1))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, values, codes in _encoded(batches):
        sizes = np.array([len(v) for v in values], np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()) for x in (sizes, np.concatenate(values).astype(np.int32), codes)],
            names=["sizes", "values", "codes"])


def _opened(batches: Iterator[pa.RecordBatch]):
    """(distinct integers of each dimension, codes) of each stored block."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = {c: batch.column(c)[row].as_buffer() for c in ("sizes", "values", "codes")}
            sizes = np.frombuffer(get["sizes"], np.int32)
            values = np.split(np.frombuffer(get["values"], np.int32).astype(np.int64), np.cumsum(sizes)[:-1])
            yield values, np.frombuffer(get["codes"], np.uint16).reshape(len(sizes), -1)


def cuts(width: int, parts: int) -> list[int]:
    return [k * width // parts for k in range(parts + 1)]


def nearest(values: list[np.ndarray], codes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every vector's part; all arguments hold the part's dimensions only."""
    total = np.zeros((codes.shape[1], len(book)), np.int64)
    for d, mine in enumerate(values):
        table = (mine[:, None] - book[None, :, d]) ** 2  # each distinct integer against all entries
        total += table[codes[d]]
    entry = total.argmin(axis=1)
    return entry, total[np.arange(len(entry)), entry]


def _sums(books: list[np.ndarray], at: list[int]):
    """part, entry, n, sums: one row per used entry and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for values, codes in _opened(batches):
            for p, book in enumerate(books):
                entry, _ = nearest(values[at[p]:at[p + 1]], codes[at[p]:at[p + 1]], book)
                counts[p] += np.bincount(entry, minlength=len(book))
                for d in range(at[p], at[p + 1]):
                    np.add.at(sums[p][:, d - at[p]], entry, values[d][codes[d]])
        for p, n in enumerate(counts):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(n[used]),
                 pa.array(list(sums[p][used]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: list[np.ndarray], at: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, codes in _encoded(batches):
            values = [v.astype(np.int64) for v in values]
            found = [nearest(values[a:b], codes[a:b], book) for a, b, book in zip(at, at[1:], books)]
            entries = np.array([e for e, _ in found], np.uint8).T.copy()
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), pa.array([row.tobytes().hex() for row in entries], pa.string()),
                 pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])

    return run


# -- codebooks --------------------------------------------------------------------------------------

def improved(blocks: DataFrame, books: list[np.ndarray], at: list[int]) -> list[np.ndarray]:
    """Codebooks after one round over all blocks; the driver gets one row per part and entry."""
    rows = blocks.mapInArrow(_sums(books, at), "part int, entry int, n long, sums array<long>")
    each = rows.select("part", "entry", "n", F.posexplode("sums").alias("d", "x")).groupBy("part", "entry", "d").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = [b.copy() for b in books]
    found = each.toPandas().to_numpy(np.int64)
    for p in range(len(books)):
        part, entry, d, n, x = found[found[:, 0] == p].T
        out[p][entry, d] = x // n
    return out


def codebook_text(books: list[np.ndarray]) -> str:
    """All components as decimals: by part, entry and position."""
    return ",".join(",".join(map(str, b.ravel().tolist())) for b in books if b.size)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error per kept row; the final codebooks). entries: 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte per part: 1 to 256 entries")
    folder = shared_folder(vectors.sparkSession)
    rows = whole_vectors(vectors, id_col, vector_col, label_col)
    order = [F.col("vec_id").isNull(), "vec_id", "v"]
    first = rows.orderBy(*order).limit(1).select(F.size("v")).first()
    width = first[0] if first else 0
    rows = stored(rows.where(F.size("v") == width), folder, "rows")
    heads = [r.v for r in rows.orderBy(*order).limit(entries).select("v").collect()]  # entries rows at most
    heads = np.array(heads, np.int64).reshape(len(heads), width)
    at = cuts(width, parts)
    books = [heads[:, a:b].copy() for a, b in zip(at, at[1:])]
    blocks = rows.select("v").mapInArrow(_blocks, "sizes binary, values binary, codes binary")
    blocks = stored(blocks, folder, "blocks")
    for _ in range(rounds if len(heads) else 0):
        books = improved(blocks, books, at)
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(_codes(books, at), f"vec_id long, label {kind}, code string, error long"), books


def compressed(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (error of all rows of the label), codebooks_sha256."""
    coded, books = compress(vectors, **options)
    coded = stored(coded, shared_folder(vectors.sparkSession), "coded")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(labels, coded["label"].eqNullSafe(labels["of"])).select(
        "vec_id", "code", "error", "label_error",
        F.lit(sha256(codebook_text(books).encode()).hexdigest()).alias("codebooks_sha256"))


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([book[k] for k, book in zip(bytes.fromhex(code), books)])
