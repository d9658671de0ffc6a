"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing the texts.

Texts are equal when they agree after every character of [\\x20\\x09-\\x0D] is deleted. A text is cut
into chunks; each chunk is hashed on its own, and (hash, base ** length) pairs combine in order by
h = h_left * shift_right + h_right, so the chunks of a huge document need not meet in one worker.
Equal fingerprints are only candidates: their chunks are compared one by one with those of the
document that would stay, and a text that differs opens a class of its own.

Defined cases: a null text counts as empty, empty texts are equal to each other; of equal texts the
longest original (code points) stays, then the smallest id (a null id ranks last), then one of the
rows that repeat it; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.store import equal, fresh, shared_folder, stored, text_of

WHITE = r"[\x20\x09-\x0D]+"
CHUNK = 1 << 20
BLOCK = 4096  # 255 * 2**31 * 4096 < 2**53: block sums are exact in doubles
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
KEY = ["hash_1", "hash_2", "norm_bytes"]


def _powers(base: int, prime: int, n: int) -> list[int]:
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base % prime)
    return out[::-1]


_POWERS = np.array([_powers(b, p, BLOCK) for b, p in zip(BASES, PRIMES)], dtype=np.float64).T.copy()
_STEPS = [np.array(_powers(pow(b, BLOCK, p), p, CHUNK // BLOCK), dtype=np.uint64)
          for b, p in zip(BASES, PRIMES)]


def fingerprint(data: bytes) -> tuple[int, int, int, int]:
    """(hash, base ** length) for each of the two primes."""
    n = len(data)
    raw = np.frombuffer(data, dtype=np.uint8)
    if n <= BLOCK:
        sums = raw.astype(np.float64) @ _POWERS[BLOCK - n:]
        h = [int(s) % p for s, p in zip(sums, PRIMES)]
    else:
        rows = -(-n // BLOCK)
        padded = np.zeros(rows * BLOCK, dtype=np.float64)  # zeros in front leave the value as it is
        padded[rows * BLOCK - n:] = raw
        sums = (padded.reshape(rows, BLOCK) @ _POWERS).astype(np.uint64)
        h = []
        for i, p in enumerate(PRIMES):
            steps = _STEPS[i][-rows:] if rows <= len(_STEPS[i]) else np.array(
                _powers(pow(BASES[i], BLOCK, p), p, rows), dtype=np.uint64)
            h.append(int((sums[:, i] % np.uint64(p) * steps % np.uint64(p)).sum()) % p)
    return h[0], pow(BASES[0], n, PRIMES[0]), h[1], pow(BASES[1], n, PRIMES[1])


def combine(left: tuple[int, int, int, int], right: tuple[int, int, int, int]):
    """The pair of a text from those of its two parts."""
    return ((left[0] * right[1] + right[0]) % PRIMES[0], left[1] * right[1] % PRIMES[0],
            (left[2] * right[3] + right[2]) % PRIMES[1], left[3] * right[3] % PRIMES[1])


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [i for i, f in enumerate(batch.schema) if f.name != "chunk"]
        parts = np.array([fingerprint(c.as_buffer()) for c in batch.column("chunk")],
                         dtype=np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in keep] + [pa.array(parts[:, j]) for j in range(4)],
            names=[batch.schema.names[i] for i in keep] + ["h1", "s1", "h2", "s2"])


def _chunks(docs: DataFrame, id_col: str, text_col: str, chunk: int, *more) -> DataFrame:
    """Chunks of every text without white space; an empty text has one empty chunk."""
    text = text_of(text_col)
    norm = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("sig"), *more,
        F.regexp_replace(text, WHITE, "").cast("binary").alias("norm"))
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("norm") / chunk).cast("int") - 1)),
        lambda i: F.substring(F.col("norm"), i * chunk + 1, F.lit(chunk)))
    kept = [c for c in norm.columns if c != "norm"]
    return norm.select(*kept, F.octet_length("norm").cast("long").alias("norm_bytes"),
                       F.sha2("norm", 256).alias("text_sha256"), F.posexplode(parts).alias("no", "chunk"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, sig, row, n_chars, text_sha256, hash_1, hash_2, norm_bytes."""
    parts = _chunks(docs, id_col, text_col, chunk, F.monotonically_increasing_id().alias("row"),
                    F.length(text_of(text_col)).cast("long").alias("n_chars"))
    hashed = parts.mapInArrow(
        _hash_chunks, "doc_id long, sig long, row long, n_chars long, norm_bytes long, "
        "text_sha256 string, no int, h1 long, s1 long, h2 long, s2 long")
    names = ["row", "doc_id", "sig", "n_chars", "norm_bytes", "text_sha256"]
    listed = hashed.groupBy(*names).agg(
        F.sort_array(F.collect_list(F.struct("no", "h1", "s1", "h2", "s2"))).alias("parts"))

    def folded(h: str, s: str, prime: int):
        return F.aggregate("parts", F.lit(0).cast("long"),
                           lambda acc, x: (acc * x[s] + x[h]) % F.lit(prime))

    return listed.select(*names, folded("h1", "s1", PRIMES[0]).alias("hash_1"),
                         folded("h2", "s2", PRIMES[1]).alias("hash_2"))


def _leaders(rows: DataFrame) -> DataFrame:
    """Per key the row that stays and the number of rows."""
    rank = F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("no_id"),
                    "doc_id", "row", "sig")
    return rows.groupBy(*KEY, "cls").agg(F.min(rank).alias("first"), F.count("*").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     chunk: int = CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, sig: one row per row of docs."""
    folder = shared_folder(docs.sparkSession)
    rows = stored(fingerprints(docs, id_col, text_col, chunk), folder, "rows").withColumn(
        "cls", F.lit(0))
    texts = None
    for attempt in itertools.count(1):
        firsts = _leaders(rows)
        several = firsts.where("group_size > 1")
        if texts is None:  # the texts of all candidates, once
            wanted = rows.join(several, [*KEY, "cls"], "left_semi").select("doc_id", "sig", *KEY)
            wanted = wanted.distinct().select(F.col("doc_id").alias("d"), F.col("sig").alias("s"),
                                              *KEY[:2])
            parts = _chunks(docs, id_col, text_col, chunk)
            texts = stored(parts.join(wanted, parts.doc_id.eqNullSafe(wanted.d)
                                      & (parts.sig == wanted.s)).select(
                "doc_id", "sig", "hash_1", "hash_2", "norm_bytes", "no", "chunk"), folder, "texts")
        odd = stored(_differing(texts, rows, several, attempt), folder, f"odd-{attempt}")
        if odd.isEmpty():
            break
        rows = rows.join(odd, equal(rows, odd, "doc_id", "sig", *KEY, "cls"), "left").select(
            *[rows[c] for c in rows.columns if c != "cls"],
            F.coalesce(odd["to"], rows["cls"]).alias("cls"))
        rows = stored(rows, folder, f"rows-{attempt}")
    out = rows.join(firsts, [*KEY, "cls"])
    return out.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "sig")


def _differing(texts: DataFrame, rows: DataFrame, several: DataFrame, attempt: int) -> DataFrame:
    """Members whose chunks are not those of their leader, with the class they move to."""
    lead = several.select(F.col("first.doc_id").alias("doc_id"), F.col("first.sig").alias("sig"),
                          *KEY, "cls")
    lead = texts.join(lead, equal(texts, lead, "doc_id", "sig", *KEY)).select(
        *[lead[c] for c in (*KEY, "cls")], texts["no"], texts["chunk"].alias("lead_chunk"))
    if attempt == 1:  # every row is still in class 0
        mine = texts.withColumn("cls", F.lit(0))
    else:
        now = rows.select("doc_id", "sig", *KEY, "cls").distinct()
        mine = texts.join(now, equal(texts, now, "doc_id", "sig", *KEY)).select(
            *[texts[c] for c in texts.columns], now["cls"])
        mine = mine.where(F.col("cls") == attempt - 1)
    pairs = mine.join(lead, [*KEY, "cls", "no"])
    return pairs.groupBy("doc_id", "sig", *KEY, "cls").agg(
        F.bool_and(F.col("chunk") == F.col("lead_chunk")).alias("same")).where("not same").select(
        "doc_id", "sig", *KEY, "cls", F.lit(attempt).alias("to"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row keeps; all columns stay."""
    sig, of_id, of_sig = (fresh(docs, c) for c in ("_sig", "_kept_id", "_kept_sig"))
    found = exact_duplicates(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias(of_id), F.col("sig").alias(of_sig))
    signed = docs.withColumn(sig, F.xxhash64(text_of(text_col)))
    kept = signed.join(found, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(sig) == F.col(of_sig)), "left_semi")
    return kept.dropDuplicates([id_col, sig]).drop(sig)
