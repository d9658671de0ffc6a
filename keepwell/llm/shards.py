"""Shards under a byte limit by extendible hashing.

A row's address is a string of 128 bits: the hash of its id, then a hash of its place in the input,
which tells rows apart that repeat an id. The directory begins with as many prefix bits as the total
asks for at least; a bucket over the limit, and only that, is split on the next bit on which its
addresses differ, until it fits. A shard is named by its prefix. Splits skip the bits on which a bucket's
rows agree, and looking an address up skips them too, so the directory covers every address.

Defined cases: a row weighs the UTF-8 bytes of its text plus ROW; a null text has none; a row that is
over the limit by itself gets a shard of its own; rows that repeat one id, however many, are split
by their place; a null id has an address like any other; an empty table has no shards; very long texts are
weighed whole. A row that the directory was not built from gets the shard its address leads to. Writing keeps
all columns of the input, except one named like the shard column, which is refused.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.store import fresh, shared_folder, stored, text_of

ROW = 8


def _bits(hashed: Column) -> Column:
    return F.lpad(F.bin(hashed), 64, "0")


def _address(id_col: str) -> Column:
    return F.concat(_bits(F.xxhash64(F.col(id_col))), _bits(F.xxhash64(F.monotonically_increasing_id())))


def addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_address and _weight of every row."""
    return docs.select(_address(id_col).alias("_address"), (
        F.octet_length(text_of(text_col)).cast("long") + ROW).alias("_weight"))


def _buckets(rows: DataFrame) -> DataFrame:
    """Size of each bucket and the first bit on which its addresses differ (0 if on none)."""
    found = rows.groupBy("shard").agg(
        F.sum("_weight").alias("shard_bytes"), F.count("*").alias("shard_rows"),
        F.min("_address").alias("low"), F.max("_address").alias("high"))
    same = F.filter(F.sequence(F.lit(1), F.lit(128)),
                    lambda i: F.substring("low", i, 1) != F.substring("high", i, 1))
    return found.select("shard", "shard_bytes", "shard_rows", "low",
                        F.when(F.col("low") == F.col("high"), 0).otherwise(F.array_min(same)).alias("bit"))


@dataclass
class Directory:
    """shards: shard (its prefix), shard_bytes, shard_rows; bits: those that every shard begins with; splits: for
    each turn, the buckets that were split (shard, the way to its first differing bit, that bit's place)."""
    shards: DataFrame
    bits: int
    splits: list[DataFrame]


def directory(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> Directory:
    folder = shared_folder(docs.sparkSession)
    rows = stored(addressed(docs, id_col, text_col).select("_address", "_weight"), folder, "addresses")
    total = rows.agg(F.sum("_weight")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(total, 1) / limit)))
    rows = rows.withColumn("shard", F.substring("_address", 1, bits))
    done, splits = [], []
    for turn in itertools.count():
        buckets = stored(_buckets(rows), folder, f"buckets-{turn}")
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("bit") == 0)
        done.append(buckets.where(fits).select("shard", "shard_bytes", "shard_rows"))
        over = buckets.where(~fits).select("shard", F.substring(F.col("low"), F.lit(1), F.col("bit") - 1).alias("way"), "bit")
        if over.isEmpty():
            return Directory(stored(functools.reduce(DataFrame.unionByName, done), folder, "directory"), bits, splits)
        splits.append(stored(over, folder, f"over-{turn}"))
        rows = stored(rows.join(over.select("shard", "bit"), "shard").select(
            "_address", "_weight", F.substring("_address", F.lit(1), F.col("bit")).alias("shard")),
            folder, f"split-{turn}")


def assign(docs: DataFrame, found: Directory, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the column shard. An address goes down the splits from its first bits; bits that a split has
    passed over are not looked at, so every row has a shard, whether the directory was built from it or not.
    A turn's splits are at most as many as its buckets; Spark sends them to all executors only while they are
    below its own broadcast threshold."""
    address, shard = fresh(docs, "_address"), fresh(docs, "shard")
    rows = docs.withColumn(address, _address(id_col)).withColumn(shard, F.substring(address, 1, found.bits))
    for turn, split in enumerate(found.splits):
        of, way, bit = (fresh(docs, f"_{c}{turn}") for c in ("of", "way", "bit"))
        rows = rows.join(split.toDF(of, way, bit), F.col(shard) == F.col(of), "left").withColumn(
            shard, F.when(F.col(of).isNull(), F.col(shard)).otherwise(
                F.concat(F.col(way), F.substring(F.col(address), F.col(bit), F.lit(1))))).drop(of, way, bit)
    return rows.drop(address)


def write(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
          ) -> DataFrame:
    """Writes one folder path/shard=s<prefix> per shard, each by one task; returns the shards of the
    directory."""
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("the table has a column named shard already")
    found = directory(docs, limit, id_col, text_col)
    n = max(1, found.shards.count())
    number = fresh(docs, "_number")
    numbers = found.shards.select(F.col("shard").alias("_named"), (F.row_number().over(
        Window.orderBy("shard")) - 1).cast("int").alias(number))  # one row per shard
    named = assign(docs, found, id_col, text_col)
    named = named.join(numbers, F.col("shard") == F.col("_named"), "left").drop("_named").withColumns({
        number: F.coalesce(F.col(number), F.pmod(F.hash("shard"), F.lit(n)).cast("int")),
        "shard": F.concat(F.lit("s"), "shard")})
    dealt = named.repartitionById(n, number).drop(number)
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return found.shards
