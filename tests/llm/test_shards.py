import random

import pytest
from pyspark.sql import functions as F

from keepwell.llm import shards
from keepwell.llm.store import shared_folder

KIND = "doc_id long, text string, _x int, depth string"


def weight(text):
    return len((text or "").encode()) + shards.ROW


def test_every_shard_fits(spark):
    rng = random.Random(6)
    rows = [(i, "é" * rng.randrange(300), 1, "a") for i in range(700)]
    rows += [(7, "same " * 20, 1, None)] * 400  # a third of all rows have one id
    rows += [(8000, "x" * 9000, 1, ""), (8001, None, 1, ""), (None, "no id", 2, ""), (None, "", 2, "")]
    docs, limit = spark.createDataFrame(rows, KIND), 4000
    path = f"{shared_folder(spark)}/shards"
    found = {r.shard: r for r in shards.write(docs, path, limit).collect()}
    for r in found.values():
        assert r.shard_bytes <= limit or r.shard_rows == 1
    assert not any(a != b and b.startswith(a) for a in found for b in found)  # no prefix of another
    back = spark.read.parquet(path)
    assert back.columns == [*docs.columns, "shard"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:4] for r in back.collect()), key=key) == sorted(rows, key=key)
    sizes = {}
    for r in back.collect():
        b, n = sizes.get(r.shard[1:], (0, 0))
        sizes[r.shard[1:]] = (b + weight(r.text), n + 1)
    assert sizes == {s: (r.shard_bytes, r.shard_rows) for s, r in found.items()}
    # buckets are not split further than their limit asks for
    address = {r._address: r._weight for r in shards.addressed(docs, "doc_id", "text").collect()}
    for s in found:
        whole = [w for a, w in address.items() if a.startswith(s[:-1])]
        least = max(0, (sum(address.values()) - 1).bit_length() - 12)
        if len(s) > least + 1:
            assert sum(whole) > limit or all(a.startswith(s) for a in address if a.startswith(s[:-1]))


def test_small_empty_and_clashing(spark):
    one = spark.createDataFrame([(1, "abc", 0, "")], KIND)
    assert [r.shard for r in shards.directory(one, 1000).shards.collect()] == [""]
    assert shards.assign(one, shards.directory(one, 1000)).first().shard == ""
    none = one.limit(0)
    assert shards.directory(none, 1000).shards.count() == 0
    shards.write(none, f"{shared_folder(spark)}/shards", 1000)
    with pytest.raises(ValueError):
        shards.write(one.withColumn("Shard", F.lit(1)), "x", 10)


def test_rows_that_the_directory_has_not_seen(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(200), 1, "a") for i in range(3000)] + [(5, "y" * 50, 1, "a")] * 2000
    found = shards.directory(spark.createDataFrame(rows, KIND), 3000)
    assert len(found.splits) > 1
    more = spark.createDataFrame([(10_000 + i, "new", i, "b") for i in range(1000)], KIND).withColumnRenamed("_x", "_address")
    placed = shards.assign(more, found)
    assert placed.columns == [*more.columns, "shard"] and placed.count() == 1000
    assert sorted(r._address for r in placed.collect()) == list(range(1000))
    known = {r.shard for r in found.shards.collect()}
    assert all(r.shard in known or len(r.shard) == found.bits for r in placed.collect())
