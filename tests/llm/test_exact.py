import random
import re

import pytest

from keepwell.llm import exact

KIND = "doc_id long, text string, sig string, no int, _kept_id int"


def slow(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    return {k: (min(v), len(v)) for k, v in groups.items()}


def table(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("ab éß漢 \n") for _ in range(rng.choice([0, 3, 40, 3000]))) for _ in range(60)]
    base += ["x" * 20_000 + "y", "x" * 20_001, "z" * 9000 + " " + "w" * 9000]
    texts = base + [t.replace("a", "a ") for t in base[::2]] + ["\t" + t for t in base[::3]] + [None, "", " \n"]
    rows = [(i, t, "s", None, 7) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, base[1], "s", 1, 0), (None, "only here", "s", 1, 0)]


def test_fingerprints_compose():
    rng = random.Random(1)
    for n in (0, 1, 4095, 4096, 4097, 30_000):
        data = bytes(rng.randrange(256) for _ in range(n))
        whole = exact.fingerprint(data)
        value = [0, 0]
        for b in data:
            value = [(v * base + b) % p for v, base, p in zip(value, exact.BASES, exact.PRIMES)]
        assert [whole[0], whole[2]] == value
        for cut in (0, n // 3, n):
            assert exact.combine(exact.fingerprint(data[:cut]), exact.fingerprint(data[cut:])) == whole


@pytest.mark.parametrize("chunk", [64, exact.CHUNK])
def test_groups(spark, chunk):
    rows = table(spark)
    got = exact.exact_duplicates(spark.createDataFrame(rows, KIND), chunk=chunk).collect()
    want = slow(rows)
    assert len(got) == len(rows)
    key = {(i, len(t or "")): re.sub(r"[\x20\x09-\x0D]+", "", t or "") for i, t, *_ in rows}
    by_id = {i: re.sub(r"[\x20\x09-\x0D]+", "", t or "") for i, t, *_ in rows if i is not None}
    for r in got:
        if r.doc_id is None:
            continue
        first, n = want[by_id[r.doc_id]]
        assert (r.group_size, r.keep_id) == (n, None if first[1] else first[2])
    assert sum(r.kept for r in got) == len(want)
    assert key


def test_equal_fingerprints_of_different_texts_stay_apart(spark, monkeypatch):
    texts = ["aa", "ab", "ba", "a a", "ab", "bb", "a\nb", "ccc"]
    plain = exact.fingerprints

    def colliding(docs, *args):  # every fingerprint of two bytes is the same
        from pyspark.sql import functions as F
        return plain(docs, *args).withColumn("hash_1", F.lit(1).cast("long")).withColumn("hash_2", F.lit(1).cast("long"))

    monkeypatch.setattr(exact, "fingerprints", colliding)
    got = exact.exact_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {
        0: (3, 2), 3: (3, 2), 1: (6, 3), 4: (6, 3), 6: (6, 3), 2: (2, 1), 5: (5, 1), 7: (7, 1)}


def test_stage_keeps_one_row_of_each(spark):
    rows = table(spark)
    docs = spark.createDataFrame(rows, KIND)
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len(slow(rows))
    assert exact.drop_exact_duplicates(docs.limit(0)).count() == 0
