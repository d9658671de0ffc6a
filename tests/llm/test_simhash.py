import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from keepwell.llm import simhash

KIND = "doc_id long, text string, fp string, root int"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    value = 0
    for bit in range(64):
        ones = sum(xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles)
        value |= (2 * ones > len(shingles)) << bit
    return value


def slow_components(prints):
    """prints: {id: fingerprint}."""
    left, out = sorted(prints), {}
    for start in left:
        if start in out:
            continue
        out[start], todo = start, [start]
        while todo:
            at = todo.pop()
            for other in left:
                if other not in out and bin(prints[at] ^ prints[other]).count("1") <= 4:
                    out[other] = start
                    todo.append(other)
    return out


def test_fingerprints_of_odd_texts():
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    for text in ["", " \t\n", "One", "a b c", "A  BÉ c\x0bD e", "x " * 50, " a b", long]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("shard,leaf", [(4096, 192), (64, 8)])
def test_links_of_planted_points(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(7)
    points = [rng.getrandbits(64) for _ in range(1500)]
    for p in points[:300]:  # chains whose ends are further apart than a link
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                p ^= 1 << b
            points.append(p)
    prints = {i: p for i, p in enumerate(dict.fromkeys(points))}
    signed = np.array(list(prints.values()), np.uint64).view(np.int64)
    rows = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    pairs = [(r.a, r.b) for r in simhash.links(rows).collect()]
    at = {int(x): i for i, x in enumerate(signed)}
    up = list(range(len(at)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        assert bin(prints[at[a]] ^ prints[at[b]]).count("1") <= 4 * len(points)
        i, j = sorted((root(at[a]), root(at[b])))
        up[j] = i
    assert {i: root(i) for i in prints} == slow_components(prints)
    assert len(pairs) < 13 * len(prints)


def test_components_of_documents(spark, tmp_path):
    rng = random.Random(3)
    base = [" ".join(f"t{rng.randrange(4000)}" for _ in range(400)) for _ in range(40)]
    texts = list(base)
    for t in base[:15]:
        words = t.split()
        words[rng.randrange(400)] = "changed"
        texts += [" ".join(words), t.upper(), t]
    texts += ["", None, "  \n", "one two", "one  two\n", "three"]
    rows = [(i, t, "x", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [rows[3]], KIND)
    found = simhash.near_duplicates(docs).collect()
    prints = {i: slow_fingerprint(t) for i, t, *_ in rows}
    want = slow_components(prints)
    assert len(found) == len(rows) + 1
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.fp % 2**64 for r in found} == prints
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    docs = spark.createDataFrame([(None, "a b", "", 0), (5, "a b", "", 0), (None, "z q", "", 0)], KIND)
    got = sorted((r.doc_id is None, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 5), (True, -1), (True, 5)]


def test_one_row_of_each_component_whatever_the_ids(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"t{rng.randrange(4000)}" for _ in range(300)) for _ in range(4))
    rows = [(1, a), (1, b), (0, b + " "), (5, a), (1, a), (None, c), (None, c + "  "), (None, d), (7, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text.strip()) for r in simhash.drop_near_duplicates(docs).collect())
    assert got == sorted([(1, a), (-1, b), (-1, c), (7, d)])


def test_shards_too_large_for_one_sample_get_trees_of_their_own(spark):
    """Samples of 128 points tell 8 shards apart; 6,000 points in shards of 50 need deeper trees."""
    rng = random.Random(11)
    prints = [rng.getrandbits(64) for _ in range(5000)]
    for p in prints[:1000]:
        flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
        prints.append(p ^ flips)
    prints = list(dict.fromkeys(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    points = spark.createDataFrame([(p,) for p in signed], "fp long")
    dealt = simhash._split_on(points.mapInArrow(simhash._deal(None), "shard string, fp long, home boolean"),
                              simhash.shared_folder(spark), 50, 128).groupBy("shard").agg({"home": "count"}).count()
    assert dealt > 40
    pairs = simhash.links(points, 50, 128).collect()
    up = {p: p for p in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = a % 2**64, b % 2**64
        i, j = sorted((root(x), root(y)))
        up[j] = i
    every = np.array(prints, np.uint64)
    want = {p: p for p in prints}

    def wanted(i):
        while want[i] != i:
            i = want[i]
        return i

    for n, p in enumerate(every):
        for q in every[n + 1:][np.bitwise_count(every[n + 1:] ^ p) <= 4]:
            i, j = sorted((wanted(int(p)), wanted(int(q))))
            want[j] = i
    assert {p: root(p) for p in prints} == {p: wanted(p) for p in prints}
