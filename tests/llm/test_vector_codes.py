import math
import random
from hashlib import sha256

import numpy as np
import pytest

from keepwell.llm import vector_codes

KIND = "vec_id long, embedding array<float>, label string, code string, part int"


def slow(rows, parts=4, entries=256, rounds=4):
    """Plain loops over Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label, *_ in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) if kept else 0
    at = [k * width // parts for k in range(parts + 1)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in zip(at, at[1:])]

    def assign(v, p):
        x = v[at[p]:at[p + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(assign(v, p)[1], []).append(v[at[p]:at[p + 1]])
            new = {k: [sum(c) // len(m) for c in zip(*m)] for k, m in members.items()}
            books[p] = [new.get(k, e) for k, e in enumerate(books[p])]
    out, total = [], {}
    for i, v, label in kept:
        found = [assign(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        total[label] = total.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, c, e, total[label], sha256(text.encode()).hexdigest()) for i, c, e, label in out), key=str)


def vectors(n, width, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.5, -0.5, rng.uniform(-2, 2)]) for _ in range(width)], rng.choice(["a", "b", None]))
            for i in range(n)]
    rows += [(n + i, rows[3 * i % n][1], "copy") for i in range(20)]  # ties
    rows += [(2, rows[0][1], "a"), (None, rows[0][1], "a"), (900, None, "a"), (901, [], "a"),
             (902, [1.0, None] + [0.0] * (width - 2), "a"), (903, [float("nan")] * width, "b"),
             (904, [float("-inf")] * width, "b"), (905, [0.25] * (width + 1), "b")]
    return [(*r, "x", 1) for r in rows]


@pytest.mark.parametrize("n,width,entries", [(300, 8, 256), (40, 6, 256), (200, 9, 7)])
def test_against_plain_loops(spark, n, width, entries):
    rows = vectors(n, width, n)
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    got = vector_codes.compressed(docs, entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows, entries=entries)


def test_gathered_distances_are_those_of_the_vectors():
    rng = np.random.default_rng(3)
    whole, book = rng.integers(-2000, 2000, (500, 5)), rng.integers(-2000, 2000, (11, 5))
    values, codes = vector_codes.encode(whole.astype(np.int32))
    entry, far = vector_codes.nearest([v.astype(np.int64) for v in values], codes, book)
    plain = ((whole[:, None] - book[None]) ** 2).sum(axis=2)
    assert (far == plain.min(axis=1)).all() and (entry == plain.argmin(axis=1)).all()


def test_decoding_and_large_components(spark):
    rows = [(k, [float(k), 0.0, 1e30, -1e30], "a", "", 0) for k in range(3)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, KIND))
    found = {r.vec_id: vector_codes.decode(r.code, books).tolist() for r in coded.collect()}
    top = vector_codes.LARGEST
    assert found == {k: [1024 * k, 0, top, -top] for k in range(3)}
    assert all(r.error == 0 for r in coded.collect())


def test_empty_table(spark):
    assert vector_codes.compressed(spark.createDataFrame([], KIND)).count() == 0
    only_bad = spark.createDataFrame([(1, None, "a", "", 0)], KIND)
    assert vector_codes.compressed(only_bad).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(only_bad, entries=300)
