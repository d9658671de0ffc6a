import math
import random

import pytest
from pyspark.sql import functions as F

from keepwell.llm import topk

KIND = "vec_id long, embedding array<float>, rank int, v string"
OUT = ["query_id", "rank", "vec_id", "score"]


def slow(rows, k, mod):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % mod == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,queries", [(4096, 1024), (16, 4)])
def test_against_all_pairs(spark, block, queries):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1, 1]) * rng.randrange(1024) / 512 * 2 ** rng.randrange(-3, 3) for _ in range(9)], 1, "x")
            for i in range(300)]
    rows += [(300 + i, rows[7 * i][1], 0, "") for i in range(10)]  # ties
    rows += [(400, None, 0, ""), (401, [1.0, None] + [0.0] * 7, 0, ""), (402, [float("nan")] * 9, 0, ""),
             (403, [float("inf")] + [0.0] * 8, 0, ""), (None, [1.0] * 9, 0, ""), (405, [0.0] * 9, 0, ""),
             (410, [0.5, -0.25], 0, ""), (420, [], 0, ""), (406, [50.0] * 9, 0, "")]
    got = topk.top_k(spark.createDataFrame(rows, KIND).repartition(3), F.col("vec_id") % 10 == 0, 5, block=block,
                     queries=queries)
    assert got.columns == OUT
    assert sorted(tuple(r) for r in got.collect()) == slow(rows, 5, 10)


def test_few_candidates_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], 0, ""), (3, [0.5, 0.5], 0, ""), (3, [0.5, 0.5], 0, ""), (0, [1.0, 0.0], 0, "")]
    got = topk.top_k(spark.createDataFrame(rows, KIND), F.col("vec_id") % 10 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 3, 32768)] * 2 + [(0, 2, 3, 32768)] * 2
    assert topk.top_k(spark.createDataFrame([], KIND), F.col("vec_id") == 0, 5).count() == 0
    alone = spark.createDataFrame(rows[:1], KIND)
    assert topk.top_k(alone, F.col("vec_id") == 0, 5).count() == 0
