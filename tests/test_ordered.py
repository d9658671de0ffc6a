"""Both plans of every order-dependent helper against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from keepwell.functions import ordered
from keepwell.functions.quantiles import quantiles


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    # One key holds a third of the rows and one of its values half of those.
    out = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{i % 7}"
        value = 0.5 if key == "hot" and i % 2 else round(rnd.gauss(0, 10), 3)
        out.append((i, key, value, rnd.randint(0, 1)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, v double, y int")


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(frame, rows, descending):
    counts = ordered.value_counts(frame, ["k"], "v", {"n": F.count("*")})
    got = {(r["k"], r["v"]): r["upto"] for r in ordered.running_sums(
        counts, ["k"], "v", {"upto": "n"}, descending=descending).collect()}
    for key in {r[1] for r in rows}:
        mine = [r[2] for r in rows if r[1] == key]
        for v in set(mine):
            want = sum(1 for x in mine if (x >= v if descending else x <= v))
            assert got[(key, v)] == want


def test_previous_values(frame, rows):
    got = {r["id"]: r["before"] for r in ordered.previous_values(
        frame, ["k"], ["v", "id"], {"before": "y"}).collect()}
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for a, b in zip([None, *mine], mine):
            assert got[b[0]] == (a[3] if a else None)


def test_greatest_before(frame, rows):
    got = {r["id"]: r["top"] for r in ordered.greatest_before(
        frame, [], ["v", "id"], "id", "top").collect()}
    best = None
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[r[0]] == best
        best = r[0] if best is None else max(best, r[0])


def test_quantiles_interpolate(frame, rows):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["q"] for r in quantiles(frame, ["v"], probs, ["k"]).collect()}
    for key in {r[1] for r in rows}:
        mine = sorted(r[2] for r in rows if r[1] == key)
        for p, q in zip(probs, got[key]):
            at = p * (len(mine) - 1)
            lo = int(at)
            hi = min(lo + 1, len(mine) - 1)
            assert q == pytest.approx(mine[lo] + (mine[hi] - mine[lo]) * (at - lo), abs=1e-12)


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "a double, b double")
    got = {r["variable"]: r["q"] for r in quantiles(
        df.select("a", F.col("b").cast("double").alias("b")), ["a", "b"], [0.5]).collect()}
    assert got == {"a": [2.0], "b": None}


def test_evenly_spaced_keeps_ends(spark):
    df = spark.range(1000).withColumn("pos", F.col("id") + 1)
    got = [r["id"] for r in ordered.evenly_spaced(df, [], "pos", F.lit(1000), 200)
           .orderBy("id").collect()]
    want = sorted({round(i * (999 / 199)) for i in range(200)})
    assert got == want and got[0] == 0 and got[-1] == 999
