import random

import numpy as np
import pytest

from keepwell.llm import mixing

KIND = "doc_id long, text string, _text string, p int, rate double"
WORDS = {"good": ["alpha", "beta", "gamma", "delta"], "poor": ["###", "$$$", "%%%"], "toxic": ["idiot", "scum", "trash"]}
TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


def rows(n=600, seed=1):
    rng = random.Random(seed)
    out, kind = [], {}
    for i in range(n):
        kind[i] = rng.choices(list(WORDS), [6, 3, 1])[0]
        mine = rng.choices(WORDS["good"], k=rng.randrange(5, 80)) + rng.choices(WORDS[kind[i]], k=rng.randrange(5, 60))
        rng.shuffle(mine)
        out.append((i, " ".join(mine), "x", 1, 2.0))
    return out, kind


@pytest.fixture(scope="module")
def fitted(spark):
    made, kind = rows()
    made += [(5000, None, "", 0, 0.0), (5001, " \n", "", 0, 0.0), made[3], (None, "alpha beta", "", 0, 0.0)]
    labels = [(i, k) for i, k in kind.items() if i % 2] + [(1, None), (None, "good"), (7777, "good"), (3, "what")]
    docs = spark.createDataFrame(made, KIND)
    labelled = spark.createDataFrame(labels, "doc_id long, domain string")
    return docs, labelled, made, kind, mixing.document_rates(docs, labelled, TARGETS).collect()


def test_domains_of_documents_that_were_not_learnt_from(fitted):
    *_, kind, got = fitted
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 2 == 0]
    assert np.mean([list(TARGETS)[int(np.argmax(r.p))] == kind[r.doc_id] for r in held]) > 0.95


def test_rates_meet_the_targets(fitted):
    docs, _, made, _, got = fitted
    assert len(got) == len(made)
    assert {r.doc_id: r.tokens for r in got} == {i: len((t or "").split()) for i, t, *_ in made}
    total = sum(r.tokens for r in got)
    for k, want in enumerate(TARGETS.values()):
        assert sum(r.rate * r.tokens * r.p[k] for r in got) / total == pytest.approx(want, abs=1e-5)
    assert min(r.rate for r in got) >= 0


def test_least_squares_against_plain_descent(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.4] * 3, 400)
    tokens = rng.integers(1, 50, 400)
    table = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "tokens long, p array<double>")
    a = tokens / tokens.sum()
    goal = [0.8, 0.2, 0.0]  # no rates reach it: every document has some of the third
    steps, shares = mixing.fit_rates(table, goal, passes=25)
    rate = np.ones(400)
    for _ in range(25):
        rate = np.maximum(0, rate - 0.9 * (p @ (p.T @ (a * rate) - goal)))
    assert ((np.array(shares) - goal) ** 2).sum() <= ((p.T @ (a * rate) - goal) ** 2).sum()
    mine = np.ones(400)
    for step in steps:
        mine = np.maximum(0, mine - p @ np.array(step))
    assert np.allclose(p.T @ (a * mine), shares, atol=1e-9)
    assert (mine == 0).any()
    goal = [0.72, 0.23, 0.05]  # reached with some documents at zero
    assert np.allclose(mixing.fit_rates(table, goal)[1], goal, atol=2e-6)


def test_mix_repeats_rows_by_their_rate(fitted):
    docs, labelled, made, kind, got = fitted
    mixed = mixing.mix(docs, labelled, TARGETS, budget=2.5)
    assert mixed.columns == docs.columns
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    rates = {r.doc_id: r.rate for r in mixing.document_rates(docs, labelled, TARGETS, 2.5).collect()}
    for i, rate in rates.items():
        times = 2 if i == 3 else 1
        assert times * int(rate) <= counts.get(i, 0) <= times * (int(rate) + 1)
    size = {i: len((t or "").split()) for i, t, *_ in made}
    total = sum(size[i] * n for i, n in counts.items())
    assert total == pytest.approx(2.5 * sum(len((t or "").split()) for _, t, *_ in made), rel=0.15)


def test_few_or_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "", 0, 0.0), (2, "c", "", 0, 0.0)], KIND)
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {tuple(r.p) for r in mixing.document_rates(docs, none, {"x": 1, "y": 1}).collect()} == {(0.5, 0.5)}
    one = spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, domain string")
    assert all(r.p[0] > 0.99 for r in mixing.document_rates(docs, one, {"x": 1, "y": 0}).collect())
    assert mixing.document_rates(docs.limit(0), one, {"x": 1, "y": 1}).count() == 0
    assert mixing.mix(docs.limit(0), one, {"x": 1, "y": 1}).columns == docs.columns
    with pytest.raises(ValueError):
        mixing.document_rates(docs, one, {"x": 0})


def test_a_rare_domain_is_learnt_and_stays_rare(spark):
    rng = random.Random(8)
    kinds = ["toxic" if i % 500 == 0 else "good" for i in range(10_000)]
    made = [(i, " ".join(rng.choices(WORDS[k], k=30))) for i, k in enumerate(kinds)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labelled = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, domain string")
    model = mixing.classifier(docs, labelled, ["good", "toxic"], sample=60)
    got = mixing.memberships(docs, model, ["good", "toxic"]).collect()
    toxic = [r.p[1] for r in got if kinds[r.doc_id] == "toxic"]
    assert min(toxic) > np.mean([r.p[1] for r in got if kinds[r.doc_id] == "good"])
    assert np.mean([r.p[1] for r in got]) < 0.1
