import random

from keepwell.llm import similar

KIND = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(texts):
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = 0
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and (a == b or len(a & b) >= 0.8 * len(a | b)):
                pairs += 1
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in up}, pairs


def test_every_pair_from_the_least_similarity_up(spark):
    rng = random.Random(4)
    word = lambda: f"t{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]  # a third of the texts share it
    texts = []
    for k in range(70):
        base = [word() for _ in range(rng.randrange(20, 400))] + passage * (k % 3 == 0)
        texts.append(base)
        for _ in range(3):  # from far above the least similarity to below it
            copy = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    star = [word() for _ in range(120)]
    texts += [star[:k] + [word()] + star[k + 1:] for k in range(60)]  # one large group
    texts = [" ".join(t) for t in texts] + ["", None, " \n", "one two", "One  two", "three"]
    want, pairs = slow_components(dict(enumerate(texts)))
    assert pairs > 500
    docs = spark.createDataFrame(list(enumerate(texts)), KIND).repartition(3)
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()} == want
    kept = similar.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert similar.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_stage(spark):
    import corpus_pipeline

    rng = random.Random(8)
    base = [[f"t{rng.randrange(3000)}" for _ in range(200)] for _ in range(40)]
    copies = []
    for t in base:
        copy = list(t)
        for k in (30, 90, 150):  # 15 of 196 shingles: similarity 181 / 211
            copy[k] = "changed"
        copies.append(copy)
    docs = spark.createDataFrame(list(enumerate(" ".join(t) for t in base + copies)), KIND)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(range(40))


def test_one_row_of_each_component_whatever_the_ids(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"t{rng.randrange(4000)}" for _ in range(300)) for _ in range(4))
    rows = [(1, a), (1, b), (0, b + " "), (5, a), (1, a), (None, c), (None, c + "  "), (None, d), (7, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text.strip()) for r in similar.drop_near_duplicates(docs).collect())
    assert got == sorted([(1, a), (-1, b), (-1, c), (7, d)])


def test_pairs_of_a_group_are_few(spark, monkeypatch):
    """Texts that all link to each other, but not to the least one, cost no comparison per pair."""
    rng = random.Random(11)
    word = lambda: f"t{rng.randrange(3000)}"
    base, asked = [word() for _ in range(200)], []
    texts = []
    for k in range(120):
        copy = list(base)
        for at in rng.sample(range(5, 195, 5), 2 + k % 2):  # two copies: 176 / 216 shingles; one with three: 171 / 221
            copy[at] = f"own{k}x{at}"
        texts.append(" ".join(copy))
    confirmed = similar._confirmed
    monkeypatch.setattr(similar, "_confirmed", lambda pairs, *more: asked.append(pairs.count()) or confirmed(pairs, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), KIND)
    want, pairs = slow_components(dict(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()} == want
    assert pairs > 1000 and sum(asked[1:]) < 400


def test_bitmaps_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (5, 40, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 9:], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        apart = np.bitwise_count(similar.bitmap(a) ^ similar.bitmap(b)).sum()
        assert apart <= len(np.setxor1d(a, b))
