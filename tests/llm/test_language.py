import random
import zlib

import numpy as np
import pytest

from keepwell.llm import language

KIND = "doc_id long, text string, lang string, score string"
WORDS = {"aa": ["the", "and", "with", "from", "ing"], "bb": ["ünd", "ëin", "nïcht", "schön", "für"],
         "cc": ["qué", "por", "ción", "los", "ñas"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, lang, rng.choice([3, 30, 900])), lang, None)
            for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(400))]
    rows += [(1000, None, "aa", "x"), (1001, "", None, "x"), (1002, "12 345 !!", "bb", None),
             (None, sentence(rng, "cc", 50), "cc", None), (1003, sentence(rng, "bb", 9), None, None)]
    return spark.createDataFrame(rows + rows[:3], KIND)


def test_held_out_accuracy_and_odd_rows(docs):
    got = language.predict(docs, language.train(docs)).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = [r for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    test = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in test]) > 0.97
    odd = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)}
    assert set(odd.values()) == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got}[1003] == "bb"
    assert {r.doc_id: r.lang_pred for r in got}[None] == "cc"


def test_prediction_reads_the_whole_text(docs):
    model = language.train(docs)
    rng = random.Random(9)
    text = sentence(rng, "aa", 60) + " " + sentence(rng, "bb", 6000)
    parts = list(language._grouped([type("T", (), {"as_py": lambda s: text})()], together=7))
    windows = np.concatenate([p[0] for p in parts])
    assert b"".join(w.tobytes() for w in windows).rstrip(b"\0") == text.lower().encode()
    assert max(len(p[0]) for p in parts) <= 7
    assert model.languages[int(model.probabilities(windows).mean(axis=0).argmax())] == "bb"


def test_fast_and_training_responses_agree(docs):
    model = language.train(docs)
    windows = language.as_windows(b"the and with " * 200)
    assert np.allclose(model.responses(windows)[0], model.largest(windows), atol=1e-5)


def test_stage_keeps_what_has_a_language(docs):
    kept = language.keep_identified(docs, least=0.4)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1000, 1001, 1002}.isdisjoint(ids) and {1003, None} <= set(ids)
    assert len(ids) >= 400
    assert {r.doc_id: r.lang for r in kept.collect()}[1003] == "bb"


def test_without_labels(spark):
    none = spark.createDataFrame([], KIND)
    assert language.train(none) is None and language.predict(none, None).count() == 0
    one = spark.createDataFrame([(1, "abc", None, None)], KIND)
    assert language.predict(one, language.train(one)).first().lang_pred == "und"
    same = spark.createDataFrame([(2, "abc", "xx", None), (3, "abd", "xx", None), (4, "q", "xx", None)], KIND)
    assert {r.lang_pred for r in language.predict(same, language.train(same)).collect()} == {"xx"}


def test_a_rare_language_is_learnt(spark):
    """One text in 400 is labelled zz; a uniform sample of 200 would hold half a text of it."""
    words = {"aa": "lorem ipsum dolor sit amet", "zz": "qwx zzyk vuuq xxaj"}
    rows = [(i, f"{words['zz' if i % 400 == 1 else 'aa']} {i}", "zz" if i % 400 == 1 else "aa") for i in range(20_000)]
    rows += [(100_000 + i, words["aa"], "aa") for i in range(8_000)]  # copies are one text
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, sample=200)
    got = language.predict(docs.where("lang = 'zz'"), model)
    assert model.languages == ["aa", "zz"] and got.where("lang_pred <> 'zz'").isEmpty()


def test_responses_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    model = language.fit(["some words here", "otras palabras"] * 4, ["en", "es"] * 4)
    x = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    got, _ = model.responses(x)
    for n, row in enumerate(x):
        want = [max(0.0, max(sum(float(filters[j, row[at + j], f]) for j in range(len(filters)))
                             for at in range(len(row) - len(filters) + 1)))
                for filters in model.filters for f in range(language.FILTERS)]
        assert np.abs(got[n] - want).max() < 1e-4
