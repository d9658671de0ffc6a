import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from keepwell.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", " a", "a ", "  a  b ", "\n\nx  y\t z\n", "     five", "don't", "é漢字 🙂 a\0b  c", "x" * 200 + " the the",
       "<0x0A> <s> </s> <unk>", "\0 a  b", "A" + " " * 37 + "b", "averyverylongword" * 9 + " one end", "1,234.5 ﬁ ÀÉ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encoded(rate, texts, seed=0, docs=None):
    e = pieces.Encoder(PATH, rate, seed)
    return e, list(e.encode(texts, np.array(docs or range(len(texts)), np.uint64)))


def test_without_dropout_the_library_agrees(library):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(ODD) + rng.choice("abé \n.,") for _ in range(30)) for _ in range(20)]
    for text, ids in zip(texts, encoded(0.0, texts)[1]):
        assert ids.tolist() == library.encode(text)


def test_dropout_varies_and_decodes(monkeypatch):
    texts = ODD + ["▁x ▁", "the remarkable internationalization of everything " * 40]
    monkeypatch.setattr(pieces, "PIECE", 70)
    e, ids = encoded(0.2, texts, 5)
    for text, got in zip(texts, ids):
        assert pieces.decode(e.v, got).decode() == text
    again = encoded(0.2, texts, 5)[1]
    assert all((a == b).all() for a, b in zip(ids, again))
    assert ids[-1].tolist() != encoded(0.2, texts, 6)[1][-1].tolist()
    assert len(ids[-1]) > len(encoded(0.0, texts)[1][-1])
    seen = set()
    for doc in range(20):
        seen.add(tuple(encoded(0.2, ["internationalization"], 5, [doc])[1][0].tolist()))
    assert len(seen) > 2


def test_side_by_side_is_the_agenda():
    e = pieces.Encoder(PATH, 0.3, 1)
    rng = random.Random(1)
    for _ in range(300):
        word = " " + "".join(rng.choice("etaoinshré漢▁") for _ in range(rng.randrange(0, 24)))
        key, symbols = e._word_keys([word]), e.v.symbol[pieces._codes([word])].astype(np.int64)
        out = pieces.segment_together(e.v, symbols[None, :], key, 0.3)[0]
        assert out.tolist() == pieces.segment_by_heap(e.v, symbols.tolist(), int(key[0]), 0.3)


def test_tables(spark):
    rows = [(i, t, "s", [i]) for i, t in enumerate([*ODD, None])] + [(3, ODD[3], "s", None), (None, "x y", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, pieces array<int>")
    ids = pieces.encode(docs.select("doc_id", "text", "pieces"), PATH, keep=("doc_id",), seed=2)
    back = pieces.decoded(ids, PATH).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((i, t or "") for i, t, *_ in rows), key=key)
    both = pieces.encode(docs, PATH, seed=2, back=True).collect()
    assert sorted(((r.doc_id, r.decoded) for r in both), key=key) == sorted(((i, t or "") for i, t, *_ in rows), key=key)
    assert pieces.decoded(pieces.encode(docs.limit(0), PATH), PATH).count() == 0


def test_every_occurrence_drops_on_its_own():
    e = pieces.Encoder(PATH, 0.1, 3)
    texts = [" ".join(["a", "everything", "remarkable"] * 700)] * 10
    plain = {w: encoded(0.0, [w])[1][0].tolist() for w in ("a", "everything", "remarkable")}
    count, seen = {w: [0, 0] for w in plain}, {w: set() for w in plain}
    for doc, text in enumerate(texts):
        numbers = e._numbers(" " + text)
        ids = list(e.encode([text], np.array([doc], np.uint64)))[0].tolist()
        at = 0
        for k, word in enumerate(e.words.names[n].strip() for n in numbers):
            size = 1
            while pieces.decode(e.v, np.array(ids[at:at + size])).decode().strip() != word:
                size += 1
            count[word][0] += ids[at:at + size] != plain[word]
            count[word][1] += 1
            seen[word].add(tuple(ids[at:at + size]))
            at += size
        assert at == len(ids)
    assert len(plain["a"]) == 1  # one candidate, of the space and the letter
    assert abs(count["a"][0] / count["a"][1] - 0.1) < 0.015
    assert len(seen["everything"]) > 8 and len(seen["remarkable"]) > 8


def test_an_occurrence_is_the_agenda_under_its_key():
    words = ["internationalization", "everything", "the", "漢it", "averyverylongword" * 4] * 40
    e, (ids,) = encoded(0.2, [" ".join(words)], 9, [77])
    place = np.arange(len(words), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    want = []
    for word, at in zip(words, pieces.mixed(place ^ np.uint64(77))):
        key = int(pieces.mixed(e._word_keys([" " + word]) ^ at)[0])
        out = pieces.segment_by_heap(e.v, e.v.symbol[pieces._codes([" " + word])].tolist(), key, 0.2)
        want += e._spelled(" " + word, [x if x > -3 else -3 - x for x in out]).tolist()
    assert ids.tolist() == want
