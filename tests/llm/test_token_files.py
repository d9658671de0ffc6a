import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keepwell.llm import token_files
from keepwell.llm.store import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", " a", "a ", "  a  b ", "\n\nx  y\t z\n", "don't stop. it's 123,456 [x] é漢字 🙂 a b  c", "a\0 b",
       "<|endoftext|> hi <|endoftext|>", "ÀÉ, ñ; 'll x's", "a.b ,c", "x\x1c y", "x \x85 y", "Word.) (foo", "a..b ., . ,x",
       "a .b", "a.\nB c. \nD", "x\n\nY", "\nA", "A\n", ". a", ", b,c", "a\n.b", "é. f", "https://m.x.net/en/7,4.html ok",
       "1,234.5 x².", "SHOUT!! IT!! ### $$$", "tabs\tand | bars | x", None]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(library, monkeypatch):
    monkeypatch.setattr(token_files, "PIECE", 50)  # long texts are cut
    encoder = token_files.Encoder(PATH)
    texts = [t or "" for t in ODD] + [" ".join(t or "" for t in ODD * 3), "x" * 300 + " y" * 40]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [0]
    monkeypatch.setattr(token_files, "MEMO", 3)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [0]


def test_code_of_values():
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 5, 0, 7])
    sizes = np.array([10, 0, 2])
    control, data = token_files.pack(values, sizes)
    assert [len(c) for c in control] == [3, 0, 1]
    assert [len(d) for d in data] == [1 + 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4 + 1, 0, 2]
    back = token_files.unpack(np.frombuffer(b"".join(control), np.uint8),
                              np.frombuffer(b"".join(data), np.uint8), sizes)
    assert back.tolist() == values.tolist()


def test_files(spark, library):
    rows = [(97 - i, t, i) for i, t in enumerate(ODD)] + [(None, "no id", 0), (97, "again", 0), (97, "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file int").repartition(3)
    folder = shared_folder(spark)
    token_files.write(docs, PATH, folder)
    got = token_files.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    want = sorted((i is not None, i, library.encode(t or "", add_special_tokens=False).ids + [0])
                  for i, t, _ in rows)
    have = sorted((r.doc_id is not None, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert have == want
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4 for r in got)
    ranks = spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True)


def test_empty_table(spark):
    folder = shared_folder(spark)
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), PATH, folder)
    assert token_files.read(spark, folder).count() == 0
