import random
import re

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": ["the", "and", "with", "ing", "ness"], "de": ["ünd", "ëin", "nïcht", "schön", "für"]}


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted copies and labels, as a table folder."""
    rng, rows, labels = random.Random(12), [], []
    for i in range(300):
        lang = rng.choice(list(WORDS))
        mine = [*("".join(rng.choices(WORDS[lang], k=3)) for _ in range(rng.randrange(60, 400)))]
        kind = rng.choices(["good", "poor", "toxic"], [6, 2, 2])[0]
        mine += {"good": [], "poor": ["%%%"] * 30, "toxic": ["idiot", "scum"] * 8}[kind]
        rng.shuffle(mine)
        rows.append([i, " ".join(mine), lang if i % 9 else None, f"src{i % 4}", 0])
        labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    rows += [[400 + i, rows[i][1].replace(" ", "  "), "en", "copy", 0] for i in range(25)]
    for i in range(25, 45):  # near copies: one word of many
        words = rows[i][1].split(" ") * 4
        rows[i][1] = " ".join(words)
        words[rng.randrange(len(words))] = "swapped"
        rows.append([500 + i, " ".join(words), "en", "near", 0])
    rows += [[600, None, None, None, None], [601, "", "en", None, 0], [602, "123 456", "en", "", 0]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_every_stage(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept[k] = (before.collect(), docs.collect())
        if k < 4:
            assert docs.columns == before.columns, name
    # language: what has no letters goes, nothing else
    before, after = kept[0]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {600, 601, 602}
    assert all(r.lang in WORDS for r in after)
    # exact: one row of each text
    before, after = kept[1]
    plain = lambda r: re.sub(r"[\x20\x09-\x0D]+", "", r.text)
    assert len(after) == len({plain(r) for r in before}) == len({plain(r) for r in after})
    assert {r.doc_id for r in after} >= {400 + i for i in range(25)}  # the longer original stays
    # near: one document of each group that five-word shingles of Jaccard 0.8 or more link
    before, after = kept[2]
    sets = {r.doc_id: shingles(r.text) for r in before}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if group[j] < group[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    group[i], changed = group[j], True
    assert sorted(r.doc_id for r in after) == sorted(set(group.values()))
    assert sum(500 <= i < 600 for i in sets) - sum(500 <= r.doc_id < 600 for r in after) == 20
    # mixing: whole rows, some more than once, some not at all
    before, after = kept[3]
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert abs(sum(len(r.text.split()) for r in after) / sum(len(r.text.split()) for r in before) - 1) < 0.3
    # pieces: all rows, losslessly
    before, after = kept[4]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in after)


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "source", "lang", "pieces", "n_pieces", "lossless"]
    assert got.where("NOT lossless").isEmpty() and got.count() > 200
