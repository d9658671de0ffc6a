"""Columns of the input whose names the operators could need themselves, and ids that are no longs."""

import pytest
from pyspark.sql import functions as F

from keepwell.llm import exact, language, mixing, simhash

CLASHING = ("_sig", "_text_sig", "_rate", "_kept_id", "_of_id", "_of_sig", "_pred", "_copy", "gone_id", "sig", "component")


@pytest.fixture(scope="module")
def docs(spark):
    words = {"en": "the quick brown fox jumps over the lazy dog", "de": "der schnelle braune Fuchs springt über den faulen Hund"}
    rows = [(i, words[lang] + f" {i}" * 3, lang) for i in range(40) for lang in [("en", "de")[i % 2]]]
    rows += [(50, rows[0][1], "en"), (51, rows[1][1] + " ", "de")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    return df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})


def untouched(df, docs):
    assert df.columns == docs.columns
    for r in df.collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHING)


def test_columns_stay_as_they_are(spark, docs):
    one = exact.drop_exact_duplicates(docs)
    untouched(one, docs)
    assert one.count() == 40
    untouched(simhash.drop_near_duplicates(docs), docs)
    kept = language.keep_identified(docs, least=0.1)
    untouched(kept, docs)
    assert kept.count() == 42
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "good").otherwise("poor").alias("domain"))
    untouched(mixing.mix(docs, labels, {"good": 0.5, "poor": 0.5}), docs)
