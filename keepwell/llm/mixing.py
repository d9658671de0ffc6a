"""Mixing sources to target weights by soft membership. DataFrame functions only.

A multinomial logistic regression over hashed word frequencies, trained on a bounded sample of a
labelled table (about SAMPLE labelled documents, in equal parts for every domain, chosen by a hash of the
id and weighted by what each stands for, so that a rare domain is learnt and stays rare), gives every
document a probability per domain. Document rates, one each to begin with and never negative, are then
fitted by projected gradient so that the expected tokens of every domain, sum(rate * tokens *
probability), match target weight times budget in the least-squares sense. The gradient of a document
depends on the residuals only, one number per domain, scaled by the inverse of the domains' Gram
matrix over documents that still have a rate; so a step is a short vector, each pass is one aggregate
over the stored probabilities, and a rate is the fold of all steps, cut off at zero after each.

Defined cases: null texts count as empty, have no tokens and weigh nothing, their rate follows from
their probabilities; labels that are null or of an unknown domain, or whose document is missing, are
not learnt from; without any, all domains are equally likely; a domain that no label has gets no
probability; targets that no rates reach are approached for STEPS
passes, each nearer; repeated rows each count;
an empty table gives an empty result. `mix` keeps all columns of the table.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.store import fresh, in_sample, shared_folder, stored, text_of

SAMPLE = 10_000  # labelled documents learnt from, about
FEATURES, PASSES, PENALTY = 1 << 14, 40, 1e-2
STEPS, TOLERANCE = 60, 1e-6  # passes at most; largest miss of a share


def _features(rows: DataFrame) -> DataFrame:
    parts = Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\s+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=FEATURES),
        Normalizer(inputCol="_counts", outputCol="_shares", p=1.0)])
    return parts.fit(rows).transform(rows)  # none of them learns anything


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id",
               text_col: str = "text", sample: int = SAMPLE):
    """A fitted model, None without labelled documents; labelled: doc_id, domain."""
    order = F.create_map(*[F.lit(x) for k, d in enumerate(domains) for x in (d, float(k))])
    known = labelled.select(F.col("doc_id").alias("_labelled"), order[F.col("domain")].alias("_label"))
    known = known.where("_labelled IS NOT NULL AND _label IS NOT NULL")
    ids = docs.select(F.col(id_col).alias("_there"))
    known = known.distinct().join(ids, known["_labelled"] == ids["_there"], "left_semi")
    sizes = known.groupBy("_label").agg(F.count("*").alias("_n"))  # a row per domain at most
    each = max(1, sample // len(domains))
    chosen = known.join(F.broadcast(sizes), "_label").where(in_sample(F.col("_labelled"), each, F.col("_n"))).select(
        "_labelled", "_label", F.greatest(F.lit(1.0), F.col("_n") / each).alias("_weight"))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_labelled"))  # about sample rows
    rows = rows.select("_id", "_text", "_label", "_weight").dropDuplicates(["_id", "_label"])
    rows = stored(rows, shared_folder(docs.sparkSession), "labelled")
    if rows.isEmpty():
        return None
    return LogisticRegression(featuresCol="_shares", labelCol="_label", family="multinomial", maxIter=PASSES,
                              regParam=PENALTY, probabilityCol="_chances", weightCol="_weight").fit(
        _features(rows).select("_shares", "_label", "_weight"))


def memberships(docs: DataFrame, model, domains: list[str], id_col: str = "doc_id", text_col: str = "text"
                ) -> DataFrame:
    """doc_id, sig (hash of the text), tokens, p: array of probabilities in the order of domains."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("sig"),
                       text_of(text_col).alias("_text"))
    found = _features(rows)
    if model is None:
        p = F.array(*[F.lit(1.0 / len(domains))] * len(domains))
    else:
        found = model.transform(found).withColumn("_p", vector_to_array("_chances"))
        p = F.array(*[F.coalesce(F.get("_p", F.lit(k)), F.lit(0.0)) for k in range(len(domains))])
    tokens = F.size(F.filter("_words", lambda w: w != "")).cast("long")
    return found.select("doc_id", "sig", tokens.alias("tokens"), p.alias("p"))


def _rate(steps: list[list[float]]) -> Column:
    rate = F.lit(1.0)
    if not steps:
        return rate
    told = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])
    dot = lambda y: F.aggregate(F.zip_with("p", y, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(told, rate, lambda r, y: F.greatest(F.lit(0.0), r - dot(y)))


def _state(rows: DataFrame, steps: list[list[float]], k: int, total: float):
    """Share of the tokens in each domain at the rates of steps; Gram matrix of rows with a rate."""
    rated = rows.withColumn("_a", F.col("tokens") / F.lit(total)).withColumn("_r", _rate(steps))
    p = [F.get("p", F.lit(i)) for i in range(k)]
    on = F.when(F.col("_r") > 0, F.col("_a")).otherwise(0.0)
    sums = [F.sum(F.col("_a") * F.col("_r") * x) for x in p]
    grams = [F.sum(on * p[i] * p[j]) for i in range(k) for j in range(i + 1)]
    got = [x or 0.0 for x in rated.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums + grams)]).first()]
    gram = np.zeros((k, k))
    for n, (i, j) in enumerate((i, j) for i in range(k) for j in range(i + 1)):
        gram[i, j] = gram[j, i] = got[k + n]
    return np.array(got[:k]), gram


def fit_rates(rows: DataFrame, goal: list[float], passes: int = STEPS
              ) -> tuple[list[list[float]], list[float]]:
    """(steps, shares reached); rows: tokens, p; goal: expected tokens per domain over all tokens. Where
    even a fifth of a scaled step brings the shares no nearer, a plain gradient step does."""
    total = rows.agg(F.sum("tokens")).first()[0]
    if not total:
        return [], [0.0] * len(goal)
    want, steps, size, plain = np.array(goal), [], 1.0, False
    shares, gram = _state(rows, steps, len(goal), total)
    steepest = max(np.linalg.eigvalsh(gram).max(), 1e-300)  # every document has a rate to begin with
    for _ in range(passes):
        short = shares - want
        if np.abs(short).max() <= TOLERANCE:
            break
        step = short / steepest if plain else size * np.linalg.lstsq(gram, short, rcond=1e-12)[0]
        tried, next_gram = _state(rows, [*steps, step.tolist()], len(goal), total)
        if ((tried - want) ** 2).sum() < (short ** 2).sum() * (1.0 if plain else 1 - 1e-4):
            steps, shares, gram = [*steps, step.tolist()], tried, next_gram
            size, plain = min(1.0, 2 * size), False
        elif plain:
            break
        elif size < 0.2:
            size, plain = 1.0, True
        else:
            size /= 2
    return steps, shares.tolist()


def document_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sig, tokens, p, rate for every row; targets: weight of each domain, budget: tokens
    wanted over tokens there."""
    if not targets or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets need weights that are not negative and not all zero")
    domains = list(targets)
    model = classifier(docs, labelled, domains, id_col, text_col)
    rows = stored(memberships(docs, model, domains, id_col, text_col),
                  shared_folder(docs.sparkSession), "memberships")
    whole = sum(targets.values())
    steps, _ = fit_rates(rows, [budget * targets[d] / whole for d in domains])
    return rows.withColumn("rate", _rate(steps))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, each row as often as its rate says: the whole part, and once more where the hash of its id
    falls below the rest."""
    rates = document_rates(docs, labelled, targets, budget, id_col, text_col)
    of_id, of_sig, rate, sig, copy = (fresh(docs, c) for c in ("_of_id", "_of_sig", "_rate", "_text_sig", "_copy"))
    rates = rates.groupBy(F.col("doc_id").alias(of_id), F.col("sig").alias(of_sig)).agg(F.first("rate").alias(rate))
    unit = F.pmod(F.xxhash64(F.lit("mix"), F.col(of_id), F.col(of_sig)), F.lit(1 << 40)) / float(1 << 40)
    copies = (F.floor(rate) + (unit < F.col(rate) - F.floor(rate)).cast("long")).cast("int")
    rows = docs.withColumn(sig, F.xxhash64(text_of(text_col)))
    rows = rows.join(rates, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(sig) == F.col(of_sig)))
    often = F.when(copies > 0, F.sequence(F.lit(1), copies))
    return rows.withColumn(copy, F.explode(often)).select(*[rows[c] for c in docs.columns])


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain from the marks of a labels table: toxic, else good or poor by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(
        F.col("toxic").isNull(), None).when(F.col("quality") == 1, "good").when(
        F.col("quality") == 0, "poor").alias("domain"))
