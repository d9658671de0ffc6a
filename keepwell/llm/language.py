"""Language identification by a convolutional network over bytes, trained here in numpy.

Lower-cased text is read as UTF-8 in windows of WINDOW bytes. Filters of several widths slide over the
bytes (a filter is one weight per byte value and place), each keeps its largest response in the
window, and a softmax over those gives the language. A document's probabilities are the means over
all of its windows, weighted by their bytes. The network learns from a bounded sample of the labelled
texts: about SAMPLE of them in equal parts for every language, but never fewer than about LEAST of a language (all,
if there are fewer), chosen by a hash of the text, copies once, two pieces of a text each. So a language that is rare
is learnt from tables of every size.

Defined cases: null texts and texts without a letter are "und" with score 0; without labelled rows
every text is; repeated rows each get their prediction; rows with a null id are never learnt from; an
empty table gives an empty result; very long texts are read whole, window by window; languages of equal
probability go to the first in order; a text under two labels is learnt under both; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.store import fresh, in_sample, text_of

UNKNOWN = "und"
WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 16
SAMPLE = 6000  # labelled texts learnt from, about
LEAST = 200  # of each language, about, where there are as many
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.02, 11
_TOGETHER = 64  # windows convolved at once


@dataclass
class Model:
    languages: list[str]
    filters: list[np.ndarray]  # per width: (width, 256, FILTERS)
    weights: np.ndarray  # (all filters, languages)
    bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of every filter per window, and the place it has it."""
        most, where = [], []
        for table in self.filters:
            width = len(table)
            n = windows.shape[1] - width + 1
            total = table[0][windows[:, :n]]
            for k in range(1, width):
                total += table[k][windows[:, k:k + n]]
            at = total.argmax(axis=1)
            where.append(at)
            most.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0])
        return np.maximum(np.concatenate(most, axis=1), 0), where

    def largest(self, windows: np.ndarray) -> np.ndarray:
        """responses without the places."""
        out = np.empty((len(windows), FILTERS * len(self.filters)), np.float32)
        for i, table in enumerate(self.filters):
            n = windows.shape[1] - len(table) + 1
            total = np.take(table[0], windows[:, :n], axis=0)
            for k in range(1, len(table)):
                total += np.take(table[k], windows[:, k:k + n], axis=0)
            total.max(axis=1, out=out[:, i * FILTERS:(i + 1) * FILTERS])
        return np.maximum(out, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [softmax(self.largest(windows[at:at + _TOGETHER]) @ self.weights + self.bias)
                 for at in range(0, len(windows), _TOGETHER)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def as_windows(raw: bytes) -> np.ndarray:
    """Consecutive windows of one text, the last one filled up with zero bytes."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def fit(pieces: list[str], labels: list[str]) -> Model:
    """A network trained on one window of each piece; the same pieces give the same network."""
    rng = np.random.default_rng(SEED)
    languages = sorted(set(labels))
    x = np.concatenate([as_windows(p.lower().encode()[:WINDOW]) for p in pieces])
    y = np.searchsorted(languages, labels)
    k, hidden = len(languages), FILTERS * len(WIDTHS)
    model = Model(languages, [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
                  rng.normal(0, 0.1, (hidden, k)).astype(np.float32), np.zeros(k, np.float32))
    share = len(y) / (k * np.bincount(y, minlength=k).clip(1))  # rare languages weigh as much in all
    knobs = [*model.filters, model.weights, model.bias]
    first, second, step = [np.zeros_like(p) for p in knobs], [np.zeros_like(p) for p in knobs], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            pick = order[at:at + BATCH]
            h, where = model.responses(x[pick])
            error = softmax(h @ model.weights + model.bias)
            error[np.arange(len(pick)), y[pick]] -= 1
            error *= (share[y[pick]] / len(pick))[:, None]
            back = (error @ model.weights.T) * (h > 0)
            slopes = []
            for i, place in enumerate(where):
                slope = np.zeros_like(model.filters[i])
                part = back[:, i * FILTERS:(i + 1) * FILTERS]
                for j in range(len(slope)):
                    value = np.take_along_axis(x[pick], place + j, axis=1)
                    np.add.at(slope[j], (value, np.arange(FILTERS)[None, :]), part)
                slopes.append(slope)
            slopes += [h.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(knobs, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9 ** step)) / (
                    np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          sample: int = SAMPLE) -> Model | None:
    """Learns from labelled rows that are not held out; None if there are none."""
    text, label = F.col(text_col), F.col(label_col)
    room = F.greatest(F.length(text) - WINDOW, F.lit(1))
    labelled = docs.where(label.isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & text.rlike(r"\p{L}")).select(
        F.xxhash64(text).alias("h"), label.alias("label"), F.substring(text, 1, WINDOW).alias("head"),
        F.substring(text, (F.pmod(F.xxhash64(text), room) + 1).cast("int"), F.lit(WINDOW)).alias("mid"))
    texts = {r.label: r.n for r in labelled.groupBy("label").agg(  # one row per language, as the model has
        F.approx_count_distinct("h").alias("n")).collect()}
    if not texts:
        return None
    each = max(LEAST, sample // len(texts))
    there = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[F.col("label")]
    rows = labelled.where(in_sample(F.col("h"), each, there)).distinct().sort("h", "label", "head", "mid").collect()
    if not rows:
        return None
    return fit([r.head for r in rows] + [r.mid for r in rows], [r.label for r in rows] * 2)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((batch.num_rows, len(model.languages)))
            size = np.zeros(batch.num_rows)
            for windows, owner, used in _grouped(batch.column("text")):
                np.add.at(sums, owner, model.probabilities(windows) * used[:, None])
                np.add.at(size, owner, used)
            means = sums / np.maximum(size, 1)[:, None]
            best = means.argmax(axis=1)
            known = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            keep = [c for c in batch.schema.names if c not in ("text", "letters")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array([model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], pa.string()),
                   pa.array(np.where(known, means[np.arange(len(best)), best].clip(0, 1), 0.0))],
                names=keep + ["lang_pred", "score"])

    return run


def _grouped(texts: pa.Array, together: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of many texts with the text each belongs to and its bytes, a bounded number at once."""
    windows, owner, used, n = [], [], [], 0
    for i, text in enumerate(texts):
        raw = text.as_py().lower().encode()
        part = as_windows(raw)
        bytes_used = np.full(len(part), WINDOW)
        bytes_used[-1] = max(1, len(raw) - WINDOW * (len(part) - 1))
        for at in range(0, len(part), together):
            windows.append(part[at:at + together])
            used.append(bytes_used[at:at + together])
            owner.append(np.full(len(used[-1]), i))
            n += len(used[-1])
            if n >= together:
                yield np.concatenate(windows), np.concatenate(owner), np.concatenate(used)
                windows, owner, used, n = [], [], [], 0
    if n:
        yield np.concatenate(windows), np.concatenate(owner), np.concatenate(used)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
            ) -> DataFrame:
    """doc_id, sig (hash of the text), held_out, lang_pred, score for every row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("sig"),
        held_out(id_col).alias("held_out"), text_of(text_col).alias("text"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", "sig", "held_out", F.lit(UNKNOWN).alias("lang_pred"),
                           F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict(model), "doc_id long, sig long, held_out boolean, "
                           "lang_pred string, score double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "lang", least: float = 0.5) -> DataFrame:
    """docs without texts whose language cannot be told: "und", or a score below least. All columns
    stay; a label that is missing is filled with the prediction."""
    found = predict(docs, train(docs, id_col, text_col, label_col), id_col, text_col)
    pred, of_id, of_sig, sig = (fresh(docs, c) for c in ("_pred", "_of_id", "_of_sig", "_text_sig"))
    found = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).groupBy(
        F.col("doc_id").alias(of_id), F.col("sig").alias(of_sig)).agg(F.first("lang_pred").alias(pred))
    rows = docs.withColumn(sig, F.xxhash64(text_of(text_col)))
    kept = rows.join(found, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(sig) == F.col(of_sig)))
    return kept.select(*[F.coalesce(label_col, pred).alias(c) if c == label_col else rows[c]
                         for c in docs.columns])
