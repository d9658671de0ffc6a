"""SentencePiece encoding with seeded merge-dropout, and decoding.

The pieces, scores and byte fallback are those of a public merge-type model. Symbols begin as single
characters; of all neighbours that form a piece the best-scored, leftmost pair merges first. Each
candidate (its place in the word, left and right piece) is skipped for good where a hash of it under
a key falls below the dropout rate, so one text gets varied segmentations that all decode to it; at
rate 0 the result is the library's own. No piece has a space behind another character, so words are
segmented on their own: every occurrence has a key, made of the seed, the document, the place and the
word. What a word gives without dropout is remembered with the candidates that merge on the way; an
occurrence whose key drops none of them takes it, every other one is segmented anew under its key.
Short words are merged side by side in numpy, one merge of every word at a time; long ones by a heap.

Defined cases: null and empty texts have no pieces; characters outside the vocabulary, the space sign
U+2581 among them, become bytes and come back as they were; repeated rows get the same pieces; an
empty table gives an empty result; very long texts are taken piece by piece; decoding ids that do not
spell UTF-8 gives replacement characters; other columns are not looked at.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.store import text_of

SPACE = "▁"
DROPOUT = 0.1
MEMO = 200_000  # distinct words a worker remembers, about
SHORT = 48  # characters of a word that is merged side by side
PIECE = 1 << 20
_CUT = re.compile(r"(?<=[^ ])(?= )")
_MASK = 2 ** 64 - 1


def mixed(x):
    """A well-mixed 64-bit value, of an int or of an array of unsigned longs."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


class Vocabulary:
    """The pieces of a model and a hash table from (left, right) to the piece they form."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        names = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.char = {p: i for p, i in names.items() if len(p) == 1}
        self.char[" "] = self.char.pop(SPACE)
        # symbols of characters: a piece, for other ASCII -3 minus its byte piece, for the rest -1
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[:128] = -3 - np.array(self.byte[:128])
        for c, i in self.char.items():
            self.symbol[ord(c)] = i
        self.bytes_of = [b""] * n
        for p, i in names.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.bytes_of[i] = bytes([b])
        size = np.array([len(b) for b in self.bytes_of])
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        self.spelled = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        order = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in names.values()}))}
        pairs = {}
        for p, i in names.items():
            if re.search(rf"[^{SPACE}]{SPACE}", p):
                raise ValueError("a piece spans words")
            for k in range(1, len(p)):
                left, right = names.get(p[:k]), names.get(p[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (i, order[model.get_score(i)] + 1)
        self.pairs = pairs
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.forms, self.rank = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.probes = 1
        for key, (i, rank) in pairs.items():
            at, tries = (key * 0x9E3779B97F4A7C15 & _MASK) >> int(self.shift), 1
            while self.keys[at] != -1:
                at, tries = at + 1 & (1 << bits) - 1, tries + 1
            self.keys[at], self.forms[at], self.rank[at] = key, i, rank
            self.probes = max(self.probes, tries)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, rank) that each pair forms; rank 0 for none. Negative sides form nothing."""
        key = left.astype(np.int64) << 32 | right
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        form, rank = np.zeros(len(key), np.int32), np.zeros(len(key), np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            here = at[open_]
            hit = self.keys[here] == key[open_]
            form[open_[hit]], rank[open_[hit]] = self.forms[here[hit]], self.rank[here[hit]]
            open_ = open_[~hit & (self.keys[here] != -1)]
            if not len(open_):
                break
            at[open_] = at[open_] + 1 & len(self.keys) - 1
        return form, rank


def _codes(words: list[str]) -> np.ndarray:
    """The code points of all words, one after the other."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)


def candidate(place, left, right):
    """The hash of a candidate that keys are combined with."""
    return mixed(place << 40 ^ left << 20 ^ right)


def skipped(key, place, left, right, rate: float):
    """Whether the candidate at place is dropped."""
    return mixed(key ^ candidate(place, left, right)) < int(rate * 2 ** 64)


def segment_by_heap(v: Vocabulary, symbols: list[int], key: int, rate: float,
                    trace: list | None = None) -> list[int]:
    """Pieces of one word from its symbols (negative: outside the vocabulary), agenda-wise: the
    places that merged into the one before hold -2; trace gets the candidates that merge."""
    ids, n = list(symbols), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = []

    def offer(p: int) -> None:
        q = after[p]
        if p >= 0 and q < n and ids[p] >= 0 and ids[q] >= 0:
            found = v.pairs.get(ids[p] << 32 | ids[q])
            if found:
                heapq.heappush(agenda, (-found[1], p, ids[p], ids[q], found[0]))

    for p in range(n - 1):
        offer(p)
    while agenda:
        _, p, left, right, piece = heapq.heappop(agenda)
        q = after[p]
        if ids[p] != left or q >= n or ids[q] != right or skipped(key, p, left, right, rate):
            continue
        if trace is not None:
            trace.append(candidate(p, left, right))
        ids[p], ids[q] = piece, -2
        after[p] = after[q]
        if after[p] < n:
            before[after[p]] = p
        offer(p)
        if before[p] >= 0:
            offer(before[p])
    return ids


def segment_together(v: Vocabulary, symbols: np.ndarray, keys: np.ndarray, rate: float,
                     trace: list | None = None) -> np.ndarray:
    """The same for many words at once; symbols: (words, places), filled up with -1. Merged-away places
    of the result hold -2; trace gets pairs of arrays (word, candidate)."""
    n, width = symbols.shape
    ids = np.full((n, width + 2), -1, np.int64)  # a place before and one after every word
    ids[:, 1:-1] = symbols
    after = np.tile(np.arange(1, width + 3), (n, 1))
    before = np.tile(np.arange(-1, width + 1), (n, 1))
    form, rank = np.zeros((n, width + 2), np.int32), np.zeros((n, width + 2), np.int32)

    def offer(row: np.ndarray, p: np.ndarray) -> None:
        left, right = ids[row, p], ids[row, np.minimum(after[row, p], width + 1)]
        piece, value = v.look_up(left, right)
        some = np.flatnonzero(value)
        drop = skipped(keys[row[some]], (p[some] - 1).astype(np.uint64), left[some].astype(np.uint64),
                       right[some].astype(np.uint64), rate)
        value[some[drop]] = 0
        form[row, p], rank[row, p] = piece, value

    row, p = np.nonzero((ids[:, :-1] >= 0) & (ids[:, 1:] >= 0))
    offer(row, p)
    live = np.arange(n)
    while True:
        p = rank[live].argmax(axis=1)
        some = rank[live, p] > 0
        live, p = live[some], p[some]
        if not len(live):
            break
        q = after[live, p]
        nxt = after[live, q]
        if trace is not None:
            trace.append((live, candidate(*(x.astype(np.uint64) for x in (p - 1, ids[live, p], ids[live, q])))))
        ids[live, p], ids[live, q] = form[live, p], -2
        rank[live, q] = 0
        after[live, p], before[live, nxt] = nxt, p
        prior = before[live, p]
        offer(np.concatenate([live, live]), np.concatenate([p, prior]))
    return ids[:, 1:-1]


class _Words(dict):
    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.names.append(word)
        return at


class Encoder:
    """Whole texts to piece ids."""

    def __init__(self, path: str, rate: float = DROPOUT, seed: int = 0):
        self.v, self.rate, self.seed = Vocabulary(path), rate, seed
        self.clear()

    def clear(self) -> None:
        self.words = _Words()
        self.words.names = []
        self.keys = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pieces = np.zeros(0, np.int32)
        self.first, self.merges = np.zeros(0, np.int64), np.zeros(0, np.int32)  # into candidates
        self.candidates = np.zeros(0, np.uint64)

    def _numbers(self, text: str) -> np.ndarray:
        found, at = [], 0
        while at < len(text):
            to = len(text)
            if to - at > PIECE:
                cut = _CUT.search(text, at + PIECE)
                to = cut.start() if cut else to
            part = text[at:to]
            at = to
            words = part.replace(" ", "\0 ").split("\0")[1:]
            if "\0" in part or " " in words or not part.startswith(" "):
                words = _CUT.split(part)
            found.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _word_keys(self, words: list[str]) -> np.ndarray:
        """A hash under the seed of every word: the sum of those of its characters at their places."""
        length = np.array([len(w) for w in words], np.int64)
        codes = _codes(words).astype(np.uint64)
        begin = np.cumsum(length) - length
        place = (np.arange(len(codes)) - np.repeat(begin, length)).astype(np.uint64)
        total = np.zeros(len(words) + 1, np.uint64)
        total[1:] = np.cumsum(mixed(codes << np.uint64(32) ^ place), dtype=np.uint64)[begin + length - 1] if len(
            codes) else 0
        return mixed(np.diff(total) ^ np.uint64(self.seed << 32 & _MASK))

    def _learn(self) -> None:
        """Segments new words without dropout and keeps the candidates that merge."""
        known = len(self.keys)
        new = self.words.names[known:]
        if not new:
            return
        keys, trace = self._word_keys(new), []
        start, size, pieces = self._segment(new, keys, 0.0, trace)
        self.keys = np.concatenate([self.keys, keys])
        self.start = np.concatenate([self.start, start + len(self.pieces)])
        self.size = np.concatenate([self.size, size])
        self.pieces = np.concatenate([self.pieces, pieces])
        word = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in trace)])
        merged = np.concatenate([np.zeros(0, np.uint64), *(c for _, c in trace)])[np.argsort(word, kind="stable")]
        merges = np.bincount(word, minlength=len(new)).astype(np.int32)
        self.first = np.concatenate([self.first, len(self.candidates) + np.cumsum(merges, dtype=np.int64) - merges])
        self.merges = np.concatenate([self.merges, merges])
        self.candidates = np.concatenate([self.candidates, merged])

    def _segment(self, words: list[str], keys: np.ndarray, rate: float, trace: list | None = None):
        """(start, size, pieces) of words under keys; trace gets pairs of arrays (word, candidate)."""
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        length = np.array([len(w) for w in words])
        made: list[np.ndarray] = [np.zeros(0, np.int32)]
        held = 0

        def spell(at: int, out) -> None:
            nonlocal held
            flat = self._spelled(words[at], out)
            start[at], size[at] = held, len(flat)
            made.append(flat)
            held += len(flat)

        for low, high in ((0, 8), (8, 12), (12, 20), (20, SHORT)):
            group = np.flatnonzero((length > low) & (length <= high))
            for at in range(0, len(group), 20_000):
                part = group[at:at + 20_000]
                symbols = np.full((len(part), high), -1, np.int64)
                inside = np.arange(high) < length[part][:, None]
                symbols[inside] = self.v.symbol[_codes([words[i] for i in part])]
                steps = None if trace is None else []
                out = segment_together(self.v, symbols, keys[part], rate, steps)
                if steps:
                    trace += [(part[w], c) for w, c in steps]
                keep = inside & (out != -2)
                counts, flat = keep.sum(axis=1), out[keep]
                flat = np.where(flat < -2, -3 - flat, flat)
                start[part], size[part] = held + np.cumsum(counts) - counts, counts
                made.append(flat.astype(np.int32))
                held += len(flat)
                for k in np.flatnonzero(((out == -1) & inside).any(axis=1)):
                    spell(part[k], out[k, :length[part[k]]])
        for i in np.flatnonzero(length > SHORT):
            symbols = self.v.symbol[_codes([words[i]])].tolist()
            steps = None if trace is None else []
            spell(i, segment_by_heap(self.v, symbols, int(keys[i]), rate, steps))
            if steps:
                trace.append((np.full(len(steps), i), np.array(steps, np.uint64)))
        return start, size, np.concatenate(made)

    def _spelled(self, word: str, out) -> np.ndarray:
        """The pieces of a word whose odd characters become bytes; out: a piece or mark per character."""
        flat: list[int] = []
        for c, piece in zip(word, out):
            if piece >= 0:
                flat.append(piece)
            elif piece != -2:
                flat += [self.v.byte[b] for b in c.encode()]
        return np.array(flat, np.int32)

    def _dropped(self, numbers: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Positions of the occurrences that drop a candidate which merges without dropout."""
        hit = np.zeros(len(numbers), bool)
        for at in range(0, len(numbers), 50_000):
            part = numbers[at:at + 50_000]
            count = self.merges[part]
            ends = np.cumsum(count, dtype=np.int64)
            where = np.arange(ends[-1]) + np.repeat(self.first[part] - ends + count, count)
            of = np.repeat(np.arange(at, at + len(part)), count)
            hit[of[mixed(keys[of] ^ self.candidates[where]) < int(self.rate * 2 ** 64)]] = True
        return np.flatnonzero(hit)

    def encode(self, texts: list[str], documents: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each text; documents: unsigned longs that tell them apart."""
        waiting, held = [], 0
        for text, doc in zip(texts, documents):
            numbers = self._numbers(" " + text if text else "")
            place = np.arange(len(numbers), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            waiting.append((numbers, mixed(place ^ np.uint64(doc))))
            held += len(numbers)
            if held > 300_000:
                yield from self._ids(waiting)
                waiting, held = [], 0
                if len(self.words) > MEMO:
                    self.clear()
        yield from self._ids(waiting)
        if len(self.words) > MEMO:
            self.clear()

    def _ids(self, waiting: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        if not waiting:
            return
        numbers = np.concatenate([n for n, _ in waiting])
        self._learn()
        begin, size, pieces = self.start[numbers], self.size[numbers], self.pieces
        if self.rate > 0:
            keys = mixed(self.keys[numbers] ^ np.concatenate([k for _, k in waiting]))
            anew = self._dropped(numbers, keys)
            words = [self.words.names[i] for i in numbers[anew]]
            start, size[anew], more = self._segment(words, keys[anew], self.rate)
            begin[anew] = start + len(pieces)
            pieces = np.concatenate([pieces, more])
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = pieces[np.arange(total) + np.repeat(begin - ends + size, size)]
        upto = np.concatenate([[0], ends])[np.cumsum([0, *(len(n) for n, _ in waiting)])]
        for a, b in zip(upto, upto[1:]):
            yield ids[a:b]


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text that ids spell; the space that begins every encoded text is taken off."""
    begin, end = v.offsets[ids], v.offsets[ids + 1]
    size = end - begin
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    raw = v.spelled[np.arange(total) + np.repeat(begin - ends + size, size)].tobytes()
    return raw[1:] if raw[:1] == b" " else raw


@functools.lru_cache(maxsize=1)
def _encoder(path: str, rate: float, seed: int) -> Encoder:
    return Encoder(path, rate, seed)


@functools.lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode(path: str, rate: float, seed: int, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, rate, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                docs = part.column("_document").to_numpy().view(np.uint64)
                ids = list(encoder.encode(part.column("_text").to_pylist(), docs))
                lists = pa.ListArray.from_arrays(
                    np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate(ids).astype(np.int32))
                names = [c for c in part.schema.names if c not in ("_document", "_text")]
                found = [part.column(c) for c in names] + [lists]
                if back:
                    found.append(pa.array([decode(encoder.v, x).decode("utf-8", "replace") for x in ids],
                                          pa.string()))
                yield pa.RecordBatch.from_arrays(found, names=names + ["pieces"] + ["decoded"] * back)

    return run


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), rate: float = DROPOUT,
           seed: int = 0, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """The columns keep and pieces (array of int) of every row; with back also decoded, the text that
    its pieces spell."""
    rows = docs.select(*keep, F.xxhash64(F.lit(seed), F.col(id_col)).alias("_document"),
                       text_of(text_col).alias("_text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_encode(model, rate, seed, back),
                           f"{kinds}, pieces array<int>" + ", decoded string" * back)


def _decode(path: str, keep: list[str], pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [decode(v, np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64)
                                if x.is_valid else np.zeros(0, np.int64)).decode("utf-8", "replace")
                         for x in part.column(pieces)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(texts, pa.string())], names=keep + ["text"])

    return run


def decoded(rows: DataFrame, model: str, pieces: str = "pieces") -> DataFrame:
    """All columns of rows and text, what its pieces spell; a column named text is replaced."""
    keep = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep).mapInArrow(_decode(model, keep, pieces), f"{kinds}, text string")
