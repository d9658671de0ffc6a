"""Token ids in files: frequency-ranked, byte-aligned, with control bytes apart from the data.

Texts are tokenized once and their ids stored. Ids are counted over all documents and ranked, the most
frequent first, so that common ids take one byte. A document's ranks are written as 1 to 4 data bytes
each; the lengths lie apart, two bits each, four to a control byte, and are read through a table of
256 control bytes. Files hold the documents in ascending id order with the offset inside their file.

Defined cases: a null or empty text has the end id only; rows that repeat an id are kept, ordered by
the hash of their text; a null id comes first; an empty table gives empty files; very long texts are
cut where no token can span; other columns are not looked at.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.store import shared_folder, stored, text_of

END = 0
MEMO = 1_000_000  # distinct words a worker remembers
PIECE = 1 << 20  # characters split at once
_CUT = re.compile(r"(?<=\S)(?= \S)")  # no token spans this place
_SIGNS = r"[!-&(-/:-@\[-`{-~]*"  # not the apostrophe, which begins tokens like 's
#: A word and its signs: the tokenizer's own first parts.
_WORD = re.compile(rf"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)({_SIGNS})")

# Texts are first cut, quickly, before every space, dot and comma and around every line end. By what a
# part ends with and what the next begins with, the cut is one of the tokenizer's own boundaries or not.
_OTHER, _SIGN, _LINE, _SPACED, _BAD = range(5)  # letters and numbers; " x"; other white space
_BOUNDARY = np.zeros((5, 5), bool)
_BOUNDARY[_OTHER, [_SIGN, _LINE, _SPACED]] = True
_BOUNDARY[_SIGN, [_LINE, _SPACED]] = True
_BOUNDARY[_LINE, [_OTHER, _SIGN]] = True


def _edges(part: str) -> tuple[int, int]:
    """What a part begins and ends with."""
    if part == "\n":
        return _LINE, _LINE
    if not part:
        return _BAD, _BAD
    last = _OTHER if part[-1].isalnum() else _BAD if part[-1].isspace() else _SIGN
    if part[0] == " " and part[1:2].strip():
        return _SPACED, last
    return _OTHER if part[0].isalnum() else _BAD if part[0].isspace() else _SIGN, last


class _Words(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.fresh.append(word)
        return at


class Encoder:
    """Whole texts to ids by the tokenizers library, each distinct word encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the library's own letters for bytes, taken one byte at a time where UTF-8 allows it
        split = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {32: split.pre_tokenize_str(" ")[0][0]}
        for char in map(chr, range(0x80, 0x800)):
            shown = split.pre_tokenize_str(char)[0][0]
            self.letters.update(zip(char.encode(), shown))
        self.clear()

    def clear(self) -> None:
        self.words = _Words()
        self.words.fresh = []
        self.signs: dict[str, list[int]] = {"": []}
        self.flat, self.starts = array("i"), array("q", [0])
        self.begins, self.ends = bytearray(), bytearray()

    def _model(self, part: str) -> list[int]:
        if part.isascii():
            shown = part.replace(" ", self.letters[32])
        else:
            shown = part.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(shown)]

    def _learn(self) -> None:
        for word in self.words.fresh:
            plain = _WORD.fullmatch(word)
            if plain:
                name, sign = plain.groups()
                ids = self.signs.get(sign)
                if ids is None:
                    ids = self.signs[sign] = self._model(sign)
                self.flat.extend(self._model(name))
                self.flat.extend(ids)
                self.begins.append(_SPACED if word[0] == " " else _OTHER)
                self.ends.append(_SIGN if sign else _OTHER)
            else:
                self.flat.extend(self.tokenizer.encode(word, add_special_tokens=False).ids)
                begin, end = _edges(word)
                self.begins.append(begin)
                self.ends.append(end)
            self.starts.append(len(self.flat))
        self.words.fresh.clear()

    def _look_up(self, words: list[str]) -> np.ndarray:
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.fresh:
            self._learn()
        return numbers

    def _numbers(self, text: str) -> np.ndarray:
        """Word numbers of one text."""
        found, at = [], 0
        while at < len(text):
            to = len(text)
            if to - at > PIECE:
                cut = _CUT.search(text, at + PIECE)
                to = cut.start() if cut else to
            piece = text[at:to]
            at = to
            numbers = None
            if "\0" not in piece:
                words = piece.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace(
                    "\n", "\0\n\0").split("\0")
                numbers = self._look_up(words[1:] if not words[0] else words)
                begins = np.frombuffer(self.begins, np.uint8)[numbers[1:]]
                if not _BOUNDARY[np.frombuffer(self.ends, np.uint8)[numbers[:-1]], begins].all():
                    numbers = None
            if numbers is None:
                numbers = self._look_up(_CUT.split(piece))
            found.append(numbers)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, the end id last."""
        waiting, held = [], 0
        for text in texts:
            waiting.append(self._numbers(text))
            held += len(waiting[-1])
            if held > 300_000:
                yield from self._ids(waiting)
                waiting, held = [], 0
                if len(self.words) > MEMO:
                    self.clear()
        yield from self._ids(waiting)

    def _ids(self, waiting: list[np.ndarray]) -> Iterator[np.ndarray]:
        if not waiting:
            return
        numbers = np.concatenate(waiting)
        starts = np.frombuffer(self.starts, np.int64)
        begin, size = starts[numbers], np.diff(starts)[numbers]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)
        ids = np.frombuffer(self.flat, np.int32)[at] if len(at) else np.zeros(0, np.int32)
        del starts
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, waiting)])]
        for a, b in zip(upto, upto[1:]):
            yield np.append(ids[a:b], np.int32(END))


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)  # a worker keeps its words from task to task


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [x.astype("<u4") if x.max() > 0xFFFF else x.astype("<u2")
                       for x in encoder.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("sig"),
                     pa.array([x.itemsize for x in ids], pa.int32()),
                     pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "sig", "width", "ids"])

    return run


def _together(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, ids, ids per row) of neighbouring rows of one width, a bounded number."""
    width = batch.column("width").to_numpy()
    column = batch.column("ids")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    at = 0
    while at < len(width):
        to = at + 1
        while to < len(width) and width[to] == width[at] and offsets[to] - offsets[at] < 1 << 22:
            to += 1
        ids = data[offsets[at]:offsets[to]].view(f"<u{width[at]}")
        yield at, to, ids, np.diff(offsets[at:to + 1]) // width[at]
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for _, _, ids, _ in _together(batch):
            part = np.bincount(ids, minlength=len(total))
            part[:len(total)] += total
            total = part
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])


# -- the code of one document -------------------------------------------------------------------

#: For each control byte, the bytes of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each document; sizes: values per document, in all values."""
    values = values.astype("<u4" if values.max(initial=0) > 0xFFFF else "<u2")
    extra = np.zeros(len(values), np.uint8)  # bytes beyond the first
    for limit in (0xFF, 0xFFFF, 0xFFFFFF)[:values.itemsize - 1]:
        extra += values > limit
    groups = -(-sizes // 4)  # control bytes; a document's last one may be part empty
    first = np.concatenate([[0], np.cumsum(groups)])
    ends = np.cumsum(sizes)
    codes = np.zeros(4 * first[-1], np.uint8)
    codes[np.arange(len(values)) + np.repeat(4 * first[:-1] - ends + sizes, sizes)] = extra
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(values.itemsize) <= extra[:, None]
    data = values.view(np.uint8).reshape(-1, values.itemsize)[used]
    upto = np.concatenate([[0], np.cumsum(extra + np.int64(1))])[np.concatenate([[0], ends])]
    return ([control[a:b].tobytes() for a, b in zip(first, first[1:])],
            [data[a:b].tobytes() for a, b in zip(upto, upto[1:])])


def unpack(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of neighbouring documents: lengths by table lookup, bytes gathered by position."""
    groups = -(-sizes // 4)
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(
        4 * (np.cumsum(groups) - groups) - ends + sizes, sizes)
    size = LENGTHS[control].ravel()[place]
    begin = np.cumsum(size, dtype=np.int64) - size
    out = data[begin].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        at = np.flatnonzero(size > k)
        out[at] |= data[begin[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _pack_documents(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in batches:
            for at, to, ids, sizes in _together(batch):
                control, data = pack(rank[ids], sizes)
                before = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("sig"), part.column("file"), pa.array(before, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                    names=["doc_id", "sig", "file", "start_in_file", "n_tokens", "control", "data"])

    return run


def write(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """folder/documents and folder/vocabulary, from the texts of docs."""
    work = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("sig"),
                       text_of(text_col).alias("text"))
    ids = stored(rows.mapInArrow(_tokenize(tokenizer), "doc_id long, sig long, width int, ids binary"),
                 work, "ids")
    counts = ids.select("width", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n"))
    # at most one row per id of the vocabulary
    table = sorted(((r.id, r.n) for r in counts.collect()), key=lambda x: (-x[1], x[0]))
    spark = docs.sparkSession
    spark.createDataFrame([(k, i, n) for k, (i, n) in enumerate(table)], "rank int, id long, n long"
                          ).coalesce(1).write.parquet(f"{folder}/vocabulary")
    rank = np.zeros(max((i for i, _ in table), default=0) + 1, np.uint32)
    rank[[i for i, _ in table]] = np.arange(len(table))
    ordered = ids.repartitionByRange("doc_id", "sig").sortWithinPartitions("doc_id", "sig")
    ordered.withColumn("file", F.spark_partition_id()).mapInArrow(
        _pack_documents(rank), "doc_id long, sig long, file int, start_in_file long, n_tokens long, "
        "control binary, data binary").write.option("compression", "zstd").parquet(f"{folder}/documents")


def _bytes(column: pa.BinaryArray) -> np.ndarray:
    """The bytes of all rows, one after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]


def _read_documents(id_of: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes = part.column("n_tokens").to_numpy()
                ids = id_of[unpack(_bytes(part.column("control")), _bytes(part.column("data")), sizes)]
                raw = memoryview(ids.tobytes())
                upto = 4 * np.concatenate([[0], np.cumsum(sizes)])
                each = [raw[a:b] for a, b in zip(upto, upto[1:])]
                more = {"ids_crc32": pa.array(map(zlib.crc32, each), pa.int64()),
                        "ids": pa.array(each, pa.binary()) if "ids" in names else None}
                yield pa.RecordBatch.from_arrays(
                    [more[c] if c in more else part.column(c) for c in names], names=names)

    return run


def read(spark, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian, four bytes each)."""
    rows = spark.read.parquet(f"{folder}/vocabulary").sort("rank").collect()  # bounded by the vocabulary
    id_of = np.array([r.id for r in rows], "<u4")
    files = spark.read.parquet(f"{folder}/documents")
    totals = files.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    names = ["doc_id", "file", "start_in_file", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = "doc_id long, file int, start_in_file long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = files.select("doc_id", "file", "start_in_file", "n_tokens", "control", "data").mapInArrow(
        _read_documents(id_of, names), kinds)
    return rows.join(F.broadcast(totals), "file").select(  # one row per file
        "doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), *names[3:])
