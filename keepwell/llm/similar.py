"""Near duplicates by exact Jaccard similarity of word shingles, none missed.

A text is the set of XXH64 values of its five-word shingles. Candidates come from two sources. The
first are SimHash fingerprints of the shingles, linked through the vantage-point trees of operator 5.
Fingerprints alone miss most pairs near the least similarity, so the second is a prefix filter: all
shingles have one order, rare before frequent (frequencies of a bounded sample; any order is right, this
one keeps groups small). Two sets of similarity t or more share one of the first n - ceil(t n) + 1
values of each, and at the first value they share, what is left of both must still reach the overlap
that t asks for (positional filter). Values with one text are dropped; under every other value, each
text is first compared with the least one, then along a least spanning tree of the pairs of different
components, and after the components of these links all pairs of different components are compared: a
group of copies costs one comparison a copy and turn, and no pair is left out. Each text brings a bitmap with the parity of its shingles per class: sets differ in at least as many
shingles as bitmaps in bits, so a pair that differs in more bits than the similarity allows ends where it
is met and is never a row. Candidates whose histograms of shingle classes cannot overlap enough are ruled out; a pair is a
link only where the exact similarity of both sets is t or more. A text that many others are compared
with is sent to groups of bounded size. Tables are deleted once their successor is written.

Shingles are compared by their 64-bit hashes, and a set is named by the hash of its values: two texts
of equal names count as one set.

Defined cases: a null text counts as empty; texts without words are linked to each other, fewer words
than a shingle form one; equal sets are linked without a comparison; very long texts are taken whole;
rows that repeat id and text are one row; a null id ranks last; ties cannot arise, as a link has no
rank; all columns stay, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from keepwell.llm.components import connected_components
from keepwell.llm.simhash import links, majority, one_of_each, shingle_hashes
from keepwell.llm.store import in_sample, removed, shared_folder, stored, text_of

SHINGLE, SIMILARITY = 5, 0.8
SAMPLE = 10_000  # texts whose shingles are counted for the order, about
FREQUENT = 1 << 17  # shingles that the order knows as frequent, at most
BUCKETS = 256  # classes of the histogram that rules pairs out
BITS = 1024  # classes of the bitmap that rules pairs out where they meet
GROUP = 500  # pairs that one text meets in a group


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text in rising order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def prefix(values: np.ndarray, frequent: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """The first values in the common order; frequent: rising, rank: their places in the order."""
    n = len(values)
    size = n - math.ceil(least * n - 1e-9) + 1 if n else 0
    at = np.searchsorted(frequent, values)
    often = np.zeros(n, bool)
    inside = at < len(frequent)
    often[inside] = frequent[at[inside]] == values[inside]
    rare = values[~often]
    if len(rare) >= size:
        return rare[:size]
    return np.concatenate([rare, values[often][np.argsort(rank[at[often]])]])[:size]


def _sketches(frequent: np.ndarray, rank: np.ndarray, shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets, prints = [], []
                for text in part.column("text"):
                    hashes = list(shingle_hashes(text.as_py(), shingle))
                    prints.append(majority(hashes))
                    sets.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes])))
                first = [prefix(s, frequent, rank, least) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("sig"),
                     pa.array(np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)),
                     pa.array([histogram(s).tobytes() for s in sets], pa.binary()),
                     pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(np.cumsum([0, *map(len, first)]).astype(np.int32),
                                              np.concatenate(first).view(np.int64))],
                    names=["doc_id", "sig", "node", "size", "fp", "hist", "bits", "keys"])

    return run


def _shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingle_set(text.as_py(), shingle).view(np.int64))], names=["value"])

    return run


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    sample = texts.where(in_sample(F.col("text"), SAMPLE, texts.count())).select("text")
    counts = sample.mapInArrow(_shingles(shingle), "value long").groupBy("value").count().where("count > 2")
    top = counts.orderBy(F.desc("count"), "value").limit(FREQUENT).toPandas()
    values = top["value"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], -order  # the most frequent comes last


# -- texts that share a value ------------------------------------------------------------------

def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of whole runs of one key and where the runs begin; batches come sorted by key."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        key = now["key"]
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))  # what may go on in the next batch
        if last or (held and held[-1]["key"][0] != key[0]):
            held.append({c: x[:last] for c, x in now.items()})
            done = {c: np.concatenate([h[c] for h in held]) for c in now}
            if len(done["key"]):
                yield done, np.flatnonzero(np.diff(done["key"], prepend=~done["key"][0]))
            held = []
        held.append({c: x[last:] for c, x in now.items()})
    if held:
        done = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        yield done, np.flatnonzero(np.diff(done["key"], prepend=~done["key"][0]))


def possible(size, pos, other_size, other_pos, least: float):
    """Whether sets that first meet at these places of their orders can be similar enough."""
    need = np.ceil(least / (1 + least) * (size + other_size) - 1e-9)
    return np.minimum(size - pos, other_size - other_pos) >= need


def _shared(least: float):
    """Rows of values with more than one text; first: the least text, where it can be similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, begin in _runs(batches):
            first = np.repeat(begin, np.diff(begin, append=len(x["key"])))
            new = np.diff(x["node"], prepend=~x["node"][0]) != 0
            new[begin] = True  # equal texts in a run count once
            texts = np.add.reduceat(new, begin, dtype=np.int64)
            keep = new & (np.repeat(texts, np.diff(begin, append=len(new))) > 1)
            able = possible(x["size"], x["pos"], x["size"][first], x["pos"][first], least)
            able &= x["node"] != x["node"][first]
            out = [pa.array(x[c][keep]) for c in ("key", "node", "size", "pos")]
            star = pa.array(x["node"][first][keep], pa.int64(), mask=~able[keep])
            yield pa.RecordBatch.from_arrays([*out, star], names=["key", "node", "size", "pos", "first"])

    return run


def bitmap(values: np.ndarray) -> np.ndarray:
    """Whether the number of values in each of BITS classes is odd, as bits."""
    counts = np.bincount((values >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8))


def _close(x: dict[str, np.ndarray], i: int, at: np.ndarray, bits: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of at that can be similar enough to i and lie in another component, and the share of differing bits."""
    at = at[possible(x["size"][i], x["pos"][i], x["size"][at], x["pos"][at], least) & (x["comp"][at] != x["comp"][i])]
    both = x["size"][i] + x["size"][at]
    most = both - 2 * np.ceil(least / (1 + least) * both - 1e-9)  # shingles in which they may differ
    apart = np.bitwise_count(bits[i] ^ bits[at]).sum(axis=1, dtype=np.int64)
    return at[apart <= most], (apart / both)[apart <= most]


def _of_each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns and bitmaps of each run whose texts lie in several components."""
    for x, begin in _runs(batches):
        several = np.minimum.reduceat(x["comp"], begin) != np.maximum.reduceat(x["comp"], begin)
        for low, high in zip(begin[several], np.append(begin[1:], len(x["key"]))[several]):
            yield ({c: x[c][low:high] for c in ("key", "node", "size", "pos", "comp")},
                   np.frombuffer(b"".join(x["bits"][low:high]), np.uint64).reshape(-1, BITS // 64))


def _forest(least: float):
    """Texts that can be similar to one of another component under their value; other: that on the edge by which a
    least spanning tree of these pairs reaches them. A text is one row, whatever the number of its pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for x, bits in _of_each_run(batches):
            n = len(x["node"])
            far, parent = np.full(n, np.inf), np.full(n, -1)
            open_, met = np.ones(n, bool), np.zeros(n, bool)
            for _ in range(n):
                left = np.flatnonzero(open_)
                i = left[np.argmin(far[left])]
                open_[i] = False
                left = left[left != i]
                same = left[x["comp"][left] == x["comp"][i]]
                far[same], parent[same] = -1.0, -1
                at, share = _close(x, i, left, bits, least)
                met[i] |= len(at) > 0
                met[at] = True
                nearer = share < far[at]
                far[at[nearer]], parent[at[nearer]] = share[nearer], i
            if met.any():
                other = np.where(parent < 0, x["node"], x["node"][parent])[met]
                out.append([*[x[c][met] for c in ("key", "node", "size", "pos")], other])
                held += len(other)
            if held > 1 << 16:
                yield _table(out, "key", "node", "size", "pos", "other")
                out, held = [], 0
        if held:
            yield _table(out, "key", "node", "size", "pos", "other")

    return run


def _table(parts: list, *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=list(names))


def _pairs(least: float):
    """a, b: texts of different components under one value that can be similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for x, bits in _of_each_run(batches):
            for i in range(len(bits) - 1):
                other = x["node"][_close(x, i, np.arange(i + 1, len(bits)), bits, least)[0]]
                out.append([np.minimum(other, x["node"][i]), np.maximum(other, x["node"][i])])
                held += len(other)
                if held > 1 << 18:
                    yield _table(out, "a", "b")
                    out, held = [], 0
        if held:
            yield _table(out, "a", "b")

    return run


def _by_key(rows: DataFrame, *more: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", *more)


# -- exact similarity --------------------------------------------------------------------------

def histogram(values: np.ndarray) -> np.ndarray:
    """How many of the values fall into each of BUCKETS classes; of a set too large for 16 bits, any."""
    counts = np.bincount((values % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return (counts if counts.max(initial=0) < 1 << 16 else np.full(BUCKETS, (1 << 16) - 1)).astype(np.uint16)


def _could_be(least: float):
    """Pairs whose histograms leave room for the overlap that the similarity asks for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                    for c in ("hist_a", "hist_b"))
            both = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            size = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            keep = both >= np.ceil(least / (1 + least) * size - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two rising arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _similar(shingle: int, least: float):
    """Links of each group: its first row is the text a, the others stream past it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = mine = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, part, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b")), batch.column("text")):
                if (a, part) != group:
                    group, mine = (a, part), None
                if b is None:
                    mine = shingle_set(text.as_py(), shingle) if mine is None else mine
                elif jaccard(mine, shingle_set(text.as_py(), shingle)) >= least:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, rows: DataFrame, texts: DataFrame, shingle: int, least: float,
               folder: str, name: str) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity least or more. Histograms rule most others out; of
    what is left, a text goes to each group of up to GROUP pairs that share it once and to the others once
    a pair."""
    spark = pairs.sparkSession
    firsts = rows.groupBy("node").agg(F.min_by(F.struct("doc_id", "sig", "size", "hist"), F.struct(
        F.col("doc_id").isNull(), "doc_id", "sig")).alias("r"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = stored(firsts.join(ends, "node", "left_semi").select("node", "r.*"), folder, f"ends-{name}")
    sides = [ends.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("hist").alias(f"hist_{c}")) for c in "ab"]
    near = pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_could_be(least), "a long, b long")
    near = stored(near, folder, f"near-{name}")
    groups = near.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    sent = near.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    sent = sent.select("a", "part", "b", F.col("b").alias("node")).unionByName(sent.select("a", "part").distinct().select(
        "a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("node")))
    sent = stored(sent.join(ends.select("node", "doc_id", "sig"), "node").select(
        "a", "part", "b", F.col("doc_id").alias("of_id"), F.col("sig").alias("of_sig")), folder, f"sent-{name}")
    moved = texts.join(sent, texts["doc_id"].eqNullSafe(sent["of_id"]) & (texts["sig"] == sent["of_sig"])).select(
        "a", "part", "b", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = moved.repartition(parts, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    links = stored(met.mapInArrow(_similar(shingle, least), "a long, b long"), folder, f"links-{name}")
    removed(spark, folder, f"ends-{name}", f"near-{name}", f"sent-{name}")
    return links


def _placed(rows: DataFrame, marked: DataFrame, root: DataFrame) -> DataFrame:
    """rows by value, with the component and the bitmap of each text."""
    of = marked.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("comp"), "bits")
    return _by_key(rows.join(of, "node").select("key", "node", "size", "pos", "comp", "bits"))


def _tree_pairs(rows: DataFrame, folder: str) -> DataFrame:
    """a, b: texts of one fingerprint with the least of them, and the links that vantage-point trees find
    between fingerprints."""
    points = stored(rows.groupBy("fp").agg(F.min("node").alias("node")), folder, "points")
    forest = links(points)
    left, right = (points.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}")) for c in "ab")
    far = forest.join(left, "a").join(right, "b").select(F.col("node_a").alias("x"), F.col("node_b").alias("y"))
    same = rows.select("fp", F.col("node").alias("x")).join(points.select("fp", F.col("node").alias("y")), "fp").select("x", "y")
    return far.unionByName(same).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """doc_id, sig (a hash of the text), component (a shingle set) for every row."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    text = text_of(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("sig"), text.alias("text"))
    made = texts.mapInArrow(_sketches(*_frequent(texts, shingle), shingle, least),
                            "doc_id long, sig long, node long, size long, fp long, hist binary, bits binary, keys array<long>")
    sketches = stored(made, folder, "sketches")
    rows = stored(sketches.drop("keys"), folder, "rows")
    keys = sketches.select("node", "size", F.posexplode("keys").alias("pos", "key")).select(
        "key", "node", "size", F.col("pos").cast("long").alias("pos"))
    kind = "key long, node long, size long, pos long"
    shared = stored(_by_key(keys, "node").mapInArrow(_shared(least), f"{kind}, first long"), folder, "shared")
    removed(spark, folder, "sketches")
    stars = shared.where("first IS NOT NULL").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))
    stars = stored(stars.unionByName(_tree_pairs(rows, folder)).distinct(), folder, "stars")
    found = _confirmed(stars, rows, texts, shingle, least, folder, "stars")
    root = connected_components(found, f"{folder}/first")
    marked = stored(rows.groupBy("node").agg(F.min("bits").alias("bits")), folder, "marked")
    met = _placed(shared, marked, root).mapInArrow(_forest(least), f"{kind}, other long")
    close = stored(met, folder, "close")
    removed(spark, folder, "shared")
    trees = close.where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    trees = stored(trees.distinct().join(stars, ["a", "b"], "left_anti"), folder, "trees")
    found = found.unionByName(_confirmed(trees, rows, texts, shingle, least, folder, "trees"))
    root = connected_components(found, f"{folder}/second")
    rest = _placed(close.drop("other"), marked, root).mapInArrow(_pairs(least), "a long, b long").distinct()
    rest = stored(rest.join(stars.unionByName(trees), ["a", "b"], "left_anti"), folder, "pairs")
    removed(spark, folder, "close", "marked", "stars", "trees", "points")
    found = found.unionByName(_confirmed(rest, rows, texts, shingle, least, folder, "pairs"))
    root = connected_components(found, f"{folder}/all")
    return rows.join(root, "node", "left").select("doc_id", "sig", F.coalesce("root", "node").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    least: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id (the least id that links reach) for every row."""
    of = _components(docs, id_col, text_col, shingle, least)
    least_id = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return of.join(least_id, "component").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component; all columns stay."""
    return one_of_each(docs, _components(docs, id_col, text_col, shingle, least), id_col, text_col)
