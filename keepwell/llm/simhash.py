"""SimHash near-duplicates, linked exactly through sharded vantage-point trees.

A fingerprint has 64 bits: bit i is one where over half of the document's 4-word shingles, repeats
included, have it in their XXH64. Distinct fingerprints are routed down a vantage-point tree whose
vantage points and radii come from a bounded sample: the near half of a node holds what lies within
its radius. Every fingerprint is at home in one leaf. By the triangle inequality a link can cross a
node's boundary only if both ends lie within LINK of it, so points of the near half that do are sent
to the far half as guests too, and guests follow every branch their ball of radius LINK meets. Each
leaf is a shard, searched by a tree of its own; homes are compared with homes and guests, so every
pair meets in exactly one shard. A shard passes on a spanning forest of its links, never all pairs.

A sample that the driver may hold tells at most some thousand shards apart. Shards that are still too large
get trees of their own, each from a bounded sample of its own points and built in a task, until none is
larger than it should be; so a shard does not grow with the table, and no tree is larger than a sample.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and are linked
to each other; fewer than four words form one shingle; equal texts share a fingerprint and cost one
point; repeated rows each get their component; a null id is named by no component; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from keepwell.llm.components import connected_components
from keepwell.llm.store import fresh, in_sample, shared_folder, stored, text_of

SHINGLE, SEED, LINK = 4, 42, 4
SHARD = 1 << 15  # fingerprints at home in a shard, about
SAMPLE = 1 << 16  # fingerprints that the routing tree is built from, about
LEAF = 192  # below this a shard's own tree compares directly
_STEP = 1 << 16  # shingles hashed at once


# -- fingerprints -------------------------------------------------------------------------------

def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.ascontiguousarray(bits).view(np.uint64)  # eight counters to a word, 255 rows at most
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, some at a time; nothing for a text without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    n = max(1, len(words) - shingle + 1) if words else 0
    for at in range(0, n, _STEP):
        part = words[at:at + _STEP + shingle - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(part) >= shingle else [
            b" ".join(part)]
        yield np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        counts += _bit_counts(hashes)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str) -> int:
    return majority(shingle_hashes(text))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("sig"), pa.array(prints.view(np.int64))],
            names=["doc_id", "sig", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sig (a hash of the text), fp: the fingerprint of every row as a signed long."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("sig"), text.alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, sig long, fp long")


# -- the tree that deals fingerprints to shards -------------------------------------------------

def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _vantage(points: np.ndarray, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The candidate whose median radius splits the points most evenly."""
    best = None
    for at in np.linspace(0, len(points) - 1, tries).astype(int):
        d = distance(points, points[at])
        for radius in {int(np.median(d)), int(np.median(d)) - 1}:
            off = abs(2 * int((d <= radius).sum()) - len(points))
            if off < len(points) and (best is None or off < best[0]):
                best = (off, points[at], radius)
    return best and best[1:]


def build_tree(points: np.ndarray, depth: int) -> list | None:
    """[vantage, radius, near, far], None for a leaf."""
    if depth == 0 or len(points) < 8:
        return None
    found = _vantage(points)
    if found is None:
        return None
    near = distance(points, found[0]) <= found[1]
    return [*found, build_tree(points[near], depth - 1), build_tree(points[~near], depth - 1)]


def _split(homes: np.ndarray, guests: np.ndarray, vantage, radius: int, fp: np.ndarray):
    """(homes, guests) of the near half and of the far half."""
    d, e = distance(fp[homes], vantage), distance(fp[guests], vantage)
    near = d <= radius
    crossing = homes[near & (d > radius - LINK)]
    return ((homes[near], guests[e <= radius + LINK]),
            (homes[~near], np.concatenate([guests[e > radius - LINK], crossing])))


def route(tree: list | None, fp: np.ndarray, home: np.ndarray | None = None, name: str = "r"
          ) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(leaf, homes, guests) with positions in fp; all are at home where home is not given."""
    at = np.arange(len(fp))
    open_ = [(name, tree, *((at, at[:0]) if home is None else (at[home], at[~home])))]
    while open_:
        name, node, homes, guests = open_.pop()
        if node is None:
            yield name, homes, guests
        elif len(homes) + len(guests):
            near, far = _split(homes, guests, node[0], node[1], fp)
            open_ += [(name + "n", node[2], *near), (name + "f", node[3], *far)]


def _placed(leaf: str, fp: np.ndarray, homes: np.ndarray, guests: np.ndarray) -> pa.RecordBatch:
    at = np.concatenate([homes, guests]).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([leaf] * len(at), pa.string()), pa.array(fp[at].view(np.int64)),
         pa.array(np.arange(len(at)) < len(homes))], names=["shard", "fp", "home"])


def _deal(tree: list | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for leaf, homes, guests in route(tree, fp):
                yield _placed(leaf, fp, homes, guests)

    return run


def _grown(shard: int):
    """The tree of each shard as text, from a sample of its points; nothing where none splits them."""
    def run(group: pa.Table) -> pa.Table:
        fp = np.sort(group.column("fp").to_numpy()).view(np.uint64)
        tree = build_tree(fp, math.ceil(math.log2(group.column("n")[0].as_py() / shard)))
        told = [json.dumps(tree, default=int)] if tree else []
        return pa.table({"shard": group.column("shard").slice(0, len(told)), "tree": pa.array(told, pa.string())})

    return run


def _deal_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points sent down the trees of their shards; a shard's tree comes before its points."""
    name = tree = None
    for batch in batches:
        shards, trees = batch.column("shard").to_pylist(), batch.column("tree")
        point = trees.is_null().to_numpy(zero_copy_only=False)
        fp = batch.column("fp").fill_null(0).to_numpy().view(np.uint64)
        home = batch.column("home").fill_null(False).to_numpy(zero_copy_only=False)
        begin = [n for n, s in enumerate(shards) if not n or s != shards[n - 1]]
        for low, high in zip(begin, [*begin[1:], len(shards)]):
            if shards[low] != name:
                name, tree = shards[low], json.loads(trees[low].as_py())
            mine = point[low:high]  # a shard's tree comes once for each of its parts in this task
            here = fp[low:high][mine]
            for leaf, homes, guests in route(tree, here, home[low:high][mine], name):
                yield _placed(leaf, here, homes, guests)


def _split_on(dealt: DataFrame, folder: str, shard: int, sample: int) -> DataFrame:
    """dealt, with shards of more than twice the wanted size dealt on by trees of their own."""
    spark, done = dealt.sparkSession, []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = stored(dealt, folder, "dealt-0")
    for step in itertools.count(1):
        sizes = now.where("home").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard)
        chosen = now.where("home").join(sizes, "shard").where(in_sample(F.col("fp"), sample, F.col("n")))
        trees = stored(chosen.select("shard", "fp", "n").groupBy("shard").applyInArrow(
            _grown(shard), "shard string, tree string"), folder, f"trees-{step}")
        if trees.isEmpty():
            return reduce(DataFrame.unionByName, done, now)
        done.append(now.join(trees, "shard", "left_anti"))
        none = F.lit(None)
        rows = now.join(trees.select("shard"), "shard", "left_semi").select(
            "shard", F.pmod(F.xxhash64("fp"), F.lit(parts)).cast("int").alias("part"), "fp", "home", none.cast("string").alias("tree"))
        every = trees.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
                             none.cast("long").alias("fp"), none.cast("boolean").alias("home"), "tree")
        met = rows.unionByName(every).repartition(parts, "shard", "part").sortWithinPartitions(
            "shard", "part", F.col("tree").desc_nulls_last())
        now = stored(met.select("shard", "fp", "home", "tree").mapInArrow(
            _deal_on, "shard string, fp long, home boolean"), folder, f"dealt-{step}")


# -- links within a shard -----------------------------------------------------------------------

class _Forest:
    """Components of positions; the root is the least position."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.up[at]
        while True:
            higher = self.up[root]
            if (higher == root).all():
                self.up[at] = root
                return root
            root = higher

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.up, b, a)


def shard_forest(fp: np.ndarray, home: np.ndarray) -> np.ndarray:
    """For each position a linked position, the least known, after all links of homes."""
    forest = _Forest(len(fp))
    open_ = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while open_:
        homes, guests = open_.pop()
        if not len(homes):
            continue
        found = _vantage(fp[homes]) if len(homes) > LEAF else None
        if found is not None:
            open_ += _split(homes, guests, *found, fp)
            continue
        for k in range(0, len(homes), LEAF):  # more than LEAF only where no vantage point splits them
            mine = homes[k:k + LEAF]
            rest = np.concatenate([homes[k:], guests])
            for at in range(0, len(rest), 8192):
                other = rest[at:at + 8192]
                i, j = np.nonzero(np.bitwise_count(fp[mine][:, None] ^ fp[other]) <= LINK)
                forest.link(mine[i], other[j])
    return forest.roots(np.arange(len(fp)))


def _shard_links(group: pa.Table) -> pa.Table:
    fp = group.column("fp").to_numpy().view(np.uint64)
    root = shard_forest(fp, group.column("home").to_numpy(zero_copy_only=False))
    moved = root != np.arange(len(fp))
    return pa.table({"a": fp[moved].view(np.int64), "b": fp[root[moved]].view(np.int64)})


def links(points: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """a, b: a spanning forest of the links between the distinct fingerprints of points (fp)."""
    n, folder = points.count(), shared_folder(points.sparkSession)
    depth = min(max(0, math.ceil(math.log2(max(n, 1) / shard))), int(math.log2(sample / 16)))
    chosen = points.where(in_sample(F.col("fp"), sample, n)).select("fp").toPandas()["fp"]
    tree = build_tree(np.sort(chosen.to_numpy(np.int64)).view(np.uint64), depth)
    dealt = points.select("fp").mapInArrow(_deal(tree), "shard string, fp long, home boolean")
    dealt = _split_on(dealt, folder, shard, sample)
    return dealt.groupBy("shard").applyInArrow(_shard_links, "a long, b long")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, sig, fp, component (a fingerprint) and component_id for every row."""
    folder = shared_folder(docs.sparkSession)
    rows = stored(fingerprints(docs, id_col, text_col), folder, "fingerprints")
    points = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), folder, "points")
    roots = connected_components(links(points), folder)
    named = points.join(roots, points.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(least, "component").select("fp", "component", "component_id")
    return rows.join(of, "fp").select("doc_id", "sig", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the least id that links reach) for every row."""
    return _components(docs, id_col, text_col).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each component of found (doc_id, sig, component): that of the least id, null
    ids last, then of the least hash of the text; all columns stay. The few rows that go are looked up, so
    that the texts are not shuffled while those are a small table."""
    folder, sig = shared_folder(docs.sparkSession), fresh(docs, "_sig")
    rows = found.groupBy("component", "doc_id", "sig").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("k")
    kept = rows.groupBy("component").agg(least, F.count("*").alias("rows")).where("rows > 1")
    first = kept.select(F.col("component").alias("of"), F.col("k.doc_id").alias("kept_id"), F.col("k.sig").alias("kept_sig"))
    joined = rows.join(first, rows["component"] == first["of"])
    gone = stored(joined.where(~(F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sig") == F.col("kept_sig")))).select(
        F.col("doc_id").alias("gone_id"), F.col("sig").alias("gone_sig")), folder, "gone")
    again = stored(rows.where("n > 1").select(F.col("doc_id").alias("again_id"), F.col("sig").alias("again_sig")), folder, "again")
    signed = docs.withColumn(sig, F.xxhash64(text_of(text_col)))
    left = signed.join(gone, signed[id_col].eqNullSafe(gone["gone_id"]) & (signed[sig] == gone["gone_sig"]), "left_anti")
    if again.isEmpty():
        return left.drop(sig)
    on = left[id_col].eqNullSafe(again["again_id"]) & (left[sig] == again["again_sig"])
    once = left.join(again, on, "left_semi").dropDuplicates([id_col, sig])  # rows that repeat id and text
    return left.join(again, on, "left_anti").unionByName(once).drop(sig)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component; all columns stay."""
    return one_of_each(docs, _components(docs, id_col, text_col), id_col, text_col)


def as_hex(fp: Column) -> Column:
    """16 lower-case hex digits of a signed long."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
