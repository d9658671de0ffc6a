"""A Merkle manifest of a table, kept as a persistent tree whose versions copy paths only.

Every row is a leaf, the SHA-256 of its fields (`-` for null, else byte count, colon, value). The rows
of a tree (one per value of a column) ascend by id; every 8 consecutive nodes become their hash until
one remains, and the last nodes of all trees, ordered by tree, are the leaves of one more tree. Four
levels at a time are hashed in aligned blocks of 8 ** 4 nodes, a block to a group, so that no task
holds more than a block however many rows a tree has. Then the way goes down again: every block gets
the siblings above it and passes its nodes theirs.

A changed row makes a version of the tree: a new leaf and new ancestors inside its block, hashed with
the untouched siblings of the base version, which all versions share; above the block the version goes
on along the block's own siblings. Nothing else is copied, and versions of one block are as many rows
as it has leaves.

Defined cases: rows that repeat an id ascend by their leaf, rows that repeat one another each have a
leaf; a null id comes first and is never changed; null trees are a tree of their own, the first; a tree
of one row is its leaf; a lone node of a run is hashed on; very long texts are hashed whole; an empty
table gives an empty manifest; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.store import shared_folder, stored

ARITY, LEVELS = 8, 4
BLOCK = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ABOVE = "path array<string>, subroot string, above array<string>, root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """Digest of the fields of a row."""
    def shown(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(shown, fields)), 256)


# -- blocks -------------------------------------------------------------------------------------

class Block:
    """The base version of up to LEVELS levels over aligned nodes; versions share its nodes."""

    def __init__(self, nodes: list[str], size: int):
        """size: nodes of the whole tree on the lowest level."""
        self.levels = [nodes]
        while size > 1 and len(self.levels) <= LEVELS:
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
            size = -(-size // ARITY)
        self._runs = [["".join(level[i:i + ARITY]) for i in range(0, len(level), ARITY)]
                      for level in self.levels[:-1]]

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[str]:
        """Left and right siblings in turn, from the level of node number at upwards."""
        out = []
        for runs in self._runs:
            at, k = divmod(at, ARITY)
            out += [runs[at][:64 * k], runs[at][64 * (k + 1):]]
        return out


def copied(node: str, siblings: list[str]) -> list[str]:
    """The node and its ancestors in a version that differs in this node."""
    out = [node]
    for left, right in zip(siblings[::2], siblings[1::2]):
        out.append(digest(left + out[-1] + right))
    return out


def _sorted(group: pa.Table) -> tuple[pa.Table, list[int], Block]:
    """The group by place, places within the block, the block."""
    group = group.sort_by("place")
    places = (group.column("place").to_numpy() % BLOCK).tolist()
    return group, places, Block(group.column("node").to_pylist(), group.column("size")[0].as_py())


def _lift(key: tuple, group: pa.Table) -> pa.Table:
    group, _, block = _sorted(group)
    size = group.column("size")[0].as_py()
    return pa.table({"tree": [key[0].as_py()], "place": [key[1].as_py()], "size": [-(-size // BLOCK)],
                     "node": [block.root]})


def _lower(key: tuple, group: pa.Table, above: pa.Table) -> pa.Table:
    group, places, block = _sorted(group)
    up = {c: above.column(c)[0].as_py() for c in ("path", "subroot", "above", "root")}
    n = len(places)
    return pa.table({
        "tree": group.column("tree"), "place": group.column("place"), "node": group.column("node"),
        "path": pa.array([block.siblings(k) + up["path"] for k in places], pa.list_(pa.string())),
        "subroot": pa.array([up["subroot"]] * n, pa.string()),
        "above": pa.array([up["above"]] * n, pa.list_(pa.string())),
        "root": pa.array([up["root"]] * n, pa.string())})


def _verify(copies: bool):
    def run(key: tuple, group: pa.Table, above: pa.Table) -> pa.Table:
        group, places, block = _sorted(group)
        path, subroot, over, root = (above.column(c)[0].as_py() for c in ("path", "subroot", "above", "root"))
        up = path + over
        up_text = "".join(up)
        leaves, changed = group.column("node").to_pylist(), group.column("changed").to_pylist()
        proofs, folded, kept = [], [], []
        for k, leaf, new in zip(places, leaves, changed):
            mine = block.siblings(k)
            proofs.append(digest("".join(mine) + up_text))
            inside = copied(new or leaf, mine)  # the version within the block
            over_block = copied(inside[-1], up)  # and above it
            folded.append(over_block[-1])
            kept.append([*inside, *over_block[1:]] if copies and new is not None else None)
        out = {"id": group.column("id"), "tree": group.column("tree"), "leaf": group.column("node"),
               "changed": group.column("changed"), "subroot": [subroot] * len(places),
               "root": [root] * len(places), "proof_sha256": proofs, "folded_root": folded,
               "verified": pa.array([f == root for f in folded], pa.bool_())}
        if copies:
            out["copies"] = pa.array(kept, pa.list_(pa.string()))
        return pa.table({c: x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, pa.string())
                         for c, x in out.items()})

    return run


# -- trees of any size --------------------------------------------------------------------------

def _placed(rows: DataFrame, order: list[str], folder: str, name: str) -> DataFrame:
    """rows with place, from 0 within the tree in this order, and size of the tree; stored sorted."""
    by = ["tree", *order]
    # written first: the bounds of the ranges are taken from a pass of its own
    rows = stored(rows, folder, f"{name}-rows").repartitionByRange(*by).sortWithinPartitions(*by)
    kept = stored(rows.select("*", F.spark_partition_id().alias("part"),
                              F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), folder, name)
    runs = kept.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    runs = runs.select("tree", "part", F.sum("n").over(tree).alias("size"), (
        F.sum("n").over(tree.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"))
    return kept.join(runs, ["tree", "part"]).select(
        *[c for c in kept.columns if c not in ("part", "at")], "size", (F.col("at") + F.col("shift")).alias("place"))


def _block() -> Column:
    return F.expr(f"place div {BLOCK}").alias("block")


def _levels(nodes: DataFrame, folder: str, name: str) -> list[DataFrame]:
    """nodes and, LEVELS levels apart, those above them up to one node per tree."""
    out = [nodes]
    size = nodes.agg(F.max("size")).first()[0] or 0
    for k in itertools.count(1):
        above = out[-1].groupBy("tree", _block()).applyInArrow(_lift, "tree string, place long, size long, node string")
        out.append(stored(above, folder, f"{name}-{k}"))
        size = math.ceil(size / BLOCK)
        if size <= 1:
            return out


def _siblings(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Siblings of every node of levels[0]; above: those of the last level's."""
    for nodes in levels[-2::-1]:
        above = _by_block(nodes, above, _lower, f"tree string, place long, node string, {_ABOVE}")
    return above


def _by_block(nodes: DataFrame, above: DataFrame, run, kind: str) -> DataFrame:
    over = above.select("tree", F.col("place").alias("block"), "path", "subroot", "above", "root")
    return nodes.groupBy("tree", _block()).cogroup(over.groupBy("tree", "block")).applyInArrow(run, kind)


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS,
             changes: dict[str, Column] | None = None, where: Column | None = None,
             copies: bool = True) -> DataFrame:
    """id, tree, leaf, changed, subroot, root, proof_sha256, folded_root, verified: one row per row of
    docs. changes: fields with another value where the condition where holds; each such row is a
    version, changed its new leaf, folded_root its root, copies (if asked for) its own nodes from the
    leaf up; all other nodes are those of the base version."""
    folder = shared_folder(docs.sparkSession)
    new = F.when(F.coalesce(where, F.lit(False)), leaf_of(
        [(changes or {}).get(f, F.col(f)) for f in fields])) if where is not None else F.lit(None).cast("string")
    tree = F.col(tree_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.when(tree.isNull(), "").otherwise(F.concat(F.lit("="), tree)).alias("tree"),
        leaf_of([F.col(f) for f in fields]).alias("node"), new.alias("changed"))
    leaves = _placed(rows, ["id", "node", "changed"], folder, "leaves")
    trees = _levels(leaves, folder, "nodes")
    tops = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    tops = _placed(tops, ["name"], folder, "tops")
    forest = _levels(tops, folder, "forest")
    none = F.array().cast("array<string>")
    root = forest[-1].select("tree", "place", "node", none.alias("path"), F.lit("").alias("subroot"),
                             none.alias("above"), F.col("node").alias("root"))
    named = _siblings(forest, root).join(tops.select("place", "name"), "place")
    over = stored(named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), none.alias("path"),
                               F.col("node").alias("subroot"), F.col("path").alias("above"), "root"), folder, "over")
    over = _siblings(trees[1:], over)
    kind = ("id long, tree string, leaf string, changed string, subroot string, root string, proof_sha256 string, "
            "folded_root string, verified boolean" + ", copies array<string>" * copies)
    return _by_block(leaves, over, _verify(copies), kind).withColumn(
        "tree", F.when(F.col("tree") != "", F.expr("substring(tree, 2)")))


def verify(digests: np.ndarray | list[str], siblings: list[str], root: str) -> bool:
    """Whether a leaf (the first of digests) and its siblings give the root."""
    return copied(digests[0], siblings)[-1] == root
