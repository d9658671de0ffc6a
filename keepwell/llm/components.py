"""Connected components of an edge list too large for one machine, by alternating stars."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.store import removed, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: larger neighbours move to the least of all neighbours. Small: smaller ones do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """node, root (the least node it reaches) of every node with an edge; edges: a, b, null-free."""
    now = stored(edges.where("a <> b").select("a", "b").distinct(), folder, "edges-0")
    seen = None
    for step in itertools.count(1):
        now = stored(_star(_star(now, True), False), folder, f"edges-{step}")
        removed(edges.sparkSession, folder, f"edges-{step - 1}")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
