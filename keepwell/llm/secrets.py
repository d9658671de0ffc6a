"""Secret scans with an incremental ledger of content-addressed blobs.

A version of a path is addressed by the SHA-256 of its text. The ledger holds one row per (blob, rule
version) with the spans found; a scan reads only pairs that the ledger does not hold yet, adds them
in one write, and joins the findings back to every path whose versions have that text.

Defined cases: a null text counts as empty; repeated rows each get their findings; an empty table
gives an empty result; other columns are not looked at. Spans count code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.store import text_of

SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and non-overlapping; group's length must reach least. A text
    without any of the hints (lower-cased where fold) cannot match."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    fold: bool = False
    hints: tuple[str, ...] = field(default=())


#: Fixed values.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         6, 2, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, False, ("AKIA",)),
    Rule("hex", r"[0-9a-f]+", 24),
)
BASE_VERSION = "base-1"


def _finder(rules: tuple[Rule, ...]) -> Callable[[str], list[tuple[int, int, int]]]:
    ready = []
    for i, rule in enumerate(rules):
        flags = re.ASCII | (re.IGNORECASE if rule.fold else 0)
        pattern = rule.pattern
        if re.fullmatch(r"\[[^\]]+\]\+", pattern):  # a maximal run: shorter ones need no match object
            pattern = f"{pattern[:-1]}{{{rule.least},}}"
        ready.append((i, re.compile(pattern, flags), rule))

    def find(text: str) -> list[tuple[int, int, int]]:
        low = text.lower() if any(r.fold for _, _, r in ready) else text
        found = []
        for i, pattern, rule in ready:
            if rule.hints and not any(h in (low if rule.fold else text) for h in rule.hints):
                continue
            found += [(m.start(), i, m.end()) for m in pattern.finditer(text)
                      if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return sorted(found)

    return find


def _scan(rules: tuple[Rule, ...], version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in find(t.as_py())]
                     for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), pa.array([version] * len(spans), pa.string()),
                 pa.array(spans, kind)], names=["blob", "rule_version", "spans"])

    return run


def blob_id(text_col: str = "text") -> Column:
    return F.sha2(text_of(text_col), 256)


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger, empty before its first scan."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if not there:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan_new_blobs(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE_RULES,
                   rule_version: str = BASE_VERSION, text_col: str = "text") -> None:
    """Adds to the ledger what it lacks: each unseen text once, however many paths and versions
    have it."""
    seen = read_ledger(versions.sparkSession, ledger).where(F.col("rule_version") == rule_version)
    rows = versions.select(blob_id(text_col).alias("blob"), text_of(text_col).alias("text"))
    unseen = rows.join(seen.select("blob"), "blob", "left_anti")
    blobs = unseen.groupBy("blob").agg(F.first("text").alias("text"))
    blobs.mapInArrow(_scan(rules, rule_version), LEDGER).write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, rule_version: str = BASE_VERSION,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob, spans for every row of versions whose text the ledger holds."""
    known = read_ledger(versions.sparkSession, ledger).where(F.col("rule_version") == rule_version)
    known = known.groupBy("blob").agg(F.first("spans").alias("spans"))  # two scans may have overlapped
    paths = versions.select(F.col(id_col).alias("doc_id"), blob_id(text_col).alias("blob"))
    return paths.join(known, "blob", "left").select("doc_id", "blob", "spans")


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE_RULES,
         rule_version: str = BASE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan_new_blobs, then findings of every row."""
    scan_new_blobs(versions, ledger, rules, rule_version, text_col)
    return findings(versions, ledger, rule_version, id_col, text_col)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
