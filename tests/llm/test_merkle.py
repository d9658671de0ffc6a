import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from keepwell.llm import merkle

KIND = "doc_id long, source string, lang string, n_chars long, text string, place long, tree string, node string"
FIELDS = 5


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row[:FIELDS]))


def rise(nodes):
    """All levels of a tree, by the plain rule."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, at):
    out = []
    for level in levels[:-1]:
        start = at // 8 * 8
        out.append(("".join(level[start:at]), "".join(level[at + 1:start + 8])))
        at //= 8
    return out


def slow(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    levels = {name: rise([leaf(r) for r in trees[name]]) for name in names}
    top = rise([levels[name][-1][0] for name in names])
    root, out = top[-1][0] if names else None, []
    for k, name in enumerate(names):
        for at, row in enumerate(trees[name]):
            new = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                new = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            sides = beside(levels[name], at) + beside(top, k)
            fold = leaf(new)
            for left, right in sides:
                fold = digest(left + fold + right)
            out.append((row[0], name, leaf(row), levels[name][-1][0], root, digest("".join(a + b for a, b in sides)),
                        fold, fold == root))
    return sorted(out, key=str)


def run(docs, **options):
    return merkle.manifest(docs, changes={"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")},
                           where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, **options)


def fields(rows):
    return sorted(((r.id, r.tree, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows), key=str)


def documents(n, rng):
    """One language holds most rows; others a handful, one or none."""
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} ÄÖ " + "wOrd " * rng.randrange(5)) for i in range(n)]
    rows += [(n + i, None, "de", None, f"Zeile {i}") for i in range(9)]
    rows += [(5, "s", "fr", 1, "One"), (7, "s", None, 2, None), (None, None, None, None, None), (8, "", None, 0, ""),
             (11, "x", "", 3, "empty name"), (5, "s", "en", 1, "again"), (5, "s", "en", 1, "again"),
             (3, "s", "es", 1, "A" * 300_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [1, 64, 65, 700])
def test_against_the_plain_rule(spark, n):
    rows = documents(n, random.Random(n))
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], KIND).repartition(5)
    assert fields(run(docs).collect()) == slow(rows)


def test_more_than_one_block(spark):
    rng = random.Random(2)
    rows = [(i, "s", "en" if i < 9_000 else "de", i, f"T{i}") for i in range(9_300)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], KIND).repartition(7)
    assert fields(run(docs, copies=False).collect()) == slow(rows)


def test_a_version_copies_its_path_only(spark):
    rows = [(i, "s", "en" if i < 600 else "de", i, f"T{i}") for i in range(640)]
    got = run(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], KIND)).collect()
    changed = [r for r in got if r.changed]
    assert changed and all(r.copies is None for r in got if not r.changed)
    for r in changed:
        # leaf, the levels of its language (4 for 600 rows, 2 for 40) and of the two languages
        assert len(r.copies) == 1 + (4 if r.tree == "en" else 2) + 1
        assert r.copies[0] == r.changed and r.copies[-1] == r.folded_root != r.root
    assert all(r.verified for r in got if not r.changed)


def test_plain_manifest_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "A", 1, "x", "y")], KIND)
    only = merkle.manifest(docs).collect()[0]
    assert only.leaf == only.subroot == only.root == only.folded_root and only.proof_sha256 == digest("")
    assert merkle.verify([only.leaf], [], only.root)
    assert run(docs.limit(0)).count() == 0
