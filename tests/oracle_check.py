"""Compare registered queries with their DuckDB SQL: python tests/oracle_check.py [pattern] [sf].
"""

from __future__ import annotations

import fnmatch
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
STRICT = "STRICT" in os.environ


def norm(v):
    if isinstance(v, float):
        if STRICT and not math.isnan(v):
            return repr(v + 0.0)
        return None if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        if STRICT:
            return repr(float(v))
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def key(row):
    return tuple((x is not None, str(x)) for x in row)


KINDS = {"long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
         "date": "DATE"}


def compare(df, con, sql):
    cols = sorted(df.columns)
    rel = con.sql(sql)
    types = dict(zip(rel.columns, map(str, rel.types)))
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    bad = [f"{f.name}:{f.dataType.typeName()}/{types[f.name]}" for f in df.schema
           if KINDS.get(f.dataType.typeName(), types[f.name]) != types[f.name]]
    mine = sorted(([norm(r[c]) for c in cols] for r in df.collect()), key=key)
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted(([norm(r[i]) for i in at] for r in rel.fetchall()), key=key)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if diff:
        return f"{len(diff)} of {len(mine)} rows differ, e.g. {cols}\n  spark {diff[0][0]}\n  duck  {diff[0][1]}"
    if bad:
        return f"types differ {bad}"
    return None if mine else "no rows"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from keepwell import get_session

    pattern = sys.argv[1] if len(sys.argv) > 1 else "*"
    sf = f"/root/testdata/{sys.argv[2] if len(sys.argv) > 2 else 'sf0.01'}"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                             "spark.driver.memory": "8g"})
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    con.execute("SET TimeZone='UTC'")
    sqls, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if not any(fnmatch.fnmatch(name, p) for p in pattern.split(",")):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                n = df.count()
                problem = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        failed += bool(problem)
        mark = "FAIL" if problem else "ok" if name in sqls else "rows"
        print(f"{mark:5}{name:40}{time.time() - start:6.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
