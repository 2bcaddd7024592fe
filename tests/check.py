"""Run registered queries next to their DuckDB SQL: python tests/check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def key(row):
    return tuple((v is not None, str(type(v)), v if not isinstance(v, float) else round(v, 3)) if v is not None else (False, "", 0) for v in row)


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return float(a) == float(b)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    return a == b


def compare(spark, con, sf_dir: str, query, sql: str | None):
    """(rows, message); an empty message means the results are equal."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    nan = sum(1 for f in df.schema.fields if f.dataType.typeName() == "void")
    if nan:
        return len(got), "void column"
    if sql is None:
        return len(got), "" if got else "no rows"
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return len(got), f"columns {cols} != {sorted(rel.columns)}"
    idx = [rel.columns.index(c) for c in cols]
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    kinds = {"DOUBLE": "double", "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "DATE": "date"}
    for f in df.schema.fields:
        if kinds.get(types[f.name], "?") not in (f.dataType.simpleString(), "?") or types[f.name] == "HUGEINT":
            return len(got), f"type {f.name}: {f.dataType.simpleString()} != {types[f.name]}"
    want = [tuple(plain(r[i]) for i in idx) for r in rel.fetchall()]
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}"
    if not got:
        return 0, "no rows"
    got.sort(key=key)
    want.sort(key=key)
    bad = [(g, x) for g, x in zip(got, want) if not all(same(a, b) for a, b in zip(g, x))]
    if bad:
        return len(got), f"{len(bad)} rows differ in {cols}, e.g.\n      spark {bad[0][0]}\n      duck  {bad[0][1]}"
    allnull = [c for i, c in enumerate(cols) if all(r[i] is None for r in got)]
    return len(got), f"all NULL: {allnull}" if allnull else ""


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tickloom.session import local_session

    sf = argv[0] if argv else "0.01"
    names = [n for n in entry.queries() if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    failed = 0
    for n in names:
        t = time.time()
        try:
            rows, msg = compare(spark, con, sf_dir, entry.queries()[n], entry.oracle_sql().get(n))
        except Exception as e:  # report and go on with the next query
            rows, msg = -1, f"{type(e).__name__}: {str(e)[:700]}"
        failed += bool(msg)
        kind = "sql " if n in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if msg else 'ok  '} {kind} {n:42s} {rows:8d} rows {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
