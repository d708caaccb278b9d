"""Compare registered queries with their SQL oracles: ``python tests/check.py [sf] [name...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
import warnings

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0 if value else 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def key(row):
    return tuple((v is None, str(type(v)) if not isinstance(v, (int, float, bool)) else "", str(v)) for v in row)


def compare(df, con, sql: str):
    """(problem or None, rows)."""
    names = sorted(df.columns)
    got = [tuple(norm(r[n]) for n in names) for r in df.collect()]
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return f"columns {names} against {sorted(cols)}", len(got)
    at = [cols.index(n) for n in names]
    want = [tuple(norm(r[i]) for i in at) for r in rel.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}", len(got)
    got.sort(key=key)
    want.sort(key=key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ on {names}, first {bad[0][0]} against {bad[0][1]}", len(got)
    types = {
        n: (type(g).__name__, type(w).__name__)
        for g, w in zip(got[:1], want[:1])
        for n, g, w in zip(names, g, w)
        if type(g) is not type(w)
    }
    return (f"types {types}" if types else None), len(got)


def main(argv):
    warnings.filterwarnings("ignore")
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.conftest import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    failed = []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem, rows = compare(df, con, oracles[name])
            else:
                rows = df.count()
                problem = None if rows else "no rows"
        except Exception as error:  # report and go on
            problem, rows = f"{type(error).__name__}: {str(error)[:900]}", -1
        mark = "ok " if problem is None else "BAD"
        kind = "sql" if name in oracles else "rows"
        print(f"{mark} {kind:4} {time.time() - start:6.2f}s {rows:7} {name} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
