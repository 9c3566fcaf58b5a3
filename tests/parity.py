"""Run registered queries against their SQL in DuckDB and report every difference."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir, plan, sql):
    """None when both sides agree, else a short account of the difference."""
    mine = plan(spark, sf_dir)
    columns, got = table_rows(mine.columns, mine.collect())
    cursor = con.execute(sql)
    names, want = table_rows([d[0] for d in cursor.description], cursor.fetchall())
    if columns != names:
        return f"columns {columns} / {names}"
    kinds = dict((d[0], str(d[1])) for d in cursor.description)
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)} rows; {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    for g, w in zip(got, want):
        if any(type(a) is not type(b) for a, b in zip(g, w)):
            return f"types differ: {g} / {w} {kinds}"
    return None


def main(sf: str, *names: str) -> int:
    from logloom.session import local_session

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not names or any(q.startswith(n) for n in names)]
    failed = 0
    for name in wanted:
        begin = time.time()
        try:
            if name in oracles:
                fault = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                n = len(queries[name](spark, sf_dir).collect())
                fault = None if n else "no rows"
        except Exception as error:  # report and go on
            fault = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += fault is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if fault is None else 'FAIL'} {kind} {name} {time.time() - begin:.2f}s {fault or ''}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
