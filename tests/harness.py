"""Run a registered query on Spark and its oracle on DuckDB; compare value by value."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9) + 0.0
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, int):
        return v
    return v


def oracle_rows(sql: str, sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf, t)}.parquet')")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    return cols, cur.fetchall(), [str(c[1]) for c in cur.description]


def compare(df, sql: str, sf: str) -> list[str]:
    cols, rows, types = oracle_rows(sql, sf)
    problems = []
    if sorted(cols) != sorted(df.columns):
        return [f"columns: spark {sorted(df.columns)} oracle {sorted(cols)}"]
    names = sorted(cols)
    got = df.select(*names).toArrow()
    columns = [got.column(c).to_pylist() for c in names]
    columns = [[norm(v) for v in c] if any(isinstance(v, float) for v in c[:1000]) else c for c in columns]
    sp = list(zip(*columns))
    ix = [cols.index(c) for c in names]
    ora = [tuple(norm(r[i]) for i in ix) for r in rows]
    if len(sp) != len(ora):
        problems.append(f"row count: spark {len(sp)} oracle {len(ora)}")
    key = lambda t: tuple((x is not None, "" if x is None else x) for x in t)
    sp.sort(key=key)
    ora.sort(key=key)
    diff = [(a, b) for a, b in zip(sp, ora) if a != b]
    if diff:
        problems.append(f"{len(diff)} of {len(sp)} rows differ, first: spark {diff[0][0]} oracle {diff[0][1]} cols {names}")
    if not ora:
        problems.append("no rows")
    st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c, t in zip(cols, types):
        kind = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}.get(t, t)
        if kind != st[c]:
            problems.append(f"type {c}: spark {st[c]} oracle {t}")
    return problems


def main() -> None:
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from boxlens.session import local_session

    import logging
    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    logging.getLogger("py4j").setLevel(logging.ERROR)
    qs, ora = entry.queries(), entry.oracle_sql()
    want = sys.argv[1:] or list(qs)
    want = [q for w in want for q in qs if q == w or (w.endswith("*") and q.startswith(w[:-1]))]
    bad = 0
    for name in want:
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            if name in ora:
                problems = compare(df, ora[name], sf)
            else:
                n = df.count()
                problems = [] if n else ["no rows"]
        except Exception as exc:
            problems = [f"{type(exc).__name__}: {str(exc)[:900]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - t0:.1f}s{' ' if name in ora else ' (rows only)'}", flush=True)
        for p in problems:
            print("     ", p[:1500], flush=True)
    print("failed:", bad, "of", len(want))


if __name__ == "__main__":
    main()
