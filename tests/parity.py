"""Run every registered query in Spark and its SQL in DuckDB and compare the rows.

    python -m tests.parity [sf_dir] [name ...]
"""

import math
import sys
import time

import duckdb

from moodspark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def open_tables(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _key(row):
    return tuple(
        (v is None, type(v).__name__, "nan" if isinstance(v, float) and math.isnan(v) else repr(v))
        for v in row
    )


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=_key)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def compare(spark, con, sf, fn, sql):
    """None when equal, else what differs."""
    df = fn(spark, sf)
    ours = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = [str(d[1]) for d in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    expected = {c: KINDS.get(t, t) for c, t in df.dtypes}
    got = dict(zip(names, kinds, strict=True))
    types = {c: (expected[c], got[c]) for c in names if expected[c] != got[c]}
    if types:
        return f"types {types}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"first difference:\n  {str(x)[:600]}\n  {str(y)[:600]}"
    return None


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark, con = local_session(8), open_tables(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        try:
            if name in sqls:
                problem = compare(spark, con, sf, fn, sqls[name])
            else:
                problem = None if fn(spark, sf).count() >= 0 else "no rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.perf_counter() - start:.2f}s", flush=True)
        if problem:
            print("    " + problem, flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
