"""Run queries next to their SQL and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(spark, con, sf_dir, query, sql) -> list[str]:
    df = query(spark, sf_dir)
    columns, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names, expected = rows_of([c[0] for c in cur.description], cur.fetchall())
    if columns != names:
        return [f"columns {columns} != {names}"]
    if got == expected:
        return []
    extra = [r for r in got if r not in set(expected)][:2]
    missing = [r for r in expected if r not in set(got)][:2]
    return [f"rows {len(got)} / {len(expected)}", f"only here: {extra}"[:1500], f"only in SQL: {missing}"[:1500]]


def main(argv):
    import __spark_entry__ as e
    from candidata.cluster import local_session

    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = e.queries(), e.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(a in n for a in argv[1:])]
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in sqls:
                found = differences(spark, con, sf_dir, queries[name], sqls[name])
            else:
                found = [] if queries[name](spark, sf_dir).collect() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:1200]}"]
        bad += bool(found)
        mark = "BAD" if found else "ok " if name in sqls else "row"
        print(f"{mark} {name} {time.time() - start:.1f}s", *found, sep="\n    " if found else " ", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
