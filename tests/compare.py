"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float) and value.is_integer():
        return value + 0.0
    if isinstance(value, float):
        return round(value, 9)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def check(spark, con, sf_dir, name):
    from gaugeframe.plans import catalog

    df = catalog.QUERIES[name](spark, sf_dir)
    got_columns, got = sorted_rows(df.columns, df.collect())
    types = dict(df.dtypes)
    if name not in catalog.ORACLES:
        return len(got), None
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    want_columns, want = sorted_rows(names, cur.fetchall())
    assert got_columns == want_columns, f"{name}: columns {got_columns} != {want_columns}"
    assert len(got) == len(want), f"{name}: {len(got)} rows, SQL has {len(want)}"
    for g, w in zip(got, want, strict=True):
        if g != w or [type(v) for v in g] != [type(v) for v in w]:
            bad = [(c, types.get(c), a, b) for c, a, b in zip(got_columns, g, w, strict=True)
                   if a != b or type(a) is not type(b)]
            raise AssertionError(f"{name}: {bad}")
    return len(got), len(want)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from gaugeframe.plans import catalog
    from gaugeframe.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    for name in catalog.QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            print(name, check(spark, con, sf, name), f"{time.time() - t:.2f}s", flush=True)
        except Exception as exc:  # noqa: BLE001
            print("FAIL", name, f"{time.time() - t:.2f}s", str(exc)[:1500], flush=True)
