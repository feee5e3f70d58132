"""Comparison of a Spark result with DuckDB on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def compare(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=str)
    want = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in want), key=str)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w and not all(a == b or (isinstance(a, float) and b is not None and abs(a - float(b)) < 2e-5 * max(1, abs(a))) for a, b in zip(g, w, strict=True))]
    assert not bad, bad[:3]
