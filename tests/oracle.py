"""Compares a query with its SQL in DuckDB: columns by name, rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((repr(tuple(clean(r[k]) for k in order)) for r in data)), [names[k] for k in order]


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    want, names = rows([d[0] for d in cur.description], cur.fetchall())
    df = query(spark, sf_dir)
    got, own = rows(df.columns, [tuple(r) for r in df.collect()])
    assert own == names, (own, names)
    assert len(got) == len(want), (len(got), len(want), got[:2], want[:2])
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, bad[:2]
