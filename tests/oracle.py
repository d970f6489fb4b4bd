"""Compare queries with their SQL, as the driver does: rows as multisets, columns by name."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def rows_of(table):
    names = sorted(table.column_names)
    rows = zip(*[table[n].to_pylist() for n in names]) if names else []
    return names, sorted((tuple(r) for r in rows), key=repr)


def compare(query, sql, spark, sf_dir, con):
    got = rows_of(query(spark, sf_dir).toArrow())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(x == y or isinstance(x, float) and abs(x - y) <= 2e-6 for x, y in zip(a, b)), (a, b)
