"""Holds a query's rows against its SQL in DuckDB."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    """Rows as sorted texts, columns by name."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([row[i] for i in order]) for row in rows)


def duck(sql, views=None):
    with duckdb.connect() as c:
        for name in TABLES:
            path = f"{DATA}/{name}.parquet"
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
        for name, frame in (views or {}).items():
            c.register(f"_{name}", frame)
            c.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM _{name}")
        c.execute(sql)
        return [d[0] for d in c.description], c.fetchall()


def same(spark_df, sql, views=None):
    names, rows = duck(sql, views)
    assert sorted(spark_df.columns) == sorted(names)
    assert rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()]) == rows_of(names, rows)
