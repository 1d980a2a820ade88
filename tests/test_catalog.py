"""Every catalogue query against DuckDB."""

from collections import Counter

import duckdb
import pytest
from conftest import DATA

from gleanery.plans import catalog, catalog_retrieval  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return c


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(tuple(r[i]) if isinstance(r[i], list) else r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in catalog.ORACLE_SQL:
        cursor = con.execute(catalog.ORACLE_SQL[name])
        want = bag([d[0] for d in cursor.description], cursor.fetchall())
        assert sorted(df.columns) == sorted(d[0] for d in cursor.description)
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
