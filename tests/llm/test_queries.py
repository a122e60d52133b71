"""Every query against its SQL, on the smallest tables where they are there."""

import os
from collections import Counter

import pytest

from coursegrain.llm import queries as registry

FOLDER = os.environ.get("COURSEGRAIN_TABLES", "/root/testdata/sf0.001")
TABLES = "events documents modules extracted_pages slides facts triples cards relation_list eval_items".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(registry.SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[k]) for k in at) for r in res.fetchall())


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
