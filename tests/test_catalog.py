"""Every query with SQL against the oracle on the smallest tables; the others return rows."""

import duckdb
import pytest

from lumenforge.plans import catalog

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def key(rows):
    return sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert key(got.select(*cols).collect()) == key([[r[i] for i in at] for r in cur.fetchall()])


def test_flagship_is_ranked_and_accepts_nothing(spark):
    rows = catalog.queries()[catalog.FLAGSHIP](spark, SF).collect()
    assert [r["posterior"] for r in rows] == sorted((r["posterior"] for r in rows), reverse=True)
    assert all(r["acceptance_label"] is None and r["delete_media"] is False for r in rows)
