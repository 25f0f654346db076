import duckdb
import pytest

from loomframe.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_is_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in catalogue.SQL:
        assert rows
        return
    found = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted(repr(tuple(r[c] for c in order)) for r in rows)
    theirs = sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in found.fetchall())
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as entry_points

    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
