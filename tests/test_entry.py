import duckdb
import pytest

import __spark_entry__ as entry
from gannet import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(rows):
    return sorted(tuple("-" if v is None else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    expected = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({catalog.ORACLE[name]})").fetchall()
    assert _plain(df.select(*cols).collect()) == _plain(expected)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sizes_of_all_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert docs.where("n_chars % 8 = 4").count() > 0
    assert catalog.QUERIES["sizes"](spark, data).count() == docs.count()
