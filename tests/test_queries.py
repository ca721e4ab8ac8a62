"""The library's queries against their SQL on the smallest tables, and the entry point."""

import os

import duckdb
import pytest

from tilequarry.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@needs_data
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tmp_path, name):
    out = str(tmp_path / "out")
    QUERIES[name](spark, SF).write.parquet(out)
    c = duckdb.connect()
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    c.sql(f"CREATE TABLE want AS {ORACLE_SQL[name]}")
    c.sql(f"CREATE TABLE got AS SELECT * FROM '{out}/*.parquet'")
    kinds = lambda t: dict(c.sql(f"SELECT column_name, column_type FROM (DESCRIBE {t})").fetchall())
    assert kinds("got") == kinds("want")
    columns = ", ".join(f'"{x}"' for x in kinds("want"))
    for a, b in (("got", "want"), ("want", "got")):
        assert c.sql(f"SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchall()[0][0] == 0


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
