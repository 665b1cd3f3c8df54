"""Each catalogue query against its SQL in DuckDB."""

import duckdb
import pytest

from polislake import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(name, spark, sf, duck, tmp_path):
    Q.queries()[name](spark, sf).write.parquet(f"{tmp_path}/out")
    sql = Q.oracle_sql()[name]
    names = sorted(r[0] for r in duck.sql(f"DESCRIBE {sql}").fetchall())
    got = duck.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'")
    assert sorted(got.columns) == names
    pick = ", ".join(f'"{n}"' for n in names)
    a, b = f"SELECT {pick} FROM '{tmp_path}/out/*.parquet'", f"SELECT {pick} FROM ({sql})"
    assert duck.sql(f"({a}) EXCEPT ALL ({b})").fetchall() == []
    assert duck.sql(f"({b}) EXCEPT ALL ({a})").fetchall() == []


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 5
    assert set(E.oracle_sql()) <= set(E.queries())
