"""Every query of the library against its SQL on the small tables."""

import duckdb
import pytest

from quantspark.plans import registry

TABLES = "lineitem events part documents".split()


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple("NULL" if r[i] is None else str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got or name == "p15_distinct_colors"
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == rows(rel.columns, rel.fetchall())


def test_entry(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() > 0
