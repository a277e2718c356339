"""Every reference query against its SQL on the small tables, as the driver compares them."""

import duckdb
import pytest

from tidebook.plans import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, small, tmp_path, name):
    QUERIES[name](spark, small).write.parquet(str(tmp_path / "out"))
    got = duck.sql(f"select * from '{tmp_path}/out/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    want = duck.sql(f"select {columns} from ({ORACLE[name]})")
    assert sorted(duck.sql(ORACLE[name]).columns) == sorted(got.columns)
    found = duck.sql(f"select {columns} from '{tmp_path}/out/*.parquet'")
    assert found.types == want.types
    a, b = (sorted(map(repr, r.fetchall())) for r in (found, want))
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["symbol", "horizon", "n", "mean_ic"]
    assert set(e.oracle_sql()) <= set(e.queries())
