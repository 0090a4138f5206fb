from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else float(v) if isinstance(v, float) else v


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(str([None if v is None or v != v else v for v in (plain(x) for x in r)]) for r in frame[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
