"""Every registered query of the language against DuckDB on the same files."""

import logging
import warnings

import duckdb
import pytest

from brook import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in queries.NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].copy()
    for c in columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(4)
    frame = frame.astype(object).where(frame.notna(), None)
    show = lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return columns, sorted(tuple(map(show, r)) for r in frame.values.tolist())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    logging.disable(logging.WARNING)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        mine = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        assert rows(mine) == rows(duck.sql(queries.ORACLE_SQL[name]).df())
    else:
        assert list(mine.columns)


def test_samples_have_their_size(spark):
    from brook import run
    from brook.sources import tables_in

    t = tables_in(spark, SF, ["events"])
    assert run(spark, "from events sample 100", t).count() == 100
    assert 0 < run(spark, "from events sample 10%", t).count() < 300
    assert list(t.opened) == ["events"]
