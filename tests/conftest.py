import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tracewell.session import local_session

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query's rows with its SQL's."""

    def compare(df, sql):
        names = sorted(df.columns)
        got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
        answer = duck.sql(sql)
        assert sorted(answer.columns) == names
        want = sorted((tuple(dict(zip(answer.columns, r))[n] for n in names) for r in answer.fetchall()), key=repr)
        assert got == want

    return compare
