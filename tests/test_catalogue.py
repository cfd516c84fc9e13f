"""Every query against its SQL in another engine."""

import subprocess
import sys

import pytest

from tracewell import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, small, same):
    same(catalogue.queries()[name](spark, small), SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_runs(name, spark, small):
    assert catalogue.queries()[name](spark, small).columns


def test_entry_without_the_text_operators():
    code = "import sys; sys.modules['tracewell.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
