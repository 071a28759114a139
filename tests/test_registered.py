"""Every registered query of the DNS library against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as driver
from dnsloom.workload import oracle
from dnsloom.workload import queries as registered

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(value)
    return value


def test_every_query_has_its_sql():
    assert set(registered.queries()) == set(SQL)
    assert set(registered.queries()) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", list(registered.queries()))
def test_query(spark, duck, name):
    result = registered.queries()[name](spark, FOLDER)
    columns = sorted(result.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in result.collect()), key=repr)
    answer = duck.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=repr)
    assert got == expected


def test_flagship(spark):
    result = driver.entry(spark)
    assert result.count() == 1000


def test_entry_without_the_libraries_of_the_training_data_operators():
    """A missing optional library takes its queries away, not the entry."""
    script = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[0] in ('xxhash', 'regex', 'tokenizers') or name.startswith('dnsloom.llm'):\n"
        "            raise ImportError(f'no {name}')\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'analyze' in e.queries() and not any(k.startswith('op') for k in e.queries())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
