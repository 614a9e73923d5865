"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    frame = registry.queries()[name](spark, DATA)
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert _normal([tuple(r) for r in frame.collect()], frame.columns) == _normal(result.fetchall(), columns)


def test_the_entry_works_without_a_library_of_the_training_text_operators():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; names = set(e.queries()); assert 'q14_tally' in names and not [n for n in names if n.startswith('op')] and set(e.oracle_sql()) <= names"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
