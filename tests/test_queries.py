"""Every registered query against its reference SQL, and a look at every plan."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

from crashgrid.checks.oracles import ORACLES  # noqa: E402
from crashgrid.checks.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def reference(sf):
    connection = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def normal(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, reference, name):
    result = QUERIES[name](spark, sf)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    answer = reference.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(result.columns) == sorted(columns)
    assert normal(result.collect(), result.columns) == normal(answer.fetchall(), columns)


def test_entry(spark):
    assert os.path.isdir(entry.SMALLEST)
    assert entry.entry(spark).count() == 1
