"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import lintlake.plans  # noqa: F401
from lintlake.plans import registry


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(registry.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted((tuple(_plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_answers_of_the_logs(spark, sf_dir):
    """The one query without SQL: every raw answer is judged once, a valid one has a score, an invalid one a reason."""
    assert set(registry.QUERIES) - set(registry.SQL) == {"json_contract_parse"}
    rows = registry.QUERIES["json_contract_parse"](spark, sf_dir).collect()
    assert rows and len({r.ref for r in rows}) == len(rows) == registry.QUERIES["raw_answers_count"](spark, sf_dir).selectExpr("sum(answers)").first()[0]
    assert all((r.status == "valid") == (r.error is None) == (r.score is not None) for r in rows)
