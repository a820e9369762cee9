"""Every registered query against its DuckDB oracle at sf0.01 (the driver's check)."""

import os
import sys

import pytest

from conftest import ROOT, SF01

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

from fieldlink.plans.queries import QUERIES  # noqa: E402

NAMES = sorted(QUERIES)  # the optional training-data queries have tests of their own


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql()) and set(NAMES) <= set(E.queries())
    assert len(NAMES) == 37


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF01)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["seq", "assetID", "title", "description", "filename", "location", "status"]
    assert df.count() > 0


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE", "date": "DATE"}


@pytest.mark.parametrize("name", NAMES)
def test_query_types_match_oracle(spark, con, name):
    schema = E.queries()[name](spark, SF01).schema
    got = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in schema.fields}
    rel = con.sql(E.oracle_sql()[name])
    want = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert got == want
