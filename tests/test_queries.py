"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from plumbline.plans import auditing, evaluation, features, inference, registry, relational, transcripts  # noqa: F401

SF = "/root/testdata/sf0.001"
SLOW = {"lexical_baseline", "nuisance_classifier", "mlp_heads", "permutation_refit"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(frame):
    cells = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else repr(float(x)) if isinstance(x, float) else str(x)
    names = sorted(frame.columns)
    return names, sorted(tuple(str(cells(x)) for x in row) for row in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF).toPandas()
    theirs = duck.sql(registry.ORACLES[name]).df()
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
