"""Every registered query against its SQL, and near-duplicate pairs against brute force."""

from __future__ import annotations

import re

import duckdb
import pytest

from gleaner.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "events", "labels", "conversations", "embeddings")


def rows(df):
    out = []
    for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None):
        out.append(tuple("null" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else re.sub(r"np\.\w+\(([^)]*)\)", r"\1", str(x)) for x in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_flagship():
    assert catalog.FLAGSHIP in catalog.QUERIES and catalog.FLAGSHIP in catalog.SQL
