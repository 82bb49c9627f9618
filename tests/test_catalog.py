"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from prismal.plans import catalog
from prismal.plans import extras as _extras  # noqa: F401  registers its queries
from prismal.plans import blocks as _blocks  # noqa: F401  registers its queries
from prismal.plans import filters as _filters  # noqa: F401  registers its queries
from prismal.plans import samples as _samples  # noqa: F401  registers its queries
from prismal.plans import searches as _searches  # noqa: F401  registers its queries

DATA = os.environ.get("PRISMAL_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    found, want = canonical(catalog.QUERIES[name](spark, DATA).toPandas()), canonical(duck.sql(catalog.ORACLES[name]).df())
    assert list(found.columns) == list(want.columns)
    assert len(found) > 0 or name == "missing_cases"
    for c in found:
        found[c], want[c] = found[c].astype(object).where(found[c].notna(), None), want[c].astype(object).where(want[c].notna(), None)
    pd.testing.assert_frame_equal(found, want, check_dtype=False, check_exact=False, rtol=1e-9)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_the_rest_works_without_the_optional_folder():
    code = "import sys; sys.modules['prismal.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert 'context_entropy' in e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
