"""Every registered query with SQL against DuckDB; the others give rows of a stable schema."""

from __future__ import annotations

import pytest
from brindle.plans import registry, series_queries, text_queries
from conftest import SF_SMALL
from oracle import same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same(QUERIES[name](spark, SF_SMALL), SQL[name], SF_SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0 and df.columns


EXAMPLES = text_queries.EXAMPLES | series_queries.EXAMPLES
EXAMPLES_SQL = text_queries.EXAMPLES_SQL | series_queries.EXAMPLES_SQL


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_examples(spark, name):
    assert name not in QUERIES
    if name in EXAMPLES_SQL:
        same(EXAMPLES[name](spark, SF_SMALL), EXAMPLES_SQL[name], SF_SMALL)
    else:
        assert EXAMPLES[name](spark, SF_SMALL).count() > 0


def test_number_mask_reads_documents(spark):
    out = QUERIES["number_mask_documents"](spark, SF_SMALL)
    assert out.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count() and out.filter("text LIKE '%<NUM>%'").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
