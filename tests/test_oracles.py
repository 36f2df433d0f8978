"""Every query of the core with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import pytest
from sql_rows import duck_rows, rows_of

from quillspark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    assert rows_of(df) == duck_rows(duck, registry.oracle_sql()[name])


def test_entry(spark, sf):
    import __spark_entry__ as e

    df = e.queries()["entry_corpus_draw"](spark, sf)
    assert df.columns == ["category", "rank", "id"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
