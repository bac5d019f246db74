"""Every query of the plans against its DuckDB twin; those without one must give rows."""

import pytest

from conftest import same_rows
from granary.plans import ingest, media, sequences, service

CASES = [(p, n) for p in (ingest, service, sequences, media) for n in p.QUERIES]


@pytest.mark.parametrize("plan,name", CASES, ids=[n for _, n in CASES])
def test_query(plan, name, spark, sf_dir, duck):
    df = plan.QUERIES[name](spark, sf_dir)
    if name in plan.ORACLES:
        same_rows(df, duck.sql(plan.ORACLES[name]))
    else:
        assert df.count() > 0


def test_entry_without_llm_names_all(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
