"""Every named query against its SQL on the smallest tables."""

import pytest

import annalum.plans.alike
import annalum.plans.changes
import annalum.plans.complete
import annalum.plans.extensions
import annalum.plans.knowledge
import annalum.plans.more
import annalum.plans.names
import annalum.plans.queries
import annalum.plans.rest
import annalum.plans.stories
import annalum.plans.texts
import annalum.plans.whole  # noqa: F401
from annalum.plans.catalog import ORACLE_SQL, QUERIES
from tests.conftest import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, data, duck, name):
    names, expected = rows_of_sql(duck, ORACLE_SQL[name])
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["a_id", "b_id", "sources", "distance", "direction", "strength"]
