"""The queries of this package against their SQL twins."""

import pytest

from tests.conftest import SF_DIR
from tests.test_oracles import duck, rows_of  # noqa: F401
from tideline.llm import workload  # noqa: F401
from tideline.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    ours = QUERIES[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"pipeline"}))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
