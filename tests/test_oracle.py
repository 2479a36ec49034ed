"""Every query of the engine that SQL can express, against DuckDB."""

import pytest

from cobordia import catalogue
from tests.conftest import SF, same


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    same(catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["modularity_clusters", "topolms_train", "label_propagation", "stream_agents", "stream_exchange", "planned_case"])
def test_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
