"""Every registered query that has SQL gives what the SQL gives."""

import pytest

import __spark_entry__
from candor.plans import oracles, queries
from tests.compare import connect, difference

HEAVY = {"gbt_predictions", "model_metrics", "feature_importance", "synthetic_injection", "ablation", "shap_topk", "top_signals"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in HEAVY])
def test_same_as_sql(spark, sf, con, name):
    df, told = queries.QUERIES[name](spark, sf), oracles.oracles()
    if name in told:
        assert difference(df, con, told[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
