"""Every query against its SQL on the smallest tables."""

import pytest

from oracle_check import compare, connect
from tabsense.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
SLOW = {"leaderboard", "leaderboard_regression", "feature_importance", "batch_score", "batch_score_facts"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SLOW])
def test_query(spark, duck, name):
    ok, detail, _, _ = compare(spark, duck, FOLDER, name, QUERIES[name], SQL.get(name))
    assert ok, detail


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 4


def test_no_local_fallback_on_a_cluster():
    from tabsense.storage import shared_dir

    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
