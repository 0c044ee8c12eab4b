"""Every query with an oracle agrees with it on the smallest tables (a quick subset per module; the
whole list is `python tests/check_all.py SF_DIR`)."""

import os

import pytest
from oracle import connect, difference

from tallybook.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FAST = ["orders_revenue", "clean_counters", "numeric_clean", "products_dim", "order_items",
        "order_margins", "training_table", "header_detect", "column_profile", "coverage",
        "conflicts", "forward_fill", "product_facts", "cluster_summary", "name_clusters",
        "refresh_decisions", "run_history", "fuzzy_match", "transliterate", "column_mapping",
        "mapping_warnings", "worded_dates"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", FAST)
def test_query_agrees(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
