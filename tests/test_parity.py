"""A spread of registered queries against SQL; PARITY_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from parity.check import connect, difference

ROOT = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
SOME = ["panel_build", "spells_competing", "spells_depletion", "km_curve", "aj_cif", "parse_branded_key", "repair_store_id", "findings", "asof_strict",
        "lead_summary", "supplier_performance", "forecast_accuracy", "feature_days_of_cover", "c_index", "bands", "explain", "reorder_demand", "path_summary",
        "recommend", "lead_corr"]
NAMES = list(entry.oracle_sql()) if os.environ.get("PARITY_ALL") else SOME


@pytest.fixture(scope="module")
def sql():
    return connect(ROOT)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sql, name):
    got = entry.queries()[name](spark, ROOT).toPandas()
    assert difference(got, sql.execute(entry.oracle_sql()[name]).df()) is None
