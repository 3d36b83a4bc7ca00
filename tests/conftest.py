import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfspan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests", partitions=4)


@pytest.fixture
def panel_of(spark):
    """A panel of one pair from (day, stock, received, sold) rows."""

    def build(rows, store="S1", sku="K1"):
        data = [(store, sku, f"2024-01-{d:02d}", float(s), float(r), float(u)) for d, s, r, u in rows]
        return spark.createDataFrame(data, "store_id string, sku_uid string, date string, store_stock double, received double, units_sold double").selectExpr(
            "store_id", "sku_uid", "cast(date as date) as date", "store_stock", "received", "units_sold")

    return build
