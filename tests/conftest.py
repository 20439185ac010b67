import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from tallyledger import LedgerRules  # noqa: E402

MOVEMENT = (
    "item_code string, warehouse string, movement_date timestamp_ntz, movement_type string, "
    "quantity double, reference string, item_description string"
)
BALANCE = "item_code string, warehouse string, balance_date timestamp_ntz, quantity double, item_description string"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rules():
    return LedgerRules(
        movement_types={
            "receipts": ["GRN", "PRODUCTION_IN"],
            "issues": ["ISSUE", "SALES_DISPATCH"],
            "adjustments": ["STOCK_ADJ"],
        },
        issues_stored_positive=True,
        dormant_days=90,
        outlier_zscore=3.0,
        variance_tolerance=0.5,
    )


def day(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture
def moves(spark):
    def build(rows):
        return spark.createDataFrame([(i, w, day(d), t, float(q), r, "") for i, w, d, t, q, r in rows], MOVEMENT)

    return build


@pytest.fixture
def held(spark):
    def build(rows):
        return spark.createDataFrame([(i, w, day(d), float(q), "") for i, w, d, q in rows], BALANCE)

    return build


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
