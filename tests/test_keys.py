"""Filters on cleaned keys: the same rows as comparing cleaned keys alone, and conditions that reach the scan."""

import itertools
import re
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from tallyledger import Dataset
from tallyledger.sources.canonical import canonical_scan
from tallyledger.sources.keys import raw_key_condition

TEXTS = [None, "", " ", "A", " A ", "a", "A|B", " A | B ", "A |", "12", "012", "-", "\tM/OLIVE  |30"]
NUMBERS = [None, 0, 12, -3, 30, 2**31 - 1]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(t, n, d, t, 1.0) for t, n, d in itertools.product(TEXTS, NUMBERS, (None, Decimal("12.50"), Decimal("30.00")))]
    schema = "`Stock No` string, `Style #` int, Price decimal(6,2), Place string, Units double"
    return spark.createDataFrame(rows, schema).withColumn("Big", F.col("`Style #`").cast("bigint")).withColumn("Real", F.col("`Style #`").cast("double"))


MAPPINGS = ["Stock No", "Style #", "Price", "Real", ["Style #", "Big"], ["Style #", "Price"], ["Stock No", "Style #"], ["Style #", "Stock No", "Big"], ["Real", "Style #"]]
KEYS = ["A", "A|B", "12", "012", "-", "12|12", "12|30", "A|12", "A|B|12", "12|A", "-3", "-3|-3", "30|30.00", "12.50", "12.5", "12|A|12", "M/OLIVE|30", "0.0", "12.0|12", "2147483647", "2147483648", "|", "||", "x"]


def dataset(mapping):
    return Dataset("stock", "balance", {"item_code": mapping, "item_description": None, "warehouse": "Place", "balance_date": None, "quantity": "Units"})


@pytest.mark.parametrize("mapping", MAPPINGS, ids=str)
def test_the_same_rows_as_cleaned_keys(table, mapping):
    every = canonical_scan(table, dataset(mapping), as_of="2026-01-01")
    counts = {r.item_code: r["count"] for r in every.groupBy("item_code").count().collect()}
    known = [raw_key_condition(table, mapping, key) for key in KEYS]
    raw = [F.count_if(c if c is not None else F.lit(True)).alias(str(k)) for k, c in enumerate(known)]
    passed = table.agg(*raw).first()
    for k, key in enumerate(KEYS):
        assert passed[k] >= counts.get(key, 0), key
    some = [key for key in KEYS if key in counts][:3] + ["x"]
    for key in some:
        rows = canonical_scan(table, dataset(mapping), as_of="2026-01-01", item_code=key)
        assert rows.count() == counts.get(key, 0), key


def test_numbers_tell_the_rows_exactly(table):
    for mapping in ("Style #", "Price", ["Style #", "Big"], ["Style #", "Price"]):
        every = canonical_scan(table, dataset(mapping), as_of="2026-01-01")
        counts = {r.item_code: r["count"] for r in every.groupBy("item_code").count().collect()}
        for key in KEYS:
            assert table.where(raw_key_condition(table, mapping, key)).count() == counts.get(key, 0), (mapping, key)


def test_conditions_reach_the_scan(table, tmp_path, spark):
    table.write.parquet(str(tmp_path / "stock"))
    stored = spark.read.parquet(str(tmp_path / "stock"))

    def pushed(mapping, **keys):
        plan = canonical_scan(stored, dataset(mapping), as_of="2026-01-01", **keys)._jdf.queryExecution().executedPlan().toString()
        return re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1).replace("`", "")

    both = pushed(["Style #", "Big"], item_code="12|12")
    assert "EqualTo(Style #,12)" in both and "EqualTo(Big,12)" in both
    assert "StringContains(Stock No,A)" in pushed("Stock No", item_code="A|B")
    assert "StringContains(Place,A)" in pushed("Stock No", warehouse="A")
    assert "EqualTo(Price,12.50)" in pushed("Price", item_code="12.50")
