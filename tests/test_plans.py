"""Plans that should hold at any size, and the entry's contract."""

import pytest

import __spark_entry__
from quern.plans.planner import query, selected
from quern.plans.spec import read
from quern.sources.catalog import tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def catalog(spark):
    return tables(spark, FOLDER)


def explained(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(catalog):
    spec = read({"collection": "orders", "where": {"o_totalprice": {"$gte": 100000}, "o_orderkey": {"$ne": 5}}})
    plan = explained(selected(catalog["orders"].documents(), spec, catalog).select("o_totalprice"))
    assert "GreaterThanOrEqual(o_totalprice,100000.0)" in plan and "Not(EqualTo(o_orderkey,5))" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_keys_reach_the_scan_as_the_native_type(catalog):
    plan = explained(query(catalog, {"collection": "orders", "keys": ["1", "5", "17"]}))
    assert "In(o_orderkey," in plan.split("PushedFilters:")[1].split("ReadSchema")[0]


def test_a_sorted_page_is_one_top_k(catalog):
    plan = explained(query(catalog, {"collection": "orders", "sort": "o_totalprice", "count": 20, "offset": 20}))
    assert "TakeOrderedAndProject(limit=40, offset=20" in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_nothing_forces_a_broadcast(spark, catalog):
    spec = read({"collection": "orders", "joins": [{"c": {"from": "customer", "on": "customer_ref"}}]})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in explained(selected(catalog["orders"].documents(), spec, catalog))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
