"""What the plans of operators look like: scans, windows, pushed filters."""

import re

from pyspark.sql import functions as F

from traceloom.operators import aggregate, ioc, process, temporal
from traceloom.operators.filters import QuerySpec
from traceloom.plans.registry import QUERIES

from .conftest import DATA


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ancestors_are_one_scan_however_deep(spark):
    edges = spark.createDataFrame([(k, k - 1 if k else None) for k in range(100)], "id int, parent_id int")
    assert leaves(process.ancestors(edges)) == 1


def test_indicators_are_one_pass_of_the_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = spark.createDataFrame([(f"word{k}.example.com",) for k in range(500)], "ioc string")
    assert plan(ioc.match(docs, names, ["text"], "doc_id")).count("FileScan") == 1
    many = plan(ioc.match(docs, names, ["text"], "doc_id", at_once=200))
    assert many.count("FileScan") == 1 and "MapInArrow" not in many and "Python" not in many


def test_totals_need_no_window_over_all_rows(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    for df in (aggregate.stack_values(events, "event_type"), aggregate.source_coverage(events, "event_type", "ts")):
        assert "Window" not in plan(df)
    assert "collect_set" not in plan(temporal.password_spray(events, "user_id", "event_type", "ts"))


def test_filters_and_columns_reach_the_scan(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    spec = QuerySpec(checked={"event_type": ["error"]}, ranges={"value": (F.lit(1.0), F.lit(2.0))})
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    shown = plan(spec.apply(events).select("event_id"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", shown)
    assert "EqualTo(event_type,error)" in pushed[1] and "LessThanOrEqual(value,2.0)" in pushed[1]
    assert set(re.findall(r"(\w+):", pushed[2])) == {"event_id", "event_type", "value"}


def test_windowed_detectors_split_a_source_by_time(spark):
    shown = plan(QUERIES["brute_force_window"](spark, DATA))
    keys = re.search(r"Window.*?\n.*?Exchange hashpartitioning\((.*?), \d+\)", shown, re.S)
    assert "user_id" in keys[1] and "__slot" in keys[1]
