"""Queries that plan, preview or parse every detection, on tables with ids far apart and more rows than a page."""

import datetime

import pytest

from tripwise.plans.queries import QUERIES

IDS = [1, 3, 399, 400, 401, 1999, 2000, 2001, 50_000, *range(60_000, 60_800)]
DAY = datetime.date(1992, 1, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Each detection of IDS has id % 5 + 1 events, one a second, on the first day."""
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, n + 1, DAY) for i in IDS for n in range(i % 5 + 1)], "l_orderkey long, l_linenumber int, l_shipdate date").write.parquet(f"{d}/lineitem.parquet")
    orders = [(i, 7, "2-HIGH", datetime.datetime(2020, 1, 1)) for i in IDS]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(7, "cam")], "c_custkey long, c_name string").write.parquet(f"{d}/customer.parquet")
    return d


def test_event_preview_of_all_detections(spark, tables):
    got = {r.detection_id: r.preview for r in QUERIES["event_preview"](spark, tables).collect()}
    clock = lambda n: ", ".join(f"00:00:00.{k:03}" for k in range(1, min(n, 3) + 1)) + (f" +{n - 3} more" if n > 3 else "")
    assert got == {i: clock(i % 5 + 1) for i in IDS}


def test_snapshot_plan_of_all_events(spark, tables):
    got = sorted((r.path, r.detection_id, r.t_ms, r.seek_ms, r.target) for r in QUERIES["snapshot_plan"](spark, tables).collect())
    assert got == sorted(("/inbox/cam.mp4", i, n + 1, 0, f"out/cam/det_{i}/event_{n + 1}.jpg") for i in IDS for n in range(i % 5 + 1))


def test_parse_detection_id_of_all_rows(spark, tables):
    got = [(r.id, r.parsed) for r in QUERIES["parse_detection_id"](spark, tables).collect()]
    assert sorted(got) == [(i, i if i % 5 else None) for i in IDS]
