"""Physical plans: what is pushed down, what is shuffled, what is broadcast."""

import re

import pytest
from conftest import SAMPLE

from trailmark.operators import enrich, insights, panels, reports, rollups, sessions, validate
from trailmark.plans.catalog import QUERIES
from trailmark.sources import samples, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('events')}/events"
    tables.write_events(samples.web_events(spark, SAMPLE), path)
    return spark.read.parquet(path)


def read_columns(text):
    return set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>(?:\n|$|,)", text).group(1)))


def test_filters_and_columns_reach_the_scan(events):
    text = plan(rollups.page_stats(events))
    assert "EqualTo(event_type,page_view)" in text
    assert read_columns(text) == {"timestamp", "event_type", "website_id", "client_id", "url_path"}


def test_product_stats_reads_only_used_item_fields(events):
    text = plan(rollups.product_stats(events))
    assert "location_id" not in re.search(r"ReadSchema:.*", text).group(0)
    assert text.count("FileScan") == 1


@pytest.mark.parametrize("build", [
    lambda ev: reports.recent_events(ev), lambda ev: reports.client_timeline(ev), lambda ev: panels.top_pages(ev),
])
def test_ranked_lists_are_limited_before_the_shuffle(events, build):
    text = plan(build(events))
    assert text.count("WindowGroupLimit") == 2


def test_one_site_lists_are_top_k(events):
    assert "TakeOrderedAndProject" in plan(reports.recent_events(events, "site-0"))
    assert "TakeOrderedAndProject" in plan(reports.live_events(events))


def test_geo_join_is_an_equi_join(spark):
    payloads, ranges = samples.payloads(spark, SAMPLE), samples.ip_ranges(spark, SAMPLE)
    small = plan(enrich.add_geo(payloads, ranges))
    assert "BroadcastHashJoin" in small and "NestedLoop" not in small and "Cartesian" not in small
    large = plan(enrich.add_geo(payloads, ranges, max_broadcast_bytes=0))
    assert "NestedLoop" not in large and "Cartesian" not in large


def test_each_body_is_parsed_once(spark):
    good, _ = validate.split_good_bad(samples.payloads(spark, SAMPLE))
    assert plan(validate.parse_events(good)).count("from_json(") == 1


def test_windows_never_run_over_the_rows_of_a_visitor(events):
    """Session windows sit above an aggregation to slices; funnel windows are keyed by slice."""
    for df in (sessions.sessionize(events), sessions.session_table(events), insights.retention(events)):
        text = plan(df)
        deepest = text.rindex("Window [")
        assert re.search(r"Aggregate\(keys?=\[website_id", text[deepest:])
    text = plan(insights.funnel_levels(events, ("view_item", "add_to_cart", "purchase")))
    assert all("slice" in w for w in re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", text))


def test_no_query_needs_a_cross_product_or_python(spark):
    for name, query in QUERIES.items():
        if name.startswith("stream_"):
            continue
        text = plan(query(spark, SAMPLE))
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval"):
            assert word not in text, (name, word)
