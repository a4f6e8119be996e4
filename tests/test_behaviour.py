"""Sessions, funnels, cohorts and reports against brute force on small data."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trailmark.operators import insights, panels, reports, rollups, sessions

START = datetime(2024, 1, 1)


def stamp(seconds):
    return (START + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S.%f")


def random_rows(seed, n=600, span=3 * 86_400, kinds=("page_view", "view_item", "add_to_cart", "purchase")):
    """One client holds half of the rows; many events share a second."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        client = "hot" if rng.random() < 0.5 else f"c{rng.randrange(12)}"
        out.append({
            "event_id": i, "timestamp": stamp(rng.randrange(span // 60) * 60 + rng.choice([0, 0, 1, 30])),
            "event_type": rng.choice(kinds), "website_id": rng.choice("ab"), "client_id": client,
            "session_id": rng.choice(["", "s1", "s2"]), "url_path": rng.choice(["/x", "/y"]), "value": float(rng.randrange(50)),
        })
    return out


def by_visitor(data):
    groups = defaultdict(list)
    for r in data:
        groups[r["website_id"], r["client_id"]].append((datetime.fromisoformat(r["timestamp"]), r["event_id"], r))
    return {k: sorted(v, key=lambda x: x[:2]) for k, v in groups.items()}


@pytest.mark.parametrize("gap, midnight", [(1800, False), (1800, True), (600, False), (7200, True)])
def test_sessionize(make_events, gap, midnight):
    data = random_rows(1)
    expected = []
    for history in by_visitor(data).values():
        number, last = 0, None
        for at, event_id, _ in history:
            if last is None or (at - last).total_seconds() >= gap or (midnight and at.date() != last.date()):
                number, first = number + 1, at
                opening = event_id
            last = at
            expected.append((event_id, number, first, event_id == opening))
    df = sessions.sessionize(make_events(data), gap, midnight, mark_first=True)
    assert rows(df, "event_id", "session_no", "session_start", "is_session_start") == sorted(expected, key=str)


@pytest.mark.parametrize("seconds, count", [(1799.999, 1), (1800.0, 2)])
def test_gap_boundary(make_events, seconds, count):
    for start in (0, 1, 1799.5, 86_399):
        data = [{"event_id": i, "timestamp": stamp(start + s), "event_type": "page_view", "website_id": "a",
                 "client_id": "c"} for i, s in enumerate((0, seconds))]
        df = sessions.session_slices(make_events(data))
        assert df.agg(F.max("session_no")).collect()[0][0] == count


def test_previous_value_equals_lag(make_events):
    data = random_rows(2)
    df = sessions.previous_value(make_events(data), F.col("url_path"), ["website_id", "client_id"], "before")
    expected = []
    for history in by_visitor(data).values():
        before = None
        for _, event_id, r in history:
            expected.append((event_id, before))
            before = r["url_path"]
    assert rows(df, "event_id", "before") == sorted(expected, key=str)


@pytest.mark.parametrize("window", [600, 3600, 86_400])
def test_funnel_levels(make_events, window):
    steps = ("view_item", "add_to_cart", "purchase")
    data = random_rows(3)
    expected = []
    for key, history in by_visitor(data).items():
        starts = [None] * (len(steps) + 1)
        level = 0
        for at, _, r in history:
            for i in range(len(steps), 0, -1):
                if r["event_type"] != steps[i - 1]:
                    continue
                if i == 1:
                    starts[1] = at
                elif starts[i - 1] is not None and (at - starts[i - 1]).total_seconds() <= window:
                    starts[i] = starts[i - 1]
                else:
                    continue
                level = max(level, i)
        if level:
            expected.append((*key, level))
    df = insights.funnel_levels(make_events(data), steps, window)
    assert rows(df, "website_id", "client_id", "level") == sorted(expected, key=str)


def test_funnel_needs_distinct_steps(make_events):
    with pytest.raises(ValueError):
        insights.funnel_levels(make_events(random_rows(4, 3)), ("a", "a"))


def test_attribution_is_the_first_touch(make_events):
    base = {"website_id": "a", "client_id": "c", "session_id": "s", "event_type": "page_view"}
    data = [
        {**base, "event_id": 2, "timestamp": stamp(0), "url_path": "/b", "url_query": "?utm_source=late"},
        {**base, "event_id": 1, "timestamp": stamp(0), "url_path": "/a", "url_query": "?gclid=7", "referrer": "r1"},
        {**base, "event_id": 3, "timestamp": stamp(9), "utm_source": "own", "utm_campaign": "mine", "referrer": "r3"},
    ]
    df = sessions.session_attribution(make_events(data))
    assert rows(df, "event_id", "utm_source", "utm_medium", "utm_campaign", "referrer", "landing_page", "gclid") == [
        (1, "google", "cpc", "", "r1", "/a?gclid=7", "7"),
        (2, "google", "cpc", "", "r1", "/a?gclid=7", "7"),
        (3, "google", "cpc", "mine", "r3", "/a?gclid=7", "7"),
    ]


def test_one_site_reports_are_the_slices_of_all_sites(make_events):
    events = make_events(random_rows(5))
    now = reports.latest(events)
    for build in (
        lambda site: reports.recent_events(events, site, n=7),
        lambda site: reports.event_detail(events, site, n=7),
        lambda site: reports.site_stats(events, site, 24, now),
        lambda site: reports.param_coverage(events, site),
    ):
        every, one = build(None).filter("website_id = 'a'").drop("website_id", "position"), build("a")
        assert rows(every, *one.columns) == rows(one, *one.columns)


def test_site_stats_has_a_row_without_events(make_events):
    row = reports.site_stats(make_events(random_rows(5, 5)), "none", 24, datetime(2030, 1, 1)).collect()
    assert [r["total_events"] for r in row] == [0]


def test_event_detail_filters_and_cap(make_events):
    data = [{"event_id": i, "timestamp": stamp(i), "event_type": "page_view", "website_id": "a",
             "client_id": "x%" if i % 2 else "xy"} for i in range(500)]
    events = make_events(data)
    assert reports.event_detail(events, "a", n=999).count() == 200
    assert {r["client_id"] for r in reports.event_detail(events, "a", client_prefix="x%").collect()} == {"x%"}
    assert reports.live_events(events, n=999).count() == 100


def test_fill_profile_lists(make_events):
    data = [{"event_id": 1, "timestamp": stamp(0), "event_type": "search", "website_id": "a", "search_term": "q", "value": 0.0}]
    row = reports.event_fill_profile(reports.event_detail(make_events(data), "a")).collect()[0]
    assert [p["key"] for p in row["filled_params"]] == ["event_type", "search_term"]
    assert row["filled_count"] + row["empty_count"] == 58
    assert {"items", "properties"} & set(row["empty_params"]) == {"properties"}


def test_journey_modes(make_events):
    data = random_rows(6)
    events = make_events(data)
    full = reports.client_journey(reports.client_timeline(events, "hot", max_events=None))
    assert full.agg(F.sum("events")).collect()[0][0] == sum(r["client_id"] == "hot" for r in data)
    some = reports.client_journey(reports.client_timeline(events, "hot", max_events=20), with_events=True)
    assert some.agg(F.sum(F.size("event_list"))).collect()[0][0] == 20
    with pytest.raises(ValueError):
        reports.client_journey(reports.client_timeline(events, max_events=None), with_events=True)


def test_percentiles(make_events):
    rng = random.Random(7)
    data = [{"event_id": i, "timestamp": stamp(i), "event_type": "web_vital", "website_id": "a", "url_path": "/x",
             "lcp_value": rng.choice([0.0, rng.random() * 5000, 1234.5])} for i in range(400)]
    values = sorted(r["lcp_value"] for r in data if r["lcp_value"] > 0)
    got = panels.web_vitals(make_events(data), (1, 50, 75, 100)).collect()[0]
    for p in (1, 50, 75, 100):
        assert got[f"p{p}"] == values[-(-len(values) * p // 100) - 1]
    near = panels.web_vitals(make_events(data), (50,), exact=False).collect()[0]
    assert near["p50"] == got["p50"]


def test_merge_is_exact_for_counts_but_not_for_summed_distincts(make_events):
    events = make_events(random_rows(8))
    halves = [rollups.page_stats(events.filter(F.col("event_id") % 2 == i)) for i in (0, 1)]
    merged = rollups.merge_rollups(
        halves[0].unionByName(halves[1]), ["date", "website_id", "url_path"], ["pageviews", "visitors"])
    whole = rollups.page_stats(events)
    key = ["date", "website_id", "url_path"]
    assert rows(merged, *key, "pageviews") == rows(whole, *key, "pageviews")
    assert rows(merged, *key, "visitors") != rows(whole, *key, "visitors")
    parts = [rollups.distinct_sketch(events.filter(F.col("event_id") % 2 == i)) for i in (0, 1)]
    sketches = rollups.sketch_estimate(
        rollups.merge_sketch(parts[0].unionByName(parts[1]), ["date", "website_id"]))
    assert rows(sketches, "date", "website_id", "visitors") == rows(
        rollups.daily_stats(events), "date", "website_id", "visitors")


def test_merge_drops_zero_rows(spark):
    parts = spark.createDataFrame([("a", 1, "x"), ("a", -1, "y"), ("b", 2, "z")], "k string, n long, label string")
    merged = rollups.merge_rollups(parts, ["k"], ["n"], ["label"])
    assert rows(merged, "k", "n", "label") == [("b", 2, "z")]


def test_cost_steps(spark):
    for events, storage in ((9_999_999, 0), (10_000_000, 50), (10_000_001, 100)):
        usage = spark.createDataFrame([(events,)], "events long")
        row = reports.cost_estimate(usage).collect()[0]
        assert (row["storage_cost"], row["total_cost"]) == (storage, storage + 5)


def test_movers_see_new_and_vanished_pages(make_events):
    week = 7 * 86_400
    view = {"event_type": "page_view", "website_id": "a", "client_id": "c"}
    data = [{**view, "event_id": i, "timestamp": stamp(t), "url_path": p}
            for i, (t, p) in enumerate([(0, "/old"), (1, "/old"), (week, "/new"), (2 * week, "/new")])]
    got = rows(insights.page_movers(make_events(data)), "week", "url_path", "current", "previous", "direction")
    weeks = [START.date() + timedelta(days=7 * i) for i in range(2)]
    assert got == sorted([
        (weeks[0], "/old", 2, 0, "up"), (weeks[1], "/new", 1, 0, "up"), (weeks[1], "/old", 0, 2, "down")], key=str)


def test_new_sources(make_events):
    view = {"event_type": "page_view", "website_id": "a", "client_id": "c"}
    data = [{**view, "event_id": i, "timestamp": stamp(t * 86_400), "referrer_domain": d}
            for i, (t, d) in enumerate([(0, "old"), (8, "old"), (9, "new"), (10, "new")])]
    assert rows(insights.new_sources(make_events(data)), "referrer_domain", "pageviews") == [("new", 2)]


def test_session_start_rows_have_their_own_ids(spark):
    df = spark.sql("""
        SELECT 'w' AS website_id, 'c' AS client_id, id AS event_id, 'page_view' AS event_type,
               timestamp_seconds(n) AS timestamp FROM VALUES ('a', 0), ('b', 10), ('c', 9000) AS t(id, n)""")
    starts = sessions.emit_session_starts(df)
    assert starts.count() == 2 and starts.columns == df.columns
    assert starts.unionByName(df).select("event_id").distinct().count() == 5


def test_datalayer_quantity_of_any_size(spark):
    entry = '{"event":"purchase","ecommerce":{"items":[{"item_id":"a","quantity":"99999999999999999999"},{"item_id":"b","quantity":2}]}}'
    df = sessions.normalize_datalayer(spark.createDataFrame([(entry,)], "entry string"))
    assert df.selectExpr("items.quantity AS q").first().q == [1, 2]
