"""Keys that hold much of the data, ranks of any size, and erasure from every table."""

import json
import random
from datetime import datetime, timedelta

import pytest
from conftest import SAMPLE, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmark.operators import enrich, insights, lifecycle, reports, rollups, sessions
from trailmark.operators.ranking import top_rows
from trailmark.plans.ingest import ingest
from trailmark.sources import samples
from trailmark.streaming import attribution, parts
from trailmark.streaming.ingest import ingest_batch, read_events

START = datetime(2024, 1, 30)
STEPS = ("view_item", "add_to_cart", "begin_checkout", "purchase")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_level(steps, events, width):
    """Deepest step of one visitor's (second, kind) rows in time order."""
    best = 0
    for i, (start, kind) in enumerate(events):
        if kind != steps[0]:
            continue
        level = 1
        for at, other in events[i + 1 :]:
            if at - start > width:
                break
            if level < len(steps) and other == steps[level]:
                level += 1
        best = max(best, level)
    return best


@pytest.fixture(scope="module")
def crowd():
    """A third of all events come from the client without an id."""
    rng = random.Random(7)
    return [
        {"event_id": k, "timestamp": str(START + timedelta(seconds=rng.randrange(40_000))), "website_id": "a",
         "client_id": rng.choice(["", f"c{rng.randrange(12)}", f"c{rng.randrange(12)}"]),
         "event_type": rng.choice([*STEPS, "page_view", "view_item"]), "url_path": rng.choice("xyz")}
        for k in range(900)
    ]


@pytest.mark.parametrize("slice_seconds", [1, 60, 600, 100_000])
@pytest.mark.parametrize("width", [30, 900, 20_000])
def test_funnel_of_any_slices_equals_brute_force(make_events, crowd, slice_seconds, width):
    found = {}
    for r in sorted(crowd, key=lambda r: (r["timestamp"], r["event_id"])):
        second = (datetime.fromisoformat(r["timestamp"]) - START).total_seconds()
        found.setdefault(r["client_id"], []).append((second, r["event_type"]))
    expected = {c: brute_level(STEPS, own, width) for c, own in found.items()}
    df = insights.funnel_levels(make_events(crowd), STEPS, width, slice_seconds=slice_seconds)
    assert {r.client_id: r.level for r in df.collect()} == {c: n for c, n in expected.items() if n}


def test_one_step_funnel(make_events, crowd):
    df = insights.funnel_levels(make_events(crowd), STEPS[:1], 60)
    assert {r.level for r in df.collect()} == {1}


def test_a_hot_client_is_cut_into_slices(spark, make_events, crowd, tmp_path):
    """No window runs over the events of a client: only over those of a slice, or over summaries."""
    make_events(crowd).write.parquet(f"{tmp_path}/e")
    events = spark.read.parquet(f"{tmp_path}/e")
    hot = events.where("client_id = ''").count()
    largest = events.groupBy("client_id", F.floor(F.unix_seconds("timestamp") / 600)).count().agg(F.max("count")).first()[0]
    assert hot > 250 and largest < hot / 10
    for df, name in ((insights.funnel_levels(events, STEPS), "slice"), (sessions.dedupe_navigation(events), "lag_slice")):
        text = plan(df)
        over_rows = [w for w in text.split("Window [")[1:] if "event_id" in w.split("]", 1)[0] or "ROWS" in w.upper()]
        assert over_rows and all(name in w for w in over_rows)


def test_navigation_equals_lag_over_the_client(make_events, crowd):
    events = make_events(crowd)
    views = events.where("event_type = 'page_view'")
    before = F.lag("url_path").over(Window.partitionBy("client_id", "session_id").orderBy("timestamp", "event_id"))
    expected = views.withColumn("b", before).where("b is null or b <> url_path")
    assert rows(sessions.dedupe_navigation(events), "event_id") == rows(expected, "event_id")


@pytest.mark.parametrize("n", [1, 40, 1000, 1001, 2000])
def test_first_rows_of_any_number(spark, n):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") < 4000, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"),
        (F.col("id") * 7919 % 100).alias("at"))
    order = [F.col("at"), F.col("id")]
    got = top_rows(df, ["key"], order, n, "rank", "id")
    place = F.row_number().over(Window.partitionBy("key").orderBy("at", "id"))
    assert rows(got, "key", "rank", "id") == rows(df.withColumn("rank", place).where(F.col("rank") <= n), "key", "rank", "id")
    text = plan(got)
    assert ("WindowGroupLimit" in text) if n <= 1000 else (text.count("row_number()") >= 2 and "_part" in text)


def test_a_long_timeline_is_cut_in_parts_first(spark):
    events = samples.web_events(spark, SAMPLE)
    text = plan(reports.client_timeline(events, max_events=2000))
    assert "hashpartitioning(client_id" in text and "_part" in text
    assert reports.client_timeline(events, max_events=2000).count() == events.count()


def test_requests_without_address_are_nobodys(spark):
    requests = spark.createDataFrame(
        [(k, ip, START) for k, ip in enumerate(["", "", None, "x", "x", "x", "y"])], "event_id long, ip string, ingest_time timestamp")
    assert rows(enrich.rate_cap(requests, 1), "event_id") == [(0,), (1,), (2,), (3,), (6,)]


def test_a_late_first_event_still_attributes(make_events, spark, tmp_path):
    base = {"website_id": "a", "client_id": "c", "event_type": "page_view", "session_id": "s", "url_path": "/p"}
    late = [{**base, "event_id": 1, "timestamp": str(START), "url_query": "?utm_source=first"}]
    soon = [{**base, "event_id": 2, "timestamp": str(START + timedelta(days=3)), "url_query": "?utm_source=second"}]
    for late_policy, source in (("recompute", "first"), ("drop", "second")):
        out = f"{tmp_path}/{late_policy}"
        for k, batch in enumerate((make_events(soon), make_events(late))):
            parts.write_parts(parts.punctual(batch, k, out, "1 day", late_policy), k, out, attribution.PARTS)
        got = {r.event_id: r.utm_source for r in attribution.read_attribution(spark, out).collect()}
        assert got[2] == source


def test_erased_clients_are_gone_from_every_table(spark, tmp_path):
    def body(client, **more):
        return json.dumps({"website_id": "a", "event_type": "page_view", "client_id": client, **more})

    data = [body("c1"), body("c2"), body("c2", value="9"), body("c2")[:-1] + ", broken", "no json", '{"client_id":"c2"}', body("c22")]
    payloads = spark.createDataFrame(
        [(b, "1.2.3.4", "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Firefox/121.0", START) for b in data],
        "body string, ip string, user_agent string, ingest_time timestamp")
    out = str(tmp_path)
    ingest_batch(payloads, 0, out, rollups={"daily_stats": rollups.daily_stats})
    gone = spark.createDataFrame([("c2",)], "client_id string")
    for _ in range(2):  # repeating finishes or does nothing
        lifecycle.erase_everywhere(spark, out, gone, {"daily_stats": rollups.daily_stats})
    left = read_events(spark, out)
    assert {r.client_id for r in left.collect()} == {"c1", "c22"}
    raw, bad = (spark.read.parquet(f"{out}/{t}") for t in ("raw_events", "bad_events"))
    assert {json.loads(r.payload)["client_id"] for r in raw.collect()} == {"c1", "c22"}
    assert [r.payload for r in bad.collect()] == ["no json"]
    again = ingest(payloads)
    replayed = lifecycle.replay(again.raw, erased=spark.read.parquet(f"{out}/tombstones"))
    assert {r.client_id for r in replayed.events.collect()} == {"c1", "c22"}
    assert spark.read.parquet(f"{out}/rollups/daily_stats").agg(F.sum("visitors")).first()[0] == 2
