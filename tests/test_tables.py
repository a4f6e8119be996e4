"""Stored tables, lifecycle jobs and streams."""

import json
from datetime import datetime, timedelta

import pytest
from conftest import SAMPLE, rows
from pyspark.sql import functions as F

from trailmark.operators import lifecycle, rollups, sessions
from trailmark.plans.ingest import ingest
from trailmark.sources import payloads as payload_source
from trailmark.sources import samples, tables
from trailmark.streaming import attribution, windows
from trailmark.streaming.ingest import read_events, run_ingest

START = datetime(2024, 1, 30)


def sample_events(make_events, n=60):
    """One event per day over two months, three clients."""
    return make_events([
        {"event_id": i, "timestamp": str(START + timedelta(days=i)), "event_type": "page_view", "website_id": "a",
         "client_id": f"c{i % 3}", "session_id": f"s{i}"} for i in range(n)])


def months(path):
    return sorted(p.name.split("=")[1] for p in path.iterdir() if p.name.startswith("event_month="))


def test_write_and_prune(spark, make_events, tmp_path):
    from trailmark.operators.panels import scope

    events = sample_events(make_events)
    tables.write_events(events, f"{tmp_path}/events")
    assert months(tmp_path / "events") == ["202401", "202402", "202403"]
    stored = spark.read.parquet(f"{tmp_path}/events")
    part = scope(stored, datetime(2024, 2, 10), datetime(2024, 2, 20), ["a"])
    assert part.count() == 10
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan
    assert "GreaterThanOrEqual(timestamp" in plan


def test_retention_job(spark, make_events, tmp_path):
    path = f"{tmp_path}/bad"
    tables.append(sample_events(make_events), path, "bad_events")
    as_of = datetime(2024, 5, 15, 0, 0)
    expected = rows(lifecycle.apply_retention(spark.read.parquet(path), "bad_events", as_of), "event_id")
    lifecycle.expire_table(spark, path, "bad_events", as_of)
    assert rows(spark.read.parquet(path), "event_id") == expected
    assert months(tmp_path / "bad") == ["202402", "202403"]
    assert 0 < len(expected) < 60


def test_erasure_rewrites_events_and_rollups(spark, make_events, tmp_path):
    events = sample_events(make_events)
    path, rollup_path = f"{tmp_path}/events", f"{tmp_path}/rollups"
    tables.write_events(events, path)
    tables.write_rollup(rollups.daily_stats(events), f"{rollup_path}/daily_stats")
    ids = spark.createDataFrame([("c1",)], "client_id string")
    touched = lifecycle.erase_from_table(spark, path, ids, {"daily_stats": rollups.daily_stats}, rollup_path)
    assert touched == ["202401", "202402", "202403"]
    left = spark.read.parquet(path)
    assert left.filter("client_id = 'c1'").count() == 0 and left.count() == 40
    daily = spark.read.parquet(f"{rollup_path}/daily_stats")
    assert daily.agg(F.sum("pageviews")).collect()[0][0] == 40


def test_compaction_keeps_rows(spark, make_events, tmp_path):
    events = sample_events(make_events)
    path = f"{tmp_path}/events"
    for part in range(3):
        tables.write_events(events.filter(F.col("event_id") % 3 == part), path)
    before = rows(spark.read.parquet(path), "event_id", "event_month")
    lifecycle.compact(spark, path, "events", ["202402"])
    assert rows(spark.read.parquet(path), "event_id", "event_month") == before
    assert len(list((tmp_path / "events" / "event_month=202402").glob("*.parquet"))) == 1


def test_a_killed_replacement_leaves_one_version(spark, make_events, tmp_path, monkeypatch):
    """Stopped before the manifest: the old version. Stopped between two months: the new one."""
    path = f"{tmp_path}/events"
    tables.write_events(sample_events(make_events), path)
    before = rows(spark.read.parquet(path), "event_id", "event_month")
    every = ["202401", "202402", "202403"]

    def stop(*_):
        raise RuntimeError("killed")

    def odd(df):
        return df.filter((F.col("event_id") % 2 == 1) & (F.col("event_month") != 202403))

    with monkeypatch.context() as patched:
        patched.setattr(tables, "write_text", stop)
        with pytest.raises(RuntimeError):
            lifecycle.rewrite_months(spark, path, "events", every, odd)
    assert rows(lifecycle.read_table(spark, path), "event_id", "event_month") == before
    assert rows(spark.read.parquet(path), "event_id", "event_month") == before

    moved, move = [], tables.move

    def one(spark, source, target):
        if moved:
            stop()
        moved.append(target)
        move(spark, source, target)

    with monkeypatch.context() as patched:
        patched.setattr(tables, "move", one)
        with pytest.raises(RuntimeError):
            lifecycle.rewrite_months(spark, path, "events", every, odd)
    expected = [r for r in before if r[0] % 2 == 1 and str(r[1]) != "202403"]
    assert moved and rows(lifecycle.read_table(spark, path), "event_id", "event_month") == expected
    lifecycle.recover(spark, path)
    assert rows(spark.read.parquet(path), "event_id", "event_month") == expected
    assert rows(lifecycle.read_table(spark, path), "event_id", "event_month") == expected
    assert months(tmp_path / "events") == ["202401", "202402"] and not (tmp_path / "events" / "_rewrite").exists()


def test_dimensions_need_one_source(spark, tmp_path):
    spark.createDataFrame([("s",)], "id string").write.parquet(f"{tmp_path}/w")
    assert tables.read_websites(spark, f"{tmp_path}/w").count() == 1
    with pytest.raises(ValueError):
        tables.read_api_keys(spark)


@pytest.fixture(scope="module")
def stored_payloads(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('lines')}/p"
    payload_source.write_payloads(samples.payloads(spark, SAMPLE).repartition(3), path)
    return path


def test_payload_lines_round_trip(spark, stored_payloads):
    back = payload_source.read_payloads(spark, stored_payloads)
    columns = ["body", "ip", "user_agent", "ingest_time"]
    assert rows(back, *columns) == rows(samples.payloads(spark, SAMPLE), *columns)


def test_a_line_that_is_no_record_is_kept_as_a_body(spark, tmp_path):
    (tmp_path / "x.txt").write_text("garbage\n" + json.dumps({"body": "{}"}) + "\n")
    got = {r["body"] for r in payload_source.read_payloads(spark, str(tmp_path)).collect()}
    assert got == {"garbage", "{}"}


def test_stream_equals_batch(spark, stored_payloads, tmp_path):
    out = f"{tmp_path}/out"
    stream = payload_source.stream_payloads(spark, stored_payloads, max_files_per_trigger=1)
    chosen = {n: rollups.ROLLUPS[n] for n in ("daily_stats", "product_stats", "ecommerce_funnel")}
    run_ingest(stream, out, f"{tmp_path}/cp", trigger=None, rollups=chosen).awaitTermination()
    batch = ingest(payload_source.read_payloads(spark, stored_payloads))
    columns = batch.events.columns
    stored = read_events(spark, out)
    assert rows(stored, *columns) == rows(batch.events, *columns)
    for name, frame in (("raw_events", batch.raw), ("bad_events", batch.bad)):
        assert rows(spark.read.parquet(f"{out}/{name}"), *frame.columns) == rows(frame, *frame.columns)
    for name, build in chosen.items():
        expected = build(batch.events)
        got = spark.read.parquet(f"{out}/rollups/{name}")
        assert rows(got, *expected.columns) == rows(expected, *expected.columns)
    # A repeated batch replaces itself.
    from trailmark.streaming.ingest import ingest_batch

    again = payload_source.read_payloads(spark, stored_payloads)
    before = stored.count()
    for _ in range(2):
        ingest_batch(again, 99, out, rollups={})
    assert read_events(spark, out).count() == 2 * before
    lifecycle.compact(spark, f"{out}/events", "events", ["202401"])
    assert read_events(spark, out).count() == 2 * before


def test_replay_keeps_places(spark):
    first = ingest(samples.payloads(spark, SAMPLE), samples.ip_ranges(spark, SAMPLE))
    again = lifecycle.replay(first.raw, first.events).events
    columns = [c for c in first.events.columns if c != "ingest_time"]
    assert rows(again, *columns) == rows(first.events, *columns)
    assert first.events.filter("country <> ''").count() > 0


def test_stream_sessions_match_batch(spark, make_events, tmp_path):
    """All sessions but those the watermark leaves open."""
    offsets = [0, 1799, 1799 + 1800, 10_000, 10_000 + 3599, 90_000]
    events = make_events([
        {"event_id": i, "timestamp": str(START + timedelta(seconds=s)), "event_type": "page_view", "website_id": "a",
         "client_id": "c"} for i, s in enumerate(offsets)])
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = windows.stream_sessions(stream).writeStream.format("parquet").option(
        "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "started_at", "ended_at", "events")
    table = sessions.session_table(events).filter(F.col("ended_at") < F.lit(str(START + timedelta(days=1))))
    assert got == rows(table, "started_at", "ended_at", "events") and len(got) == 4


def test_stream_attribution(spark, make_events, tmp_path):
    base = {"website_id": "a", "client_id": "c", "event_type": "page_view", "url_path": "/p"}
    events = make_events([
        {**base, "event_id": 1, "timestamp": str(START), "session_id": "s", "url_query": "?gclid=1", "referrer": "r"},
        {**base, "event_id": 2, "timestamp": str(START + timedelta(seconds=5)), "session_id": "s", "utm_term": "own"},
        {**base, "event_id": 3, "timestamp": str(START), "session_id": "t", "referrer": "q"}])
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    attribution.run_attribution(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    columns = ["event_id", "utm_source", "utm_medium", "utm_term", "referrer", "landing_page"]
    attribution.fold(spark, f"{tmp_path}/out")
    stamped = attribution.read_attribution(spark, f"{tmp_path}/out")
    assert "Python" not in stamped._jdf.queryExecution().executedPlan().toString()
    got = rows(stamped, *columns)
    assert got == [(1, "google", "cpc", "", "r", "/p?gclid=1"), (2, "google", "cpc", "own", "r", "/p?gclid=1"),
                   (3, "", "", "", "q", "/p")]
    assert got == rows(sessions.session_attribution(events), *columns)


def test_windowed_distinct_forms(spark, make_events):
    events = sample_events(make_events)
    exact = windows.windowed_distinct(events).groupBy("date", "website_id").agg(F.count("*").alias("visitors"))
    approx = windows.windowed_distinct(events, how="approx")
    assert rows(approx, "date", "website_id", "visitors") == rows(exact, "date", "website_id", "visitors")
    sketch = rollups.sketch_estimate(windows.windowed_distinct(events, how="sketch"))
    assert rows(sketch, "date", "website_id", "visitors") == rows(exact, "date", "website_id", "visitors")


def test_settings_apply_to_a_running_session(spark):
    from trailmark.session import RESULT_SETTINGS, configure

    assert all(spark.conf.isModifiable(key) for key in RESULT_SETTINGS)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert configure(spark).conf.get("spark.sql.session.timeZone") == "UTC"
