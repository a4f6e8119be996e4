"""Streams kept as parts: repeats, folds, late rows, and what a micro-batch reads."""

import re
from datetime import datetime, timedelta

import pytest
from conftest import SAMPLE, rows
from pyspark.sql import functions as F

from trailmark.operators import rollups, sessions
from trailmark.plans.ingest import ingest, parse_once, split
from trailmark.sources import samples, tables
from trailmark.streaming import ingest as stream_ingest
from trailmark.streaming import parts

START = datetime(2024, 1, 30)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark):
    return samples.web_events(spark, SAMPLE)


def deal(events, n, k):
    return events.where(F.pmod("event_id", F.lit(n)) == k)


def measures(df, name):
    spec = rollups.SPECS[name]
    return rows(df.select(*[F.round(c, 4).alias(c) if c in spec.sums else F.col(c)
                            for c in ("date", "website_id", *spec.keys, *spec.sums, *spec.distinct)]),
                "date", "website_id", *spec.keys, *spec.sums, *spec.distinct)


@pytest.mark.parametrize("mode", ["additive", "sketch"])
def test_parts_of_all_rollups_merge_and_fold(spark, events, tmp_path, mode):
    """Repeating a batch and folding at any point change nothing."""
    kept = parts.rollup_parts(mode)
    out = str(tmp_path)
    for k in (0, 1, 1):  # batch 1 is repeated
        parts.write_parts(deal(events, 3, k), k, out, kept)
    for name, part in kept.items():
        assert parts.fold(spark, f"{out}/{name}", part) == 1
        assert parts.fold(spark, f"{out}/{name}", part) == 1
    parts.write_parts(deal(events, 3, 1), 1, out, kept)  # repeated after its fold: not counted again
    parts.write_parts(deal(events, 3, 2), 2, out, kept)
    for name, part in kept.items():
        got = measures(parts.read_result(spark, f"{out}/{name}", part), name)
        if mode == "sketch":
            expected = rollups.ROLLUPS[name](events)
        else:
            spec = rollups.SPECS[name]
            batches = [rollups.ROLLUPS[name](deal(events, 3, k)) for k in range(3)]
            both = batches[0].unionByName(batches[1]).unionByName(batches[2])
            expected = both.groupBy("date", "website_id", *spec.keys).agg(
                *[F.sum(c).alias(c) for c in (*spec.sums, *spec.distinct)])
        assert got == measures(expected, name), name


def test_a_killed_fold_is_not_read(spark, events, tmp_path):
    part, path = parts.daily_windows(), f"{tmp_path}/daily"
    for k in range(2):
        parts.write_part(part.build(deal(events, 2, k)), path, k)
    whole = rows(parts.read_result(spark, path, part), "date", "website_id", "events")
    broken = tmp_path / "daily" / "folds" / "upto=1"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half a file")
    assert rows(parts.read_result(spark, path, part), "date", "website_id", "events") == whole
    assert parts.fold(spark, path, part) == 1
    assert rows(parts.read_result(spark, path, part), "date", "website_id", "events") == whole
    assert not list((tmp_path / "daily" / "batches").iterdir())


def test_an_empty_log_has_no_result(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        parts.read_result(spark, f"{tmp_path}/none", parts.daily_windows())
    assert parts.read_late(spark, str(tmp_path)) is None
    with pytest.raises(ValueError):
        parts.rollup_parts("exactly")
    with pytest.raises(ValueError):
        parts.distinct_clients("guess")


@pytest.mark.parametrize("late_policy, counted, aside", [("recompute", 5, 0), ("side", 4, 1), ("drop", 4, 0)])
def test_late_rows(spark, make_events, tmp_path, late_policy, counted, aside):
    def batch(*hours):
        return make_events([{"event_id": h, "timestamp": str(START + timedelta(hours=h)), "website_id": "a",
                             "event_type": "page_view", "client_id": "c"} for h in hours])

    part, out = parts.daily_windows(), str(tmp_path)
    for _ in range(2):  # the second round repeats both batches
        for k, rows_of in enumerate([batch(100, 110), batch(85, 86, 120)]):  # 85 is behind 110 - 24
            kept = parts.punctual(rows_of, k, out, "24 hours", late_policy)
            parts.write_parts(kept, k, out, {"result": part})
    got = parts.read_result(spark, f"{out}/result", part).agg(F.sum("events")).first()[0]
    late = parts.read_late(spark, out)
    assert (got, late.count() if late is not None else 0) == (counted, aside)
    with pytest.raises(ValueError):
        parts.punctual(batch(1), 0, out, "1 day", "guess")


def test_sessions_join_across_batches(spark, make_events, tmp_path):
    """Whatever the batches, and however late: the sessions of one sorted table."""
    seconds = [0, 1799, 1799 + 1800, 10_000, 10_000 + 3599, 90_000, 90_001, 11_700, 900]
    events = make_events([
        {"event_id": i, "timestamp": str(START + timedelta(seconds=s)), "event_type": "page_view", "website_id": "a",
         "client_id": f"c{i % 2}" if i > 6 else "c0"} for i, s in enumerate(seconds)])
    part, path = parts.session_parts(), f"{tmp_path}/s"
    columns = ("client_id", "started_at", "ended_at", "events", "pageviews")
    expected = rows(sessions.session_table(events), *columns)
    for k in range(3):
        parts.write_part(part.build(deal(events, 3, 2 - k)), path, k)
        if k == 1:
            parts.fold(spark, path, part)
    assert rows(parts.read_result(spark, path, part), *columns) == expected


def test_upserts_keep_the_newest_row(spark, tmp_path):
    part = parts.upserts(["k"])
    for batch_id, data in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("a", 2)]]):
        df = spark.createDataFrame(data, "k string, n long").withColumn("_batch", F.lit(batch_id).cast("long"))
        parts.write_part(df, str(tmp_path), batch_id)
    assert rows(parts.read_result(spark, str(tmp_path), part), "k", "n") == [("a", 2), ("b", 1)]
    parts.fold(spark, str(tmp_path), part)
    assert rows(parts.read_result(spark, str(tmp_path), part), "k", "n") == [("a", 2), ("b", 1)]


def test_blank_addresses_are_not_one_visitor(spark):
    events = spark.createDataFrame([(START, h) for h in ("", "", "", "x", "x")], "timestamp timestamp, ip_hash string")
    part = parts.rate_windows(1)
    assert [tuple(r)[1:] for r in part.finish(part.merge(part.build(events))).collect()] == [("x", 2, True)]


def test_a_batch_is_parsed_once(spark):
    payloads = samples.payloads(spark, SAMPLE)
    ranges = samples.ip_ranges(spark, SAMPLE)
    parsed = parse_once(payloads)
    assert plan(parsed).count("from_json(") == 1
    stored = parsed.drop("_none")
    plain, once = ingest(payloads, ranges), split(stored, ranges)
    for a, b in zip(plain, once):
        columns = [c for c in a.columns if c not in ("items", "properties")]
        assert rows(a, *columns) == rows(b.select(*a.columns), *columns)


def test_unregistered_sites_are_rejected_in_one_parse(spark):
    payloads = samples.payloads(spark, SAMPLE)
    sites = samples.websites(spark, SAMPLE).where("id in ('site-0', 'site-1')")
    plain, once = ingest(payloads, websites=sites), split(parse_once(payloads, sites))
    assert rows(plain.bad, "website_id", "payload", "reason") == rows(once.bad, "website_id", "payload", "reason")
    assert rows(plain.events, "event_id") == rows(once.events, "event_id") and once.events.count() > 0


def test_touched_dates_are_read_once_from_their_folders(spark, events, tmp_path, monkeypatch):
    """Nine rollups, one scan of the event table, pruned to the literal dates of the batch."""
    path, rollup_path = f"{tmp_path}/events", f"{tmp_path}/rollups"
    stream_ingest._replace_batch(events, path, 0, daily=True)
    batch = events.where("timestamp < '2024-01-03'")
    touched = stream_ingest.touched_events(path, batch)
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        touched._jdf.queryExecution(), "formatted")
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details
    assert re.search(r"PartitionFilters: \[.*event_date#\d+ IN \(2024-01-01,2024-01-02\)", text)
    scans = []

    def spy(name):
        def build(df):
            scans.append((name, {f.split("/part-")[0] for f in df.inputFiles()}))
            return rollups.ROLLUPS[name](df)
        return build

    stream_ingest.refresh_rollups(path, rollup_path, batch, {n: spy(n) for n in rollups.ROLLUPS})
    assert len(scans) == 9 and all("_staging/touched" in f for _, found in scans for f in found)
    expected = rollups.daily_stats(events.where("timestamp < '2024-01-03'"))
    got = spark.read.parquet(f"{rollup_path}/daily_stats")
    assert rows(got, *expected.columns) == rows(expected, *expected.columns)
    monkeypatch.setattr(stream_ingest, "_MAX_NAMED_DATES", 1)
    joined = stream_ingest.touched_events(path, batch)
    assert rows(joined, "event_id") == rows(touched, "event_id")
    assert not tables.exists(spark, f"{rollup_path}/_staging/touched-0")
