"""Validation rules on literal payloads."""

import json
from datetime import datetime

import pytest

from trailmark.operators import validate
from trailmark.plans.ingest import ingest

AT = datetime(2024, 5, 6, 7, 8, 9, 123000)


@pytest.fixture
def payloads(spark):
    def build(*bodies, ip="10.0.0.1", user_agent="Mozilla/5.0 Firefox/121.0"):
        data = [(b if isinstance(b, str) or b is None else json.dumps(b), ip, user_agent, AT) for b in bodies]
        return spark.createDataFrame(data, "body string, ip string, user_agent string, ingest_time timestamp")

    return build


def event(**fields):
    return {"website_id": "s", "event_type": "page_view", **fields}


REASONS = {
    None: "invalid_body",
    "null": "invalid_body",
    '"text"': "invalid_body",
    "5": "invalid_body",
    "": "invalid_body",
    "{bad": "invalid_body",
    "{'website_id':'s'}": "invalid_body",
    '{"website_id":"s","event_type":"page_view"': "invalid_body",
    "[1": "invalid_body",
    "[1]": "missing_website_id",
    "[]": "missing_website_id",
    "[1] x": "invalid_body",
    "[1] [": "invalid_body",
    "[1],2": "invalid_body",
    '{"website_id":"s","event_type":"page_view"} xyz': "invalid_body",
    '{"website_id":"s","event_type":"page_view"} {"a":1}': "invalid_body",
    '{"website_id":"s","event_type":"page_view"},{"a":1}': "invalid_body",
    '{"website_id":"s","event_type":"page_view"}] [': "invalid_body",
    "{}": "missing_website_id",
    '{"website_id":5,"event_type":"page_view"}': "missing_website_id",
    '{"website_id":" \\t ","event_type":"page_view"}': "missing_website_id",
    '{"website_id":null,"event_type":"page_view"}': "missing_website_id",
    '{"website_id":["s"],"event_type":"page_view"}': "missing_website_id",
    '{"website_id":"s"}': "missing_event_type",
    '{"website_id":"s","event_type":7}': "missing_event_type",
    '{"website_id":"s","event_type":"Page_View"}': "invalid_event_type",
    '{"website_id":"s","event_type":" page_view"}': "invalid_event_type",
    '{"website_id":"s","event_type":"page_view"}': "",
    ' {"website_id":"s","event_type":"scroll"} ': "",
    '{"website_id":5,"website_id":"s","event_type":"x","event_type":"search"}': "",
}


def test_reasons(payloads):
    df = validate.validate(payloads(*REASONS))
    got = {r["body"]: r["reason"] or "" for r in df.select("body", "reason").collect()}
    assert got == REASONS


def test_every_payload_is_good_or_bad(payloads):
    good, bad = validate.split_good_bad(payloads(*REASONS))
    assert good.count() + bad.count() == len(REASONS)


def parsed(payloads, body):
    good, _ = validate.split_good_bad(payloads(body))
    return validate.parse_events(good).collect()[0]


@pytest.mark.parametrize("value, expected", [
    ("9.5x", 9.5), ("Infinity", 0.0), ("abc", 0.0), (None, 0.0), (True, 0.0), (3, 3.0), ("-1e3", -1000.0),
    (" .5", 0.5), ("1e999", 0.0), ("", 0.0), ("5.", 5.0),
])
def test_numbers(payloads, value, expected):
    assert parsed(payloads, event(value=value))["value"] == expected


@pytest.mark.parametrize("value, expected", [
    (-1, 0), (0, 0), (100, 100), (101, 100), ("55%", 55), ("x", 0), (None, 0), (12.9, 12),
])
def test_percent(payloads, value, expected):
    assert parsed(payloads, event(scroll_depth=value))["scroll_depth"] == expected


def test_text_limits(payloads):
    row = parsed(payloads, event(
        page_title="x" * 501, client_id="y" * 65, currency="z" * 11, url_path="p" * 500, language=None, screen=5))
    assert [len(row[c]) for c in ("page_title", "client_id", "currency", "url_path")] == [500, 64, 10, 500]
    assert (row["language"], row["screen"], row["form_id"]) == ("", "5", "")


@pytest.mark.parametrize("sent, expected", [
    ("2024-01-01T10:00:00.999+03:00", "2024-01-01 07:00:00"),
    ("2024-01-01T10:00:00Z", "2024-01-01 10:00:00"),
    ("2024-01-01", "2024-01-01 00:00:00"),
    (1704103200999, "2024-01-01 10:00:00"),
    ("x", "2024-05-06 07:08:09"),
    ("12345", "2024-05-06 07:08:09"),
    ("2024-13-01T00:00:00Z", "2024-05-06 07:08:09"),
    ("", "2024-05-06 07:08:09"),
    (0, "2024-05-06 07:08:09"),
    (None, "2024-05-06 07:08:09"),
    ({}, "2024-05-06 07:08:09"),
])
def test_time(payloads, sent, expected):
    good, _ = validate.split_good_bad(payloads(event(timestamp=sent)))
    text = validate.parse_events(good).selectExpr("CAST(timestamp AS STRING) AS t").collect()[0]["t"]
    assert text == expected


def test_items(payloads):
    items = parsed(payloads, event(items=[None, "s", {"item_id": 5, "price": "2.5", "quantity": -3, "index": "4"}]))
    (item,) = items["items"]
    assert (item["item_id"], item["price"], item["quantity"], item["index"], item["coupon"]) == ("5", 2.5, 0, 4, "")
    assert parsed(payloads, event(items={}))["items"] == []
    many = [{"item_id": str(i)} for i in range(201)]
    assert [i["item_id"] for i in parsed(payloads, event(items=many))["items"]] == [str(i) for i in range(200)]
    # The limit counts entries before non-objects are dropped.
    assert len(parsed(payloads, event(items=[None] + many))["items"]) == 199


@pytest.mark.parametrize("sent, expected", [
    ('{"plan":"pro"}', {"plan": "pro"}),
    ({"plan": "pro", "n": 2, "f": 1.5, "b": True}, {"plan": "pro", "n": "2", "f": "1.5", "b": "true"}),
    ([1], {}),
    ("{bad", {}),
    ("", {}),
    (None, {}),
    ({"a": None, "b": "x"}, {"b": "x"}),
    ({"o": {"k": 1}}, {"o": "[object Object]"}),
    ({"long": "x" * 501}, {"long": "x" * 500}),
])
def test_properties(payloads, sent, expected):
    assert parsed(payloads, event(properties=sent))["properties"] == expected


def test_property_limit_is_by_position_and_counts_nulls(payloads):
    names = [f"k{i:02d}" for i in range(51)][::-1]
    sent = {n: (None if n == "k50" else n) for n in names}
    kept = parsed(payloads, event(properties=sent))["properties"]
    assert set(kept) == set(names[1:50])


def test_repeated_property_key(payloads):
    body = '{"website_id":"s","event_type":"custom","properties":{"a":1,"b":2,"a":3}}'
    assert parsed(payloads, body)["properties"] == {"a": "3", "b": "2"}


def test_bad_rows(payloads):
    _, bad = validate.split_good_bad(payloads("null", '{"website_id":5}', "{bad"))
    got = sorted((r["payload"], r["website_id"], r["reason"]) for r in validate.to_bad(bad).collect())
    assert got == sorted([
        ("{bad", "", "invalid_body"), ('{"website_id":5}', "5", "missing_website_id"), ("{}", "", "invalid_body")])


def test_bots_leave_no_trace_but_bad_rows_stay(payloads):
    result = ingest(payloads(event(), "{}", user_agent="Googlebot/2.1"))
    assert (result.events.count(), result.raw.count(), result.bad.count()) == (0, 0, 1)
    kept = ingest(payloads(event(), user_agent="Googlebot/2.1"), keep_bots=True).events
    assert [r["is_bot"] for r in kept.select("is_bot").collect()] == [True]


def test_unregistered_website_becomes_bad(spark, payloads):
    sites = spark.createDataFrame([("s",)], "id string")
    result = ingest(payloads(event(), event(website_id="other")), websites=sites)
    assert [r["website_id"] for r in result.events.collect()] == ["s"]
    assert [(r["website_id"], r["reason"]) for r in result.bad.collect()] == [("other", "unknown_website")]


def test_event_columns(payloads):
    from trailmark.schema import EVENTS_SCHEMA

    events = ingest(payloads(event())).events
    assert events.columns == [*EVENTS_SCHEMA.names, "event_id", "ingest_time"]
    assert len(EVENTS_SCHEMA) == 65
    row = events.collect()[0].asDict()
    assert all(v is not None for v in row.values())
