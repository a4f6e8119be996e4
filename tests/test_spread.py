"""Stored rows are spread over the cores before wide rows are made of them."""

from __future__ import annotations

import tracemalloc
from collections import Counter
from contextlib import contextmanager
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from trailmark.plans import catalog
from trailmark.sources import payloads as payload_source
from trailmark.sources import samples, tables
from trailmark.streaming import ingest as stream_ingest
from trailmark.streaming import parts

EVENTS = 60


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A table folder with one file of events whose batch 2 is empty."""
    folder = str(tmp_path_factory.mktemp("small"))
    start = datetime(2024, 3, 1, 12)
    data = [(k + k // 2, start + timedelta(hours=k), k % 5, ("view", "click", "purchase")[k % 3], 1.5, f'{{"k": {k % 100}}}')
            for k in range(EVENTS)]
    rows = spark.createDataFrame(
        data, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def test_a_stream_batch_has_many_files_and_stays_one_batch(spark, small, tmp_path):
    out = str(tmp_path)
    sizes = []
    for stream in samples.stream_web_batches(spark, small, f"{out}/source"):
        sizes.append(len(spark.read.parquet(f"{out}/source").inputFiles()))
        parts.run_parts(stream, {"result": parts.daily_windows()}, out, f"{out}/checkpoint").awaitTermination()
    assert sizes[0] > 1 and sizes[1] > sizes[0] + 1 and len(sizes) == samples.BATCHES
    logged = tables.folders(spark, f"{out}/result/batches", "batch_id")
    assert sorted(logged) == ["0", "1", "2"]
    seen = [spark.read.parquet(logged[k].toString()).groupBy().sum("events").first()[0] for k in sorted(logged)]
    assert seen == [EVENTS // 2, EVENTS // 2, None]
    total = parts.read_result(spark, f"{out}/result", parts.daily_windows())
    assert total.groupBy().sum("events").first()[0] == EVENTS


def test_late_rows_follow_the_batches(spark, small):
    rows = catalog.QUERIES["stream_late_rows"](spark, small).collect()
    ids = [(k + k // 2, k) for k in range(EVENTS)]
    latest = max(k for i, k in ids if i % 3 == 0)
    assert sorted(r["event_id"] for r in rows) == sorted(i for i, k in ids if i % 3 == 1 and k < latest - 24)


def test_payload_rows_are_spread_before_their_bodies_are_made(spark, small):
    plan = samples.payloads(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    spread = plan.index("Repartition")
    assert "body" in plan[:spread] and "body" not in plan[spread:]


def test_events_are_stored_once_without_rollups(spark, small, tmp_path, monkeypatch):
    named = []
    keep = tables.staged

    @contextmanager
    def spy(df, out, batch_id, name="batch"):
        named.append(name)
        with keep(df, out, batch_id, name) as rows:
            yield rows

    monkeypatch.setattr(tables, "staged", spy)
    lines = str(tmp_path / "lines")
    payload_source.write_payloads(samples.payloads(spark, small), lines)
    stream_ingest.ingest_batch(payload_source.read_payloads(spark, lines), 0, str(tmp_path / "out"), rollups={})
    assert named == ["parsed"]
    written = stream_ingest.read_events(spark, str(tmp_path / "out")).count()
    assert written > 0 and written == spark.read.parquet(str(tmp_path / "out/raw_events")).count()


def test_bpe_remembers_frequent_words_in_bounded_memory(monkeypatch):
    bpe = pytest.importorskip("trailmark.llm.bpe")
    plain = bpe.WordBpe(bpe.default_path())
    monkeypatch.setattr(bpe, "CACHED_WORDS", 40)
    small = bpe.WordBpe(bpe.default_path())
    coded = []
    monkeypatch.setattr(small, "encode_mapped", lambda word: coded.append(word) or plain.encode_mapped(word))
    text = " ".join(f"often word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500))
    assert small.encode(text) == plain.encode(text)
    assert coded.count("often") == 1
    assert len(small.words) + len(small.older) <= 40
    assert small.decode(small.encode("often")) == plain.decode(plain.encode("often"))


def test_bpe_writes_out_a_repeated_piece_once(monkeypatch):
    bpe = pytest.importorskip("trailmark.llm.bpe")
    own = bpe.WordBpe(bpe.default_path())
    written = []
    decode = own.decode
    monkeypatch.setattr(own, "decode", lambda ids: written.append(list(ids)) or decode(ids))
    word = "onreonlyqueéle"
    once = own.encode(word)
    assert len(once) > 1
    ids, tokens = own.coded(f"{word} 7 " * 30)
    again = (once + own.encode("7")) * 30
    assert ids == " ".join(map(str, again)) and tokens == decode(again)
    assert written == [once]
    assert own.coded("") == ("", "") and own.coded(" \n") == ("", "") and own.encode("") == []


def lm_contexts(symbols, orders):
    """One chain of contexts: each symbol alone, then behind itself again and again."""
    parents = [np.zeros(symbols, dtype=np.int64), *[np.arange(symbols)] * (orders - 1)]
    return parents, [np.arange(symbols)] * orders


def test_lm_scoring_counts_contexts_in_little_memory():
    lm = pytest.importorskip("trailmark.llm.lm_scoring")
    symbol = np.full(256, lm.OTHER, dtype=np.uint8)
    symbol[[ord(c) for c in "ab "]] = range(3)
    symbol[255] = lm.END
    texts = ["aaaaab", "", "baaaaaaab  aaaaaa", "aaaaa"]
    parents, older = lm_contexts(3, 5)
    (rows,) = lm._extensions(symbol, parents, older)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    got = {(k, c): n for k, c, n in zip(*(rows.column(i).to_pylist() for i in range(3)))}
    expected = Counter()
    for text in texts:
        s = [lm.END] * 8 + [symbol[ord(c)] for c in " ".join(text.split())] + [lm.END]
        for at in range(8, len(s)):
            if len(set(s[at - 5 : at])) == 1 and s[at - 1] < 3:
                expected[0, int(s[at - 1]) * 64 + int(s[at])] += 1
                expected[1, int(s[at - 1]) * 64 + int(s[at - 6])] += 1
    assert got == expected and expected

    batch = pa.RecordBatch.from_arrays([pa.array(["aaaaaaa abab " * 200] * 1600)], ["text"])  # 4 MB
    tracemalloc.start()
    try:
        list(lm._extensions(symbol, parents, older)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 << 20


def test_tasks_leave_small_workers_behind(monkeypatch):
    common = pytest.importorskip("trailmark.llm.common")
    common._powers.cache_clear()
    text = b" ".join(b"w%d" % k for k in range(300_000)) + b" " + b"x" * (3 << 20) + b" end"
    tracemalloc.start()
    try:
        hashes, places = common.word_hashes(text)
        kept = tracemalloc.get_traced_memory()[0] - hashes.nbytes - places.nbytes
    finally:
        tracemalloc.stop()
    assert kept < 12 << 20
    assert len(hashes) == 300_002 and len(set(hashes.tolist())) == 300_002
    monkeypatch.setattr(common, "_PIECE", 1000)  # the pieces make no difference
    again, at = common.word_hashes(text)
    assert np.array_equal(hashes, again) and np.array_equal(places, at)
    monkeypatch.undo()
    common.word_hashes(b"a b")
    assert common._powers.cache_info().currsize == 1
    assert list(common.released(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4]
    assert common._powers.cache_info().currsize == 0
