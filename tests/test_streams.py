"""Streams with state against the same work done at once."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from quillgraph.operators import chat
from quillgraph.streaming import conversations as streams

MESSAGES = "session_id string, message_id string, ts timestamp, role string, text string, switch string, detected string"
EVENTS = "event_id string, op string, key string, ts timestamp, value string, ttl_seconds long"
START = datetime(2025, 3, 1)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, path, batches, schema, made, name):
    """All rows of a stream that gets one file at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        query = made(spark.readStream.schema(schema).parquet(f"{path}/in")).writeStream.format("parquet").option("checkpointLocation", f"{path}/at").outputMode("append").trigger(availableNow=True).start(f"{path}/out")
        query.awaitTermination(120)
        assert query.exception() is None, (i, query.exception())
    return spark.read.parquet(f"{path}/out")


def test_a_stream_of_messages_has_the_rows_of_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows, at = [], START
    for i in range(90):
        at += timedelta(seconds=rng.choice([1, 5, 30, 4000 if i % 17 == 0 else 2]))
        s = rng.choice("ab")
        rows.append((s, f"m{i:03}", at, rng.choice(["user", "assistant"]), rng.choice(["x" * 400, f"text {i}", None]), rng.choice([None] * 6 + ["en", "es"]), rng.choice([None, "en", "it"])))
    batches = [rows[:30], [*rows[30:60], rows[58]], [*rows[60:], ("a", "m001", rows[1][2], "user", "late", None, None), rows[59]]]
    found = streamed(spark, str(tmp_path), batches, MESSAGES, lambda s: streams.conversations(s, late="1 second", keep=7, recent=4), "turns")
    expected = chat.conversation(spark.createDataFrame(rows, MESSAGES), keep=7, recent=4)
    told = lambda df: sorted(tuple(str(v) for v in r.asDict().values()) for r in df.select(expected.columns).collect())
    assert told(found) == told(expected)


def test_a_cache_keeps_to_its_expiries(spark, tmp_path):
    t = lambda s: START + timedelta(seconds=s)
    first = [("e1", "set", "a", t(0), "A", 60), ("e2", "set", "b", t(0), "B", 10), ("e3", "get", "a", t(9), None, None), ("e4", "get", "b", t(10), None, None), ("e5", "get", "c", t(11), None, None)]
    second = [("e6", "set", "d", t(20), "D", 10), ("e7", "cleanup", None, t(30), None, None), ("e8", "get", "a", t(59), None, None), ("e0", "get", "a", t(1), None, None)]
    third = [("f0", "cleanup", None, t(61), None, None), ("f1", "set", "g", t(70), "G", 1000), ("f2", "flush", None, t(71), None, None), ("f3", "get", "g", t(72), None, None), ("f4", "set", "g", t(73), "H", 1000), ("f5", "get", "g", t(74), None, None)]
    found = streamed(spark, str(tmp_path), [first, second, third], EVENTS, lambda s: streams.cache(s, late="1 day", parts=3), "cache").collect()
    gets = sorted((r.ts, r.key, r.value) for r in found if r.op == "get")
    assert gets == [(t(9), "a", "A"), (t(10), "b", None), (t(11), "c", None), (t(59), "a", "A"), (t(72), "g", None), (t(74), "g", "H")]
    removed = {}
    for r in found:
        if r.op != "get":
            removed[r.op, r.ts] = removed.get((r.op, r.ts), 0) + r.removed
    assert removed == {("cleanup", t(30)): 0, ("cleanup", t(61)): 2, ("flush", t(71)): 1}


def test_state_goes_when_time_has_passed(spark, tmp_path):
    t = lambda s: START + timedelta(seconds=s)
    batches = [[(f"e{i}", "set", f"k{i}", t(0), "v", 10) for i in range(20)], [("f", "get", "z", t(100), None, None)], [("g", "get", "z", t(200), None, None)]]
    path = str(tmp_path)
    streamed(spark, path, batches, EVENTS, lambda s: streams.cache(s, late="1 second", parts=2), "gone")
    last = spark.readStream.schema(EVENTS).parquet(f"{path}/in")
    query = streams.cache(last, late="1 second", parts=2).writeStream.format("parquet").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination(120)
    state = spark.read.format("statestore").option("stateVarName", "entries").load(f"{path}/at")
    assert state.count() == 0
