"""Conversations and caches as streams, with state by key.

Both read events in the order of their time (ties by id) within a micro-batch; across micro-batches time goes on, and an event from before the last one that
its state has seen is late: it changes nothing and gives no row, as does one whose id the state still holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quillgraph.catalog import HISTORY_MESSAGES, RECENT_MESSAGES, SESSION_IDLE_SECONDS

#: Parts of a cache: its keys are dealt to them, and what concerns all keys goes to each.
CACHE_PARTS = 16
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TURN = "session_id string, message_id string, ts timestamp, role string, text string, language string, context string, n_messages int"
CACHE = "op string, key string, ts timestamp, value string, removed int"


def _microseconds(ts: pd.Timestamp) -> int:
    return int(ts.value // 1000) if ts.unit == "ns" else int(ts.as_unit("us").value)


class Conversation(StatefulProcessor):
    """One session: its last messages and its language."""

    def __init__(self, keep: int, recent: int, idle: int, default: str) -> None:
        self.keep, self.recent, self.idle, self.default = keep, recent, idle, default

    def init(self, handle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "message_id string, text string")
        self.about = handle.getValueState("about", "language string, last long, total int")

    def _forget(self) -> None:
        self.messages.clear()
        self.about.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["ts", "message_id"])
        held = [(m[0], m[1]) for m in self.messages.get()] if self.messages.exists() else []
        language, last, total = self.about.get() if self.about.exists() else (None, None, 0)
        out = []
        for r in new.itertuples(index=False):
            at = _microseconds(r.ts)
            if last is not None and at - last > self.idle * 1_000_000:
                held, language, total = [], None, 0  # a pause begins another conversation
            elif last is not None and (at < last or any(m == r.message_id for m, _ in held)):
                continue
            switch = r.switch if isinstance(r.switch, str) else None
            detected = r.detected if isinstance(r.detected, str) else None
            language = switch or language or (detected if not held else None) or self.default
            before = held[-(self.recent - 1) :] if self.recent > 1 else []
            held = [*held, (r.message_id, r.text if isinstance(r.text, str) else None)][-self.keep :]
            last, total = at, total + 1
            context = "\n".join(t[:300] for _, t in before if t is not None)
            out.append((key[0], r.message_id, r.ts, r.role, r.text, language, context, min(total, self.keep)))
        if last is not None:
            self.messages.put(held)
            self.about.update((language, last, total))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.idle * 1000 + 1)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in TURN.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._forget()
        yield pd.DataFrame(columns=[c.split(" ")[0] for c in TURN.split(", ")])

    def close(self) -> None:
        pass


def conversations(messages: DataFrame, late: str = "10 minutes", keep: int = HISTORY_MESSAGES, recent: int = RECENT_MESSAGES, idle: int = SESSION_IDLE_SECONDS, default: str = "it") -> DataFrame:
    """A stream of messages with each one's language, the context before it, and how many messages its session holds.

    messages: session_id, message_id, ts, role, text, switch (the language that it asks for), detected (what a first message is written in). A session keeps ``keep``
    messages; after ``idle`` seconds of the watermark without one its state goes. The same rows as ``chat.conversation`` gives for all messages at once.
    """
    rows = messages.select("session_id", "message_id", "ts", "role", "text", "switch", "detected").withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(Conversation(keep, recent, idle, default), TURN, "Append", "EventTime")


class Cache(StatefulProcessor):
    """The entries of one part of a cache."""

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "value string, expiry long")
        self.about = handle.getValueState("about", "last long")

    def _state(self) -> dict:
        return {k[0]: (v[0], v[1]) for k, v in self.entries.iterator()} if self.entries.exists() else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        last = self.about.get()[0] if self.about.exists() else None
        entries, out = self._state(), []
        there = set(entries)
        for r in new.itertuples(index=False):
            now = _microseconds(r.ts)
            if last is not None and now < last:
                continue
            last = now
            if r.op == "set":
                entries[r.key] = (r.value if isinstance(r.value, str) else None, now + int(r.ttl_seconds) * 1_000_000)
            elif r.op == "get":
                value, expiry = entries.get(r.key, (None, now))
                if now >= expiry:  # an entry that expires now is gone
                    entries.pop(r.key, None)
                    value = None
                out.append(("get", r.key, r.ts, value, 0))
            else:
                gone = [k for k, (_, expiry) in entries.items() if r.op == "flush" or expiry < now]  # a cleanup leaves what expires now
                for k in gone:
                    del entries[k]
                out.append((r.op, None, r.ts, None, len(gone)))
        for k in there - set(entries):
            self.entries.removeKey((k,))
        for k, v in entries.items():
            self.entries.updateValue((k,), v)
        self.about.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if entries:
            self.handle.registerTimer(min(e for _, e in entries.values()) // 1000 + 1)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CACHE.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """What the watermark has passed can't be read any more, and goes without a row."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        left = []
        for k, (_, expiry) in self._state().items():
            if expiry < passed:
                self.entries.removeKey((k,))
            else:
                left.append(expiry)
        if left:
            self.handle.registerTimer(min(left) // 1000 + 1)
        yield pd.DataFrame(columns=[c.split(" ")[0] for c in CACHE.split(", ")])

    def close(self) -> None:
        pass


def cache(events: DataFrame, late: str = "10 minutes", parts: int = CACHE_PARTS) -> DataFrame:
    """op, key, ts, value, removed: what each get finds, and how many entries of each part a flush or cleanup removes.

    events: event_id, op (set, get, flush, cleanup), key, ts, value, ttl_seconds. A get at an entry's expiry finds nothing and removes it; a cleanup
    leaves an entry that expires at its time; a flush removes all. Flushes and cleanups reach every part; their rows add up over parts.
    """
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    part = F.when(F.col("op").isin("set", "get"), F.array(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))).otherwise(every)
    rows = events.select("event_id", "op", "key", "ts", "value", F.coalesce("ttl_seconds", F.lit(3600)).cast("long").alias("ttl_seconds"), F.explode(part).alias("part")).withWatermark("ts", late)
    return rows.groupBy("part").transformWithStateInPandas(Cache(), CACHE, "Append", "EventTime")
