"""Keyed state over streams: flushing after N, pairing, numbering, first types, and panes that fire by count or time.

Each is a processor for transformWithStateInPandas; spark.sql.streaming.stateStore.providerClass must be RocksDB's.
Rows of a key within a micro-batch are taken in the order of an "ord" column. State of keys without end is kept for
ttl_ms after it was last written, if that is given, else for ever; state of windows goes with the windows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.operators.quality import type_name


def _rows(batches: Iterator[pd.DataFrame]) -> list:
    found = [b for b in batches if len(b)]
    return list(pd.concat(found).sort_values("ord", kind="stable").itertuples(index=False)) if found else []


class FlushAfter(StatefulProcessor):
    """Gathers a key's values until n rows, errors among them, have come; then gives those without error, once."""

    def __init__(self, n: int, ttl_ms: int | None = None):
        self.n, self.ttl = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n int", self.ttl)
        self.items = handle.getListState("items", "value long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        if seen >= self.n:
            return
        for r in _rows(rows):
            seen += 1
            if seen <= self.n and not r.is_error:
                self.items.appendValue((int(r.value),))
            if seen == self.n:
                held = [int(x[0]) for x in self.items.get()] if self.items.exists() else []
                self.items.clear()
                yield pd.DataFrame({"key": [key[0]], "items": [json.dumps(held)]})
        self.seen.update((min(seen, self.n),))


class Pair(StatefulProcessor):
    """Gives each two values of a key that follow each other; an odd one waits."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", "value long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = self.waiting.get()[0] if self.waiting.exists() else None
        out = []
        for r in _rows(rows):
            if waiting is None:
                waiting = int(r.value)
            else:
                out.append((key[0], waiting, int(r.value)))
                waiting = None
        if waiting is None:
            self.waiting.clear()
        else:
            self.waiting.update((waiting,))
        yield pd.DataFrame(out, columns=["key", "first", "second"])


class Number(StatefulProcessor):
    """Gives a key's values 0, 1, 2... as they come."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.next.get()[0] if self.next.exists() else 0
        got = _rows(rows)
        self.next.update((n + len(got),))
        yield pd.DataFrame([(key[0], n + i, int(r.value)) for i, r in enumerate(got)], columns=["key", "index", "value"])


class FirstType(StatefulProcessor):
    """Gives a field's type, by its first value, when the field is first seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "type string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.known.exists():
            kind = _rows(rows)[0].type
            self.known.update((kind,))
            yield pd.DataFrame({"name": [key[0]], "type": [kind]})


class Panes(StatefulProcessor):
    """Fires a pane each so many rows of a key, or, with seconds, when that long has passed since the pane's first row.

    The window is a global one, which never ends: every pane is EARLY. accumulated and discarded sums are both there for
    the reader to choose.
    """

    def __init__(self, every: int | None = None, seconds: float | None = None, ttl_ms: int | None = None):
        self.every, self.seconds, self.ttl = every, seconds, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pane", "index long, n long, sum double, total double", self.ttl)

    def _fire(self, key, index: int, part: float, total: float) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "pane_index": [index], "timing": ["EARLY"], "is_first": [index == 0], "accumulated": [total], "discarded": [part]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        index, n, part, total = self.state.get() if self.state.exists() else (0, 0, 0.0, 0.0)
        for r in _rows(rows):
            if n == 0 and self.seconds is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.seconds * 1000))
            n, part, total = n + 1, part + float(r.value), total + float(r.value)
            if self.every is not None and n == self.every:
                yield self._fire(key, index, part, total)
                index, n, part = index + 1, 0, 0.0
        self.state.update((index, n, part, total))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            index, n, part, total = self.state.get()
            if n:
                self.state.update((index + 1, 0, 0.0, total))
                yield self._fire(key, index, part, total)


class WindowPanes(StatefulProcessor):
    """Fires panes of a key's window (key, end_ms): EARLY ones, ON_TIME once, and LATE ones until lateness has passed.

    The latest time seen is the watermark plus lateness. While it is below the window's end, each micro-batch with rows of
    the window fires an EARLY pane, if wanted; then the ON_TIME pane comes, of what was there, be it nothing new; each
    later micro-batch fires a LATE pane. A window that began late has LATE ones only. Once the watermark is past a window's
    end its state goes, and rows of it that still come are left out.
    """

    def __init__(self, lateness_ms: int, early: bool = True):
        self.lateness, self.early = lateness_ms, early

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pane", "index long, part double, total double, closed boolean")

    def _fire(self, key, timing: str, index: int, part: float, total: float) -> pd.DataFrame:
        last = timing == "ON_TIME" and self.lateness == 0
        return pd.DataFrame({"key": [key[0]], "end_ms": [key[1]], "pane_index": [index], "timing": [timing], "is_first": [index == 0], "is_last": [last], "accumulated": [total], "discarded": [part]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end, latest = int(key[1]), timerValues.getCurrentWatermarkInMs() + self.lateness
        if latest - self.lateness >= end:
            return
        if self.state.exists():
            index, part, total, closed = self.state.get()
            if latest >= end and not closed:
                yield self._fire(key, "ON_TIME", index, part, total)
                index, part, closed = index + 1, 0.0, True
        else:
            index, part, total, closed = 0, 0.0, 0.0, latest >= end
            for at in {end - 1} | ({end - self.lateness - 1} if not closed else set()):
                self.handle.registerTimer(at)
        new = sum(float(r.value) for r in _rows(rows))
        part, total = part + new, total + new
        if closed or self.early:
            yield self._fire(key, "LATE" if closed else "EARLY", index, part, total)
            index, part = index + 1, 0.0
        self.state.update((index, part, total, closed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        index, part, total, closed = self.state.get()
        if not closed:
            yield self._fire(key, "ON_TIME", index, part, total)
            self.state.update((index + 1, 0.0, total, True))
        if expiredTimerInfo.getExpiryTimeInMs() >= int(key[1]) - 1:
            self.state.clear()


def _keyed(stream: DataFrame, processor: StatefulProcessor, schema: str, timers: str = "None", keys: Sequence[str] = ("key",)) -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=timers)


def _mode(ttl_ms: int | None, timers: bool = False) -> str:
    return "ProcessingTime" if timers or ttl_ms is not None else "None"


def flush_after(stream: DataFrame, n: int, ttl_ms: int | None = None) -> DataFrame:
    """key, items (JSON): see FlushAfter. stream: key string, ord, value, is_error."""
    return _keyed(stream, FlushAfter(n, ttl_ms), "key string, items string", _mode(ttl_ms))


def pairs(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return _keyed(stream, Pair(ttl_ms), "key string, first long, second long", _mode(ttl_ms))


def numbered(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return _keyed(stream, Number(ttl_ms), "key string, index long, value long", _mode(ttl_ms))


def first_types(stream: DataFrame, payload: str, arrival: str) -> DataFrame:
    """name, type of each top-level key of JSON objects, when it is first seen: see inferred_fields()."""
    entries = stream.select(F.col(arrival).alias("ord"), F.explode(F.from_json(payload, "map<string,string>")).alias("key", "value"))
    return _keyed(entries.select("key", "ord", type_name("value").alias("type")), FirstType(), "name string, type string")


def panes(stream: DataFrame, every: int | None = None, seconds: float | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Panes of a global window: see Panes. stream: key string, ord, value."""
    schema = "key string, pane_index long, timing string, is_first boolean, accumulated double, discarded double"
    return _keyed(stream, Panes(every, seconds, ttl_ms), schema, _mode(ttl_ms, seconds is not None))


def window_panes(stream: DataFrame, ts: str, size: str, lateness: str, early: bool = True) -> DataFrame:
    """key, window_end, pane_index, timing, is_first, is_last, accumulated, discarded: see WindowPanes.

    stream: key string, ord, value and ts. A row of a window that had ended lateness before the latest time goes; so may
    one, of a window still open, that is older than that itself.
    """
    late_ms = int(pd.Timedelta(lateness).total_seconds() * 1000)
    rows = stream.withWatermark(ts, lateness).select("key", F.unix_millis(F.window(ts, size).end).alias("end_ms"), "ord", "value", ts)
    schema = "key string, end_ms long, pane_index long, timing string, is_first boolean, is_last boolean, accumulated double, discarded double"
    fired = _keyed(rows, WindowPanes(late_ms, early), schema, "EventTime", ("key", "end_ms"))
    return fired.select("key", F.timestamp_millis("end_ms").alias("window_end"), *[c for c in fired.columns if c not in ("key", "end_ms")])
