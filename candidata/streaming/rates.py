"""Request rates on a stream."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from candidata.operators.usage import WINDOW_REQUESTS, WINDOW_SECONDS

# Fixed names: the setting and the state store that processors with timers need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Windows in one span of time; a state holds a bucket of keys for one span.
SPAN_WINDOWS = 4

#: Buckets of keys: Python is called once per bucket and span that a batch touches, not once per key.
BUCKETS = 512


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started in this block keep their state in RocksDB, which state with timers needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Requests:
    """Requests of several keys: the distinct keys, and the place of each request's key among them."""

    NAMES = ("key", "at", "id", "own")

    def __init__(self, keys: np.ndarray, key: np.ndarray, at: np.ndarray, id: np.ndarray, own: np.ndarray):
        self.keys, self.key, self.at, self.id, self.own = keys, key, at, id, own

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Requests:
        key, keys = pd.factorize(rows["key"].to_numpy(object), use_na_sentinel=False)
        at, ids = (rows[c].to_numpy(np.int64) for c in ("at", "id"))
        return cls(keys, key.astype(np.int64), at, ids, rows["own"].to_numpy(bool))

    @classmethod
    def joined(cls, parts: Sequence[Requests]) -> Requests:
        """Those of all parts, in order, with one list of keys."""
        sizes = [len(p.keys) for p in parts]
        place, keys = pd.factorize(np.concatenate([p.keys for p in parts]), use_na_sentinel=False)
        first = np.cumsum([0, *sizes[:-1]])
        key = np.concatenate([place[n + p.key] for n, p in zip(first, parts)])
        return cls(keys, key, *(np.concatenate([getattr(p, c) for p in parts]) for c in cls.NAMES[1:]))

    @classmethod
    def stored(cls, keys, key, at, id, own) -> Requests:
        """From a row of state."""
        numbers = (np.frombuffer(x, np.int64) for x in (key, at, id))
        distinct = np.empty(len(keys), object)
        distinct[:] = [None if k is None else str(k) for k in keys]
        return cls(distinct, *numbers, np.frombuffer(own, bool))

    def to_store(self) -> tuple:
        keys = [None if pd.isna(k) else k for k in self.keys]
        return (keys, *(getattr(self, c).tobytes() for c in self.NAMES))

    def __len__(self) -> int:
        return len(self.at)

    def filter(self, kept: np.ndarray) -> Requests:
        return Requests(self.keys, *(getattr(self, c)[kept] for c in self.NAMES))


def trailing_counts(requests: Requests, of: Requests, window: int) -> np.ndarray:
    """How many of `requests` lie in the window that ends at each of `of`; both have the same list of keys."""
    times = np.unique(requests.at)
    n = len(times) + 1
    # Key and rank of the time in one number: the times of a key follow each other.
    rank = lambda key, at: key * n + np.searchsorted(times, at, "right")
    ordered = np.sort(rank(requests.key, requests.at))
    last, first = rank(of.key, of.at), rank(of.key, of.at - window)
    return np.searchsorted(ordered, last, "right") - np.searchsorted(ordered, first, "right")


class TrailingCounts(StatefulProcessor):
    """Requests of a bucket of keys and a span, and how many the window before each holds.

    What a batch brings is stored as one row of arrays, and all rows are read when the next comes.
    """

    def __init__(self, window: int, span: int, max_requests: int, names: tuple[str, ...]):
        self.window, self.span, self.max_requests, self.names = window, span, max_requests, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = handle.getListState("requests", "keys array<string>, key binary, at binary, id binary, own binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = Requests.of(pd.concat([batch[list(Requests.NAMES)] for batch in rows]))
        parts = [Requests.stored(*row) for row in self.requests.get()] if self.requests.exists() else []
        if not parts:
            # After this time no row of the span, and none of the window before it, is accepted.
            self.handle.registerTimer((int(key[1]) + 1) * self.span // 1000 + 1)
        self.requests.appendValue(new.to_store())
        every = Requests.joined([*parts, new])
        n_known = len(every) - len(new)
        known, new = every.filter(np.arange(len(every)) < n_known), every.filter(np.arange(len(every)) >= n_known)
        changed = known.filter(known.own)
        changed = changed.filter(trailing_counts(new, changed, self.window) > 0)
        for out in (new.filter(new.own), changed):
            if len(out):
                found = trailing_counts(every, out, self.window)
                values = (out.keys[out.key], out.id, out.at, found, found > self.max_requests)
                yield pd.DataFrame(dict(zip(self.names, values)))

    def handleExpiredTimer(
        self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        self.requests.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_requests_in_window(
    log: DataFrame,
    key: str,
    id: str,
    ts: str = "ts",
    seconds: float = WINDOW_SECONDS,
    max_requests: int = WINDOW_REQUESTS,
    delay: str = "10 seconds",
) -> DataFrame:
    """(key, id, at, in_window, over_limit) of every request of a stream, for `update_log`.

    As `operators.usage.requests_in_window`: how many requests of the key lie in the trailing
    window, the request itself included; `at` is its time in microseconds. A request is counted
    as it comes. One that comes late, by up to `delay`, changes the counts of those already given; these are given
    again, so the newest row of an id is its count. Ids are whole numbers.

    Time is cut into spans of `SPAN_WINDOWS` windows, and a state holds one of `BUCKETS` buckets of
    keys and one span: its own requests and those of the last window before it, which are sent to both. So a busy key is
    spread over its spans, and a timer drops a span as soon as no request of it can come. Run it
    within `rocksdb_state`. Keys travel as strings, so their type must be one that a string holds exactly.
    """
    window = int(seconds * 1_000_000)
    span = window * SPAN_WINDOWS
    at = F.unix_micros(ts)
    rows = log.withWatermark(ts, delay).select(
        F.col(key).cast("string").alias("key"), ts, at.alias("at"), F.col(id).cast("bigint").alias("id"), F.floor(at / span).alias("_own")
    )
    # The window of a later span reaches back to requests of the last window of this one.
    near_end = F.col("at") >= (F.col("_own") + 1) * span - window
    spans = F.when(near_end, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))
    rows = rows.withColumn("span", F.explode(spans)).withColumn("own", F.col("span") == F.col("_own")).drop("_own")
    names = (key, id, "at", "in_window", "over_limit")
    kind = log.schema[key].dataType.simpleString()
    schema = f"`{key}` string, `{id}` bigint, at bigint, in_window bigint, over_limit boolean"
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    counted = rows.groupBy("bucket", "span").transformWithStateInPandas(
        statefulProcessor=TrailingCounts(window, span, max_requests, names),
        outputStructType=schema,
        outputMode="Update",
        timeMode="EventTime",
    )
    return counted.withColumn(key, F.col(f"`{key}`").cast(kind))


def stream_request_ticks(
    log: DataFrame, key: str, ts: str = "ts", slide: str = "1 second", delay: str = "10 seconds"
) -> DataFrame:
    """Requests per key and tick of one slide, for `update_log`; ticks are forgotten after the delay."""
    ticks = log.withWatermark(ts, delay).groupBy(F.window(ts, slide).alias("window"), key)
    return ticks.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("tick"), "n")


def rates_of_ticks(
    ticks: DataFrame,
    key: str,
    window: str = "60 seconds",
    slide: str = "1 second",
    max_requests: int = WINDOW_REQUESTS,
) -> DataFrame:
    """Requests per key in sliding windows over stored ticks, and whether they are over the limit.

    All windows that hold a request are there, also those still open. Only counts are spread
    over the windows, so a request is not multiplied by the number of windows it lies in.
    """
    spans = ticks.groupBy(F.window("tick", window, slide).alias("window"), key)
    return spans.agg(F.sum("n").alias("requests")).select(
        key,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "requests",
        (F.col("requests") > max_requests).alias("over_limit"),
    )
