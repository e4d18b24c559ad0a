"""The queue of pending changes with both timers: silence since the last event, wait since the first one."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# Silence that flushes, longest wait of a pending change (microseconds), pending paths that flush at once.
SILENCE, WAIT, MOST = 2_000_000, 60_000_000, 300
FLUSH = "first_at long, last_at long, flush_at long, n long, events long, reason string"


class Pending:
    """What waits for one key. It never holds more than `most` paths, as that many flush."""

    def __init__(self, silence: int, wait: int, most: int):
        self.silence, self.wait, self.most = silence, wait, most
        self.clear()

    def clear(self) -> None:
        self.first = self.last = None
        self.events, self.paths = 0, set()

    def deadline(self) -> tuple[int, str]:
        quiet, stale = self.last + self.silence, self.first + self.wait
        return (quiet, "debounce") if quiet <= stale else (stale, "staleness")

    def flush(self, at: int, reason: str) -> tuple:
        out = (self.first, self.last, at, len(self.paths), self.events, reason)
        self.clear()
        return out

    def due(self, now: int) -> list[tuple]:
        """The flush whose timer ran out before now; an event at the very deadline still belongs to it."""
        return [self.flush(*self.deadline())] if self.events and now > self.deadline()[0] else []

    def add(self, at: int, path: str) -> list[tuple]:
        """Flushes that an event causes: the one before it that was due, its own if the queue is full."""
        done = self.due(at)
        self.first = at if self.first is None else min(self.first, at)
        self.last = at if self.last is None else max(self.last, at)
        self.events += 1
        self.paths.add(path)
        return [*done, self.flush(at, "threshold")] if len(self.paths) >= self.most else done


def _slim(events: DataFrame, key: str, ts: str, path: str) -> DataFrame:
    """k, ts, at, p: the time in microseconds too; times without a zone count as they read, whatever the session's zone."""
    at = F.unix_micros(ts) if events.schema[ts].dataType == T.TimestampType() else F.unix_micros(F.concat(F.col(ts).cast("string"), F.lit("Z")).cast("timestamp"))
    return events.where(F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.col(ts).alias("ts"), at.alias("at"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("p"))


def _timed(flushed: DataFrame, events: DataFrame, key: str, ts: str) -> DataFrame:
    """Flushes with times of the type that the events have."""

    def time(c: str):
        bare = F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(cast({c} as decimal(20, 0)) * 0.000001 as decimal(18, 6)))")
        return (F.timestamp_micros(c) if events.schema[ts].dataType == T.TimestampType() else bare).alias(c)

    return flushed.select(F.col("k").alias(key), *[time(c) for c in ("first_at", "last_at", "flush_at")], "n", "events", "reason")


def flushes(events: DataFrame, key: str = "repo", ts: str = "ts", path: str = "path", silence: int = SILENCE, wait: int = WAIT, most: int = MOST) -> DataFrame:
    """(key, first_at, last_at, flush_at, n, events, reason): every flush of a batch of events; n counts distinct paths.

    A flush comes `silence` after the last event (debounce), `wait` after the first pending one (staleness) or as soon as
    `most` paths wait (threshold), whichever is first. Each depends on the one before, so a key's events go through one task, but
    sorted and in Arrow batches: only the pending state is held. Events without a time are left out; null keys are one key.
    """
    kind = events.schema[key].dataType.simpleString()
    slim = _slim(events, key, ts, path).drop("ts")

    def run(frames):
        import pandas as pd

        now, queue = None, Pending(silence, wait, most)
        begun = False
        for df in frames:
            out = []
            for k, at, p in zip(df["k"], df["at"], df["p"], strict=True):
                k = None if pd.isna(k) else k
                if begun and k != now and queue.events:
                    out.append((now, *queue.flush(*queue.deadline())))
                begun, now = True, k
                out += [(k, *f) for f in queue.add(int(at), p)]
            yield pd.DataFrame(out, columns=names)
        if queue.events:
            yield pd.DataFrame([(now, *queue.flush(*queue.deadline()))], columns=names)

    names = ["k", *[c.split()[0] for c in FLUSH.split(", ")]]
    done = slim.repartition("k").sortWithinPartitions("k", "at", "p").mapInPandas(run, f"k {kind}, {FLUSH}")
    return _timed(done, events, key, ts)


def stream(events: DataFrame, key: str = "repo", ts: str = "ts", path: str = "path", late: str = "10 seconds", silence: int = SILENCE, wait: int = WAIT, most: int = MOST) -> DataFrame:
    """The same flushes of a stream, as event-time timers run out: state is one key's pending paths, `most` at most.

    Events within `late` of the watermark join what is pending. A timer fires once the watermark has passed it, so the last flushes wait
    for later events of any key.
    """
    kind = events.schema[key].dataType.simpleString()
    slim = _slim(events.withWatermark(ts, late), key, ts, path)
    names = ["k", *[c.split()[0] for c in FLUSH.split(", ")]]

    def run(k, frames, state):
        import json

        import pandas as pd

        queue = Pending(silence, wait, most)
        if state.exists:
            queue.first, queue.last, queue.events, paths = state.get
            queue.paths = set(json.loads(paths))
        seen, out = state.getCurrentWatermarkMs() * 1000, []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["at", "p"])
            for at, p in zip(rows["at"], rows["p"], strict=True):
                out += queue.add(int(at), p)
        out += queue.due(seen)
        if queue.events:
            state.update((queue.first, queue.last, queue.events, json.dumps(sorted(queue.paths))))
            state.setTimeoutTimestamp(max(-(-queue.deadline()[0] // 1000) + 1, seen // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*k, *f) for f in out], columns=names)

    done = slim.groupBy("k").applyInPandasWithState(run, f"k {kind}, {FLUSH}", "first long, last long, events long, paths string", "append", "EventTimeTimeout")
    return _timed(done, events, key, ts)
