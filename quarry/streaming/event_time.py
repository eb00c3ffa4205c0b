"""Streams that go by the time of events: what comes out of order is put in order before it counts, whatever the trigger it came in.

Both jobs keep state with timers on the watermark, so no clock of a machine decides, a run with an `availableNow` trigger ends
by itself, and results are those of the batch jobs for all rows that come before the watermark passes them. State that has run
out is removed by a timer. The session must keep its state in RocksDB (`PROVIDER`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quarry.functions.redaction import DEFAULT_RULES, Pattern, Words, redacted
from quarry.streaming.jobs import ATTEMPT, LATE, next_attempt, safe_cut

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _check(spark: SparkSession) -> None:
    if not str(spark.conf.get(PROVIDER[0], "")).endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {PROVIDER[0]} to {PROVIDER[1]}")


class _Lockout(StatefulProcessor):
    """A user's attempts are held until the watermark has passed them, then counted in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "count int, window_end double, locked_until double")
        self.pending = handle.getListState("pending", "ts double, success boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(float(ts), bool(ok)) for b in rows for ts, ok in zip(b["ts"], b["success"], strict=True)]
        if new:
            self.pending.appendList(new)
            self._wake(min(ts for ts, _ in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) / 1000
        held = sorted((r[0], r[1]) for r in self.pending.get())
        due, rest = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        state = tuple(self.state.get()) if self.state.exists() else (0, 0.0, 0.0)
        out = []
        for ts, ok in due:
            state, outcome = next_attempt(state, ts, ok)
            out.append((key[0], ts, outcome))
        if rest:
            self.pending.put(rest)
            self._wake(rest[0][0])
        else:
            self.pending.clear()
        ends = max(state[1], state[2])
        if ends > now:
            self.state.update(state)
            self._wake(ends)  # then count and lock have run out
        else:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=["username", "ts", "outcome"])

    def _wake(self, seconds: float) -> None:
        self.handle.registerTimer(int(seconds * 1000) + 1)


def login_lockout(attempts: DataFrame, late: str = LATE) -> DataFrame:
    """username, ts, outcome of a stream of attempts (username, ts in seconds, success), each once the watermark has passed it."""
    _check(attempts.sparkSession)
    rows = attempts.select("username", F.col("ts").cast("double").alias("ts"), "success", F.timestamp_millis((F.col("ts") * 1000).cast("long")).alias("at")).filter("ts is not null").withWatermark("at", late)
    return rows.groupBy("username").transformWithStateInPandas(_Lockout(), ATTEMPT, "Append", "EventTime")


class _Answers(StatefulProcessor):
    """Frames of an answer are held until all before them are there; a text goes on up to where no match can be cut."""

    def __init__(self, whole: bool, idle_ms: int):
        self.whole, self.idle = whole, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "seq long", "delta string, last boolean")
        self.state = handle.getValueState("state", "text string, part int, next long, touched long")

    def _goes(self, key: Any, text: str, part: int, ended: bool) -> tuple[str, int, list[tuple]]:
        cut = len(text) if ended else 0 if self.whole else safe_cut(text)
        return text[cut:], part + (cut > 0), [(key[0], part, text[:cut])] if cut else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        text, part, at, touched = tuple(self.state.get()) if self.state.exists() else ("", 0, 0, 0)
        for b in rows:
            for seq, delta, last, time in zip(b["seq"], b["delta"], b["last"], b["at"], strict=True):
                touched = max(touched, int(time.timestamp() * 1000))
                if at <= seq:  # one that comes again is passed over
                    self.frames.updateValue((int(seq),), (delta if isinstance(delta, str) else "", bool(last)))
        if at < 0:  # the answer has ended
            return
        ended = False
        while not ended and self.frames.containsKey((at,)):
            delta, ended = self.frames.getValue((at,))
            self.frames.removeKey((at,))
            text, at = text + delta, at + 1
        text, part, out = self._goes(key, text, part, ended)
        if ended:
            self.frames.clear()
        # an answer that has ended is remembered until its frames would come too late
        self.state.update((text, part, -1 if ended else at, touched))
        self.handle.registerTimer(touched + self.idle)
        if out:
            yield pd.DataFrame(out, columns=["answer_id", "part", "text"])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        text, part, at, touched = tuple(self.state.get())
        if touched + self.idle > max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()):
            return  # frames have come since
        if at >= 0:  # what is there ends the answer, with gaps where frames are missing
            held = sorted((k[0], v[0]) for k, v in self.frames.iterator())
            _, _, out = self._goes(key, text + "".join(d for _, d in held), part, True)
            if out:
                yield pd.DataFrame(out, columns=["answer_id", "part", "text"])
        self.frames.clear()
        self.state.clear()


def redact_deltas(deltas: DataFrame, rules: tuple[Pattern | Words, ...] = DEFAULT_RULES, late: str = LATE, idle: str = "10 minutes") -> DataFrame:
    """answer_id, part, masked, hits: a stream of frames (answer_id, seq from 0, delta, last, at) masked part by part, in their order.

    An answer ends with its last frame once all frames before it are there, or when the watermark is `idle` beyond its newest.
    With other rules than the built-in ones an answer is held until its end, as any text may be a match.
    """
    _check(deltas.sparkSession)
    kind = deltas.schema["answer_id"].dataType.simpleString()
    rows = deltas.select("answer_id", F.col("seq").cast("long").alias("seq"), "delta", "last", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    answers = _Answers(rules != DEFAULT_RULES, int(pd.Timedelta(idle).total_seconds() * 1000))
    parts = rows.groupBy("answer_id").transformWithStateInPandas(answers, f"answer_id {kind}, part int, text string", "Append", "EventTime")
    return redacted(parts, rules=rules).select("answer_id", "part", "masked", "hits")
