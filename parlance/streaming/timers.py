"""Operators in event time: rows wait for the watermark, are taken in the order of time, and silence has an end.

A row is held until the watermark has passed its time; then rows of a key are taken in the order
of (ts, ordinal), however they arrived, and a timer tells when a key has been silent for too long.
A stream so gives the rows of the same operator over a table. Fates: a row behind the watermark
is dropped by Spark (``numRowsDroppedByWatermark`` of the query's progress counts it), a row
without a time is left out, and a key whose step says ``over`` keeps no state: what comes for it
later begins anew. Streams need the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from parlance.streaming.state import transferred

Rows = list[tuple]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Turns:
    """A key's rows in the order of time. Rows are dicts with ``at``, microseconds, and ``ordinal``."""

    def __init__(self, step: Callable[[dict, dict], Rows], silent: Callable[[dict], Rows], silence: int, held: dict | None = None, due: int | None = None):
        self.step, self.silent, self.silence, self.held, self.due = step, silent, silence, held or {}, due

    def _ended(self, out: Rows) -> Rows:
        if self.held.get("over"):
            self.held, self.due = {}, None
        return out

    def _fallen_silent(self) -> Rows:
        self.due = None
        return self._ended(self.silent(self.held))

    def take(self, rows: Iterable[dict], until: int | None) -> Rows:
        """Rows before ``until``, and then silence up to it; None is the end of time."""
        out: Rows = []
        for row in sorted(rows, key=lambda r: (r["at"], r["ordinal"])):
            if self.due is not None and row["at"] >= self.due:
                out += self._fallen_silent()
            found = self.step(self.held, row)
            self.due = row["at"] + self.silence
            out += self._ended(found)
        if self.due is not None and (until is None or self.due < until):
            out += self._fallen_silent()
        return out


def _tuples(x: pd.DataFrame, schema: StructType) -> Iterator[tuple]:
    """Rows of a pandas frame, in which nulls made whole numbers floats, as the schema has them."""
    whole = [isinstance(f.dataType, IntegralType) for f in schema]
    for row in x[schema.names].itertuples(index=False):
        none = (not isinstance(v, (bytes, str)) and pd.isna(v) for v in row)
        yield tuple(None if n else int(v) if w else v for v, n, w in zip(row, none, whole))


class _Processor(StatefulProcessor):
    def __init__(self, waiting: StructType, output: list[str], step, silent, silence: int):
        self.schema, self.output, self.how = waiting, output, (step, silent, silence)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.state = handle.getValueState("state", "held string, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [r for x in rows for r in _tuples(x, self.schema)]
        if came:
            self.waiting.appendList(came)
            for at in {r[0] // 1000 + 1 for r in came}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [dict(zip(self.schema.names, r)) for r in self.waiting.get()]
        ready, later = [r for r in rows if r["at"] < now], [r for r in rows if r["at"] >= now]
        held, due = self.state.get() if self.state.exists() else ("{}", None)
        turns = Turns(*self.how, json.loads(held), due)
        out = turns.take(ready, now)
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put([tuple(r[n] for n in self.schema.names) for r in later])
        if turns.held or turns.due is not None:
            self.state.update((json.dumps(turns.held), turns.due))
        else:
            self.state.clear()
        if turns.due is not None:
            self.handle.registerTimer(turns.due // 1000 + 1)
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=self.output)

    def close(self) -> None:
        pass


def timed(rows: DataFrame, keys: list[str], output: str, step, silent, silence: int) -> DataFrame:
    """Rows that ``step`` (held, row) and, after ``silence`` microseconds without a row, ``silent`` (held) give;
    output: schema of the key and them.

    rows: keys, ts (of a stream with a watermark), ordinal and others. Over a table a key's rows are one group
    and its end is followed by silence; over a stream a key holds the rows that the watermark hasn't passed.
    """
    others = [c for c in rows.columns if c not in (*keys, "ts")]
    waiting = StructType([StructField("at", LongType()), *[rows.schema[c] for c in others]])
    schema = StructType.fromDDL(output)
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    if rows.isStreaming:
        if rows.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
            raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
        processor = _Processor(waiting, schema.names, step, silent, silence)
        return rows.where("ts is not null").select(*keys, "ts", at, *others).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")

    def fold(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        came = (dict(zip(waiting.names, r)) for r in _tuples(x, waiting))
        return pd.DataFrame([(*key, *out) for out in Turns(step, silent, silence).take(came, None)], columns=schema.names)

    return rows.where("ts is not null").select(*keys, at, *others).groupBy(*keys).applyInPandas(fold, schema)


def transfers(rows: DataFrame, stall: int = 5_000_000) -> DataFrame:
    """As ``state.received``, over rows with a time (stream, ts, offset, payload, code, ordinal): a transfer that is
    silent for ``stall`` microseconds gives a restart from its cursor, with ``why`` it was.

    After its end a transfer has no state; a frame that comes then begins a new one at 0.
    """

    def step(held: dict, row: dict) -> Rows:
        out = [(*x, "gap" if x[0] == "restart" else None) for x in transferred(held, row)]
        held["over"] = held.pop("done", False)
        return out

    def silent(held: dict) -> Rows:
        held["gap"] = True
        return [("restart", held.get("cursor", 0), None, "stall")]

    return timed(rows.select("stream", "ts", "offset", "payload", "code", "ordinal"), ["stream"], "stream string, what string, at long, payload binary, why string", step, silent, stall)


def accepted_in_time(rows: DataFrame, silence: int) -> DataFrame:
    """stream, seq of frames (stream, ts, seq, ordinal) whose number is above all before it in their stream, in the order
    of time; after ``silence`` microseconds a stream's last number is forgotten. Frames without a number are dropped."""

    def step(held: dict, row: dict) -> Rows:
        if row["seq"] is None or row["seq"] <= held.get("last", -1):
            return []
        held["last"] = int(row["seq"])
        return [(held["last"],)]

    def silent(held: dict) -> Rows:
        held["over"] = True
        return []

    return timed(rows.select("stream", "ts", "seq", "ordinal"), ["stream"], f"stream {rows.schema['stream'].dataType.simpleString()}, seq long", step, silent, silence)


def log_sessions(requests: DataFrame, key: str, gap: str) -> DataFrame:
    """key, first, last, n, failed: sessions of a log (key, ts, status) that close after ``gap`` without a request.

    Of a table, or of a stream with a watermark, which gives a session when the watermark has passed its
    end. Rows without a time are in no session.
    """
    window = F.session_window("ts", gap).alias("session")
    sums = requests.where("ts is not null").groupBy(key, window).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.count_if(F.col("status") >= 400).alias("failed"))
    return sums.select(key, "first", "last", "n", "failed")
