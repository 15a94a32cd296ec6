"""Operators in event time: a stream that comes out of order gives the rows of the table."""

from datetime import datetime, timedelta

import pytest

from parlance.streaming import timers

T0 = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


DATA = "stream string, ts timestamp, offset long, payload binary, code long, ordinal long"
FRAMES = [
    # a stalls twice, and goes on from its cursor; b ends, and a frame after its end begins a new transfer
    ("a", 0, 0, b"abc", None, 1), ("a", 1, 3, b"de", None, 2), ("a", 8, 5, b"f", None, 3), ("a", 7.5, 3, b"de", None, 4), ("a", 30, 9, b"x", None, 5),
    ("b", 0, 0, b"zz", None, 6), ("b", 3, None, None, 1, 8), ("b", 2, 2, b"y", None, 7), ("b", 9, 0, b"new", None, 9), ("b", 9.5, 7, b"gap", None, 10), ("b", None, 3, b"no time", None, 11),
]
WANT = sorted(
    [
        ("a", "data", 0, b"abc", None), ("a", "data", 3, b"de", None), ("a", "restart", 5, None, "stall"), ("a", "data", 5, b"f", None), ("a", "restart", 6, None, "stall"), ("a", "restart", 6, None, "stall"),
        ("b", "data", 0, b"zz", None), ("b", "data", 2, b"y", None), ("b", "end", 3, None, None), ("b", "data", 0, b"new", None), ("b", "restart", 3, None, "gap"), ("b", "restart", 3, None, "stall"),
    ],
    key=str,
)
SEQS = [("a", 0, 5, 1), ("a", 1, 4, 2), ("a", 2, 6, 3), ("a", 50, 1, 4), ("a", 52, 1, 5), ("a", 51, 3, 6), ("b", 1, None, 7), ("b", 2, 0, 8)]


def plain(rows):
    clean = lambda v: bytes(v) if isinstance(v, bytearray) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=str)


def frame(spark, rows, schema):
    return spark.createDataFrame([(r[0], at(r[1]), *r[2:]) for r in rows], schema)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, timers.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def run(spark, path, parts, schema, operator, delay="1 minute"):
    """A file a batch, each in a run of its own from the checkpoint; the last one drives the watermark on."""
    query = None
    for part in parts:
        frame(spark, part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in").withWatermark("ts", delay)
        query = operator(rows).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{path}/out").collect(), query


def test_stalled_transfers_over_a_table(spark):
    assert plain(timers.transfers(frame(spark, FRAMES[::-1], DATA)).collect()) == WANT


def test_stalled_transfers_over_a_stream(rocks, tmp_path):
    end = [("end", 9000, None, None, 1, 99)]
    late = [("a", 10, 6, b"late", None, 12)]  # behind the watermark: dropped
    got, query = run(rocks, tmp_path, [FRAMES[1::2], FRAMES[::2], end, late, [("end", 20000, None, None, 1, 100)]], DATA, timers.transfers)
    assert [r for r in plain(got) if r[0] != "end"] == WANT
    # nothing is kept of transfers that ended or fell silent but their cursor: b's second, and a, wait at theirs
    state = rocks.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/state")
    assert sorted(r.key.stream for r in state.collect()) == ["a", "b"]
    waiting = rocks.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/state")
    assert {r.key.stream for r in waiting.collect()} <= {"end"}


def test_accepted_frames_are_forgotten_after_silence(rocks, tmp_path):
    schema = "stream string, ts timestamp, seq long, ordinal long"
    want = [("a", 1), ("a", 3), ("a", 5), ("a", 6), ("b", 0)]
    operator = lambda rows: timers.accepted_in_time(rows, 20_000_000)
    assert plain(operator(frame(rocks, SEQS, schema)).collect()) == want
    got, _ = run(rocks, tmp_path, [SEQS[::-2], SEQS[::2], [("end", 9000, 1, 9)], [("end", 20000, 1, 10)]], schema, operator)
    assert [r for r in plain(got) if r[0] != "end"] == want
    state = rocks.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/state")
    assert [r for r in state.collect() if r.key.stream != "end"] == []


def test_a_stream_needs_its_state_store(spark, tmp_path):
    frame(spark, SEQS, "stream string, ts timestamp, seq long, ordinal long").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("stream string, ts timestamp, seq long, ordinal long").parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError, match="providerClass"):
        timers.accepted_in_time(rows, 1)


def test_log_sessions(spark, tmp_path):
    schema = "key string, ts timestamp, status int"
    log = [("a", 0, 200), ("a", 59, 404), ("a", 119, 500), ("a", 300, 200), ("b", 10, 200), ("b", None, 200), (None, 5, 200)]
    want = [("None", 5, 5, 1, 0), ("a", 0, 119, 3, 2), ("a", 300, 300, 1, 0), ("b", 10, 10, 1, 0)]
    seconds = lambda rows: sorted((str(r[0]), *(int((t - T0).total_seconds()) for t in r[1:3]), *r[3:]) for r in rows)
    operator = lambda rows: timers.log_sessions(rows, "key", "1 minute 1 second")
    assert seconds(operator(frame(spark, log, schema)).collect()) == want
    got, _ = run(spark, tmp_path, [log[1::2], log[::2], [("end", 9000, 200)], [("end", 20000, 200)]], schema, operator, "10 minutes")
    assert [r for r in seconds(got) if r[0] != "end"] == want
