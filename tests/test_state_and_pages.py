"""State as tables, and pages of binary files."""

import struct

import pytest
from pyspark.sql import functions as F

from parlance.sources import pages
from parlance.streaming import tables

CHANGES = "kind string, key string, ordinal long, gone boolean, fields string, body binary"
BATCHES = [
    [("object", "a", 1, None, "f1", b"one"), ("object", "b", 2, False, "f", b"one"), ("task", "t", 3, None, "s1", None), ("object", "a", 4, None, "f2", b"two")],
    [("object", "b", 5, True, None, None), ("object", "c", 6, None, "f", b"one"), ("task", "t", 7, None, "s2", None)],
    [("object", "b", 8, None, "again", b"three"), ("device", "d", 9, True, None, None)],
]
STATE = [("object", "a", "f2"), ("object", "b", "again"), ("object", "c", "f"), ("task", "t", "s2")]


@pytest.mark.parametrize("fold", [0, 2])
def test_a_batch_twice_changes_nothing(spark, tmp_path, fold):
    frames = [spark.createDataFrame(b, CHANGES) for b in BATCHES]
    for number in (0, 0, 1, 2, 2, 1, 2):  # repeated, and run again after a later one
        tables.save(frames[number], number, str(tmp_path), fold)
    assert sorted((r.kind, r.key, r.fields) for r in tables.current(spark, str(tmp_path)).collect()) == STATE
    whole = {(r.key, bytes(r.body), r.whole) for r in tables.bodies(spark, str(tmp_path)).collect()}
    assert whole == {("a", b"two", True), ("b", b"three", True), ("c", b"one", True)}
    assert spark.read.parquet(f"{tmp_path}/bodies").count() == 3
    assert sorted(tuple(r) for r in tables.summary(spark, str(tmp_path)).collect()) == [("device", 0, 0, 0, 1), ("object", 3, 11, 3, 6), ("task", 1, 0, 0, 2)]


def test_a_stream_into_tables(spark, tmp_path):
    for b in BATCHES:
        spark.createDataFrame(b, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        sink = rows.writeStream.foreachBatch(lambda df, n: tables.save(df, n, f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/check")
        sink.trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.kind, r.key, r.fields) for r in tables.current(spark, f"{tmp_path}/out").collect()) == STATE


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc >> 31 else crc << 1
            crc &= 0xFFFFFFFF
    return crc


def page(payload, lacing, flags=0, granule=0, sequence=0, crc=None):
    head = b"OggS\0" + struct.pack("<BqII", flags, granule, 5, sequence)
    rest = bytes([len(lacing), *lacing]) + payload
    return head + struct.pack("<I", slow_checksum(head + bytes(4) + rest) if crc is None else crc) + rest


HEAD = b"OpusHead\x01\x02" + struct.pack("<HIhB", 312, 16000, 0, 0)
LONG = bytes(range(256)) * 3
FILES = {
    "good": page(HEAD, [19], 2) + page(b"tags", [4], sequence=1) + page(LONG[:510] + b"ab", [255, 255, 2], 0, 960, 2) + page(LONG[:765], [255, 255, 255], 0, -1, 3) + page(b"xyz" + b"end", [3, 3], 5, 48312, 4),
    "damaged": page(b"no head", [7], 2, 0, 0, crc=1) + page(b"abc", [3], 0, 480, 1) + page(b"abc", [9], 0, 999, 2),
    "orphan": page(b"restnext", [4, 4], 1, 100) + page(b"cut", [255], 0, 200, 1)[:-1] + b"",
    "open": page(HEAD, [19], 2) + page(LONG[:255], [255], 0, 100, 1),
    "empty": b"",
    "other": b"RIFF....",
}


def table(spark):
    return pages.pages(spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "path string, content binary"))


def test_pages_and_packets(spark):
    found = table(spark).cache()
    rows = {(r.path, r.page): r for r in found.collect()}
    assert [rows["good", i].crc_good for i in range(5)] == [True] * 5 and not rows["damaged", 0].crc_good
    assert rows["damaged", 2].error == "the payload is cut" and rows["other", 0].error == "not a page" and not any(p == "empty" for p, _ in rows)
    assert rows["good", 4].granule == 48312 and rows["good", 3].granule == -1 and list(rows["good", 2].lacing) == [255, 255, 2]
    local = {(r.path, r.page, r.packet): bytes(r.data) for r in pages.page_packets(found).collect()}
    assert local["good", 2, 0] == LONG[:510] + b"ab" and local["good", 3, 0] == LONG[:765] and local["good", 4, 0] == b"xyz"
    across = {(r.path, r.packet): (r.page, bytes(r.data), r.whole) for r in pages.packets(found).collect()}
    assert across["good", 3] == (3, LONG[:765] + b"xyz", True) and across["good", 4] == (4, b"end", True)
    assert across["orphan", 0] == (0, b"rest", False) and across["orphan", 1] == (0, b"next", True)
    assert across["open", 1][2] is False


def test_durations(spark, tmp_path):
    got = {r.path: (r.seconds, r.ended, r.bad_crc, r.error) for r in pages.durations(table(spark)).collect()}
    assert got["good"] == (1.0, True, 0, None) and got["damaged"] == (0.01, False, 1, "the payload is cut")
    assert got["other"] == (None, False, 0, "not a page") and "empty" not in got
    heads = {r.path: tuple(r)[1:] for r in pages.heads(table(spark)).collect()}
    assert heads["good"] == (2, 312, 16000, True) and heads["damaged"] == (1, 0, 48000, False)
    for name in ("good.ogg", "open.opus", "other.wav"):
        (tmp_path / name).write_bytes(FILES[name.split(".")[0]])
    assert pages.durations(pages.pages(pages.read(spark, str(tmp_path)))).count() == 2
