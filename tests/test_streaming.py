"""Operators with state: the same over a table and over a stream that comes in parts."""

import json

import pytest

from parlance.streaming import state

FRAMES = [("a", 1, 1), ("a", 3, 2), ("a", 2, 3), ("b", 0, 4), ("a", 3, 5), ("a", 9, 6), ("b", 0, 7)]
PAGES = [("s", 7, 3, 0, 2, 1), ("s", 8, 3, 2, 1, 2), ("s", 7, 9, 0, 2, 3), ("s", 7, 9, 2, 1, 4), ("t", 1, 2, None, 0, 5), ("t", 1, 2, 0, 3, 6)]
DATA = [("x", 0, "abc", None, 1), ("x", 5, "zz", None, 2), ("x", 9, "zz", None, 3), ("x", 3, "de", None, 4), ("x", 0, "abc", None, 5), ("x", 5, "f", None, 6), ("x", None, None, 1, 7), ("x", 6, "g", None, 8)]
PARTS = [
    ("u", "part", 2, '"e2"', None, 1),
    ("u", "complete", None, None, [(1, "e1"), (2, "e2")], 2),
    ("u", "part", 1, "e1", None, 3),
    ("u", "complete", None, None, [(1, "e1"), (1, "e1")], 4),
    ("u", "complete", None, None, [(1, "e9")], 5),
    ("u", "complete", None, None, [(2, '"e2"'), (1, "e1")], 6),
    ("u", "complete", None, None, [], 7),
]
BINDS = [("d", "bind", "p", 1), ("d", "bind", "q", 2), ("d", "bind", "p", 3), ("d", "unbind", "p", 4), ("d", "bind", "q", 5), ("e", "unbind", "p", 6)]
CASES = {
    "accepted": (FRAMES, "stream string, seq long, ordinal long", [("a", 1), ("a", 3), ("a", 9), ("b", 0)]),
    "listed": (
        PAGES,
        "stream string, stamp long, totals long, start long, n long, ordinal long",
        [("s", 1, "accepted", 2, False), ("s", 2, "stamp", 2, False), ("s", 3, "index", 2, False), ("s", 4, "accepted", 3, True), ("t", 5, "header", 0, False), ("t", 6, "accepted", 3, False)],
    ),
    "received": (
        DATA,
        "stream string, offset long, payload binary, code long, ordinal long",
        [("x", "data", 0, b"abc"), ("x", "restart", 3, None), ("x", "data", 3, b"de"), ("x", "data", 5, b"f"), ("x", "end", 6, None)],
    ),
    "assembled": (
        PARTS,
        "upload string, kind string, part int, etag string, parts array<struct<part:int,etag:string>>, ordinal long",
        [("u", None, "part 1 never uploaded"), ("u", None, "part 1 listed twice"), ("u", None, "part 1 of another etag"), ("u", [1, 2], None), ("u", [1, 2], None)],
    ),
    "bindings": (
        BINDS,
        "device string, kind string, owner string, ordinal long",
        [("d", 1, 200, True, 1), ("d", 2, 403, True, 1), ("d", 3, 200, True, 2), ("d", 4, 200, False, 2), ("d", 5, 200, True, 3), ("e", 6, 404, False, 0)],
    ),
}


def plain(rows):
    clean = lambda v: bytes(v) if isinstance(v, bytearray) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=str)


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(v.encode() if isinstance(v, str) and i == 2 and "payload" in schema else v for i, v in enumerate(r)) for r in rows], schema)


@pytest.mark.parametrize("name", CASES)
def test_over_tables(spark, name):
    rows, schema, want = CASES[name]
    assert plain(getattr(state, name)(frame(spark, rows[::-1], schema)).collect()) == sorted(want, key=str)


@pytest.mark.parametrize("name", CASES)
def test_over_streams(spark, tmp_path, name):
    """A file a batch, and a query that is stopped and started again from its checkpoint."""
    rows, schema, want = CASES[name]
    source, out = str(tmp_path / "in"), "out"
    stream = lambda: getattr(state, name)(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    for part in (rows[:3], rows[3:]):
        frame(spark, part, schema).coalesce(1).write.mode("append").parquet(source)
        query = stream().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / out)).trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / out)).collect()
    assert plain(found) == sorted(want, key=str)


def test_binding_state(spark):
    rows = {r.device: r for r in state.binding_state(frame(spark, BINDS, CASES["bindings"][1])).collect()}
    assert (rows["d"].is_bind, rows["d"].history) == (True, ["q", "p", "p"]) and "e" not in rows


def test_request_log(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text("\n".join(json.dumps({"seq": i, "method": "GET", "path": p, "status": 200, "body": "x" * 9}) for i, p in enumerate(["/a", "/_mock/b", "/c"])))
    query = state.request_log(spark, str(log), body=4).writeStream.format("memory").queryName("requests").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("requests").collect()) == [(0, "GET", "/a", 200, "xxxx"), (2, "GET", "/c", 200, "xxxx")]
