"""Operators with a state per key, over streams and, in the order of arrival, over tables.

A step takes a key's state and a row and gives rows; the state lives in Spark's state store, so a
query that is started again from its checkpoint goes on where it was. Rows of a key that
come in one batch are taken in the order of ``ordinal``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

Step = Callable[[dict, dict], list[tuple]]


def folded(rows: DataFrame, keys: list[str], output: str, step: Step) -> DataFrame:
    """Rows that ``step`` gives; output: schema of the key and them. For streams and tables."""
    schema = StructType.fromDDL(output)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=schema.names)

    def fold(key: tuple, found: Iterable[dict], held: dict) -> list[tuple]:
        return [(*key, *x) for row in found for x in step(held, row)]

    def streamed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        out = fold(key, pd.concat(list(frames)).sort_values("ordinal", kind="stable").to_dict("records"), held)
        state.update((json.dumps(held),))
        yield frame(out)

    if rows.isStreaming:
        return rows.groupBy(*keys).applyInPandasWithState(streamed, output, "state string", "append", GroupStateTimeout.NoTimeout)
    kinds = to_arrow_schema(schema)

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda row: (row["ordinal"] is None, row["ordinal"] or 0))
        out = fold(tuple(k.as_py() for k in key), found, {})
        return pa.Table.from_arrays([pa.array([row[i] for row in out], f.type) for i, f in enumerate(kinds)], schema=kinds)

    # steps take long for few bytes: a fixed number of partitions isn't put together by their size
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).groupBy(*keys).applyInArrow(whole, output)


def accepted(rows: DataFrame, key: str = "stream") -> DataFrame:
    """Frames (stream, seq, ordinal) whose number is above all before it in their stream; repeated and
    late ones are dropped, as are those without a number. Over a table it is a running maximum."""
    rows = rows.where("seq is not null")
    if not rows.isStreaming:
        before = F.max("seq").over(Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("before", before).where(F.col("seq") > F.coalesce("before", F.lit(-1))).select(key, F.col("seq").cast("long").alias("seq"))

    def step(held: dict, row: dict) -> list[tuple]:
        if row["seq"] <= held.get("last", -1):
            return []
        held["last"] = int(row["seq"])
        return [(row["seq"],)]

    return folded(rows.select(key, "seq", "ordinal"), [key], f"{key} {rows.schema[key].dataType.simpleString()}, seq long", step)


def listed(rows: DataFrame) -> DataFrame:
    """Paged lists (stream, stamp, totals, start, n, ordinal): what became of each page, how many entries
    there are then, and whether the list is complete.

    The first page fixes stamp and totals; a page counts only if it starts where the list ends.
    """

    def step(held: dict, row: dict) -> list[tuple]:
        held.setdefault("stamp", int(row["stamp"]))
        if row["stamp"] != held["stamp"]:
            how = "stamp"
        else:
            held.setdefault("totals", int(row["totals"]))
            held.setdefault("n", 0)
            if pd.isna(row["start"]):
                how = "header"
            elif row["start"] != held["n"]:
                how = "index"
            else:
                held["n"], how = held["n"] + int(row["n"]), "accepted"
        return [(row["ordinal"], how, held.get("n", 0), held.get("n") == held.get("totals"))]

    return folded(rows.select("stream", "stamp", "totals", "start", "n", "ordinal"), ["stream"], "stream string, ordinal long, how string, n long, complete boolean", step)


def transferred(held: dict, row: dict) -> list[tuple]:
    """What a frame (offset, payload, code) does to a transfer: ``received`` says how."""
    cursor = held.setdefault("cursor", 0)
    if held.get("done"):
        return []
    if not pd.isna(row["code"]):
        if row["code"] == 1:
            held["done"] = True
            return [("end", cursor, None)]
        waiting, held["gap"] = held.get("gap", False), False
        return [("restart", cursor, None)] if waiting else []
    if pd.isna(row["offset"]):
        return []
    if row["offset"] != cursor:
        if row["offset"] < cursor or held.get("gap"):
            return []
        held["gap"] = True
        return [("restart", cursor, None)]
    held["gap"], held["cursor"] = False, cursor + len(row["payload"] or b"")
    return [("data", cursor, bytes(row["payload"] or b""))]


def received(rows: DataFrame) -> DataFrame:
    """Transfers (stream, session, offset, payload, code, ordinal): the payloads that continue what is
    there, a restart (``restart``, from the cursor) at each gap, and ``end`` at an empty package of code 1.

    What lies before the cursor is dropped, as is a frame without an offset and a code; after a gap nothing
    counts until the cursor's offset comes."""
    return folded(rows.select("stream", "offset", "payload", "code", "ordinal"), ["stream"], "stream string, what string, at long, payload binary", transferred)


def assembled(rows: DataFrame) -> DataFrame:
    """Multipart uploads (upload, kind: part or complete, part, etag, md5, parts: array of number and
    etag, ordinal): a row for each request to complete, with the parts' numbers in order or the error.

    Parts come in any order, a later one of a number replaces the earlier; completing twice
    gives the same again. Bodies stay in their table; what is joined to them is the list of parts.
    """

    def step(held: dict, row: dict) -> list[tuple]:
        there = held.setdefault("there", {})
        if row["kind"] == "part":
            there[str(int(row["part"]))] = row["etag"].strip('"')
            return []
        if "done" in held:
            return [(held["done"], None)]
        asked = sorted((int(p["part"]), p["etag"].strip('"')) for p in row["parts"])
        numbers = [n for n, _ in asked]
        twice = [n for n in numbers if numbers.count(n) > 1]
        absent = [n for n in numbers if str(n) not in there]
        other = [n for n, e in asked if there.get(str(n)) not in (None, e)]
        for found, what in ((twice, "listed twice"), (absent, "never uploaded"), (other, "of another etag")):
            if found:
                return [(None, f"part {found[0]} {what}")]
        held["done"] = numbers
        return [(numbers, None)]

    return folded(rows.select("upload", "kind", "part", "etag", "parts", "ordinal"), ["upload"], "upload string, parts array<int>, error string", step)


def bindings(rows: DataFrame) -> DataFrame:
    """Devices (device, kind: bind or unbind, owner, ordinal): the answer to each request, is_bind, and
    the number of bind events so far. A device of one owner is refused to others, and one that was never
    bound can't be unbound."""

    def step(held: dict, row: dict) -> list[tuple]:
        owner = held.get("owner")
        if owner is not None and owner != row["owner"]:
            return [(row["ordinal"], 403, True, held.get("n", 0))]
        if row["kind"] == "unbind" and not held.get("n"):
            return [(row["ordinal"], 404, False, 0)]
        if row["kind"] == "bind":
            held["owner"], held["n"] = row["owner"], held.get("n", 0) + 1
        else:
            held["owner"] = None
        return [(row["ordinal"], 200, held["owner"] is not None, held.get("n", 0))]

    return folded(rows.select("device", "kind", "owner", "ordinal"), ["device"], "device string, ordinal long, status int, is_bind boolean, binds long", step)


def binding_state(rows: DataFrame) -> DataFrame:
    """device, is_bind (null: never bound), history (owners, newest first) of accepted events."""
    answers = bindings(rows).where("status = 200").select("device", "ordinal")
    done = rows.join(answers, ["device", "ordinal"])
    history = F.reverse(F.array_sort(F.collect_list(F.when(F.col("kind") == "bind", F.struct("ordinal", "owner")))))
    last = F.max_by("kind", "ordinal") == "bind"
    state = done.groupBy("device").agg(F.transform(history, lambda x: x["owner"]).alias("history"), last.alias("last"))
    return state.select("device", F.when(F.size("history") > 0, F.col("last")).alias("is_bind"), "history")


def request_log(spark: SparkSession, path: str, hidden: str = "/_mock", body: int = 4096) -> DataFrame:
    """A stream of requests from a folder of JSON lines: seq, method, path, status, body (its first bytes),
    without those of hidden paths."""
    rows = spark.readStream.schema("seq long, method string, path string, status int, body string").json(path)
    return rows.where(~F.coalesce(F.col("path").startswith(hidden), F.lit(False))).withColumn("body", F.substring("body", 1, body))


