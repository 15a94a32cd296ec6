"""Annotated speech corpora in XML: words of speakers, and their conversion to turns with text."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import intervals
from parlance.operators.text import corpus_words

ID = "{http://nite.sourceforge.net/}id"
TOKENS = "path string, pos int, id string, kind string, text string, start double, end double, punc boolean, trunc boolean, error string"
_TOKENS = pa.schema(
    [(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in TOKENS.split(", "))]
)


def _elements(path: str, value: str) -> Iterator[dict]:
    none = {"path": path, "pos": None, "id": None, "kind": None, "text": None, "start": None, "end": None, "punc": None, "trunc": None}
    try:
        root = ElementTree.fromstring(value)
    except ElementTree.ParseError as wrong:
        yield none | {"error": f"not XML: {wrong}"}
        return
    seen = set()
    for pos, e in enumerate(root):
        error, times = None, {}
        for name, key in (("starttime", "start"), ("endtime", "end")):
            try:
                times[key] = float(e.get(name)) if e.get(name) is not None else None
            except ValueError:
                error, times[key] = f"{name} is no number: {e.get(name)}", None
        if not e.get(ID):
            error = "no id"
        elif e.get(ID) in seen:
            error = f"the id {e.get(ID)} is repeated"
        seen.add(e.get(ID))
        yield {"path": path, "pos": pos, "id": e.get(ID), "kind": e.tag, "text": e.text or "", **times, "punc": e.get("punc") == "true", "trunc": e.get("trunc") == "true", "error": error}


def tokens(files: DataFrame) -> DataFrame:
    """All elements of word files (path, value), in the order of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist()):
                yield pa.RecordBatch.from_pylist(list(_elements(path, value)), schema=_TOKENS)

    return files.select("path", "value").mapInArrow(run, TOKENS)


def participants(files: DataFrame) -> DataFrame:
    """meeting_id, agent, name, role of a corpus' list of meetings, by agent; ``error`` where one is
    unnamed or repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("value").to_pylist():
                for m in ElementTree.fromstring(value):
                    if m.get("observation"):
                        rows += [{"meeting_id": m.get("observation"), "agent": s.get("nxt_agent"), "name": s.get("global_name"), "role": s.get("role")} for s in m if s.tag == "speaker"]
            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], pa.string()) for k in ("meeting_id", "agent", "name", "role")})

    found = files.select("value").mapInArrow(run, "meeting_id string, agent string, name string, role string")
    twice = lambda c: F.count("*").over(Window.partitionBy("meeting_id", c)) > 1
    error = F.when(F.col("agent").isNull() | F.col("name").isNull(), "no agent or name").when(twice("agent") | twice("name"), "repeated")
    return found.withColumn("error", error)


def repaired(words: DataFrame) -> DataFrame:
    """``words`` (start, end, duration in seconds; kind) with lo and hi in microseconds, null for what
    takes no speech time, and ``repair``: what was done."""
    start, end, last = F.col("start"), F.greatest("start", "end"), F.col("duration")
    timed = (F.col("kind") == "w") & start.isNotNull() & F.col("end").isNotNull()
    repair = F.filter(
        F.array(
            F.when((F.col("kind") == "w") & ~timed, "untimed"),
            F.when(timed & (F.col("end") < start), "negative"),
            F.when(timed & (start >= last), "after_end"),
            F.when(timed & (start < last) & (end > last), "clipped"),
        ),
        lambda x: x.isNotNull(),
    )
    inside = timed & (start < last)
    micro = lambda x: F.when(inside, F.round(x * 1e6).cast("long"))
    return words.withColumns({"repair": repair, "lo": micro(start), "hi": micro(F.least(end, last))})


def counters(words: DataFrame) -> DataFrame:
    """meeting_id and how often each repair was made."""
    kinds = ("untimed", "negative", "after_end", "clipped")
    return words.groupBy("meeting_id").agg(F.count_if(F.col("kind") == "w").alias("words"), *[F.count_if(F.array_contains("repair", k)).alias(k) for k in kinds])


def clamped(words: DataFrame, keys: tuple[str, ...], order: str = "pos") -> DataFrame:
    """Starts raised to the latest start before them in their turn; ends follow. (A running maximum
    is what raising one after the other gives.)"""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lo = F.max("lo").over(before)
    return words.withColumn("clamped", lo > F.col("lo")).withColumns({"lo": lo, "hi": F.greatest("hi", lo)})


def speaker_turns(words: DataFrame, keep_truncated: bool = True) -> DataFrame:
    """meeting_id, label, lo, hi, text, words: speakers' turns, with the words that lie inside.

    words: meeting_id, label, pos, kind, text, punc, trunc, and lo and hi of ``repaired``. Turns are the
    union of words' times, what touches merged; marks take time but give no text.
    """
    keys = ("meeting_id", "label")
    timed = words.where("lo is not null")
    turns = intervals.union(timed, keys).where("hi > lo")
    # the last turn that starts at or before the word, if the word ends in it
    marks = turns.select(*keys, F.col("lo").alias("at"), F.struct("lo", "hi").alias("turn"))
    rows = timed.withColumn("at", F.col("lo")).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("at", F.col("turn").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("turn", F.last("turn", ignorenulls=True).over(order)).where("pos is not null and turn.hi >= hi")
    spoken = placed.where(~F.col("punc") & (F.col("kind") == "w"))
    spoken = spoken if keep_truncated else spoken.where(~F.col("trunc"))
    said = spoken.withColumn("tokens", corpus_words(F.col("text"))).where("size(tokens) > 0").withColumn("t0", F.col("turn.lo"))
    cut = clamped(said, (*keys, "t0")).select(*keys, "t0", "pos", "lo", "hi", F.size("tokens").alias("k"), F.posexplode("tokens").alias("i", "w"))
    word = F.struct("pos", "i", "w", F.expr("lo + (hi - lo) * i div k").alias("lo"), F.expr("lo + (hi - lo) * (i + 1) div k").alias("hi"))
    texts = cut.groupBy(*keys, F.col("t0").alias("lo")).agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: F.struct(x["w"].alias("w"), x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("words"))
    whole = turns.join(texts, [*keys, "lo"], "left")
    text = F.array_join(F.transform("words", lambda x: x["w"]), " ")
    return whole.select(*keys, "lo", "hi", F.coalesce(text, F.lit("")).alias("text"), "words")


def of_speakers(found: DataFrame, durations: DataFrame) -> DataFrame:
    """Good ``tokens`` with meeting_id and label from their file's name (``meeting.label.words.xml``), and
    the duration of ``durations`` (meeting_id, duration)."""
    part: Column = F.split(F.element_at(F.split("path", "/"), -1), r"\.")
    named = found.where("error is null").withColumns({"meeting_id": part[0], "label": part[1]})
    return named.join(durations, "meeting_id")
