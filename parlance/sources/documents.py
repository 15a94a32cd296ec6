"""Meetings and hypotheses as JSON documents: scans with the errors of each document, and writers.

A document is a row. Its rules are checked with column functions, and all that is broken is in
``errors``; ``good`` keeps the documents without any. Times are seconds in the documents and
whole microseconds in ``segments``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.text import split_words

WORD = "struct<w:string,start:double,end:double>"
SEGMENT = f"struct<speaker:string,start:double,end:double,text:string,words:array<{WORD}>>"
MEETING = f"schema string, meeting_id string, sample_rate long, duration_s double, channels long, speakers array<struct<id:string>>, segments array<{SEGMENT}>, audio string, generator string"
HYPOTHESIS = f"schema string, meeting_id string, system string, segments array<{SEGMENT}>, extra string"
#: How far times may lie outside what holds them, in seconds.
TOLERANCE = 1e-6


def read(spark: SparkSession, path: str, kind: str = "*.json") -> DataFrame:
    """path, value of whole files of a kind (a pattern of names) below a folder, or of one file."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", kind)
    return files.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def field_problem(value: Column) -> Column:
    """Why a text can't be one field of a line; null if it can."""
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "is empty")
        .when(value.rlike(r"(?U)\s"), "contains white space")
        .when(value.startswith(";;"), "starts with a comment's mark")
        .when(value == "<NA>", "is the mark of an absent field")
    )


def _broken(ok: Column, message: str | Column) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(message) if isinstance(message, str) else message)


def _first(*found: Column) -> Column:
    return F.coalesce(*found, F.lit(None).cast("string"))


def _number(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _word_errors(s: Column) -> Column:
    def one(w: Column, j: Column) -> Column:
        bare = F.trim(w["w"])
        before = F.get(s["words"], j - 1)["start"]
        return F.concat(
            F.lit("words["),
            j.cast("string"),
            F.lit("]: "),
            _first(
                _broken(bare != "", "no text"),
                _broken(~F.contains(bare, F.lit(" ")), "more than one token"),
                _broken(_number(w["start"]) & _number(w["end"]), "times aren't finite numbers"),
                _broken(w["end"] >= w["start"], "ends before its start"),
                _broken((w["start"] >= s["start"] - TOLERANCE) & (w["end"] <= s["end"] + TOLERANCE), "outside its segment"),
                _broken((j == 0) | (w["start"] >= before - TOLERANCE), "not sorted by start"),
            ),
        )

    words = F.coalesce(s["words"], F.array().cast(f"array<{WORD}>"))
    spelled = s["words"].isNull() | (F.transform(words, lambda w: w["w"]) == split_words(s["text"]))
    bad = F.filter(F.transform(words, one), lambda e: e.isNotNull())
    return F.coalesce(F.get(bad, F.lit(0)), _broken(spelled, "words don't spell the text"))


def _segment_errors(segments: Column, speakers: Column | None, duration: Column | None, ordered: bool) -> Column:
    def one(s: Column, i: Column) -> Column:
        rules = [
            _broken(F.trim(s["speaker"]) != "", "no speaker"),
            *([_broken(F.array_contains(speakers, s["speaker"]), "speaker isn't declared")] if speakers is not None else []),
            _broken(_number(s["start"]) & _number(s["end"]), "times aren't finite numbers"),
            _broken(s["start"] >= 0, "start is negative"),
            _broken(s["end"] > s["start"], "end isn't after the start"),
            *([_broken(s["end"] <= duration + TOLERANCE, "ends after the meeting")] if duration is not None else []),
            _broken(s["text"].isNotNull(), "no text"),
            _word_errors(s),
            *([_broken((i == 0) | (s["start"] >= F.get(segments, i - 1)["start"]), "not sorted by start")] if ordered else []),
        ]
        return F.concat(F.lit("segments["), i.cast("string"), F.lit("]: "), _first(*rules))

    return F.filter(F.transform(segments, one), lambda e: e.isNotNull())


#: What a field is, in the names of variant types, if it isn't as asked for.
TEXTS, LISTS = r"(?<![\w`])(speaker|text|w)`?: (?!STRING\b|VOID\b)(\w+)", r"(?<![\w`])(words)`?: (?!ARRAY\b|VOID\b)(\w+)"


def _types(value: Column) -> list[Column]:
    """Errors of fields of another type than they should have, which a parser with a schema would cast. The
    types of all segments' fields are merged, so that one that isn't text shows."""
    tree = F.try_parse_json(value)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(tree, path, "variant"))
    segments = kind("$.segments")
    wrong = lambda pattern, what: F.when(F.regexp_extract(segments, pattern, 1) != "", F.concat(F.lit("segments: "), F.regexp_extract(segments, pattern, 1), F.lit(f" isn't {what}")))
    text = lambda name: F.when(~F.coalesce(kind(f"$.{name}"), F.lit("STRING")).isin("STRING", "VOID"), F.lit(f"{name} isn't text"))
    return [F.when(tree.isNull(), F.lit("isn't JSON")), text("meeting_id"), text("system"), wrong(TEXTS, "text"), wrong(LISTS, "a list")]


def _checked(docs: DataFrame, kind: str, schema: str, rules, segment_errors) -> DataFrame:
    parsed = docs.withColumn("d", F.from_json("value", kind)).select("path", "value", "d.*")
    all_rules = F.array(_broken(F.col("schema") == schema, F.lit(f"schema isn't {schema}")), *_types(F.col("value")), *rules(F.col))
    errors = F.filter(all_rules, lambda e: e.isNotNull())
    more = F.when(F.col("segments").isNotNull(), segment_errors(F.col)).otherwise(F.array(F.lit("no segments")))
    return parsed.withColumn("errors", F.concat(errors, more)).drop("value")


def meetings(docs: DataFrame, schema: str) -> DataFrame:
    """path, the document's fields, errors of meetings (path, value); ``schema``: its expected name."""

    def rules(c) -> list[Column]:
        ids = F.transform(c("speakers"), lambda s: s["id"])
        problem = F.get(F.filter(F.transform(ids, field_problem), lambda p: p.isNotNull()), F.lit(0))
        return [
            F.concat(F.lit("meeting_id "), field_problem(c("meeting_id"))),
            _broken(c("sample_rate") > 0, "sample_rate isn't a positive whole number"),
            _broken(_number(c("duration_s")) & (c("duration_s") > 0), "duration_s isn't a positive finite number"),
            _broken(c("channels") >= 1, "channels isn't 1 or more"),
            _broken(F.size(ids) > 0, "no speakers"),
            F.concat(F.lit("a speaker's id "), problem),
            _broken(F.size(F.array_distinct(ids)) == F.size(ids), "a speaker's id is repeated"),
            _broken(F.substring(c("audio"), 1, 1) == "{", "audio isn't an object"),
            _broken(F.substring(c("generator"), 1, 1) == "{", "generator isn't an object"),
        ]

    return _checked(docs, MEETING, schema, rules, lambda c: _segment_errors(c("segments"), F.transform(c("speakers"), lambda s: s["id"]), c("duration_s"), True))


def hypotheses(docs: DataFrame, schema: str) -> DataFrame:
    """As ``meetings``; segments may be in any order, and labels may be any text that isn't blank."""
    rules = lambda c: [F.concat(F.lit("meeting_id "), field_problem(c("meeting_id"))), _broken(F.trim(c("system")) != "", "no system")]
    return _checked(docs, HYPOTHESIS, schema, rules, lambda c: _segment_errors(c("segments"), None, None, False))


def good(docs: DataFrame) -> DataFrame:
    return docs.where("size(errors) = 0")


def segments(docs: DataFrame, side: str) -> DataFrame:
    """meeting_id, side, label, lo, hi, seg_no, text, words of documents' segments."""
    each = docs.select("meeting_id", F.posexplode("segments").alias("seg_no", "s"))
    micro = lambda x: F.round(x * 1e6).cast("long")
    return each.select("meeting_id", F.lit(side).alias("side"), F.col("s.speaker").alias("label"), micro(F.col("s.start")).alias("lo"), micro(F.col("s.end")).alias("hi"), F.col("seg_no").cast("long").alias("seg_no"), "s.text", "s.words")


def active_speakers(docs: DataFrame) -> DataFrame:
    """meeting_id, pos, label: declared speakers with a segment, in the order of declaration."""
    said = docs.select("meeting_id", F.explode(F.array_distinct(F.transform("segments", lambda s: s["speaker"]))).alias("label"))
    declared = docs.select("meeting_id", F.posexplode(F.transform("speakers", lambda s: s["id"])).alias("pos", "label"))
    return declared.join(said, ["meeting_id", "label"], "left_semi").select("meeting_id", "pos", "label")


def hypothesis_documents(rows: DataFrame, schema: str, system: str) -> DataFrame:
    """meeting_id, value: a JSON document for each meeting's segments (label, lo, hi, text), by time."""
    seconds = lambda x: F.round(x / 1e6, 6)
    item = F.struct("lo", "hi", "label", F.coalesce("text", F.lit("")).alias("text"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["label"].alias("speaker"), seconds(s["lo"]).alias("start"), seconds(s["hi"]).alias("end"), s["text"].alias("text")))
    body = F.struct(F.lit(schema).alias("schema"), F.col("meeting_id").cast("string").alias("meeting_id"), F.lit(system).alias("system"), F.col("segments"))
    return rows.groupBy("meeting_id").agg(listed.alias("segments")).select("meeting_id", F.to_json(body).alias("value"))


def results_as_segments(results: DataFrame, default: str = "spk") -> DataFrame:
    """meeting_id, label, lo, hi, text of cloud results (meeting_id, value)."""
    kind = "results array<struct<speaker_id:string,start:double,end:double,text:string>>"
    each = results.select("meeting_id", F.inline(F.from_json("value", kind)["results"]))
    text = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+", " "))
    micro = lambda x: F.round(F.col(x) * 1e6).cast("long")
    return each.select("meeting_id", F.coalesce("speaker_id", F.lit(default)).alias("label"), micro("start").alias("lo"), micro("end").alias("hi"), text.alias("text"))


def hypothesis_paths(meetings: DataFrame, files: DataFrame) -> DataFrame:
    """meeting_id, hypothesis: the first there is of a meeting's five places, else null.

    meetings: meeting_id, folder (relative to the references); files: path (relative to the hypotheses).
    """
    name = F.element_at(F.split("folder", "/"), -1)
    places = F.array(
        F.concat("folder", F.lit("/hyp.json")), F.concat(name, F.lit("/hyp.json")), F.concat("meeting_id", F.lit("/hyp.json")), F.concat("meeting_id", F.lit(".hyp.json")), F.concat("meeting_id", F.lit(".json"))
    )
    asked = meetings.select("meeting_id", F.posexplode(places).alias("rank", "path"))
    found = asked.join(files.select("path").distinct(), "path").groupBy("meeting_id").agg(F.min_by("path", "rank").alias("hypothesis"))
    return meetings.select("meeting_id").join(found, "meeting_id", "left")


def below(path: Column, top: str) -> Column:
    """What of a file's path lies below the folder ``top``."""
    bare = F.regexp_replace(path, "^file:/+", "/")
    return F.regexp_replace(bare, F.lit("^" + re.escape(re.sub("^file:/+", "/", top).rstrip("/")) + "/"), F.lit(""))


def checksums(lines: DataFrame) -> DataFrame:
    """digest, name of lines ``hex  name`` or ``hex *name``."""
    part = lambda i: F.regexp_extract("line", r"^([0-9a-fA-F]{32,128})\s[\s*](.+?)\s*$", i)
    return lines.select(F.lower(part(1)).alias("digest"), part(2).alias("name")).where("digest <> ''")


def audio_meetings(audio: DataFrame, files: DataFrame, name: str = "meeting.json") -> DataFrame:
    """``audio`` (path) with the document beside it, or one or two folders up, as ``meeting``; else null."""
    parts = F.split("path", "/")
    up = lambda k: F.concat_ws("/", F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - k)), F.lit(name))
    asked = audio.select("path", F.posexplode(F.array(*[up(k) for k in (1, 2, 3)])).alias("rank", "meeting"))
    found = asked.join(files.select(F.col("path").alias("meeting")).distinct(), "meeting").groupBy("path").agg(F.min_by("meeting", "rank").alias("meeting"))
    return audio.join(found, "path", "left")


def audio_path(audio: Column, key: str) -> Column:
    """The path of a meeting's audio (JSON text) for a key: mix, device, device.<name>, stem:<speaker>, or a
    path itself; null if there is none or it leaves the meeting's folder."""
    get = lambda p: F.get_json_object(audio, p)
    devices = F.from_json(get("$.device"), "map<string,string>")
    if key == "mix":
        found = get("$.mix_wav")
    elif key == "device":
        primary = get("$.device_primary")
        found = F.when(primary.isNotNull(), F.try_element_at(devices, primary)).otherwise(F.coalesce(F.try_element_at(devices, F.lit("ogg_opus")), F.get(F.map_values(devices), F.lit(0))))
    elif key.startswith("device."):
        found = F.try_element_at(devices, F.lit(key.split(".", 1)[1]))
    elif key.startswith("stem:"):
        found = F.try_element_at(F.from_json(get("$.stems"), "map<string,string>"), F.lit(key.split(":", 1)[1]))
    else:
        return F.lit(key)
    return F.when(~found.startswith("/") & ~found.rlike(r"(^|/)\.\.(/|$)"), found)


def raw_turns(docs: DataFrame) -> DataFrame:
    """meeting_id, label, lo, hi of the turns that hypotheses keep beside their segments."""
    turns = F.from_json(F.get_json_object("extra", "$.diarization.turns"), "array<array<string>>")
    each = docs.select("meeting_id", F.explode(turns).alias("t"))
    micro = lambda i: F.round(F.col("t")[i].cast("double") * 1e6).cast("long")
    return each.select("meeting_id", F.col("t")[2].alias("label"), micro(0).alias("lo"), micro(1).alias("hi"))
