"""Small values: tolerant JSON getters, parameters with defaults, names, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_int(doc: Column, path: str, default: int) -> Column:
    """A whole number; numbers and numeric texts are cut to one, anything else is the default."""
    value = F.get_json_object(doc, path)
    number = F.when(value.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), value.cast("double"))
    whole = F.coalesce(value.try_cast("long"), F.when(F.abs(number) < 9e18, number.cast("long")))
    return F.coalesce(whole, F.lit(default))


def json_text(doc: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(doc, path), F.lit(default))


def _filled(doc: Column, path: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.get_json_object(doc, path), F.lit("")), F.lit(default))


def transcription_options(doc: Column) -> Column:
    """A request's parameters with their defaults."""
    flag = lambda path: F.coalesce(F.get_json_object(doc, path) == "true", F.lit(False))
    return F.struct(
        _filled(doc, "$.transcribe.language", "auto").alias("language"),
        _filled(doc, "$.transcribe.model", "plaud-fast-whisper").alias("model"),
        _filled(doc, "$.transcribe.detection_level", "segment").alias("detection_level"),
        flag("$.vad.decode_silence").alias("decode_silence"),
        flag("$.diarization.enabled").alias("diarization"),
        flag("$.diarization.return_embedding").alias("return_embedding"),
    )


def languages(language: Column) -> Column:
    """The language of a whole and of its parts: "auto" is English."""
    auto = language == "auto"
    return F.struct(F.when(auto, "en").otherwise(F.split(language, "-")[0]).alias("whole"), F.when(auto, "en-US").otherwise(language).alias("part"))


def file_name(session: Column) -> Column:
    """A recording's name: its number is a time in seconds, but for small ones. In the session's time zone."""
    time = F.date_format(F.timestamp_seconds(session), "y-MM-dd_HH-mm-ss")  # "yyyy" puts a sign before years of five digits
    return F.when(session < 100, F.concat(F.lit("log"), session.cast("string"))).otherwise(F.concat(time, F.lit(".opus")))


def token_payload(token: Column) -> Column:
    """The middle part of a signed token, as JSON text; null if it isn't three parts of base64url."""
    part = F.split(token, r"\.")
    fits = token.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$")
    body = F.translate(part[1], "-_", "+/")
    return F.when(fits, F.try_to_binary(F.rpad(body, F.ceil(F.length(body) / 4).cast("int") * 4, "="), F.lit("base64")).cast("string"))


def serial(text: Column) -> Column:
    """What may stand in a serial number: hyphen, digits, capitals, U+005F to U+2E80, U+9FFF."""
    return F.regexp_replace(text, "[^\\-0-9A-Z\u005f-\u2e80\u9fff]", "")


def decibel(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(1e-12)))
