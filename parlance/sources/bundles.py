"""Bundles: a meeting's document and its RTTM and STM lines, written together and read by kind.

A bundle is the folder data/meeting_id=.../kind=... of text; beside them ``manifest`` has for each
meeting and kind the number of lines and their sha256, so that what is read can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources import lines

KINDS = ("json", "rttm", "stm")


def rows_of(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """meeting_id, kind, lo, hi, field, line of documents (meeting_id, value) and segments."""
    made = {"rttm": lines.rttm_lines(segments), "stm": lines.stm_lines(segments)}
    out = documents.select("meeting_id", F.lit("json").alias("kind"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit("").alias("field"), F.regexp_replace("value", r"[\r\n]+", " ").alias("line"))
    for kind, df in made.items():
        out = out.unionByName(df.select("meeting_id", F.lit(kind).alias("kind"), "lo", "hi", "field", "line"))
    return out


def manifest_of(rows: DataFrame) -> DataFrame:
    """meeting_id, kind, lines, sha256."""
    found = rows.groupBy("meeting_id", "kind").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("lo", "hi", "field", "line"))).alias("x"))
    return found.select("meeting_id", "kind", "lines", F.sha2(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), 256).alias("sha256"))


def write(documents: DataFrame, segments: DataFrame, path: str) -> None:
    rows = rows_of(documents, segments)
    order = ("meeting_id", "kind", "lo", "hi", "field", "line")
    placed = rows.repartition("meeting_id").sortWithinPartitions(*order)
    placed.select("meeting_id", "kind", F.col("line").alias("value")).write.partitionBy("meeting_id", "kind").text(f"{path}/data")
    manifest_of(rows).write.json(f"{path}/manifest")


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path, value: the files of a kind, each whole; other kinds aren't opened."""
    files = spark.read.schema("value string, meeting_id string, kind string").option("basePath", f"{path}/data").text(f"{path}/data", wholetext=True)
    return files.where(F.col("kind") == kind).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\n$", "").alias("value"))


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, "json")


def lines_of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path, line_no, line of the RTTM or STM files."""
    return lines.lines_of(read(spark, path, kind))


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """meeting_id, kind, what: files that are absent, not listed, or differ from the manifest."""
    files = spark.read.schema("value string, meeting_id string, kind string").option("basePath", f"{path}/data").text(f"{path}/data", wholetext=True)
    there = files.select("meeting_id", "kind", F.sha2(F.regexp_replace("value", r"\n$", ""), 256).alias("found"))
    listed = spark.read.schema("meeting_id string, kind string, lines long, sha256 string").json(f"{path}/manifest")
    both = listed.join(there, ["meeting_id", "kind"], "full_outer")
    what = F.when(F.col("found").isNull(), "absent").when(F.col("sha256").isNull(), "not listed").when(F.col("found") != F.col("sha256"), "differs")
    return both.select("meeting_id", "kind", what.alias("what")).where("what is not null")
