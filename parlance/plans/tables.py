"""Annotation tables derived from the driver's tables; times are whole microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str = "ts"):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, side (R or H), label, lo, hi, seg_no; from events, folded into one hour."""
    length = F.round(F.col("value") * 1e6).cast("long")
    lo = micros() % HOUR
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("meeting_id"),
            F.when(F.col("event_id") % 2 == 0, "R").otherwise("H").alias("side"),
            F.col("event_type").alias("label"),
            lo.alias("lo"),
            (lo + length).alias("hi"),
            F.col("event_id").alias("seg_no"),
        )
        .where("hi > lo")
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, speaker, seg_no, text; from conversations."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("role").alias("speaker"), F.col("turn").alias("seg_no"), "text")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, frame (minute of the month), energy_db: the loudest event of each minute."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("meeting_id"), (F.floor(micros() / 60_000_000) - 28401120).alias("frame"))
        .agg(F.max(F.col("value")).alias("level"))
    )


SEG_SQL = """seg AS (
    SELECT user_id AS meeting_id, CASE WHEN event_id % 2 = 0 THEN 'R' ELSE 'H' END AS side, event_type AS label,
           epoch_us(ts) % 3600000000 AS lo, epoch_us(ts) % 3600000000 + CAST(round(value * 1e6) AS BIGINT) AS hi, event_id AS seg_no
    FROM events WHERE CAST(round(value * 1e6) AS BIGINT) > 0
)"""

FRAMES_SQL = """frames AS (
    SELECT user_id AS meeting_id, epoch_us(ts) // 60000000 - 28401120 AS frame, max(value) AS level FROM events GROUP BY 1, 2
)"""


SLOT = 10_000_000


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, side, label, lo, hi, seg_no, text; a turn every ten seconds. Side H lacks some words
    and has the names of two roles exchanged."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("role").alias("label"), F.col("turn").cast("long").alias("seg_no"), "text")
    timed = turns.withColumns({"lo": F.col("seg_no") * SLOT, "hi": F.col("seg_no") * SLOT + 8_000_000})
    kept = F.filter(F.split("text", r"\s+"), lambda w, i: (i + F.col("seg_no")) % 5 != 3)
    other = F.when(F.col("label") == "user", "assistant").when(F.col("label") == "assistant", "user").otherwise(F.col("label"))
    ref = timed.select("meeting_id", F.lit("R").alias("side"), "label", "lo", "hi", "seg_no", "text")
    return ref.unionByName(timed.select("meeting_id", F.lit("H").alias("side"), other.alias("label"), "lo", "hi", "seg_no", F.array_join(kept, " ").alias("text")))


def spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words (meeting_id, seg_no, word_no, word, lo, hi) of the conversations, 0.4 s apart, and speakers'
    turns (meeting_id, label, lo, hi) that begin late and overlap the next."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("role").alias("label"), F.col("turn").cast("long").alias("seg_no"), "text")
    words = turns.select("meeting_id", "seg_no", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_no", "word"))
    lo = F.col("seg_no") * SLOT + F.col("word_no") * 400_000
    words = words.withColumns({"lo": lo, "hi": lo + 350_000})
    t0 = F.col("seg_no") * SLOT + 1_500_000
    return words, turns.select("meeting_id", "label", t0.alias("lo"), (t0 + 9_000_000 + F.col("seg_no") * 100_000).alias("hi"))


SPOKEN_SQL = f"""cut AS (
    SELECT conv_id AS meeting_id, role AS label, turn::BIGINT AS seg_no, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS l FROM conversations
), words AS (
    SELECT meeting_id, seg_no, (i - 1)::INT AS word_no, w AS word, seg_no * {SLOT} + (i - 1) * 400000 AS lo, seg_no * {SLOT} + (i - 1) * 400000 + 350000 AS hi
    FROM (SELECT meeting_id, seg_no, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM cut)
), turns AS (
    SELECT meeting_id, label, seg_no * {SLOT} + 1500000 AS t0, seg_no * {SLOT} + 10500000 + seg_no * 100000 AS t1 FROM cut
)"""
