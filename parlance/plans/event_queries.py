"""Queries of event-time operators, line formats and roll-ups over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import alignment, catalog
from parlance.plans import evaluation
from parlance.plans import queries as annotations
from parlance.plans.tables import SEG_SQL, SLOT, dialogue, micros, segments, spoken, table
from parlance.sources import lines
from parlance.streaming import timers

SILENCE = 43_200_000_000
STALL = 86_400_000_000


def request_sessions(spark, sf_dir):
    """Sessions of a user's events that close after six hours."""
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    log = table(spark, sf_dir, "events").select("user_id", "ts", status.alias("status"))
    found = timers.log_sessions(log, "user_id", "6 hours")
    return found.select("user_id", micros("first").alias("first"), micros("last").alias("last"), "n", "failed")


def accepted_in_time(spark, sf_dir):
    """Numbers of a user's events that exceed all before, which are forgotten after half a day."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), "ts", (F.col("event_id") * 7919 % 1000).alias("seq"), F.col("event_id").alias("ordinal"))
    return timers.accepted_in_time(rows, SILENCE)


def stalled_transfers(spark, sf_dir):
    """A user's events as frames of eight bytes in order; a day without one is a stall."""
    events = table(spark, sf_dir, "events")
    rows = catalog.ordinals(events, ("user_id",), ("ts", "event_id"))
    frames = rows.select(F.col("user_id").cast("string").alias("stream"), "ts", ((F.col("ordinal") - 1) * 8).cast("long").alias("offset"), F.lpad(F.col("event_id").cast("string"), 8, "0").cast("binary").alias("payload"), F.lit(None).cast("long").alias("code"), F.col("event_id").alias("ordinal"))
    return timers.transfers(frames, STALL).select("stream", "what", F.col("at").alias("place"), F.decode("payload", "utf-8").alias("payload"), "why")


def nearest_centroid(spark, sf_dir):
    """The nearest of six vectors for each vector."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    centres = rows.where("vec_id < 6").select(F.col("vec_id").alias("label"), F.col("v").alias("c"))
    return catalog.nearest(rows.withColumnRenamed("vec_id", "id"), centres).select("id", "label", F.round("distance", 6).alias("distance"))


def rttm_lenient(spark, sf_dir):
    """Segments as lines of nine fields on another channel, with comments, and read from them."""
    line = F.format_string("SPEAKER %s 2 %s %s <NA> <NA> %s <NA> # seen", F.col("meeting_id").cast("string"), (F.col("lo") / 1e6).cast("decimal(20,6)").cast("string"), ((F.col("hi") - F.col("lo")) / 1e6).cast("decimal(20,6)").cast("string"), "label")
    text = F.when(F.col("seg_no") % 10 == 0, F.concat(F.lit("# "), line)).when(F.col("seg_no") % 10 == 1, "SPEAKER x").otherwise(line)
    found = lines.rttm_lenient(segments(spark, sf_dir).select(F.lit("").alias("path"), F.col("seg_no").alias("line_no"), text.alias("line")))
    return found.select(F.col("line_no").alias("seg_no"), F.when(F.col("error").isNull(), F.col("meeting_id")).cast("long").alias("meeting_id"), "label", "lo", "hi", F.col("error").isNull().alias("good"))


def stm_nist(spark, sf_dir):
    """Turns as lines with a tag on any channel, and read from them."""
    rows = dialogue(spark, sf_dir).where("side = 'R'")
    seconds = lambda c: (F.col(c) / 1e6).cast("decimal(20,3)").cast("string")
    line = F.concat_ws(" ", F.col("meeting_id").cast("string"), F.lit("B"), "label", seconds("lo"), seconds("hi"), F.when(F.col("seg_no") % 2 == 0, F.lit("<o,f0,unknown>")), "text")
    found = lines.stm(rows.select(F.lit("").alias("path"), F.lit(1).alias("line_no"), line.alias("line")), nist=True)
    return found.where("error is null").select(F.col("meeting_id").cast("long"), "label", "lo", "hi", "tag", F.regexp_replace("text", r"\s+", " ").alias("text"))


def view_agreement(spark, sf_dir):
    """Places at which views of the references' segments differ: one with some other labels, one with later ends."""
    rows = segments(spark, sf_dir).where("side = 'R'").select("meeting_id", "label", "lo", "hi", "seg_no")
    other = rows.withColumn("label", F.when(F.col("seg_no") % 14 == 0, "none").otherwise(F.col("label")))
    later = rows.withColumn("hi", F.col("hi") + F.when(F.col("seg_no") % 10 == 0, 2).otherwise(1))
    return lines.agreement({"json": rows, "rttm": other, "stm": later}).select("meeting_id", "view", F.col("pos").alias("place"))


def rate_summary(spark, sf_dir):
    """Error rates by dataset, system and variant, by the sets of keys, and over all."""
    der = annotations.der_two_label(spark, sf_dir)
    keys = {"dataset": F.concat(F.lit("d"), F.col("meeting_id") % 3), "system": F.concat(F.lit("s"), F.col("meeting_id") % 2), "variant": F.when(F.col("meeting_id") % 5 > 1, F.concat(F.lit("v"), F.col("meeting_id") % 5))}
    known = {"der.der": F.col("der"), "der.miss": F.col("miss"), "der.false_alarm": F.col("fa"), "der.confusion": F.col("conf"), "der.total": F.col("total")}
    names = {c for a, b in evaluation.SUMS.values() for c in (*a, b)} | set(evaluation.SUMS)
    scores = der.select(*[v.alias(k) for k, v in keys.items()], *[known.get(n, F.lit(None)).cast("double").alias(n) for n in sorted(names)])
    found = evaluation.summary(scores).where("metric = 'der.der'")
    return found.select("dataset", "system", "variant", "level", F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"), "meetings")


def whole_segments(spark, sf_dir):
    """Every third turn of the conversations has no words and takes a label as a whole."""
    words, turns = spoken(spark, sf_dir)
    rows = dialogue(spark, sf_dir).where("side = 'R'").select("meeting_id", "seg_no", "lo", "hi", "text")
    return alignment.assign_whole(rows, words.where("seg_no % 3 <> 0"), turns, "latest_start").select("meeting_id", "seg_no", "label", "how")


QUERIES = {f.__name__: f for f in (whole_segments, request_sessions, accepted_in_time, stalled_transfers, nearest_centroid, rttm_lenient, stm_nist, view_agreement, rate_summary)}

_PLACED = lambda name, label, hi: f"{name} AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY lo, {hi}, {label}) AS place, {label} AS label, lo, {hi} AS hi FROM ref)"

_WHOLE = annotations._assigned_sql("arg_max(label, last)").replace(
    "WITH ", f"WITH whole AS (SELECT conv_id AS meeting_id, turn::BIGINT AS seg_no, 0 AS word_no, text AS word, turn::BIGINT * {SLOT} AS lo, turn::BIGINT * {SLOT} + 8000000 AS hi FROM conversations WHERE turn % 3 = 0 AND trim(text) <> ''), ", 1
).replace("FROM words w", "FROM whole w").replace("JOIN words USING", "JOIN whole USING")

ORACLE_SQL = {
    "whole_segments": f"{_WHOLE} SELECT meeting_id, seg_no, label, how FROM found",
    "request_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_type FROM events
    ), m AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)
    ), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM m)
    SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM s GROUP BY user_id, s""",
    "accepted_in_time": f"""WITH e AS (SELECT user_id AS stream, epoch_us(ts) AS t, event_id, event_id * 7919 % 1000 AS seq FROM events
    ), m AS (SELECT *, CASE WHEN t - lag(t) OVER w < {SILENCE} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY stream ORDER BY t, event_id)
    ), s AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM m
    ), b AS (SELECT *, max(seq) OVER (PARTITION BY stream, s ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
    SELECT stream, seq FROM b WHERE seq > coalesce(before, -1)""",
    "stalled_transfers": f"""WITH e AS (
        SELECT user_id::VARCHAR AS stream, event_id, epoch_us(ts) AS t, row_number() OVER w AS n, lead(epoch_us(ts)) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT stream, 'data' AS what, (n - 1) * 8 AS place, lpad(event_id::VARCHAR, 8, '0') AS payload, NULL::VARCHAR AS why FROM e
    UNION ALL SELECT stream, 'restart', n * 8, NULL, 'stall' FROM e WHERE next IS NULL OR next - t >= {STALL}""",
    "nearest_centroid": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
    ), d AS (SELECT a.vec_id AS id, c.vec_id AS label, list_distance(a.v, c.v) AS d FROM v a, v c WHERE c.vec_id < 6)
    SELECT id, arg_min(label, (d, label)) AS label, round(min(d), 6) AS distance FROM d GROUP BY 1""",
    "rttm_lenient": f"""WITH {SEG_SQL} SELECT seg_no, CASE WHEN seg_no % 10 <> 1 THEN meeting_id END AS meeting_id, CASE WHEN seg_no % 10 <> 1 THEN label END AS label,
        CASE WHEN seg_no % 10 <> 1 THEN lo END AS lo, CASE WHEN seg_no % 10 <> 1 THEN hi END AS hi, seg_no % 10 <> 1 AS good FROM seg WHERE seg_no % 10 <> 0""",
    "stm_nist": r"""SELECT conv_id AS meeting_id, role AS label, turn::BIGINT * 10000000 AS lo, turn::BIGINT * 10000000 + 8000000 AS hi,
        CASE WHEN turn % 2 = 0 THEN '<o,f0,unknown>' END AS tag, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations""",
    "view_agreement": f"""WITH {SEG_SQL}, ref AS (SELECT *, CASE WHEN seg_no % 14 = 0 THEN 'none' ELSE label END AS other, hi + CASE WHEN seg_no % 10 = 0 THEN 2 ELSE 1 END AS later FROM seg WHERE side = 'R'
    ), {_PLACED("a", "label", "hi")}, {_PLACED("b", "other", "hi")}, {_PLACED("c", "label", "later")}
    SELECT meeting_id, 'rttm' AS view, place::INT AS place FROM a JOIN b USING (meeting_id, place) WHERE a.label <> b.label OR abs(a.lo - b.lo) > 1 OR abs(a.hi - b.hi) > 1
    UNION ALL SELECT meeting_id, 'stm', place::INT FROM a JOIN c USING (meeting_id, place) WHERE a.label <> c.label OR abs(a.lo - c.lo) > 1 OR abs(a.hi - c.hi) > 1""",
    "rate_summary": f"""{annotations._der_sql()}, r AS (
        SELECT 'd' || meeting_id % 3 AS dataset, 's' || meeting_id % 2 AS system, CASE WHEN meeting_id % 5 > 1 THEN 'v' || meeting_id % 5 END AS variant, der, miss + fa + conf AS e, total FROM der)
    SELECT dataset, system, variant, (grouping(dataset) + grouping(system) + grouping(variant))::INT AS level, round(avg(der), 6) AS macro,
        round(sum(e) FILTER (der IS NOT NULL)::DOUBLE / nullif(sum(total) FILTER (der IS NOT NULL), 0), 6) AS micro, count(der) AS meetings
    FROM r GROUP BY GROUPING SETS ((dataset, system, variant), (dataset, system), (system), ())""",
}
