"""Queries of the frame tables, derived from the driver's events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import frame_tables as ft
from parlance.plans.tables import FRAMES_SQL, SEG_SQL, frames, micros, segments, table

STEP, STEPS = 720, 3
SHIFT, WIDTH = 480, 1440
SHARES = {"floor": 0.1, "middle": 0.5, "top": 0.95}


def class_threshold(spark, sf_dir):
    return ft.class_threshold(frames(spark, sf_dir)).select("meeting_id", F.round("threshold", 6).alias("threshold"))


def percentiles(spark, sf_dir):
    return ft.percentiles(frames(spark, sf_dir), SHARES).select("meeting_id", *[F.round(n, 6).alias(n) for n in SHARES])


def loudest_frame(spark, sf_dir):
    """Of each meeting the frame with the highest level in whole numbers, the first of equals."""
    return frames(spark, sf_dir).withColumn("level", F.floor("level")).groupBy("meeting_id").agg(ft.first_largest("level", "frame").alias("frame"), F.max("level").alias("level"))


def moving_windows(spark, sf_dir):
    pitch = F.when(F.col("level") > 20, F.floor(F.col("level") / 4).cast("double"))
    found = ft.moving(frames(spark, sf_dir).withColumn("pitch", pitch), STEP, STEPS, 3, 0.2)
    return found.select("meeting_id", "first", "n", F.round("mean", 6).alias("mean"), "voiced", "median")


def activity(spark, sf_dir):
    """meeting_id, chunk, speaker, at: minutes of the month in chunks of a day, a third of one apart; a chunk
    numbers its speakers anew."""
    kinds = ["view", "click", "purchase", "signup", "error"]
    kind = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")).cast("int")
    minute = F.floor(micros() / 60_000_000) - 28401120
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting_id"), minute.alias("minute"), kind.alias("kind"))
    last = F.floor(F.col("minute") / SHIFT)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.greatest(F.lit(0), last - WIDTH // SHIFT + 1), last)))
    return rows.select("meeting_id", "chunk", ((F.col("kind") + F.col("chunk")) % 3).cast("int").alias("speaker"), (F.col("minute") - F.col("chunk") * SHIFT).alias("at")).distinct()


def chunk_clusters(spark, sf_dir):
    """The cluster of a chunk's speaker; one in eleven has none."""
    pairs = activity(spark, sf_dir).select("meeting_id", "chunk", "speaker").distinct()
    cluster = ((F.col("speaker") * 2 + F.col("chunk") + F.col("meeting_id")) % 4).cast("int")
    return pairs.where("(chunk + speaker * 5) % 11 <> 3").withColumn("cluster", cluster)


def votes(spark, sf_dir):
    return ft.votes(activity(spark, sf_dir), chunk_clusters(spark, sf_dir), SHIFT)


def chunk_map(spark, sf_dir):
    """Frames of a chunk's speakers by cluster, and those without one."""
    of = activity(spark, sf_dir).join(chunk_clusters(spark, sf_dir), ["meeting_id", "chunk", "speaker"], "left")
    return of.groupBy("meeting_id", "chunk", "speaker", "cluster").agg(F.count("*").alias("n"))


def speakers_per_frame(spark, sf_dir):
    rows = activity(spark, sf_dir)
    return ft.speakers_per_frame(rows, rows.select("meeting_id", "chunk"), SHIFT, WIDTH, silent=False).where("k > 0")


def most_voted(spark, sf_dir):
    rows = activity(spark, sf_dir)
    return ft.most_voted(votes(spark, sf_dir), ft.speakers_per_frame(rows, rows.select("meeting_id", "chunk"), SHIFT, WIDTH, silent=False))


def single_turns(spark, sf_dir):
    """Frames with votes as turns of seconds in single precision."""
    chosen = votes(spark, sf_dir).select("meeting_id", "frame", "cluster")
    return ft.single_turns(chosen, 0.016875, 0.0309375, 0.02, 4.1)


def region_pieces(spark, sf_dir):
    return ft.pieces(segments(spark, sf_dir).select("meeting_id", "seg_no", "lo", "hi"), 10_000_000, 4_000_000)


QUERIES = {
    "class_threshold": class_threshold,
    "level_percentiles": percentiles,
    "loudest_frame": loudest_frame,
    "moving_windows": moving_windows,
    "chunk_map": chunk_map,
    "frame_votes": votes,
    "speakers_per_frame": speakers_per_frame,
    "most_voted": most_voted,
    "single_turns": single_turns,
    "region_pieces": region_pieces,
}

_EDGE = lambda i: f"CASE WHEN {i} = bins THEN hi ELSE {i} * ((hi - lo) / bins) + lo END"

_ACTIVITY = f"""rows_ AS (
    SELECT user_id AS meeting_id, epoch_us(ts) // 60000000 - 28401120 AS minute, list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type) AS kind FROM events
), activity AS (
    SELECT DISTINCT meeting_id, chunk, ((coalesce(kind, 0) + chunk) % 3)::INT AS speaker, minute - chunk * {SHIFT} AS pos FROM (
        SELECT *, unnest(range(greatest(0, minute // {SHIFT} - {WIDTH // SHIFT - 1}), minute // {SHIFT} + 1)) AS chunk FROM rows_)
), clusters AS (
    SELECT *, ((speaker * 2 + chunk + meeting_id) % 4)::INT AS cluster FROM (SELECT DISTINCT meeting_id, chunk, speaker FROM activity) WHERE (chunk + speaker * 5) % 11 <> 3
), votes AS (
    SELECT meeting_id, chunk * {SHIFT} + pos AS frame, cluster, count(DISTINCT chunk) AS n FROM activity JOIN clusters USING (meeting_id, chunk, speaker) GROUP BY 1, 2, 3
), spf AS (
    SELECT meeting_id, frame, floor((coalesce(n, 0)::FLOAT / (weight::FLOAT + 1e-12::FLOAT))::FLOAT + 0.5::FLOAT)::INT AS k FROM (
        SELECT meeting_id, frame, count(*) AS weight FROM (SELECT meeting_id, unnest(range(chunk * {SHIFT}, chunk * {SHIFT} + {WIDTH})) AS frame FROM (SELECT DISTINCT meeting_id, chunk FROM activity)) GROUP BY 1, 2)
    LEFT JOIN (SELECT meeting_id, chunk * {SHIFT} + pos AS frame, count(*) AS n FROM activity GROUP BY 1, 2) USING (meeting_id, frame)
)"""

# one cluster of k: without a tie at k's end the larger counts; a heap of one keeps the first of the largest,
# a heap of two or three is walked through place by place for four clusters
_SINK2 = "CASE WHEN c[h[2]] <= c[h[1]] THEN [h[2], h[1]] ELSE h END"
_SINK3 = """CASE WHEN c[h[3]] < c[h[2]] THEN CASE WHEN c[h[3]] <= c[h[1]] THEN [h[3], h[2], h[1]] ELSE h END
                  WHEN c[h[2]] <= c[h[1]] THEN [h[2], h[1], h[3]] ELSE h END"""
_TOP = f"""dense AS (
    SELECT s.meeting_id, s.frame, k, last + 1 AS size, list(coalesce(n, 0) ORDER BY cluster) AS c FROM (
        SELECT s.*, last, unnest(range(0, last + 1)) AS cluster FROM spf s JOIN (SELECT meeting_id, max(cluster) AS last FROM votes GROUP BY 1) USING (meeting_id) WHERE k > 0) s
    LEFT JOIN votes USING (meeting_id, frame, cluster) GROUP BY ALL
), h0 AS (
    SELECT *, range(1, least(k, size) + 1) AS h FROM dense
), h1 AS (
    SELECT * EXCLUDE (h), CASE len(h) WHEN 2 THEN {_SINK2} WHEN 3 THEN {_SINK3} ELSE h END AS h FROM h0
), h2 AS (
    SELECT meeting_id, frame, c, k, size, CASE WHEN k + 1 <= size AND c[k + 1] > c[h[1]] THEN list_concat([k + 1], h[2:]) ELSE h END AS h FROM h1
), h3 AS (
    SELECT * EXCLUDE (h), CASE len(h) WHEN 2 THEN {_SINK2} WHEN 3 THEN {_SINK3} ELSE h END AS h FROM h2
), h4 AS (
    SELECT meeting_id, frame, c, k, size, CASE WHEN k + 2 <= size AND c[k + 2] > c[h[1]] THEN list_concat([k + 2], h[2:]) ELSE h END AS h FROM h3
), h5 AS (
    SELECT * EXCLUDE (h), CASE len(h) WHEN 2 THEN {_SINK2} WHEN 3 THEN {_SINK3} ELSE h END AS h FROM h4
), h6 AS (
    SELECT meeting_id, frame, CASE WHEN k + 3 <= size AND c[k + 3] > c[h[1]] THEN list_concat([k + 3], h[2:]) ELSE h END AS h FROM h5
)"""

ORACLE_SQL = {
    "class_threshold": f"""WITH {FRAMES_SQL}, extent AS (
        SELECT meeting_id, min(level)::DOUBLE AS lo, max(level)::DOUBLE AS hi, greatest(2, ceil((max(level) - min(level)) / 0.5))::BIGINT AS bins FROM frames GROUP BY 1
    ), placed AS (
        SELECT *, least(floor((level - lo) * (bins / (hi - lo)))::BIGINT, bins - 1) AS pos FROM frames JOIN extent USING (meeting_id) WHERE hi - lo >= 1
    ), counts AS (
        SELECT meeting_id, lo, hi, bins, CASE WHEN level < {_EDGE("pos")} THEN pos - 1 WHEN level >= {_EDGE("(pos + 1)")} AND pos < bins - 1 THEN pos + 1 ELSE pos END AS bin, count(*) AS n FROM placed GROUP BY 1, 2, 3, 4, 5
    ), sums AS (
        SELECT *, sum(n) OVER w AS n0, sum(n) OVER a AS total, sum(n * ({_EDGE("bin")} + {_EDGE("(bin + 1)")}) * 0.5) OVER w AS s0, sum(n * ({_EDGE("bin")} + {_EDGE("(bin + 1)")}) * 0.5) OVER a AS s, {_EDGE("(bin + 1)")} AS edge
        FROM counts WINDOW w AS (PARTITION BY meeting_id ORDER BY bin), a AS (PARTITION BY meeting_id)
    ), best AS (
        SELECT meeting_id, arg_min(edge, (-round(n0 * (total - n0) * (s0 / n0 - (s - s0) / greatest(total - n0, 1)) ** 2, 3), bin)) AS edge FROM sums GROUP BY 1
    ) SELECT meeting_id, round(coalesce(edge, hi), 6) AS threshold FROM extent LEFT JOIN best USING (meeting_id)""",
    "level_percentiles": f"WITH {FRAMES_SQL} SELECT meeting_id, {', '.join(f'round(quantile_cont(level, {s}), 6) AS {n}' for n, s in SHARES.items())} FROM frames GROUP BY 1",
    "loudest_frame": f"WITH {FRAMES_SQL} SELECT meeting_id, arg_min(frame, (-floor(level), frame)) AS frame, max(floor(level))::BIGINT AS level FROM frames GROUP BY 1",
    "moving_windows": f"""WITH {FRAMES_SQL}, starts AS (SELECT DISTINCT meeting_id, frame // {STEP} * {STEP} AS first FROM frames
    ), inside AS (
        SELECT meeting_id, first, level, CASE WHEN level > 20 THEN floor(level / 4) END AS pitch FROM starts s JOIN frames f USING (meeting_id) WHERE frame >= first AND frame < first + {STEP * STEPS}
    ), sums AS (SELECT meeting_id, first, count(*) AS n, avg(level) AS mean, count(pitch) AS voiced, quantile_cont(pitch, 0.5) AS m FROM inside GROUP BY 1, 2
    ), lows AS (SELECT meeting_id, first, count(*) AS k, quantile_cont(pitch, 0.5) AS low FROM inside JOIN sums USING (meeting_id, first) WHERE abs(pitch - (m - 12)) <= 3 GROUP BY 1, 2)
    SELECT meeting_id, first, n, round(mean, 6) AS mean, voiced, CASE WHEN voiced >= 3 THEN CASE WHEN k >= voiced * 0.2 THEN low ELSE m END END AS median FROM sums LEFT JOIN lows USING (meeting_id, first)""",
    "chunk_map": f"WITH {_ACTIVITY} SELECT meeting_id, chunk, speaker, cluster, count(*) AS n FROM activity LEFT JOIN clusters USING (meeting_id, chunk, speaker) GROUP BY 1, 2, 3, 4",
    "frame_votes": f"WITH {_ACTIVITY} SELECT * FROM votes",
    "speakers_per_frame": f"WITH {_ACTIVITY} SELECT * FROM spf WHERE k > 0",
    "most_voted": f"WITH {_ACTIVITY}, {_TOP} SELECT meeting_id, frame, (unnest(h) - 1)::INT AS cluster FROM h6",
    "single_turns": f"""WITH {_ACTIVITY}, islands AS (
        SELECT meeting_id, cluster, frame, frame - row_number() OVER (PARTITION BY meeting_id, cluster ORDER BY frame) AS i FROM votes
    ), ends AS (SELECT meeting_id, max(frame) AS last FROM votes GROUP BY 1
    ), runs AS (
        SELECT meeting_id, cluster, min(frame) AS a, (min(frame) * 0.016875::FLOAT::DOUBLE + 0.0309375::FLOAT::DOUBLE)::FLOAT AS start,
               (least(max(frame) + 1, any_value(last)) * 0.016875::FLOAT::DOUBLE + 0.0309375::FLOAT::DOUBLE)::FLOAT AS stop FROM islands JOIN ends USING (meeting_id) GROUP BY meeting_id, cluster, i
    ), marked AS (
        SELECT *, CASE WHEN lag(stop) OVER w < start AND lag(stop) OVER w + 4.1::FLOAT >= start THEN 0 ELSE 1 END AS new FROM runs WINDOW w AS (PARTITION BY meeting_id, cluster ORDER BY a)
    ), turns AS (SELECT *, sum(new) OVER (PARTITION BY meeting_id, cluster ORDER BY a) AS t FROM marked)
    SELECT meeting_id, cluster, min(start) AS start, max(stop) AS stop FROM turns GROUP BY meeting_id, cluster, t HAVING max(stop) - min(start) > 0.02::FLOAT""",
    "region_pieces": f"""WITH {SEG_SQL}, cut AS (
        SELECT meeting_id, seg_no, lo, hi, unnest(range(lo, hi, 10000000)) AS a FROM seg
    ), kept AS (SELECT * FROM cut WHERE a = lo OR hi - a >= 4000000)
    SELECT meeting_id, seg_no, a AS lo, coalesce(lead(a) OVER (PARTITION BY meeting_id, seg_no ORDER BY a), hi) AS hi FROM kept""",
}
