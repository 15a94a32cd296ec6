"""Queries of the small table operators, frames and keyed state over the driver's tables, and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import frames, values
from parlance.operators import catalog, intervals, kmeans, text
from parlance.plans import evaluation
from parlance.plans.tables import dialogue, segments, spoken, table
from parlance.sources import annotated
from parlance.streaming import state

GRID = [0.25, 0.5, 1.0, 2.0, 4.0]
PATTERNS = {"metal": "steel|copper|brass", "colour": "red|green|blue", "size": "(?i)large|small"}
FALLBACK = ["zero", "one", "the"]


def text_concat(spark, sf_dir):
    return catalog.joined_text(dialogue(spark, sf_dir).where("side = 'R'"))


def speaker_relabel(spark, sf_dir):
    return catalog.numbered_speakers(segments(spark, sf_dir))


def stream_ordinal(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return catalog.ordinals(rows, ("user_id", "event_type"), ("ts", "event_id")).select("event_id", "ordinal")


def _thresholds(spark, sf_dir):
    """Under each threshold, how many orders a customer's mean price puts above it."""
    grid = spark.createDataFrame([(x,) for x in GRID], "threshold double")
    prices = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("price"))
    swept = catalog.sweep(prices, grid).groupBy("threshold").agg(F.count_if(F.col("price") > F.col("threshold") * 150_000).alias("n"), F.count("*").alias("customers"))
    return swept.withColumn("off", F.abs(F.col("n") * 2 - F.col("customers")))


def threshold_sweep(spark, sf_dir):
    return _thresholds(spark, sf_dir)


def grid_selection(spark, sf_dir):
    return catalog.selected(_thresholds(spark, sf_dir), "off", "threshold")


def vocabulary(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return catalog.vocabulary(words, FALLBACK)


def first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return catalog.first_of_each(rows, "o_custkey", ("o_orderkey",))


def class_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(catalog.evidence_class(F.col("o_orderpriority")).alias("class")).agg(F.count("*").alias("n"))


def source_tags(spark, sf_dir):
    return catalog.tagged(table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name")), "name", PATTERNS).select("p_partkey", "tag")


def unlisted(spark, sf_dir):
    return catalog.unlisted(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("key")), "key")


def log_equality(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return catalog.differences(rows.where("l_partkey % 2 = 0 or l_suppkey % 3 > 0"), rows.where("l_suppkey % 3 > 0"))


def replay_record(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), F.concat(F.lit("r"), "page_id").alias("request_id"), (F.col("page_id") + 0.5).alias("ts"), F.lit(1.5).alias("duration_ms"), F.lit("GET").alias("method"),
        F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"), F.lit("v=1").alias("query"), F.lit(None).cast("string").alias("host"), F.lit("é").alias("body"), F.lit(None).cast("long").alias("body_size"),
    )
    return catalog.replay_record(rows)


def url_parts(spark, sf_dir):
    part = lambda p: F.try_parse_url("url", F.lit(p))
    return table(spark, sf_dir, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"))


def running_clamp(spark, sf_dir):
    rows = segments(spark, sf_dir).select("meeting_id", "label", "seg_no", "lo", "hi")
    return annotated.clamped(rows, ("meeting_id", "label"), "seg_no")


def _times(spark, sf_dir):
    """Words with times that need repair, from the line items."""
    start = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 500
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("pos"), F.lit("w").alias("kind"), F.when(F.col("l_linenumber") != 3, start.cast("double")).alias("start"))
    return rows.withColumns({"end": F.col("start") + F.col("pos") * 40 - 60, "duration": F.lit(450.0)})


def time_repair(spark, sf_dir):
    return annotated.repaired(_times(spark, sf_dir)).select("meeting_id", "pos", "lo", "hi", F.array_join("repair", ",").alias("repair"))


def repair_counters(spark, sf_dir):
    return annotated.counters(annotated.repaired(_times(spark, sf_dir)))


def missing_hypotheses(spark, sf_dir):
    rows = segments(spark, sf_dir)
    return evaluation.pairs(rows.where("side = 'R' and label = 'view' and lo % 3 = 0"), rows.where("side = 'H' and lo % 7 = 0 and meeting_id % 5 > 0"))[1]


def _frames(spark, sf_dir):
    """Data frames of parts' names, as bytes; some are cut, some end before their offset, some are of another type."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("session"), (F.col("p_partkey") * 7).alias("offset"), F.encode("p_name", "utf-8").alias("body"))
    whole = frames.data_frame(F.col("session"), F.col("offset"), F.col("body"))
    size = F.octet_length(whole)
    raw = F.when(F.col("session") % 13 == 0, F.substring(whole, F.lit(1), F.lit(7))).when(F.col("session") % 11 == 0, F.concat(F.lit(b"\x01"), F.substring(whole, F.lit(2), size)))
    return rows.select("session", "offset", "body", raw.when(F.col("session") % 5 == 0, F.substring(whole, F.lit(1), size - 2)).otherwise(whole).alias("raw"))


def frame_decode(spark, sf_dir):
    found = frames.file_data(_frames(spark, sf_dir).select("raw"))
    return found.select("session", F.col("offset").alias("place"), "length", F.decode("payload", "utf-8").alias("payload"), F.col("error").isNull().alias("good"), F.coalesce("error", F.lit("")).alias("error"))


def session_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", values.file_name(F.col("o_orderkey") * 100_003).alias("name"))


def accepted_frames(spark, sf_dir):
    rows = segments(spark, sf_dir).select(F.col("meeting_id").alias("stream"), F.col("seg_no").alias("seq"), (F.col("lo") * 100_000 + F.col("seg_no")).alias("ordinal"))
    return state.accepted(rows)


def binding_state(spark, sf_dir):
    """Customers as owners of devices; every third event gives a device back."""
    kind = F.when(F.col("event_id") % 3 == 0, "unbind").otherwise("bind")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("device"), kind.alias("kind"), (F.col("user_id") % 3).cast("string").alias("owner"), F.col("event_id").alias("ordinal"), "user_id")
    rows = rows.withColumn("device", F.concat("device", (F.col("user_id") / 3).cast("int").cast("string"))).drop("user_id")
    return state.binding_state(rows).select("device", "is_bind", F.size("history").alias("binds"))


def embedding_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return catalog.cluster_sizes(kmeans.kmeans(rows.where("v is not null and group is not null"), 3), 2, 0.1)


def interval_difference(spark, sf_dir):
    rows = segments(spark, sf_dir)
    return intervals.difference(rows.where("side = 'R'"), rows.where("side = 'H'"))


def cell_windows(spark, sf_dir):
    rows = segments(spark, sf_dir)
    regions = intervals.union(rows.where("side = 'R'"), ("meeting_id",))
    return intervals.cell_windows(rows.where("side = 'H'").select("meeting_id", "seg_no", "lo", "hi"), regions, 60_000_000).select("meeting_id", "seg_no", "w0", "w1")


def tie_break_rates(spark, sf_dir):
    said, turns = spoken(spark, sf_dir)
    tokens = text.split_words(text.normalise(F.col("text")))
    refs = dialogue(spark, sf_dir).where("side = 'R'").withColumn("tokens", tokens)
    rounded = [F.round(c, 6).alias(c) for c in ("micro", "macro")]
    return evaluation.tie_breaks(refs, said, turns).select("rule", *rounded, "meetings", "ties")


def evaluation_macro(spark, sf_dir):
    return evaluation.macro(evaluation.flat(dialogue(spark, sf_dir))).withColumn("value", F.round("value", 6))


def evaluation_micro(spark, sf_dir):
    return evaluation.micro(evaluation.flat(dialogue(spark, sf_dir))).withColumn("value", F.round("value", 6))


QUERIES = {
    f.__name__: f
    for f in (
        text_concat, speaker_relabel, stream_ordinal, threshold_sweep, grid_selection, vocabulary, first_wins, class_counts, source_tags, unlisted, log_equality, replay_record, url_parts,
        running_clamp, time_repair, repair_counters, missing_hypotheses, frame_decode, session_names, accepted_frames, binding_state, embedding_clusters, interval_difference, cell_windows, tie_break_rates, evaluation_macro, evaluation_micro,
    )
}

_SEG = """seg AS (
    SELECT user_id AS meeting_id, CASE WHEN event_id % 2 = 0 THEN 'R' ELSE 'H' END AS side, event_type AS label,
           epoch_us(ts) % 3600000000 AS lo, epoch_us(ts) % 3600000000 + CAST(round(value * 1e6) AS BIGINT) AS hi, event_id AS seg_no
    FROM events WHERE CAST(round(value * 1e6) AS BIGINT) > 0
)"""
_SWEPT = f"""p AS (SELECT o_custkey, avg(o_totalprice) AS price FROM orders GROUP BY 1), s AS (
    SELECT threshold, count(*) FILTER (price > threshold * 150000) AS n, count(*) AS customers FROM p, (SELECT unnest({GRID}::DOUBLE[]) AS threshold) GROUP BY 1
), x AS (SELECT *, abs(n * 2 - customers) AS off FROM s)"""
_TIMES = """t AS (SELECT l_orderkey AS meeting_id, l_linenumber AS pos, CASE WHEN l_linenumber <> 3 THEN (l_orderkey * 37 + l_linenumber * 11) % 500 END AS a FROM lineitem
), u AS (SELECT *, a + pos * 40 - 60 AS b FROM t)"""
_CLASS = "CASE " + " ".join(f"WHEN contains(upper(coalesce(o_orderpriority, '')), '{k}') THEN '{v}'" for k, v in catalog.EVIDENCE) + " ELSE 'UNCLASSIFIED' END"

ORACLE_SQL = {
    "text_concat": "SELECT conv_id AS meeting_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (coalesce(text, '') <> ''), '') AS text FROM conversations GROUP BY 1",
    "speaker_relabel": f"""WITH {_SEG}, f AS (SELECT meeting_id, label, min({{'lo': lo, 'seg_no': seg_no}}) AS f FROM seg GROUP BY 1, 2)
        SELECT meeting_id, label, 'Speaker ' || row_number() OVER (PARTITION BY meeting_id ORDER BY f) AS name FROM f""",
    "stream_ordinal": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS ordinal FROM events",
    "threshold_sweep": f"WITH {_SWEPT} SELECT threshold, n, customers, off FROM x",
    "grid_selection": f"WITH {_SWEPT} SELECT threshold, n, customers, off FROM x ORDER BY off, threshold LIMIT 1",
    "vocabulary": f"SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT unnest({FALLBACK}))",
    "first_wins": "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1",
    "class_counts": f"SELECT {_CLASS} AS class, count(*) AS n FROM orders GROUP BY 1",
    "source_tags": " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS tag FROM part WHERE regexp_matches(lower(p_name), '{p}')" for k, p in PATTERNS.items()),
    "unlisted": "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "log_equality": """WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 2 = 0 OR l_suppkey % 3 > 0), b AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey % 3 > 0)
        SELECT * FROM (SELECT 'left' AS side, count(*) AS n FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'right', count(*) FROM (FROM b EXCEPT ALL FROM a)) WHERE n > 0""",
    "replay_record": """SELECT page_id AS seq, '1 r' || page_id || ' ' || (page_id * 1000000000 + 500000000) || ' 1500000' || chr(10) || 'GET ' || regexp_replace(url, '^[a-z]+://[^/]*', '') || '?v=1 HTTP/1.1'
        || chr(13) || chr(10) || 'Host: localhost' || chr(13) || chr(10) || 'Content-Length: 2' || chr(13) || chr(10) || chr(13) || chr(10) || 'é' || chr(10) AS record FROM pages""",
    "url_parts": "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host FROM pages",
    "running_clamp": f"""WITH {_SEG}, c AS (SELECT *, max(lo) OVER (PARTITION BY meeting_id, label ORDER BY seg_no ROWS UNBOUNDED PRECEDING) AS m FROM seg)
        SELECT meeting_id, label, seg_no, m AS lo, greatest(hi, m) AS hi, m > lo AS clamped FROM c""",
    "time_repair": f"""WITH {_TIMES} SELECT meeting_id, pos, CASE WHEN a < 450 THEN a::BIGINT * 1000000 END AS lo, CASE WHEN a < 450 THEN least(greatest(a, b), 450)::BIGINT * 1000000 END AS hi,
        concat_ws(',', CASE WHEN a IS NULL THEN 'untimed' END, CASE WHEN b < a THEN 'negative' END, CASE WHEN a >= 450 THEN 'after_end' END, CASE WHEN a < 450 AND greatest(a, b) > 450 THEN 'clipped' END) AS repair FROM u""",
    "repair_counters": f"""WITH {_TIMES} SELECT meeting_id, count(*) AS words, count(*) FILTER (a IS NULL) AS untimed, count(*) FILTER (b < a) AS negative, count(*) FILTER (a >= 450) AS after_end,
        count(*) FILTER (a < 450 AND greatest(a, b) > 450) AS clipped FROM u GROUP BY 1""",
    "missing_hypotheses": f"""WITH {_SEG}, r AS (SELECT DISTINCT meeting_id FROM seg WHERE side = 'R' AND label = 'view' AND lo % 3 = 0), h AS (SELECT DISTINCT meeting_id FROM seg WHERE side = 'H' AND lo % 7 = 0 AND meeting_id % 5 > 0)
        SELECT coalesce(r.meeting_id, h.meeting_id) AS meeting_id, CASE WHEN h.meeting_id IS NULL THEN 'missing' WHEN r.meeting_id IS NULL THEN 'unknown' ELSE 'scored' END AS status FROM r FULL JOIN h ON r.meeting_id = h.meeting_id""",
    "frame_decode": """WITH p AS (SELECT p_partkey AS session, p_partkey % 13 = 0 AS short, p_name AS n, p_partkey FROM part)
        SELECT session, CASE WHEN NOT short THEN p_partkey * 7 END AS place, CASE WHEN NOT short THEN length(n)::BIGINT END AS length,
        CASE WHEN short THEN NULL WHEN p_partkey % 11 <> 0 AND p_partkey % 5 = 0 THEN left(n, greatest(0, length(n) - 2)) ELSE n END AS payload,
        NOT short AND p_partkey % 11 <> 0 AS good, CASE WHEN short THEN 'too short for the offset' WHEN p_partkey % 11 = 0 THEN 'not a data frame' ELSE '' END AS error FROM p""",
    "binding_state": """WITH RECURSIVE e AS (
        SELECT event_type || (user_id // 3) AS device, CASE WHEN event_id % 3 = 0 THEN 'unbind' ELSE 'bind' END AS kind, (user_id % 3)::VARCHAR AS owner,
               row_number() OVER (PARTITION BY event_type || (user_id // 3) ORDER BY event_id) AS i FROM events
    ), walk AS (
        SELECT device, 0::BIGINT AS i, NULL::VARCHAR AS holder, 0::INT AS binds, NULL::VARCHAR AS last FROM (SELECT DISTINCT device FROM e)
        UNION ALL SELECT device, i, CASE WHEN NOT good THEN holder WHEN kind = 'bind' THEN owner END, (binds + CASE WHEN good AND kind = 'bind' THEN 1 ELSE 0 END)::INT, CASE WHEN good THEN kind ELSE last END
        FROM (SELECT e.*, holder, binds, last, (holder IS NULL OR holder = owner) AND (kind = 'bind' OR binds > 0) AS good FROM walk w JOIN e ON e.device = w.device AND e.i = w.i + 1)
    ) SELECT device, last = 'bind' AS is_bind, binds FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY i DESC) AS back FROM walk) WHERE back = 1 AND last IS NOT NULL""",
    "session_names": "SELECT o_orderkey, CASE WHEN o_orderkey * 100003 < 100 THEN 'log' || o_orderkey * 100003 ELSE strftime(make_timestamp(o_orderkey * 100003 * 1000000), '%Y-%m-%d_%H-%M-%S') || '.opus' END AS name FROM orders",
    "accepted_frames": f"""WITH {_SEG}, b AS (SELECT meeting_id AS stream, seg_no AS seq, max(seg_no) OVER (PARTITION BY meeting_id ORDER BY lo * 100000 + seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM seg)
        SELECT stream, seq FROM b WHERE seq > coalesce(m, -1)""",
    "interval_difference": f"""WITH {_SEG}, e AS (SELECT meeting_id, lo AS t, CASE WHEN side = 'R' THEN 1 ELSE 0 END AS a, CASE WHEN side = 'H' THEN 1 ELSE 0 END AS b FROM seg
        UNION ALL SELECT meeting_id, hi, CASE WHEN side = 'R' THEN -1 ELSE 0 END, CASE WHEN side = 'H' THEN -1 ELSE 0 END FROM seg
    ), g AS (SELECT meeting_id, t, sum(a) AS a, sum(b) AS b FROM e GROUP BY 1, 2
    ), c AS (SELECT meeting_id, t AS lo, lead(t) OVER w AS hi, sum(a) OVER w AS a, sum(b) OVER w AS b FROM g WINDOW w AS (PARTITION BY meeting_id ORDER BY t)
    ), k AS (SELECT *, CASE WHEN lag(hi) OVER w = lo THEN 0 ELSE 1 END AS new FROM c WHERE hi IS NOT NULL AND a > 0 AND b = 0 WINDOW w AS (PARTITION BY meeting_id ORDER BY lo)
    ), i AS (SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY lo ROWS UNBOUNDED PRECEDING) AS island FROM k)
    SELECT meeting_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY meeting_id, island""",
    "cell_windows": f"""WITH {_SEG}, m AS (
        SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY meeting_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM seg WHERE side = 'R'
    ), i AS (SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m
    ), r AS (SELECT meeting_id, min(lo) AS r0, max(hi) AS r1 FROM i GROUP BY meeting_id, island
    ), h AS (SELECT * FROM seg WHERE side = 'H'
    ), p AS (SELECT h.meeting_id, h.seg_no, h.lo, h.hi, coalesce(min({{'r1': r1, 'r0': r0}}) FILTER (r1 >= h.hi), max({{'r1': r1, 'r0': r0}})) AS g FROM h LEFT JOIN r ON r.meeting_id = h.meeting_id GROUP BY 1, 2, 3, 4)
    SELECT meeting_id, seg_no, greatest(coalesce(g.r0, lo)::DOUBLE, (lo + hi) / 2 - greatest(60000000, hi - lo) / 2) AS w0, least(coalesce(g.r1, hi)::DOUBLE, (lo + hi) / 2 + greatest(60000000, hi - lo) / 2) AS w1 FROM p""",
}
