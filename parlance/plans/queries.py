"""Queries of the annotation operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.operators import alignment, reports, scoring, sessions, text, words
from parlance.operators import intervals as iv
from parlance.plans.mapping_sql import MAPPING_SQL
from parlance.plans.tables import FRAMES_SQL, SEG_SQL, SPOKEN_SQL, dialogue, frames, segments, spoken, table, transcripts
from parlance.sources import lines

COLLAR = 2_000_000
GAP = 30_000_000
CHECKS = [
    ("core", "der", 5.0, None, None, None),
    ("core", "total", None, 1.0, None, None),
    ("strict", "der", 0.1, None, None, None),
    ("strict", "absent", 1.0, None, None, None),
    ("exact", "der", None, None, 2.5, 2.5),
    ("exact", "total", None, None, 1.0, None),
]


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("label").isin("view", "click"), "A").otherwise("B")
    return segments(spark, sf_dir).withColumn("label", label)


def der_two_label(spark, sf_dir, **how):
    return scoring.diarization_error(_two(spark, sf_dir), **how)


def der_multi_label(spark, sf_dir):
    return scoring.diarization_error(segments(spark, sf_dir))


def overlap_der(spark, sf_dir):
    return scoring.overlap_error(segments(spark, sf_dir))


def der_per_speaker(spark, sf_dir):
    whole = [F.round(c).cast("long").alias(c) for c in ("miss", "conf", "fa")]
    return scoring.per_speaker(segments(spark, sf_dir)).select("meeting_id", "speaker", "mapped_to", "total", "correct", *whole)


def jer(spark, sf_dir):
    return scoring.jaccard_error(_two(spark, sf_dir))


def union_of(strict):
    return lambda spark, sf_dir: iv.union(segments(spark, sf_dir), ("meeting_id", "side", "label"), strict)


def cooccurrence_matrix(spark, sf_dir):
    return iv.cooccurrence(iv.tracks(segments(spark, sf_dir)))


def meeting_stats(spark, sf_dir):
    """Speech (one or more of the reference's tracks active) and overlap (two or more)."""
    cells = iv.sweep({"n": iv.tracks(segments(spark, sf_dir)).where("side = 'R'")})
    d = F.col("hi") - F.col("lo")
    sums = cells.groupBy("meeting_id").agg(F.sum(F.when(F.col("n") >= 1, d).otherwise(0)).alias("speech"), F.sum(F.when(F.col("n") >= 2, d).otherwise(0)).alias("overlap"))
    return sums.withColumn("overlap_ratio", F.try_divide("overlap", "speech"))


def speaker_count_error(spark, sf_dir):
    names = lambda side: F.count_distinct(F.when(F.col("side") == side, F.col("label")))
    counts = segments(spark, sf_dir).groupBy("meeting_id").agg(names("R").alias("n_ref"), names("H").alias("n_hyp"))
    return counts.withColumn("error", F.col("n_hyp") - F.col("n_ref")).withColumn("abs_error", F.abs("error"))


def turn_diff(spark, sf_dir):
    """Second-long turns of one side that the other lacks, with multiplicity."""
    rows = segments(spark, sf_dir).select("side", "label", F.expr("lo div 1000000").alias("sec"))
    one, two = (rows.where(F.col("side") == s).drop("side") for s in "RH")
    only = lambda a, b, name: a.exceptAll(b).groupBy("label").agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "label", "n")
    return only(one, two, "R").unionByName(only(two, one, "H"))


def merge_gap(spark, sf_dir):
    return sessions.merge_gap(segments(spark, sf_dir).where("side = 'R'"), GAP)


def first_appearance_relabel(spark, sf_dir):
    first = segments(spark, sf_dir).groupBy("meeting_id", "label").agg(F.min(F.struct("lo", "seg_no")).alias("f"))
    return first.select("meeting_id", "label", F.concat(F.lit("spk"), F.row_number().over(Window.partitionBy("meeting_id").orderBy("f")) - 1).alias("name"))


def _long(spark, sf_dir):
    return der_two_label(spark, sf_dir).select("meeting_id", F.expr("stack(4, 'total', double(total), 'miss', double(miss), 'fa', double(fa), 'conf', double(conf)) as (metric, value)"))


def macro_average(spark, sf_dir):
    return reports.macro_average(_long(spark, sf_dir)).select("metric", F.round("value", 3).alias("value"), "meetings")


def micro_average(spark, sf_dir):
    s = der_two_label(spark, sf_dir).agg(*[F.sum(c).alias(c) for c in ("total", "miss", "fa", "conf")])
    return s.withColumn("der", F.try_divide(F.col("miss") + F.col("fa") + F.col("conf"), "total"))


def _checked(spark, sf_dir):
    micro = micro_average(spark, sf_dir).select(F.expr("stack(2, 'der', der, 'total', double(total)) as (metric, value)"))
    return reports.gates(spark.createDataFrame(CHECKS, "suite string, metric string, max double, min double, eq double, tol double"), micro)


def gate_suite(spark, sf_dir):
    return reports.suites(_checked(spark, sf_dir))


def normalize_text(spark, sf_dir):
    return transcripts(spark, sf_dir).select("meeting_id", "seg_no", text.normalise(F.col("text")).alias("norm"))


def output_tokens(spark, sf_dir):
    return transcripts(spark, sf_dir).select("meeting_id", "seg_no", F.posexplode(text.output_tokens(F.col("text"))).alias("pos", "token"))


def split_words(spark, sf_dir):
    """Words of a turn share its minute equally, in microseconds from the turn's start."""
    words = transcripts(spark, sf_dir).withColumn("words", text.split_words(F.col("text"))).withColumn("k", F.size("words"))
    rows = words.select("meeting_id", "seg_no", "k", F.posexplode("words").alias("pos", "w"))
    return rows.select("meeting_id", "seg_no", "pos", "w", F.expr("60000000L * pos div k").alias("lo"), F.expr("60000000L * (pos + 1) div k").alias("hi"))


def mask_runs(spark, sf_dir):
    return sessions.runs(frames(spark, sf_dir), F.col("level") >= 50)


def hangover(spark, sf_dir):
    return sessions.hangover(mask_runs(spark, sf_dir), 20, frames(spark, sf_dir))


def smooth_turns(spark, sf_dir):
    return sessions.smooth(segments(spark, sf_dir).where("side = 'R'"), 20_000_000, GAP)


def bridge_silence(spark, sf_dir):
    return sessions.joined(mask_runs(spark, sf_dir), 60)


def drop_short(spark, sf_dir):
    return bridge_silence(spark, sf_dir).where("n >= 2")


def time_text(spark, sf_dir):
    return segments(spark, sf_dir).select("seg_no", text.time_text(F.col("lo") / 1e6).alias("t"))


def quantise_grid(spark, sf_dir):
    lo = F.expr("lo div 125")
    return segments(spark, sf_dir).select("seg_no", (lo * 125).alias("down"), ((F.expr("(lo + 124) div 125")) * 125).alias("up"))


def replay_window(spark, sf_dir):
    """Events are accepted if their number exceeds all before, in the order of their folded time."""
    before = Window.partitionBy("meeting_id").orderBy("lo", "seg_no").rowsBetween(Window.unboundedPreceding, -1)
    return segments(spark, sf_dir).select("meeting_id", "seg_no", (F.col("seg_no") > F.coalesce(F.max("seg_no").over(before), F.lit(-1))).alias("accepted"))


def latest_state(spark, sf_dir):
    last = segments(spark, sf_dir).groupBy("meeting_id").agg(F.max_by("label", F.struct("seg_no")).alias("state"), F.count("*").alias("events"))
    return last


def paging(spark, sf_dir):
    """A customer's orders in pages of ten."""
    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    paged = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(row / 10).alias("page"))
    return paged.groupBy("o_custkey", "page").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def seed_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.seed_number(F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("seed"))


def rttm_roundtrip(spark, sf_dir):
    """Segments as lines of ten fields, and read from them."""
    named = segments(spark, sf_dir).withColumn("meeting_id", F.col("meeting_id").cast("string"))
    written = lines.rttm_lines(named, safe=True).select(F.lit("").alias("path"), F.lit(1).alias("line_no"), "line")
    return lines.rttm(written).where("error is null").select(F.col("meeting_id").cast("long"), "label", "lo", "hi")


def stm_roundtrip(spark, sf_dir):
    named = dialogue(spark, sf_dir).where("side = 'R'").withColumn("meeting_id", F.col("meeting_id").cast("string"))
    written = lines.stm_lines(named, safe=True).select(F.lit("").alias("path"), F.lit(1).alias("line_no"), "line")
    return lines.stm(written).where("error is null").select(F.col("meeting_id").cast("long"), "label", "lo", "hi", "text")


def rttm_statistics(spark, sf_dir):
    return lines.statistics(segments(spark, sf_dir))


def release_digest(spark, sf_dir):
    return lines.release_digest(lines.rttm_lines(segments(spark, sf_dir), safe=True))


def _word_errors(spark, sf_dir, kinds=words.KINDS):
    tokens = text.split_words(text.normalise(F.col("text")))
    return words.word_errors(dialogue(spark, sf_dir).withColumn("tokens", tokens), kinds=kinds)


def rate_of(kind):
    return lambda spark, sf_dir: _word_errors(spark, sf_dir, (kind,)).select("meeting_id", f"{kind}.rate", f"{kind}.errors", f"{kind}.length", f"{kind}.hits")


def word_rates(spark, sf_dir):
    scores = _word_errors(spark, sf_dir)
    kinds = ("literal", "concat", "cp", "tcp")
    stacked = scores.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}.errors").alias("errors"), F.col(f"{k}.length").alias("length"), F.col(f"{k}.rate").alias("rate")) for k in kinds])).alias("x")).select("x.*")
    return stacked.groupBy("kind").agg(F.sum("errors").alias("errors"), F.sum("length").alias("length"), F.round(F.avg("rate"), 6).alias("macro"), F.count("rate").alias("meetings"))


def assigned(tie_break):
    return lambda spark, sf_dir: alignment.assign(*spoken(spark, sf_dir), tie_break).select("meeting_id", "seg_no", "word_no", "label", "how")


def assignment_stats(spark, sf_dir):
    return alignment.assignment_stats(alignment.assign(*spoken(spark, sf_dir)))


def speaker_runs(spark, sf_dir):
    return alignment.speaker_runs(alignment.assign(*spoken(spark, sf_dir)))


def word_in_turn(spark, sf_dir):
    return alignment.contained(*spoken(spark, sf_dir)).select("meeting_id", "seg_no", "word_no", "label")


def number_words(spark, sf_dir):
    """Order keys and prices in words."""
    price = F.format_number(F.col("o_totalprice").cast("decimal(15,2)"), 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.integer_words(F.col("o_orderkey")).alias("key"), text.number_words(price).alias("price"))


QUERIES = {
    "der_two_label": der_two_label,
    "der_collar": lambda spark, sf_dir: der_two_label(spark, sf_dir, collar=COLLAR),
    "der_skip_overlap": lambda spark, sf_dir: der_two_label(spark, sf_dir, skip_overlap=True),
    "der_multi_label": der_multi_label,
    "overlap_der": overlap_der,
    "der_per_speaker": der_per_speaker,
    "jer": jer,
    "interval_union_touch": union_of(False),
    "interval_union_strict": union_of(True),
    "cooccurrence_matrix": cooccurrence_matrix,
    "meeting_stats": meeting_stats,
    "speaker_count_error": speaker_count_error,
    "turn_diff": turn_diff,
    "merge_gap": merge_gap,
    "first_appearance_relabel": first_appearance_relabel,
    "macro_average": macro_average,
    "micro_average": micro_average,
    "gate_eval": _checked,
    "gate_suite": gate_suite,
    "normalize_text": normalize_text,
    "output_tokens": output_tokens,
    "split_words": split_words,
    "mask_runs": mask_runs,
    "hangover": hangover,
    "bridge_silence": bridge_silence,
    "drop_short": drop_short,
    "time_text": time_text,
    "quantise_grid": quantise_grid,
    "replay_window": replay_window,
    "latest_state": latest_state,
    "paging": paging,
    "seed_hash": seed_hash,
    "rttm_roundtrip": rttm_roundtrip,
    "stm_roundtrip": stm_roundtrip,
    "rttm_statistics": rttm_statistics,
    "release_digest": release_digest,
    "smooth_turns": smooth_turns,
    "wer_literal": rate_of("literal"),
    "wer_concat": rate_of("concat"),
    "cpwer": rate_of("cp"),
    "tcpwer": rate_of("tcp"),
    "word_rates": word_rates,
    **{f"word_to_turn_{t}": assigned(t) for t in alignment.TIE_BREAKS},
    "assignment_stats": assignment_stats,
    "speaker_runs": speaker_runs,
    "word_in_turn": word_in_turn,
    "number_words": number_words,
}


def _union_sql(source: str, strict: bool) -> str:
    return f"""SELECT meeting_id, side, label, min(lo) AS lo, max(hi) AS hi FROM (
        SELECT *, sum(new) OVER (PARTITION BY meeting_id, side, label ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT meeting_id, side, label, lo, hi, CASE WHEN lo {"<" if strict else "<="} max(hi) OVER (
                PARTITION BY meeting_id, side, label ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
            FROM {source}))
    GROUP BY meeting_id, side, label, island"""


TRACKS_SQL = f"WITH {SEG_SQL}, tracks AS ({_union_sql('seg', True)})"


def _der_sql(collar: int = 0, skip: bool = False) -> str:
    half = collar // 2
    return f"""WITH {SEG_SQL}, two AS (
    SELECT meeting_id, side, CASE WHEN label IN ('view', 'click') THEN 'A' ELSE 'B' END AS label, lo, hi FROM seg
), tracks AS ({_union_sql("two", True)}), p AS (
    SELECT meeting_id, side || label AS k, lo AS t, 1 AS s FROM tracks UNION ALL SELECT meeting_id, side || label, hi, -1 FROM tracks
    UNION ALL SELECT meeting_id, 'c', t - {half}, 1 FROM (SELECT meeting_id, unnest([lo, hi]) AS t FROM tracks WHERE side = 'R')
    UNION ALL SELECT meeting_id, 'c', t + {half}, -1 FROM (SELECT meeting_id, unnest([lo, hi]) AS t FROM tracks WHERE side = 'R')
), q AS (
    SELECT meeting_id, t, {", ".join(f"sum(CASE WHEN k = '{k}' THEN s ELSE 0 END) AS {k}" for k in ("RA", "RB", "HA", "HB", "c"))} FROM p GROUP BY 1, 2
), cells AS (
    SELECT meeting_id, lead(t) OVER w - t AS d, {", ".join(f"sum({k}) OVER w AS {k}" for k in ("RA", "RB", "HA", "HB", "c"))} FROM q WINDOW w AS (PARTITION BY meeting_id ORDER BY t)
), sums AS (
    SELECT meeting_id, sum(d * (RA + RB))::BIGINT AS total, sum(d * greatest(0, RA + RB - HA - HB))::BIGINT AS miss, sum(d * greatest(0, HA + HB - RA - RB))::BIGINT AS fa,
           sum(d * least(RA + RB, HA + HB))::BIGINT AS common,
           greatest(sum(d * (least(RA, HA) + least(RB, HB))), sum(d * (least(RA, HB) + least(RB, HA))))::BIGINT AS correct
    FROM cells WHERE d > 0 AND c = 0 {"AND RA + RB < 2" if skip else ""} GROUP BY meeting_id HAVING sum(d * (RA + RB + HA + HB)) > 0
), der AS (
    SELECT meeting_id, total, miss, fa, common - correct AS conf, correct, CASE WHEN total > 0 THEN (miss + fa + common - correct)::DOUBLE / total END AS der FROM sums
)"""


_JER = f"""{_der_sql()}, sizes AS (
    SELECT meeting_id, sum(d * RA) AS ra, sum(d * RB) AS rb, sum(d * HA) AS ha, sum(d * HB) AS hb, sum(d * least(RA, HA)) AS aa, sum(d * least(RB, HB)) AS bb,
           sum(d * least(RA, HB)) AS ab, sum(d * least(RB, HA)) AS ba FROM cells WHERE d > 0 GROUP BY meeting_id
), pick AS (
    SELECT *, aa + bb >= ab + ba AS straight FROM sizes
), each AS (
    SELECT meeting_id, ra AS r, CASE WHEN straight THEN aa ELSE ab END AS x, CASE WHEN straight THEN ha ELSE hb END AS h FROM pick WHERE ra > 0
    UNION ALL SELECT meeting_id, rb, CASE WHEN straight THEN bb ELSE ba END, CASE WHEN straight THEN hb ELSE ha END FROM pick WHERE rb > 0
)
SELECT meeting_id, count(*) AS n_ref, avg(CASE WHEN x > 0 THEN 1 - x::DOUBLE / (r + h - x) ELSE 1 END) AS jer FROM each GROUP BY meeting_id"""

_SHARED = f"""{TRACKS_SQL.replace("WITH", "WITH RECURSIVE", 1)}, e AS (
    SELECT meeting_id, side, label, lo AS t, 1 AS s FROM tracks UNION ALL SELECT meeting_id, side, label, hi, -1 FROM tracks
), cells AS (
    SELECT meeting_id, t AS lo, lead(t) OVER w AS hi, sum(r) OVER w AS r, sum(h) OVER w AS h FROM (
        SELECT meeting_id, t, sum(CASE WHEN side = 'R' THEN s ELSE 0 END) AS r, sum(CASE WHEN side = 'H' THEN s ELSE 0 END) AS h FROM e GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY meeting_id ORDER BY t)
), shared AS (
    SELECT r.meeting_id, r.label AS ref, h.label AS hyp, sum(least(r.hi, h.hi) - greatest(r.lo, h.lo)) AS d
    FROM tracks r JOIN tracks h ON r.meeting_id = h.meeting_id AND r.side = 'R' AND h.side = 'H' AND r.lo < h.hi AND h.lo < r.hi GROUP BY 1, 2, 3
)"""

# the largest total over all permutations
_MULTI = f"""{_SHARED}, names AS (SELECT DISTINCT label FROM tracks
), perms AS (
    SELECT row_number() OVER () AS p, * FROM (SELECT list(label ORDER BY label) AS refs FROM names), (
        SELECT [a.label, b.label, c.label, d.label, e.label] AS hyps FROM names a, names b, names c, names d, names e
        WHERE len(list_distinct([a.label, b.label, c.label, d.label, e.label])) = 5)
), pairs AS (SELECT p, unnest(refs) AS ref, unnest(hyps) AS hyp FROM perms
), gains AS (SELECT meeting_id, p, sum(d) AS d FROM shared JOIN pairs USING (ref, hyp) GROUP BY 1, 2
), best AS (SELECT meeting_id, max(d) AS correct FROM gains GROUP BY 1)"""

_MAPPED = f"{_SHARED}, {MAPPING_SQL}"


def _multi_sql(mapping: str, where: str, correct: str) -> str:
    return f"""{mapping}, right_ AS ({correct}), sums AS (
        SELECT meeting_id, sum((hi - lo) * r)::BIGINT AS total, sum((hi - lo) * greatest(0, r - h))::BIGINT AS miss, sum((hi - lo) * greatest(0, h - r))::BIGINT AS fa, sum((hi - lo) * least(r, h))::BIGINT AS common
        FROM cells WHERE hi IS NOT NULL AND {where} GROUP BY 1
    ) SELECT meeting_id, total, miss, fa, common - coalesce(correct, 0)::BIGINT AS conf, coalesce(correct, 0)::BIGINT AS correct,
             CASE WHEN total > 0 THEN (miss + fa + common - coalesce(correct, 0))::DOUBLE / total END AS der
      FROM sums LEFT JOIN right_ USING (meeting_id) WHERE total + fa > 0"""


_INSIDE = """SELECT c.meeting_id, sum(least(c.hi, r.hi, h.hi) - greatest(c.lo, r.lo, h.lo)) AS correct FROM cells c
    JOIN tracks r ON c.meeting_id = r.meeting_id AND r.side = 'R' AND r.lo < c.hi AND c.lo < r.hi
    JOIN tracks h ON c.meeting_id = h.meeting_id AND h.side = 'H' AND h.lo < c.hi AND c.lo < h.hi
    JOIN mapping m ON m.meeting_id = c.meeting_id AND m.ref = r.label AND m.hyp = h.label
    WHERE c.r >= 2 GROUP BY 1"""


_SPEAKERS = f"""{_MAPPED}, mapped AS (SELECT meeting_id, ref, hyp FROM mapping
), active AS (
    SELECT c.meeting_id, c.lo, c.hi - c.lo AS d, c.r, c.h, t.side, t.label FROM cells c JOIN tracks t ON t.meeting_id = c.meeting_id AND t.lo <= c.lo AND c.hi <= t.hi
), hit AS (
    SELECT a.meeting_id, a.lo, m.ref, m.hyp FROM active a JOIN mapped m ON m.meeting_id = a.meeting_id AND m.ref = a.label AND a.side = 'R'
    JOIN active b ON b.meeting_id = a.meeting_id AND b.lo = a.lo AND b.side = 'H' AND b.label = m.hyp
), n AS (SELECT meeting_id, lo, count(*) AS c FROM hit GROUP BY 1, 2
), each AS (
    SELECT a.*, coalesce(c, 0) AS c, hit.ref IS NOT NULL AS matched FROM active a LEFT JOIN n USING (meeting_id, lo)
    LEFT JOIN hit ON hit.meeting_id = a.meeting_id AND hit.lo = a.lo AND CASE WHEN a.side = 'R' THEN hit.ref ELSE hit.hyp END = a.label
), said AS (
    SELECT meeting_id, label AS speaker, d AS total, CASE WHEN matched THEN d ELSE 0 END AS correct, CASE WHEN matched THEN 0 ELSE d * greatest(0, r - h)::DOUBLE / (r - c) END AS miss,
           CASE WHEN matched THEN 0 ELSE d * (least(r, h) - c)::DOUBLE / (r - c) END AS conf, 0::DOUBLE AS fa FROM each WHERE side = 'R'
    UNION ALL SELECT e.meeting_id, coalesce(m.ref, 'hyp:' || label), 0, 0, 0, 0, CASE WHEN matched THEN 0 ELSE d * greatest(0, h - r)::DOUBLE / (h - c) END
    FROM each e LEFT JOIN mapped m ON m.meeting_id = e.meeting_id AND m.hyp = e.label WHERE side = 'H'
)
SELECT s.meeting_id, speaker, any_value(m.hyp) AS mapped_to, sum(total)::BIGINT AS total, sum(correct)::BIGINT AS correct, round(sum(miss))::BIGINT AS miss, round(sum(conf))::BIGINT AS conf, round(sum(fa))::BIGINT AS fa
FROM said s LEFT JOIN mapped m ON m.meeting_id = s.meeting_id AND m.ref = s.speaker GROUP BY 1, 2"""


def _assigned_sql(pick: str) -> str:
    return f"""WITH {SPOKEN_SQL}, met AS (
        SELECT w.meeting_id, seg_no, word_no, label, t0, t1, least(hi, t1) - greatest(lo, t0) AS d FROM words w JOIN turns t ON w.meeting_id = t.meeting_id AND t0 <= hi AND lo <= t1
    ), seen AS (SELECT meeting_id, label, min({{'a': t0, 'b': t1}}) AS seen FROM turns GROUP BY 1, 2
    ), totals AS (
        SELECT meeting_id, seg_no, word_no, label, sum(d) AS total, min(CASE WHEN d > 0 THEN {{'a': t0, 'b': t1, 'c': label}} END) AS first, max(CASE WHEN d > 0 THEN {{'a': t0, 'b': t1, 'c': label}} END) AS last
        FROM met GROUP BY 1, 2, 3, 4
    ), tops AS (
        SELECT *, max(total) OVER (PARTITION BY meeting_id, seg_no, word_no) AS most FROM totals JOIN seen USING (meeting_id, label)
    ), picks AS (
        SELECT meeting_id, seg_no, word_no, {pick} AS label, CASE WHEN count(*) > 1 THEN 'tie' ELSE 'overlap' END AS how FROM tops WHERE total = most AND most > 0 GROUP BY 1, 2, 3
    ), gaps AS (
        SELECT w.meeting_id, w.seg_no, w.word_no, arg_min(label, {{'g': greatest(0, t0 - hi, lo - t1), 'a': t0, 'b': t1}}) AS label FROM words w JOIN turns t ON w.meeting_id = t.meeting_id
        WHERE (w.meeting_id, w.seg_no, w.word_no) NOT IN (SELECT (meeting_id, seg_no, word_no) FROM picks) GROUP BY 1, 2, 3
    ), found AS (SELECT *, lo, hi FROM (SELECT * FROM picks UNION ALL SELECT meeting_id, seg_no, word_no, label, 'nearest' FROM gaps) JOIN words USING (meeting_id, seg_no, word_no))"""


_FLOOR = "arg_min(label, first)"
_ONES = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"
_TENS = "['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"


def _words_sql(n: str) -> str:
    """Words of whole numbers below 10^9."""
    three = lambda x: f"""concat_ws(' ', CASE WHEN {x} >= 100 THEN {_ONES}[({x}) // 100 + 1] || ' hundred' END, CASE WHEN ({x}) % 100 >= 20 THEN {_TENS}[({x}) % 100 // 10 - 1] END,
        CASE WHEN ({x}) % 100 BETWEEN 1 AND 19 THEN {_ONES}[({x}) % 100 + 1] WHEN ({x}) % 100 >= 20 AND ({x}) % 10 > 0 THEN {_ONES}[({x}) % 10 + 1] END)"""  # noqa: E731
    parts = [f"CASE WHEN ({n}) // {s} % 1000 > 0 THEN {three(f'(({n}) // {s} % 1000)')} || '{name}' END" for s, name in ((1000000, " million"), (1000, " thousand"), (1, ""))]
    return f"CASE WHEN ({n}) = 0 THEN 'zero' ELSE concat_ws(' ', {', '.join(parts)}) END"


_RUNS = f"""{FRAMES_SQL}, runs AS (
    SELECT meeting_id, min(frame) AS first, max(frame) AS last, count(*) AS n FROM (
        SELECT *, frame - row_number() OVER (PARTITION BY meeting_id ORDER BY frame) AS island FROM frames WHERE level >= 50) GROUP BY meeting_id, island
)"""


def _joined_sql(last: str, gap: int) -> str:
    return f"""WITH {_RUNS}, grown AS (SELECT meeting_id, first, {last} AS last FROM runs), j AS (
    SELECT meeting_id, min(first) AS first, max(last) AS last, max(last) - min(first) + 1 AS n FROM (
        SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY meeting_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {1 + gap}
                      THEN 0 ELSE 1 END AS new FROM grown)) GROUP BY meeting_id, island
) SELECT meeting_id, first, last, n FROM j"""


_W = r"[\p{L}\p{N}_]"
_EDGE = r"""[.,;:!?"\'()\[\]{}<>-]+""".replace("\\'", "''")
_TIME = lambda x: f"CASE WHEN regexp_replace(printf('%.6f', {x}), '0+$', '') LIKE '%.' THEN regexp_replace(printf('%.6f', {x}), '0+$', '') || '0' ELSE regexp_replace(printf('%.6f', {x}), '0+$', '') END"
_MICRO = f"{_der_sql()}, micro AS (SELECT sum(total)::BIGINT AS total, sum(miss)::BIGINT AS miss, sum(fa)::BIGINT AS fa, sum(conf)::BIGINT AS conf, CASE WHEN sum(total) > 0 THEN (sum(miss) + sum(fa) + sum(conf))::DOUBLE / sum(total)::DOUBLE END AS der FROM der)"
_GATES = f"""{_MICRO}, checks(suite, metric, max, min) AS (VALUES ('core', 'der', 5.0::DOUBLE, NULL::DOUBLE), ('core', 'total', NULL, 1.0), ('strict', 'der', 0.1, NULL), ('strict', 'absent', 1.0, NULL)
), eqs(suite, metric, eq, tol) AS (VALUES ('exact', 'der', 2.5::DOUBLE, 2.5::DOUBLE), ('exact', 'total', 1.0, 0.0)
), m AS (SELECT 'der' AS metric, der AS value FROM micro UNION ALL SELECT 'total', total::DOUBLE FROM micro
), g AS (SELECT suite, metric, value, value IS NOT NULL AND coalesce(value <= max, TRUE) AND coalesce(value >= min, TRUE) AS passed,
        CASE WHEN value IS NULL THEN 'metric not in report' WHEN value > max THEN 'exceeds max' WHEN value < min THEN 'below min' ELSE 'ok' END AS reason FROM checks LEFT JOIN m USING (metric)
    UNION ALL SELECT suite, metric, value, abs(value - eq) <= tol, CASE WHEN abs(value - eq) <= tol THEN 'ok' ELSE 'differs' END FROM eqs LEFT JOIN m USING (metric))"""

ORACLE_SQL = {
    "der_two_label": f"{_der_sql()} SELECT * FROM der",
    "der_collar": f"{_der_sql(COLLAR)} SELECT * FROM der",
    "der_skip_overlap": f"{_der_sql(skip=True)} SELECT * FROM der",
    "jer": _JER,
    "interval_union_touch": f"WITH {SEG_SQL} {_union_sql('seg', False)}",
    "interval_union_strict": f"WITH {SEG_SQL} {_union_sql('seg', True)}",
    "cooccurrence_matrix": f"""{TRACKS_SQL} SELECT r.meeting_id, r.label AS ref, h.label AS hyp, sum(least(r.hi, h.hi) - greatest(r.lo, h.lo))::BIGINT AS shared
        FROM tracks r JOIN tracks h ON r.meeting_id = h.meeting_id AND r.side = 'R' AND h.side = 'H' AND r.lo < h.hi AND h.lo < r.hi GROUP BY 1, 2, 3""",
    "meeting_stats": f"""{TRACKS_SQL}, q AS (
        SELECT meeting_id, t, sum(s) AS s FROM (SELECT meeting_id, lo AS t, 1 AS s FROM tracks WHERE side = 'R' UNION ALL SELECT meeting_id, hi, -1 FROM tracks WHERE side = 'R') GROUP BY 1, 2
    ), c AS (SELECT meeting_id, lead(t) OVER w - t AS d, sum(s) OVER w AS n FROM q WINDOW w AS (PARTITION BY meeting_id ORDER BY t)
    ), z AS (SELECT meeting_id, sum(CASE WHEN n >= 1 THEN d ELSE 0 END)::BIGINT AS speech, sum(CASE WHEN n >= 2 THEN d ELSE 0 END)::BIGINT AS overlap FROM c WHERE d IS NOT NULL GROUP BY 1)
    SELECT *, CASE WHEN speech > 0 THEN overlap::DOUBLE / speech END AS overlap_ratio FROM z""",
    "speaker_count_error": f"""WITH {SEG_SQL}, n AS (SELECT meeting_id, count(DISTINCT label) FILTER (side = 'R') AS n_ref, count(DISTINCT label) FILTER (side = 'H') AS n_hyp FROM seg GROUP BY 1)
        SELECT *, n_hyp - n_ref AS error, abs(n_hyp - n_ref) AS abs_error FROM n""",
    "turn_diff": f"""WITH {SEG_SQL}, r AS (SELECT label, lo // 1000000 AS sec FROM seg WHERE side = 'R'), h AS (SELECT label, lo // 1000000 AS sec FROM seg WHERE side = 'H')
        SELECT 'R' AS side, label, count(*) AS n FROM (FROM r EXCEPT ALL FROM h) GROUP BY 2 UNION ALL SELECT 'H', label, count(*) FROM (FROM h EXCEPT ALL FROM r) GROUP BY 2""",
    "merge_gap": f"""WITH {SEG_SQL}, o AS (
        SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY lo, hi, label, seg_no) AS i FROM seg WHERE side = 'R'
    ), k AS (
        SELECT *, i - row_number() OVER (PARTITION BY meeting_id, label ORDER BY i) AS run FROM o
    ), m AS (
        SELECT *, CASE WHEN lo - max(hi) OVER (PARTITION BY meeting_id, label, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {GAP} THEN 0 ELSE 1 END AS new FROM k
    ), g AS (SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM m)
    SELECT meeting_id, island, label, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY 1, 2, 3""",
    "first_appearance_relabel": f"""WITH {SEG_SQL}, f AS (SELECT meeting_id, label, min({{'lo': lo, 'seg_no': seg_no}}) AS f FROM seg GROUP BY 1, 2)
        SELECT meeting_id, label, 'spk' || (row_number() OVER (PARTITION BY meeting_id ORDER BY f) - 1) AS name FROM f""",
    "macro_average": f"{_der_sql()} SELECT metric, round(avg(value::DOUBLE), 3) AS value, count(value) AS meetings FROM (UNPIVOT (SELECT total, miss, fa, conf FROM der) ON total, miss, fa, conf INTO NAME metric VALUE value) GROUP BY metric",
    "micro_average": f"{_MICRO} SELECT * FROM micro",
    "gate_eval": f"{_GATES} SELECT * FROM g",
    "gate_suite": f"{_GATES} SELECT suite, bool_and(passed) AS passed, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (NOT passed), '') AS failed FROM g GROUP BY suite",
    "normalize_text": rf"""WITH a AS (SELECT conv_id AS meeting_id, turn AS seg_no, regexp_replace(translate(regexp_replace(lower(text), '[-‐-―_/]+', ' ', 'g'), '‘’`´', ''''''''''), '[^\p{{L}}\p{{N}}_\s'']', '', 'g') AS x FROM conversations
    ), b AS (SELECT meeting_id, seg_no, regexp_replace(regexp_replace(x, '({_W})''({_W})', '\1' || chr(1) || '\2', 'g'), '({_W})''({_W})', '\1' || chr(1) || '\2', 'g') AS x FROM a)
    SELECT meeting_id, seg_no, trim(regexp_replace(translate(replace(x, '''', ''), chr(1), ''''), '\s+', ' ', 'g')) AS norm FROM b""",
    "output_tokens": f"""WITH w AS (SELECT conv_id AS meeting_id, turn AS seg_no, list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(regexp_replace(w, '^{_EDGE}', ''), '{_EDGE}$', '')), lambda w: w <> '') AS l FROM conversations)
        SELECT meeting_id, seg_no, (unnest(range(len(l))))::INT AS pos, unnest(l) AS token FROM w""",
    "split_words": """WITH w AS (SELECT conv_id AS meeting_id, turn AS seg_no, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS l FROM conversations),
        x AS (SELECT meeting_id, seg_no, len(l) AS k, unnest(range(len(l))) AS pos, unnest(l) AS w FROM w)
        SELECT meeting_id, seg_no, pos::INT AS pos, w, 60000000 * pos // k AS lo, 60000000 * (pos + 1) // k AS hi FROM x""",
    "mask_runs": f"WITH {_RUNS} SELECT meeting_id, first, last, n FROM runs",
    "hangover": _joined_sql("least(last + 20, (SELECT max(frame) FROM frames f WHERE f.meeting_id = runs.meeting_id))", 0),
    "bridge_silence": _joined_sql("last", 60),
    "drop_short": f"{_joined_sql('last', 60)} WHERE n >= 2",
    "time_text": f"WITH {SEG_SQL} SELECT seg_no, {_TIME('lo / 1e6')} AS t FROM seg",
    "quantise_grid": f"WITH {SEG_SQL} SELECT seg_no, lo // 125 * 125 AS down, (lo + 124) // 125 * 125 AS up FROM seg",
    "replay_window": f"WITH {SEG_SQL} SELECT meeting_id, seg_no, seg_no > coalesce(max(seg_no) OVER (PARTITION BY meeting_id ORDER BY lo, seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS accepted FROM seg",
    "latest_state": f"WITH {SEG_SQL} SELECT meeting_id, max_by(label, seg_no) AS state, count(*) AS events FROM seg GROUP BY 1",
    "paging": """SELECT o_custkey, page, count(*) AS n, min(o_orderkey) AS first FROM (
        SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 10 AS page FROM orders) GROUP BY 1, 2""",
    "seed_hash": """SELECT o_orderkey, list_reduce(list_transform(range(8, 0, -1), lambda i: ('0x' || substr(sha256(o_orderkey || '|' || o_orderpriority), (2 * i - 1)::INT, 2))::INT::HUGEINT), lambda a, b: a * 256 + b)::VARCHAR AS seed FROM orders""",
    "rttm_roundtrip": f"WITH {SEG_SQL} SELECT meeting_id, label, lo, hi FROM seg",
    "stm_roundtrip": f"SELECT conv_id AS meeting_id, role AS label, turn::BIGINT * 10000000 AS lo, turn::BIGINT * 10000000 + 8000000 AS hi, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations",
    "rttm_statistics": f"WITH {SEG_SQL} SELECT meeting_id, count(*) AS lines, count(DISTINCT label) AS speakers, sum(hi - lo)::BIGINT AS duration FROM seg GROUP BY 1",
    "release_digest": f"""WITH {SEG_SQL}, l AS (SELECT meeting_id, lo, hi, label, 'SPEAKER ' || meeting_id || ' 1 ' || {_TIME('lo / 1e6')} || ' ' || {_TIME('(hi - lo) / 1e6')} || ' <NA> <NA> ' || label || ' <NA> <NA>' AS line FROM seg)
        SELECT meeting_id, count(*) AS lines, sha256(string_agg(line, chr(10) ORDER BY lo, hi, label)) AS digest FROM l GROUP BY 1""",
    "der_multi_label": _multi_sql(_MULTI, "TRUE", "SELECT meeting_id, correct FROM best"),
    "overlap_der": _multi_sql(_MAPPED, "r >= 2", _INSIDE),
    "der_per_speaker": _SPEAKERS,
    "word_to_turn_floor": f"{_assigned_sql(_FLOOR)} SELECT meeting_id, seg_no, word_no, label, how FROM found",
    "word_to_turn_latest_start": f"{_assigned_sql('arg_max(label, last)')} SELECT meeting_id, seg_no, word_no, label, how FROM found",
    "word_to_turn_first_seen": f"{_assigned_sql('arg_min(label, seen)')} SELECT meeting_id, seg_no, word_no, label, how FROM found",
    "word_to_turn_previous_word": f"""{_assigned_sql(_FLOOR).replace("WITH", "WITH RECURSIVE", 1)}, ties AS (SELECT meeting_id, seg_no, word_no, list(label) AS labels FROM tops WHERE total = most AND most > 0 GROUP BY 1, 2, 3
        ), placed AS (SELECT meeting_id, seg_no, word_no, label, how, labels, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_no, word_no) AS i FROM found LEFT JOIN ties USING (meeting_id, seg_no, word_no)
        ), walk AS (
            SELECT meeting_id, seg_no, word_no, label, how, i FROM placed WHERE i = 1
            UNION ALL SELECT p.meeting_id, p.seg_no, p.word_no, CASE WHEN p.how = 'tie' AND list_contains(p.labels, w.label) THEN w.label ELSE p.label END, p.how, p.i FROM walk w JOIN placed p ON p.meeting_id = w.meeting_id AND p.i = w.i + 1
        ) SELECT meeting_id, seg_no, word_no, label, how FROM walk""",
    "assignment_stats": f"""{_assigned_sql(_FLOOR)} SELECT meeting_id, count(*) AS words, count(*) FILTER (how = 'overlap') AS overlap, count(*) FILTER (how = 'tie') AS tie, count(*) FILTER (how = 'nearest') AS nearest, 0::BIGINT AS fallback FROM found GROUP BY 1""",
    "speaker_runs": f"""{_assigned_sql(_FLOOR)}, c AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS c FROM found WINDOW w AS (PARTITION BY meeting_id, seg_no ORDER BY word_no)
        ), r AS (SELECT *, sum(c) OVER (PARTITION BY meeting_id, seg_no ORDER BY word_no)::BIGINT AS run FROM c)
        SELECT meeting_id, seg_no, run, label, min(lo) AS lo, greatest(max(hi), min(lo) + 10000) AS hi, string_agg(word, ' ' ORDER BY lo, hi, word_no) AS text FROM r GROUP BY 1, 2, 3, 4""",
    "word_in_turn": f"""WITH {SPOKEN_SQL}, l AS (SELECT w.meeting_id, seg_no, word_no, any_value(hi) AS hi, max({{'a': t0, 'b': t1, 'c': label}}) AS t FROM words w LEFT JOIN turns t ON w.meeting_id = t.meeting_id AND t0 <= lo GROUP BY 1, 2, 3)
        SELECT meeting_id, seg_no, word_no, CASE WHEN t.b >= hi THEN t.c END AS label FROM l""",
    "number_words": f"""SELECT o_orderkey, {_words_sql('o_orderkey')} AS key, {_words_sql('(o_totalprice::DECIMAL(15,2) * 100)::BIGINT // 100')} || ' point ' || {_ONES}[(o_totalprice::DECIMAL(15,2) * 100)::BIGINT % 100 // 10 + 1] || ' ' || {_ONES}[(o_totalprice::DECIMAL(15,2) * 100)::BIGINT % 10 + 1] AS price FROM orders""",
}
