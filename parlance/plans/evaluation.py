"""Evaluation of hypotheses against references: scores of every meeting, roll-ups, gates, reports.

From folders of documents or from tables of segments; every meeting is one group of a few
shuffles, and what can't be scored is a row with its reason, never dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.operators import alignment, reports, scoring, text, words
from parlance.sources import documents

DER_COLLAR = 250_000
HEADLINE = (("cpWER", "cpwer.error_rate"), ("tcpWER", "tcpwer.error_rate"), ("WER", "wer_concat.wer"), ("DER", "der.der"), ("JER", "jer.jer"), ("speakers off", "speaker_count.error"))


def pairs(refs: DataFrame, hyps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Meetings (meeting_id) that are on both sides, and status of all: scored, missing (no
    hypothesis) or unknown (no reference)."""
    r, h = (df.select("meeting_id").distinct().withColumn(name, F.lit(True)) for df, name in ((refs, "r"), (hyps, "h")))
    both = r.join(h, "meeting_id", "full_outer")
    status = F.when(F.col("h").isNull(), "missing").when(F.col("r").isNull(), "unknown").otherwise("scored")
    rows = both.select("meeting_id", status.alias("status"))
    return rows.where("status = 'scored'").select("meeting_id"), rows


def flat(segments: DataFrame, collar: int = DER_COLLAR, skip_overlap: bool = False, tcp_collar: int = words.TCP_COLLAR, **normaliser: bool) -> DataFrame:
    """A wide row per meeting of all metrics. segments: meeting_id, side, label, lo, hi, text and, if each
    meeting's scored region is known, duration."""
    der = scoring.meeting_scores(segments, collar, None, skip_overlap)
    seconds = lambda c: (F.col(c) / 1e6)
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    wrong = F.col("miss") + F.col("fa") + F.col("conf")
    overlap = F.col("overlap_miss") + F.col("overlap_fa") + F.col("overlap_conf")
    one = der.select(
        "meeting_id",
        F.try_divide(wrong, F.col("total")).alias("der.der"),
        *[seconds(a).alias(f"der.{b}") for a, b in (("total", "total"), ("miss", "miss"), ("fa", "false_alarm"), ("conf", "confusion"), ("correct", "correct"))],
        *[rate(a, "total").alias(f"der.{b}_rate") for a, b in (("miss", "miss"), ("fa", "false_alarm"), ("conf", "confusion"))],
        F.try_divide(overlap, F.col("overlap_total")).alias("der.overlap.der"),
        seconds("overlap_total").alias("der.overlap.total"),
        (overlap / 1e6).alias("der.overlap.error"),
        seconds("overlap_time").alias("der.overlap.overlap_time"),
        F.col("jer").alias("jer.jer"),
        F.col("n_ref").alias("jer.speaker_count"),
        F.coalesce(F.col("jer") * F.col("n_ref"), F.lit(0.0)).alias("jer.speaker_error"),
    )
    spoken = segments.withColumn("tokens", text.split_words(text.normalise(F.col("text"), **normaliser)))
    wer = words.word_errors(spoken, tcp_collar)
    two = wer.select(
        "meeting_id",
        *[F.col(f"{k}.{a}").alias(f"wer_{k}.{b}") for k in ("literal", "concat") for a, b in (("rate", "wer"), ("errors", "errors"), ("length", "reference_words"))],
        *[F.col(f"cp.{a}").alias(f"cpwer.{b}") for a, b in (("rate", "error_rate"), ("errors", "errors"), ("length", "length"), ("missed_speakers", "missed_speaker"), ("false_speakers", "falarm_speaker"))],
        *[F.col(f"tcp.{a}").alias(f"tcpwer.{b}") for a, b in (("rate", "error_rate"), ("errors", "errors"), ("length", "length"))],
        "refused",
    )
    names = lambda side: F.count_distinct(F.when(F.col("side") == side, F.col("label")))
    three = segments.groupBy("meeting_id").agg(names("R").alias("speaker_count.reference_active"), names("H").alias("speaker_count.hypothesis"))
    error = F.col("`speaker_count.hypothesis`") - F.col("`speaker_count.reference_active`")
    three = three.withColumns({"speaker_count.error": error, "speaker_count.abs_error": F.abs(error)})
    return one.join(two, "meeting_id", "full_outer").join(three, "meeting_id", "full_outer")


def long(scores: DataFrame) -> DataFrame:
    """meeting_id, metric, value, refused of ``flat``: one row per meeting and metric."""
    names = [c for c in scores.columns if c not in ("meeting_id", "refused", "der.overlap.error")]
    each = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])
    return scores.select("meeting_id", F.explode(each).alias("x"), "refused").select("meeting_id", "x.metric", "x.value", "refused")


def macro(scores: DataFrame) -> DataFrame:
    """metric, value, meetings, not_scored: unweighted means over the meetings that have a value."""
    refused = F.col("refused").isNotNull() & (F.col("metric").startswith("cpwer.") | F.col("metric").startswith("tcpwer."))
    return long(scores).groupBy("metric").agg(F.avg("value").alias("value"), F.count("value").alias("meetings"), F.count_if(refused).alias("not_scored"))


#: Rates over all meetings: sums of one column by sums of another.
POOLED = {
    "der.miss_rate": ("der.miss", "der.total"),
    "der.false_alarm_rate": ("der.false_alarm", "der.total"),
    "der.confusion_rate": ("der.confusion", "der.total"),
    "der.overlap.der": ("der.overlap.error", "der.overlap.total"),
    "jer.jer": ("jer.speaker_error", "jer.speaker_count"),
    "wer_literal.wer": ("wer_literal.errors", "wer_literal.reference_words"),
    "wer_concat.wer": ("wer_concat.errors", "wer_concat.reference_words"),
    "cpwer.error_rate": ("cpwer.errors", "cpwer.length"),
    "tcpwer.error_rate": ("tcpwer.errors", "tcpwer.length"),
}


def micro(scores: DataFrame) -> DataFrame:
    """metric, value, meetings, not_scored: pooled over meetings; refused meetings have no part in the pools of
    permutations. Sums of errors, lengths and times are metrics of their own."""
    total = lambda c: F.sum(F.col(f"`{c}`"))
    wrong = total("der.miss") + total("der.false_alarm") + total("der.confusion")
    values = {"der.der": F.try_divide(wrong, total("der.total"))} | {k: F.try_divide(total(a), total(b)) for k, (a, b) in POOLED.items()}
    sums = sorted({c for ab in POOLED.values() for c in ab if c != "der.overlap.error"} | {"cpwer.missed_speaker", "cpwer.falarm_speaker", "der.correct", "der.overlap.overlap_time"})
    values |= {c: total(c) for c in sums}
    values |= {f"speaker_count.{c}": F.avg(F.col(f"`speaker_count.{c}`")) for c in ("error", "abs_error")}
    values |= {c: total(c) for c in ("der.miss", "der.false_alarm", "der.confusion", "der.overlap.error") if c not in values}
    permuted = lambda k: k.startswith(("cpwer.", "tcpwer."))
    scored = {"all": F.count("*"), "permuted": F.count_if(F.col("refused").isNull())}
    row = scores.agg(*[v.cast("double").alias(k) for k, v in values.items()], *[v.alias(k) for k, v in scored.items()])
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("value"), F.col("permuted" if permuted(k) else "all").alias("meetings"), (F.col("all") - F.col("permuted") if permuted(k) else F.lit(0)).cast("long").alias("not_scored")) for k in values])
    return row.select(F.explode(each).alias("x")).select("x.*")


def gated(scores: DataFrame, checks: DataFrame) -> DataFrame:
    """``reports.gates`` of the macro averages: what wasn't scored on some meeting fails."""
    return reports.gates(checks, macro(scores))


def gated_each(scores: DataFrame, checks: DataFrame) -> DataFrame:
    """``reports.gates`` of every meeting on its own, with meeting_id; a meeting without a metric fails its check."""
    values = long(scores)
    refused = F.col("refused").isNotNull() & (F.col("metric").startswith("cpwer.") | F.col("metric").startswith("tcpwer."))
    each = values.select("meeting_id", "metric", "value", F.when(refused, 1).otherwise(0).cast("long").alias("not_scored"))
    asked = scores.select("meeting_id").crossJoin(F.broadcast(checks))  # a list that a person wrote
    return reports.judged(asked.join(each.withColumn("there", F.lit(True)), ["meeting_id", "metric"], "left"))


#: Rolled up per dataset and system, per system, and over all.
ROLLUPS = (("dataset", "system", "variant"), ("dataset", "system"), ("system",), ())
#: A rate, and the columns whose sums give it over meetings.
SUMS = {
    "der.der": (("der.miss", "der.false_alarm", "der.confusion"), "der.total"),
    "jer.jer": (("jer.speaker_error",), "jer.speaker_count"),
    "cpwer.error_rate": (("cpwer.errors",), "cpwer.length"),
    "tcpwer.error_rate": (("tcpwer.errors",), "tcpwer.length"),
    "wer_concat.wer": (("wer_concat.errors",), "wer_concat.reference_words"),
}


def summary(scores: DataFrame, keys: tuple[str, ...] = ROLLUPS[0], sets: tuple[tuple[str, ...], ...] = ROLLUPS) -> DataFrame:
    """keys, level, metric, macro, micro, meetings of scores with the columns ``keys``: the mean over meetings and
    the rate of their sums, for every set of keys in ``sets``; level is the number of keys left out.

    One pass: the metrics of a meeting are rows of value, errors and length, and the sets are grouping sets.
    A key that is null itself is told from one left out by ``level``.
    """
    column = lambda n: F.col(f"`{n}`").cast("double")
    parts = [F.struct(F.lit(m).alias("metric"), column(m).alias("value"), sum(map(column, a), F.lit(0.0)).alias("errors"), column(b).alias("length")) for m, (a, b) in SUMS.items()]
    rows = scores.select(*keys, F.explode(F.array(*parts)).alias("x")).select(*keys, "x.*")
    grouped = rows.groupingSets([[F.col(k) for k in (*s, "metric")] for s in sets], *keys, "metric")
    pooled = F.try_divide(F.sum(F.when(F.col("value").isNotNull(), F.col("errors"))), F.sum(F.when(F.col("value").isNotNull(), F.col("length"))))
    level = F.bit_count(F.grouping_id())
    return grouped.agg(level.cast("int").alias("level"), F.avg("value").alias("macro"), pooled.alias("micro"), F.count("value").alias("meetings"))


def markdown(scores: DataFrame) -> DataFrame:
    """part, meeting_id, line: the headline table, its two first lines and one for each meeting; to be written in the
    order of part and meeting_id."""
    cell = lambda m: F.coalesce(F.format_string("%.4f", F.col(f"`{m}`").cast("double")), F.lit("–"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("meeting_id").cast("string"), *[cell(m) for _, m in HEADLINE]), F.lit(" |"))
    head = ["| meeting | " + " | ".join(n for n, _ in HEADLINE) + " |", "|---|" + "---:|" * len(HEADLINE)]
    kind = scores.schema["meeting_id"].dataType.simpleString()
    first = scores.sparkSession.createDataFrame(list(enumerate(head)), "part int, line string").select("part", F.lit(None).cast(kind).alias("meeting_id"), "line")
    return first.unionByName(scores.select(F.lit(len(head)).alias("part"), "meeting_id", line.alias("line")))


def report(scores: DataFrame, kind: str) -> DataFrame:
    """meeting_id, value: a JSON report of each meeting's metrics."""
    body = F.struct(*[F.col(f"`{c}`") for c in scores.columns if c not in ("meeting_id", "der.overlap.error")])
    return scores.select("meeting_id", F.to_json(F.struct(F.lit(kind).alias("kind"), F.col("meeting_id").cast("string").alias("meeting_id"), body.alias("metrics"))).alias("value"))


def evaluate(spark: SparkSession, refs: str, hyps: str, meeting_schema: str, hypothesis_schema: str, reader=documents.read, **options) -> tuple[DataFrame, DataFrame]:
    """Scores of all meetings below a folder, and a status row for each document: scored, missing, unknown,
    or refused with its errors. ``reader`` gives the documents of a folder: its JSON files, or those of bundles."""
    r = documents.meetings(reader(spark, refs), meeting_schema)
    h = documents.hypotheses(reader(spark, hyps), hypothesis_schema)
    good_r, good_h = documents.good(r), documents.good(h)
    both, status = pairs(good_r, good_h)
    duration = good_r.select("meeting_id", F.round(F.col("duration_s") * 1e6).cast("long").alias("duration"))
    rows = documents.segments(good_r, "R").unionByName(documents.segments(good_h, "H"))
    scores = flat(rows.join(both, "meeting_id", "left_semi").join(duration, "meeting_id"), **options)
    bad = r.select("meeting_id", "path", "errors").unionByName(h.select("meeting_id", "path", "errors")).where("size(errors) > 0")
    refused = bad.select("meeting_id", F.lit("refused").alias("status"), "path", "errors")
    none = F.lit(None)
    return scores, status.select("meeting_id", "status", none.cast("string").alias("path"), none.cast("array<string>").alias("errors")).unionByName(refused)


def tie_breaks(refs: DataFrame, spoken: DataFrame, turns: DataFrame) -> DataFrame:
    """rule, micro, macro, meetings, not_scored, ties: cpWER of words (meeting_id, seg_no, word_no, word, lo,
    hi) under each way to break ties between the labels of turns, against refs (meeting_id, label, lo, hi, tokens).

    Words are assigned once. Only segments that the rules label apart have runs for each rule, and meetings
    without such a segment are scored once."""
    spark, rules = spoken.sparkSession, alignment.TIE_BREAKS
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = alignment.assign_each(spoken, turns).repartition(parts, "meeting_id")
    told = told.withColumn("any", F.max(F.col("how") == "tie").over(Window.partitionBy("meeting_id")))
    tied = alignment.previous(told.where("any"), "floor", "previous_word")
    apart = F.max(F.expr(" or ".join(f"not floor <=> {r}" for r in rules[1:]))).over(Window.partitionBy("meeting_id", "seg_no"))
    each = lambda *names: F.array(*[F.struct(F.lit(n).cast("string").alias("rule"), F.col(n or "floor").alias("label")) for n in names])
    tied = tied.withColumn("apart", apart).withColumn("x", F.explode(F.when(F.col("apart"), each(*rules)).otherwise(each(None)))).select("*", "x.*")
    plain = told.where("not any").select("*", F.lit(None).cast("string").alias("rule"), F.col("floor").alias("label"))
    ties = F.count_if(F.col("how") == "tie")
    runs = alignment.speaker_runs(plain, by=("rule",), ties=ties).unionByName(alignment.speaker_runs(tied, by=("rule",), ties=ties))
    own = runs.select("meeting_id", F.lit("H").alias("side"), "label", "lo", "hi", text.split_words(text.normalise(F.col("text"))).alias("tokens"), "seg_no", "run", "rule", "ties")
    both = refs.select("meeting_id", F.lit("R").alias("side"), "label", "lo", "hi", "tokens").unionByName(own, allowMissingColumns=True)
    scores = words.word_errors(both, kinds=("cp",), order=("seg_no", "run"), variant="rule", variants=rules, summed="ties")
    rates = words.pooled(scores, "cp", ("rule",), F.sum("ties").alias("ties"))
    names = spark.createDataFrame([(r,) for r in rules], "rule string")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return names.join(rates, "rule", "left").select("rule", "micro", "macro", count("meetings"), count("not_scored"), count("ties"))
