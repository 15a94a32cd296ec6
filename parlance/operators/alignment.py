"""Assignment of words to the turns of speakers, and words as segments.

Words (meeting_id, seg_no, word_no, word, lo, hi) and turns (meeting_id, label, lo, hi), in whole
microseconds. A word takes the label whose turns share most time with it in total. Words
meet the list of the turns of a meeting's time bucket, so a long meeting is spread over
buckets; words that meet no turn look for the nearest one by running values over the
meeting's times, not by a join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Times are whole microseconds, so labels are tied if their totals are equal.
TIE_BREAKS = ("floor", "latest_start", "first_seen", "previous_word")
#: Shortest segment that a run of words gives.
SHORTEST = 10_000
BUCKET = 60_000_000
WORD = ("meeting_id", "seg_no", "word_no")
#: Label of words in meetings without turns.
FALLBACK = "spk"


def _touching(words: DataFrame, turns: DataFrame, bucket: int) -> DataFrame:
    """``own`` (all of a word) and ``touch``: the turns (t0, t1, label and what else they have) that share time with it or touch it.

    The turns of a bucket are one list. A word in one bucket meets them where it is; only what longer words meet is put
    together by word."""
    rest = [c for c in turns.columns if c not in ("meeting_id", "label", "lo", "hi")]
    spread = turns.withColumn("bucket", F.explode(F.sequence(F.expr(f"lo div {bucket}"), F.expr(f"hi div {bucket}"))))
    listed = spread.groupBy("meeting_id", "bucket").agg(F.collect_list(F.struct(F.col("lo").alias("t0"), F.col("hi").alias("t1"), "label", *rest)).alias("around"))
    rows = words.select("meeting_id", F.struct(*words.columns).alias("own"), F.expr(f"lo div {bucket}").alias("bucket"), F.expr(f"hi div {bucket}").alias("end"))
    near = lambda x: (x["t0"] <= F.col("own.hi")) & (F.col("own.lo") <= x["t1"])
    once = lambda x: near(x) & (F.call_function("div", F.greatest(F.col("own.lo"), x["t0"]), F.lit(bucket)) == F.col("bucket"))
    short = rows.where("bucket <=> end").join(listed, ["meeting_id", "bucket"], "left")
    long = rows.where("not bucket <=> end").withColumn("row", F.monotonically_increasing_id())
    long = long.select("meeting_id", "own", "row", F.explode_outer(F.sequence("bucket", "end")).alias("bucket")).join(listed, ["meeting_id", "bucket"], "left")
    whole = long.withColumn("touch", F.filter("around", once)).groupBy("row").agg(F.first("own").alias("own"), F.flatten(F.collect_list("touch")).alias("touch"))
    return short.select("own", F.coalesce(F.filter("around", near), F.array()).alias("touch")).unionByName(whole.select("own", "touch"))


def nearest_turn(words: DataFrame, turns: DataFrame) -> DataFrame:
    """``words`` with ``near``: label of the turn at the smallest gap, for words that touch none.

    Of equal gaps the earliest turn. The last turn to end before the word, and the first to start
    after it, are carried along the meeting's times.
    """
    kind = turn_type(turns)
    none, turn = F.lit(None).cast(kind), F.struct("t0", "t1", "label")
    t = turns.select("meeting_id", F.col("lo").alias("t0"), F.col("hi").alias("t1"), "label")
    ends = t.select("meeting_id", F.col("t1").alias("at"), turn.alias("before"), none.alias("after"))
    starts = t.select("meeting_id", F.col("t0").alias("at"), none.alias("before"), turn.alias("after"))
    w = words.select("meeting_id", F.col("lo").alias("at"), none.alias("before"), none.alias("after"), F.struct(*words.columns).alias("own"))
    rows = w.unionByName(ends, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True)
    up = Window.partitionBy("meeting_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("meeting_id").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # the latest end, of equal ones the earliest turn; the earliest start
    last = F.max(F.when(F.col("before").isNotNull(), F.struct(F.col("before.t1").alias("t1"), (-F.col("before.t0")).alias("back"), F.col("before.label").alias("label")))).over(up)
    first = F.min("after").over(down)
    found = rows.withColumns({"last": last, "first": first}).where("own is not null")
    past, ahead = F.col("own.lo") - F.col("last.t1"), F.col("first.t0") - F.col("own.hi")
    near = F.when(past.isNull() | (ahead < past), F.col("first.label")).otherwise(F.col("last.label"))
    return found.select("own.*", near.alias("near"))


def turn_type(turns: DataFrame) -> str:
    return f"struct<t0:bigint,t1:bigint,label:{turns.schema['label'].dataType.simpleString()}>"


def assign_each(words: DataFrame, turns: DataFrame, rules: tuple[str, ...] = TIE_BREAKS[:3], bucket: int = BUCKET, fallback: str = FALLBACK) -> DataFrame:
    """``words`` with how (overlap, tie, nearest or fallback), tied (the tied labels of a tie) and the label under each of
    the ``rules``, all from one meeting of words and turns. ``previous_word`` isn't among them: it follows from floor and tied."""
    turns = turns.where("hi >= lo")
    met = turns.withColumn("seen", F.min(F.struct("lo", "hi")).over(Window.partitionBy("meeting_id", "label"))) if "first_seen" in rules else turns
    rows = _touching(words, met.select("meeting_id", "label", "lo", "hi", *(["seen"] if "first_seen" in rules else [])), bucket)
    shared = lambda x: F.least(F.col("own.hi"), x["t1"]) - F.greatest(F.col("own.lo"), x["t0"])
    total = lambda name: F.aggregate("touch", F.lit(0).cast("long"), lambda n, x: n + F.when(x["label"].eqNullSafe(name), shared(x)).otherwise(0))
    rows = rows.withColumn("totals", F.transform(F.array_distinct(F.transform("touch", lambda x: x["label"])), lambda name: F.struct(total(name).alias("total"), name.alias("label"))))
    rows = rows.withColumn("most", F.greatest(F.lit(1), F.array_max(F.transform("totals", lambda x: x["total"]))))
    rows = rows.withColumn("tied", F.array_sort(F.transform(F.filter("totals", lambda x: x["total"] == F.col("most")), lambda x: x["label"])))
    rows = rows.withColumn("won", F.filter("touch", lambda x: (shared(x) > 0) & F.exists("tied", lambda name: name.eqNullSafe(x["label"]))))
    turn = lambda x: F.struct(x["t0"], x["t1"], x["label"])
    picks = {
        "floor": lambda: F.array_min(F.transform("won", turn))["label"],
        "latest_start": lambda: F.array_max(F.transform("won", turn))["label"],
        "first_seen": lambda: F.array_min(F.transform("won", lambda x: F.struct(x["seen"], x["label"])))["label"],
    }
    touched = F.array_min(F.transform("touch", turn))["label"]
    how = F.when(F.size("tied") > 1, "tie").when(F.size("tied") == 1, "overlap").otherwise("nearest")
    found = rows.where(F.size("touch") > 0).select("own.*", how.alias("how"), "tied", *[F.coalesce(picks[r](), touched).alias(r) for r in rules])
    near = nearest_turn(rows.where(F.size("touch") == 0).select("own.*"), turns)
    way, none = F.when(F.col("near").isNull(), "fallback").otherwise("nearest"), F.array().cast(found.schema["tied"].dataType)
    label = F.coalesce("near", F.lit(fallback))
    return found.unionByName(near.select(*words.columns, way.alias("how"), none.alias("tied"), *[label.alias(r) for r in rules]))


def assign(words: DataFrame, turns: DataFrame, tie_break: str = "floor", bucket: int = BUCKET, fallback: str = FALLBACK) -> DataFrame:
    """``words`` with label and how: overlap, tie, nearest or fallback.

    Ties go to the tied label whose overlapping turn started first (``floor``) or last
    (``latest_start``), that appears first in the meeting (``first_seen``), or of the word before if it is
    tied, else as ``floor`` (``previous_word``).
    """
    if tie_break not in TIE_BREAKS:
        raise ValueError(f"tie_break is one of {', '.join(TIE_BREAKS)}, not {tie_break!r}")
    rule = "floor" if tie_break == "previous_word" else tie_break
    found = assign_each(words, turns, (rule,), bucket, fallback).select(*words.columns, F.col(rule).alias("label"), "how", "tied")
    found = previous(found) if tie_break == "previous_word" else found
    return found.select(*words.columns, "label", "how")


def assign_whole(segments: DataFrame, words: DataFrame, turns: DataFrame, tie_break: str = "floor", shortest: int = SHORTEST) -> DataFrame:
    """meeting_id, seg_no, label, lo, hi, text, how of the segments (meeting_id, seg_no, lo, hi, text) that have a text but no
    words: each takes a label as a word would. No word comes before it, so ``previous_word`` is ``floor``."""
    bare = segments.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(words.select("meeting_id", "seg_no").distinct(), ["meeting_id", "seg_no"], "left_anti")
    as_words = bare.select("meeting_id", "seg_no", F.lit(0).alias("word_no"), F.col("text").alias("word"), "lo", "hi")
    found = assign(as_words, turns, "floor" if tie_break == "previous_word" else tie_break)
    return found.select("meeting_id", "seg_no", "label", "lo", F.greatest("hi", F.col("lo") + shortest).alias("hi"), F.col("word").alias("text"), "how")


def previous(found: DataFrame, floor: str = "label", name: str = "label") -> DataFrame:
    """``found`` less tied, with labels ``name`` by ``previous_word``, given those by floor: a tied word follows the word
    before it, which may itself have followed: one pass in order."""
    kept = [f for f in found.schema if f.name not in ("tied", name)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{name}` {found.schema[floor].dataType.simpleString()}"

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seg_no", "ascending"), ("word_no", "ascending")])
        out, before = [], None
        for own, how, tied in zip(*(table.column(c).to_pylist() for c in (floor, "how", "tied"))):
            before = before if how == "tie" and before in tied else own
            out.append(before)
        return table.select([f.name for f in kept]).append_column(name, pa.array(out, pa.string()))

    return found.groupBy("meeting_id").applyInArrow(follow, kinds)


def assignment_stats(assigned: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """meeting_id and how many words came by each way; with ``whole`` (``assign_whole``) the segments without words, too."""
    ways = [F.count_if(F.col("how") == x).alias(x) for x in ("overlap", "tie", "nearest", "fallback")]
    found = assigned.groupBy("meeting_id").agg(F.count("*").alias("words"), *ways)
    if whole is None:
        return found
    bare = whole.groupBy("meeting_id").agg(F.count("*").alias("segments_without_words"))
    both = found.join(bare, "meeting_id", "full_outer")
    return both.select("meeting_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in both.columns if c != "meeting_id"])


def speaker_runs(assigned: DataFrame, shortest: int = SHORTEST, by: tuple[str, ...] = (), **sums) -> DataFrame:
    """Consecutive words of one label in a segment as one: meeting_id, seg_no, run, label, lo, hi, text.

    A run is never shorter than ``shortest``. Rows that differ in columns ``by`` are apart; ``sums``: more aggregates."""
    keys = ("meeting_id", "seg_no", *by)
    order = Window.partitionBy(*keys).orderBy("word_no")
    change = F.when(F.lag("label").over(order).eqNullSafe(F.col("label")), 0).otherwise(1)
    marked = assigned.withColumn("change", change).withColumn("run", F.sum("change").over(order))
    words = F.array_sort(F.collect_list(F.struct("lo", "hi", "word_no", "word")))
    runs = marked.groupBy(*keys, "run", "label").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), words.alias("w"), *[c.alias(n) for n, c in sums.items()])
    return runs.select(*keys, "run", "label", "lo", F.greatest("hi", F.col("lo") + shortest).alias("hi"), F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"), *sums)


def split_words(words: DataFrame, tokens) -> DataFrame:
    """A word whose text has k tokens becomes k words that share its time equally; one without is
    dropped. ``tokens``: column of arrays of text."""
    cut = words.withColumn("hi", F.greatest("lo", "hi")).withColumn("k", F.size(tokens)).select("*", F.posexplode(tokens).alias("i", "token"))
    lo = F.expr("lo + (hi - lo) * i div k")
    hi = F.expr("lo + (hi - lo) * (i + 1) div k")
    return cut.select(*[c for c in words.columns if c not in ("word", "lo", "hi", "word_no")], F.struct("word_no", "i").alias("place"), F.col("token").alias("word"), lo.alias("lo"), hi.alias("hi"))


def contained(words: DataFrame, turns: DataFrame) -> DataFrame:
    """``words`` with the label of the last turn that starts at or before each and covers it, or null."""
    t = turns.select("meeting_id", F.col("lo").alias("at"), F.struct(F.col("lo").alias("t0"), F.col("hi").alias("t1"), "label").alias("turn"))
    rows = words.withColumn("at", F.col("lo")).withColumn("row", F.monotonically_increasing_id()).unionByName(t, allowMissingColumns=True)
    order = Window.partitionBy("meeting_id").orderBy("at", F.col("turn").isNull(), "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("last", F.last("turn", ignorenulls=True).over(order)).where("row is not null")
    covers = F.when(F.col("last.t1") >= F.col("hi"), F.col("last.label"))
    return found.select(*words.columns, covers.alias("label"))
