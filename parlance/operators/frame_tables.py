"""Tables of frames: thresholds between classes, exact percentiles, moving windows, votes of overlapping
chunks, and turns cut from them. Levels and frames are grouped by meeting; no step needs a
meeting's frames in one task but where a docstring says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_largest(value: str, *place: str) -> Column:
    """Aggregate: the place of the largest value, the first of equal ones."""
    return F.min_by(F.struct(*place) if len(place) > 1 else F.col(place[0]), F.struct((-F.col(value)).alias("v"), *place))


def class_threshold(levels: DataFrame, width: float = 0.5) -> DataFrame:
    """meeting_id, threshold: where the levels (meeting_id, level) part into two classes of the largest
    variance between them (Otsu), by bins of about ``width``; the lower of equal bins.

    Levels within two widths are one class, with their highest as threshold. Null levels don't count. The
    levels are counted by bin with map-side combination; running sums go over a meeting's filled bins,
    which its range of levels bounds. An empty bin has the variance of the one below it, so it never counts.
    """
    levels = levels.where("level is not null")
    extent = levels.groupBy("meeting_id").agg(F.min("level").cast("double").alias("lo"), F.max("level").cast("double").alias("hi"))
    extent = extent.withColumn("bins", F.greatest(F.lit(2), F.ceil((F.col("hi") - F.col("lo")) / width)).cast("long"))
    edge = lambda i: F.when(i == F.col("bins"), F.col("hi")).otherwise(i * ((F.col("hi") - F.col("lo")) / F.col("bins")) + F.col("lo"))
    split = levels.join(extent, "meeting_id").where(F.col("hi") - F.col("lo") >= 2 * width)
    at = F.least(F.floor((F.col("level") - F.col("lo")) * (F.col("bins") / (F.col("hi") - F.col("lo")))), F.col("bins") - 1)
    split = split.withColumn("at", at)
    # a level on the other side of a rounded edge goes there
    at = F.when(F.col("level") < edge(F.col("at")), F.col("at") - 1).when((F.col("level") >= edge(F.col("at") + 1)) & (F.col("at") < F.col("bins") - 1), F.col("at") + 1).otherwise(F.col("at"))
    counts = split.withColumn("bin", at).groupBy("meeting_id", "bin", "lo", "hi", "bins").agg(F.count("*").alias("n"))
    middle = (edge(F.col("bin")) + edge(F.col("bin") + 1)) * 0.5
    below, all_ = Window.partitionBy("meeting_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("meeting_id")
    sums = counts.withColumn("s", F.col("n") * middle).select(
        "*", F.sum("n").over(below).alias("n0"), F.sum("n").over(all_).alias("total"), F.sum("s").over(below).alias("s0"), F.sum("s").over(all_.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("sum")
    )
    n1 = F.col("total") - F.col("n0")
    apart = F.col("s0") / F.col("n0") - (F.col("sum") - F.col("s0")) / F.greatest(n1, F.lit(1))
    between = sums.withColumns({"between": F.col("n0") * n1 * apart * apart, "edge": edge(F.col("bin") + 1)})
    best = between.groupBy("meeting_id").agg(first_largest("between", "bin", "edge").alias("best"))
    return extent.join(best, "meeting_id", "left").select("meeting_id", F.coalesce("best.edge", "hi").alias("threshold"))


def percentiles(levels: DataFrame, shares: dict[str, float]) -> DataFrame:
    """meeting_id and a column for each share: the exact percentiles of the levels, interpolated between ranks.

    Equal levels are counted once; the counts are sorted over all meetings by range, so that a
    meeting may reach over many tasks, and ranks are running counts within a task's part plus what the
    parts before it hold. Null and NaN levels don't count.
    """
    counts = levels.where("level is not null and not isnan(level)").groupBy("meeting_id", F.col("level").cast("double").alias("level")).agg(F.count("*").alias("n"))
    placed = counts.repartitionByRange("meeting_id", "level").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part", "meeting_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy("part", "meeting_id").agg(F.sum("n").alias("held"))
    meeting = Window.partitionBy("meeting_id")  # a row for each part that a meeting reaches
    parts = parts.select("part", "meeting_id", (F.sum("held").over(meeting.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("before"), F.sum("held").over(meeting).alias("total"))
    ranked = placed.withColumn("upto", F.sum("n").over(inside)).join(parts, ["part", "meeting_id"])
    end = F.col("before") + F.col("upto")
    found = []
    for name, share in shares.items():
        at = (F.col("total") - 1) * share
        has = lambda rank: F.when((rank >= end - F.col("n")) & (rank < end), F.col("level"))
        found += [F.max(has(F.floor(at))).alias(f"{name}_lo"), F.max(has(F.ceil(at))).alias(f"{name}_hi"), F.max(at - F.floor(at)).alias(f"{name}_part")]
    one = lambda n: (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n)
    return ranked.groupBy("meeting_id").agg(*found).select("meeting_id", *[one(n) for n in shares])


def _middle(sorted_: Column) -> Column:
    n = F.size(sorted_)
    return F.when(n > 0, (sorted_[F.floor((n - 1) / 2).cast("int")] + sorted_[F.floor(n / 2).cast("int")]) / 2)


def moving(frames: DataFrame, step: int, steps: int, least: int = 1, octave_share: float = 0.0, octave: float = 12.0, near: float = 3.0) -> DataFrame:
    """meeting_id, first, n, mean, voiced, median: of frames (meeting_id, frame, level, pitch or null) in windows
    of ``steps`` times ``step`` frames that begin at each multiple of ``step`` with frames of its own.

    The median of the pitches is null for fewer than ``least``. If ``octave_share`` of them lie about an octave
    below it, it is the median of these. Frames are gathered once, by step; a window reads the steps
    that it covers, so no frame is copied into windows. A step's and a window's pitches are one array.
    """
    cells = frames.groupBy("meeting_id", F.floor(F.col("frame") / step).alias("cell")).agg(F.count("level").alias("n"), F.sum("level").alias("s"), F.collect_list("pitch").alias("pitches"))
    window = Window.partitionBy("meeting_id").orderBy("cell").rangeBetween(0, steps - 1)
    seen = cells.select("meeting_id", "cell", F.sum("n").over(window).alias("n"), F.sum("s").over(window).alias("s"), F.array_sort(F.flatten(F.collect_list("pitches").over(window))).alias("p"))
    middle = seen.withColumn("m", _middle(F.col("p")))
    lower = middle.withColumn("low", F.filter("p", lambda x: F.abs(x - (F.col("m") - octave)) <= near))
    low = F.lit(octave_share > 0) & (F.size("low") > 0) & (F.size("low") >= F.size("p") * octave_share)
    median = F.when(F.size("p") >= max(1, least), F.when(low, _middle(F.col("low"))).otherwise(F.col("m")))
    return lower.select("meeting_id", (F.col("cell") * step).alias("first"), "n", F.try_divide("s", "n").alias("mean"), F.size("p").cast("long").alias("voiced"), median.alias("median"))


def votes(activity: DataFrame, clusters: DataFrame, shift: int) -> DataFrame:
    """meeting_id, frame, cluster, n: how many chunks are for a cluster in a frame.

    activity: meeting_id, chunk, speaker, at: frames of a chunk in which one of its own speakers is
    active; chunks begin ``shift`` frames apart. clusters: meeting_id, chunk, speaker, cluster; speakers of a
    chunk without one don't vote, several of one cluster vote once.
    """
    of = activity.join(clusters, ["meeting_id", "chunk", "speaker"])
    once = of.select("meeting_id", "chunk", (F.col("chunk") * shift + F.col("at")).alias("frame"), "cluster").distinct()
    return once.groupBy("meeting_id", "frame", "cluster").agg(F.count("*").alias("n"))


def speakers_per_frame(activity: DataFrame, chunks: DataFrame, shift: int, width: int, silent: bool = True) -> DataFrame:
    """meeting_id, frame, k: active speakers of a frame over the chunks (meeting_id, chunk) that cover it, half up.

    In single precision, as the sum, the weight and their quotient are. Frames that no chunk covers have no row;
    those that are covered without activity have a row with a k of 0, unless not ``silent``.

    How many chunks cover a frame is counted by slots of ``shift`` frames, which a chunk covers wholly but for its last.
    Only ``silent`` frames are written out, from their slots; without them there are as many rows as active frames.
    """
    at = F.col("chunk") * shift + F.col("at")
    active = activity.select("meeting_id", "chunk", "speaker", "at").distinct()
    counts = active.groupBy("meeting_id", at.alias("frame")).agg(F.count("*").alias("n"))
    parts = F.transform(F.sequence(F.lit(0), F.lit((width - 1) // shift)), lambda i: F.struct((F.col("chunk") + i).alias("slot"), F.least(F.lit(shift), width - i * shift).alias("held")))
    slots = chunks.select("meeting_id", "chunk").distinct().select("meeting_id", F.explode(parts).alias("x"))
    # a slot's frames from its last chunk's end on are covered by the others alone
    slots = slots.groupBy("meeting_id", "x.slot").agg(F.count("*").alias("all"), F.count_if(F.col("x.held") == shift).alias("whole"))
    place = F.pmod(F.col("frame"), F.lit(shift))
    covered = F.when(place < (width - 1) % shift + 1, F.col("all")).otherwise(F.col("whole"))
    if silent:
        frames = slots.withColumn("frame", F.explode(F.sequence(F.col("slot") * shift, F.col("slot") * shift + shift - 1)))
        met = frames.join(counts, ["meeting_id", "frame"], "left")
    else:
        met = counts.withColumn("slot", F.floor(F.col("frame") / shift)).join(slots, ["meeting_id", "slot"])
    met = met.withColumn("covered", covered).where("covered > 0")
    n, weight = F.coalesce("n", F.lit(0)).cast("float"), F.col("covered").cast("float") + F.lit(1e-12).cast("float")
    # the quotient of two singles, rounded once more from double, is the single quotient
    half_up = (n / weight).cast("float") + F.lit(0.5).cast("float")
    return met.select("meeting_id", "frame", F.floor(half_up).cast("int").alias("k"))


def heap_choice(counts: list[int], k: int) -> list[int]:
    """The k places of the largest counts where the k-th equals the next: those that a heap of the first k,
    the least at its root, is left with after every later and larger count has taken the root's place.

    An item sinks below children that aren't larger, towards the lesser child, the left one of equals.
    """
    heap = list(range(k))

    def sink(at: int) -> None:
        item = heap[at]
        while 2 * at + 1 < k:
            child = min((c for c in (2 * at + 1, 2 * at + 2) if c < k), key=lambda c: counts[heap[c]])
            if counts[heap[child]] > counts[item]:
                break
            heap[at], at = heap[child], child
        heap[at] = item

    for at in reversed(range(k // 2)):
        sink(at)
    for place in range(k, len(counts)):
        if counts[place] > counts[heap[0]]:
            heap[0] = place
            sink(0)
    return sorted(heap)


def most_voted(voted: DataFrame, speakers: DataFrame) -> DataFrame:
    """meeting_id, frame, cluster: the k clusters of a frame with most votes (meeting_id, frame, cluster from 0, n),
    k from ``speakers`` (meeting_id, frame, k).

    A meeting's clusters are those up to its largest number; one without votes in a frame has 0 of them.
    Only frames in which the k-th and the next have equal votes leave the JVM, for ``heap_choice``.
    """

    @F.pandas_udf("array<int>")
    def chosen(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for counts, k in frames:
            yield pd.Series([None if c is None else heap_choice(list(c), int(n)) for c, n in zip(counts, k)])

    most = voted.groupBy("meeting_id").agg(F.max("cluster").alias("last"))
    by_frame = voted.groupBy("meeting_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct(F.col("cluster").cast("int"), F.col("n").cast("int")))).alias("n"))
    wanted = speakers.where("k > 0").join(most, "meeting_id").join(by_frame, ["meeting_id", "frame"], "left")
    all_ = F.sequence(F.lit(0), F.col("last").cast("int"))
    counts = F.transform(all_, lambda c: F.coalesce(F.try_element_at("n", c), F.lit(0)))
    rows = wanted.select("meeting_id", "frame", "k", all_.alias("all"), F.when(F.col("n").isNull(), F.transform(all_, lambda c: F.lit(0))).otherwise(counts).alias("counts"))
    ranked = rows.withColumn("ranked", F.reverse(F.array_sort("counts")))
    whole = F.col("k") >= F.size("all")
    clear = whole | (F.try_element_at("ranked", F.col("k")) > F.try_element_at("ranked", F.col("k") + 1))
    told = ranked.withColumns({"whole": whole, "clear": clear})
    told = told.withColumn("tied", F.when(~F.col("clear"), F.col("counts")))
    picked = told.withColumn("chosen", chosen("tied", "k"))
    least = F.try_element_at("ranked", F.col("k"))
    of_clear = F.filter("all", lambda c: F.get("counts", c) >= F.col("least"))
    final = picked.withColumn("least", least).withColumn("c", F.when(F.col("whole"), F.col("all")).when(F.col("clear"), of_clear).otherwise(F.col("chosen")))
    return final.select("meeting_id", "frame", F.explode("c").alias("cluster"))


def single_turns(chosen: DataFrame, scale: float, offset: float, on: float, off: float) -> DataFrame:
    """meeting_id, cluster, start, stop of the runs of frames (meeting_id, frame, cluster), in single precision: a
    gap of at most ``off`` seconds joins two runs, and what lasts ``on`` seconds or less goes.

    Frames become times by one multiplication and addition in double precision, rounded once to single; the last
    frame that a meeting has ends a run that reaches it, a run elsewhere ends where the next frame begins. A
    run is a gap's neighbour whatever was joined before, so a window over runs decides.
    """
    single = lambda x: F.lit(x).cast("float")
    time = lambda frame: (frame * single(scale).cast("double") + single(offset).cast("double")).cast("float")
    last = chosen.groupBy("meeting_id").agg(F.max("frame").alias("last"))
    order = Window.partitionBy("meeting_id", "cluster").orderBy("frame")
    islands = chosen.select("meeting_id", "cluster", "frame").distinct().withColumn("island", F.col("frame") - F.row_number().over(order))
    runs = islands.groupBy("meeting_id", "cluster", "island").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).join(last, "meeting_id")
    timed = runs.select("meeting_id", "cluster", "a", time(F.col("a")).alias("start"), time(F.least(F.col("b") + 1, F.col("last"))).alias("stop"))
    by_run = Window.partitionBy("meeting_id", "cluster").orderBy("a")
    before = F.lag("stop").over(by_run)
    joins = (before < F.col("start")) & (before + single(off) >= F.col("start"))
    grouped = timed.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("turn", F.sum("new").over(by_run.rowsBetween(Window.unboundedPreceding, 0)))
    turns = grouped.groupBy("meeting_id", "cluster", "turn").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return turns.where(F.col("stop") - F.col("start") > single(on)).drop("turn")


def pieces(regions: DataFrame, size: int, least: int) -> DataFrame:
    """The regions (lo, hi and others) cut into pieces of ``size``; a last piece shorter than ``least`` belongs to
    the one before it. Regions without length have no piece."""
    length = F.col("hi") - F.col("lo")
    full = F.ceil(length / size)
    n = F.when((full >= 2) & (length - (full - 1) * size < least), full - 1).otherwise(full)
    others = [c for c in regions.columns if c not in ("lo", "hi")]
    cut = regions.where("hi > lo").withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    lo = F.col("lo") + F.col("i") * size
    return cut.select(*others, lo.alias("lo"), F.when(F.col("i") == F.col("n") - 1, F.col("hi")).otherwise(lo + size).alias("hi"))
