"""Interval operators: sweeps, unions, collars, crops and overlap joins.

Interval tables have key columns, lo and hi. Everything is partitioned by the keys, and times
are integers, so sums don't depend on their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("meeting_id",)


def union(spans: DataFrame, keys: tuple[str, ...], strict: bool = False) -> DataFrame:
    """Merged intervals of each key. Touching intervals merge, or stay apart if ``strict``."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("lo") >= reach if strict else F.col("lo") > reach
    marked = spans.select(*keys, "lo", "hi", F.when(reach.isNull() | apart, 1).otherwise(0).alias("new"))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def sweep(spans: dict[str, DataFrame], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Elementary cells: keys, lo, hi, and how many intervals of each table are active.

    One pass over +1 and -1 events; no range join.
    """
    events = []
    for name, df in spans.items():
        for at, sign in (("lo", 1), ("hi", -1)):
            events.append(df.select(*keys, F.col(at).alias("t"), *[F.lit(sign if n == name else 0).alias(n) for n in spans]))
    points = reduce(DataFrame.unionByName, events).groupBy(*keys, "t").agg(*[F.sum(n).alias(n) for n in spans])
    order = Window.partitionBy(*keys).orderBy("t")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    cells = points.select(*keys, F.col("t").alias("lo"), F.lead("t").over(order).alias("hi"), *[F.sum(n).over(running).alias(n) for n in spans])
    return cells.where("hi is not null")


def overlap_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = KEYS, bucket: int = 60_000_000) -> DataFrame:
    """Pairs that share time, with lo and hi of what they share; left's and right's other
    columns must differ. Equal keys and time buckets make it a hash join; a pair is taken in
    the bucket in which what it shares begins."""
    cut = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}{c}" if c in ("lo", "hi") else c) for c in df.columns if c not in keys]).withColumn(
        "bucket", F.explode(F.sequence(F.expr(f"{p}lo div {bucket}"), F.expr(f"({p}hi - 1) div {bucket}")))
    )
    joined = cut(left.where("hi > lo"), "a_").join(cut(right.where("hi > lo"), "b_"), [*keys, "bucket"])
    shared = joined.withColumns({"lo": F.greatest("a_lo", "b_lo"), "hi": F.least("a_hi", "b_hi")})
    return shared.where(f"lo < hi and lo div {bucket} = bucket").drop("bucket", "a_lo", "a_hi", "b_lo", "b_hi")


def tracks(segments: DataFrame) -> DataFrame:
    """A label's activity: its segments, strictly overlapping ones merged."""
    return union(segments, ("meeting_id", "side", "label"), strict=True)


def crop(spans: DataFrame, regions: DataFrame) -> DataFrame:
    return overlap_join(spans, regions)


def overlapped(activity: DataFrame) -> DataFrame:
    """Time in which two or more tracks of the reference are active."""
    return sweep({"n": activity.where("side = 'R'")}).where("n >= 2").select("meeting_id", "lo", "hi")


def cooccurrence(activity: DataFrame) -> DataFrame:
    """meeting_id, ref, hyp, shared: time that each pair of labels shares."""
    ref = activity.where("side = 'R'").select("meeting_id", F.col("label").alias("ref"), "lo", "hi")
    hyp = activity.where("side = 'H'").select("meeting_id", F.col("label").alias("hyp"), "lo", "hi")
    return overlap_join(ref, hyp).groupBy("meeting_id", "ref", "hyp").agg(F.sum(F.col("hi") - F.col("lo")).alias("shared"))


def difference(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, lo, hi of the time of left that right lacks, in whole stretches."""
    cells = sweep({"a": left, "b": right}, keys).where("a > 0 and b <= 0")
    return union(cells.select(*keys, "lo", "hi"), keys)


def cell_windows(cells: DataFrame, regions: DataFrame, width: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``cells`` with w0 and w1: a window of the width, or of the cell if that is longer, around its
    middle, cut to the first region that ends at or after the cell's end, else the last one."""
    ends = regions.select(*keys, F.col("hi").alias("at"), F.struct(F.col("hi").alias("hi"), F.col("lo").alias("lo")).alias("region"))
    rows = cells.withColumns({"at": F.col("hi"), "cell": F.lit(True)}).unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    last = F.max("region").over(Window.partitionBy(*keys))
    found = rows.withColumn("region", F.coalesce(F.min("region").over(order), last)).where("cell")
    middle, half = (F.col("lo") + F.col("hi")) / 2, F.greatest(F.lit(width), F.col("hi") - F.col("lo")) / 2
    w0, w1 = F.greatest(F.coalesce("region.lo", "lo"), middle - half), F.least(F.coalesce("region.hi", "hi"), middle + half)
    return found.select(*cells.columns, w0.alias("w0"), w1.alias("w1"))
