"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

Each source is cut into blocks of ``block_rows`` documents. With W the sum of all target
weights, block i of a source of weight w has the release ``floor(i * W / w)`` and the deadline
``ceil((i + 1) * W / w)``; in each slot the released block with the earliest deadline goes
next (ties: the larger weight, then the source). As the weights sum to W, every block runs
inside its window, so at any slot each source has had its target's share to within less than
one block, while no source has run out. No weight is rounded.

The schedule repeats every W slots, so one cycle is computed, and every block's slot follows
from its number. Sources of equal weight have the same windows, so the cycle is scheduled for
classes of equal weight: a class of m sources runs block i of each of them in the order of
the sources. That takes W steps over a few numbers a class, however many sources there are.
W may be up to ``MAX_CYCLE``; more is refused with an error, as is a weight that is no positive whole number.

Within a source documents are ordered by the md5 of their id, then the id: a fixed shuffle.
Ranks come from counts in ranges of that hash, which hold about ``GROUP_ROWS`` rows of all
sources, so a source with a third of all rows is spread over many groups at any size.

All documents are kept. When a source runs out its slots stay empty; ``in_mix`` is true for
the slots before the first empty one, the part of the result that has the target weights.
Edge cases: null sources are a source of their own; a null id is ordered by the hash of the
row's other columns (rows equal in all columns are one group); repeated rows each take a
place; an empty table gives an empty result; texts aren't looked at, however long; other columns are
kept whatever their names, but those named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import documents, stored

BLOCK_ROWS = 16
#: Target weights of the query; sources that aren't named have weight 1.
TARGETS = {"src0": 3, "src1": 2, "src2": 2}
RESULT = ("block", "place", "slot", "release", "deadline", "in_mix")
GROUP_ROWS, MAX_CYCLE = 2_000, 1_000_000
#: Slots whose blocks are gathered in one array.
STEP = 1000


def _pattern(classes: DataFrame, cycle: int) -> DataFrame:
    """Earliest deadline first over one cycle of the classes (w, m): w, g (number of the block in its class), slot."""
    row = classes.agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("v"), "m"))).alias("c"))
    due = f"""
        transform(c, (x, k) ->
            if(s.given[k] < -x.v * x.m and (s.given[k] div x.m) * {cycle} div -x.v <= t,
               struct(cast(((s.given[k] div x.m + 1) * {cycle} - x.v - 1) div -x.v as bigint) as due, k as k),
               struct(9223372036854775807L as due, k as k)))"""
    one = f"""
        aggregate(sequence({STEP} * q, least({cycle}, {STEP} * (q + 1)) - 1),
            named_struct('given', z.given, 'went', cast(array() as array<bigint>)),
            (s, t) -> element_at(transform(array(array_min({due}).k), p -> named_struct(
                'given', transform(s.given, (g, k) -> if(k = p, g + 1, g)),
                'went', concat(s.went, array(-c[p].v)))), 1))"""
    all_steps = f"""
        aggregate(sequence(0, {(cycle - 1) // STEP}),
            named_struct('given', transform(c, x -> 0L), 'went', cast(array() as array<array<bigint>>)),
            (z, q) -> element_at(transform(array({one}), r -> named_struct('given', r.given, 'went', concat(z.went, array(r.went)))), 1))
        .went"""
    went = row.where("size(c) > 0").select(F.posexplode(F.flatten(F.expr(all_steps))).alias("slot", "w"))
    return went.select("w", "slot", (F.row_number().over(Window.partitionBy("w").orderBy("slot")) - 1).alias("g"))


def _weight(source: Column, targets: dict[str, int]) -> Column:
    if any(not isinstance(v, int) or v < 1 for v in targets.values()):
        raise ValueError("target weights are positive whole numbers")
    weight = F.lit(1)
    for name, value in targets.items():
        weight = F.when(source == f"={name}", value).otherwise(weight)
    return weight.cast("long")


def mix(docs: DataFrame, targets: dict[str, int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` (doc_id, source, ...) with block, place in the block, slot, release, deadline, in_mix.

    ``targets``: whole-number weights by source, 1 where not named.
    """
    own = [c for c in docs.columns if c not in RESULT]
    quoted = [F.col(f"`{c}`") for c in own]
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.xxhash64(*[c for c, n in zip(quoted, own) if n != "doc_id"]).cast("string")))
    # the row as one column, so that no name of its columns meets a name of ours
    rows = docs.select(F.struct(*quoted).alias("doc"), src.alias("src"), hashed.alias("hash"))
    total, digits = docs.count(), 1
    while total > GROUP_ROWS * 16**digits:
        digits += 1
    rows = rows.withColumn("part", F.substring("hash", 1, digits))
    counts = stored(rows.groupBy("src", "part").agg(F.count("*").alias("n")), "mixed")
    sources = counts.groupBy("src").agg(F.sum("n").alias("rows")).withColumn("w", _weight(F.col("src"), targets))
    cycle = sources.agg(F.sum("w")).first()[0] or 1
    if cycle > MAX_CYCLE:
        raise ValueError(f"the target weights sum to {cycle}, more than {MAX_CYCLE}")
    classes = sources.groupBy("w").agg(F.count("*").alias("m"))
    pattern = F.broadcast(_pattern(classes, cycle))  # as many rows as the cycle has slots
    in_class = Window.partitionBy("w").orderBy("src")
    sources = sources.select("src", "rows", "w", (F.row_number().over(in_class) - 1).alias("j"), F.count("*").over(Window.partitionBy("w")).alias("m"))
    # the first block that a source doesn't have
    missing = sources.withColumn("b", F.ceil(F.col("rows") / block_rows)).withColumn("g", F.expr("b % w * m + j"))
    ends = missing.join(pattern, ["w", "g"]).agg(F.min(F.expr(f"b div w * {cycle} + slot")).alias("horizon"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("src", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.join(sources.select("src", "w", "j", "m"), "src").join(F.broadcast(ends))
    order = Window.partitionBy("src", "part").orderBy("hash", "doc.doc_id")
    ranked = rows.join(offsets, ["src", "part"]).withColumn("rank", F.col("offset") + F.row_number().over(order) - 1)
    placed = ranked.withColumns({"block": F.expr(f"rank div {block_rows}"), "place": F.expr(f"cast(rank % {block_rows} as int)")})
    placed = placed.withColumns({"i": F.expr("block % w"), "turn": F.expr(f"block div w * {cycle}")}).withColumn("g", F.expr("i * m + j"))
    return placed.join(pattern, ["w", "g"]).select(
        "doc.*",
        "block",
        "place",
        (F.col("turn") + F.col("slot")).alias("slot"),
        F.expr(f"turn + i * {cycle} div w").alias("release"),
        F.expr(f"turn + ((i + 1) * {cycle} + w - 1) div w").alias("deadline"),
        F.expr("turn + slot < horizon").alias("in_mix"),
    )


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mix to ``TARGETS``."""
    mixed = mix(documents(spark, sf_dir).select("doc_id", "source"), TARGETS)
    return mixed.select("doc_id", "source", *RESULT)


OP9_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, coalesce('=' || source, 'null') AS src, md5(doc_id::VARCHAR) AS hash FROM documents
), n AS (
    SELECT src, ceil(count(*) / {BLOCK_ROWS})::BIGINT AS b,
           (CASE {" ".join(f"WHEN src = '={k}' THEN {v}" for k, v in TARGETS.items())} ELSE 1 END)::BIGINT AS w
    FROM d GROUP BY src
), s AS (
    SELECT *, row_number() OVER (PARTITION BY w ORDER BY src) - 1 AS j, count(*) OVER (PARTITION BY w) AS m, sum(w) OVER ()::BIGINT AS cycle FROM n
), c AS (
    SELECT list(w ORDER BY w DESC) AS ws, list(m ORDER BY w DESC) AS ms, any_value(cycle) AS cycle FROM (SELECT DISTINCT w, m, cycle FROM s)
), edf(t, given, p) AS (
    SELECT -1::BIGINT, list_transform(c.ws, lambda x: 0::BIGINT), 0::BIGINT FROM c WHERE len(c.ws) > 0
    UNION ALL
    SELECT t + 1, list_transform(range(1, len(given) + 1), lambda k: given[k] + CASE WHEN k = q THEN 1 ELSE 0 END), q
    FROM (
        SELECT t, given, list_min(list_transform(range(1, len(given) + 1), lambda k:
            CASE WHEN given[k] < c.ws[k] * c.ms[k] AND given[k] // c.ms[k] * c.cycle // c.ws[k] <= t + 1
                 THEN ((given[k] // c.ms[k] + 1) * c.cycle + c.ws[k] - 1) // c.ws[k] * 1000000 + k ELSE 9000000000000000000 END)) % 1000000 AS q
        FROM edf, c WHERE t < c.cycle - 1
    )
), pattern AS (
    SELECT c.ws[p] AS w, t AS slot, row_number() OVER (PARTITION BY p ORDER BY t) - 1 AS g FROM edf, c WHERE t >= 0
), ends AS (
    SELECT min(s.b // s.w * s.cycle + pattern.slot) AS horizon FROM s JOIN pattern ON s.w = pattern.w AND s.b % s.w * s.m + s.j = pattern.g
), r AS (
    SELECT *, (row_number() OVER (PARTITION BY src ORDER BY hash, doc_id) - 1) // {BLOCK_ROWS} AS block,
           (row_number() OVER (PARTITION BY src ORDER BY hash, doc_id) - 1) % {BLOCK_ROWS} AS place FROM d
)
SELECT doc_id, source, block, place::INT AS place, block // s.w * cycle + pattern.slot AS slot,
       block // s.w * cycle + block % s.w * cycle // s.w AS release,
       block // s.w * cycle + ((block % s.w + 1) * cycle + s.w - 1) // s.w AS deadline,
       block // s.w * cycle + pattern.slot < horizon AS in_mix
FROM r JOIN s USING (src) JOIN pattern ON pattern.w = s.w AND pattern.g = block % s.w * m + j CROSS JOIN ends
"""
