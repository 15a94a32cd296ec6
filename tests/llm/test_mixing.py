"""The mix: windows, deviation from the targets, many sources, edge cases."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from parlance.llm.mixing import TARGETS, _pattern, mix

SCHEMA = "doc_id long, source string, w int, offset int, k int, block string"


def deviation(slots, weights):
    """Most blocks by which any source is off its share, over all slots; slots: name by slot."""
    total, had, worst = sum(weights.values()), dict.fromkeys(weights, 0), 0.0
    for t, name in enumerate(slots, 1):
        had[name] += 1
        worst = max(worst, max(abs(n - t * weights[s] / total) for s, n in had.items()))
    return worst


def test_deviation_over_many_slots(spark):
    """The schedule repeats, so a cycle of 10^5 slots holds all its prefixes."""
    classes = spark.createDataFrame([(70_001, 1), (17_500, 1), (4_166, 3), (1, 1)], "w long, m long")
    cycle = 100_000
    rows = _pattern(classes, cycle).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(cycle))
    members = {70_001: 1, 17_500: 1, 4_166: 3, 1: 1}
    weights = {(w, j): w for w, m in members.items() for j in range(m)}
    assert sum(weights.values()) == cycle
    assert deviation([(r.w, r.g % members[r.w]) for r in rows], weights) < 1


def test_targets_are_met(spark):
    ids = spark.range(20_000)
    docs = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("src"), F.col("id") % 22).alias("source"))
    rows = mix(docs, TARGETS, block_rows=1).where("in_mix").collect()
    order = [r.source for r in sorted(rows, key=lambda r: r.slot)]
    assert len(order) > 5_000 and [r.slot for r in sorted(rows, key=lambda r: r.slot)] == list(range(len(rows)))
    assert deviation(order, {f"src{i}": TARGETS.get(f"src{i}", 1) for i in range(22)}) < 1


def test_more_sources_than_slots(spark):
    ids = spark.range(3000)
    docs = ids.select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, F.concat(F.lit("s"), "id")).otherwise("hot").alias("source"))
    for targets in ({"hot": 90_000}, {"s3": 7}, {}):
        rows = mix(docs, targets).collect()
        assert sorted(r.doc_id for r in rows) == list(range(3000))
        blocks = defaultdict(set)
        for r in rows:
            assert r.release <= r.slot < r.deadline
            blocks[r.slot].add((r.source, r.block))
        assert all(len(x) == 1 for x in blocks.values())


def test_edge_cases(spark):
    """Null sources and ids, repeated rows, columns with the names of inner and result columns."""
    rows = [(i, "a", 1, 2, 3, "mine") for i in range(40)] + [(None, None, 9, 9, i, "mine") for i in range(20)] + [(7, "a", 1, 2, 3, "mine")] * 3
    found = mix(spark.createDataFrame(rows, SCHEMA), {"a": 2}).collect()
    assert sorted(((r.doc_id, r.source, r.w, r.offset, r.k) for r in found), key=str) == sorted((r[:5] for r in rows), key=str)
    places = {(r.source, r.block, r.place) for r in found}
    assert len(places) == len(rows) and all(isinstance(r.block, int) for r in found)
    empty = mix(spark.createDataFrame([], SCHEMA), {"a": 2})
    assert empty.count() == 0 and empty.columns[:5] == ["doc_id", "source", "w", "offset", "k"]


def test_refused_weights(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    for bad in ({"a": 0}, {"a": 0.5}, {"a": 10_000_000}):
        with pytest.raises(ValueError):
            mix(docs, bad)


def test_stage_mixes_to_targets(spark):
    ids = spark.range(4 * 320)
    docs = ids.select(
        F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 4).alias("source"), F.lit(1).alias("n_chars")
    )
    rows = corpus_pipeline.mixing(spark, docs, "").collect()
    assert sorted(r.doc_id for r in rows) == list(range(4 * 320))
    order = [rows[i].source for i in range(0, 700, 16)]
    assert deviation(order, {"src0": 3, "src1": 2, "src2": 2, "src3": 1}) < 1
