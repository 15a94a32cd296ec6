"""Error rates against closed forms worked out by hand; times in seconds."""

import pytest

from parlance.operators import scoring, words

S = 1_000_000
REF = [("R", "A", 0, 10, "one two three"), ("R", "B", 10, 20, "four five six")]
HYP = [("H", "x", 0, 9, "one two three"), ("H", "y", 10, 18, "four five"), ("H", "x", 18, 20, ""), ("H", "y", 25, 25.5, "")]
OVERLAP = [("R", "A", 0, 10, ""), ("R", "B", 8, 12, ""), ("H", "a", 0, 10, "")]


def score(spark, rows, collar=0.0, duration=None, **how):
    data = [(1, s, x, round(lo * S), round(hi * S)) for s, x, lo, hi, *_ in rows]
    df = spark.createDataFrame(data, "meeting_id long, side string, label string, lo long, hi long")
    found = scoring.meeting_scores(df, round(collar * S), None if duration is None else round(duration * S), **how).collect()
    return found[0] if found else None


def parts(r, prefix=""):
    return tuple(r[f"{prefix}{x}"] / S for x in ("total", "miss", "fa", "conf", "correct"))


def speakers(r):
    return {x.speaker: tuple(y / S for y in (x.total, x.correct, x.miss, x.conf, x.fa)) for x in r.speakers}


def mapping(r):
    return {x.hyp: x.ref for x in r.mapping}


def test_components(spark):
    r = score(spark, REF + HYP, duration=30)
    assert parts(r) == (20, 1, 0.5, 2, 17) and mapping(r) == {"x": "A", "y": "B"}
    assert speakers(r) == {"A": (10, 9, 1, 0, 0), "B": (10, 8, 0, 2, 0.5)}
    assert parts(r, "overlap_") == (0, 0, 0, 0, 0) and r.overlap_time == 0


def test_collar_is_centred_on_reference_boundaries(spark):
    assert parts(score(spark, REF + HYP, 0.5, 30)) == pytest.approx((19, 0.75, 0.5, 1.75, 16.5))
    assert parts(score(spark, REF + HYP, 0.25, 30))[0] == 19.5


def test_scored_region(spark):
    assert parts(score(spark, REF + HYP, duration=24))[2] == 0
    assert parts(score(spark, REF + HYP))[2] == 0.5


def test_overlap(spark):
    r = score(spark, OVERLAP, duration=15)
    assert parts(r)[:2] == (14, 4) and parts(r, "overlap_") == (4, 2, 0, 0, 2) and r.overlap_time == 2 * S
    assert parts(score(spark, OVERLAP, duration=15, skip_overlap=True))[:2] == (10, 2)


def test_overlap_is_scored_under_the_mapping_of_all_time(spark):
    r = score(spark, [("R", "A", 0, 10), ("R", "B", 8, 20), ("H", "x", 0, 8), ("H", "y", 8, 20), ("H", "w", 8, 10)], duration=20)
    assert mapping(r) == {"x": "A", "y": "B"} and parts(r)[3] == 2 and speakers(r)["A"][3] == 2
    assert parts(r, "overlap_") == (4, 0, 0, 2, 2)


def test_speakers_sum_to_components_with_collar(spark):
    rows = [("R", "A", 0, 10), ("R", "B", 8, 14), ("R", "C", 12, 16), ("H", "p", 0, 9), ("H", "q", 9, 15), ("H", "r", 13, 17), ("H", "s", 20, 22)]
    r = score(spark, rows, 0.25, 25)
    want = {"A": (9.5, 8.625, 0.875, 0, 0), "B": (5.25, 4.375, 0.875, 0, 0.875), "C": (3.5, 2.625, 0.875, 0, 0.875), "hyp:s": (0, 0, 0, 0, 2)}
    assert speakers(r) == {k: pytest.approx(v) for k, v in want.items()}
    assert parts(r) == pytest.approx((18.25, 2.625, 3.75, 0, 15.625))


def test_names_of_unmapped_speakers_stay_apart(spark):
    r = score(spark, [("R", "hyp:x", 0, 4), ("R", "x", 5, 6), ("H", "y", 0, 4), ("H", "x", 8, 9)], duration=10)
    assert speakers(r) == {"hyp:x": (4, 4, 0, 0, 0), "x": (1, 0, 1, 0, 0), "hyp:x#2": (0, 0, 0, 0, 1)}


def test_jaccard_error(spark):
    assert score(spark, [("R", "A", 0, 10), ("H", "x", 0, 5)], duration=10).jer == 0.5
    nothing = score(spark, [("R", "A", 0, 5), ("R", "B", 0, 5), ("H", "x", 0, 5)], duration=5, skip_overlap=True)
    assert nothing.jer is None and nothing.n_ref == 0
    inside = score(spark, [("R", "A", 1, 1.2), ("H", "x", 2, 3)], 0.25, 10)
    assert inside.jer is None and inside.total == 0 and inside.fa == S


def test_segments_of_one_speaker_count_once(spark):
    r = score(spark, [("R", "A", 0, 10), ("H", "s", 0, 6), ("H", "s", 5, 10)], duration=10)
    assert parts(r) == (10, 0, 0, 0, 10) and r.jer == 0
    two = score(spark, [("R", "A", 0, 6), ("R", "A", 5, 10), ("H", "s", 0, 10)], duration=10)
    assert parts(two)[0] == 10 and two.overlap_time == 0
    assert parts(score(spark, [("R", "A", 0, 5), ("R", "A", 5, 10), ("H", "s", 0, 10)], 0.5, 10))[0] == pytest.approx(9)


def test_ties_follow_the_order_of_numbered_labels(spark):
    others = [i for i in range(12) if i not in (2, 10)]
    rows = [("R", "R", 0, 2)] + [("R", f"s{i:02d}", 10 + 2 * i, 11 + 2 * i) for i in others]
    rows += [("H", "h02", 0, 1), ("H", "h10", 1, 2), ("H", "h10", 4, 8)] + [("H", f"h{i:02d}", 10 + 2 * i, 11 + 2 * i) for i in others]
    found = mapping(score(spark, rows, duration=40))
    assert found == {"h10": "R"} | {f"h{i:02d}": f"s{i:02d}" for i in others}  # "10" sorts before "2"


def test_negative_collar_is_refused(spark):
    with pytest.raises(ValueError):
        score(spark, REF, -1.0)


def rates(rows, collar=5.0):
    return words.scores_of([{"side": s, "label": x, "lo": round(lo * S), "hi": round(hi * S), "tokens": t.split()} for s, x, lo, hi, t in rows], round(collar * S))


def counts(r):
    return r["hits"], r["substitutions"], r["deletions"], r["insertions"]


def test_word_rates(spark):
    r = rates(REF + HYP)
    assert counts(r["cp"]) == (5, 0, 1, 0) and r["cp"]["rate"] == pytest.approx(1 / 6)
    assert counts(r["concat"]) == (5, 0, 1, 0)
    assert counts(r["literal"]) == (0, 0, 6, 5)  # no label is on both sides
    assert r["cp"]["mapping"] == [{"ref": "A", "hyp": "x"}, {"ref": "B", "hyp": "y"}]


def test_permutations_and_unpaired_speakers():
    ref = [("R", "a", 0, 4, "w x y z"), ("R", "b", 4, 8, "k l")]
    swapped = [("H", "a", 4, 8, "k l"), ("H", "b", 0, 4, "w x y z")]
    r = rates(ref + swapped)
    assert r["cp"]["errors"] == 0 and r["literal"]["errors"] == 8 and r["concat"]["errors"] == 0
    more = rates(ref + swapped + [("H", "c", 9, 10, "m n o")])
    assert counts(more["cp"]) == (6, 0, 0, 3) and more["cp"]["false_speakers"] == 1
    less = rates(ref + swapped[1:])
    assert counts(less["cp"]) == (4, 0, 2, 0) and less["cp"]["missed_speakers"] == 1


def test_time_constraint():
    ref = [("R", "a", 0, 2, "hello"), ("R", "a", 20, 22, "world")]
    late = [("H", "x", 10, 12, "hello"), ("H", "x", 20, 22, "world")]
    assert rates(ref + late, 5.0)["tcp"]["errors"] == 2 and rates(ref + late, 10.0)["tcp"]["errors"] == 0
    assert counts(rates(ref + late, 5.0)["tcp"]) == (1, 0, 1, 1)
    assert rates(ref + late, 5.0)["cp"]["errors"] == 0


def test_many_speakers_and_empty_sides():
    many = [("R", f"s{i}", i, i + 1, "a b") for i in range(21)]
    r = rates(many + [("H", "x", 0, 1, "a")])
    assert r["cp"] is None and "21" in r["refused"] and r["literal"]["errors"] > 0
    assert rates([("H", "x", 0, 1, "a b")])["cp"]["rate"] is None
    assert rates([("R", "x", 0, 1, "a b")])["cp"]["rate"] == 1


def brute(ref, hyp):
    """Least errors, by memo."""
    from functools import cache

    @cache
    def least(i, j):
        if not i or not j:
            return i + j
        return min(least(i - 1, j) + 1, least(i, j - 1) + 1, least(i - 1, j - 1) + (ref[i - 1] != hyp[j - 1]))

    return least(len(ref), len(hyp))


def test_edits_are_optimal():
    import numpy as np

    random = np.random.default_rng(1)
    for _ in range(200):
        ref, hyp = (random.integers(0, 4, random.integers(0, 12)) for _ in range(2))
        h, s, d, i = words.edits(ref, hyp)
        assert s + d + i == brute(tuple(ref), tuple(hyp)) and h + s + d == len(ref) and h + s + i == len(hyp)
        apart = random.random((len(ref), len(hyp))) < 0.3
        h, s, d, i = words.edits(ref, hyp, apart)
        assert s + d + i == words.distance(ref, hyp, apart) and h + s + d == len(ref) and h + s + i == len(hyp)
