"""Scans of documents, evaluation end to end, annotated corpora, small table operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import alignment, catalog, kmeans
from parlance.plans import evaluation
from parlance.sources import annotated, bundles, documents, lines

REF, HYP = "ref/1", "hyp/1"


def meeting(name="m1", **changes):
    segments = [
        {"speaker": "A", "start": 0.0, "end": 10.0, "text": "one two three", "words": [{"w": "one", "start": 0, "end": 1}, {"w": "two", "start": 1, "end": 2}, {"w": "three", "start": 2, "end": 3}]},
        {"speaker": "B", "start": 10.0, "end": 20.0, "text": "four five six"},
    ]
    return {"schema": REF, "meeting_id": name, "sample_rate": 16000, "duration_s": 30.0, "channels": 1, "speakers": [{"id": "A"}, {"id": "B"}, {"id": "C"}], "segments": segments, "audio": {}, "generator": {"seed": 1}} | changes


def hypothesis(name="m1", **changes):
    segments = [{"speaker": "Speaker 1", "start": 0, "end": 9, "text": "one two three"}, {"speaker": "y", "start": 10, "end": 18, "text": "four five"}, {"speaker": "Speaker 1", "start": 18, "end": 20, "text": ""}, {"speaker": "y", "start": 25, "end": 25.5, "text": ""}]
    return {"schema": HYP, "meeting_id": name, "system": "s", "segments": segments} | changes


def files(spark, docs):
    return spark.createDataFrame([(f"p{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "path string, value string")


def bad_segment(**changes):
    return meeting(segments=[meeting()["segments"][0] | changes])


@pytest.mark.parametrize(
    ("doc", "hint"),
    [
        ("not json", "schema"),
        (meeting(schema="other"), "schema"),
        (meeting("a b"), "white space"),
        (meeting(sample_rate=0), "sample_rate"),
        (meeting(duration_s=None), "duration_s"),
        (meeting(speakers=[]), "no speakers"),
        (meeting(speakers=[{"id": "A"}, {"id": "A"}, {"id": "B"}]), "repeated"),
        (meeting(speakers=[{"id": "<NA>"}, {"id": "A"}, {"id": "B"}]), "absent"),
        (meeting(audio=3), "audio"),
        (meeting(segments=None), "no segments"),
        (meeting(segments=meeting()["segments"][::-1]), "sorted"),
        (bad_segment(speaker="D"), "declared"),
        (bad_segment(end=31.0), "after the meeting"),
        (bad_segment(start=-1.0), "negative"),
        (bad_segment(end=0.0), "after the start"),
        (bad_segment(text=None), "no text"),
        (bad_segment(text="one two"), "spell"),
        (bad_segment(words=[{"w": "one two three", "start": 0, "end": 1}]), "more than one"),
        (bad_segment(words=[{"w": "one", "start": 0, "end": 11}]), "outside"),
        (bad_segment(text="one two", words=[{"w": "one", "start": 2, "end": 3}, {"w": "two", "start": 1, "end": 2}]), "words[1]: not sorted"),
        (bad_segment(text="one", words=[{"w": "one", "start": 2, "end": 1}]), "before its start"),
        (bad_segment(words=[]), "spell"),
        (bad_segment(text=5, words=None), "text isn't text"),
        (bad_segment(speaker=7), "speaker isn't text"),
        (bad_segment(words="one"), "words isn't a list"),
        (bad_segment(text="5", words=[{"w": 5, "start": 0, "end": 1}]), "w isn't text"),
        (meeting(7), "meeting_id isn't text"),
        ("{'schema': 'ref/1'}", "isn't JSON"),
    ],
)
def test_broken_meetings(spark, doc, hint):
    errors = documents.meetings(files(spark, [doc]), REF).first().errors
    assert any(hint in e for e in errors), errors


def test_good_documents(spark):
    docs = documents.meetings(files(spark, [meeting()]), REF)
    assert docs.first().errors == []
    assert [r.label for r in documents.active_speakers(docs).orderBy("pos").collect()] == ["A", "B"]
    hyps = documents.hypotheses(files(spark, [hypothesis(), hypothesis(system=" ")]), HYP)
    assert [bool(r.errors) for r in hyps.orderBy("path").collect()] == [False, True]
    back = documents.hypothesis_documents(documents.segments(documents.good(hyps), "H"), HYP, "s").first()
    assert json.loads(back.value) == hypothesis(segments=sorted(hypothesis()["segments"], key=lambda s: s["start"]))


def test_evaluation_of_folders(spark, tmp_path):
    for folder, docs in (("r/m1", meeting()), ("r/m2", meeting("m2")), ("r/m3", meeting("m3", channels=0)), ("h/m1", hypothesis()), ("h/m9", hypothesis("m9"))):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "x.json").write_text(json.dumps(docs))
    scores, status = evaluation.evaluate(spark, str(tmp_path / "r"), str(tmp_path / "h"), REF, HYP, collar=0)
    assert {(r.meeting_id, r.status) for r in status.collect()} == {("m1", "scored"), ("m2", "missing"), ("m9", "unknown"), ("m3", "refused")}
    values = {r.metric: r.value for r in evaluation.long(scores).collect()}
    assert values["der.der"] == pytest.approx(0.175) and values["der.total"] == 20 and values["jer.speaker_count"] == 2
    assert values["cpwer.errors"] == 1 and values["wer_literal.errors"] == 11 and values["speaker_count.error"] == 0
    assert len(values) == 33
    pooled = {r.metric: r.value for r in evaluation.micro(scores).collect()}
    assert pooled["der.der"] == pytest.approx(0.175) and pooled["cpwer.error_rate"] == pytest.approx(1 / 6)
    table = [r.line for r in evaluation.markdown(scores).orderBy("part", "meeting_id").collect()]
    assert table[0].startswith("| meeting | cpWER") and table[2].startswith("| m1 | 0.1667 |") and len(table) == 3
    assert json.loads(evaluation.report(scores, "meeting").first().value)["metrics"]["cpwer.errors"] == 1
    checks = spark.createDataFrame([("s", "der.der", 0.2, None), ("s", "cpwer.error_rate", 0.1, None)], "suite string, metric string, max double, min double")
    assert {r.metric: r.passed for r in evaluation.gated(scores, checks).collect()} == {"der.der": True, "cpwer.error_rate": False}


def test_bundles(spark, tmp_path):
    docs = files(spark, [hypothesis(), hypothesis("m 2"), hypothesis("m3")])
    good = documents.good(documents.hypotheses(docs, HYP))
    rows = documents.segments(good, "H")
    values = docs.join(good.select("path", "meeting_id"), "path").select("meeting_id", "value")
    bundles.write(values, rows, f"{tmp_path}/b")
    back = documents.hypotheses(bundles.documents_of(spark, f"{tmp_path}/b"), HYP)
    assert {r.meeting_id for r in back.where("size(errors) = 0").collect()} == {"m1", "m3"}
    rttm, stm = lines.rttm(bundles.lines_of(spark, f"{tmp_path}/b", "rttm")), lines.stm(bundles.lines_of(spark, f"{tmp_path}/b", "stm"))
    named = documents.segments(documents.good(back), "H").join(lines.label_fields(rows), ["meeting_id", "label"]).select("meeting_id", F.col("field").alias("label"), "lo", "hi")
    assert lines.agreement({"json": named, "rttm": rttm, "stm": stm}).count() == 0 and rttm.count() == 8
    assert bundles.damaged(spark, f"{tmp_path}/b").count() == 0
    file = next((tmp_path / "b/data/meeting_id=m1/kind=rttm").glob("part*"))
    file.write_text(file.read_text().replace("9.0", "8.0", 1) + "more\n")
    file.with_name("." + file.name + ".crc").unlink(missing_ok=True)
    (next((tmp_path / "b/data/meeting_id=m3/kind=stm").glob("part*"))).unlink()
    assert sorted(tuple(r) for r in bundles.damaged(spark, f"{tmp_path}/b").collect()) == [("m1", "rttm", "differs"), ("m3", "stm", "absent")]


def test_summary_of_grouping_sets(spark):
    rows = [("d1", "s", None, 0.5, 1.0, 2.0), ("d1", "s", None, 0.1, 1.0, 10.0), ("d2", "s", "v", None, 0.0, 0.0), ("d2", "t", "v", 0.3, 3.0, 10.0)]
    zero = {c: F.lit(0.0) for a, b in evaluation.SUMS.values() for c in (*a, b)} | {m: F.lit(None).cast("double") for m in evaluation.SUMS}
    scores = spark.createDataFrame(rows, "dataset string, system string, variant string, rate double, errors double, length double")
    scores = scores.select("dataset", "system", "variant", *[v.alias(k) for k, v in (zero | {"der.der": F.col("rate"), "der.miss": F.col("errors"), "der.total": F.col("length")}).items()])
    got = {(r.dataset, r.system, r.variant, r.level): (r.macro and round(r.macro, 6), r.micro and round(r.micro, 6), r.meetings) for r in evaluation.summary(scores).where("metric = 'der.der'").collect()}
    assert got[("d1", "s", None, 0)] == (0.3, 0.166667, 2) == got[("d1", "s", None, 1)]
    assert got[("d2", "s", "v", 0)] == (None, None, 0) and got[(None, "s", None, 2)] == (0.3, 0.166667, 2) and got[(None, None, None, 3)] == (0.3, 0.227273, 3)
    assert len(got) == 3 + 3 + 2 + 1


def test_refused_meetings_fail_gates(spark):
    rows = [("m", "R", f"s{i}", i * 10, i * 10 + 5, "a") for i in range(21)] + [("m", "H", "x", 0, 5, "a")]
    scores = evaluation.flat(spark.createDataFrame(rows, "meeting_id string, side string, label string, lo long, hi long, text string"))
    found = {r.metric: r for r in evaluation.macro(scores).collect()}
    assert found["cpwer.error_rate"].not_scored == 1 and found["cpwer.error_rate"].value is None and found["der.der"].not_scored == 0
    checks = spark.createDataFrame([("s", "cpwer.error_rate", 9.0, None)], "suite string, metric string, max double, min double")
    assert "not scored" in evaluation.gated(scores, checks).first().reason


def test_hypothesis_lookup(spark):
    meetings = spark.createDataFrame([("a", "x/a1"), ("b", "b1"), ("c", "c1"), ("d", "d1")], "meeting_id string, folder string")
    there = spark.createDataFrame([("a1/hyp.json",), ("x/a1/hyp.json",), ("b.json",), ("b.hyp.json",), ("c/hyp.json",)], "path string")
    got = {r.meeting_id: r.hypothesis for r in documents.hypothesis_paths(meetings, there).collect()}
    assert got == {"a": "x/a1/hyp.json", "b": "b.hyp.json", "c": "c/hyp.json", "d": None}


def test_checksums_and_results(spark):
    lines = spark.createDataFrame([("d" * 64 + "  a b.wav",), ("E" * 32 + " *c.wav",), ("short  x",)], "line string")
    assert sorted(tuple(r) for r in documents.checksums(lines).collect()) == [("d" * 64, "a b.wav"), ("e" * 32, "c.wav")]
    result = spark.createDataFrame([("m", json.dumps({"results": [{"start": 0.5, "end": 1, "text": " Hello  World", "speaker_id": "Speaker 1"}, {"start": 1, "end": 2, "text": "X"}]}))], "meeting_id string, value string")
    assert [tuple(r) for r in documents.results_as_segments(result).collect()] == [("m", "Speaker 1", 500_000, 1_000_000, "hello world"), ("m", "spk", 1_000_000, 2_000_000, "x")]


WORDS = """<?xml version="1.0"?><nite:root xmlns:nite="http://nite.sourceforge.net/">
<w nite:id="1" starttime="0.0" endtime="1.0">Hello</w><w nite:id="2" starttime="1.0" endtime="1.0" punc="true">,</w>
<vocalsound nite:id="3" starttime="1.0" endtime="5.0"/><w nite:id="4" starttime="1.5" endtime="1.2">back</w>
<w nite:id="5" starttime="3.0" endtime="4.0">well-known</w><w nite:id="6" starttime="2.9" endtime="3.5" trunc="true">kn</w>
<w nite:id="7">untimed</w><w nite:id="8" starttime="9.0" endtime="12.0">long</w><w nite:id="9" starttime="11" endtime="12">late</w>
<w nite:id="9" starttime="1" endtime="2">again</w><w nite:id="10" starttime="x">bad</w></nite:root>"""


def test_annotated_words_to_turns(spark):
    found = annotated.tokens(spark.createDataFrame([("/c/M1.A.words.xml", WORDS), ("/c/M1.B.words.xml", "<broken")], "path string, value string"))
    assert sorted(r.error[:7] for r in found.where("error is not null").collect()) == ["not XML", "startti", "the id "]
    assert [r.id for r in found.where("error is null").orderBy("pos").collect()] == [str(i) for i in range(1, 10)]
    words = annotated.repaired(annotated.of_speakers(found, spark.createDataFrame([("M1", 10.0)], "meeting_id string, duration double")))
    assert annotated.counters(words).first()[1:] == (8, 1, 1, 1, 1)
    turns = sorted(annotated.speaker_turns(words).collect(), key=lambda r: r.lo)
    assert [(r.lo, r.hi, r.text) for r in turns] == [(0, 1_000_000, "hello"), (2_900_000, 4_000_000, "well known kn"), (9_000_000, 10_000_000, "long")]
    assert [tuple(w) for w in turns[1].words] == [("well", 3_000_000, 3_500_000), ("known", 3_500_000, 4_000_000), ("kn", 3_000_000, 3_500_000)]
    assert "kn" not in annotated.speaker_turns(words, keep_truncated=False).where("lo = 2900000").first().text.split()


def test_participants(spark):
    xml = '<c><meeting observation="M"><speaker nxt_agent="B" global_name="Y" role="R"/><speaker nxt_agent="A" global_name="X"/></meeting><meeting observation="N"><speaker nxt_agent="A" global_name="X"/><speaker nxt_agent="A" global_name="Z"/></meeting></c>'
    rows = annotated.participants(spark.createDataFrame([("p", xml)], "path string, value string")).orderBy("meeting_id", "agent").collect()
    assert [(r.meeting_id, r.agent, r.error) for r in rows] == [("M", "A", None), ("M", "B", None), ("N", "A", "repeated"), ("N", "A", "repeated")]


def assigned(spark, words, turns, rule="floor"):
    w = spark.createDataFrame([(1, 0, i, f"w{i}", lo, hi) for i, (lo, hi) in enumerate(words)], "meeting_id long, seg_no long, word_no int, word string, lo long, hi long")
    t = spark.createDataFrame([(1, x, lo, hi) for x, lo, hi in turns], "meeting_id long, label string, lo long, hi long")
    return [(r.label, r.how) for r in alignment.assign(w, t, rule, bucket=7).orderBy("word_no").collect()]


def test_words_take_the_most_total_overlap(spark):
    turns = [("a", 0, 4), ("b", 4, 9), ("a", 9, 12)]
    assert assigned(spark, [(3, 10), (0, 3), (20, 21), (4, 4), (12, 12)], turns) == [("b", "overlap"), ("a", "overlap"), ("a", "nearest"), ("a", "nearest"), ("a", "nearest")]
    assert assigned(spark, [(1, 2)], []) == [("spk", "fallback")]
    assert assigned(spark, [(10, 12), (100, 110)], [("x", 0, 8), ("y", 14, 20), ("z", 60, 90)]) == [("x", "nearest"), ("z", "nearest")]


def test_ties(spark):
    turns, words = [("late", 2, 10), ("early", 0, 10), ("late", -5, -4)], [(5, 6), (0, 1), (5, 6), (2, 3), (11, 12)]
    label = lambda rule: [x for x, _ in assigned(spark, words, turns, rule)]
    assert label("floor") == ["early"] * 4 + ["early"] and label("latest_start") == ["late", "early", "late", "late", "early"]
    assert label("first_seen") == ["late", "early", "late", "late", "early"]
    assert label("previous_word") == ["early", "early", "early", "early", "early"]
    assert [h for _, h in assigned(spark, words, turns)] == ["tie", "overlap", "tie", "tie", "nearest"]
    with pytest.raises(ValueError):
        assigned(spark, words, turns, "other")


def test_nearest_is_brute_force(spark):
    random = np.random.default_rng(2)
    for k in range(3):
        turns = [(f"t{i}", int(lo), int(lo + random.integers(1, 9))) for i, lo in enumerate(np.sort(random.integers(0, 400, 25)))]
        words = [(int(lo), int(lo + random.integers(0, 6))) for lo in random.integers(-20, 450, 80)]
        want = []
        order = sorted(turns, key=lambda t: (t[1], t[2]))
        for lo, hi in words:
            shared = {}
            for x, t0, t1 in order:
                if min(hi, t1) > max(lo, t0):
                    shared[x] = shared.get(x, 0) + min(hi, t1) - max(lo, t0)
            if shared:
                most = [x for x, _, _ in order if shared.get(x) == max(shared.values())]
                want.append((most[0], "tie" if len(set(most)) > 1 else "overlap"))
            else:
                want.append((min(order, key=lambda t: max(0, t[1] - hi, lo - t[2]))[0], "nearest"))
        assert assigned(spark, words, turns) == want


def test_split_words_share_time(spark):
    w = spark.createDataFrame([(1, 0, 0, "well-known", 0, 10), (1, 0, 1, "...", 10, 12)], "meeting_id long, seg_no long, word_no int, word string, lo long, hi long")
    from parlance.operators import text

    out = alignment.split_words(w, text.output_tokens(F.regexp_replace("word", "-", " ")))
    assert sorted((r.word, r.lo, r.hi) for r in out.collect()) == [("known", 5, 10), ("well", 0, 5)]


def test_catalog(spark):
    rows = spark.createDataFrame([(1, "Proven_bytecode x"), (2, "medium"), (3, None), (4, "UNPROVEN high")], "i int, x string")
    assert [r[0] for r in rows.orderBy("i").select(catalog.evidence_class(F.col("x"))).collect()] == ["PROVEN_BYTECODE", "OFFICIAL_DOC", "UNCLASSIFIED", "PROVEN_OFFICIAL_SOURCE"]
    assert sorted((r.i, r.tag) for r in catalog.tagged(rows, "x", {"b": "(?i)byte", "p": "(?i)proven"}).collect()) == [(1, "b"), (1, "p"), (4, "p")]
    log = spark.createDataFrame([(1, "r1", 1.5, 2.0, "POST", "/a", "q=1", None, "é", None), (2, "r2", 2.0, None, "GET", "/b", "", "h", None, 99)], "seq long, request_id string, ts double, duration_ms double, method string, path string, query string, host string, body string, body_size long")
    one, two = (r.record for r in catalog.replay_record(log, "|").orderBy("seq").collect())
    assert one == "1 r1 1500000000 2000000\nPOST /a?q=1 HTTP/1.1\r\nHost: localhost\r\nContent-Length: 2\r\n\r\né|"
    assert two == "1 r2 2000000000 0\nGET /b HTTP/1.1\r\nHost: h\r\nX-Mock-Body-Truncated: 99\r\nContent-Length: 0\r\n\r\n|"
    assert catalog.differences(log, log).count() == 0 and catalog.differences(log, log.limit(1)).first().n == 1
    grid = spark.createDataFrame([(0.5, 0.2, 1), (0.6, 0.2, 0), (0.7, 0.3, 0)], "threshold double, der double, off int")
    assert catalog.selected(grid, "der", "off", "threshold").first().threshold == 0.6


def test_clustering(spark):
    random = np.random.default_rng(5)
    x = np.concatenate([random.normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    points = spark.createDataFrame([(1, i, v) for i, v in enumerate(x.tolist())], "group long, id long, v array<double>")
    clusters = kmeans.kmeans(points, 3)
    of = [r.cluster for r in clusters.orderBy("id").collect()]
    assert [len(set(of[a : a + 20])) for a in (0, 20, 40)] == [1, 1, 1] and len(set(of)) == 3
    assert {(r.n, r.kept) for r in catalog.cluster_sizes(clusters, 1, 0.3).collect()} == {(20, True)}
    centres = spark.createDataFrame([("o", [0.0, 0.0]), ("p", [5.0, 5.0]), ("q", [0.0, 5.0])], "label string, c array<double>")
    near = {r.id: r.label for r in catalog.nearest(points.select("id", "v"), centres).collect()}
    assert [near[i] for i in (0, 20, 40)] == ["o", "p", "q"]


def test_clusters_of_large_groups(spark):
    """Groups of many blocks are clustered as those of one are."""
    rng = np.random.default_rng(2)
    x = rng.normal(rng.integers(0, 4, (400, 1)) * 3.0, 0.6, (400, 3))
    x[350:] = x[0]
    rows = [(g, i, v) for g, n in (("p", 400), ("q", 90), ("r", 2)) for i, v in enumerate(x[:n].tolist())]
    points = spark.createDataFrame(rows, "group string, id long, v array<double>")
    of = lambda block: {(r.group, r.id): r.cluster for r in kmeans.kmeans(points, 4, block=block).collect()}
    assert of(64) == of(1000) and len(of(64)) == len(rows)


def test_audio_of_meetings(spark):
    there = spark.createDataFrame([("/a/b/meeting.json",), ("/a/meeting.json",)], "path string")
    audio = spark.createDataFrame([("/a/b/mix.wav",), ("/a/b/stems/x.wav",), ("/a/c/x.ogg",), ("/z/x.ogg",)], "path string")
    assert {r.path: r.meeting for r in documents.audio_meetings(audio, there).collect()} == {"/a/b/mix.wav": "/a/b/meeting.json", "/a/b/stems/x.wav": "/a/b/meeting.json", "/a/c/x.ogg": "/a/meeting.json", "/z/x.ogg": None}
    doc = json.dumps({"mix_wav": "mix.wav", "device": {"a": "d/a.bin", "ogg_opus": "d/o.ogg"}, "stems": {"A": "../a.wav"}})
    row = spark.createDataFrame([(doc, doc.replace('"mix_wav"', '"device_primary": "a", "mix_wav"'))], "x string, y string")
    got = row.select(*[documents.audio_path(F.col(c), k).alias(f"{c}{k}") for c in "xy" for k in ("mix", "device", "device.a", "stem:A", "own.wav")]).first()
    assert list(got) == ["mix.wav", "d/o.ogg", "d/a.bin", None, "own.wav", "mix.wav", "d/a.bin", "d/a.bin", None, "own.wav"]
    hyp = documents.hypotheses(files(spark, [hypothesis(extra={"diarization": {"turns": [[0.5, 1.25, "A"]]}})]), HYP)
    assert [tuple(r) for r in documents.raw_turns(hyp).collect()] == [("m1", "A", 500_000, 1_250_000)]


def test_parts_and_registered_objects(spark):
    parts = spark.createDataFrame([("u", 2, '"b"', bytearray(b"B")), ("u", 1, "a", bytearray(b"A")), ("v", 1, "a", bytearray(b"A"))], "upload string, part int, etag string, body binary")
    asked = spark.createDataFrame([("u", 1, '"a"'), ("u", 2, "b"), ("v", 1, "x"), ("w", 1, "a"), ("v", 2, "a")], "upload string, part int, etag string")
    got = {r.upload: (bytes(r.body) if r.body else None, r.error) for r in catalog.merged_parts(parts, asked).collect()}
    assert got == {"u": (b"AB", None), "v": (None, "part 1 of another etag"), "w": (None, "part 1 never uploaded")}
    known = spark.createDataFrame([("7fc56270e7a70fa81a5935b72eacbe29", "/m")], "md5 string, folder string")
    assert {r.part: r.folder for r in catalog.registered(parts.where("upload = 'u'"), known).collect()} == {1: "/m", 2: None}
