"""Commands and their exit codes; suites of gates."""

import json

import pytest

from parlance.__main__ import main
from parlance.sources import bundles, documents, gates
from tests.test_evaluation import WORDS, hypothesis, meeting


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    top = tmp_path_factory.mktemp("commands")
    docs = {"refs/m1.json": meeting(schema="meeting/1"), "hyps/m1.json": hypothesis(schema="hypothesis/1"), "more/m1.json": meeting(schema="meeting/1"), "more/m2.json": meeting("m2", schema="meeting/1"), "bad/m1.json": meeting()}
    docs["gates.json"] = {"easy": [{"metric": "der.der", "max": 0.2}], "hard": [{"metric": "der.der", "max": 0.1}]}
    for name, doc in docs.items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_text(json.dumps(doc))
    return top


def test_batch(spark, folders):
    run = lambda *more: main(["batch", "--hyps", f"{folders}/hyps", *more], spark)
    suite = ("--gates", f"{folders}/gates.json", "--gate-on", "both", "--suite")
    assert run("--refs", f"{folders}/refs", *suite, "easy", "--out", f"{folders}/out") == 0
    assert spark.read.json(f"{folders}/out/scores").where("metric = 'der.total'").first().value == 19.5
    assert run("--refs", f"{folders}/refs", *suite, "hard") == 1
    assert run("--refs", f"{folders}/more") == 2 and run("--refs", f"{folders}/more", "--missing", "skip") == 0
    assert run("--refs", f"{folders}/bad") == 2


def test_each_meeting_and_bundles(spark, folders):
    run = lambda *more: main(["batch", "--refs", f"{folders}/refs", "--hyps", f"{folders}/hyps", "--gates", f"{folders}/gates.json", "--gate-on", "each", *more], spark)
    assert run("--suite", "easy", "--out", f"{folders}/each") == 0 and run("--suite", "hard") == 1
    assert [r.meeting_id for r in spark.read.json(f"{folders}/each/gates-each").collect()] == ["m1"]
    (folders / "refs" / "ref.rttm").write_text("SPEAKER m1 1 0 1 <NA> <NA> A <NA> <NA>\n")  # other kinds beside documents
    assert run("--suite", "easy") == 0
    for side, kind, schema in (("refs", documents.meetings, "meeting/1"), ("hyps", documents.hypotheses, "hypothesis/1")):
        docs = documents.read(spark, f"{folders}/{side}")
        good = documents.good(kind(docs, schema))
        bundles.write(docs.join(good.select("path", "meeting_id"), "path").select("meeting_id", "value"), documents.segments(good, "R"), f"{folders}/bundles-{side}")
    assert main(["batch", "--refs", f"{folders}/bundles-refs", "--hyps", f"{folders}/bundles-hyps", "--bundles"], spark) == 0
    assert main(["selfcheck", f"{folders}/refs"], spark) == 0 and main(["suites", f"{folders}/gates.json"], spark) == 0


def test_layouts_of_gates():
    body = {"schema": "gates/1", "suites": {"s": {"description": "d", "gates": [{"metric": "x", "eq": 0.0, "tol": 1e-9}]}}}
    assert gates.checks_of(gates.suites_of(body, "gates/1")) == [("s", "x", None, None, 0.0, 1e-9)]
    for wrong in ({}, [], body | {"more": 1}, body | {"suites": {}}, body | {"suites": {"s": []}}, {"suites": {"s": {"gates": [], "x": 1}}}):
        with pytest.raises(ValueError):
            gates.checks_of(gates.suites_of(wrong))
    with pytest.raises(ValueError):
        gates.suites_of(body, "gates/2")


def test_validate(spark, folders):
    assert main(["validate", f"{folders}/refs"], spark) == 0 and main(["validate", f"{folders}/bad"], spark) == 2
    assert main(["validate", f"{folders}/hyps", "--hypotheses"], spark) == 0


def test_lines_and_corpora(spark, folders):
    (folders / "x.stm").write_text("m 1 A 0 1 <o,f0,x> hi\n")
    assert main(["import-stm", f"{folders}/x.stm"], spark) == 0
    (folders / "xml").mkdir()
    (folders / "xml" / "M1.A.words.xml").write_text(WORDS.split('<w nite:id="9" starttime="1"')[0] + "</nite:root>")
    (folders / "d.json").write_text('{"meeting_id": "M1", "duration": 10.0}')
    assert main(["convert", f"{folders}/xml", "--durations", f"{folders}/d.json", "--out", f"{folders}/turns"], spark) == 0
    rttm = f"{folders}/turns/rttm/*/*.txt"
    assert main(["stats", rttm], spark) == 0 and main(["crosscheck", rttm, rttm], spark) == 0
    (folders / "one.rttm").write_text("SPEAKER M1 1 0 1 <NA> <NA> A <NA> <NA>\n")
    assert main(["crosscheck", f"{folders}/one.rttm", rttm], spark) == 1
    (folders / "bad.rttm").write_text("SPEAKER M1 1 0\n")
    assert main(["stats", f"{folders}/bad.rttm"], spark) == 2


@pytest.mark.parametrize("check", [{"metric": "x"}, {"metric": "x", "max": float("nan")}, {"metric": "x", "max": 1, "min": 2}, {"metric": "x", "most": 1}, {"max": 1}, {"metric": "x", "eq": True}, {"metric": "x", "max": 1, "tol": -1}, {"metric": "x", "eq": 5, "max": 1}, {"metric": "x", "eq": 0, "min": 1, "tol": 0.4}])
def test_refused_gates(check):
    with pytest.raises(ValueError):
        gates.checks_of({"s": [check]})
