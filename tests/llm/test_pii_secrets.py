"""Personal data and secrets: base spans by plain patterns, what the methods add, edge cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from parlance.llm import pii, secrets
from parlance.llm.lstm_crf import Tagger, codes

SCHEMA = "doc_id long, text string, spans string, row int"
EDGES = [
    (1, None),
    (2, ""),
    (3, "0" * 5000 + ".1.2.3 and 300.1.1.1 and 1.2.3.4.5"),
    (4, "write to a.b+c@x-y.example.org or @nobody.org, 4111 1111 1111 1111, +49 (30) 1234-5678"),
    (4, "write to a.b+c@x-y.example.org or @nobody.org, 4111 1111 1111 1111, +49 (30) 1234-5678"),
    (None, "é a@b.cc é"),
    (5, "x" * 3_000 + " z@zz.zz " + "1" * 3_000),
]


def plain_pii(text):
    """By the patterns as they are stated."""
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    return [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()).hexdigest()


@pytest.fixture(scope="module")
def model():
    """As ``pii.train``, from the seeded examples alone."""
    xs, ys = [], []
    for text, spans in pii.examples():
        starts = pii.window_starts(text) or [0]
        xs.append(pii.cut(codes(text), starts, 97))
        ys.append(pii.cut(pii.labels_of(text, spans), starts, 0))
    tagger = Tagger(5, pii.HIDDEN, pii.HIDDEN)
    tagger.fit(np.concatenate(xs, 1), np.concatenate(ys, 1), pii.ROUNDS)
    return tagger


def test_spans_of_other_forms_are_found(model):
    """Held-out examples, of another seed: recall and precision of what the base rules miss."""
    test = pii.examples(400, seed=99)
    want, hit, given, good = (Counter() for _ in range(4))
    for (text, spans), found in zip(test, pii.spans_of(model, [t for t, _ in test])):
        base = [x for x in found if not x[0].startswith("tagged_")]
        added = [(k.removeprefix("tagged_"), a, b) for k, a, b in found if k.startswith("tagged_")]
        meets = lambda x, y: x[1] < y[2] and x[2] > y[1]
        for x in spans:
            if not any(meets(x, y) for y in base):
                want[x[0]] += 1
                hit[x[0]] += any(x[0] == y[0] and meets(x, y) and abs(x[1] - y[1]) <= 1 and abs(x[2] - y[2]) <= 1 for y in added)
        for x in added:
            given[x[0]] += 1
            good[x[0]] += any(x[0] == y[0] and meets(x, y) for y in spans)
    for kind in pii.BASE:
        assert want[kind] > 100 and hit[kind] >= 0.9 * want[kind] and good[kind] >= 0.9 * given[kind], kind


def test_pii_edge_cases(spark, model):
    rows = pii.find(spark.createDataFrame([(*r, "s", 1) for r in EDGES], SCHEMA), model).collect()
    got = Counter((r.doc_id, tuple(sorted(tuple(x) for x in r.spans if x.kind in pii.BASE))) for r in rows)
    assert got == Counter((d, tuple(sorted((k, a, b) for a, _, k, b in plain_pii(t or "")))) for d, t in EDGES)
    assert pii.find(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_long_runs_take_linear_time():
    assert pii.base_spans("x" * 2_000_000 + "@" + "1" * 1_000_000 + "+" * 1_000) == []


def test_pii_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in pii.op5_pii(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(docs)
    for d in docs:
        base = plain_pii(d.text or "")
        assert rows[d.doc_id].base_sha256 == digest(base)
        assert {f"{k}:{a}:{b}" for a, _, k, b in base} <= set(rows[d.doc_id].spans.split(","))


SECRETS = [
    (1, "user_id = jdoe42\nnothing else"),  # a weak part alone
    (2, "client_id=app-7781 at https://api.example.org/v1\npwd: hunter22"),  # all three
    (3, "client_id=app-7781\n\n" + "pwd: hunter22"),  # apart: other stretches
    (4, "client_id=app-7781 " + "x " * 150 + "pwd: hunter22"),  # out of reach
    (5, "see https://example.org and host=db1.example.org"),  # endpoints alone
    (6, "token=" + "ab12" * 8 + ".client_id=abcdef and more"),  # inside a base span
    (7, None),
    (8, ""),
    (9, "login: root, key=s3cr3t!! " + "word " * 50_000),
    (None, "tenant: acme password=abcdef123"),
    (None, "tenant: acme password=abcdef123"),
]


def test_weak_parts_are_reported_when_they_complete_each_other(spark):
    df = spark.createDataFrame([(*r, "s", 1) for r in SECRETS], SCHEMA)
    rows = secrets.scan(df).collect()
    kinds = sorted((str(r.doc_id), sorted(x.kind for x in r.spans)) for r in rows)
    assert kinds == sorted(
        [("1", []), ("2", ["endpoint", "identifier", "password"]), ("3", []), ("4", []), ("5", []), ("6", ["assign", "hex"]), ("7", []), ("8", []), ("9", ["identifier", "password"])]
        + [("None", ["assign", "identifier"])] * 2
    )
    six = next(r for r in rows if r.doc_id == 6)
    assert "identifier" not in {x.kind for x in six.spans} and "assign" in {x.kind for x in six.spans}
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_stretch_with_very_many_parts(spark):
    """Linking lists no pairs: 20,000 identifiers near 20,000 passwords."""
    text = " ".join(f"login: user{i} pwd: pass{i}" for i in range(20_000))
    found = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(found.spans) == 40_000
