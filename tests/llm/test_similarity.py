"""Similarity operators against brute force."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import embedding_dedup, line_dedup
from parlance.llm.jaccard_join import PartEnum, jaccard_components
from parlance.llm.line_dedup import removed_lines

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, one int"
BASE = " ".join(f"w{i}" for i in range(60))
EDGES = [
    (1, BASE, "a", "s", 1),
    (2, BASE + " tail", "a", "s", 1),
    (3, BASE.upper(), "a", None, 2),
    (4, None, None, "s", 3),
    (5, "", "a", "s", 4),
    (6, "two words", "a", "s", 5),
    (7, "Two\twords", "a", "s", 6),
    (7, "Two\twords", "a", "s", 6),
    (None, BASE, "a", "s", 7),
    (8, " \n\n ", "a", "s", 8),
    (9, " ".join(f"v{i}" for i in range(30_000)), "a", "s", 9),
    (10, " ".join(f"v{i}" for i in range(29_000)), "a", "s", 9),
]


def roots(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def shingle_set(text, width):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


@pytest.mark.parametrize(("width", "percent", "n2", "k2"), [(3, 90, 3, 1), (5, 80, 1, 0), (5, 80, 4, 2)])
@pytest.mark.parametrize("edges", [False, True])
def test_jaccard_components(spark, width, percent, n2, k2, edges):
    docs = spark.createDataFrame(EDGES, SCHEMA) if edges else spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [r for r in docs.collect() if r.doc_id is not None]
    sets = {r.doc_id: shingle_set(r.text, width) for r in rows}
    links = []
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    root = roots(sets, links)
    want = sorted((r.doc_id, len(sets[r.doc_id]), root[r.doc_id]) for r in rows)
    got = [tuple(r) for r in jaccard_components(docs, width, percent, n2, k2).collect()]
    assert sorted(r for r in got if r[0] is not None) == want
    assert len(got) == docs.count()


def test_jaccard_of_nothing(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


LINES = [
    (5, "one line that is here\nother words in this one", 1),
    (5, "a copy of nothing else\none line that is here", 1),
    (6, "one line that is here too", 2),
    (6, "", 2),
    (None, "shared line of three\nonly once", 3),
    (None, "shared line of three", 3),
    (None, "shared line of three", 4),
    (None, None, 4),
    (1 << 62, "shared line of three\nLine SHARED of three", 5),
    (-(1 << 62), "first of all lines", 5),
    (7, "first of all lines", 5),
    (8, " ".join(f"v{i}" for i in range(30_000)), 6),
    (9, " ".join(f"v{i}" for i in range(29_000)), 6),
    (9, " ".join(f"v{i}" for i in range(29_000)), 6),
]


def brute_lines(rows):
    """(doc_id, line_no, occurrence) of lines that an earlier one is similar to."""
    seen, sets, gone, times = set(), [], [], Counter()
    keyed = sorted({(r.doc_id is not None, r.doc_id or 0, r.h, r.text) for r in rows if r.text is not None})
    times = Counter((r.doc_id, r.text) for r in rows)
    for some, doc_id, _, text in keyed:
        doc_id = doc_id if some else None
        for i, line in enumerate(text.split("\n")):
            words = frozenset(w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", line))
            if not words:
                continue
            gone += [(doc_id, i, k) for k in range(1, times[doc_id, text])]
            if words in seen or any(100 * len(words & s) >= 80 * len(words | s) for s in sets):
                gone.append((doc_id, i, 0))
            if words not in seen:
                seen.add(words)
                sets.append(words)
    return sorted(gone, key=str)


@pytest.mark.parametrize("source", ["edges", "lines", "table", "shuffled"])
def test_removed_lines(spark, source, monkeypatch):
    if source == "edges":
        docs = spark.createDataFrame(EDGES, SCHEMA)
    elif source == "lines":
        docs = spark.createDataFrame(LINES, "doc_id long, text string, at int")
    else:
        docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 100")
        monkeypatch.setattr(line_dedup, "EARLIEST", 1)  # more lines in the second round
    if source == "shuffled":
        monkeypatch.setattr(line_dedup, "BLOCK", 8)
    found = removed_lines(docs, broadcast_lines=0 if source == "shuffled" else 1_000_000).collect()
    got = sorted(((r.doc_id, r.line_no, r.occurrence) for r in found), key=str)
    assert got == brute_lines(docs.select("doc_id", F.col("text"), F.xxhash64("text").alias("h")).collect())


def test_removed_lines_in_any_order_of_rows(spark):
    columns = ("doc_id", "line_no", "occurrence", "copy", "text_hash")
    rows = [removed_lines(spark.createDataFrame(x, "doc_id long, text string, at int")).select(*columns).collect() for x in (LINES, LINES[::-1])]
    assert sorted(rows[0], key=str) == sorted(rows[1], key=str)


def test_lines_are_compared_without_python_on_executors(spark):
    """op4 is marked native; that tasks run no Python is seen in the plans that write its tables and in its own."""
    plans, was = [], line_dedup.stored_at

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return was(df, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "stored_at", seen)
        patch.setattr(line_dedup, "stored", lambda df, name: seen(df, name)[0])
        found = removed_lines(spark.createDataFrame(LINES, "doc_id long, text string, at int"))
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans) > 5 and not any("Arrow" in p or "Python" in p.replace("applySchemaToPythonRDD", "") for p in plans)


@pytest.mark.parametrize("letter", ["É", "İ", "ß", "Σ", "a\u0301", "ⓐⒶ", "ǅ", "\x1f", "\u2003", "\u0085"])
def test_only_ascii_letters_are_lowered(spark, letter):
    """Line by line the built-in function lowers A-Z alone or isn't used."""
    rows = [(f"Q{letter}Z\tB\x0bC\x0cD\rE {letter}",), (letter * 3,), (f"ABC {letter.lower()}",), ("ABC\tDef",), ("ABC",)]
    got = [r[0] for r in spark.createDataFrame(rows, "line string").select(line_dedup._lowered("line")).collect()]
    lower = {i: i + 32 for i in range(65, 91)} | {i: 32 for i in (9, 11, 12, 13)}
    assert got == [r[0].translate(lower) for r in rows]


def test_no_lines(spark):
    assert removed_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("n1", "n2", "k2", "percent"), [(None, 1, 0, 80), (None, 3, 1, 80), (None, 4, 2, 90), (None, 3, 2, 70)])
def test_similar_sets_share_a_signature(n1, n2, k2, percent):
    """Random pairs at and above the threshold, of all sizes."""
    scheme, random = PartEnum(percent, n2, k2), np.random.default_rng(n2)
    for size in [*range(1, 60), 200, 1000]:
        for _ in range(6):
            a = np.unique(random.integers(0, 1 << 63, size).astype(np.uint64))
            most = 2 * len(a) * (100 - percent) // (100 + percent)
            out = random.integers(0, most + 1)
            b = np.unique(np.concatenate([a[random.permutation(len(a))[out // 2 :]], random.integers(0, 1 << 63, out - out // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                assert {int(x) for s in scheme(a)[0] for x in s} & {int(x) for s in scheme(b)[0] for x in s}


def brute_links(rows):
    vectors = {}
    for r in rows:
        v = np.array(r.embedding if r.embedding is not None else [np.nan], float)
        if r.label is not None and r.vec_id is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            vectors[r.vec_id] = (r.label, v / np.linalg.norm(v))
    pairs = [(a, b) for a, b in combinations(vectors, 2) if vectors[a][0] == vectors[b][0] and len(vectors[a][1]) == len(vectors[b][1])]
    return [(a, b) for a, b in pairs if vectors[a][1] @ vectors[b][1] >= 0.98]


@pytest.mark.parametrize(("cell", "recall"), [(128, 0.999), (2, 0.999), (1, 1.0)])
def test_embedding_dedup_against_brute_force(spark, monkeypatch, cell, recall):
    """With cells of a few vectors, so grids of many words and traversals of many cells."""
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    x, labels = clustered(600)
    docs = spark.createDataFrame([(i, v, f"l{k}") for i, (v, k) in enumerate(zip(x.tolist(), labels.tolist()))], "vec_id long, embedding array<double>, label string")
    rows = docs.collect()
    links = brute_links(rows)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(docs, recall=recall).collect()}
    assert set(got) == {r.vec_id for r in rows} and links
    found = sum(r.n_links for r in got.values())
    assert 0.95 * 2 * len(links) <= found <= 2 * len(links)
    if found == 2 * len(links):
        root = roots(got, links)
        assert all(r.component_id == root[v] and r.kept == (v == r.component_id) for v, r in got.items())


def clustered(n, labels=3, seed=4):
    """Vectors around centres, at cosines of about 0.95 to 1 from each other."""
    random = np.random.default_rng(seed)
    centres = random.standard_normal((n // 12, 16))
    of = random.integers(0, len(centres), n)
    x = centres[of] + random.standard_normal((n, 16)) * random.choice([0.05, 0.12, 0.2], (n, 1))
    return x, (of % labels)


def test_norms_beyond_doubles(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=16)
    rows = [(i, (x * s).tolist(), 1) for i, s in enumerate((1.0, 1e200, 1e-200, 3e307 / np.abs(x).max(), 1e-320, -1e200))]
    rows += [(10, [0.0] * 16, 1), (11, [1e200] * 15 + [float("inf")], 1), (12, (x * 1e200).tolist(), None), (13, [None] * 16, 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i] for i in (0, 1, 2, 3)] == [(3, 0)] * 4 or [got[i] for i in (0, 1, 2, 3)] == [(4, 0)] * 4  # 1e-320 keeps few bits
    assert all(got[i] == (0, i) for i in (5, 10, 11, 12, 13))


def test_recall_of_the_traversal():
    """Of the index alone, 16 words a book: at the target without and with an earlier end."""
    x, labels = clustered(3000)
    labels = labels.astype(str)
    units = embedding_dedup.unit(x)
    moved = units - np.array([units[labels == k].mean(0) for k in labels])
    means = {k: units[labels == k].mean(0) for k in set(labels)}
    index = embedding_dedup.MultiIndex(embedding_dedup.codebook(moved[:, :8], 16), embedding_dedup.codebook(moved[:, 8:], 16), 0.98, means)
    seen = {}
    for recall in (None, 0.99):
        if recall:
            index.calibrate(x[:1500], labels[:1500], 0.98, recall)
        own, visits = index.cells(index.moved(x, labels.tolist()))
        near = (units @ units.T >= 0.98) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
        pairs = np.argwhere(near)
        sets = [set(v.tolist()) for v in visits]
        found = sum(own[p] in sets[q] for q, p in pairs)
        seen[recall] = (found / len(pairs), np.mean([len(v) for v in visits]))
        assert len(pairs) > 3000 and all(len(s) == len(v) for s, v in zip(sets, visits))
    assert seen[None][0] == 1 and seen[0.99][0] >= 0.97 and seen[0.99][1] < seen[None][1] < 256


def test_traversal_order():
    u, v = np.array([3.0, 0.0, 1.0]), np.array([0.0, 2.5, 0.5, 9.0])
    cells = embedding_dedup.traversal(u, v, 4.0)
    sums = [u[i] + v[j] for i, j in cells]
    assert sums == sorted(sums) and sorted(cells) == sorted((i, j) for i in range(3) for j in range(4) if u[i] + v[j] <= 4)


def test_embedding_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, "a"), (2, v, "a"), (3, v, "b"), (4, v, None), (5, None, "a"), (6, [], "a"), (7, [0.0, 0.0, 0.0], "a"), (8, [1.0, float("nan"), 1.0], "a")]
    rows += [(9, [1.0, None, 1.0], "a"), (10, [float("inf"), 1.0, 1.0], "a"), (11, [1.0, 2.0], "a"), (12, [1.0, 2.0], "a"), (None, v, "a"), (2, v, "a"), (13, [2.0, 4.0, 6.1], "a")]
    schema = "vec_id long, embedding array<double>, label string, n_links int, links int, v string"
    docs = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], schema)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(docs).collect()), key=str)
    lone = [(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10)] + [(None, 0, None)]
    assert got == sorted([*lone, (1, 3, 1), (2, 3, 1), (2, 3, 1), (13, 3, 1), (11, 1, 11), (12, 1, 11)], key=str)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_near_copies_do_not_meet_each_other(spark, monkeypatch):
    """Lines of a group of near copies have leaders, so their pairs aren't sought; a line is lowered once."""
    copies = [" ".join(f"word{'x' * (j if j != i % 25 else 30 + i // 25)}{j}" for j in range(25)) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    tables, was = {}, line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: tables.setdefault((name, len(tables)), was(df, name)))
    found = removed_lines(docs)
    wanted = next(df for (name, _), df in tables.items() if name == "own").where("wanted").count()
    assert wanted < 30 and sorted(r.doc_id for r in found.collect()) == list(range(1, 150))
    assert line_dedup._sets(docs, 80)._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


@pytest.mark.parametrize("few", [0, 200])
def test_lines_whose_leaders_fail_need_no_second_round(spark, monkeypatch, few):
    """A line that shares its longest words with an unlike line that isn't far, and is near to a third one."""
    rows, long = [], "aaaaaaaaaaaaaaaaaa bbbbbbbbbbbbbbbbb cccccccccccccccc ddddddddddddddd eeeeeeeeeeeeee"
    for g in range(12):
        of = lambda *parts: " ".join(f"{chr(97 + g)}{p}{i}" for p, n in parts for i in range(n))
        names = " ".join(w + chr(97 + g) for w in long.split())
        rows += [f"{names} {of(('x', 20), ('y', 4))}", f"{of(('x', 20), ('z', 4))} {names[: len(names) // 2]}zz"]
        rows.append(f"{names} {of(('x', 17), ('z', 4))}")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    tables, was = [], line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: tables.append(name) or was(df, name))
    monkeypatch.setattr(line_dedup, "FEW", few, raising=False)
    found = sorted(((r.doc_id, r.line_no, r.occurrence) for r in removed_lines(docs).collect()), key=str)
    assert found == brute_lines(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect())
    assert tables.count("pairs") == line_dedup.PARTS
    assert tables.index("matched") < tables.index("pairs")  # leaders are verified before words are joined
    monkeypatch.setattr(line_dedup, "EARLIEST", 1)  # all candidates but one come in a second round
    assert sorted(((r.doc_id, r.line_no, r.occurrence) for r in removed_lines(docs).collect()), key=str) == found
