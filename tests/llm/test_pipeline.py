"""Quality and the pipeline's stages against brute force, and their edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from parlance.llm import brown_lm, quality
from parlance.llm.common import stored
from parlance.llm.decontaminate import contaminated

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, doc int, component_id int, score int"
LONG = " ".join(f"w{i}" for i in range(40))
ROWS = [
    (3, LONG, "en", "a"),
    (1, LONG + " tail", "en", "b"),
    (1, "another text of the same id that is long enough", "de", None),
    (1, "another text of the same id that is long enough", "de", None),
    (None, LONG.upper(), "en", "a"),
    (None, "a text that has no id and no copy", "en", "a"),
    (None, "a text that has no id but a copy", "fr", "a"),
    (None, "a text that has no id but a copy", "en", "a"),
    (7, None, None, None),
    (8, "", "en", "a"),
    (None, None, None, None),
    (None, None, None, None),
    (9, " ".join(f"v{i}" for i in range(30_000)), "en", "c"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", 1, 2, 3) for r in rows], SCHEMA)


def plain(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()), key=str)


def test_near_duplicates_edges(spark):
    out = pipeline.near_duplicates(spark, frame(spark, ROWS), DIR)
    assert out.columns == list(pipeline.COLUMNS)
    want = [ROWS[i] for i in (1, 2, 5, 7, 8, 9, 10, 11, 12)]
    assert plain(out) == sorted(want, key=str)


def test_documents_that_share_a_key(spark, monkeypatch):
    """Where 64 bits are the same, the other 64 tell documents apart."""
    want = plain(pipeline.near_duplicates(spark, frame(spark, ROWS), DIR))
    monkeypatch.setattr(pipeline, "key_of", lambda: F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)))
    assert plain(pipeline.near_duplicates(spark, frame(spark, ROWS), DIR)) == want
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    rows = [*ROWS, (77, f"before it {item} and after it", "en", "a")]
    assert plain(pipeline.decontamination(spark, frame(spark, rows), DIR)) == sorted(ROWS, key=str)


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")]
        sets[r.doc_id] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, DIR).collect()) == [i for i in ids if find(i) == i]


def test_decontamination(spark, tmp_path):
    items = ["Which of these five rivers is the longest one in that country", "A train leaves at 9 with 40 people and stops 3 times before it ends"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dirty = [(1, f"Before it. {items[0]}. After it.", "en", "a"), (None, f"x {items[1].replace('40', '55')} y", "en", "a"), (2, items[0], "en", "a"), (2, items[0], "en", "a")]
    docs = frame(spark, ROWS + dirty + [(2, "a clean text of a dirty id, with a number of 40 people", "en", "a")])
    out = pipeline.decontamination(spark, docs, str(tmp_path))
    assert plain(out) == sorted([*ROWS, (2, "a clean text of a dirty id, with a number of 40 people", "en", "a")], key=str)


def test_decontamination_ways_agree(spark):
    """Broadcast windows and shuffled ones, on the whole table."""
    docs, items = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    ways = [sorted(tuple(r) for r in contaminated(docs, items, broadcast_windows=n).collect()) for n in (1_000_000, 0)]
    assert ways[0] == ways[1] and ways[0]


def test_decontamination_edge_cases(spark):
    items = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Solve 3x + 5 = 20", "x"), (4, "Solve 3x + 5 = 20", "x"), (None, "unknown item of a benchmark with quite some words", "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(1, "Now solve 3x + 5 = 20 " + "and so on " * 20_000, 5), (1, "other", 5), (None, "Solve 3x + 5 = 20", 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, item_id int")
    found = sorted(((r.doc_id, r.item_id, r.coverage) for r in contaminated(docs, items).collect()), key=str)
    assert found == sorted([(1, 3, 1.0), (1, 4, 1.0), (None, 3, 1.0), (None, 4, 1.0)], key=str)
    none = [docs.limit(0), items.limit(0)]
    assert contaminated(none[0], items).count() == 0 and contaminated(docs, none[1]).count() == 0


def test_quality_of_held_out_documents(spark):
    big = DIR.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in quality.op6_quality(spark, big).collect()}
    labels = [r for r in spark.read.parquet(f"{big}/labels.parquet").collect() if r.doc_id in rows and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(labels) > 50 and all(rows[r.doc_id].held_out for r in labels)
    right = np.mean([rows[r.doc_id].predicted == r.quality for r in labels])
    good = [rows[r.doc_id].score for r in labels if r.quality == 1]
    bad = [rows[r.doc_id].score for r in labels if r.quality == 0]
    assert right >= 0.9 and np.mean([g > b for g in good for b in bad]) >= 0.95
    assert len(rows) == spark.read.parquet(f"{big}/documents.parquet").count()
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows.values())


def test_quality_edge_cases(spark):
    docs = frame(spark, ROWS)
    labels = spark.createDataFrame([(3, 1), (7, 0), (8, 0), (1, 1), (1, 0), (9, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text or "", r.score) == r.score  # of its text alone
    assert quality.scored(docs.limit(0), model).count() == 0
    alone = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, alone).collect()} == {1.0}
    again = docs.unionByName(docs)  # an id with many rows is learnt from once
    assert np.allclose(quality.train(again, labels)["w"], model["w"])


def test_quality_stage(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    want = sorted(r.doc_id for r in docs.collect() if quality.score(model, quality.features(r.text)[None, :])[0] >= 0.7)
    got = sorted(r.doc_id for r in pipeline.quality(spark, docs, DIR).collect())
    assert got == want and 0 < len(want) < docs.count()


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_of_nothing(spark, name):
    docs = frame(spark, ROWS).limit(0)
    assert dict(pipeline.STAGES)[name](spark, docs, DIR).count() == 0


def test_mixing_and_token_output_edges(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    docs = frame(spark, ROWS)
    mixed = pipeline.mixing(spark, docs, DIR)
    assert mixed.columns == list(pipeline.COLUMNS) and plain(mixed) == sorted(ROWS, key=str)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pipeline.token_output(spark, stored(mixed, "mixed"), DIR).collect()
    want = Counter((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in ROWS)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, DIR), name)
    rows = pipeline.run(spark, DIR).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in kept.collect())
    first = min(rows, key=lambda r: r.start)
    assert first.start == 0 and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)


def test_language_model(spark):
    """The base score by its formula, totals, and held-out texts above the base."""
    big = DIR.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    words = {r.doc_id: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())] for r in docs}
    counts = Counter(w for d, ws in words.items() if not held(d) for w in [*ws, b"<end>"])
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in brown_lm.op10_brown_lm(spark, big).collect()}
    assert set(rows) == set(words)
    for d, ws in words.items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(d), len(ws) + 1, n)
        assert r.n_known == sum(counts[w] > 0 for w in [*ws, b"<end>"])
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, b"<end>"]), abs=1e-6)
    out = [r for r in rows.values() if r.held_out]
    base, model = (sum(getattr(r, c) for r in out) / sum(r.n_tokens for r in out) for c in ("base_score", "score"))
    assert model > base + 0.1


@pytest.mark.parametrize("head", [300_000, 20])
def test_language_model_is_a_distribution(spark, monkeypatch, head):
    """Of one-word texts all words, the unseen one included, have probabilities that sum to one; with words outside the head."""
    monkeypatch.setattr(brown_lm.head_of, "__defaults__", (head,))
    texts = [f"the {a} {b} runs" for a in ("big", "small", "old") for b in ("dog", "cat", "ox", "hen", "pig", "owl", "bee")] * 3
    seen = sorted({w for t in texts for w in t.split()})
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(1000 + i, w, False) for i, w in enumerate([*seen, "unseen"])] + [(None, None, True), (5000, "", False), (5001, "ox " * 30_000, False)]
    found = {r.doc_id: r for r in brown_lm.scored(spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, train boolean, row int, word string")).collect()}
    assert len(found) == len(rows) and all(np.isfinite(r.score) for r in found.values())
    assert found[5001].n_tokens == 30_001 and found[5000].n_tokens == 1
    # P(word, end) = P(class) P(word | class) P(end | class): of words of a class the counts decide
    counts = Counter(w for t in texts for w in t.split())
    for a in ("dog", "cat", "ox"):
        assert counts[a] == 9 and found[1000 + seen.index(a)].score < 0
    total = sum(10 ** found[1000 + i].score for i in range(len(seen) + 1)) + 10 ** found[5000].score
    assert 0 < total <= 1 + 1e-9
    assert brown_lm.scored(spark.createDataFrame([], "doc_id long, text string, train boolean")).count() == 0
    none = brown_lm.scored(spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")).first()
    assert none.train_tokens == 0 and none.n_known == 0 and np.isfinite(none.score)
