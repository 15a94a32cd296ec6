"""Token files: edge cases, long texts, random access."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import token_output as t
from parlance.llm.common import new_path

SCHEMA = "doc_id long, text string, shard int, path string, k0 int"
TEXTS = [
    (3, "One two  three\n\n four\tfive"),
    (1, "Plain words, with (marks) and it's 12.5% of n½, dogs' 日本語 x y."),
    (None, None),
    (None, "no id"),
    (5, ""),
    (5, "Plain words"),
    (5, "Plain words"),
    (2, " starts with a space"),
    (4, "ends with a line\n"),
    (9, "one line\nand another\nand a third"),
]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    return path, lambda text: [*whole.encode(text or "", add_special_tokens=False).ids, 0]


def test_edge_cases(spark, tokenizer):
    path, ids_of = tokenizer
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in TEXTS], SCHEMA)
    rows = t.read_documents(t.write_sequences(docs, new_path(spark, "edges"), path, length=8)).collect()
    want = sorted((str(d), len(ids := ids_of(x)), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, x in TEXTS)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 5, 5, 5, 9]


def test_empty_table(spark, tokenizer):
    docs = spark.createDataFrame([], SCHEMA)
    assert t.read_documents(t.write_sequences(docs, new_path(spark, "none"), tokenizer[0])).count() == 0


def test_long_texts_in_segments(tokenizer, monkeypatch):
    """Cuts at any place, and a table that is emptied again and again, change nothing."""
    path, ids_of = tokenizer
    random = np.random.default_rng(3)
    words = [f"w{i}" + "," * (i % 3 == 0) for i in range(300)]
    texts = ["".join(words[j] + (" " if random.random() < 0.8 else "\n") for j in random.integers(0, 300, 900)) + "end" for _ in range(5)] + ["x" * 5000, "é" * 40]
    for segment in (7, 100, 1 << 20):
        monkeypatch.setattr(t, "SEGMENT", segment)
        encoder, got = t.TextEncoder(path, limit=50, bits=10), [[]]
        for ids, whole in encoder(texts):
            got[-1] += ids.tolist()
            if whole:
                got.append([])
        assert got[:-1] == [ids_of(x) for x in texts]


def test_random_access_is_a_view(tmp_path, monkeypatch):
    monkeypatch.setattr(t, "BATCH_ROWS", 4)
    path, out = str(tmp_path / "a.arrow"), t.SequenceFile(str(tmp_path / "a.arrow"), np.dtype("<u2"), 16)
    ids = np.arange(1, 334, dtype="<u2")
    for i, part in enumerate(np.split(ids, [100, 101, 300])):
        out.add(part)
        out.end(i)
    out.close()
    reader = t.SequenceReader(path)
    before = pa.total_allocated_bytes()
    assert len(reader) == 21
    for i in (20, 0, 7, 13):
        row, mask = reader[i]
        real = ids[i * 16 : (i + 1) * 16]
        assert row[: len(real)].tolist() == real.tolist() and mask.true_count == len(real)
        assert not row.flags.owndata and not row.flags.writeable
    assert pa.total_allocated_bytes() == before  # neither ids nor mask were copied
    assert t.sequence(path, 3)[0].tolist() == ids[48:64].tolist()
    with pytest.raises(IndexError):
        reader[21]
    assert [d for d, _ in t.read_file(path)] == [0, 1, 2, 3]
