"""Token files and secrets against plain Python; queries with SQL against it."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from parlance.llm.queries import ORACLE_SQL, QUERIES
from parlance.llm.secrets import op1_secrets
from parlance.llm.token_output import op3_token_output

DIR = "/root/testdata/sf0.001"
SQL_DIR = "/root/testdata/sf0.01"


def texts(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DIR}/documents.parquet").collect())


def test_token_files_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for doc_id, text in texts(spark):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in op3_token_output(spark, DIR).collect()) == want


def test_secrets_base(spark):
    kinds = [
        ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    got = {r.doc_id: r for r in op1_secrets(spark, DIR).collect()}
    for doc_id, text in texts(spark):
        found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m)]
        spans = ",".join(x[2] for x in sorted(found))
        assert got[doc_id].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) - {""} <= set(got[doc_id].spans.split(","))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SQL_DIR}/{table}.parquet')")
    df = QUERIES[name](spark, SQL_DIR)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(str, want))
