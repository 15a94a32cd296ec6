"""Secret scan: parts of credentials, and the weak ones that complete each other.

A first pass finds the base secrets (``assign``, ``access``, ``hex``) and further parts by
role: identifiers (access ids, client ids, user and account names), secrets (base secrets,
short passwords, random-looking tokens) and endpoints (URLs, hosts, addresses with a port).
Many of these are weak: alone they are everyday text. They are reported only if they
complete each other, which an interval join decides: parts are rows keyed by document and
scope (a stretch of text between blank lines), each part is an interval reaching ``REACH``
characters beyond itself, and a weak part is linked if the interval meets one of a
complementary role. The join is a sort-merge over positions by window functions, which carry
the nearest part of each role from both sides past every part: a partner within reach exists
exactly if the nearest one is within reach, so no pairs are listed and a scope with very many
parts costs no more than its rows.

Secrets complete identifiers and endpoints; identifiers and endpoints complete secrets.

Edge cases: a null or empty text has no spans; a very long text is scanned whole; documents are told apart by row, so null,
repeated or equal ids keep their own spans; an empty table gives an empty result; other
columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import documents
from parlance.llm.spans import SPAN, counted, digest, listed

#: Characters within which parts of a credential complete each other.
REACH = 200
BASE = ("assign", "access", "hex")
WEAK = ("identifier", "password", "token", "endpoint")
KINDS = BASE + WEAK

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"\b(?:client_?id|user(?:_?name|_?id)?|login|account(?:_?id|_?name)?|access_?key(?:_?id)?|tenant(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@+/_.-]{3,})", re.I | re.A)
_PASSWORD = re.compile(r"\b(?:pwd|pass(?:code|phrase)?|pin|auth|bearer|credentials?|private_?key|key)[\"']?\x20*[:=]\x20*[\"']?([^\s\"',;]{4,})", re.I | re.A)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>|]+|\b(?:host(?:name)?|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9.-]{3,}(?::[0-9]{1,5})?)|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{1,5}\b", re.I | re.A)
_BLANK = re.compile(r"\n[ \t\r]*\n")
_MAY_BE_WEAK = re.compile(r"[:=]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that are long enough."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # the run is maximal, so asking for the length in the pattern drops the same matches
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _random_looking(token: str) -> bool:
    """Letters and digits that change often, as no word or number does."""
    digits = sum(c.isdigit() for c in token)
    if not 3 <= digits <= len(token) - 3:
        return False
    return sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:])) >= 4


def parts(text: str) -> list[tuple[str, str, int, int, int, bool]]:
    """kind, role, scope, start, end, weak of every part, weak ones only where no base span is."""
    base = base_spans(text)
    found = [(k, "identifier" if k == "access" else "secret", s, e, False) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def add(kind: str, role: str, start: int, end: int) -> None:
        i = bisect_right(starts, end - 1) - 1
        if i < 0 or reach[i] <= start:
            found.append((kind, role, start, end, True))

    if _MAY_BE_WEAK.search(text) or base:
        for m in _IDENTIFIER.finditer(text):
            add("identifier", "identifier", *m.span())
        for m in _PASSWORD.finditer(text):
            add("password", "secret", *m.span())
        for m in _ENDPOINT.finditer(text):
            add("endpoint", "endpoint", *m.span())
    if found:
        for m in _TOKEN.finditer(text):
            if _random_looking(m[0]):
                add("token", "secret", *m.span())
    if len(found) < 2 or not any(x[4] for x in found):
        return [(k, r, 0, s, e, w) for k, r, s, e, w in found if not w]
    cuts = [m.start() for m in _BLANK.finditer(text)]
    return [(k, r, bisect_right(cuts, s), s, e, w) for k, r, s, e, w in found]


PART = "array<struct<kind:string,role:string,scope:int,start:int,end:int,weak:boolean>>"
_PART = pa.list_(pa.struct([("kind", pa.string()), ("role", pa.string()), ("scope", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("weak", pa.bool_())]))


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end), linked weak parts among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _PART.value_type]
        for batch in batches:
            found = [[dict(zip(names, p)) for p in parts(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found, _PART)], names=["doc_id", "row", "parts"])

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string"))
    found = rows.mapInArrow(run, f"doc_id long, row long, parts {PART}")
    each = found.select("doc_id", "row", F.explode_outer("parts").alias("p")).select("doc_id", "row", "p.*")

    scope = Window.partitionBy("row", "scope").orderBy("start", "end", "kind")
    # nearest end before and nearest start after, of secrets and of what they complete
    before, after = scope.rowsBetween(Window.unboundedPreceding, -1), scope.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    is_secret = F.col("role") == "secret"
    near = each
    for name, holds in (("secret", is_secret), ("other", ~is_secret)):
        near = near.withColumn(f"{name}_before", F.max(F.when(holds, F.col("end"))).over(before))
        near = near.withColumn(f"{name}_after", F.min(F.when(holds, F.col("start"))).over(after))
    within = lambda name: F.coalesce(F.col("start") - F.col(f"{name}_before") <= reach, F.lit(False)) | F.coalesce(F.col(f"{name}_after") - F.col("end") <= reach, F.lit(False))
    linked = F.when(is_secret, within("other")).otherwise(within("secret"))
    keep = F.col("kind").isNotNull() & (~F.col("weak") | linked)
    span = F.when(keep, F.struct("kind", "start", "end"))
    return near.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(span).cast(SPAN).alias("spans")).select("doc_id", "spans")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked secrets of every document."""
    spans = F.col("spans")
    return scan(documents(spark, sf_dir)).select(
        "doc_id",
        *[counted(spans, k).alias(f"n_{k}") for k in BASE],
        digest(spans, BASE).alias("base_sha256"),
        listed(spans, KINDS).alias("spans"),
        *[counted(spans, k).alias(f"n_{k}") for k in WEAK],
        F.size(spans).cast("long").alias("n_spans"),
    )
