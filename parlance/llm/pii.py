"""Personal data: exact patterns, and a character-level tagger for what they miss.

The base spans (``email``, ``ip``, ``card``, ``phone``) follow fixed rules. A bidirectional
LSTM with CRF transitions learns characters' labels from labelled spans: the base spans of at
most ``SAMPLE`` documents of the table, those with the smallest md5 of their id, and seeded
examples, also of written forms that the rules don't know ("name [at] host [dot] org", a
phone number without a plus, a card number with dots). It reads every text in windows of
``WINDOW`` characters that overlap by half. The decoded windows are reconciled over the whole
text: each character has the label from the window in which it is nearer to the middle, and
runs of a label become spans. A span is added if it doesn't touch a base span and is of its
kind by a check that is laxer than the base rule; of the stretches that pass, the one that fits
the run best. Every such stretch holds a digit, an at sign or an "at" before a host and a dot,
so windows without any of these give no span and are not decoded.

Edge cases: a null or empty text has no spans; null or repeated ids don't matter, as a row's
spans come from its text alone (of the rows of an id in the sample the text with the smallest
hash is used); very long texts are tagged in groups of windows; numbers may have any length; an empty table
gives an empty result; other columns are ignored. Offsets count code points, ends are
exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import documents
from parlance.llm.lstm_crf import Tagger, codes
from parlance.llm.spans import SPAN, counted, digest, listed

BASE = ("email", "ip", "card", "phone")
ADDED = tuple(f"tagged_{k}" for k in BASE)
KINDS = BASE + ADDED
SAMPLE, WINDOW, ROUNDS, HIDDEN, EXAMPLES = 1_000, 64, 320, 28, 2_400
#: Windows tagged at once.
BATCH = 1024

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match begins at the first digit of a run, so later digits needn't be tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"[@0-9]|[\[(]\x20?at\x20?[\])]|\x20at\x20(?=[a-z0-9-]+\x20?(?:\.|[\[(]\x20?dot\x20?[\])]|\x20?dot\x20))", re.I)
_DIGITS = re.compile(r"[^0-9]+")


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign and domain, in time linear in the text."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that hold."""
    found = []
    found += [("email", *x) for x in _emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(_byte(x) for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return found


def window_starts(text: str) -> list[int]:
    """Starts of the windows, on a grid of half windows, that can hold anything."""
    half, last = WINDOW // 2, 0
    found: list[int] = []
    for m in _AT.finditer(text):
        cell = m.start() // half
        for k in (cell - 1, cell):
            if k >= 0 and k >= last:
                found.append(k * half)
                last = k + 1
    return found


def labels_of(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(len(text), np.int64)
    for kind, start, end in spans:
        out[start:end] = 1 + BASE.index(kind)
    return out


def cut(values: np.ndarray, starts: list[int], fill: int) -> np.ndarray:
    """Windows (time, windows) of values, filled up at the end."""
    padded = np.concatenate([values, np.full(WINDOW, fill, values.dtype)])
    return padded[np.arange(WINDOW)[:, None] + np.array(starts, np.int64)]


def tagged(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Runs of labels in each text, from all its windows."""
    where = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    encoded: dict[int, np.ndarray] = {}
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    labels: dict[int, dict[int, np.ndarray]] = {}
    for at in range(0, len(where), BATCH):
        some = where[at : at + BATCH]
        for i in {i for i, _ in some}.difference(encoded):
            encoded[i] = codes(texts[i])
        x = np.stack([cut(encoded[i][s : s + WINDOW], [0], 97)[:, 0] for i, s in some], axis=1)
        y = model.decode(x)
        for k in np.flatnonzero(y.any(axis=0)).tolist():
            labels.setdefault(some[k][0], {})[some[k][1]] = y[:, k]
    half, quarter = WINDOW // 2, WINDOW // 4
    for i, found in labels.items():
        text, own = texts[i], set(window_starts(texts[i]))
        whole = np.zeros(len(text) + WINDOW, np.int8)
        for s, y in found.items():
            # the middle half of a window is its own; its ends only where no other window is
            whole[s + quarter : s + half + quarter] = y[quarter : half + quarter]
            if s - half not in own:
                whole[s : s + quarter] = y[:quarter]
            if s + half not in own:
                whole[s + half + quarter : s + WINDOW] = y[half + quarter :]
        whole = whole[: len(text)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], whole, [0]])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if whole[a]:
                out[i].append((BASE[whole[a] - 1], a, b))
    return out


_LAX = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+\x20?(?:@|[\[(]\x20?at\x20?[\])]|\x20at\x20)\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])]|\x20?dot\x20)\x20?[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?:\x20?[.\[\]()]{1,3}\x20?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\x20._/-]{0,3}[0-9]){11,18}"),
    "phone": re.compile(r"(?:\+|\(|[0-9])[0-9\x20().\-/]{7,22}[0-9]"),
}
#: A match doesn't begin or end inside a run of these.
_INSIDE = {"email": re.compile(r"[A-Za-z0-9_%+]"), "ip": re.compile("[0-9]"), "card": re.compile("[0-9]"), "phone": re.compile("[0-9]")}
MARGIN = 8


def _holds(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    digits = _DIGITS.sub("", found)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and found.count("(") == found.count(")")
    return all(_byte(x) for x in re.findall("[0-9]+", found))


def _lax(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The stretch of the kind, in the tagged run or a little around it, that fits the run best."""
    best, at, inside = None, None, _INSIDE[kind]
    last = min(len(text), end + MARGIN)
    for s in range(max(0, start - MARGIN), end):
        if s and inside.match(text[s - 1]) and inside.match(text[s]):
            continue
        m = _LAX[kind].match(text, s, last)
        while m:
            e = m.end()
            if e > start and not (e < len(text) and inside.match(text[e]) and inside.match(text[e - 1])) and _holds(kind, m[0]):
                fit = min(e, end) - max(s, start) - max(0, start - s) - max(0, e - end)
                if best is None or fit > best:
                    best, at = fit, (s, e)
            m = _LAX[kind].match(text, s, e - 1) if kind != "email" and e - 1 > s else None
    return at if best is not None and 2 * best >= end - start else None


def spans_of(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    out = []
    for text, runs in zip(texts, tagged(model, texts)):
        base = base_spans(text)
        found = list(base)
        for kind, start, end in runs:
            if all(e <= start or s >= end for _, s, e in found) and (at := _lax(kind, text, start, end)):
                if all(e <= at[0] or s >= at[1] for _, s, e in found):
                    found.append((f"tagged_{kind}", *at))
        out.append(found)
    return out


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Seeded texts with labelled spans, half of them in forms the base rules don't know."""
    random = np.random.default_rng(seed)
    pick = lambda *x: x[random.integers(len(x))]
    word = lambda: "".join(chr(97 + c) for c in random.integers(0, 26, random.integers(2, 9)))
    number = lambda k: "".join(str(d) for d in random.integers(0, 10, k))

    def card() -> str:
        body = number(15)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def one(kind: str) -> str:
        if kind == "email":
            at, dot = pick(("@", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), (" at ", " dot "), (" @ ", "."))
            return f"{word()}{pick('', '.' + word(), number(2))}{at}{word()}{dot}{pick('com', 'org', 'net', 'example' + dot + 'com')}"
        if kind == "ip":
            return pick(".", "[.]", "(.)", " . ").join(str(x) for x in random.integers(0, 256, 4))
        if kind == "card":
            c, by = card(), pick("", " ", "-", ".", "/", " - ")
            return by.join(c[i : i + 4] for i in range(0, 16, 4))
        return pick("+{}{} {} {}", "+{}{}-{}-{}", "({}{}) {}-{}", "00{}{} {}{}", "00{} {} {} {}", "({}{}) {} {}", "+{} ({}) {}-{}").format(number(1), number(2), number(3), number(4))

    found = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < 2 * WINDOW:
            if random.random() < 0.25:
                kind = BASE[random.integers(4)]
                value = one(kind)
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + pick(" ", ", ", ".\n")
            elif random.random() < 0.25:
                text += pick(number(random.integers(1, 9)), f"{number(1)}.{number(1)}.{number(1)}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", f"v{number(1)}.{number(2)}", "CC BY 4.0", f"{word()}{number(3)}", f"{number(2)} at {word()}", f"@{word()}", f"{number(3)}.{number(2)}") + " "
            else:
                text += pick(word(), word().title()) + pick(" ", " ", ", ", ".\n")
        found.append((text, spans))
    return found


def train(docs: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Tagger:
    """The tagger, from base spans of at most ``sample`` documents and the seeded examples."""
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    text = F.col("text").cast("string")
    chosen = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias("text"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the stretches around labels and numbers, a few from each document
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                starts = window_starts(text or "")
                rows += [text[s : s + WINDOW] for s in starts[:: max(1, len(starts) // 8)][:8]]
            yield pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string())})

    own = sorted(r["text"] for r in chosen.select("text").mapInArrow(cut_out, "text string").collect())
    labelled = examples() + [(t, base_spans(t)) for t in own]
    xs, ys = [], []
    for text, spans in labelled:
        starts = window_starts(text) or [0]
        xs.append(cut(codes(text), starts, 97))
        ys.append(cut(labels_of(text, spans), starts, 0))
    model = Tagger(1 + len(BASE), HIDDEN, HIDDEN)
    model.fit(np.concatenate(xs, axis=1), np.concatenate(ys, axis=1), rounds)
    return model


def find(docs: DataFrame, model: Tagger) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("kind", "start", "end")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [[dict(zip(names, x)) for x in spans] for spans in spans_of(shared.value, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPAN}")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and tagged personal data of every document."""
    docs = documents(spark, sf_dir)
    spans = F.col("spans")
    found = find(docs, train(docs))
    return found.select(
        "doc_id",
        *[counted(spans, k).alias(f"n_{k}") for k in BASE],
        digest(spans, BASE).alias("base_sha256"),
        listed(spans, KINDS).alias("spans"),
        *[counted(spans, k).alias(f"n_{k}") for k in ADDED],
        F.size(spans).cast("long").alias("n_spans"),
    )
