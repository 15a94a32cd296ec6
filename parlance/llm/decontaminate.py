"""Benchmark decontamination by templates.

Texts become templates: words are lower-cased and freed of punctuation, and numbers, units
(after a number) and names (capitalised inside a sentence) become typed placeholders. Windows
of ``WIDTH`` template words of the benchmark are hash-joined with those of all documents, so a
question is found again when only its numbers, units or names were changed. A capitalised word
that starts a sentence may be a name or not, so windows over it have both forms, on both sides.
A hit keeps the values that stand in the slots of both sides. Hits of one alignment of an item
in a document are accepted only if their slots are consistent: each value of the item has been
replaced by one value throughout. Hits that take a sentence's first word as a name are left
out where that is what makes a value inconsistent. A document is contaminated by an item if
accepted windows cover at least ``COVERAGE`` of the item's windows.

Items without any window of enough words (short ones, arithmetic) are searched for verbatim:
their windows are of words as they stand, lower-cased and freed of punctuation, and of lone
marks.

Windows of the benchmark are sent to all tasks while there are at most ``BROADCAST_WINDOWS``
of them, which is counted first; beyond that, the windows of all documents are shuffled and
joined by their hash. Both ways give the same rows.

Edge cases: null or empty texts have no windows; an item of fewer than ``WIDTH`` words is one
window of its own length, and one of fewer than ``LEAST`` words is searched for verbatim, so
a one-word item is in every document with that word; a window with more placeholders than
words says too little and is not used; rows with the same document id count as one document; repeated items count each; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import MULTIPLIERS, documents, kept, mix, stored

WIDTH, LEAST, COVERAGE = 8, 4, 0.5
BROADCAST_WINDOWS = 1_000_000
#: Words after which the windows of texts are made, of several short ones at once.
TOGETHER = 20_000

#: Number words of English, German, French and Spanish, without those that are also articles or other common words.
NUMBER_WORDS = frozenset(
    (
        "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
        " null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen milliarde milliarden"
        " deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante soixante mille millions milliard milliards"
        " cero dos tres cuatro cinco seis siete ocho nueve diez doce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones"
    ).split()
)
#: Units, as they count after a number alone.
UNITS = frozenset(
    (
        "% percent mm cm m km meter meters metre metres inch inches foot feet yard yards mile miles mg g kg gram grams tonne tonnes pound pounds lb ounce ounces ml l liter liters litre litres"
        " second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp watt watts kw volt volts kb mb gb tb degree degrees celsius fahrenheit mph"
        " prozent metern kilometer zoll fuß meile meilen gramm kilogramm tonnen pfund litern sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren grad"
        " pour-cent mètre mètres kilomètre kilomètres pouce pouces pied pieds gramme grammes kilogramme kilogrammes livre livres seconde secondes heure heures jour jours semaine semaines mois année années ans degré degrés"
        " metro metros kilómetro kilómetros pulgada pulgadas pie pies gramo gramos kilogramo kilogramos tonelada toneladas litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años dólar dólares grado grados kmh"
    ).split()
)

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"\d[\d.,:/]*")
_MEASURE = re.compile(r"(\d[\d.,]*)([^\W\d_]{1,3})")
#: Kinds of a raw word, as bits.
PLAIN, NUMBER, UNIT, CAPITAL, STOPS, BLANK = 0, 1, 2, 4, 8, 16
#: Multipliers of the places of a window, and the seed of verbatim ones.
_PLACES = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * MULTIPLIERS[2]) | np.uint64(1)
_VERBATIM = MULTIPLIERS[4]
_BITS = np.array([bin(x).count("1") for x in range(1 << WIDTH)])


class Templates:
    """Template hashes of the words of a text; what a raw word gives is remembered."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        self.digest, self.limit = xxhash.xxh3_64_intdigest, limit
        self.known: dict[str, tuple[int, int]] = {}
        self.literal: dict[str, int] = {}
        self.number, self.unit, self.name = (self.digest(x) for x in ("<number>", "<unit>", "<name>"))

    def _look(self, raw: str) -> tuple[int, int]:
        stops = STOPS if raw[-1] in ".!?:;\"'”»)" and raw.rstrip("\"'”»)")[-1:] in (".", "!", "?", ":", ";") else 0
        word = _EDGES.sub("", raw)
        if not word:
            return (self.digest("%"), UNIT | stops) if "%" in raw else (0, BLANK | stops)
        low = word.lower()
        if _NUMBER.fullmatch(word) or _MEASURE.fullmatch(word) or low in NUMBER_WORDS:
            return self.number, NUMBER | stops
        kind = UNIT if low in UNITS else 0
        if word[0].isupper() and not (len(word) > 1 and word.isupper()):
            kind |= CAPITAL
        return self.digest(low.encode("utf-8", "surrogatepass")), kind | stops

    def verbatim(self, text: str | None) -> np.ndarray:
        """Hashes of the words and lone marks of a text as they stand."""
        raw = text.split() if text else []
        known = self.literal
        if len(known) > self.limit:
            known.clear()
        for w in set(raw).difference(known):
            known[w] = self.digest((_EDGES.sub("", w) or w).lower().encode("utf-8", "surrogatepass"))
        return np.fromiter((known[w] for w in raw), np.uint64, len(raw))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Template hashes, which of them are placeholders, which may be names too, and the raw words."""
        raw = text.split() if text else []
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(raw).difference(known):
            known[w] = self._look(w)
        found = [known[w] for w in raw]
        h = np.fromiter((x[0] for x in found), np.uint64, len(raw))
        kind = np.fromiter((x[1] for x in found), np.uint8, len(raw))
        if (kind & BLANK).any():
            # a lone mark is no word, but it may end a sentence
            keep = np.flatnonzero(kind & BLANK == 0)
            ended = np.flatnonzero((kind & BLANK != 0) & (kind & STOPS != 0))
            before = np.searchsorted(keep, ended) - 1
            h, marks = h[keep], kind[keep]
            marks[before[before >= 0]] |= STOPS
            kind, raw = marks, [raw[i] for i in keep]
        starts = np.ones(len(h), bool)
        starts[1:] = kind[:-1] & STOPS != 0
        after_number = np.zeros(len(h), bool)
        after_number[1:] = kind[:-1] & NUMBER != 0
        name = (kind & CAPITAL != 0) & ~starts
        unit = (kind & UNIT != 0) & after_number
        h[name], h[unit] = self.name, self.unit
        return h, name | unit | (kind & NUMBER != 0), (kind & CAPITAL != 0) & starts & ~unit, raw


def _sums(h: np.ndarray, width: int) -> np.ndarray:
    n = max(len(h) - width + 1, 0)
    out = np.full(n, width, np.uint64)
    for i in range(width if n else 0):
        out += h[i : i + n] * _PLACES[i]
    return out


def windows(h: np.ndarray, slot: np.ndarray, maybe: np.ndarray, name: int, width: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``width`` template words that have enough words: their hashes, places, and
    which of their words are taken as names (bits), in each way for the words ``maybe``.
    ``ends``: of each word, where its text ends, if there are several."""
    key = _sums(h, width)
    slots = np.concatenate([[0], np.cumsum(slot)])
    filled = slots[width:] - slots[:-width] if len(key) else np.empty(0, np.int64)
    good = 2 * filled <= width
    if ends is not None:
        good &= np.arange(width, width + len(key)) <= ends[: len(key)]
    first, change = np.flatnonzero(maybe), np.uint64(name) - h
    at, also, names = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint8)
    for i in range(width if len(first) else 0):
        new = first - i
        new = new[(new >= 0) & (new < len(key))]
        new = new[good[new] & (2 * filled[new] + 2 <= width)]
        use = np.flatnonzero(maybe[at + i])
        use = use[2 * (filled[at[use]] + _BITS[names[use]] + 1) <= width]
        more, bit = np.concatenate([new, at[use]]), np.uint8(1 << i)
        also = np.concatenate([also, np.concatenate([key[new], also[use]]) + change[more + i] * _PLACES[i]])
        names = np.concatenate([names, np.full(len(new), bit), names[use] | bit])
        at = np.concatenate([at, more])
    plain = np.flatnonzero(good)
    return mix(np.concatenate([key[plain], also])), np.concatenate([plain, at]), np.concatenate([np.zeros(len(plain), np.uint8), names])


def verbatim_windows(h: np.ndarray, width: int) -> np.ndarray:
    return mix(_sums(h, width) ^ _VERBATIM)


def _templates() -> Templates:
    return kept("templates", Templates)


def _values(raw: list[str], slot: np.ndarray, at: int, width: int, names: int) -> list[str]:
    return [_EDGES.sub("", raw[at + i]).lower() for i in range(width) if slot[at + i] or names >> i & 1]


WINDOW = "key long, id long, pos int, width int, vals array<string>, soft boolean, literal boolean"
_WINDOW = pa.schema(
    [("key", pa.int64()), ("id", pa.int64()), ("pos", pa.int32()), ("width", pa.int32()), ("vals", pa.list_(pa.string())), ("soft", pa.bool_()), ("literal", pa.bool_())]
)
HIT = "doc_id long, item_id long, at int, pos int, slots array<struct<item:string,doc:string>>, soft boolean"
_HIT = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("at", pa.int32()), ("pos", pa.int32()), ("slots", pa.list_(pa.struct([("item", pa.string()), ("doc", pa.string())]))), ("soft", pa.bool_())]
)


def _template_rows(make: Templates, id: int | None, text: str | None, widths: list[int] | None) -> list[tuple]:
    h, slot, maybe, raw = make(text)
    rows = []
    for width in [min(WIDTH, len(h))] if widths is None else widths:
        if width >= LEAST:
            keys, at, names = windows(h, slot, maybe, make.name, width)
            found = zip(keys.view(np.int64).tolist(), at.tolist(), names.tolist())
            rows += [(k, id, i, width, _values(raw, slot, i, width, m), m > 0, False) for k, i, m in found]
    return rows


def _verbatim_rows(make: Templates, id: int | None, text: str | None, widths: list[int] | None) -> list[tuple]:
    h = make.verbatim(text)
    rows = []
    for width in [min(WIDTH, len(h))] if widths is None else widths:
        if width:
            rows += [(k, id, i, width, [], False, True) for i, k in enumerate(verbatim_windows(h, width).view(np.int64).tolist())]
    return rows


def _item_windows(benchmark: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _templates()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                rows += _template_rows(make, item, text, None) or _verbatim_rows(make, item, text, None)
            yield _batch(rows, _WINDOW)

    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, WINDOW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _hits_by_broadcast(docs: DataFrame, found: list) -> DataFrame:
    """``found``: the windows of the benchmark, few enough to be in every task."""
    by_key: dict[int, list[tuple]] = {}
    for r in found:
        by_key.setdefault(r["key"], []).append((r["id"], r["pos"], r["vals"], r["soft"]))
    widths = [sorted({r["width"] for r in found if r["literal"] == literal}) for literal in (False, True)]
    shared = docs.sparkSession.sparkContext.broadcast((by_key, *widths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, widths, literal_widths = shared.value
        make = _templates()
        keys = np.array(sorted(items), np.int64)
        likely = np.zeros(1 << 20, bool)
        likely[keys.view(np.uint64) >> np.uint64(44)] = True

        def template_hits(together: list[tuple]) -> Iterator[tuple]:
            docs, hs, slots, maybes, raws = zip(*together)
            sizes = [len(x) for x in hs]
            h, slot, maybe = np.concatenate(hs), np.concatenate(slots), np.concatenate(maybes)
            last = np.cumsum(sizes)
            ends = np.repeat(last, sizes)
            for width in widths:
                w, at, names = windows(h, slot, maybe, make.name, width, ends)
                for j in np.flatnonzero(likely[w >> np.uint64(44)]).tolist():
                    for item, pos, vals, soft in items.get(int(w[j].view(np.int64)), ()):
                        d, m = int(np.searchsorted(last, at[j], "right")), int(names[j])
                        i = int(at[j] - last[d]) + sizes[d]
                        found = _values(raws[d], slots[d], i, width, m)
                        yield docs[d], item, i - pos, pos, [{"item": a, "doc": b} for a, b in zip(vals, found)], soft or m > 0

        for batch in batches:
            rows, together, n_words = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if widths and text:
                    together.append((doc, *make(text)))
                    n_words += len(together[-1][1])
                    if n_words > TOGETHER:
                        rows += template_hits(together)
                        together, n_words = [], 0
                literal = make.verbatim(text) if literal_widths else None
                for width in literal_widths:
                    w = verbatim_windows(literal, width)
                    for i in np.flatnonzero(likely[w >> np.uint64(44)]).tolist():
                        rows += [(doc, item, i - pos, pos, [], False) for item, pos, _, _ in items.get(int(w[i].view(np.int64)), ())]
            if together:
                rows += template_hits(together)
            yield _batch(rows, _HIT)

    return docs.mapInArrow(run, HIT)


def _hits_by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = items.select("literal", "width").distinct().collect()  # at most 2 * WIDTH rows
    widths, literal_widths = ([r["width"] for r in found if r["literal"] == literal] for literal in (False, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _templates()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some, rows = batch.slice(at, 100), []
                for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    rows += _template_rows(make, doc, text, widths) if widths else []
                    rows += _verbatim_rows(make, doc, text, literal_widths) if literal_widths else []
                yield _batch(rows, _WINDOW)

    own = docs.mapInArrow(run, WINDOW).select("key", F.col("id").alias("doc_id"), F.col("pos").alias("i"), F.col("vals").alias("found"), F.col("soft").alias("soft_too"))
    joined = own.join(items, "key")
    slots = F.zip_with("vals", "found", lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    return joined.select(
        "doc_id", F.col("id").alias("item_id"), (F.col("i") - F.col("pos")).alias("at"), "pos", slots.alias("slots"), (F.col("soft") | F.col("soft_too")).alias("soft")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Pairs of a document and an item found in it: doc_id, item_id, n_windows, item_windows,
    coverage, verbatim (all slot values are the item's own).
    """
    items = stored(_item_windows(benchmark), "windows")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = items.count()
    if n <= broadcast_windows:
        hits = _hits_by_broadcast(docs, items.collect())
    else:
        hits = _hits_by_shuffle(docs, items)
    whole = hits.groupBy("doc_id", "item_id", "at").agg(F.collect_set(F.struct("pos", "slots", "soft")).alias("hits"))
    pairs_of = lambda column: F.array_distinct(F.flatten(F.transform(column, lambda x: x["slots"])))
    items_of = lambda column: F.transform(column, lambda x: x["item"])
    # values of the item that were replaced by more than one value
    twice = F.filter(items_of("slots"), lambda v: F.size(F.filter(F.col("slots"), lambda x: x["item"] == v)) > 1)
    whole = whole.withColumn("slots", pairs_of("hits")).withColumn("twice", twice)
    sure = F.filter("hits", lambda x: ~x["soft"] | ~F.arrays_overlap(items_of(x["slots"]), F.col("twice")))
    whole = whole.withColumn("hits", F.when(F.size("twice") > 0, sure).otherwise(F.col("hits"))).withColumn("slots", pairs_of("hits"))
    consistent = F.size("slots") == F.size(F.array_distinct(items_of("slots")))
    same = F.forall("slots", lambda x: x["item"] == x["doc"])
    spread = whole.where(consistent).select("doc_id", "item_id", same.alias("same"), F.explode("hits.pos").alias("pos"))
    pairs = spread.groupBy("doc_id", "item_id").agg(F.countDistinct("pos").alias("n_windows"), F.min("same").alias("verbatim"))
    sizes = items.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("pos").alias("item_windows"))
    share = F.col("n_windows") / F.col("item_windows")
    return (
        pairs.join(sizes, "item_id")
        .select("doc_id", "item_id", "n_windows", "item_windows", share.alias("coverage"), "verbatim")
        .where(F.col("coverage") >= coverage)
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark that documents contain."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
