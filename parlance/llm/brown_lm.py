"""Language-model scoring with Brown classes.

Words (runs of other than ASCII white space, A-Z lower-cased) and an end per document are
counted over all training documents. Exchange clustering (Martin, Liermann, Ney 1998; the
criterion is Brown's) assigns every training word to a class so that class bigrams explain
the training text best:

1. The ``UNITS`` most frequent words, and ``TYPES`` types of all others by length and last
   two bytes, are exchanged one after the other on their bigram table, which has a bounded
   size. This gives the first classes.
2. Then all words of the training text are exchanged, as Spark jobs (Uszkoreit and Brants
   2008): the counts of the classes before and after each word are gathered by word, and each word
   takes the class that makes its own tokens likeliest given the classes of its neighbours.
   This is repeated ``ROUNDS`` times.

The number of classes grows with the vocabulary, as its fourth root.

The model's probability of a text is the product of class transitions and of the words'
emissions from their classes, both smoothed by added counts: of a class with N tokens of V
words, a word seen c times has (c + 1) / (N + V + 1), an unseen one 1 / (N + V + 1). An unseen word
has the class of its type.

Words and their classes stay distributed tables. The words of at most ``HEAD`` are numbered
and sent to all tasks, cut off by a level of counts that keeps their number below it, as they
make up most tokens; all texts are stored once as these numbers. Tokens of other words
are joined to the table by a shuffle, with the classes beside them. In step 2 such a token
counts as a neighbour by the class of its type; in the model it has its own class.

Edge cases: a null or empty text has the end alone; a null id is trained on; repeated rows
count and are scored as often as they occur; ties go to the class of the smaller number; without
training documents N and V are 0 and every word is unseen; a very long text is one row of
numbers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import ascii_words, documents, fold, stored

HEAD, UNITS, TYPES, ROUNDS = 300_000, 400, 64, 2
FOLDS, HELD_OUT = 7, 2
#: Words that a task counts before it passes the counts on, and tokens whose neighbours it counts.
HELD_WORDS, HELD_TOKENS = 400_000, 2_000_000


def n_classes(words: int) -> int:
    return max(16, int(2 * words**0.25))


def type_of(word: bytes) -> int:
    """One of ``TYPES`` types of rare words: four lengths times endings."""
    size = 0 if len(word) < 5 else 1 if len(word) < 9 else 2 if len(word) < 13 else 3
    return size * (TYPES // 4) + zlib.crc32(word[-2:]) % (TYPES // 4)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over the texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(ascii_words(text))
            if len(held) > HELD_WORDS:
                yield _counts(held)
                held = Counter()
        yield _counts(held)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})


def head_of(vocabulary: DataFrame, most: int = HEAD) -> dict[bytes, int]:
    """The most frequent words and their counts: all above a level of counts, ``most`` at most."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r[0], r[1]) for r in vocabulary.groupBy(level).count().collect()), reverse=True)  # 1,024 levels at most
    total, least = 0, None
    for at, n in sizes:
        if total + n > most:
            break
        total, least = total + n, at
    if least is None:
        return {}
    return {bytes(r["word"]): r["n"] for r in vocabulary.where(level >= least).collect()}


class Numbers(dict):
    """Numbers of the head's words, from 1 by falling counts; any other word has 0."""

    def __init__(self, head: dict[bytes, int] | None = None):
        order = sorted((head or {}).items(), key=lambda x: (-x[1], x[0]))
        super().__init__((w, i) for i, (w, _) in enumerate(order, 1))

    def __missing__(self, word: bytes) -> int:
        return 0


def encoded(docs: DataFrame, numbers: Numbers) -> DataFrame:
    """doc_id, row, train, ids, rest of each text: the words' numbers, -1 - type for a word
    outside the head, and those words in order."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        numbers.update(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch, ids, rest = whole.slice(at, 250), [], []
                for text in batch.column("text").to_pylist():
                    words = ascii_words(text)
                    found = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                    tail = np.flatnonzero(found == 0)
                    rest.append([words[i] for i in tail.tolist()])
                    found[tail] = [-1 - type_of(w) for w in rest[-1]]
                    ids.append(found)
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "train")), lists, pa.array(rest, pa.list_(pa.binary()))], names=["doc_id", "row", "train", "ids", "rest"])

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "train", F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, row long, train boolean, ids array<int>, rest array<binary>")


def _sequence(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all texts of a batch with a 0 before, between and after them; where each
    text's end stands; the places of the words."""
    flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
    places = np.arange(len(flat)) + np.repeat(np.arange(len(lists)), lengths) + 1
    out = np.zeros(len(flat) + len(lists) + 1, np.int64)
    out[places] = flat
    return out, np.cumsum(lengths + 1), places


def _cells(texts: DataFrame, table: np.ndarray, size: int, tails: bool) -> np.ndarray:
    """Counts of pairs of neighbours after mapping numbers by ``table``, which begins at -TYPES;
    with ``tails``, of pairs with words outside the head, too."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cells = shared.value, np.zeros(size * size, np.int64)
        for batch in batches:
            s, _, _ = _sequence(batch.column("ids"))
            to = table[s + TYPES]
            pair = to[:-1] * size + to[1:]
            cells += np.bincount(pair if tails else pair[(s[:-1] >= 0) & (s[1:] >= 0)], minlength=size * size)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(cells[at], pa.int64())})

    out = np.zeros(size * size)
    for r in texts.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # size squared rows at most
        out[r["cell"]] = r["n"]
    return out.reshape(size, size)


def _h(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 6) -> np.ndarray:
    """The class of each unit. Unit 0 keeps class 0; other units move, one after the other, to
    the class from 1 up that raises the likelihood of class bigrams most, until none moves."""
    size = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = [u for u in np.argsort(-weight, kind="stable").tolist() if u]
    of = np.zeros(size, np.int64)
    for i, u in enumerate(order):
        of[u] = 1 + i % (classes - 1)
    member = np.eye(classes)[of]
    table = member.T @ bigrams @ member
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            was, loop = of[u], bigrams[u, u]
            out, into = bigrams[u] @ member, bigrams[:, u] @ member
            out[was] -= loop
            into[was] -= loop
            table[was] -= out
            table[:, was] -= into
            table[was, was] -= loop
            rows, columns = table.sum(1), table.sum(0)
            # what the likelihood gains if u joins each class: changed cells, then class totals
            gain = (_h(table + out) - _h(table)).sum(1) + (_h(table + into[:, None]) - _h(table)).sum(0)
            own = np.diagonal(table)
            gain += _h(own + out + into + loop) - _h(own + out) - _h(own + into) + _h(own)
            n_out, n_in = out.sum() + loop, into.sum() + loop
            gain -= _h(rows + n_out) - _h(rows) + _h(columns + n_in) - _h(columns)
            gain[0] = -np.inf
            now = int(np.argmax(gain)) if gain.max() > gain[was] + 1e-9 else was
            table[now] += out
            table[:, now] += into
            table[now, now] += loop
            if now != was:
                member[u, was], member[u, now], of[u] = 0, 1, now
                moved += 1
        if not moved:
            break
    return of


def neighbours(texts: DataFrame, of: np.ndarray, classes: int) -> DataFrame:
    """id, word (outside the head, where id is 0), codes, counts: how often a class comes before
    a word (code: the class) and after it (``classes`` more). Several rows a word."""
    shared, wide = texts.sparkSession.sparkContext.broadcast(of), 2 * classes

    def rows(ids: np.ndarray, codes: np.ndarray, words: list[bytes] | None = None) -> pa.RecordBatch:
        cell, n = np.unique(ids * wide + codes, return_counts=True)
        owner = cell // wide
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(cell) else np.empty(0, np.int64)
        offsets = pa.array(np.r_[first, len(cell)], pa.int32())
        own = owner[first]
        return pa.RecordBatch.from_pydict(
            {
                "id": pa.array(own if words is None else np.zeros(len(own)), pa.int32()),
                "word": pa.array([None] * len(own) if words is None else [words[i] for i in own.tolist()], pa.binary()),
                "codes": pa.ListArray.from_arrays(offsets, pa.array(cell % wide, pa.int16())),
                "counts": pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32())),
            }
        )

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        ids, codes, rare, rare_codes = (np.concatenate(x) for x in list(zip(*held))[:4])
        yield rows(ids, codes)
        place: dict[bytes, int] = {}
        numbers = np.array([place.setdefault(w, len(place)) for x in held for w in x[4]], np.int64)
        yield rows(np.repeat(numbers, 2), rare_codes, list(place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size = shared.value, [], 0
        for batch in batches:
            s, _, places = _sequence(batch.column("ids"))
            to = of[s + TYPES]
            codes = np.stack([to[places - 1], to[places + 1] + classes], axis=1)
            own = s[places]
            rest = [w for some in batch.column("rest").to_pylist() for w in some]
            held.append((np.repeat(own[own > 0], 2), codes[own > 0].ravel(), own[own < 0], codes[own < 0].ravel(), rest))
            size += len(own)
            if size > HELD_TOKENS:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return texts.select("ids", "rest").mapInArrow(run, "id int, word binary, codes array<short>, counts array<int>")


def reassigned(found: DataFrame, bigrams: np.ndarray) -> DataFrame:
    """id, word, class: of every word the class that its neighbours (``neighbours``) make likeliest."""
    classes = len(bigrams)
    step = np.log((bigrams + 0.5) / (bigrams.sum(1, keepdims=True) + 0.5 * classes))
    size = np.log(bigrams.sum(0) + 1)

    def choose(ids: np.ndarray, words: list, codes: pa.ListArray, counts: pa.ListArray) -> pa.RecordBatch:
        new = np.r_[True, (ids[1:] != ids[:-1]) | np.array([a != b for a, b in zip(words[1:], words[:-1])], bool)]
        group = np.cumsum(new) - 1
        cell = np.repeat(group, codes.value_lengths().to_numpy()) * 2 * classes + codes.flatten().to_numpy()
        table = np.bincount(cell, counts.flatten().to_numpy(), minlength=2 * classes * (group[-1] + 1)).reshape(-1, 2 * classes)
        before, after = table[:, :classes], table[:, classes:]
        fit = before @ step + after @ step.T - after.sum(1, keepdims=True) * size
        fit[:, 0] = -np.inf  # the end's class
        return pa.RecordBatch.from_pydict({"id": pa.array(ids[new], pa.int32()), "word": pa.array([w for w, x in zip(words, new.tolist()) if x], pa.binary()), "class": pa.array(fit.argmax(1), pa.int16())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            ids, words = table.column("id").to_numpy(), table.column("word").to_pylist()
            other = next((i for i in range(len(ids) - 1, -1, -1) if ids[i] != ids[-1] or words[i] != words[-1]), -1) + 1
            if other:  # the last word may go on
                yield choose(ids[:other], words[:other], *(table.column(c).chunk(0).slice(0, other) for c in ("codes", "counts")))
                held = table.slice(other).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if table.num_rows:
                yield choose(table.column("id").to_numpy(), table.column("word").to_pylist(), table.column("codes").chunk(0), table.column("counts").chunk(0))

    return found.repartition("id", "word").sortWithinPartitions("id", "word").mapInArrow(run, "id int, word binary, class short")


def rare_tokens(texts: DataFrame, of: np.ndarray) -> DataFrame:
    """row, train, word, kind (its type's class), left, right (classes beside it, -1 for a word
    outside the head), before (that word on the left, if so), of each token outside the head."""
    shared = texts.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            s, ends, _ = _sequence(batch.column("ids"))
            at = np.flatnonzero(s < 0)
            words = batch.column("rest").flatten()
            doc = np.searchsorted(ends, at)
            left, right = s[at - 1], s[at + 1]
            before = np.where(left < 0, np.arange(len(at)) - 1, -1)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": batch.column("row").take(pa.array(doc)),
                    "train": batch.column("train").take(pa.array(doc)),
                    "word": words,
                    "kind": pa.array(of[s[at] + TYPES], pa.int16()),
                    "left": pa.array(np.where(left < 0, -1, of[left + TYPES]), pa.int16()),
                    "right": pa.array(np.where(right < 0, -1, of[right + TYPES]), pa.int16()),
                    "before": words.take(pa.array(before, mask=before < 0)),
                    "before_kind": pa.array(of[left + TYPES], pa.int16()),
                }
            )

    schema = "row long, train boolean, word binary, kind short, left short, right short, before binary, before_kind short"
    return texts.select("row", "train", "ids", "rest").mapInArrow(run, schema)


def _head_scores(texts: DataFrame, of: np.ndarray, logs: np.ndarray, step: np.ndarray, emit: np.ndarray) -> DataFrame:
    """doc_id, row, n_tokens, and of the head's tokens: how many, log10 of their counts, and the
    classes' log10 probability (transitions between two of them, or the end)."""
    shared = texts.sparkSession.sparkContext.broadcast((of, logs, step, emit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, logs, step, emit = shared.value
        for batch in batches:
            s, ends, _ = _sequence(batch.column("ids"))
            to, head = of[s + TYPES], s >= 0
            now = np.where(head[1:] & head[:-1], step[to[:-1], to[1:]], 0.0) - np.where(head[1:], emit[to[1:]], 0.0)
            known = np.where(s[1:] > 0, logs[np.maximum(s[1:], 0)], 0.0)
            starts = np.r_[0, ends[:-1]]
            sums = [np.add.reduceat(x, starts) if len(starts) else x for x in (known, (s[1:] > 0).astype(np.int64), now)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(ends - starts, pa.int64()), pa.array(sums[0]), pa.array(sums[1], pa.int64()), pa.array(sums[2])],
                names=["doc_id", "row", "n_tokens", "head_log", "head_n", "class_log"],
            )

    return texts.select("doc_id", "row", "ids").mapInArrow(run, "doc_id long, row long, n_tokens long, head_log double, head_n long, class_log double")


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc_id, text, train): doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", F.col("text").cast("string"), F.coalesce("train", F.lit(False)).alias("train"))
    vocabulary = stored(word_counts(docs.where("train")), "vocabulary")
    n_words, n_different = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = docs.where("train").count()
    total, different = n_words + ends, n_different + (ends > 0)
    head = head_of(vocabulary)
    numbers = Numbers(head)
    words = list(numbers)
    texts = stored(encoded(docs, numbers), "encoded")
    training = texts.where("train")

    # the first classes: those of units and types
    classes, types = n_classes(n_different), np.array([type_of(w) for w in words], np.int64)
    n_units = min(UNITS, len(words))
    unit = np.r_[1 + UNITS + np.arange(TYPES)[::-1], 0, np.arange(1, n_units + 1), 1 + UNITS + types[n_units:]]
    units = _cells(training, unit, 1 + UNITS + TYPES, tails=True)
    of_unit = exchange(units, classes)
    of = of_unit[unit]
    member = np.eye(classes)[of_unit]
    bigrams = member.T @ units @ member
    tail = vocabulary.sparkSession.createDataFrame([], "word binary, class short")
    for k in range(rounds):
        if k:
            bigrams = _cells(training, of, classes, tails=True)
        now = stored(reassigned(neighbours(training, of, classes), bigrams), "classes")
        of = of.copy()
        found = now.where("id > 0").select("id", "class").toPandas()  # the head
        of[found["id"].to_numpy(np.int64) + TYPES] = found["class"].to_numpy()
        tail = now.where("id = 0").select("word", "class")

    # tokens outside the head, with their classes and those beside them
    own = vocabulary.join(tail, "word", "left") if rounds else vocabulary.withColumn("class", F.lit(None).cast("short"))
    rare = rare_tokens(texts, of).join(own, "word", "left").withColumn("class", F.coalesce("class", "kind")).drop("word", "kind")
    alone = rare.where("before is null").withColumn("left_rare", F.lit(-1).cast("short"))
    beside = rare.where("before is not null").join(own.select(F.col("word").alias("before"), F.col("class").alias("left_rare")), "before", "left")
    beside = beside.withColumn("left_rare", F.coalesce("left_rare", "before_kind"))
    columns = ("row", "train", "left", "left_rare", "right", "class", F.coalesce("n", F.lit(0)).alias("n"))
    rare = stored(alone.select(*columns).unionByName(beside.select(*columns)), "rare")

    bigrams = _cells(training, of, classes, tails=False)
    pairs = F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in ((F.col("left"), F.col("class")), (F.col("left_rare"), F.col("class")), (F.col("class"), F.col("right")))])
    for r in rare.where("train").select(F.explode(pairs).alias("p")).where("p.a >= 0 and p.b >= 0").groupBy("p.a", "p.b").count().collect():  # classes squared at most
        bigrams[r["a"], r["b"]] += r["count"]
    sizes = np.bincount(of[TYPES + 1 :], minlength=classes).astype(float)
    if len(words) < n_different:
        # words outside the head; every one of them has a class of its own after a round
        kinds = tail.groupBy("class").count().collect() if rounds else _types_of(vocabulary, numbers, of)
        for r in kinds:
            sizes[r["class"]] += r["count"]
    step = np.log10((bigrams + 0.5) / (bigrams.sum(1, keepdims=True) + 0.5 * classes))
    emit = np.log10(bigrams.sum(0) + sizes + 1)
    emit[0] = 0.0  # the end's class holds the end alone
    logs = np.log10(np.array([0, *(head[w] for w in words)], float) + 1)

    shared = docs.sparkSession.sparkContext.broadcast((step, emit))

    def of_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, emit = shared.value
        for batch in batches:
            left, left_rare, right, own = (batch.column(c).to_numpy().astype(np.int64) for c in ("left", "left_rare", "right", "class"))
            log = np.where(left >= 0, step[left, own], 0.0) + np.where(left_rare >= 0, step[left_rare, own], 0.0) + np.where(right >= 0, step[own, right], 0.0) - emit[own]
            n = batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.log10(n + 1.0)), pa.array((n > 0).astype(np.int64)), pa.array(log)], names=["row", "log", "known", "class_log"])

    per_row = rare.select("row", "left", "left_rare", "right", "class", "n").mapInArrow(of_rare, "row long, log double, known long, class_log double")
    per_row = per_row.groupBy("row").agg(F.sum("log").alias("rare_log"), F.sum("known").alias("rare_n"), F.sum("class_log").alias("rare_class"))
    end_log, below = float(np.log10(ends + 1)), float(np.log10(total + different + 1))
    none = F.lit(0.0)
    known = F.col("head_log") + F.coalesce("rare_log", none)
    return _head_scores(texts, of, logs, step, emit).join(per_row, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("head_n") + F.coalesce("rare_n", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (known + end_log - F.col("n_tokens") * below).alias("base_score"),
        (known + F.col("class_log") + F.coalesce("rare_class", none)).alias("score"),
    )


def _types_of(vocabulary: DataFrame, numbers: Numbers, of: np.ndarray) -> list:
    """Number of words outside the head in each class, by their types."""
    shared = vocabulary.sparkSession.sparkContext.broadcast((dict(numbers), of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, of = shared.value
        for batch in batches:
            found = [of[TYPES - 1 - type_of(w)] for w in batch.column("word").to_pylist() if w not in numbers]
            yield pa.RecordBatch.from_pydict({"class": pa.array(found, pa.int16())})

    return vocabulary.select("word").mapInArrow(run, "class short").groupBy("class").count().collect()


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under a model of those that aren't held out."""
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    found = scored(documents(spark, sf_dir).select("doc_id", "text", (~held).alias("train")))
    return found.select("doc_id", held.alias("held_out"), *found.columns[1:], F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
