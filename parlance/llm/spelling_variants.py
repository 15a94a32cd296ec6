"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

Words that differ at place i share what is before and what is after it. In the forward order of
the words the first is an interval, in the reverse order (words read from their ends) the
second; a word is a point of the two ranks, and its neighbours at place i are the points in the
rectangle of the two intervals, which a wavelet tree over the reverse ranks reports.

On the cluster words are dealt out by halves. A pair that differs in the second half of its
longer word has the first half in common, and the other way round; so words are sent once by
the length and first half and once by the length and second half of the longer word of a pair,
and each block of such groups has a tree of its own. Groups over a block's size are cut into
slices, to each of which all words of the group are put as queries. A task gives a count
and a best neighbour for each of its words, not pairs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import documents, release, stored

RUN = "A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT, RATIO, DROP = 6, 5, 5, 199

#: Words of a block's tree, at most twice as many with its last group, and words asked at once; and
#: their code points, which is less where words are very long.
BLOCK, CELLS = 1 << 16, 1 << 21
#: Different words that a task counts before it hands them on.
HELD = 200_000


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """word, n: runs of letters of whole texts (doc_id, text), A-Z lower-cased, of ``least_chars`` code points.

    Runs whose crc32 of ``doc_id:run`` is a multiple of 199 lose the code point crc32 % length. A null
    text has no words; a null id stands as an empty one.
    """
    pattern = re.compile(f"[{RUN}]{{{least_chars},}}")

    def counted(found: Counter) -> pa.RecordBatch:
        words = pa.array(list(found), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                head = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                for raw, n in Counter(pattern.findall(text.as_py() or "")).items():
                    word = raw.encode().lower()  # of bytes: only A-Z
                    h = zlib.crc32(word, head)
                    if h % DROP == 0:
                        if len(raw) == least_chars:
                            continue
                        at, chars = h % len(raw), word.decode()
                        word = (chars[:at] + chars[at + 1 :]).encode()
                    found[word] += n
                if len(found) >= HELD:
                    yield counted(found)
                    found = Counter()
        yield counted(found)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """Levels of bits of a sequence of numbers below 2^bits: which of a range lie in another range."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # zeros before each place, a level each; the last is their number
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value): the values at places lo to hi (exclusive) of each query that are in [least, end)."""
        query, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for depth, zeros in enumerate(self.zeros):
            span = 1 << (self.bits - 1 - depth)
            z_lo, z_hi = zeros[lo], zeros[hi]
            left = (z_lo < z_hi) & (least[query] < value + span) & (end[query] > value)
            o_lo, o_hi, top = lo - z_lo + zeros[-1], hi - z_hi + zeros[-1], value + span
            right = (o_lo < o_hi) & (least[query] < top + span) & (end[query] > top)
            lo, hi = np.concatenate([z_lo[left], o_lo[right]]), np.concatenate([z_hi[left], o_hi[right]])
            query, value = np.concatenate([query[left], query[right]]), np.concatenate([value[left], top[right]])
        return query, value


def _codes(words: np.ndarray, length: int) -> np.ndarray:
    return np.ascontiguousarray(words.astype(f"U{length}")).view(np.uint32).reshape(len(words), length).astype(np.int64)


class Intervals:
    """Ranks of sorted words, by their first characters: a step a character for all queries at once."""

    def __init__(self, codes: np.ndarray):
        rank, n = np.zeros(len(codes), np.int64), len(codes)
        self.steps = []
        for column in codes.T:
            key = (rank << 21) | column
            new = np.concatenate([[True], key[1:] != key[:-1]])
            starts = np.flatnonzero(new)
            self.steps.append((key[starts], np.concatenate([starts, [n]])))
            rank = np.cumsum(new) - 1
        self.n = n

    def of(self, codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """lo and hi of the ranks that begin with 0, 1, 2, ... characters of each row."""
        rank = np.zeros(len(codes), np.int64)
        lows, highs = [rank], [np.full(len(codes), self.n)]
        for (keys, starts), column in zip(self.steps, codes.T):
            key = (rank << 21) | column
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = (keys[at] == key) & (rank >= 0)
            rank = np.where(there, at, -1)
            lows.append(np.where(there, starts[at], 0))
            highs.append(np.where(there, starts[at + 1], 0))
        return lows, highs


class Block:
    """Words of one length, in forward order, with the tree that answers for one half of the places."""

    def __init__(self, words: list[str], counts: list[int], length: int, second_half: bool):
        order = np.argsort(words := np.array(words))
        self.words, self.counts = words[order], np.array(counts, np.int64)[order]
        self.codes = _codes(self.words, length)
        back = np.ascontiguousarray(self.codes[:, ::-1])
        self.by_end = np.lexsort(back.T[::-1])  # forward ranks in reverse order
        ranks = np.empty(len(words), np.int64)
        ranks[self.by_end] = np.arange(len(words))
        self.tree, self.forward, self.reverse = WaveletTree(ranks), Intervals(self.codes), Intervals(back[self.by_end])
        self.length, self.places = length, range(length // 2, length) if second_half else range(length // 2)

    def neighbours(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, forward rank) of words that differ from the rows at one of the block's places: by a
        replacement if the rows have the block's length, by an insertion if they have one less."""
        same = codes.shape[1] == self.length
        (p_lo, p_hi), (s_lo, s_hi) = self.forward.of(codes), self.reverse.of(codes[:, ::-1])
        own = p_hi[-1] - p_lo[-1] if same else 0  # a word of the block finds itself
        rows, found = [], []
        for i in self.places:
            lo, hi, least, end = p_lo[i], p_hi[i], s_lo[self.length - 1 - i], s_hi[self.length - 1 - i]
            ask = np.flatnonzero((hi - lo > own) & (end - least > own))
            query, value = self.tree.report(lo[ask], hi[ask], least[ask], end[ask])
            query, rank = ask[query], self.by_end[value]
            keep = self.codes[rank, i] != (codes[query, i] if same else self.codes[rank, i - 1] if i else -1)  # in a run of one letter, its first place
            rows.append(query[keep])
            found.append(rank[keep])
        return np.concatenate(rows), np.concatenate(found)


def _best(target: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets, how many each has, and the place of its best: largest n, then smallest rank."""
    order = np.lexsort((rank, -n, target))
    first = np.flatnonzero(np.r_[True, np.diff(target[order]) != 0]) if len(order) else order
    return target[order[first]], np.diff(np.r_[first, len(order)]), order[first]


def _answers(block: Block, words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Partial results of a block for words of its length, or one less, and for the block's own."""
    if not len(words):
        return
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    shorter = len(words[0]) < block.length
    row, rank = block.neighbours(_codes(words, len(words[0])))
    ways = [(words, block, row, rank)] if not shorter else [(words, block, row, rank), (block.words, None, rank, row)]
    for targets, source, target, other in ways:
        names, n = (source.words, source.counts) if source else (words, counts)
        of, many, best = _best(target, n[other], other)
        if len(of):
            columns = [pa.array(targets[of].tolist()), pa.array(many), pa.array(n[other[best]]), pa.array(names[other[best]].tolist())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def _searched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (half, length, part, slice, asked, word, n) in this order. A block is one or more groups, but
    slices of a group are blocks of their own, as the same words are put to each."""
    release()
    group: tuple | None = None
    index: tuple[list, list] = ([], [])
    asked: tuple[list, list] = ([], [])
    block: Block | None = None

    def answers(half: int, length: int) -> Iterator[pa.RecordBatch]:
        nonlocal block
        if index[0] and asked[0]:
            block = block or Block(*index, length, half == 1)
            words, counts = np.array(asked[0]), np.array(asked[1], np.int64)
            whole = np.char.str_len(words) == length
            for mine in (whole, ~whole):
                yield from _answers(block, words[mine], counts[mine])
        for x in asked:
            x.clear()

    for batch in batches:
        for half, length, part, piece, is_asked, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (half, length, part, piece) != group:
                if group and ((half, length) != group[:2] or piece or block or len(index[0]) >= capacity(length, size)):
                    yield from answers(*group[:2])
                    index, block = ([], []), None
                group = (half, length, part, piece)
            into = asked if is_asked else index
            into[0].append(word)
            into[1].append(n)
            if is_asked and len(asked[0]) >= 4 * capacity(length, size):
                yield from answers(half, length)
    if group:
        yield from answers(*group[:2])


def capacity(length: int, size: int) -> int:
    return max(1, min(size, CELLS // length))


def near_words(words: DataFrame, size: int = BLOCK) -> DataFrame:
    """word, n_near, best_n, best: of the different words (word, n), how many are one edit away, and the
    most frequent of these, the smallest in code-point order of equals. Words without any have no row."""
    spark = words.sparkSession
    length = F.char_length("word")
    ways = F.array(*[F.struct(F.lit(half).alias("half"), (length + more).alias("length"), F.lit(bool(more)).alias("longer")) for half in (0, 1) for more in (0, 1)])
    first = F.floor(F.col("length") / 2).cast("int")
    part = F.when(F.col("half") == 1, F.substring(F.col("word"), F.lit(1), first)).otherwise(F.reverse(F.substring(F.reverse("word"), F.lit(1), F.col("length") - first)))
    dealt = words.select("word", "n", F.explode(ways).alias("w")).select("word", "n", "w.*").withColumn("part", F.xxhash64("half", "length", part))
    keys = ["half", "length", "part"]
    # groups over a block: their number is at most twice the words over a block's
    room = F.greatest(F.lit(1), F.least(F.lit(size), F.floor(F.lit(CELLS) / F.col("length"))))
    large = dealt.where("not longer").groupBy(*keys).count().where(F.col("count") > room).select(*keys, F.ceil(F.col("count") / room).cast("int").alias("slices"))
    sliced = dealt.join(F.broadcast(large), keys, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")
    index = sliced.where("not longer").select(*keys, own.alias("slice"), F.lit(False).alias("asked"), "word", "n")
    asked = sliced.select(*keys, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("asked"), "word", "n")
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(words.count() * 6 / size))
    ordered = index.unionByName(asked).repartitionByRange(parts, *keys, "slice").sortWithinPartitions(*keys, "slice", "asked")
    found = ordered.mapInArrow(lambda batches: _searched(batches, size), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of the different words (word, n).

    form: the near word of largest n, if that is at least ``ratio`` times n. root: the last of the
    forms that follow; counts grow by the ratio along them, so a few joins that each
    double the way suffice.
    """
    found = words.join(near_words(words), "word", "left").withColumn("is_form", F.coalesce(F.col("best_n") >= F.col("n") * ratio, F.lit(False)))
    form = F.when(F.col("is_form"), F.col("best")).alias("form")
    found = stored(found.select("word", form, "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("best_n")).alias("form_n")), "forms")
    linked = found.where("form is not null")
    span = linked.agg(F.max(F.col("form_n")).alias("most"), F.min("n").alias("least")).first()
    longest = math.log(span.most / max(1, span.least), ratio) if span.most else 0
    roots, reach = linked.select("word", F.col("form").alias("root")), 1
    while reach < longest:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots, reach = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots"), reach * 2
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all documents, of 6 code points and 5 occurrences.

    No documents, or texts without such words: no rows. Other columns don't matter.
    """
    words = stored(word_counts(documents(spark, sf_dir)).where(F.col("n") >= LEAST_COUNT), "words")
    return variants(words)


OP12_SQL = f"""WITH RECURSIVE crc AS (
    SELECT b, b AS v, 0 AS i FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i + 1 FROM crc WHERE i < 8
), crcs AS (SELECT list(v ORDER BY b) AS t FROM crc WHERE i = 8
), raw AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[{RUN}]+')) AS r FROM documents
), runs AS (
    SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM raw WHERE length(r) >= {LEAST_CHARS} GROUP BY ALL
), hexed AS (
    SELECT r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x, t FROM runs, crcs
), hashed AS (
    SELECT r, n, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM hexed
), words AS (
    SELECT CASE WHEN h % {DROP} = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, sum(n)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_CHARS} AND sum(n) >= {LEAST_COUNT}
), cuts AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), longer AS (SELECT DISTINCT w.word AS a, w.n AS an, c.word AS b, c.n AS bn FROM words w JOIN cuts c ON w.word = c.cut
), near AS (
    SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
    UNION ALL SELECT a, b, bn FROM longer UNION ALL SELECT b, a, an FROM longer
), best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS other, max(n)::BIGINT AS most FROM near GROUP BY 1
), forms AS (
    SELECT word, CASE WHEN most >= {RATIO} * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.next
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM walk WHERE next IS NULL) USING (word)"""
