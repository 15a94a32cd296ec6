"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to unit length, moved by the mean of their label, and cut into halves. A
codebook for each half is fitted by k-means to at most ``SAMPLE`` vectors, those with the
smallest md5 of their id; every vector lies in the cell of its nearest words in both books,
so two books of k words give a grid of k x k cells (Babenko and Lempitsky 2012). k grows with
the number of vectors a label, and is ``FEWEST`` at least.

A vector searches its own label's grid by multi-sequence traversal: with a queue over the two
orders of words it visits cells by growing bound, the least distance that anything in a cell
can have from it. What lies in a cell is on its word's side of the midplane between its word
and the query's own nearest word, so the bound is sound, and the traversal goes on to the
threshold's radius: the target recall is 1, nothing within the threshold is missed. If a lower
``recall`` is asked for, it ends at the bound within which that share of the sample's own linked
pairs is found, if the sample has ``ENOUGH`` such pairs. Candidates are verified by their
cosine in double precision. Vectors whose squares would leave the range of doubles are first
divided by a power of two, which changes no cosine.

Equal vectors of a label are searched for once, with their number. A label's vectors, in the
order of their cells, are cut into blocks, whose size grows with the label, so that there
are about ``BLOCKS`` of them (each of ``BLOCK`` vectors at least and ``LARGEST`` at most). Two blocks meet if
a vector of one visits a cell of the other, in one task and as matrix products of a few rows each.
So a vector is sent once for each block that its own block meets, not once for each cell that it
visits, and no cell is collected in one place. A pair of blocks gives a count for each vector and a
spanning forest of links, never a row a pair.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, and
null labels, link with nothing and are kept; vectors of different lengths link with nothing of
another length; null ids link with nothing; repeated rows are returned as often as they
occur, but an id that has several vectors links by any of them; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import stored
from parlance.llm.components import connected_components

COSINE, LOWER, SAMPLE = 0.98, 0.35, 8_192
#: Blocks of a label; the fewest and the most vectors of one; products that are looked at in one go.
BLOCKS, BLOCK, LARGEST, PRODUCTS = 16, 1024, 32_768, 1 << 21
#: Vectors of a label that a cell should hold on average; the fewest and the most words of a codebook.
CELL, FEWEST, MOST_WORDS = 128, 4, 512
ENOUGH = 1_000
#: Norms whose squares stay well inside of doubles.
SMALL, LARGE = 1e-140, 1e140


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows in the order of their first component."""
    k = max(1, min(k, len(x)))
    words = x[np.argsort(x[:, 0], kind="stable")[np.linspace(0, len(x) - 1, k).astype(int)]].copy()
    for _ in range(rounds):
        of = _distances(x, words).argmin(1)
        n = np.bincount(of, minlength=k)
        for j in np.flatnonzero(n):
            words[j] = x[of == j].mean(0)
    return words


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1))


def traversal(u: np.ndarray, v: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Cells (i, j) by growing u[i] + v[j], up to ``reach``: the multi-sequence algorithm. A cell
    waits in the queue once those before it in its row and its column were visited."""
    rows, columns = np.argsort(u, kind="stable"), np.argsort(v, kind="stable")
    a, b = u[rows].tolist(), v[columns].tolist()
    done, queue, out = [0] * len(a), [(a[0] + b[0], 0, 0)], []  # done: visited cells of each row
    while queue:
        total, i, j = heappop(queue)
        if total > reach:
            break
        out.append((int(rows[i]), int(columns[j])))
        done[i] = j + 1
        if i + 1 < len(a) and done[i + 1] == j:
            heappush(queue, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heappush(queue, (a[i] + b[j + 1], i, j + 1))
    return out


class MultiIndex:
    """Two codebooks; finds a vector's cell and the cells that can hold its neighbours."""

    def __init__(self, one: np.ndarray, two: np.ndarray, cosine: float, means: dict[str, np.ndarray] | None = None):
        self.books, self.reach, self.means = (one, two), 2 - 2 * cosine + 1e-9, means or {}
        self.size = one.shape[1] + two.shape[1]
        self.apart = [np.sqrt(_distances(b, b)) for b in self.books]

    def moved(self, x: np.ndarray, labels: list[str]) -> np.ndarray:
        none = np.zeros(self.size)
        return unit(x) - np.array([self.means.get(k, none) for k in labels]).reshape(-1, self.size)

    def _half(self, x: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest word, and the least squared distance to anything of each word."""
        d = _distances(x, self.books[i])
        near = d.argmin(1)
        ahead = d - d[np.arange(len(x)), near][:, None]
        gap = self.apart[i][near]
        bound = np.where(gap > 0, ahead / (2 * np.where(gap > 0, gap, 1)), 0)
        return near, np.square(np.maximum(0, bound - 1e-9))

    def halves(self, x: np.ndarray) -> tuple[tuple, tuple]:
        half = self.books[0].shape[1]
        return self._half(x[:, :half], 0), self._half(x[:, half:], 1)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The cell of each (moved) row, and the cells it visits, by growing bound."""
        (a, bound_a), (b, bound_b) = self.halves(x)
        width = len(self.books[1])
        return a * width + b, [np.array([i * width + j for i, j in traversal(u, v, self.reach)], np.int64) for u, v in zip(bound_a, bound_b)]

    def calibrate(self, x: np.ndarray, labels: np.ndarray, cosine: float, recall: float) -> None:
        """Let traversals end where ``recall`` of the linked pairs in the sample x are found."""
        unmoved, moved = unit(x), self.moved(x, labels.tolist())
        (a, u), (b, v) = self.halves(moved)
        bounds = []
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            for at in range(0, len(mine), 256):
                rows = mine[at : at + 256]
                q, p = np.nonzero(unmoved[rows] @ unmoved[mine].T >= cosine)
                q, p = rows[q], mine[p]
                bounds.append((u[q, a[p]] + v[q, b[p]])[q != p])
        found = np.concatenate(bounds) if bounds else np.empty(0)
        if len(found) >= ENOUGH:
            self.reach = min(self.reach, float(np.quantile(found, recall, method="higher")))


def fit(vectors: DataFrame, n: int, cosine: float, labels: int, recall: float | None = None) -> MultiIndex | None:
    """Codebooks from a bounded sample; their size follows the number of vectors a label. Vectors of
    another length than most of the sample have no index and are compared in blocks."""
    rows = vectors.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id", "label", "v").select("label", "v").limit(SAMPLE).collect()
    sizes = Counter(len(r["v"]) for r in rows)
    size = min(sizes, key=lambda k: (-sizes[k], k))
    if size < 2:
        return None
    rows = [r for r in rows if len(r["v"]) == size]
    words = int(min(MOST_WORDS, max(FEWEST, math.sqrt(n / max(1, labels) / CELL))))
    x, names = np.array([r["v"] for r in rows]), np.array([r["label"] for r in rows], object)
    whole = unit(x)
    means = {k: whole[names == k].mean(0) for k in set(names.tolist())}
    moved = whole - np.array([means[k] for k in names.tolist()])
    half = size // 2
    index = MultiIndex(codebook(moved[:, :half], words), codebook(moved[:, half:], words), cosine, means)
    if recall is not None:
        index.calibrate(x, names.astype(str), cosine, recall)
    return index


def _fits(index: MultiIndex | None, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch (v) that the index has cells for, and their vectors."""
    lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == (index.size if index else -1))
    return rows, _matrix(batch.column("v").take(pa.array(rows)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _cells(shared):
    """For mapInArrow over vec_id, label, v, n: the same with a vector's cell, -1 without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            cell = np.full(batch.num_rows, -1)
            rows, x = _fits(index, batch)
            if len(rows):
                (a, _), (b, _) = index.halves(index.moved(x, batch.column("label").take(pa.array(rows)).to_pylist()))
                cell[rows] = a * len(index.books[1]) + b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "cell"])

    return run


def _visits(shared):
    """For mapInArrow over label, block, v: the cells that the vectors of a block visit; once for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            labels, blocks = batch.column("label").to_pylist(), batch.column("block").to_pylist()
            seen: dict[tuple, set] = {}
            rows, x = _fits(index, batch)
            for i in set(range(batch.num_rows)) - set(rows.tolist()):
                seen.setdefault((labels[i], blocks[i]), set()).add(-1)
            every = len(index.books[0]) * len(index.books[1]) if index else 0
            for at in range(0, len(rows), 500):
                some = rows[at : at + 500].tolist()
                (_, u), (_, v) = index.halves(index.moved(x[at : at + 500], [labels[i] for i in some]))
                for i, one, two in zip(some, u, v):
                    cells = seen.setdefault((labels[i], blocks[i]), set())
                    if len(cells) < every:
                        cells.update(r * len(index.books[1]) + c for r, c in traversal(one, two, index.reach))
            out = [(label, block, cell) for (label, block), cells in seen.items() for cell in cells]
            kinds = (("label", pa.string()), ("block", pa.int64()), ("cell", pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    return run


def _merged(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Roots after the places p and q are linked; a root is the smallest place of its set."""
    while (root[p] != root[q]).any():
        low = np.minimum(root[p], root[q])
        for side in (p, q):
            np.minimum.at(root, root[side], low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _pair(table: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two blocks (``second``: not of the first), or of one block with itself: ids with their links, ids with
    a linked id that stands for their set."""
    table = table.take(pa.compute.sort_indices(table, [("second", "ascending"), ("vec_id", "ascending")]))
    ids, n, second = (table.column(c).to_numpy() for c in ("vec_id", "n", "second"))
    column = table.column("v").combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for size in np.unique(lengths):
        mine = np.flatnonzero(lengths == size)
        x = _matrix(column.take(pa.array(mine)))
        norms = np.sqrt((x * x).sum(1))
        own, others = (np.flatnonzero(second[mine] == k) for k in (False, True))
        alone = not len(others) and not table.column("two")[0].as_py()
        others = own if alone else others
        step = max(1, PRODUCTS // max(1, len(others)))
        for at in range(0, len(own) if len(others) else 0, step):
            some = own[at : at + step]
            hit = x[some] @ x[others].T / (norms[some][:, None] * norms[others]) >= cosine
            a, b = np.nonzero(hit)
            a, b = mine[some[a]], mine[others[b]]
            apart = ids[a] != ids[b]
            a, b = a[apart], b[apart]
            np.add.at(links, a, n[b])
            if not alone:
                np.add.at(links, b, n[a])
            root = _merged(root, a, b)
    hit, joined = links > 0, root != np.arange(len(ids))
    return ids[hit], links[hit], ids[joined], ids[root[joined]]


def _found(cosine: float):
    """For mapInArrow over sorted pairs of blocks: per vector its links, and a forest of them."""

    def work(held: list) -> pa.RecordBatch:
        hit, links, joined, root = _pair(pa.Table.from_batches(held), cosine)
        columns = np.r_[hit, joined], np.r_[links, np.zeros(len(joined), np.int64)], pa.array([*[None] * len(hit), *root.tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["vec_id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "one", "other"))))
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)] * bool(keys)
            for at, end in zip([0, *ends], ends):
                if keys[at] != key and held:
                    yield work(held)
                    held = []
                key = keys[at]
                held.append(batch.slice(at, end - at))
        if held:
            yield work(held)

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float | None = None) -> DataFrame:
    """``embeddings`` (vec_id, embedding, label): vec_id, n_links, component_id, kept; without ``recall`` all links."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    # null if a component is, NaN or infinite if one is
    largest = F.aggregate("v", F.lit(0.0), lambda s, x: F.when(s.isNull() | x.isNull(), F.lit(None).cast("double")).when(F.abs(x) <= s, s).otherwise(F.abs(x)))
    finite = (largest > 0) & (largest < float("inf"))
    good = F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    power = F.pow(F.lit(2.0), F.floor(F.log2("largest")))
    scaled = F.when(F.col("largest").between(SMALL, LARGE), F.col("v")).otherwise(F.transform("v", lambda x: x / power))
    valid = stored(rows.where(good).withColumn("largest", largest).withColumn("v", scaled).drop("largest"), "vectors")
    equal = valid.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = stored(equal, "equal")
    total, labels = classes.agg(F.count("*"), F.approx_count_distinct("label")).first()
    index = fit(classes.select(F.col("rep").alias("vec_id"), "label", "v"), total, cosine, labels, recall) if total else None
    shared = embeddings.sparkSession.sparkContext.broadcast(index)
    placed = stored(classes.select(F.col("rep").alias("vec_id"), "label", "v", "n").mapInArrow(_cells(shared), "vec_id long, label string, v array<double>, n long, cell long"), "cells")
    # a label's vectors in the order of cells; those of one cell in that of a hash
    counts = placed.groupBy("label", "cell").agg(F.count("*").alias("m"))
    order, whole = Window.partitionBy("label").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("label")
    size = F.least(F.lit(LARGEST), F.greatest(F.lit(BLOCK), F.ceil(F.sum("m").over(whole) / BLOCKS))).cast("long")
    counts = stored(counts.select("label", "cell", "m", (F.sum("m").over(order) - F.col("m")).alias("start"), size.alias("size")), "counts")
    block = F.expr("(start + pmod(xxhash64(vec_id), m)) div size")
    placed = placed.join(counts, ["label", "cell"]).select("vec_id", "label", "v", "n", block.alias("block"))
    visits = placed.select("label", "block", "v").mapInArrow(_visits(shared), "label string, block long, cell long").distinct()
    reached = counts.select("label", "cell", F.explode(F.sequence(F.expr("start div size"), F.expr("(start + m - 1) div size"))).alias("met"))
    pairs = visits.join(reached, ["label", "cell"]).select("label", F.least("block", "met").alias("one"), F.greatest("block", "met").alias("other")).distinct()
    pairs = stored(pairs, "pairs")
    sides = pairs.select("label", F.col("one").alias("block"), "one", "other", F.lit(False).alias("second"))
    sides = sides.unionByName(pairs.where("one <> other").select("label", F.col("other").alias("block"), "one", "other", F.lit(True).alias("second")))
    dealt = placed.join(sides, ["label", "block"]).select("label", "one", "other", "second", (F.col("one") != F.col("other")).alias("two"), "vec_id", "v", "n")
    keys = ["label", "one", "other"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_found(cosine), "vec_id long, links long, root long")
    found = stored(found, "found")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("root is not null").select(F.col("vec_id").alias("a"), F.col("root").alias("b")), "links")
    per_class = classes.join(links, classes.rep == links.vec_id, "left").select("label", "v", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    per_class = per_class.join(components, F.col("rep") == F.col("node"), "left").select("label", "v", "links", F.coalesce("component", "rep").alias("component_id"))
    full = valid.join(per_class, ["label", "v"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    lone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at a cosine of at least 0.98."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def embedding_links_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at ``LOWER``, where the given vectors have links."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), LOWER)


def _sql(cosine: float) -> str:
    """The same by all pairs of vectors of a label."""
    return f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
    SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v
    WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {cosine}
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT a, y FROM reach JOIN links ON x = b
), c AS (
    SELECT a, min(b) AS b FROM reach GROUP BY 1
), n AS (
    SELECT x, count(*) AS n FROM links GROUP BY 1
)
SELECT a AS vec_id, coalesce(n, 0)::BIGINT AS n_links, b AS component_id, a = b AS kept FROM c LEFT JOIN n ON x = a
"""


OP2_SQL, LOWER_SQL = _sql(COSINE), _sql(LOWER)
