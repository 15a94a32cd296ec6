"""N-gram Jaccard join: PartEnum signatures, then exact verification in blocks.

A document's set is its distinct word shingles. Equal sets are joined by their digest and
represented by their smallest document id. Between different sets, PartEnum (Arasu, Ganti,
Kaushik 2006) finds candidates:

* Sets are put in bands of similar size; a set also takes part in the next bands that a
  partner within the threshold can reach.
* Two sets within the threshold differ in at most ``k`` elements, a number that follows from
  the largest size in the band. The shingle domain is dealt into ``n1`` partitions so that at
  least one has at most ``k2`` differences; each is dealt into ``n2`` parts and every subset
  of ``n2 - k2`` of them is enumerated. So a pair within the threshold agrees on one subset,
  whose content is its signature.

Signatures that the same sets share count once. Sets that share a signature are compared by odd sketches, a bit for the parity of each part
of the domain: two sets differ in at least as many elements as their sketches in bits, so a
pair beyond the threshold by its sketches is no pair. What remains forms groups, and all true
links lie within a group. Groups are verified exactly from whole texts. Both steps split the
sets of a signature or a group into blocks of bounded size; each pair of blocks is worked on
its own, and gives only a spanning forest of the links found in it, never all pairs. No
candidate is dropped.

Edge cases: a null or empty text, or one without words, has an empty set and links with
nothing; fewer words than the shingle width make one shingle; null document ids get a null
component; repeated rows are returned as often as they occur; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import documents, mix, release, shingles, stored, text_hashes
from parlance.llm.components import Forest, connected_components

#: Sets compared in one task: blocks of this many against blocks of this many.
BLOCK = 384
#: Size bands grow by this factor.
BAND = 1.5


class PartEnum:
    """Signatures for Jaccard similarity of at least ``percent`` / 100.

    ``slack`` deals the domain into more partitions than needed. Then a set may leave out
    subsets without elements, on which unlike sets would agree, as long as more partitions
    are filled than can differ. With single partitions (``k2`` = 0) it also keeps only as many
    of the fullest as are needed: a prefix filter, as fullness is part of what sets agree on.
    """

    def __init__(self, percent: int, n2: int = 1, k2: int = 0, slack: float = 1.25):
        self.percent, self.n2, self.k2, self.slack = percent, n2, k2, slack
        self.subsets = [list(x) for x in combinations(range(n2), n2 - k2)]
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
        self.edges = np.array(edges, np.int64)

    def bands(self, size: int) -> range:
        """Numbers of the bands in which a set of this size takes part."""
        own = int(np.searchsorted(self.edges, size, "right")) - 1
        last = int(np.searchsorted(self.edges, size * 100 // self.percent, "right")) - 1
        return range(own, last + 1)

    def differences(self, band: int) -> int:
        """Most elements in which two sets of the band can differ."""
        largest = int(self.edges[band + 1]) - 1
        return 2 * largest * (100 - self.percent) // (100 + self.percent)

    def __call__(self, elements: np.ndarray) -> tuple[list[np.ndarray], list[bytes]]:
        """Signatures, and the sketch, of a set of distinct 64-bit hashes for each of its bands."""
        signatures, sketches = [], []
        if len(elements):
            value = mix(elements ^ np.uint64(0x5851F42D4C957F2D))
            where = (elements >> np.uint64(33)).astype(np.int64)
            for band in self.bands(len(elements)):
                signatures.append(np.concatenate(self._of_band(value, where, band)).view(np.int64))
                bits = -(-max(64, int(self.edges[band + 1]) - 1) // 8) * 8
                odd = np.bincount((value >> np.uint64(24)).astype(np.int64) % bits, minlength=bits) & 1
                sketches.append(np.packbits(odd.astype(bool)).tobytes())
        return signatures, sketches

    def _of_band(self, value: np.ndarray, where: np.ndarray, band: int) -> list[np.ndarray]:
        differ = self.differences(band) // (self.k2 + 1)  # partitions with over k2 differences, at most
        n1 = int((differ + 1) * self.slack) if differ else 1
        cell = where % (n1 * self.n2)
        order = np.argsort(cell, kind="stable")
        filled = np.bincount(cell, minlength=n1 * self.n2).reshape(n1, self.n2)
        sums = np.zeros(n1 * self.n2, np.uint64)
        ids, starts = np.unique(cell[order], return_index=True)
        sums[ids] = np.add.reduceat(value[order], starts)
        sums = sums.reshape(n1, self.n2)
        counts = np.stack([filled[:, x].sum(axis=1) for x in self.subsets], axis=1)
        keep = np.ones_like(counts, bool)
        if (counts > 0).all(axis=1).sum() > differ:
            keep = counts > 0
            if not self.k2:
                keep = np.zeros_like(counts, bool)
                keep[np.argsort(-counts[:, 0], kind="stable")[: differ + 1]] = True
        found = []
        for s, subset in enumerate(self.subsets):
            h = mix((np.arange(n1, dtype=np.uint64) * np.uint64(len(self.subsets)) + np.uint64(s)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band))
            for j in subset:
                h = mix(h ^ sums[:, j]) + sums[:, j]
            found.append(h[keep[:, s]])
        return found


def _sets(docs: DataFrame, width: int, scheme: PartEnum) -> DataFrame:
    """doc_id, n_shingles, digest of the set (two longs, null when empty), signatures and
    sketches by band."""

    def nested(parts: list[list], flat: pa.Array, sizes: list[int]) -> pa.Array:
        inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), inner)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, one, two, signatures, sketches = [], [], [], [], []
                for text in batch.column("text").to_pylist():
                    s = shingles(text_hashes(text), width)
                    n.append(len(s))
                    one.append(int(np.add.reduce(s).view(np.int64)) if len(s) else None)
                    two.append(int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else None)
                    for out, found in zip((signatures, sketches), scheme(s)):
                        out.append(found)
                flat = [x for per_doc in signatures for x in per_doc]
                marks = nested(signatures, pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)), [len(x) for x in flat])
                bits = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sketches)]), pa.int32()), pa.array([x for per_doc in sketches for x in per_doc], pa.binary()))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64()), "signatures": marks, "sketches": bits})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(features, "doc_id long, n_shingles long, one long, two long, signatures array<array<long>>, sketches array<binary>")


def _sketch_links(percent: int):
    """Of the rows of a pair of blocks, the links that sketches don't rule out."""

    def links(rows: list) -> Iterator[tuple[int, int]]:
        first, second = rows[0][2], rows[0][3]
        forest = Forest()
        left = [r for r in rows if r[1] == first]
        right = left if first == second else [r for r in rows if r[1] == second]
        if len(left) * len(right) <= 4000:
            bits = {r[0]: int.from_bytes(r[5]) for r in rows}
            for i, x in enumerate(left):
                for y in right[i + 1 :] if first == second else right:
                    if (bits[x[0]] ^ bits[y[0]]).bit_count() * (100 + percent) <= (100 - percent) * (x[4] + y[4]):
                        forest.join(x[0], y[0])
        else:
            one, two = (np.frombuffer(b"".join(r[5] for r in side), np.uint8).reshape(len(side), -1) for side in (left, right))
            sizes = np.array([r[4] for r in right])
            for i, x in enumerate(left):
                apart = np.bitwise_count(two ^ one[i]).sum(axis=1, dtype=np.int64)
                hit = apart * (100 + percent) <= (100 - percent) * (sizes + x[4])
                for j in np.flatnonzero(hit):
                    forest.join(x[0], right[j][0])
        return forest.stars()

    return links


def _exact_links(width: int, percent: int):
    """Of the rows of a pair of blocks, the links by their whole texts."""

    def similar(left: list, right: list | None) -> Iterator[tuple[int, int]]:
        """Pairs of (id, set) within the threshold; of left against itself if right is None."""
        rows = left + (right or [])
        sizes = np.array([len(s) for _, s in rows])
        values, inverse, counts = np.unique(np.concatenate([s for _, s in rows]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(rows)), sizes)
        shared = counts[inverse] > 1
        inverse, owner = inverse[shared], owner[shared]
        order = np.argsort(inverse, kind="stable")
        posting = owner[order]
        ends = np.cumsum(np.bincount(inverse, minlength=len(values)))
        starts = ends - np.bincount(inverse, minlength=len(values))
        at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))])
        for i in range(len(left)):
            mine = inverse[at[i] : at[i + 1]]
            if not len(mine):
                continue
            spans = ends[mine] - starts[mine]
            index = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            both = np.bincount(posting[index], minlength=len(rows))
            hit = 100 * both >= percent * (sizes[i] + sizes - both)
            hit[: i + 1 if right is None else len(left)] = False
            for j in np.flatnonzero(hit):
                yield rows[i][0], rows[j][0]

    def links(rows: list) -> Iterator[tuple[int, int]]:
        forest, sides = Forest(), {}
        for doc_id, block, _, _, text in rows:
            sides.setdefault(block, []).append((doc_id, shingles(text_hashes(text), width)))
        first, second = rows[0][2], rows[0][3]
        if first in sides and second in sides:
            for a, b in similar(sides[first], None if first == second else sides[second]):
                forest.join(a, b)
        return forest.stars()

    return links


def _by_block(rows: DataFrame, group: str, counts: DataFrame, size: int, work, columns: tuple) -> DataFrame:
    """Links (a, b) that ``work`` finds in the rows of each pair of blocks of each group.

    ``counts`` has the group and its n; a group of at most ``size`` rows is one block.
    """
    blocks = counts.select(group, F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    dealt = rows.join(blocks, group).withColumn("block", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keys = [group, "first", "second"]
    dealt = dealt.select(group, F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "doc_id", "block", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            out = []
            values = [batch.column(c).to_pylist() for c in (*keys, "doc_id", "block", "first", "second", *columns)]
            for g, first, second, *row in zip(*values):
                if (g, first, second) != key:
                    out += work(held) if len(held) > 1 else ()
                    held, key = [], (g, first, second)
                held.append(row)
            yield _links(out)
        yield _links(list(work(held)) if len(held) > 1 else [])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, n2: int = 1, k2: int = 0) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when ``100 * intersection >= percent * union`` of their shingle sets.
    """
    sets = stored(_sets(docs, width, PartEnum(percent, n2, k2)), "sets")
    # equal sets: one representative each
    classes = stored(
        sets.where("n_shingles > 0 and doc_id is not null").groupBy("one", "two").agg(F.min("doc_id").alias("rep")), "classes"
    )
    reps = sets.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    # signatures that different sets share; of signatures with the same sets, one
    marks = reps.select("doc_id", F.posexplode("signatures").alias("band", "found")).select("doc_id", "band", F.explode("found").alias("signature"))
    several = stored(marks.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").select("signature"), "several")
    shared = stored(marks.join(several, "signature", "left_semi"), "shared")
    members = [F.bit_xor(F.xxhash64(F.lit(i), "doc_id", "band")).alias(f"m{i}") for i in range(2)]
    counts = shared.groupBy("signature").agg(F.count("*").alias("n"), *members)
    counts = stored(counts.groupBy("m0", "m1", "n").agg(F.min("signature").alias("signature")).select("signature", "n"), "signatures")
    shared = shared.join(counts.select("signature"), "signature", "left_semi")
    sketches = reps.select("doc_id", "n_shingles", F.posexplode("sketches").alias("band", "sketch"))
    near = _by_block(shared.join(sketches, ["doc_id", "band"]), "signature", counts, 1024, _sketch_links(percent), ("n_shingles", "sketch"))
    groups = connected_components(near, "candidates").select(F.col("node").alias("doc_id"), F.col("component").alias("grp"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    links = _by_block(texts.join(groups, "doc_id"), "grp", sizes, BLOCK, _exact_links(width, percent), ("text",))
    found = connected_components(links, "links")
    per_class = classes.join(found, classes.rep == found.node, "left").select("one", "two", F.coalesce("component", "rep").alias("component_id"))
    empty = F.col("one").isNull() | F.col("doc_id").isNull()
    full = sets.select("doc_id", "n_shingles", "one", "two").where(~empty).join(per_class, ["one", "two"])
    rest = sets.where(empty).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n_shingles", "component_id").unionByName(rest)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: 3-word shingles, similarity of at least 0.9."""
    return jaccard_components(documents(spark, sf_dir), width=3, percent=90, n2=3, k2=1)


#: The same by all pairs of documents that share a shingle.
OP7_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
), sh AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [array_to_string(ws, ' ')] END) AS s
    FROM w WHERE len(ws) > 0
), n AS (
    SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
), reach(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN links ON x = b
)
SELECT a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
"""
