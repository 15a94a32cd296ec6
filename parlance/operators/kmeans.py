"""Deterministic k-means of the points of many groups, over blocks of points.

The first centre is the point nearest the mean, each further one the point farthest from those
before; equal ones go to the smaller id, equal clusters to the smaller number. A group of one block
is worked on in one task. Larger groups go through Spark rounds: a block gives its sums for each
centre, sums are added in the order of blocks, so results don't depend on the cluster; between
rounds only centres move, by way of the driver and not more at once than ``BROADCAST_BYTES``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.storage import written

BLOCK = 4096
#: Centres that are sent to the blocks at once; groups with more are worked on in parts.
BROADCAST_BYTES = 64 << 20
#: Blocks whose sums are added in one step.
RUN = 256
#: Numbers of which distances are taken at once.
NEAR = 1 << 16


def apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points by centres; differences of a few points at once stay in a core's cache."""
    out, few = np.empty((len(x), len(centres))), max(1, NEAR // max(1, x.shape[1]))
    for i in range(0, len(x), few):
        for j, c in enumerate(centres):
            d = x[i : i + few] - c
            np.einsum("ij,ij->i", d, d, out=out[i : i + few, j])
    return out


def sums(x: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How many points each cluster has, and their sum."""
    total = [np.bincount(of, column, k) for column in x.T]  # in the order of the points
    return np.bincount(of, minlength=k), np.stack(total, axis=1) if total else np.zeros((k, 0))


def labels_of(x: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Clusters of the points of one block, in the order of their ids."""
    k = max(1, min(k, len(x)))
    centres = np.empty((k, x.shape[1]))
    reach = -apart(x, x.mean(0)[None])[:, 0]  # the first is nearest the mean
    for j in range(k):
        centres[j] = x[reach.argmax()]
        new = apart(x, centres[j : j + 1])[:, 0]
        reach = new if j == 0 else np.minimum(reach, new)
    for _ in range(rounds - 1):
        n, total = sums(x, apart(x, centres).argmin(1), k)
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        if (moved == centres).all():
            break
        centres = moved
    return apart(x, centres).argmin(1)


def kmeans(points: DataFrame, k: int, rounds: int = 100, block: int = BLOCK) -> DataFrame:
    """group, id, cluster of the points (group, id, v); all v of a group have one length."""
    sizes = points.groupBy("group").agg(F.count("*").alias("size"))
    sized = points.select("group", "id", "v").join(sizes, "group")
    found = _small(sized.where(F.col("size") <= block), k, rounds)
    if sizes.where(F.col("size") > block).isEmpty():
        return found
    return found.unionByName(_large(sized.where(F.col("size") > block), k, rounds, block))


def _small(points: DataFrame, k: int, rounds: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        of = labels_of(_matrix(table.column("v").combine_chunks()), k, rounds)
        return table.select(["group", "id"]).append_column("cluster", pa.array(of, pa.int32()))

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.select("group", "id", "v").groupBy("group").applyInArrow(run, f"group {kinds['group']}, id {kinds['id']}, cluster int")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _over(blocks: DataFrame, centres: dict, step, output: str, ids: bool = True) -> DataFrame:
    """``step`` (ids, points, centres) gives rows for each block of the groups in ``centres``; output: schema of them after
    group and block."""
    kind = blocks.schema["group"].dataType.simpleString()
    names = ["group", "block", *(f.split()[0] for f in output.split(", "))]
    sent = blocks.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = sent.value
        for batch in batches:
            for i, group in enumerate(batch.column("group").to_pylist()):
                if group not in near:
                    continue
                x = np.frombuffer(batch.column("x")[i].as_buffer()).reshape(batch.column("n")[i].as_py(), -1)
                found = step(batch.column("ids")[i].values if ids else None, x, near[group])
                many = len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(n)[i].as_py()] * many, batch.schema.field(n).type) for n in names[:2]] + found, names=names)

    return (blocks if ids else blocks.drop("ids")).mapInArrow(run, f"group {kind}, block int, {output}")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def _added(partial: DataFrame, most: int) -> DataFrame:
    """group, j, n, s: blocks' sums added in the order of blocks, in runs and then over runs, if there are ``most`` blocks."""
    for by in (F.floor(F.col("block") / RUN).cast("int"), F.lit(0)) if most > RUN else (F.lit(0),):
        rows = F.array_sort(F.collect_list(F.struct("block", "s")))
        added = F.aggregate(F.slice(rows, 2, F.size(rows)), rows[0]["s"], lambda a, x: F.zip_with(a, x["s"], lambda p, q: p + q))
        partial = partial.withColumn("run", by).groupBy("group", "j", F.col("run").alias("block")).agg(F.sum("n").alias("n"), added.alias("s"))
    return partial.drop("block")


def _blocks(points: DataFrame, block: int) -> DataFrame:
    """group, block, n, ids and x, the bytes of the points in the order of their ids; a table that the rounds pass over."""
    number = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / block)).cast("int").alias("block")
    rows = F.sort_array(F.collect_list(F.struct("id", F.col("v").cast("array<double>").alias("v"))))
    gathered = points.groupBy("group", number).agg(rows.alias("r")).select("group", "block", F.transform("r", lambda x: x["id"]).alias("ids"), F.transform("r", lambda x: x["v"]).alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("ids"), [_matrix(v.values).tobytes() for v in batch.column("v")]
            columns = [batch.column("group"), batch.column("block"), pa.array([len(i.values) for i in ids], pa.int32()), ids, pa.array(x, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "block", "n", "ids", "x"])

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return written(gathered.mapInArrow(packed, f"group {kinds['group']}, block int, n int, ids array<{kinds['id']}>, x binary"), "blocks")


def _large(points: DataFrame, k: int, rounds: int, block: int) -> DataFrame:
    blocks = _blocks(points, block)
    most, room = blocks.agg(F.max("block") + 1, F.sum(F.when(F.col("block") == 0, F.length("x") / F.col("n")) * k)).first()
    parts = math.ceil((room or 0) / BROADCAST_BYTES) or 1
    part = F.pmod(F.xxhash64("group"), F.lit(parts))
    found = [_clustered(blocks.where(part == i) if parts > 1 else blocks, k, rounds, most) for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _clustered(blocks: DataFrame, k: int, rounds: int, most: int) -> DataFrame:
    """Of groups whose centres go through the driver together; a round is one job, over the groups that still move."""
    id_kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def farthest(of_mean: bool):
        def step(ids: pa.Array, x: np.ndarray, c: np.ndarray) -> list:
            d = apart(x, c).min(1)
            best = (-d if of_mean else d).argmax()
            return [pa.array([float(-d[best] if of_mean else d[best])]), ids.slice(int(best), 1), _lists(x[best : best + 1])]

        return step

    def summed(_: None, x: np.ndarray, c: np.ndarray) -> list:
        n, total = sums(x, apart(x, c).argmin(1) if len(c) > 1 else np.zeros(len(x), int), len(c))
        return [pa.array(np.arange(len(c)), pa.int32()), pa.array(n), _lists(total)]

    def labelled(ids: pa.Array, x: np.ndarray, c: np.ndarray) -> list:
        return [ids, pa.array(apart(x, c).argmin(1), pa.int32())]

    def means(centres: dict) -> dict:
        moved = {group: c.copy() for group, c in centres.items()}
        for r in _added(_over(blocks, centres, summed, "j int, n long, s array<double>", ids=False), most).collect():
            if r.n:
                moved[r.group][r.j] = np.array(r.s) / r.n
        return moved

    widths = blocks.where("block = 0").select("group", (F.length("x") / F.col("n") / 8).cast("int").alias("width")).collect()
    mean, centres = means({r.group: np.zeros((1, r.width)) for r in widths}), {}
    for j in range(k):
        found = _over(blocks, centres or mean, farthest(j == 0), f"d double, id {id_kind}, p array<double>")
        best = found.groupBy("group").agg(F.min_by("p", F.struct((-F.col("d")).alias("d"), "id")).alias("p")).collect()
        centres = {r.group: np.concatenate([centres[r.group], [r.p]]) if j else np.array([r.p]) for r in best}
    moving = centres
    for _ in range(rounds - 1):
        moved = means(moving)
        moving = {group: c for group, c in moved.items() if not np.array_equal(c, moving[group], equal_nan=True)}
        centres = centres | moving
        if not moving:
            break
    return _over(blocks, centres, labelled, f"id {id_kind}, cluster int").select("group", "id", "cluster")
