"""Centroid clustering: Lloyd's rounds in whole numbers, with Drake's adaptive bounds.

A vector's state holds its cluster, an upper bound of the distance to that centroid, the nearest
other centroids with a lower bound for each, and one lower bound for all the rest. When the
centroids have moved, bounds move by as much; a vector is looked at again only where they don't
certify its order, and then only against the stored centroids that may be nearer, or against all of
them if the remainder bound is reached. Bounds are rounded outwards and must be strictly apart, so
each assignment is the exact one, ties going to the smaller number.

Vectors stay where they are: a round maps their states, written to the shared folder, and sums the
members of each centroid with map-side combination; only the centroids, k rows, reach the driver.
How many centroids are stored adapts to the farthest place that the last round looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import discard, release, stored_at

K, ROUNDS, WIDTH, SCALE, SEED = 40, 5, 64, 256, 2

#: Components beyond it are out of range: squared distances of 64 of them would leave 64 bits.
LARGEST = 1 << 27

SLACK = 1e-12

STATE = "vec_id long, x array<int>, cluster int, distance long, up double, near array<int>, low array<double>, rest double, used int"


def whole_vectors(embeddings: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, x: vectors of ``width`` components, all of them finite, as whole numbers floor(scale * x).

    Other vectors are left out, as are components of 2^27 or more after scaling.
    """
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < LARGEST))
    return embeddings.where((F.size("embedding") == width) & good).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<int>").alias("x"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest sha256 of ``seed:vec_id``; repeated ids in the order of components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()], np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and c; by floating point where that is exact."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * largest * largest * x.shape[1] < 1 << 53:
        x, c = x.astype(float), c.astype(float)
    return ((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)).astype(np.int64)


def distance_to(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row."""
    return ((x - c) ** 2).sum(1)


def above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(float)) * (1 + SLACK)


def below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(float)) * (1 - SLACK)


class Bounds:
    """States of a batch of vectors; ``b`` centroids are stored beside a vector's own."""

    def __init__(self, x: np.ndarray, b: int):
        self.x, n = x, len(x)
        self.cluster, self.up, self.rest = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
        self.near, self.low, self.used = np.zeros((n, b), np.int64), np.zeros((n, b)), np.zeros(n, np.int64)

    def scan(self, rows: np.ndarray, c: np.ndarray) -> None:
        """Order all centroids for these rows."""
        d, b = distances(self.x[rows], c), self.near.shape[1]
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, 1)
        self.cluster[rows], self.up[rows] = order[:, 0], above(d[:, 0])
        self.near[rows], self.low[rows] = order[:, 1 : b + 1], below(d[:, 1 : b + 1])
        self.rest[rows] = below(d[:, b + 1]) if len(c) > b + 1 else np.inf
        self.used[rows] = b + 1

    def move(self, drift: np.ndarray) -> None:
        """Centroids moved by at most ``drift``."""
        self.up = (self.up + drift[self.cluster]) * (1 + SLACK)
        step = drift[self.near]
        self.low = self.low - step - SLACK * (np.abs(self.low) + step)
        self.rest = self.rest - drift.max() - SLACK * (np.where(np.isinf(self.rest), 0, np.abs(self.rest)) + drift.max())
        self.used[:] = 0

    def places(self, rows: np.ndarray) -> np.ndarray:
        """How many of the stored centroids may be as near as the own one; one more: any may."""
        bounds = np.c_[self.low[rows], self.rest[rows]]
        least = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]
        sure = self.up[rows, None] < least
        return np.where(sure.any(1), sure.argmax(1), bounds.shape[1])

    def settle(self, c: np.ndarray) -> None:
        """Assign all vectors to their nearest centroids."""
        rows = np.arange(len(self.x))
        rows = rows[self.places(rows) > 0]
        self.up[rows] = above(distance_to(self.x[rows], c[self.cluster[rows]]))
        place = self.places(rows)
        for j in np.unique(place[place > 0]):
            mine = rows[place == j]
            if j > self.near.shape[1]:
                self.scan(mine, c)
                continue
            among = np.sort(np.c_[self.cluster[mine], self.near[mine, :j]], axis=1)  # ties: smaller numbers first
            d = np.stack([distance_to(self.x[mine], c[among[:, i]]) for i in range(j + 1)], axis=1)
            order = np.argsort(d, axis=1, kind="stable")
            among, d = np.take_along_axis(among, order, 1), np.take_along_axis(d, order, 1)
            self.cluster[mine], self.up[mine] = among[:, 0], above(d[:, 0])
            self.near[mine, :j], self.low[mine, :j], self.used[mine] = among[:, 1:], below(d[:, 1:]), j

    def narrow(self, b: int) -> None:
        """Store fewer centroids; the rest's bound takes over the bounds that go."""
        if b < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, b:].min(1))
            self.near, self.low = self.near[:, :b], self.low[:, :b]


def _fixed(column: pa.Array, kind) -> np.ndarray:
    flat = np.asarray(column.flatten(), kind)
    return flat.reshape(len(column), len(flat) // len(column))


def _table(ids: pa.Array, s: Bounds, c: np.ndarray) -> pa.RecordBatch:
    lists = lambda a, kind: pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], pa.array(a.ravel(), kind))
    columns = [
        ids, lists(s.x, pa.int32()), pa.array(s.cluster, pa.int32()), pa.array(distance_to(s.x, c[s.cluster])), pa.array(s.up),
        lists(s.near, pa.int32()), lists(s.low, pa.float64()), pa.array(s.rest), pa.array(s.used, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in STATE.split(", ")])


def started(vectors: DataFrame, c: np.ndarray, b: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if batch.num_rows:
                s = Bounds(_fixed(batch.column("x"), np.int64), b)
                s.scan(np.arange(len(s.x)), c)
                yield _table(batch.column("vec_id"), s, c)

    return vectors.mapInArrow(run, STATE)


def moved(states: DataFrame, c: np.ndarray, drift: np.ndarray, b: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            s = Bounds(_fixed(batch.column("x"), np.int64), 0)
            s.cluster, s.up, s.rest = (np.array(batch.column(n), k) for n, k in (("cluster", np.int64), ("up", float), ("rest", float)))
            s.near, s.low = _fixed(batch.column("near"), np.int64), _fixed(batch.column("low"), float)
            s.narrow(b)
            s.move(drift)
            s.settle(c)
            yield _table(batch.column("vec_id"), s, c)

    return states.mapInArrow(run, STATE)


def means(states: DataFrame, c: np.ndarray) -> tuple[np.ndarray, int]:
    """floor(sum / count) of each centroid's members, empty ones as they were; the farthest place looked at."""
    rows = states.groupBy("cluster").agg(F.count("*").alias("n"), F.max("used").alias("used"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(c.shape[1])]).collect()
    new = c.copy()
    for r in rows:
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(c.shape[1])]
    return new, max(r.used for r in rows)


def clusters(vectors: DataFrame, c: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """States of the vectors (vec_id, x) after ``rounds`` rounds from the centroids ``c``, and the last centroids.

    Rows of one id are vectors of their own. The vectors' states are whole in each round; a new
    table replaces the one before, which is deleted.
    """
    k = len(c)
    b = min(k - 1, max(1, k // 4))
    states, path = stored_at(started(vectors, c, b), "clusters")
    for _ in range(rounds):
        new, used = means(states, c)
        drift = above(distance_to(new, c))
        b = min(b, max(1, k // 8, used))
        c, old = new, path
        states, path = stored_at(moved(states, c, drift, b), "clusters")
        discard(vectors.sparkSession, old)
    return states, c


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector.

    Vectors that are null, of another length or hold null or non-finite components have no row;
    fewer vectors than centroids: each starts one. No vectors: no rows. Other columns don't matter.
    """
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    c = first_centroids(vectors)
    if len(c):
        states, c = clusters(vectors, c)
    else:
        states = spark.createDataFrame([], STATE)
    text = [(i, ",".join(map(str, row))) for i, row in enumerate(c.tolist())]
    of_cluster = states.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = of_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    named = spark.createDataFrame(text, "cluster int, text string").select("cluster", F.sha2("text", 256).alias("centroid_sha256"))
    per_cluster = of_cluster.join(named, "cluster").crossJoin(F.broadcast(whole))  # at most k rows, and one
    return states.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    def assigned(i: int) -> str:
        apart = "list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return f"""a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, arg_min(k, (d, k)) AS k, min(d) AS d
            FROM (SELECT r, vec_id, q, k, {apart} AS d FROM v, c{i}) GROUP BY r)"""

    def moved_(i: int) -> str:
        return f"""s{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, unnest(range({WIDTH})) AS j FROM a{i}) GROUP BY k, j),
        c{i + 1} AS (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM s{i} GROUP BY k) USING (k))"""

    steps = ", ".join(x for i in range(ROUNDS) for x in (assigned(i), moved_(i)))
    return f"""WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}
    ), c0 AS (
        SELECT row_number() OVER (ORDER BY h, c) - 1 AS k, c FROM (SELECT sha256('{SEED}:' || vec_id) AS h, q AS c FROM v ORDER BY h, c LIMIT {K})
    ), {steps}, {assigned(ROUNDS)}
    SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)"""


OP11_SQL = _rounds_sql()
