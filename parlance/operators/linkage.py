"""How many clusters the points of a group have, by average linkage, and small clusters given to others.

A nearest-neighbour chain merges pairs of clusters that are each other's nearest; with average
linkage such a pair never comes to have a nearer one, so the merges are those of always taking the
nearest pair, in another order, at n^2 steps and one n x n table. A group is one meeting's voices: it must fit
``MOST`` points, and a larger one is an error, not a sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Points of a group: a table of 8 bytes a pair, 128 MB.
MOST = 4_000


def merges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a, b) of all merges by growing height; a cluster is named by its smallest point."""
    n = len(x)
    square = (x * x).sum(1)
    apart = np.sqrt(np.maximum(0, square[:, None] + square - 2 * x @ x.T))
    np.fill_diagonal(apart, np.inf)
    size, open_, chain, found = np.ones(n), np.ones(n, bool), [], []
    while len(found) < n - 1:
        if not chain:
            chain.append(int(open_.argmax()))
        while True:
            top = chain[-1]
            near = int(apart[top].argmin())
            if len(chain) > 1 and apart[top, chain[-2]] <= apart[top, near]:
                near = chain[-2]
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        found.append((float(apart[a, b]), a, b))
        mean = (size[a] * apart[a] + size[b] * apart[b]) / (size[a] + size[b])
        size[a] += size[b]
        open_[b] = False
        apart[a], apart[:, a] = mean, mean
        apart[b], apart[:, b] = np.inf, np.inf
        apart[a, a] = np.inf
    return sorted(found)


def cut(x: np.ndarray, height: float) -> np.ndarray:
    """Clusters of the points that merge at ``height`` or below, numbered by their smallest points."""
    up = np.arange(len(x))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for h, a, b in merges(x):
        if h <= height:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    roots = np.array([top(i) for i in range(len(x))])
    return np.unique(roots, return_inverse=True)[1]


def absorbed(x: np.ndarray, of: np.ndarray, least: int) -> np.ndarray:
    """Clusters of fewer than ``least`` points are given to the nearest mean, the smallest first and of equals the one of
    the largest number, until all are large enough or one is left; numbered by size, equals as before."""
    names = {c: np.flatnonzero(of == c) for c in range(int(of.max()) + 1)} if len(of) else {}
    while len(names) > 1:
        small = min(names, key=lambda c: (len(names[c]), -c))
        if len(names[small]) >= least:
            break
        mine = names.pop(small)
        mean = x[mine].mean(0)
        nearest = min(names, key=lambda c: (((x[names[c]].mean(0) - mean) ** 2).sum(), c))
        names[nearest] = np.concatenate([names[nearest], mine])
    out = np.zeros(len(of), int)
    for number, c in enumerate(sorted(names, key=lambda c: (-len(names[c]), c))):
        out[names[c]] = number
    return out


def average_linkage(points: DataFrame, height: float, share: float = 0.0, least: int = 1, most: int = MOST) -> DataFrame:
    """group, id, cluster of the points (group, id, v): the tree of average linkage cut at ``height``; clusters
    with fewer than ``least`` points and the ``share`` of their group are absorbed. Null vectors have no row."""

    def run(table: pa.Table) -> pa.Table:
        if len(table) > most:
            raise ValueError(f"a group of {len(table)} points; {most} fit")
        table = table.sort_by("id")
        x = np.array(table.column("v").to_pylist(), float)
        of = absorbed(x, cut(x, height), max(least, int(np.ceil(len(x) * share))))
        return table.select(["group", "id"]).append_column("cluster", pa.array(of, pa.int32()))

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.select("group", "id", "v").where("v is not null").groupBy("group").applyInArrow(run, f"group {kinds['group']}, id {kinds['id']}, cluster int")
