"""Connected components of links that stay distributed.

Alternating large-star and small-star steps (Kiveris et al., 2014): every node learns the
smallest node near it and hands it to its neighbours, until the links are stars around the
smallest node of each component. A step is one aggregation (partial sums first, so a node
with very many links costs little) and one join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import stored


class Forest:
    """Union-find over any hashable ids; a root is the smallest of its set."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        a, b = min(a, b), max(a, b)
        self.up[b] = a
        self.up.setdefault(a, a)
        return True

    def stars(self) -> list[tuple]:
        """Every joined id but the roots, with its root."""
        return [(x, r) for x in self.up if (r := self.root(x)) != x]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def connected_components(links: DataFrame, name: str, most: int = 60) -> DataFrame:
    """``links`` has long columns a, b. Returns (node, component) for every node with a link
    to another; ``component`` is the smallest node reachable. Null and self links are
    dropped; no links give an empty result.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    was = _state(edges)
    for _ in range(most):
        # large star: larger neighbours of u go to the smallest near u
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours of u, and u, go to the smallest of them
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        now = _state(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
