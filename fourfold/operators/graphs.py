"""Connected components and spanning forests of link tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourfold.sources.tables import written

#: Edges that one task sorts; more are reduced by rounds of joins.
KRUSKAL_EDGES = 500_000


class Forest:
    """Union-find with path compression; a set's root is its smallest node."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, u: int, v: int) -> bool:
        x, y = self.find(u), self.find(v)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: each node with its set's smallest."""
    sets = Forest()
    for batch in batches:
        for u, v in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            sets.join(u, v)
    nodes = [x for x in sets.parent if sets.find(x) != x]
    for k in range(0, len(nodes), 10_000):
        some = nodes[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([sets.find(x) for x in some], pa.int64()), pa.array(some, pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component, for nodes other than that one with links (a, b), which are longs.

    Each partition reduces its links to a union-find forest; then links move to
    smaller neighbours (large-star and small-star steps) until all point at
    their component's smallest node. All steps are minima and joins: a hub's
    links are never gathered. Links of a node with itself and repeated links
    change nothing; without links there are no rows.
    """
    edges = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "a long, b long").distinct())
    while True:
        # a forest of stars has no node that is both a root and under another one
        chained = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        twice = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not chained and not twice:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: each larger neighbour of u moves to u's smallest
        larger = both.select(F.col("b").alias("u"), F.col("a").alias("v")).where("v > u")
        large = written(larger.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct())
        # small star: u and its smaller neighbours move to the smallest of them
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = written(small.where("a < b").distinct())


def labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) for all ``nodes`` (column id): the smallest id of each one's component."""
    found = components(links)
    return nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = sorted({(d, a, b) for x in batches for a, b, d in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), x.column("d").to_pylist(), strict=True)})
    sets = Forest()
    kept = [(a, b, d) for d, a, b in edges if sets.join(a, b)]
    if kept:
        a, b, d = zip(*kept, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], ["a", "b", "d"])


def spanning_forest(edges: DataFrame, limit: int = KRUSKAL_EDGES) -> DataFrame:
    """Edges (a, b, d), a < b, of the minimum spanning forest; equal lengths go by the nodes.

    Up to ``limit`` edges are sorted in one task. Of more, every component takes
    its shortest edge outward and components are labelled anew until few enough
    edges between them are left.
    """
    left = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("d").cast("double")).distinct())
    if left.count() <= limit:
        return left.coalesce(1).mapInArrow(_kruskal, "a long, b long, d double")
    ends = left.select(F.explode(F.array("a", "b")).alias("node"), F.struct("d", "a", "b").alias("way"))
    taken = written(ends.groupBy("node").agg(F.min("way").alias("way")).select("way.a", "way.b", "way.d").distinct())
    found = written(components(taken))
    own = lambda x: found.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    between = left.join(own("a"), "a", "left").join(own("b"), "b", "left").withColumn("x", F.coalesce("la", "a")).withColumn("y", F.coalesce("lb", "b")).where("x <> y")
    # of the edges between two components the shortest one counts
    shortest = between.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min(F.struct("d", F.col("a").alias("u"), F.col("b").alias("v"))).alias("way"))
    named = written(shortest.select("a", "b", "way.*"))
    outer = spanning_forest(named.select("a", "b", "d"), limit).join(named.select("a", "b", "u", "v"), ["a", "b"])
    return taken.unionByName(outer.select(F.col("u").alias("a"), F.col("v").alias("b"), "d"))
