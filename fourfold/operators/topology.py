"""Point clouds and transition graphs: neighbours, components, persistence, mapper, paths.

Pairs of points are made cell by cell: points fall into cubes of the distance
threshold in their first coordinates, and a point meets only the cubes beside
its own. Operators that are quadratic by definition (nearest neighbours without
a radius, spanning trees, pair counts) take the whole cloud in hashed blocks:
a task holds two blocks, and only neighbours, tree edges or counts leave it.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Sequence
from typing import IO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourfold.operators import graphs
from fourfold.operators.quantiles import quantiles
from fourfold.sources.tables import written

#: Points of a cloud for operators that need its whole distance matrix, taken in the order of a hash of the id.
MATRIX_POINTS = 1_000
#: Points of a hashed block; two blocks meet in one task.
BLOCK_POINTS = 500
#: Queries and points of the blocks of a search: a query is sent once for each block of points, a point once for each block of queries.
QUERY_BLOCK, SEARCH_BLOCK = 2_000, 5_000
#: Bytes of reduced columns that a task of loops holds in memory; the others go to its file.
COLUMN_BYTES = 64_000_000


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _block_pairs(points: DataFrame, size: int, id_col: str, vec: str, by: str | None = None) -> DataFrame:
    """Rows (i, j, block, id, p) that bring each pair of hashed blocks of about ``size`` points together once."""
    n = points.count()
    blocks = max(1, -(-n // size))
    base = points.select(F.col(by or F.lit(0)).alias("by") if by else F.lit(0).alias("by"), F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("p"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))
    return base.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("by", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "p")


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), float)


def block_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of two blocks, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 1_000_000 // max(1, b.size))
    for k in range(0, len(a), step):
        out[k : k + step] = np.sqrt(((a[k : k + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The two blocks of a group, and whether they are one block."""
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    return pdf[pdf["block"] == i], pdf[pdf["block"] == j], i == j


def close_pairs(points: DataFrame, threshold: float, id_col: str = "id", vec: str = "p", grid_dims: int = 2, block: int | None = None) -> DataFrame:
    """(a, b, d) with a < b for points at most ``threshold`` apart.

    In few dimensions points fall into cubes of the threshold and meet the cubes
    beside their own. In many dimensions no grid keeps points apart: then
    ``block`` gives the points of a hashed block, and blocks meet blocks.
    """
    if block:
        kind = points.schema[id_col].dataType.simpleString()

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            left, right, same = _sides(pdf)
            d = block_distances(_matrix(left["p"]), _matrix(right["p"])) if len(left) and len(right) else np.zeros((0, 0))
            x, y = np.nonzero(np.triu(d <= threshold, 1) if same else d <= threshold)
            u, v = left["id"].to_numpy()[x], right["id"].to_numpy()[y]
            return pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v), "d": d[x, y]})

        return _block_pairs(points, block, id_col, vec).groupBy("i", "j").applyInPandas(run, f"a {kind}, b {kind}, d double")
    p = F.col(vec).cast("array<double>")
    cell = [F.floor(p[k] / threshold).cast("long") for k in range(grid_dims)]
    base = points.select(F.col(id_col).alias("id"), p.alias("p"), *[c.alias(f"c{k}") for k, c in enumerate(cell)])
    beside = base.select("id", "p", *[F.explode(F.array(F.col("c0") - 1, F.col("c0"), F.col("c0") + 1)).alias("c0")], *[f"c{k}" for k in range(1, grid_dims)])
    for k in range(1, grid_dims):
        beside = beside.withColumn(f"c{k}", F.explode(F.array(F.col(f"c{k}") - 1, F.col(f"c{k}"), F.col(f"c{k}") + 1)))
    left, right = base.alias("l"), beside.alias("r")
    same = [F.col(f"l.c{k}") == F.col(f"r.c{k}") for k in range(grid_dims)]
    joined = left.join(right, same).where(F.col("l.id") < F.col("r.id"))
    return joined.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), l2(F.col("l.p"), F.col("r.p")).alias("d")).where(F.col("d") <= threshold)


def pair_counts(points: DataFrame, radii: Sequence[float], id_col: str = "id", vec: str = "p", block: int = BLOCK_POINTS) -> DataFrame:
    """(r, pairs, all_pairs): pairs of the whole cloud closer than each radius, counted block by block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        d = block_distances(_matrix(left["p"]), _matrix(right["p"])) if len(left) and len(right) else np.zeros((0, 0))
        d = d[np.triu_indices(len(left), 1)] if same else d.ravel()
        return pd.DataFrame({"r": [float(r) for r in radii], "pairs": [int((d < r).sum()) for r in radii], "all_pairs": len(d)})

    counted = _block_pairs(points, block, id_col, vec).groupBy("i", "j").applyInPandas(run, "r double, pairs long, all_pairs long")
    return counted.groupBy("r").agg(F.sum("pairs").alias("pairs"), F.sum("all_pairs").alias("all_pairs"))


def sample_points(points: DataFrame, n: int = MATRIX_POINTS, id_col: str = "id") -> DataFrame:
    return points.orderBy(F.xxhash64(id_col), id_col).limit(n)


def sample_pairs(points: DataFrame, n: int = MATRIX_POINTS, id_col: str = "id", vec: str = "p") -> DataFrame:
    """All pairs of a bounded sample; one side is broadcast."""
    some = sample_points(points, n, id_col).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("p"))
    a, b = some.alias("l"), F.broadcast(some).alias("r")
    return a.join(b, F.col("l.id") < F.col("r.id")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), l2(F.col("l.p"), F.col("r.p")).alias("d"))


def auto_threshold(points: DataFrame, id_col: str = "id", vec: str = "p") -> float:
    """Median distance of a bounded sample's pairs."""
    return sample_pairs(points, MATRIX_POINTS, id_col, vec).agg(F.percentile("d", F.lit(0.5))).first()[0]


def betti(points: DataFrame, threshold: float, id_col: str = "id", vec: str = "p", block: int | None = None) -> DataFrame:
    """b0 components of the graph of close pairs, b1 = E - V + b0 its independent loops, and their Euler number."""
    edges = written(close_pairs(points, threshold, id_col, vec, block=block))
    joined = graphs.components(edges).agg(F.count(F.lit(1)).alias("under"))
    counts = points.agg(F.count(F.lit(1)).alias("v")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("e")))).join(F.broadcast(joined))
    found = counts.select("v", "e", (F.col("v") - F.col("under")).alias("b0"))
    return found.select("v", "e", "b0", F.greatest(F.lit(0), F.col("e") - F.col("v") + F.col("b0")).alias("b1")).withColumn("euler", F.col("b0") - F.col("b1"))


def spanning_tree(points: DataFrame, by: str | None = None, id_col: str = "id", vec: str = "p", block: int = BLOCK_POINTS) -> DataFrame:
    """Edges (a, b, d) of the minimum spanning tree of the whole cloud, or of each group of ``by``.

    Every pair of blocks gives the tree of its own points; an edge that is
    longest in a cycle there is so in the whole cloud, so the tree lies in their
    union. Ids are longs.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        data, ids = _matrix(pdf["p"]), pdf["id"].to_numpy()
        d, x, y = _tree(data)
        return pd.DataFrame({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "d": d})

    kept = _block_pairs(points, block, id_col, vec, by).groupBy("by", "i", "j").applyInPandas(run, "a long, b long, d double")
    return graphs.spanning_forest(kept)


def persistence_h0(points: DataFrame, id_col: str = "id", vec: str = "p", by: str | None = None) -> DataFrame:
    """Births (0) and deaths of components as the threshold grows, over the whole cloud (or each whole group of ``by``): edges of the minimum spanning tree, and one that never dies."""
    tree = spanning_tree(points, by, id_col, vec)
    named = [F.col(by)] if by else []
    if by:
        tree = tree.join(points.select(F.col(id_col).alias("a"), F.col(by)), "a")
    finite = tree.select(*named, F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.col("d").alias("death"))
    return finite.unionByName(points.select(*(named or [F.lit(1).alias("one")])).distinct().select(*named, F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.lit(float("inf")).alias("death")))


def betti_curves(points: DataFrame, thresholds: Sequence[float], id_col: str = "id", vec: str = "p") -> DataFrame:
    """(threshold, b0, b1) of the whole cloud as the threshold grows: deaths of the spanning tree and counts of pairs up to it.

    One spanning tree and one pass over blocks serve all thresholds.
    """
    n = points.count()
    tree = written(spanning_tree(points, None, id_col, vec))
    steps = points.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    joined = steps.join(tree, F.col("d") <= F.col("threshold"), "left").groupBy("threshold").agg(F.count("d").alias("under"))
    pairs = pair_counts(points, [math.nextafter(float(t), math.inf) for t in thresholds], id_col, vec)
    edges = steps.join(pairs, F.abs(F.col("r") - F.col("threshold")) <= 1e-12 * F.abs(F.col("threshold"))).select("threshold", "pairs")
    b0 = F.lit(n) - F.col("under")
    return joined.join(edges, "threshold").select("threshold", b0.alias("b0"), F.greatest(F.lit(0), F.col("pairs") - n + b0).alias("b1"))


def clusters_by_betti(curves: DataFrame) -> DataFrame:
    """The most frequent b0 over the thresholds; ties go to the smallest."""
    counts = curves.groupBy("b0").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("b0", F.struct(-F.col("n"), F.col("b0"))).alias("clusters"))


def loops_by_betti(curves: DataFrame) -> DataFrame:
    """The largest b1 over the thresholds."""
    return curves.agg(F.max("b1").alias("loops"))


def betti_signature(b0: Column, b1: Column, b2: Column | None = None) -> Column:
    return F.format_string("β₀=%d-β₁=%d-β₂=%d", b0, b1, F.lit(0) if b2 is None else b2)


def complexity(b0: Column, b1: Column, b2: Column | None = None) -> Column:
    return b0 + 2 * b1 + 3 * (F.lit(0) if b2 is None else b2)


def _tree(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and ends of the edges of the minimum spanning tree (Prim)."""
    n = len(data)
    if n < 2:
        return np.zeros(0), np.zeros(0, int), np.zeros(0, int)
    best, source = np.full(n, np.inf), np.zeros(n, int)
    inside = np.zeros(n, bool)
    now, out = 0, []
    for _ in range(n - 1):
        inside[now] = True
        d = np.sqrt(((data - data[now]) ** 2).sum(axis=1))
        nearer = ~inside & (d < best)
        best[nearer], source[nearer] = d[nearer], now
        now = int(np.where(inside, np.inf, best).argmin())
        out.append((best[now], source[now], now))
    d, x, y = (np.array(c) for c in zip(*out, strict=True))
    return d, x, y


def spanning_edges(data: np.ndarray) -> np.ndarray:
    """Sorted edge lengths of the minimum spanning tree."""
    return np.sort(_tree(data)[0])


def _edges(data: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends (the first is smaller) and lengths of the edges up to ``limit``, by length; memory goes by edges, not by pairs."""
    n, dims = data.shape
    square = (data * data).sum(axis=1)
    found = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))]
    step, some = max(1, 2_000_000 // n), max(1, 1_000_000 // max(1, dims))
    for k in range(0, n, step):
        both = square[k : k + step, None] + square[None, k:]
        # products of matrices rule out pairs that are longer beyond their rounding; the others are measured
        near = np.triu(~(both - 2 * (data[k : k + step] @ data[k:].T) > limit * limit + 1e-12 * (dims + 1) * both), 1)
        a, b = (x.astype(np.int32) + np.int32(k) for x in np.nonzero(near))
        for at in range(0, len(a), some):
            x, y = a[at : at + some], b[at : at + some]
            d = np.sqrt(((data[x] - data[y]) ** 2).sum(axis=1))
            kept = d <= limit
            found.append((x[kept], y[kept], d[kept]))
    a, b, d = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((b, a, d))
    return a[order], b[order], d[order]


class _Columns:
    """Sorted columns by their first entry; those beyond ``COLUMN_BYTES`` lie in a file that ends with the task."""

    def __init__(self) -> None:
        self.kept: dict[int, np.ndarray] = {}
        self.places: dict[int, tuple[int, int]] = {}
        self.bytes = self.end = 0
        self.file: IO[bytes] | None = None

    def add(self, column: np.ndarray) -> None:
        pivot = int(column[0])
        if self.bytes + column.nbytes <= COLUMN_BYTES:
            self.kept[pivot] = column
            self.bytes += column.nbytes
            return
        self.file = self.file or tempfile.TemporaryFile()
        self.file.write(column.data)
        self.places[pivot] = (self.end, column.nbytes)
        self.end += column.nbytes

    def get(self, pivot: int) -> np.ndarray | None:
        if pivot not in self.places:
            return self.kept.get(pivot)
        start, size = self.places[pivot]
        self.file.seek(start)
        column = np.frombuffer(self.file.read(size), np.int64)
        self.file.seek(self.end)
        return column


def _loops(n: int, a: np.ndarray, b: np.ndarray, length: np.ndarray, loops: bool = True) -> list[tuple[int, float, float]]:
    """Persistence pairs of components and loops of ``n`` points from their edges, by length.

    A triangle is named by the number of its longest edge and the vertex
    opposite, which also orders triangles by length. Edges that join components
    are the deaths of these. The others, the longest first, are paired with the
    first triangle that is left of their coboundary over two elements. An edge
    that is the longest of a triangle has its first such triangle as its pair:
    loops that are born and die at once need no reduction and no stored column.
    """
    none = len(a)
    sets, tree = graphs.Forest(), np.zeros(none, bool)
    for at in range(0, none, 100_000):
        if np.count_nonzero(tree) == n - 1:
            break
        own = slice(at, at + 100_000)
        tree[own] = [sets.join(x, y) for x, y in zip(a[own].tolist(), b[own].tolist(), strict=True)]
    out = [(0, 0.0, x) for x in length[tree].tolist() if x > 0] + [(0, 0.0, math.inf)] * (n - int(tree.sum()))
    if not loops:
        return out
    # the neighbours of each vertex in order, and the numbers of the edges to them
    by = np.argsort(np.concatenate([a * np.int64(n) + b, b * np.int64(n) + a]))
    number = (by % max(1, none)).astype(np.int32)
    vertex = np.where(by < none, b[number], a[number])
    del by
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    ends = np.cumsum(degree)
    of = [slice(x, y) for x, y in zip((ends - degree).tolist(), ends.tolist(), strict=True)]
    row = np.full(n, none, np.int32)
    first = np.full(none, -1, np.int32)
    for x in range(n):
        later = slice(int(np.searchsorted(vertex[of[x]], x)) + of[x].start, of[x].stop)
        row[vertex[of[x]]] = number[of[x]]
        total = np.cumsum(degree[vertex[later]])
        cuts = np.flatnonzero(np.diff(total // 1_000_000)) + 1 if len(total) else []
        for at in np.split(np.arange(later.start, later.stop), cuts):
            size = degree[vertex[at]]
            side = np.repeat(np.arange(len(at)), size)
            place = np.arange(len(side)) + np.repeat(ends[vertex[at]] - np.cumsum(size), size)
            inside = np.flatnonzero(np.maximum(row[vertex[place]], number[place]) < number[at][side])
            side, least = np.unique(side[inside], return_index=True)
            first[number[at[side]]] = vertex[place[inside[least]]]
        row[vertex[of[x]]] = none

    def coboundary(e: int) -> np.ndarray:
        x, y = int(a[e]), int(b[e])
        row[vertex[of[x]]] = number[of[x]]
        left = row[vertex[of[y]]]
        row[vertex[of[x]]] = none
        common = np.flatnonzero(left < none)
        left, right, third = left[common], number[of[y]][common], vertex[of[y]][common].astype(np.int64)
        long = np.maximum(left, right).astype(np.int64)
        return np.sort(np.where(long < e, e * n + third, long * n + np.where(left > right, y, x)))

    reduced = _Columns()
    for e in np.flatnonzero(~tree & (first < 0))[::-1].tolist():
        runs = [own] if len(own := coboundary(e)) else []
        while (pivot := _first_odd(runs)) >= 0:
            other = reduced.get(pivot)
            if other is None and first[pivot // n] == pivot % n:
                other = coboundary(pivot // n)
                if reduced.bytes < COLUMN_BYTES // 2:
                    reduced.add(other)  # asked for again and again
            if other is None:
                break
            _add(runs, other[1:])  # the pivot is gone from both
        if pivot < 0:
            out.append((1, float(length[e]), math.inf))
            continue
        column = np.array([pivot])
        for run in reversed(runs):
            column = _sum_of_two(column, run)
        reduced.add(column)
        if length[pivot // n] > length[e]:
            out.append((1, float(length[e]), float(length[pivot // n])))
    return out


def _sum_of_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What only one of two sorted arrays has."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    once = np.ones(len(both) + 1, bool)
    np.not_equal(both[1:], both[:-1], out=once[1:-1])
    return both[once[1:] & once[:-1]]


def _add(runs: list[np.ndarray], other: np.ndarray) -> None:
    """Add a sorted array to a sum kept as few sorted runs, each over twice as long as the next."""
    while runs and len(runs[-1]) <= 2 * len(other):
        other = _sum_of_two(runs.pop(), other)
    if len(other):
        runs.append(other)


def _first_odd(runs: list[np.ndarray]) -> int:
    """Take the least entry that an odd number of runs has off them, with all before it; -1 without any."""
    while runs:
        heads = [int(r[0]) for r in runs]
        least = min(heads)
        left = (r[1:] if x == least else r for r, x in zip(runs, heads, strict=True))
        runs[:] = [r for r in left if len(r)]
        if heads.count(least) % 2:
            return least
    return -1


def rips(data: np.ndarray, limit: float, max_dim: int = 1) -> list[tuple[int, float, float]]:
    """Persistence pairs (dim, birth, death) of the Rips complex up to ``limit``.

    Components and loops come from the coboundaries of edges. From the second
    dimension on, the whole boundary matrix is reduced over two elements.
    """
    n = len(data)
    if n < 2:
        return [(0, 0.0, math.inf)] * n
    if max_dim < 2:
        return sorted(_loops(n, *_edges(data, limit), max_dim > 0))
    d = block_distances(data, data)
    simplices: list[tuple[float, tuple[int, ...]]] = [(0.0, (k,)) for k in range(n)]
    level = [((a, b), float(d[a, b])) for a in range(n) for b in range(a + 1, n) if d[a, b] <= limit]
    near = [set(np.flatnonzero(d[k] <= limit).tolist()) - {k} for k in range(n)]
    for _ in range(max_dim + 1):
        simplices += [(v, s) for s, v in level]
        level = [((*s, c), max(v, *(float(d[c, x]) for x in s))) for s, v in level for c in set.intersection(*(near[x] for x in s)) if c > s[-1]]
    simplices.sort(key=lambda x: (x[0], len(x[1]), x[1]))
    place = {s: k for k, (_, s) in enumerate(simplices)}
    low: dict[int, int] = {}
    columns: dict[int, set[int]] = {}
    paired: set[int] = set()
    out = []
    for k, (value, s) in enumerate(simplices):
        column = {place[s[:j] + s[j + 1 :]] for j in range(len(s))} if len(s) > 1 else set()
        while column and (top := max(column)) in low:
            column = column ^ columns[low[top]]
        if column:
            top = max(column)
            low[top], columns[k] = k, column
            paired |= {top, k}
            if value > simplices[top][0]:
                out.append((len(s) - 2, simplices[top][0], value))
    out += [(len(s) - 1, v, math.inf) for k, (v, s) in enumerate(simplices) if k not in paired and len(s) - 1 <= max_dim]
    return sorted(out)


def diagrams(groups: DataFrame, by: str, vec: str = "p", limit: float = math.inf, max_dim: int = 1) -> DataFrame:
    """Persistence pairs of each group's whole cloud up to the distance ``limit``.

    A group is taken in one task, with its edges up to ``limit`` (some 60 bytes
    each), over which loops are reduced; higher dimensions take the matrix of
    distances and the cliques: use ``persistence_h0`` for components of large
    clouds.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[by].iloc[0]
        return pd.DataFrame([(key, *r) for r in rips(_matrix(pdf["p"]), limit, max_dim)], columns=[by, "dim", "birth", "death"])

    kind = groups.schema[by].dataType.simpleString()
    # few rows, long work: a number that adaptive execution doesn't lower, so that groups run side by side
    dealt = groups.select(by, F.col(vec).cast("array<double>").alias("p")).repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    return dealt.groupBy(by).applyInPandas(run, f"`{by}` {kind}, dim int, birth double, death double")


def alive(diagram: DataFrame, threshold: float) -> DataFrame:
    """Features of each dimension with birth <= threshold < death."""
    return diagram.groupBy("dim").agg(F.count_if((F.col("birth") <= threshold) & (F.col("death") > threshold)).alias("betti"))


def entropy(diagram: DataFrame, *by: str) -> DataFrame:
    """Entropy of finite persistences' shares."""
    rows = diagram.where(F.col("death") < float("inf")).withColumn("__p", F.col("death") - F.col("birth"))
    total = rows.groupBy(*by).agg(F.sum("__p").alias("__total"))
    shares = rows.join(F.broadcast(total), list(by)) if by else rows.crossJoin(F.broadcast(total))
    share = F.col("__p") / F.col("__total")
    return shares.groupBy(*by).agg(F.sum(-share * F.ln(share + 1e-10)).alias("entropy"), F.count(F.lit(1)).alias("n"))


def top_features(diagram: DataFrame, k: int) -> DataFrame:
    return diagram.withColumn("persistence", F.col("death") - F.col("birth")).orderBy(F.desc("persistence"), "birth").limit(k)


def matching_distance(a: np.ndarray, b: np.ndarray, order: float = math.inf) -> float:
    """Bottleneck (order inf) or Wasserstein distance of two finite diagrams (birth, death), with the diagonal as partner."""
    n, m = len(a), len(b)
    if not n + m:
        return 0.0
    cost = np.zeros((n + m, n + m))
    if n and m:
        cost[:n, :m] = np.abs(a[:, None, :] - b[None, :, :]).max(axis=2)
    cost[:n, m:] = ((a[:, 1] - a[:, 0]) / 2)[:, None] if n else 0
    cost[n:, :m] = ((b[:, 1] - b[:, 0]) / 2)[None, :] if m else 0
    if math.isinf(order):
        steps = np.unique(cost)
        lo, hi = 0, len(steps) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if _perfect(cost <= steps[mid]) else (mid + 1, hi)
        return float(steps[lo])
    return float(_assignment(cost**order) ** (1 / order))


def _perfect(allowed: np.ndarray) -> bool:
    partner = [-1] * len(allowed)

    def grow(k: int, seen: set[int]) -> bool:
        for j in np.flatnonzero(allowed[k]).tolist():
            if j not in seen:
                seen.add(j)
                if partner[j] < 0 or grow(partner[j], seen):
                    partner[j] = k
                    return True
        return False

    return all(grow(k, set()) for k in range(len(allowed)))


def _assignment(cost: np.ndarray) -> float:
    """Least total cost of a perfect matching: shortest augmenting paths with potentials."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[j]:
            used[j] = True
            row = match[j]
            free = ~used[1:]
            reach = cost[row - 1] - u[row] - v[1:]
            better = free & (reach < least[1:])
            least[1:][better], way[1:][better] = reach[better], j
            nxt = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
        while j:
            match[j], j = match[way[j]], way[j]
    return float(-v[0])


def _shortest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k least finite entries; equal ones go by column."""
    rows, columns = [], []
    most = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
    for row, (own, limit) in enumerate(zip(d, most, strict=True)):
        may = np.flatnonzero((own <= limit) & np.isfinite(own))
        columns.append(may[np.argsort(own[may], kind="stable")[:k]])
        rows.append(np.full(len(columns[-1]), row))
    return np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, int), *columns])


def nearest(points: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vec: str = "p", query_block: int = QUERY_BLOCK, block: int = SEARCH_BLOCK) -> DataFrame:
    """(query, id, d, rank): the k nearest other points of each row of ``queries``, which may be all points.

    Blocks of queries meet blocks of points; each meeting keeps k points a
    query, and the ranks are taken over those. Equal distances go by id.
    """
    kind, query_kind = points.schema[id_col].dataType.simpleString(), queries.schema[id_col].dataType.simpleString()
    sides, counts = [], [max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (points, block))]
    for side, df in enumerate((queries, points)):
        own = F.pmod(F.xxhash64(id_col), F.lit(counts[side])).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(counts[1 - side] - 1)))
        named = [own.alias("i"), other.alias("j")] if side == 0 else [other.alias("i"), own.alias("j")]
        sides.append(df.select(*named, F.lit(side).alias("side"), F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("p")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("id")
        if not len(q) or not len(x):
            return pd.DataFrame({"query": q["id"][:0], "id": x["id"][:0], "d": np.zeros(0)})
        asked, names, left, right = q["id"].to_numpy(), x["id"].to_numpy(), _matrix(q["p"]), _matrix(x["p"])
        out = []
        step = max(1, 2_000_000 // len(names))
        for first in range(0, len(asked), step):
            own = asked[first : first + step]
            d = block_distances(left[first : first + step], right)
            d[own[:, None] == names[None, :]] = np.inf
            row, at = _shortest(d, k)
            out.append(pd.DataFrame({"query": own[row], "id": names[at], "d": d[row, at]}))
        return pd.concat(out)

    met = sides[0].unionByName(sides[1]).groupBy("i", "j").applyInPandas(run, f"query {query_kind}, id {kind}, d double")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))).where(F.col("rank") <= k)


def local_density(near: DataFrame) -> DataFrame:
    return near.groupBy("query").agg((1 / (F.avg("d") + 1e-10)).alias("density"))


def mle_dimension(near: DataFrame) -> DataFrame:
    """Median over queries of the likelihood estimate of intrinsic dimension from neighbour distances."""
    far = Window.partitionBy("query")
    logs = near.withColumn("__k", F.max("d").over(far)).where("d > 0 and d < __k").groupBy("query").agg((F.count(F.lit(1)) / F.sum(F.ln(F.col("__k") / F.col("d")))).alias("m"))
    return quantiles(logs, [(F.col("m"), {"dimension": 0.5})], also=[F.count(F.lit(1)).alias("n")])


def correlation_dimension(points: DataFrame, radii: Sequence[float], id_col: str = "id", vec: str = "p") -> DataFrame:
    """Slope of ln share of all pairs within r on ln r."""
    counts = pair_counts(points, radii, id_col, vec).where("pairs > 0")
    return counts.agg(F.regr_slope(F.ln(F.col("pairs") / F.col("all_pairs")), F.ln("r")).alias("dimension"), F.count(F.lit(1)).alias("n"))


def curvature(points: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vec: str = "p") -> DataFrame:
    """Smallest over largest variance of each query point's k nearest points: 0 where they lie flat."""
    near = nearest(points, queries, k, id_col, vec)
    rows = near.join(points.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("p")), "id").select("query", "p")
    kind = rows.schema["query"].dataType.simpleString()

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.array(pdf["p"].tolist(), float)
        values = np.linalg.eigvalsh(np.cov(data.T)) if len(data) > 1 else np.zeros(1)
        return pd.DataFrame({"query": [pdf["query"].iloc[0]], "curvature": [float(max(values[0], 0.0) / values[-1]) if values[-1] > 0 else 0.0]})

    return rows.groupBy("query").applyInPandas(local, f"query {kind}, curvature double")


def manifold(points: DataFrame, vec: str = "p") -> DataFrame:
    """Ambient and intrinsic dimension (95 % of the variance), their ratio, and whether it is under 0.7; under 10 rows the ambient one."""
    n, _, cov = covariance(points, vec)
    size = len(cov)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1] if size else np.zeros(1)
    total = np.cumsum(values) / max(values.sum(), 1e-300)
    own = int(np.searchsorted(total, 0.95) + 1) if n >= 10 else size
    share = float(total[own - 1]) if own and size else 1.0
    return points.sparkSession.createDataFrame([(size, own, own / max(size, 1), bool(own < 0.7 * size), share)], "ambient int, intrinsic int, ratio double, is_manifold boolean, confidence double")


def covariance(points: DataFrame, vec: str = "p") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance; each batch of rows is one matrix product, and only sums leave a task."""
    cells = covariance_cells(points, vec).collect()
    size = max((r.i for r in cells), default=-1) + 1
    n, mean, cov = 0, np.zeros(size), np.zeros((size, size))
    for r in cells:
        n, mean[r.i] = r.n, r.mean if r.i == r.j else mean[r.i]
        cov[r.i, r.j] = cov[r.j, r.i] = r.cov
    return n, mean, cov


def covariance_cells(points: DataFrame, vec: str = "p") -> DataFrame:
    """(i, j, n, mean, cov) for i <= j: the covariance matrix (n - 1) as a table, with the mean of dimension i.

    Values are taken off the cloud's first mean, so that no digits are lost.
    """
    p = F.col(vec).cast("array<double>")
    clean = points.where(F.col(vec).isNotNull()).select(p.alias("p"))
    centre = {r.k: r.m for r in clean.select(F.posexplode("p").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m")).collect()}
    mid = np.array([centre[k] for k in range(len(centre))])

    def sums(batches):
        size = len(mid)
        total, first, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            data = np.array(batch.column("p").to_pylist(), float).reshape(-1, size) - mid
            total, first, n = total + data.T @ data, first + data.sum(axis=0), n + len(data)
        if n:
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j]), pa.array(first[i]), pa.array(first[j]), pa.array(np.full(len(i), n))], ["i", "j", "xy", "x", "y", "n"])

    parts = clean.mapInArrow(sums, "i int, j int, xy double, x double, y double, n long")
    added = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y", "n")])
    means = points.sparkSession.createDataFrame([(k, float(m)) for k, m in enumerate(mid)], "i int, centre double")
    cov = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))
    return added.join(F.broadcast(means), "i").select("i", "j", "n", (F.col("centre") + F.col("x") / F.col("n")).alias("mean"), cov.alias("cov"))


def pca_dimension(points: DataFrame, vec: str = "p", share: float = 0.95) -> int:
    values = np.sort(np.linalg.eigvalsh(covariance(points, vec)[2]))[::-1]
    total = np.cumsum(values) / max(values.sum(), 1e-300)
    return int(np.searchsorted(total, share) + 1)


def distances(data: np.ndarray) -> np.ndarray:
    return np.sqrt(((data[:, None, :] - data[None, :, :]) ** 2).sum(axis=2))


def _reach(near: np.ndarray, core: np.ndarray | None = None) -> np.ndarray:
    """Component of each point in a neighbour matrix; growth passes through ``core`` points only, others alone are -1."""
    core = np.ones(len(near), bool) if core is None else core
    marks = np.full(len(near), -1)
    for k in np.flatnonzero(core):
        if marks[k] < 0:
            todo, marks[k] = [int(k)], k
            while todo:
                x = todo.pop()
                if core[x]:
                    new = np.flatnonzero(near[x] & (marks < 0))
                    marks[new] = k
                    todo += new.tolist()
    return marks


def cluster_components(data: np.ndarray, least: int) -> np.ndarray:
    """Components of pairs under the 10 % shortest distances."""
    d = distances(data)
    upper = d[np.triu_indices(len(d), 1)]
    return _reach(d <= (np.percentile(upper, 10) if len(upper) else 0.0))


def cluster_linkage(data: np.ndarray, least: int) -> np.ndarray:
    """Single linkage cut into max(2, n // least) clusters."""
    d = distances(data)
    cuts = spanning_edges(data)
    keep = len(data) - max(2, len(data) // least)
    return _reach(d <= (cuts[keep - 1] if keep > 0 else 0.0))


def cluster_density(data: np.ndarray, least: int) -> np.ndarray:
    """Growth through points with ``least`` neighbours within the median distance of the ``least``-th neighbour; the rest is noise."""
    d = distances(data)
    k = min(least, len(data) - 1)
    near = d <= np.median(np.sort(d, axis=1)[:, k])
    return _reach(near, near.sum(axis=1) >= least)


def cluster_means(data: np.ndarray, least: int, steps: int = 50, seed: int = 42) -> np.ndarray:
    """Lloyd's iterations with n // least centres."""
    k = max(1, len(data) // least)
    centres = data[np.random.default_rng(seed).choice(len(data), k, replace=False)]
    for _ in range(steps):
        marks = ((data[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([data[marks == c].mean(axis=0) if (marks == c).any() else centres[c] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return marks


CLUSTERINGS = {"components": cluster_components, "single_linkage": cluster_linkage, "dbscan": cluster_density, "kmeans": cluster_means}


def mapper(points: DataFrame, intervals: int = 10, overlap: float = 0.3, least: int = 3, id_col: str = "id", vec: str = "p", filter_col: Column | None = None, method: str = "components") -> tuple[DataFrame, DataFrame]:
    """Nodes (node, member) and edges (a, b, shared) of a mapper graph.

    Points are sorted into overlapping intervals of a filter (by default the
    first principal axis); within each, points form clusters of ``least`` or
    more; clusters that share points are joined. ``components`` of close points
    are found block by block over any number of points with ids that are longs;
    single_linkage, dbscan and kmeans hold an interval's distance matrix in one
    task, so their intervals have to be narrow enough for that.
    """
    p = F.col(vec).cast("array<double>")
    if filter_col is None:
        _, mean, cov = covariance(points, vec)
        axis = np.linalg.eigh(cov)[1][:, -1]
        axis = axis * (1 if axis[np.abs(axis).argmax()] > 0 else -1)
        filter_col = sum(((p[k] - float(mean[k])) * float(axis[k]) for k in range(len(axis))), F.lit(0.0))
    valued = points.select(F.col(id_col).alias("id"), p.alias("p"), filter_col.alias("f"))
    lo, hi = valued.agg(F.min("f"), F.max("f")).first()
    length = (hi - lo) / max(intervals - overlap * (intervals - 1), 1e-12)
    step = length * (1 - overlap)
    cover = [(k, lo + k * step, lo + k * step + length + 1e-12) for k in range(intervals)]
    table = F.broadcast(points.sparkSession.createDataFrame(cover, "interval int, low double, high double"))
    parts = valued.join(table, F.col("f").between(F.col("low"), F.col("high"))).select("interval", "id", "p")
    if method == "components":
        nodes = _close_components(written(parts), least, intervals)
    else:
        cluster_of = CLUSTERINGS[method]

        def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            ids = pdf["id"].to_numpy()
            marks = cluster_of(_matrix(pdf["p"]), least)
            name, rows = pdf["interval"].iloc[0], []
            for m in np.unique(marks[marks >= 0]):
                own = ids[marks == m]
                if len(own) >= least:
                    rows += [(f"{name}-{own.min()}", x) for x in own]
            return pd.DataFrame(rows, columns=["node", "member"])

        kind = valued.schema["id"].dataType.simpleString()
        nodes = parts.groupBy("interval").applyInPandas(cluster, f"node string, member {kind}")
    nodes = written(nodes)
    left, right = nodes.alias("l"), nodes.alias("r")
    edges = left.join(right, F.col("l.member") == F.col("r.member")).where(F.col("l.node") < F.col("r.node")).groupBy(F.col("l.node").alias("a"), F.col("r.node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    return nodes, edges


def _close_components(parts: DataFrame, least: int, intervals: int) -> DataFrame:
    """Components of each interval's pairs under the 10 % shortest distances, block by block.

    The 10 % point is taken over the pairs of up to about MATRIX_POINTS points
    of an interval, picked by a hash of the id: all points where there are fewer.
    """
    share = parts.groupBy("interval").agg(F.ceil(F.count(F.lit(1)) / MATRIX_POINTS).cast("long").alias("every"))
    some = parts.join(F.broadcast(share), "interval").where(F.pmod(F.xxhash64("id"), F.col("every")) == 0)

    def tenth(pdf: pd.DataFrame) -> pd.DataFrame:
        data = _matrix(pdf["p"])
        d = block_distances(data, data)[np.triu_indices(len(data), 1)]
        return pd.DataFrame({"interval": [pdf["interval"].iloc[0]], "radius": [float(np.percentile(d, 10)) if len(d) else 0.0]})

    radii = written(some.select("interval", "id", "p").groupBy("interval").applyInPandas(tenth, "interval int, radius double"))
    within = written(parts.join(F.broadcast(radii), "interval"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        d = block_distances(_matrix(left["p"]), _matrix(right["p"])) if len(left) and len(right) else np.zeros((0, 0))
        close = d <= pdf["radius"].iloc[0]
        x, y = np.nonzero(np.triu(close, 1) if same else close)
        at = int(pdf["interval"].iloc[0])
        return pd.DataFrame({"a": left["id"].to_numpy()[x] * intervals + at, "b": right["id"].to_numpy()[y] * intervals + at})

    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK_POINTS)).cast("int")
    sized = within.join(F.broadcast(within.groupBy("interval").agg(blocks.alias("blocks"))), "interval").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = sized.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("interval", "radius", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "p")
    links = met.groupBy("interval", "i", "j").applyInPandas(run, "a long, b long")
    marked = graphs.labels(within.select((F.col("id").cast("long") * intervals + F.col("interval")).alias("id")), links)
    marked = written(marked)
    large = marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("label")
    name = F.concat_ws("-", F.pmod("label", F.lit(intervals)).cast("string"), F.expr(f"(label - pmod(label, {intervals})) div {intervals}").cast("string"))
    return marked.join(large, "label").select(name.alias("node"), F.expr(f"(id - pmod(id, {intervals})) div {intervals}").alias("member"))


#: The default state transitions (from, to, operation, cost, risk).
DEFAULT_EDGES = [
    (0, 0, "gate", 1.0, 0.0), (2, 0, "gate", 1.0, 0.3), (1, 1, "gate", 1.0, 0.0), (3, 3, "gate", 1.0, 0.0),
    (0, 0, "admit", 1.0, 0.0), (2, 3, "admit", 1.0, 0.1), (1, 1, "admit", 1.0, 0.0), (3, 3, "admit", 1.0, 0.0),
    (0, 3, "comp", 1.0, 0.5), (3, 0, "comp", 1.0, 0.5), (2, 1, "comp", 1.0, 0.3), (1, 2, "comp", 1.0, 0.3),
    (0, 2, "set_i", 0.5, 0.2), (2, 0, "clear_i", 0.5, 0.3), (1, 3, "set_i", 0.5, 0.1), (3, 1, "clear_i", 0.5, 0.4),
    (0, 1, "set_q", 0.5, 0.3), (1, 0, "clear_q", 0.5, 0.4), (2, 3, "set_q", 0.5, 0.1), (3, 2, "clear_q", 0.5, 0.3),
]


def transition_edges(spark: SparkSession, edges: Sequence[tuple[int, int, str, float, float]] | None = None) -> DataFrame:
    return spark.createDataFrame(list(edges if edges is not None else DEFAULT_EDGES), "a int, b int, op string, cost double, risk double")


def paths(spark: SparkSession, edges: DataFrame, longest: int = 3) -> DataFrame:
    """All simple paths between states with total cost, largest and mean risk; a state reaches itself by the empty path."""
    start = spark.range(4).select(F.col("id").cast("int").alias("source"), F.col("id").cast("int").alias("target"), F.array(F.col("id").cast("int")).alias("states"), F.array().cast("array<string>").alias("ops"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("risk"), F.lit(0.0).alias("risk_sum"), F.lit(0).alias("length"))
    every = last = start
    step = F.broadcast(edges.select("a", "b", "op", F.col("cost").alias("c"), F.col("risk").alias("r")))
    for _ in range(longest):
        grown = last.join(step, F.col("target") == F.col("a")).where(~F.array_contains("states", F.col("b")))
        last = grown.select("source", F.col("b").alias("target"), F.concat("states", F.array("b")).alias("states"), F.concat("ops", F.array("op")).alias("ops"), (F.col("cost") + F.col("c")).alias("cost"), F.greatest("risk", "r").alias("risk"), (F.col("risk_sum") + F.col("r")).alias("risk_sum"), (F.col("length") + 1).alias("length"))
        every = every.unionByName(last)
    return every.withColumn("average_risk", F.when(F.col("length") > 0, F.col("risk_sum") / F.col("length")).otherwise(0.0)).drop("risk_sum")


def best_path(found: DataFrame, by: str = "cost", avoid: Sequence[int] = (), max_length: int | None = None, max_risk: float | None = None) -> DataFrame:
    """The best path of each pair by cost, risk, length or average_risk; ties go to shorter, then smaller operation names."""
    inner = F.slice("states", 2, F.greatest(F.col("length") - 1, F.lit(0)))
    ok = ~F.arrays_overlap(inner, F.array(*map(F.lit, avoid)).cast("array<int>")) if avoid else F.lit(True)
    if max_length is not None:
        ok = ok & (F.col("length") <= max_length)
    if max_risk is not None:
        ok = ok & (F.col("risk") <= max_risk)
    w = Window.partitionBy("source", "target").orderBy(by, "length", F.array_join("ops", ","))
    return found.where(ok).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def transition_matrix(edges: DataFrame) -> DataFrame:
    """Share of each target among a state's edges."""
    counts = edges.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("a", "b", (F.col("n") / F.sum("n").over(Window.partitionBy("a"))).alias("p"))


def reachability(edges: DataFrame) -> DataFrame:
    """(source, target, reachable) for all sixteen pairs of states."""
    found = paths(edges.sparkSession, edges).select("source", "target").distinct().withColumn("reachable", F.lit(True))
    every = edges.sparkSession.range(16).select(F.expr("cast(id div 4 as int)").alias("source"), (F.col("id") % 4).cast("int").alias("target"))
    return every.join(F.broadcast(found), ["source", "target"], "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))


def compare_strategies(found: DataFrame, strategies: Sequence[str] = ("cost", "risk", "length")) -> DataFrame:
    """The best path of each pair by each strategy, one under the other."""
    out = None
    for by in strategies:
        one = best_path(found, by).withColumn("strategy", F.lit(by))
        out = one if out is None else out.unionByName(one)
    return out


def mapper_values(nodes: DataFrame, points: DataFrame, value: Column, id_col: str = "id") -> DataFrame:
    """Mean of a value over each node's members."""
    return nodes.join(points.select(F.col(id_col).alias("member"), value.alias("v")), "member").groupBy("node").agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("n"))


def mapper_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, mean node size, mean degree and components of a mapper graph."""
    each = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    numbered = written(each.select("node", "n", F.monotonically_increasing_id().alias("id")))
    at = lambda x: numbered.select(F.col("node").alias(x), F.col("id").alias(f"id_{x}"))
    links = written(edges.join(at("a"), "a").join(at("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    under = graphs.components(links).agg(F.count(F.lit(1)).alias("under"))
    counts = numbered.agg(F.count(F.lit(1)).alias("nodes"), F.avg("n").alias("mean_size")).join(F.broadcast(links.agg(F.count(F.lit(1)).alias("edges")))).join(F.broadcast(under))
    return counts.select("nodes", "edges", "mean_size", F.coalesce(F.try_divide(2 * F.col("edges"), F.col("nodes")), F.lit(0.0)).alias("mean_degree"), (F.col("nodes") - F.col("under")).alias("components"))
