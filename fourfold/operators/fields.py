"""State fields: long tables (field_id, x, y[, z], s); neighbourhoods are exploded offsets and one aggregate.

A cell's row is sent to all cells that it neighbours, and each cell sums what
it gets: one shuffle by coordinates, no join with the field itself. Boundary
rules rewrite the coordinates that fall outside.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourfold.functions import state as st
from fourfold.operators.quantiles import values

KEY = ("field_id", "x", "y")
BOUNDARIES = ("zero", "periodic", "reflect", "extend", "constant")
#: Votes that tie go to the first in this order of codes: empty, delta, phi, psi.
TIE = (0, 2, 1, 3)


def grid(spark: SparkSession, width: int, height: int, s: Column, field_id: int = 0) -> DataFrame:
    """A field from an expression over x and y."""
    cells = spark.range(width * height).select(F.lit(field_id).alias("field_id"), (F.col("id") % width).cast("int").alias("x"), F.expr(f"cast(id div {width} as int)").alias("y"))
    return cells.withColumn("s", s.cast("tinyint"))


def grid3(spark: SparkSession, width: int, height: int, depth: int, s: Column, field_id: int = 0) -> DataFrame:
    cells = spark.range(width * height * depth).select(F.lit(field_id).alias("field_id"), (F.col("id") % width).cast("int").alias("x"), F.expr(f"cast(id div {width} % {height} as int)").alias("y"), F.expr(f"cast(id div {width * height} as int)").alias("z"))
    return cells.withColumn("s", s.cast("tinyint"))


def checkerboard(size: int = 1) -> Column:
    return F.when((F.floor(F.col("x") / size) + F.floor(F.col("y") / size)) % 2 == 0, st.lit(3)).otherwise(st.lit(0))


def gradient_pattern(width: int) -> Column:
    return F.least(F.lit(3), F.floor(F.col("x") * 4 / width)).cast("tinyint")


def noise(seed: int = 0) -> Column:
    """Uniform states by a hash of the place."""
    return F.pmod(F.xxhash64("x", "y", F.lit(seed)), F.lit(4)).cast("tinyint")


def sine(frequency: float = 0.1) -> Column:
    v = F.sin(F.col("x") * frequency) + F.sin(F.col("y") * frequency)
    return ((v > 0).cast("tinyint") * 2 + (v > 1).cast("tinyint")).cast("tinyint")


def mandelbrot(width: int, height: int, iterations: int = 30) -> Column:
    """psi inside, delta where the escape is late, phi where it is early, empty where it is at once."""
    cr, ci = F.col("x") * 3.0 / width - 2.0, F.col("y") * 2.0 / height - 1.0
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("n"))

    def step(z: Column, _: Column) -> Column:
        out = z["a"] * z["a"] + z["b"] * z["b"] > 4.0
        return F.struct(F.when(out, z["a"]).otherwise(z["a"] * z["a"] - z["b"] * z["b"] + cr).alias("a"), F.when(out, z["b"]).otherwise(2 * z["a"] * z["b"] + ci).alias("b"), F.when(out, z["n"]).otherwise(z["n"] + 1).alias("n"))

    n = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step, lambda z: z["n"])
    return F.when(n >= iterations, st.lit(3)).when(n > iterations / 4, st.lit(2)).when(n > 2, st.lit(1)).otherwise(st.lit(0))


def from_values(df: DataFrame, c: str, method: str = "percentile", out: str = "s") -> DataFrame:
    """Cells with numbers into states: thresholds median and 75 % (percentile), or mean and mean + half a deviation."""
    if method in {"percentile", "threshold"}:
        row = values(df, (F.col(c), 0.5), (F.col(c), 0.75))
        return df.withColumn(out, st.encode(c, row[0], row[1]))
    row = df.agg(F.avg(c), F.stddev_pop(c)).first()
    return df.withColumn(out, st.encode(c, row[0], row[0] + 0.5 * row[1]))


def from_image(df: DataFrame, c: str, threshold: float = 0.5, out: str = "s") -> DataFrame:
    return df.withColumn(out, st.encode(c, threshold, 1.5 * threshold))


def to_image(df: DataFrame, mode: str = "i") -> DataFrame:
    value = {"i": st.i_bit("s"), "q": st.q_bit("s"), "both": F.col("s") / 3.0, "psi": (F.col("s") == 3)}[mode]
    return df.withColumn("pixel", value.cast("double"))


def sizes(df: DataFrame) -> DataFrame:
    """Width and height of each field."""
    return df.groupBy("field_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def region(df: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """A half-open rectangle with coordinates from 0."""
    return df.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)).withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)


def paste(df: DataFrame, part: DataFrame, x0: int, y0: int) -> DataFrame:
    moved = part.select("field_id", (F.col("x") + x0).alias("x"), (F.col("y") + y0).alias("y"), F.col("s").alias("__new"))
    return df.join(moved, list(KEY), "left").withColumn("s", F.coalesce("__new", "s")).drop("__new")


def plane(df: DataFrame, axis: str, index: int) -> DataFrame:
    """A slice of a volume as a field; axis x gives (z, y), y gives (x, z), z gives (x, y)."""
    keep = {"x": ("z", "y"), "y": ("x", "z"), "z": ("x", "y")}[axis]
    return df.where(F.col(axis) == index).select("field_id", F.col(keep[0]).alias("x"), F.col(keep[1]).alias("y"), "s")


def square(radius: int, center: bool = True) -> list[tuple[int, int]]:
    side = range(-radius, radius + 1)
    return [(dx, dy) for dy in side for dx in side if center or dx or dy]


def cross() -> list[tuple[int, int]]:
    return [(0, -1), (-1, 0), (1, 0), (0, 1)]


def neighbourhood(df: DataFrame, offsets: Sequence[tuple[int, int]], boundary: str | None = None, weights: Sequence[float] | None = None) -> DataFrame:
    """For each cell its state ``s`` and the counts n0..n3 of neighbours by state (weights w0..w3 with ``weights``).

    Without a boundary rule (or ``constant``), neighbours outside don't count;
    zero adds empty ones, periodic wraps, extend repeats the edge, and reflect
    mirrors it (-1 reads 1, width reads width - 1).
    """
    where = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for (dx, dy), w in zip(offsets, weights or [1.0] * len(offsets), strict=True)]
    if boundary in {None, "constant", "zero"}:
        sent = df.select(*KEY, "s", F.explode(F.array(*where)).alias("o"))
        sent = sent.select("field_id", (F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), F.col("s").alias("n"), F.col("o.w").alias("w"), F.lit(None).cast("tinyint").alias("own"))
    else:
        size = F.broadcast(sizes(df))  # one row a field
        asked = df.select(*KEY, F.explode(F.array(*where)).alias("o")).join(size, "field_id")
        rule = {
            "periodic": lambda v, n: F.pmod(v, n),
            "extend": lambda v, n: F.least(F.greatest(v, F.lit(0)), n - 1),
            "reflect": lambda v, n: F.when(v < 0, -v).when(v >= n, 2 * n - v - 1).otherwise(v),
        }[boundary]
        asked = asked.select("field_id", F.col("x").alias("cx"), F.col("y").alias("cy"), rule(F.col("x") + F.col("o.dx"), F.col("width")).alias("x"), rule(F.col("y") + F.col("o.dy"), F.col("height")).alias("y"), F.col("o.w").alias("w"))
        got = asked.join(df.select(*KEY, F.col("s").alias("n")), list(KEY))
        sent = got.select("field_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "n", "w", F.lit(None).cast("tinyint").alias("own"))
    mine = df.select(*KEY, F.lit(None).cast("tinyint").alias("n"), F.lit(0.0).alias("w"), F.col("s").alias("own"))
    counts = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(4)] + [F.sum(F.when(F.col("n") == k, F.col("w")).otherwise(0.0)).alias(f"w{k}") for k in range(4)]
    out = sent.unionByName(mine).groupBy(*KEY).agg(F.max("own").alias("s"), *counts).where("s is not null")
    if boundary == "zero":
        missing = len(offsets) - sum((F.col(f"n{k}") for k in range(4)), F.lit(0))
        out = out.withColumn("n0", F.col("n0") + missing)
    return out


def majority(prefix: str = "n", extra: Column | None = None) -> Column:
    """The most frequent state of the counts; ``extra`` adds one vote for a state."""
    best = None
    for rank, k in enumerate(TIE):
        n = F.col(f"{prefix}{k}") + ((extra == k).cast("int") if extra is not None else F.lit(0))
        one = F.struct(n.cast("double").alias("n"), F.lit(-rank).alias("r"), st.lit(k).alias("s"))
        best = one if best is None else F.greatest(best, one)
    return best["s"]


#: Footprints of named kernels.
KERNELS = {"box": square(1), "sobel": square(1), "gaussian": square(2)}


def convolve(df: DataFrame, kernel: str | Sequence[tuple[int, int]] = "box", boundary: str = "zero") -> DataFrame:
    """Majority over a kernel's footprint, the cell itself included."""
    if boundary not in BOUNDARIES:
        raise ValueError(f"unknown boundary {boundary}")
    offsets = KERNELS[kernel] if isinstance(kernel, str) else kernel
    near = neighbourhood(df, offsets, boundary)
    any_of = F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3") > 0
    return near.select(*KEY, F.when(any_of, majority()).otherwise(F.col("s")).alias("s"))


def around(df: DataFrame, radius: int, exclude: str = "equal") -> DataFrame:
    """Neighbour counts without the center cell; ``equal`` also leaves out all neighbours equal to it."""
    near = neighbourhood(df, square(radius, center=False))
    if exclude == "equal":
        near = near.withColumns({f"n{k}": F.when(F.col("s") == k, F.lit(0)).otherwise(F.col(f"n{k}")) for k in range(4)})
    return near


def dilate(df: DataFrame, radius: int = 1) -> DataFrame:
    """psi where the cell or any neighbour is psi."""
    return neighbourhood(df, square(radius)).select(*KEY, F.when(F.col("n3") > 0, st.lit(3)).otherwise(F.col("s")).alias("s"))


def erode(df: DataFrame, radius: int = 1) -> DataFrame:
    """psi with a neighbour that isn't psi becomes delta."""
    near = neighbourhood(df, square(radius))
    other = F.col("n0") + F.col("n1") + F.col("n2") > 0
    return near.select(*KEY, F.when((F.col("s") == 3) & other, st.lit(2)).otherwise(F.col("s")).alias("s"))


def boundaries(df: DataFrame) -> DataFrame:
    """psi where any neighbour differs, else empty."""
    near = around(df, 1)
    differs = F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3") > 0
    return near.select(*KEY, F.when(differs, st.lit(3)).otherwise(st.lit(0)).alias("s"))


def smooth(df: DataFrame, radius: int = 1) -> DataFrame:
    """Majority of the neighbourhood with one more vote for the cell."""
    near = neighbourhood(df, square(radius))
    return near.select(*KEY, majority(extra=F.col("s")).alias("s"))


def automaton(df: DataFrame, rule: Callable[[DataFrame], Column], steps: int = 1, exclude: str = "cell") -> DataFrame:
    """Apply a rule over s and n0..n3 several times; every few steps the field is written and read again."""
    from fourfold.sources.tables import written

    for k in range(steps):
        near = around(df, 1, exclude)
        df = near.select(*KEY, rule(near).cast("tinyint").alias("s"))
        if k % 4 == 3 and k < steps - 1:
            df = written(df)
    return df


def life(near: DataFrame) -> Column:
    return F.when((near["n3"] == 3) | ((near["s"] == 3) & (near["n3"] == 2)), st.lit(3)).otherwise(st.lit(0))


def gradient(df: DataFrame) -> DataFrame:
    """Magnitude of each bit's gradient: central differences inside, one-sided at edges."""

    def along(v: Column, axis: str, other: str) -> Column:
        w = Window.partitionBy("field_id", other).orderBy(axis)
        a, b = F.lag(v).over(w), F.lead(v).over(w)
        return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b - v).when(b.isNull(), v - a).otherwise((b - a) / 2)

    df = df.withColumn("__i", st.i_bit("s").cast("double")).withColumn("__q", st.q_bit("s").cast("double"))
    size = lambda c: F.sqrt(F.pow(along(F.col(c), "x", "y"), F.lit(2.0)) + F.pow(along(F.col(c), "y", "x"), F.lit(2.0)))
    return df.select(*KEY, size("__i").alias("grad_i"), size("__q").alias("grad_q"))


def reduce(df: DataFrame, how: str = "overlay", initial: int = 0) -> DataFrame:
    """One state a field: OR or AND of all cells and the initial state."""
    agg = F.bit_or("s").bitwiseOR(st.lit(initial)) if how == "overlay" else F.bit_and("s").bitwiseAND(st.lit(initial))
    return df.groupBy("field_id").agg(agg.alias("s"))


def distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hamming share of bits, euclidean distance of bits, and share of equal cells of two fields."""
    pairs = a.select(*KEY, F.col("s").alias("a")).join(b.select(*KEY, F.col("s").alias("b")), list(KEY))
    d = st.distance("a", "b")
    return pairs.groupBy("field_id").agg((F.avg(d) / 2).alias("hamming"), F.sqrt(F.sum(d).cast("double")).alias("euclidean"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("similarity"))


def match(df: DataFrame, template: list[tuple[int, int, int]], threshold: float = 0.8) -> DataFrame:
    """Places where at least ``threshold`` of a template's cells (dx, dy, state) agree; the template lies inside."""
    w, h = max(t[0] for t in template) + 1, max(t[1] for t in template) + 1
    cells = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), st.lit(s).alias("want")) for x, y, s in template])
    sent = df.select(*KEY, "s", F.explode(cells).alias("o")).groupBy("field_id", (F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y")).agg((F.sum((F.col("s") == F.col("o.want")).cast("double")) / len(template)).alias("similarity"))
    inside = sent.join(F.broadcast(sizes(df)), "field_id").where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + w <= F.col("width")) & (F.col("y") + h <= F.col("height")))
    return inside.where(F.col("similarity") >= threshold).drop("width", "height")


def _cell_id(*coordinates: str) -> Column:
    """A long that orders cells by field, then last to first coordinate; 21 bits each in a plane, 18 in a volume."""
    bits = 21 if len(coordinates) == 2 else 18
    inside = [F.col(c).between(0, (1 << bits) - 1) for c in coordinates] + [F.col("field_id").between(0, (1 << 63 - bits * len(coordinates)) - 1)]
    packed = F.col("field_id").cast("long") * (1 << bits * len(coordinates))
    for k, c in enumerate(coordinates):
        packed = packed + F.col(c).cast("long") * (1 << bits * k)
    ok = inside[0]
    for x in inside[1:]:
        ok = ok & x
    return F.when(ok, packed).otherwise(F.raise_error(F.lit("a field's number or coordinate is out of range")).cast("long"))


def _components(cells: DataFrame, coordinates: tuple[str, ...], offsets: list[tuple[int, ...]]) -> DataFrame:
    """Cells with ``label``, the rank of their component's first cell in its field."""
    from fourfold.operators import graphs
    from fourfold.sources.tables import written

    own = written(cells.select("field_id", *coordinates, _cell_id(*coordinates).alias("id")))
    where = F.array(*[F.struct(*[F.lit(o).alias(c) for o, c in zip(offset, coordinates, strict=True)]) for offset in offsets])
    sent = own.select(F.col("id").alias("a"), "field_id", *coordinates, F.explode(where).alias("o")).select("a", "field_id", *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in coordinates])
    links = sent.join(own.withColumnRenamed("id", "b"), ["field_id", *coordinates]).select("a", "b")
    joined = own.join(graphs.components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("label", "id")).drop("label", "id")
    joined = written(joined)
    ranks = joined.select("field_id", "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy("field_id").orderBy("root")))
    return joined.join(ranks, ["field_id", "root"]).select("field_id", *coordinates, "label")


def components(df: DataFrame, target: int | None = 3, full: bool = False) -> DataFrame:
    """Label of each target cell's component: 4 or 8 neighbours; target None joins all cells that aren't empty.

    Labels are ranks of the components' first cells in row order; only the
    roots of a field's components are ranked together.
    """
    cells = df.where(F.col("s") == target if target is not None else F.col("s") != 0)
    return _components(cells, ("x", "y"), [(1, 0), (0, 1), *([(1, 1), (-1, 1)] if full else [])])


VOLUME = ("field_id", "x", "y", "z")


def components3(df: DataFrame, target: int | None = 3, connectivity: int = 1) -> DataFrame:
    """Components of a volume's target cells by 6 (1), 18 (2) or 26 (3) neighbours; labels rank their first cells."""
    cells = df.where(F.col("s") == target if target is not None else F.col("s") != 0)
    side = (-1, 0, 1)
    half = [(dx, dy, dz) for dx in side for dy in side for dz in side if (dz, dy, dx) > (0, 0, 0) and abs(dx) + abs(dy) + abs(dz) <= connectivity]
    return _components(cells, ("x", "y", "z"), half)


def _moved(axis: str, boundary: str) -> Column:
    """A coordinate that may lie outside, brought back inside by a boundary rule."""
    x, n = F.col(axis), F.col(f"n_{axis}")
    if boundary == "periodic":
        return F.pmod(x, n)
    if boundary == "extend":
        return F.least(F.greatest(x, F.lit(0)), n - 1)
    if boundary == "reflect":
        return F.when(x < 0, -x).when(x >= n, 2 * n - 1 - x).otherwise(x)
    return x


def convolve3(df: DataFrame, weights: dict[tuple[int, int, int], float] | None = None, boundary: str = "zero") -> DataFrame:
    """The state with the largest sum of weights around each cell of a volume; ties go by ``TIE``.

    Without ``weights`` all 27 cells count alike. Outside a volume lie empty
    cells (zero) or its own ones (periodic, reflect, extend); constant leaves
    out what lies outside. A cell looks at its neighbours' places once moved, by
    one join on coordinates.
    """
    if boundary not in BOUNDARIES:
        raise ValueError(f"unknown boundary: {boundary}")
    side = (-1, 0, 1)
    weights = weights or {(dx, dy, dz): 1.0 for dx in side for dy in side for dz in side}
    offsets = F.array(*[F.struct(*[F.lit(o).alias(c) for o, c in zip(k, "xyz", strict=True)], F.lit(float(w)).alias("w")) for k, w in weights.items()])
    size = df.groupBy("field_id").agg(*[(F.max(c) + 1).alias(f"n_{c}") for c in "xyz"])
    asked = df.select(*VOLUME).join(F.broadcast(size), "field_id").withColumn("o", F.explode(offsets))
    asked = asked.select("field_id", *[F.col(c).alias(f"to_{c}") for c in "xyz"], *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"], *[f"n_{c}" for c in "xyz"], "o.w")
    asked = asked.select("field_id", "w", *[f"to_{c}" for c in "xyz"], *[_moved(c, boundary).cast("int").alias(c) for c in "xyz"])
    found = asked.join(df.select(*VOLUME, "s"), list(VOLUME), "left" if boundary == "zero" else "inner")
    s = F.coalesce("s", st.lit(0))
    sums = found.groupBy("field_id", *[f"to_{c}" for c in "xyz"]).agg(*[F.sum(F.when(s == k, F.col("w")).otherwise(0.0)).alias(f"n{k}") for k in range(4)])
    return sums.select("field_id", *[F.col(f"to_{c}").alias(c) for c in "xyz"], majority().cast("tinyint").alias("s"))


def gaussian3(size: int = 3, sigma: float = 1.0) -> dict[tuple[int, int, int], float]:
    """Weights of a cube of odd ``size``, summing to 1."""
    r = range(-(size // 2), size // 2 + 1)
    raw = {(x, y, z): math.exp(-(x * x + y * y + z * z) / (2 * sigma * sigma)) for x in r for y in r for z in r}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def betti3(df: DataFrame, target: int = 3) -> DataFrame:
    """Betti numbers of a volume's target cells as unit cubes that touch by faces, for each field.

    b0 counts components by 6 neighbours, b2 the holes: components of the rest
    by 26 neighbours that don't reach the volume's border. b1 follows from the
    Euler number of cells, faces, edges and corners between them:
    b1 = b0 + b2 - euler.
    """
    own = df.where(F.col("s") == target).select(*VOLUME)
    parts = []
    for sign, shifts in ((1, [(0, 0, 0)]), (-1, [(1, 0, 0), (0, 1, 0), (0, 0, 1)]), (1, [(1, 1, 0), (1, 0, 1), (0, 1, 1)]), (-1, [(1, 1, 1)])):
        for dx, dy, dz in shifts:
            cells = [(a, b, c) for a in range(dx + 1) for b in range(dy + 1) for c in range(dz + 1)]
            sent = own.select("field_id", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in cells])).alias("o"), *"xyz")
            met = sent.groupBy("field_id", (F.col("x") - F.col("o.a")).alias("x"), (F.col("y") - F.col("o.b")).alias("y"), (F.col("z") - F.col("o.c")).alias("z")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(met.where(F.col("n") == len(cells)).select("field_id", F.lit(sign).alias("k")))
    euler = parts[0]
    for p in parts[1:]:
        euler = euler.unionByName(p)
    chi = euler.groupBy("field_id").agg(F.sum("k").alias("euler"))
    b0 = components3(df, target).groupBy("field_id").agg(F.max("label").alias("b0"))
    rest = df.withColumn("s", (F.col("s") != target).cast("tinyint"))
    size = df.groupBy("field_id").agg(*[(F.max(c)).alias(f"n_{c}") for c in "xyz"])
    border = F.lit(False)
    for c in "xyz":
        border = border | (F.col(c) == 0) | (F.col(c) == F.col(f"n_{c}"))
    holes = components3(rest, 1, 3).join(F.broadcast(size), "field_id").groupBy("field_id", "label").agg(F.bool_or(border).alias("open")).groupBy("field_id").agg(F.count_if(~F.col("open")).alias("b2"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = size.select("field_id").join(chi, "field_id", "left").join(b0, "field_id", "left").join(holes, "field_id", "left")
    return out.select("field_id", zero("b0").alias("b0"), (zero("b0") + zero("b2") - zero("euler")).alias("b1"), zero("b2").alias("b2"), zero("euler").alias("euler"))


def euler(df: DataFrame, target: int = 3) -> DataFrame:
    """Cells, edges and faces of the target set (4-neighbours) and their alternating sum, for each field."""
    own = df.where(F.col("s") == target)
    w = Window.partitionBy("field_id", "y").orderBy("x")
    right = (F.lead("x").over(w) == F.col("x") + 1).cast("long")
    rows = own.withColumn("__r", F.coalesce(right, F.lit(0)))
    v = Window.partitionBy("field_id", "x").orderBy("y")
    below = F.coalesce((F.lead("y").over(v) == F.col("y") + 1).cast("long"), F.lit(0))
    rows = rows.withColumn("__b", below).withColumn("__f", F.when((F.col("__b") == 1) & (F.col("__r") == 1), F.coalesce(F.lead("__r").over(v), F.lit(0))).otherwise(0))
    return rows.groupBy("field_id").agg(F.count(F.lit(1)).alias("v"), F.sum("__r").alias("e_x"), F.sum("__b").alias("e_y"), F.sum("__f").alias("f")).select("field_id", "v", (F.col("e_x") + F.col("e_y")).alias("e"), "f", (F.col("v") - F.col("e_x") - F.col("e_y") + F.col("f")).alias("euler"))
