"""Exact percentiles with bounded memory: a sketch brackets each one, and only values inside a bracket are sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The sketch's ranks are off by 1 / ACCURACY of the values at most. Groups of up to SMALL values need no bracket.
ACCURACY, SMALL = 25_000, 100_000

Wanted = Sequence[tuple[Column, dict[str, float]]]


def at(x: Column, running: Column, n: Column, p: Column | float) -> Column:
    """Aggregate: the percentile p, interpolated, of values with inclusive running counts out of n."""
    place = (n - 1) * p
    low, high, top = F.min(F.when(running > F.floor(place), x)), F.min(F.when(running > F.ceil(place), x)), F.max(place)
    return F.when(low == high, low).otherwise((F.ceil(top) - top) * low + (top - F.floor(top)) * high)


def _marks(wanted: Wanted, accuracy: int) -> list[Column]:
    """For each feature the number of values and the sketched ends of its brackets."""
    out = []
    for k, (x, of) in enumerate(wanted):
        x, steps = x.cast("double"), sorted(of.values())
        ends = [max(p - 2 / accuracy, 0.0) for p in steps] + [min(p + 2 / accuracy, 1.0) for p in steps]
        out += [F.count(x).alias(f"__n{k}"), F.percentile_approx(F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x), ends, accuracy).alias(f"__e{k}")]
    return out


def _brackets(k: int, steps: list[float], accuracy: int) -> list[Column]:
    """Arrays of the brackets' ends; open ones start at -inf and end at NaN, the greatest value."""
    ends = F.col(f"__e{k}")
    low = [F.get(ends, F.lit(j)) if p - 2 / accuracy > 0 else F.lit(float("-inf")) for j, p in enumerate(steps)]
    high = [F.get(ends, F.lit(len(steps) + j)) if p + 2 / accuracy < 1 else F.lit(float("nan")) for j, p in enumerate(steps)]
    return [F.array(*low).alias(f"__l{k}"), F.array(*[F.when(h == float("inf"), F.lit(float("nan"))).otherwise(h) for h in high]).alias(f"__h{k}")]


def _items(k: int, m: int, small: int) -> Column:
    """A row's part in feature k: itself (j = -2) in a small group; else how many brackets start
    at or before it (j = -1), and itself for each bracket it lies in."""
    x, n, low, high = (F.col(f"__{c}{k}") for c in "xnlh")
    make = lambda j, v: F.struct(F.lit(k).alias("f"), j.alias("j"), v.alias("v"), n.alias("n"))
    begun = F.size(F.filter(low, lambda e: e <= x)).cast("double")
    inside = F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: (F.get(low, j) <= x) & (x <= F.get(high, j)))
    large = F.concat(F.array(make(F.lit(-1), begun)), F.transform(inside, lambda j: make(j, x)))
    return F.when(x.isNull(), None).when(n <= small, F.array(make(F.lit(-2), x))).otherwise(large)


def quantiles(df: DataFrame, wanted: Wanted, *by: str, also: Sequence[Column] = (), accuracy: int = ACCURACY, small: int = SMALL) -> DataFrame:
    """Interpolated percentiles of each group: a column for each name in ``wanted``, pairs of a column and {name: p}.

    ``F.percentile`` keeps a counter for every distinct value of a group in one
    buffer, which is right for up to ``small`` values. Beyond them a first aggregate, of bounded size, sketches where each
    percentile lies; a second counts, map-side first, how many values lie below
    each bracket and how often each value inside occurs. The brackets hold some
    ``6 / accuracy`` of a group, which a window sorts (and may spill). The result
    is the exact one; a sketch outside its error bound raises instead.

    ``also`` are further aggregates of the same rows, named, which share the first
    pass. Nulls are no values; a group without values has nulls, and null keys
    are a group. NaN is the greatest value, -0.0 becomes 0.0. Without ``by`` there is one row, for
    an empty table too. Ties and repeated rows count as often as they occur.
    """
    steps = [sorted(of.items(), key=lambda x: x[1]) for _, of in wanted]
    first = [*also, *_marks(wanted, accuracy)]
    key = F.struct(*map(F.col, by)) if by else F.lit(0)
    sketch = df.groupBy(key.alias("__g")).agg(*first) if by else df.agg(*first).withColumn("__g", key)
    kept = [c for c in sketch.columns if not c.startswith("__")]
    marks = sketch.select("__g", *[f"__n{k}" for k in range(len(steps))], *[e for k, own in enumerate(steps) for e in _brackets(k, [p for _, p in own], accuracy)])
    rows = df.select(key.alias("__g"), *[x.cast("double").alias(f"__x{k}") for k, (x, _) in enumerate(wanted)])
    rows = rows.join(marks if by else F.broadcast(marks), "__g")
    none = F.array().cast("array<struct<f:int,j:int,v:double,n:bigint>>")
    items = F.concat(*[F.coalesce(_items(k, len(own), small), none) for k, own in enumerate(steps)])
    every = rows.select("__g", F.explode(items).alias("i")).groupBy("__g", "i.f", "i.j", "i.v", "i.n").agg(F.count(F.lit(1)).alias("c"))
    of_small = [F.percentile(F.when(F.col("f") == k, F.col("v")), F.array(*[F.lit(float(p)) for _, p in own]), F.col("c")).alias(f"__s{k}") for k, own in enumerate(steps)]
    few = every.where("j = -2").groupBy("__g").agg(*of_small)
    counts = every.where("j > -2")
    # a row that so many brackets had begun by is below all later ones
    n_steps = F.get(F.array(*[F.lit(len(own)) for own in steps]), F.col("f"))
    begun = F.col("v").cast("int")
    later = F.when(begun < n_steps, F.transform(F.sequence(begun, F.greatest(n_steps - 1, begun)), lambda j: F.struct(j.alias("j"), F.lit(None).cast("double").alias("v"))))
    spread = counts.select("__g", "f", "n", "c", F.explode(F.when(F.col("j") < 0, later).otherwise(F.array(F.struct("j", "v")))).alias("s")).select("__g", "f", "n", "c", "s.j", "s.v")
    w = Window.partitionBy("__g", "f", "j").orderBy(F.asc_nulls_first("v"))
    p = F.get(F.get(F.array(*[F.array(*[F.lit(float(q)) for _, q in own]) for own in steps]), F.col("f")), F.col("j"))
    ranked = spread.withColumn("r", F.sum("c").over(w)).withColumn("p", p)
    place = (F.col("n") - 1) * F.col("p")
    missed = F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("r"))), F.lit(0)) > F.max(F.floor(place))
    missed = missed | (F.max("r") <= F.max(F.ceil(place)))
    picked = ranked.groupBy("__g", "f", "j").agg(missed.alias("missed"), at(F.col("v"), F.col("r"), F.col("n"), F.col("p")).alias("q"))
    q = F.when(F.col("missed"), F.raise_error(F.lit("a percentile lies outside its sketched bracket")).cast("double")).otherwise(F.col("q"))
    wide = picked.groupBy("__g").agg(*[F.max(F.when((F.col("f") == k) & (F.col("j") == j), q)).alias(name) for k, own in enumerate(steps) for j, (name, _) in enumerate(own)])
    out = sketch.select("__g", *kept).join(wide, "__g", "left").join(few, "__g", "left")
    points = [F.coalesce(F.col(name), F.get(F.col(f"__s{k}"), F.lit(j))).alias(name) for k, own in enumerate(steps) for j, (name, _) in enumerate(own)]
    return out.select(*[F.col("__g").getField(c).alias(c) for c in by], *kept, *points).select(*by, *kept, *[name for _, of in wanted for name in of])


def values(df: DataFrame, *wanted: tuple[Column, float], also: Sequence[Column] = ()) -> list[float | None]:
    """Percentiles of the whole table, in the order asked for, then the further aggregates."""
    by_column: dict[str, tuple[Column, dict[str, float]]] = {}
    for k, (x, p) in enumerate(wanted):
        by_column.setdefault(str(x), (x, {}))[1][f"q{k}"] = p
    named = [x.alias(f"a{k}") for k, x in enumerate(also)]
    if not wanted:
        return list(df.agg(*named).first()) if named else []
    pairs = list(by_column.values())
    first = df.agg(*named, *[F.count(x.cast("double")) for x, _ in pairs]).first()
    if max(first[len(named) :]) <= SMALL:
        steps = [sorted(of.items(), key=lambda x: x[1]) for _, of in pairs]
        got = df.agg(*[F.percentile(x.cast("double"), F.array(*[F.lit(float(p)) for _, p in own])) for (x, _), own in zip(pairs, steps, strict=True)]).first()
        row = {name: None if got[k] is None else got[k][j] for k, own in enumerate(steps) for j, (name, _) in enumerate(own)}
    else:
        row = quantiles(df, pairs).first()
    return [row[f"q{k}"] for k in range(len(wanted))] + list(first[: len(named)])
