"""Encoders and threshold learners: fit is an aggregate that gives two numbers, encoding a projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourfold.functions import state as st
from fourfold.operators.preprocess import value
from fourfold.operators.quantiles import at, quantiles, values

#: Thresholds by domain and feature.
DOMAIN_RULES = {
    "trading": {"rsi": (50.0, 70.0), "volume": (1.0, 1.5), "price": (0.0, 0.02)},
    "medical": {"temperature": (37.5, 38.5), "blood_pressure": (140.0, 160.0), "heart_rate": (100.0, 120.0)},
}


def percentile_thresholds(df: DataFrame, c: str, pi: float = 0.5, pq: float = 0.75) -> tuple[float, float]:
    ti, tq = values(df, (value(c), pi), (value(c), pq))
    return ti, tq


def grouped_percentile_encode(df: DataFrame, c: str, by: list[str], pi: float = 0.5, pq: float = 0.75, out: str = "s", least_rows: int = 0) -> DataFrame:
    """Encode by each group's own percentiles; groups of ``least_rows`` rows or fewer take the global ones.

    The thresholds are one row a group and joined back.
    """
    own = quantiles(df, [(value(c), {"__ti": pi, "__tq": pq})], *by, also=[F.count(F.lit(1)).alias("n_rows")])
    if least_rows:
        ti, tq = percentile_thresholds(df, c, pi, pq)
        few = F.col("n_rows") <= least_rows
        own = own.withColumn("__ti", F.when(few, F.lit(ti)).otherwise(F.col("__ti"))).withColumn("__tq", F.when(few, F.lit(tq)).otherwise(F.col("__tq")))
    return df.join(own.drop("n_rows"), by).withColumn(out, st.encode(c, F.col("__ti"), F.col("__tq"))).drop("__ti", "__tq")


def scored_candidates(df: DataFrame, c: str, label: str, candidates: list[float], metric: str = "correlation") -> DataFrame:
    """One row for each candidate threshold with the score of its bit against the label; one pass over the data.

    correlation (signed), abs_correlation, accuracy (label = bit) or mutual_info (nats).
    The rows of a candidate are never formed: counts by label and bucket between
    candidates are summed.
    """
    spark = df.sparkSession
    x = value(c)
    cuts = sorted(set(candidates))
    bucket = sum(((x > F.lit(float(t))).cast("int") for t in cuts), F.lit(0))
    counts = df.select(F.coalesce(bucket, F.lit(0)).alias("b"), F.col(label).cast("double").alias("y")).groupBy("b", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    table = spark.createDataFrame([(k, float(t), cuts.index(t)) for k, t in enumerate(candidates)], "k int, t double, place int")
    both = counts.join(F.broadcast(table)).withColumn("bit", (F.col("b") > F.col("place")).cast("double"))
    cells = both.groupBy("k", "t", "bit", "y").agg(F.sum("n").alias("n"))
    if metric == "mutual_info":
        k, kb, ky = Window.partitionBy("k"), Window.partitionBy("k", "bit"), Window.partitionBy("k", "y")
        term = F.col("n") / F.sum("n").over(k) * F.ln(F.col("n") * F.sum("n").over(k) / (F.sum("n").over(kb) * F.sum("n").over(ky)))
        return cells.withColumn("term", term).groupBy("k", "t").agg(F.sum("term").alias("score"))
    n, bit, y = F.col("n"), F.col("bit"), F.col("y")
    if metric == "accuracy":
        return cells.groupBy("k", "t").agg((F.sum(n * (bit == y).cast("double")) / F.sum(n)).alias("score"))
    top = F.sum(n) * F.sum(n * bit * y) - F.sum(n * bit) * F.sum(n * y)
    under = F.sqrt((F.sum(n) * F.sum(n * bit) - F.pow(F.sum(n * bit), F.lit(2.0))) * (F.sum(n) * F.sum(n * y * y) - F.pow(F.sum(n * y), F.lit(2.0))))
    score = F.coalesce(F.try_divide(top, under), F.lit(0.0))
    return cells.groupBy("k", "t").agg((F.abs(score) if metric == "abs_correlation" else score).alias("score"))


def supervised_thresholds(df: DataFrame, c: str, label: str, metric: str = "mutual_info", n_candidates: int = 20, least_rows: int = 10) -> tuple[float, float]:
    """The best candidate of 20 percentiles (10 to 90) for presence, then for membership among the values above it.

    The first of equal scores wins. With ``least_rows`` values or fewer above the
    first threshold, the second is 1.5 times the first.
    """

    def candidates(rows: DataFrame) -> list[float]:
        steps = [0.1 + 0.8 * k / (n_candidates - 1) for k in range(n_candidates)]
        return [t for t in values(rows, *[(value(c), p) for p in steps]) if t is not None]

    def best(of: list[float]) -> float:
        return scored_candidates(df, c, label, of, metric).orderBy(F.desc(F.round("score", 12)), "k").first()["t"]

    ti = best(candidates(df))
    above = df.where(value(c) > F.lit(ti))
    return (ti, best(candidates(above))) if above.count() > least_rows else (ti, 1.5 * ti)


def optimal_threshold(df: DataFrame, c: str, label: str | None = None, objective: Callable[[Column], Column] | None = None, steps: int = 100) -> float:
    """The candidate of ``steps`` percentiles with the best objective.

    With labels the correlation of the bit; without, the binary entropy of its
    share; or ``objective`` of the bit column, an aggregate. One pass each.
    """
    cuts = values(df, *[(value(c), k / steps) for k in range(1, steps)])
    if objective is None and label is not None:
        return scored_candidates(df, c, label, cuts, "correlation").orderBy(F.desc(F.round("score", 12)), "k").first()["t"]

    def entropy(bit: Column) -> Column:
        p = F.avg(bit)
        return -p * F.ln(p + 1e-10) - (1 - p) * F.ln(1 - p + 1e-10)

    score = objective or entropy
    row = df.agg(*[score((value(c) > F.lit(float(t))).cast("double")).alias(f"s{k}") for k, t in enumerate(cuts)]).first()
    return cuts[max(range(len(cuts)), key=lambda k: (round(row[k] or 0.0, 12), -k))]


def domain_thresholds(df: DataFrame, c: str, domain: str, feature: str | None = None) -> tuple[float, float]:
    """The domain's rule for the feature, or the percentiles 50 and 75."""
    return DOMAIN_RULES.get(domain, {}).get(feature or c) or percentile_thresholds(df, c)


def kmeans_thresholds(df: DataFrame, c: str, seed: int = 42) -> tuple[float, float]:
    """Midpoints between three cluster centres; percentiles 33 and 67 with fewer distinct values."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(value(c).alias("x")).where("x is not null")
    if rows.distinct().limit(3).count() < 3:
        return percentile_thresholds(df, c, 0.33, 0.67)
    model = KMeans(k=3, seed=seed).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
    a, b, d = sorted(float(m[0]) for m in model.clusterCenters())
    return (a + b) / 2, (b + d) / 2


def dual_encode(df: DataFrame, ci: str, cq: str, out: str = "s", p: float = 0.5) -> DataFrame:
    """Presence from one column, membership from another, each against its percentile."""
    row = values(df, (value(ci), p), (value(cq), p))
    above = lambda c, t: F.coalesce(value(c) > F.lit(t), F.lit(False)).cast("tinyint")
    return df.withColumn(out, (above(ci, row[0]) * 2 + above(cq, row[1])).cast("tinyint"))


def multi_encode(df: DataFrame, columns: list[str], how: str = "majority_vote", out: str = "s", weights: list[float] | None = None) -> DataFrame:
    """Bits of every column against its percentiles 50 and 75, joined by majority (strict), all, any or weights."""
    row = values(df, *[(value(c), p) for c in columns for p in (0.5, 0.75)])
    each = [st.encode(c, row[2 * k], row[2 * k + 1]) for k, c in enumerate(columns)]

    def side(bit: Callable[[Column], Column]) -> Column:
        own = [bit(s).cast("double") for s in each]
        if how == "all":
            return F.least(*own) if len(own) > 1 else own[0]
        if how == "any":
            return F.greatest(*own) if len(own) > 1 else own[0]
        w = weights if how == "weighted" and weights else [1.0] * len(own)
        return (sum((x * F.lit(float(k)) for x, k in zip(own, w, strict=True)), F.lit(0.0)) > sum(w) / 2).cast("double")

    return df.withColumn(out, (side(st.i_bit) * 2 + side(st.q_bit)).cast("tinyint"))


def density_regions_encode(df: DataFrame, c: str, regions: int = 5, bins: int = 100, how: str = "own", out: str = "s") -> DataFrame:
    """Encode by percentiles of regions of equal density: values fall into ``regions`` by how many share their bin.

    ``own`` encodes a value by its region's thresholds, ``middle`` all values by
    those of the middle region. Regions are few, and their thresholds one row each.
    """
    lo, hi = df.agg(F.min(value(c)), F.max(value(c))).first()
    width = (hi - lo) / bins if lo is not None and hi > lo else 1.0
    rows = df.withColumn("__bin", F.least(F.lit(bins - 1), F.floor((value(c) - F.lit(lo)) / F.lit(width))))
    counts = rows.groupBy("__bin").agg(F.count(F.lit(1)).alias("__n")).withColumn("__region", F.ntile(regions).over(Window.orderBy("__n", "__bin")))  # one row a bin
    placed = rows.join(F.broadcast(counts), rows["__bin"].eqNullSafe(counts["__bin"])).drop(counts["__bin"])
    marks = {r[0]: (r[1], r[2]) for r in quantiles(placed, [(value(c), {"ti": 0.5, "tq": 0.75})], "__region").collect()}
    if how == "middle" and marks:
        marks = dict.fromkeys(marks, marks[sorted(marks)[len(marks) // 2]])
    ti, tq = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, (a, b) in marks.items():
        ti, tq = F.when(F.col("__region") == k, F.lit(a)).otherwise(ti), F.when(F.col("__region") == k, F.lit(b)).otherwise(tq)
    return placed.withColumn(out, st.encode(c, ti, tq)).drop("__bin", "__n", "__region")


def label_weights(df: DataFrame, columns: list[str], label: str) -> list[float]:
    """Absolute correlation of each column with the label; 0 where one of them is constant."""
    y = F.col(label).cast("double")
    same = lambda c: F.try_divide(F.covar_pop(value(c), y), F.stddev_pop(value(c)) * F.stddev_pop(y))
    row = df.agg(*[F.abs(same(c)) for c in columns]).first()
    return [x if x is not None and x == x else 0.0 for x in row]


def bootstrap(df: DataFrame, c: str, replicates: int = 100, confidence: float = 0.95, pi: float = 0.5, pq: float = 0.75) -> DataFrame:
    """Percentile thresholds over Poisson-weighted replicates: mean, deviation and interval of each.

    Weights come from a hash of value and replicate, so reruns agree; equal
    values of a replicate are weighted together after counting them.
    """
    counts = df.select(value(c).alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    drawn = counts.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = (F.pmod(F.xxhash64("x", "rep"), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    # inverse of the Poisson(1) distribution for single values, a normal approximation for frequent ones
    one = sum(((u > F.lit(t)).cast("int") for t in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)), F.lit(0))
    v = (F.pmod(F.xxhash64("rep", "x", F.lit(1)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    normal = F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * v)
    weight = F.when(F.col("n") == 1, one).otherwise(F.greatest(F.lit(0), F.round(F.col("n") + F.sqrt("n") * normal).cast("int")))
    drawn = drawn.withColumn("w", weight.cast("long")).where("w > 0")
    rep = Window.partitionBy("rep")
    ranked = drawn.withColumn("r", F.sum("w").over(rep.orderBy("x"))).withColumn("all", F.sum("w").over(rep))
    each = ranked.groupBy("rep").agg(*[at(F.col("x"), F.col("r"), F.col("all"), p).alias(k) for k, p in (("ti", pi), ("tq", pq))])
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    parts = [f for k in ("ti", "tq") for f in (F.avg(k).alias(f"{k}_mean"), F.stddev_pop(k).alias(f"{k}_std"), F.percentile(k, F.lit(low)).alias(f"{k}_low"), F.percentile(k, F.lit(high)).alias(f"{k}_high"))]
    return each.agg(*parts, F.count(F.lit(1)).alias("replicates")).withColumn("stability", 1 / (1 + F.col("ti_std") + F.col("tq_std")))


class MultiFeatureThresholds:
    """A threshold learner for each feature; each fits the table's column of its name where there is one."""

    def __init__(self) -> None:
        self.learners: dict[str, Callable[[DataFrame, str], tuple[float, float]]] = {}
        self.thresholds: dict[str, tuple[float, float]] = {}

    def add_feature(self, name: str, learner: Callable[[DataFrame, str], tuple[float, float]] = percentile_thresholds) -> MultiFeatureThresholds:
        self.learners[name] = learner
        return self

    def fit(self, df: DataFrame) -> MultiFeatureThresholds:
        self.thresholds = {n: f(df, n) for n, f in self.learners.items() if n in df.columns}
        return self

    def get_thresholds(self, name: str) -> tuple[float, float]:
        if name not in self.thresholds:
            raise KeyError(f"no thresholds for {name}")
        return self.thresholds[name]

    def get_all_thresholds(self) -> dict[str, tuple[float, float]]:
        return dict(self.thresholds)
