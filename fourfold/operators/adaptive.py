"""Thresholds that follow a stream: all-time moments, distribution shape, several scales, regimes.

The trackers are plain classes with a ``step``; batch operators run them over
each key's ordered rows, streaming ones keep them as state (see ``streaming``).
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourfold.operators.quantiles import quantiles
from fourfold.operators.series import numbered, scan
from fourfold.sources.tables import written


class MomentTracker:
    """All-time mean and deviation (ddof 1); thresholds follow mean and mean + half a deviation from 0 at rate alpha.

    The first value leaves both thresholds at 0.
    """

    def __init__(self, alpha: float = 0.01):
        self.alpha = alpha
        self.n, self.mean, self.m2, self.ti, self.tq = 0, 0.0, 0.0, 0.0, 0.0

    def step(self, x: float) -> MomentTracker:
        self.n += 1
        delta = x - self.mean
        self.mean += delta / self.n
        self.m2 += delta * (x - self.mean)
        if self.n > 1:
            std = (self.m2 / (self.n - 1)) ** 0.5
            self.ti += self.alpha * (self.mean - self.ti)
            self.tq += self.alpha * (self.mean + 0.5 * std - self.tq)
        return self

    @property
    def std(self) -> float:
        return (self.m2 / (self.n - 1)) ** 0.5 if self.n > 1 else 0.0


def code(x: float, ti: float, tq: float) -> int:
    """NaN is empty."""
    return 2 * int(x > ti) + int(x > tq)


def density(data: np.ndarray, points: int = 1000, factor: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian kernel density over the data's range; the width is ``factor`` deviations (ddof 1).

    More than 200 values fall to their nearest grid points, where powers of what
    they are off by are summed; the kernel's Taylor series over these, up to the
    rounding of doubles, is the density.
    """
    grid = np.linspace(data.min(), data.max(), points)
    width = factor * data.std(ddof=1)
    if not width > 0:
        return grid, np.zeros(points)
    step = (grid[-1] - grid[0]) / (points - 1) / width
    if len(data) > 200 and 0 < step <= 1:
        return grid, _series(data, grid[0], width, step, points) / (len(data) * width * np.sqrt(2 * np.pi))
    total = np.zeros(points)
    for part in np.array_split(data, max(1, len(data) // 2000)):
        total += np.exp(-0.5 * ((grid[:, None] - part[None, :]) / width) ** 2).sum(axis=1)
    return grid, total / (len(data) * width * np.sqrt(2 * np.pi))


def _series(data: np.ndarray, low: float, width: float, step: float, points: int) -> np.ndarray:
    at = (data - low) / width
    place = np.clip(np.rint(at / step), 0, points - 1).astype(np.int64)
    off = at - place * step
    reach = min(points - 1, int(np.ceil(9 / step)))
    t = np.arange(-reach, reach + 1) * step
    total = np.zeros(points)
    part, kernel = np.exp(-0.5 * off**2), np.exp(-0.5 * t**2)
    k, most = 0, 1.0
    while most > 1e-17:  # the largest that the next term can be
        total += np.convolve(np.bincount(place, weights=part, minlength=points), kernel)[reach : reach + points]
        k += 1
        part *= off / k
        kernel = kernel * t
        most = np.exp(k * np.log(step / 2) + 0.5 * k * (np.log(k) - 1) - sum(np.log(np.arange(1, k + 1))))
    return np.maximum(total, 0.0)


def peaks(y: np.ndarray, prominence: float, apart: int) -> list[int]:
    """Local maxima, the higher first, ``apart`` positions from each other, that stand out by ``prominence``."""
    tops, k = [], 1
    v = y.tolist()
    while k < len(v) - 1:
        if v[k] > v[k - 1]:
            end = k
            while end < len(v) - 1 and v[end + 1] == v[k]:
                end += 1
            if end < len(v) - 1 and v[end + 1] < v[k]:
                tops.append((k + end) // 2)
            k = end
        k += 1
    kept: list[int] = []
    for t in sorted(tops, key=lambda t: -y[t]):
        if all(abs(t - o) >= apart for o in kept):
            kept.append(t)

    def stands(t: int) -> float:
        low = []
        for side in (y[:t][::-1], y[t + 1 :]):
            higher = np.flatnonzero(side > y[t])
            low.append(side[: higher[0] if len(higher) else len(side)].min(initial=y[t]))
        return y[t] - max(low)

    return sorted(t for t in kept if stands(t) >= prominence)


def shape(data: np.ndarray) -> dict:
    """Modes, skewness, excess kurtosis, gaps, density variance and components of a sample; defaults under 10 values."""
    if len(data) < 10:
        return {"modality": 1, "maxima": [], "skew": 0.0, "kurt": 0.0, "gaps": [], "density_variance": 0.0, "components": 1}
    mean, std = data.mean(), data.std()
    z = (data - mean) / std if std > 0 else np.zeros(len(data))
    ordered = np.sort(data)
    steps = np.diff(ordered)
    typical = np.median(steps)
    wide = np.flatnonzero(steps > 3 * typical) if typical > 0 else np.zeros(0, int)
    gaps = list(zip(ordered[wide].tolist(), ordered[wide + 1].tolist(), strict=True))
    grid, y = density(data)
    tops = peaks(y, 0.05 * y.max(), len(grid) // 20) if y.max() > 0 else []
    high = y > 0.1 * y.max() if y.max() > 0 else np.ones(1, bool)
    components = int((np.diff(np.concatenate([[0], high.astype(int)])) == 1).sum())
    k = min(10, len(data) // 10)
    variance = 0.0
    if k >= 2:
        # the k nearest of a sorted value, itself among them, lie side by side
        n = len(ordered)
        far = np.full(n, np.inf)
        for left in range(k):
            own = slice(left, n - (k - 1 - left))
            far[own] = np.fmin(far[own], np.maximum(ordered[own] - ordered[: n - k + 1], ordered[k - 1 :] - ordered[own]))
        with np.errstate(divide="ignore"):
            d = np.where(far > 0, k / (2 * np.where(far > 0, far, 1.0)), 0.0)
        variance = float(d.var())
    return {"modality": max(1, len(tops)), "maxima": [float(grid[t]) for t in tops], "skew": float((z * z * z).mean()), "kurt": float((z * z * z * z).mean() - 3) if std > 0 else 0.0, "gaps": gaps, "density_variance": variance, "components": max(1, components)}


def shape_thresholds(data: np.ndarray, found: dict) -> tuple[str, float, float]:
    """The strategy that the shape asks for, and its two targets."""
    q1, q2, q3 = np.percentile(data, [25, 50, 75])
    iqr = q3 - q1
    if found["modality"] > 1 and len(found["maxima"]) >= 2:
        a, b = found["maxima"][:2]
        between = data[(data > a) & (data < b)]
        return "multimodal", float(np.median(between)) if len(between) else (a + b) / 2, float(b)
    if found["kurt"] > 3:
        return "heavy_tailed", float(q2), float(q2 + iqr)
    if abs(found["skew"]) > 1:
        return ("skewed", float(q2), float(q2 + 1.5 * iqr)) if found["skew"] > 0 else ("skewed", float(q2 - 0.5 * iqr), float(q2 + 0.5 * iqr))
    if found["density_variance"] > data.var():
        if found["gaps"]:
            lo, hi = max(found["gaps"], key=lambda g: g[1] - g[0])
            return "clustered", (lo + hi) / 2, hi
        return "clustered", float(q2), float(q3)
    return "normal", float(data.mean()), float(data.mean() + 0.5 * data.std())


class ShapeTracker:
    """A window whose shape is taken anew every ``every`` values; thresholds follow its targets."""

    def __init__(self, window: int = 1000, alpha: float = 0.01, every: int = 100, least: int = 50):
        self.alpha, self.every, self.least = alpha, every, least
        self.values: deque[float] = deque(maxlen=window)
        self.n, self.ti, self.tq, self.strategy, self.found, self.before = 0, 0.0, 0.0, "normal", None, None

    def step(self, x: float) -> ShapeTracker:
        self.n += 1
        self.values.append(x)
        if self.n % self.every == 0 and len(self.values) >= self.least:
            data = np.array(self.values)
            self.before, self.found = self.found, shape(data)
            self.strategy, *targets = shape_thresholds(data, self.found)
            self.follow(*targets)
        return self

    def follow(self, ti: float, tq: float) -> None:
        self.ti += self.alpha * (ti - self.ti)
        self.tq += self.alpha * (tq - self.tq)

    def changed(self, sensitivity: float = 0.5) -> bool:
        if not self.before or not self.found:
            return False
        a, b = self.before, self.found
        return a["modality"] != b["modality"] or abs(a["skew"] - b["skew"]) > sensitivity or abs(a["kurt"] - b["kurt"]) > 3 * sensitivity


class ScaleTracker:
    """Shape trackers of a fast, a medium and a slow window; every 50 values their divergences give a regime."""

    #: Window and rate of each scale.
    SCALES = {"fast": (100, 0.1), "medium": (1000, 0.01), "slow": (10_000, 0.001)}

    def __init__(self, every: int = 50):
        self.every = every
        self.scales = {name: ShapeTracker(window, alpha) for name, (window, alpha) in self.SCALES.items()}
        self.n, self.regime, self.confidence, self.changes = 0, "unknown", 0.0, 0

    def step(self, x: float) -> ScaleTracker:
        self.n += 1
        for t in self.scales.values():
            t.step(x)
        if self.n % self.every == 0:
            self.judge(*(_deviation(np.array(self.scales[name].values)) for name in ("medium", "slow")))
        return self

    def judge(self, medium: float, slow: float) -> None:
        """The regime at the deviations of the medium and the slow window."""
        fm, fs, ms = self.divergence("fast", "medium", medium), self.divergence("fast", "slow", slow), self.divergence("medium", "slow", slow)
        new = classify(fm, fs, ms)
        self.changes += new != self.regime
        self.regime, self.confidence = new, min((fm + fs) / 6, 1.0)

    def divergence(self, a: str, b: str, size: float) -> float:
        """Distance of the two thresholds in deviations of the second scale's window; 0 without any scale."""
        first, second = self.scales[a], self.scales[b]
        size = size or second.tq - second.ti
        return float(np.hypot(first.ti - second.ti, first.tq - second.tq) / abs(size)) if size else 0.0

    def own(self) -> ShapeTracker:
        """The scale that the regime goes by."""
        calm = {"stable": "slow", "mean_reverting": "slow", "volatile": "fast"}
        return self.scales[calm.get(self.regime, "medium")]

    def encode(self, x: float) -> int:
        own = self.own()
        return code(x, own.ti, own.tq)


def _deviation(data: np.ndarray) -> float:
    return float(np.std(data)) if len(data) > 1 else 0.0


def classify(fm: float, fs: float, ms: float, low: float = 0.5, high: float = 2.0) -> str:
    """The regime of the divergences fast-medium, fast-slow and medium-slow; the first rule that holds."""
    table = (
        (max(fs, ms) < low, "stable"),
        (min(fs, ms) > high, "volatile"),
        (fs > high, "transitioning"),
        (ms > low and fm < low, "trending"),
        (fm > low and fs < low, "mean_reverting"),
    )
    return next((name for holds, name in table if holds), "unknown")


def track_moments(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], alpha: float = 0.01, carry: Sequence[str] = ()) -> DataFrame:
    """Thresholds and code after each row (update first, then encode)."""

    def step(state: dict, row: dict) -> dict:
        t = state.setdefault("t", MomentTracker(alpha)).step(row[c])
        return {"n": t.n, "mean": t.mean, "std": t.std, "threshold_i": t.ti, "threshold_q": t.tq, "s": code(row[c], t.ti, t.tq)}

    return scan(df, by, order, step, dict, {"n": "long", "mean": "double", "std": "double", "threshold_i": "double", "threshold_q": "double", "s": "tinyint"}, [c], carry)


def track_shape(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], window: int = 1000, every: int = 100, carry: Sequence[str] = ()) -> DataFrame:
    def step(state: dict, row: dict) -> dict:
        t = state.setdefault("t", ShapeTracker(window, every=every)).step(row[c])
        f = t.found or {"modality": 1, "skew": 0.0, "kurt": 0.0}
        return {"threshold_i": t.ti, "threshold_q": t.tq, "strategy": t.strategy, "modality": f["modality"], "skew": f["skew"], "kurt": f["kurt"], "changed": t.changed(), "s": code(row[c], t.ti, t.tq)}

    return scan(df, by, order, step, dict, {"threshold_i": "double", "threshold_q": "double", "strategy": "string", "modality": "int", "skew": "double", "kurt": "double", "changed": "boolean", "s": "tinyint"}, [c], carry)


def track_scales(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], every: int = 50) -> DataFrame:
    """What a ``ScaleTracker`` says after each row.

    A window's shape and deviation depend on its values alone: they are taken in
    tasks over chunks of a key's rows, with the rows before that the slowest
    window needs. One pass over these few numbers a key then follows the
    thresholds and regimes, which hold until the next ones.
    """
    # joins are by names of our own, as keys may be null
    rows = numbered(df.select(*by, *order, F.col(c).cast("double").alias(c)), by, order, "__n")
    key, longest = F.struct(F.lit(0), *by), max(window for window, _ in ScaleTracker.SCALES.values())
    size, trackers = 2 * longest, ScaleTracker(every).scales
    beat = next(iter(trackers.values())).every
    chunk = F.expr(f"int((__n - 1) div {size})")
    needed = F.when((F.col("__n") - 1) % size >= size - longest, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    parts = rows.select(*by, "__n", F.col(c).alias("__v"), F.explode(needed).alias("__chunk"))
    names = [f"__{x}_{name}" for name in trackers for x in ("ti", "tq")]
    stats = [*names, "__medium", "__slow"]
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by), "__n long", *(f"{x} double" for x in stats)])

    def taken(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n")
        first, last, values = int(pdf["__n"].iloc[0]), int(pdf["__n"].iloc[-1]), pdf["__v"].to_numpy(float)
        found = []
        for n in range(max(first, int(pdf["__chunk"].iloc[0]) * size + 1), last + 1):
            if n % beat and n % every:
                continue
            window = {name: values[max(0, n - first + 1 - t.values.maxlen) : n - first + 1] for name, t in trackers.items()}
            targets = [math.nan] * len(names)
            if n % beat == 0:
                targets = [x for name, t in trackers.items() for x in (shape_thresholds(window[name], shape(window[name]))[1:] if len(window[name]) >= t.least else (math.nan, math.nan))]
            found.append((n, *targets, _deviation(window["medium"]), _deviation(window["slow"])))
        out = pd.DataFrame(found, columns=["__n", *stats])
        for place, k in enumerate(by):
            out.insert(place, k, pd.Series([pdf[k].iloc[0]] * len(out), dtype=object))
        return out

    def step(state: dict, row: dict) -> dict:
        tracker = state.setdefault("t", ScaleTracker(every))
        n = row["__n"]
        if n % beat == 0:
            for name, t in tracker.scales.items():
                if min(n, t.values.maxlen) >= t.least:
                    t.follow(row[f"__ti_{name}"], row[f"__tq_{name}"])
        if n % every == 0:
            tracker.judge(row["__medium"], row["__slow"])
        own = tracker.own()
        return {"regime": tracker.regime, "confidence": tracker.confidence, "changes": tracker.changes, "__ti": own.ti, "__tq": own.tq}

    # long work on few bytes: a number of partitions that adaptive execution doesn't lower
    dealt = parts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "__chunk")
    seen = written(dealt.groupBy(*by, "__chunk").applyInPandas(taken, schema))
    states = scan(seen, by, ["__n"], step, dict, {"regime": "string", "confidence": "double", "changes": "int", "__ti": "double", "__tq": "double"}, ["__n", *stats])
    states = states.select(key.alias("__key"), F.col("__n").alias("__held"), "regime", "confidence", "changes", "__ti", "__tq")
    held = F.greatest(F.col("__n") - F.col("__n") % every, F.col("__n") - F.col("__n") % beat)
    both = rows.withColumn("__key", key).withColumn("__held", held).alias("r").join(states.alias("t"), F.col("r.__key").eqNullSafe(F.col("t.__key")) & (F.col("r.__held") == F.col("t.__held")), "left")
    since = lambda k, v: F.when(F.col("t.__held").isNull(), F.lit(v)).otherwise(F.col(f"t.{k}"))
    ti, tq, x = since("__ti", 0.0), since("__tq", 0.0), F.col(f"r.{c}")
    over = lambda t: F.coalesce((x > t) & ~F.isnan(x), F.lit(False)).cast("tinyint")
    start = ScaleTracker(every)
    told = [since(k, v).alias(k) for k, v in (("regime", start.regime), ("confidence", start.confidence), ("changes", start.changes))]
    return both.select(*[F.col(f"r.{k}").alias(k) for k in dict.fromkeys([*by, *order, c])], *told, (over(ti) * 2 + over(tq)).cast("tinyint").alias("s"))


def gaps(df: DataFrame, c: str, *by: str, times: float = 3.0) -> DataFrame:
    """Steps between neighbouring values above ``times`` the median step, for each group."""
    w = Window.partitionBy(*by).orderBy(c)
    steps = df.select(*by, F.col(c).alias("low"), F.lead(c).over(w).alias("high")).where("high is not null")
    typical = quantiles(steps, [(F.col("high") - F.col("low"), {"__m": 0.5})], *by)
    return steps.join(typical, list(by)).where((F.col("__m") > 0) & (F.col("high") - F.col("low") > times * F.col("__m"))).drop("__m")


def histogram_modes(df: DataFrame, c: str, *by: str, bins: int = 50, share: float = 0.05) -> DataFrame:
    """Number of strict local maxima over ``share`` of the largest in a histogram of ``bins`` bins; 1 at least."""
    ends = df.groupBy(*by).agg(F.min(c).alias("__a"), F.max(c).alias("__b"))
    at = F.when(F.col("__b") > F.col("__a"), F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col("__a")) / (F.col("__b") - F.col("__a")) * bins))).otherwise(0)
    counts = df.join(ends, list(by)).groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w, own = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    top = (F.col("n") > F.lag("n").over(w)) & (F.col("n") > F.lead("n").over(w)) & (F.col("n") > share * F.max("n").over(own))
    return filled.withColumn("__t", F.coalesce(top, F.lit(False))).groupBy(*by).agg(F.greatest(F.lit(1), F.count_if("__t")).cast("long").alias("modality"))


def strategy(df: DataFrame, c: str, *by: str) -> DataFrame:
    """Skewness, kurtosis and the strategy they ask for, and the thresholds, for each group."""
    moments = [F.coalesce(F.skewness(c), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis(c), F.lit(0.0)).alias("kurt"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")]
    agg = quantiles(df, [(F.col(c), {"p25": 0.25, "p50": 0.5, "p75": 0.75})], *by, also=moments).withColumn("iqr", F.col("p75") - F.col("p25"))
    heavy, right, left = F.col("kurt") > 3, F.col("skew") > 1, F.col("skew") < -1
    name = F.when(heavy, "heavy_tailed").when(right | left, "skewed").otherwise("normal")
    ti = F.when(heavy | right, F.col("p50")).when(left, F.col("p50") - 0.5 * F.col("iqr")).otherwise(F.col("mean"))
    tq = F.when(heavy, F.col("p50") + F.col("iqr")).when(right, F.col("p50") + 1.5 * F.col("iqr")).when(left, F.col("p50") + 0.5 * F.col("iqr")).otherwise(F.col("mean") + 0.5 * F.col("std"))
    return agg.select(*by, "skew", "kurt", name.alias("strategy"), ti.alias("threshold_i"), tq.alias("threshold_q"))
