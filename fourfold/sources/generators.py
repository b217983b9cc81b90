"""Seeded example inputs as DataFrames: by expressions over a range where rows are independent, by numpy where they aren't."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def states(spark: SparkSession, n: int, code: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(code).cast("tinyint").alias("s"))


def uniform(seed: int, *cols: str | Column) -> Column:
    """A number in [0, 1) by a hash of columns and seed: the same in every run and partitioning."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def normal(seed: int, *cols: str | Column) -> Column:
    u, v = uniform(seed, *cols), uniform(seed + 7919, *cols)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * F.pi() * v)


def classification(spark: SparkSession, n: int = 1000, features: int = 2, classes: int = 2, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Gaussian blobs around one centre for each class."""
    centres = np.random.default_rng(seed).normal(0, 2, (classes, features))
    y = (F.col("id") % classes).cast("int")
    table = F.array(*[F.array(*map(F.lit, map(float, c))) for c in centres])
    x = F.array(*[F.element_at(table, y + 1)[k] + noise * normal(seed + k, "id") for k in range(features)])
    return spark.range(n).select("id", x.alias("x"), y.alias("y"))


def time_series(spark: SparkSession, n: int = 1000, trend: float = 0.001, season: float = 0.1, noise: float = 0.05, seed: int = 42) -> DataFrame:
    t = F.col("id").cast("double")
    return spark.range(n).select(F.col("id").alias("t"), (10 + trend * t + season * F.sin(2 * F.pi() * t / 50) + noise * normal(seed, "id")).alias("v"))


def regimes(spark: SparkSession, n: int = 1000, k: int = 3, seed: int = 42) -> DataFrame:
    rng = np.random.default_rng(seed)
    mean, width = rng.normal(10, 5, k), rng.uniform(0.5, 2.5, k)
    r = F.least(F.lit(k - 1), F.floor(F.col("id") * k / n)).cast("int")
    at = lambda values: F.element_at(F.array(*map(F.lit, map(float, values))), r + 1)
    return spark.range(n).select(F.col("id").alias("t"), (at(mean) + at(width) * normal(seed, "id")).alias("v"), r.alias("regime"))


def signal(spark: SparkSession, n: int = 1000, waves: Sequence[tuple[float, float]] = ((1.0, 1.0), (0.5, 3.0), (0.25, 7.0)), rate: float = 100.0) -> DataFrame:
    t = F.col("id") / rate
    return spark.range(n).select(t.alias("t"), sum((a * F.sin(2 * F.pi() * f * t) for a, f in waves), F.lit(0.0)).alias("v"))


def walk(spark: SparkSession, n: int = 1000, start: float = 100.0, volatility: float = 0.02, drift: float = 0.0005, seed: int = 42) -> DataFrame:
    """Open, high, low, close and volume of a geometric random walk; made on the driver, as each row needs the one before."""
    rng = np.random.default_rng(seed)
    close = start * np.exp(np.cumsum(rng.normal(drift, volatility, n)))
    opened = np.concatenate([[start], close[:-1]])
    span = np.abs(rng.normal(0, volatility / 2, (2, n)))
    high, low = np.maximum(opened, close) * (1 + span[0]), np.minimum(opened, close) * (1 - span[1])
    return spark.createDataFrame(pd.DataFrame({"seq": np.arange(n), "open": opened, "high": high, "low": low, "close": close, "volume": rng.lognormal(10, 0.5, n)}))


def patients(spark: SparkSession, n: int = 500, prevalence: float = 0.2, sensitivity: float = 0.9, specificity: float = 0.95, seed: int = 42) -> DataFrame:
    ill = uniform(seed, "id") < prevalence
    test = F.when(ill, uniform(seed + 1, "id") < sensitivity).otherwise(uniform(seed + 1, "id") >= specificity)
    symptoms = F.array(*[F.when(ill, 0.5).otherwise(0.0) + 0.5 * uniform(seed + 2 + k, "id") for k in range(3)])
    return spark.range(n).select("id", symptoms.alias("symptoms"), test.alias("test"), ill.alias("label"))


#: How a state persists or moves in the default chain, by code.
PERSISTENT = [[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.1, 0.1, 0.1, 0.7]]


def state_chain(spark: SparkSession, n: int = 100, table: Sequence[Sequence[float]] = PERSISTENT, start: int = 3, seed: int = 42) -> DataFrame:
    rng = np.random.default_rng(seed)
    out = [start]
    for _ in range(n - 1):
        out.append(int(rng.choice(4, p=table[out[-1]])))
    return spark.createDataFrame(list(enumerate(out)), "pos long, s tinyint")


def state_cycle(spark: SparkSession, n: int = 100, p: float = 0.3, seed: int = 42) -> DataFrame:
    """psi, delta, phi, empty in turn, moving on with probability p."""
    moves = np.concatenate([[0], np.cumsum(np.random.default_rng(seed).random(n - 1) < p)])
    return spark.createDataFrame([(k, (3, 2, 1, 0)[int(m) % 4]) for k, m in enumerate(moves)], "pos long, s tinyint")


def nested_states(spark: SparkSession, n: int = 50, deepest: int = 3, seed: int = 42) -> DataFrame:
    size = (uniform(seed, "id") * deepest).cast("int") + 1
    levels = F.transform(F.sequence(F.lit(1), size), lambda k: F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(4)).cast("tinyint"))
    return spark.range(n).select("id", levels.alias("levels"))


def parallel_channels(spark: SparkSession, n: int = 50, names: Sequence[str] = ("technical", "business", "team", "market"), seed: int = 42) -> DataFrame:
    states_of = F.array(*[F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(4)).cast("tinyint") for k in names])
    return spark.range(n).select("id", F.map_from_arrays(F.array(*map(F.lit, names)), states_of).alias("channels"))


def rate_stream(spark: SparkSession, rows_per_second: int = 10, volatility: float = 0.1, seed: int = 42) -> DataFrame:
    """An endless stream of values with time stamps."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select("timestamp", F.col("value").alias("id"), (10 + volatility * normal(seed, "value")).alias("v"))
