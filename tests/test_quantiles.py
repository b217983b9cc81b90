"""Percentiles by sketched brackets against the built-in, which holds every value."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fourfold.operators.quantiles import quantiles, values

STEPS = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}
SCHEMA = "k string, x double, y double"


def expected(df, *by):
    return df.groupBy(*by).agg(*[F.percentile(c, F.lit(p)).alias(f"{c}_{n}") for c in ("x", "y") for n, p in STEPS.items()], F.count(F.lit(1)).alias("rows"))


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_equals_percentile(spark, small):
    rng = random.Random(5)
    rows = []
    for _ in range(20_000):
        g = rng.choice(["hot", "hot", "hot", "b", None])
        rows.append((g, rng.gauss(0, 10) if rng.random() > 0.1 else None, float(rng.randrange(7)) if g != "b" else None))
    rows += [("one", 4.0, -3.0), ("nulls", None, None), ("ties", 2.0, float("inf")), ("ties", 2.0, float("nan"))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if small == 0:  # a bracket needs some values for each step of the sketch
        df = df.where("k is null or k in ('hot', 'b')")
    wanted = [(F.col(c), {f"{c}_{n}": p for n, p in STEPS.items()}) for c in ("x", "y")]
    got = quantiles(df, wanted, "k", also=[F.count(F.lit(1)).alias("rows")], accuracy=500, small=small)
    want = expected(df, "k")
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    assert sorted(map(str, got.select(order).collect())) == sorted(map(str, want.select(order).collect()))


def test_whole_table(spark):
    df = spark.range(30_000).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("x"))
    steps = [k / 40 for k in range(41)]
    want = df.agg(F.percentile("x", F.array(*map(F.lit, steps)))).first()[0]
    assert values(df, *[(F.col("x"), p) for p in reversed(steps)]) == want[::-1]
    row = quantiles(df, [(F.col("x"), {f"q{k}": p for k, p in enumerate(steps)})], accuracy=1000, small=100).first()
    assert list(row) == want


def test_empty(spark):
    df = spark.createDataFrame([], "k int, x double")
    assert values(df, (F.col("x"), 0.5), also=[F.count("x")]) == [None, 0]
    assert quantiles(df, [(F.col("x"), {"m": 0.5})], "k").count() == 0
    assert values(df) == []
