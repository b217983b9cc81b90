"""Indicators and measurements as states; recent patterns, anomalies, change points, predicted values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourfold.functions import state as st
from fourfold.operators.preprocess import value
from fourfold.operators.series import ordered


def rsi_state(rsi: Column, low: float = 30.0, middle: float = 50.0, high: float = 70.0) -> Column:
    """psi above high, delta above middle, phi above low, else empty; missing is empty."""
    return F.coalesce(F.when(rsi > high, st.lit(3)).when(rsi > middle, st.lit(2)).when(rsi > low, st.lit(1)), st.lit(0))


def macd_state(line: Column, signal: Column) -> Column:
    """Presence where the line is above its signal, membership where it is above 0."""
    above = lambda t: F.coalesce(t, F.lit(False)).cast("tinyint")
    return (above(line > signal) * 2 + above(line > 0)).cast("tinyint")


def band_state(price: Column, upper: Column, middle: Column, lower: Column) -> Column:
    """psi above the upper band, delta above the middle, phi above the lower, else empty."""
    return F.coalesce(F.when(price > upper, st.lit(3)).when(price > middle, st.lit(2)).when(price > lower, st.lit(1)), st.lit(0))


def severity_state(severity: Column, mild: float = 0.3, severe: float = 0.7) -> Column:
    return st.encode(severity, mild, severe)


def range_state(x: Column, low: float, high: float, slack: float = 0.2) -> Column:
    """psi inside the reference range, delta within ``slack`` of its width outside, empty beyond; missing is phi."""
    width = (high - low) * slack
    return F.when(value(x).isNull(), st.lit(1)).when(value(x).between(low, high), st.lit(3)).when(value(x).between(low - width, high + width), st.lit(2)).otherwise(st.lit(0))


def recent_pattern(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], out: str = "pattern") -> DataFrame:
    """The last three values as stable, increasing, accelerating, decreasing, crashing or volatile (a turn of over a tenth)."""
    w = ordered(by, order)
    d1, d2 = F.lag(c).over(w) - F.lag(c, 2).over(w), F.col(c) - F.lag(c).over(w)
    rows = df.withColumn("__a", d1).withColumn("__b", d2)
    a, b = F.col("__a"), F.col("__b")
    name = F.when((a > 0) & (b > 0), F.when(b > 2 * a, "accelerating").otherwise("increasing")).when((a < 0) & (b < 0), F.when(b < 2 * a, "crashing").otherwise("decreasing"))
    turn = F.abs(a) + F.abs(b) > 0.1 * F.abs(F.col(c))
    return rows.withColumn(out, F.coalesce(name, F.when(turn, "volatile"), F.lit("stable"))).drop("__a", "__b")


def pattern_adjusted(s: Column, pattern: Column) -> Column:
    """Accelerating values gain membership, crashing ones lose it, and volatile ones need both bits to be present."""
    return F.when(pattern == "accelerating", st.overlay(s, st.lit(1))).when(pattern == "crashing", st.weave(s, st.lit(2))).when(pattern == "volatile", st.gate(s)).otherwise(s).cast("tinyint")


def anomalies(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], window: int = 50, limit: float = 3.0) -> DataFrame:
    """z score of each value against the ``window`` values before it, and whether it passes ``limit``; fewer than 10 values before give none."""
    before = ordered(by, order).rowsBetween(-window, -1)
    z = F.when((F.count(c).over(before) >= 10) & (F.stddev_samp(c).over(before) > 0), F.try_divide(F.col(c) - F.avg(c).over(before), F.stddev_samp(c).over(before)))
    return df.withColumn("z", z).withColumn("anomaly", F.coalesce(F.abs("z") > limit, F.lit(False)))


def change_points(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], window: int = 20, limit: float = 1.0) -> DataFrame:
    """Rows at which the mean of the next ``window`` values leaves that of the last by over ``limit`` deviations of both."""
    w = ordered(by, order)
    back, on, both = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1), w.rowsBetween(-window, window - 1)
    full = (F.count(c).over(back) == window) & (F.count(c).over(on) == window)
    shift = F.when(full, F.try_divide(F.avg(c).over(on) - F.avg(c).over(back), F.stddev_pop(c).over(both)))
    return df.withColumn("shift", shift).where(F.abs("shift") > limit)


def predicted_fill(df: DataFrame, target: str, predictor: str, out: str | None = None) -> DataFrame:
    """Missing targets from a linear regression on another column; one aggregate, then literals."""
    x, y = value(predictor), value(target)
    both = F.when(x.isNotNull() & y.isNotNull(), x)
    row = df.agg(F.regr_slope(y, both), F.regr_intercept(y, both)).first()
    guess = x * F.lit(row[0]).cast("double") + F.lit(row[1]).cast("double")
    return df.withColumn(out or target, F.coalesce(y, guess))
