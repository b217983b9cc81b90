"""Scores of a value in its context, in [0, 1]; windows give the context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def fixed(x: Column, digits: int = 3) -> Column:
    """A number with so many decimals, rounded by its exact binary value, halves to even, as C's printf does.

    ``format_string`` rounds the shortest decimals that stand for a double, so
    that 0.5225, whose double lies under it, goes up. Up to 6 decimals and 1e9;
    other values fall back to ``format_string``.
    """
    size = F.abs(x.cast("double"))
    scale = 10**digits
    low = F.floor(size * float(scale)).cast("long")
    # size * 2 * scale - (2 * low + 1): products of halves of the double are exact, and so is the sign of their sum
    high = size.cast("float").cast("double")
    over = (high * (2.0 * scale) - (low * 2 + 1).cast("double")) + (size - high) * (2.0 * scale)
    k = low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1).otherwise(0)
    shown = F.format_string(f"%s%d.%0{digits}d", F.when(x < 0, "-").otherwise(""), F.floor(k / scale).cast("long"), k % scale)
    return F.when(size < 1e9, shown).otherwise(F.format_string(f"%.{digits}f", x))


def confidence(n: Column, missing: Column, noise: Column) -> Column:
    return clip(F.least(n / 30.0, F.lit(1.0)) * (1 - missing) / (1 + noise))


def freshness(age: Column, half_life: float = 3600.0) -> Column:
    return F.pow(F.lit(0.5), age / half_life)


def stability(n: Column, mean: Column, std: Column) -> Column:
    """1 / (1 + deviation / |mean|); 0.5 for fewer than 3 values or a mean of 0."""
    return F.when((n < 3) | (mean == 0), 0.5).otherwise(1 / (1 + std / F.abs(mean)))


def density(near: Column, n: Column) -> Column:
    """Share of values in the neighbourhood over 0.2, at most 1; 0.5 for fewer than 10 values."""
    return F.when(n < 10, 0.5).otherwise(F.least(near / n / 0.2, F.lit(1.0)))


def relevance(mean_outcome: Column, near: Column, n: Column) -> Column:
    """(mean outcome of near values + 1) / 2; 0.5 with fewer than 10 values or 5 near ones."""
    return F.when((n < 10) | (near < 5), 0.5).otherwise(clip((mean_outcome + 1) / 2))


def combine(scores: dict[str, Column], weights: dict[str, float] | None = None, how: str = "weighted_average") -> Column:
    """weighted_average, min, max or product of scores, null as 0.5; 0.5 without any."""
    if not scores:
        return F.lit(0.5)
    own = {k: F.coalesce(x, F.lit(0.5)) for k, x in scores.items()}
    if how in {"min", "max"}:
        return next(iter(own.values())) if len(own) == 1 else (F.least if how == "min" else F.greatest)(*own.values())
    if how == "product":
        out = F.lit(1.0)
        for x in own.values():
            out = out * x
        return out
    w = {k: float((weights or {}).get(k, 1.0)) for k in own}
    return sum((x * w[k] for k, x in own.items()), F.lit(0.0)) / sum(w.values())


#: Dimensions and weights of the preset scorers.
PRESETS = {
    "trading": {"strength": 2.0, "confidence": 1.5, "timeliness": 1.5, "stability": 1.0},
    "medical": {"diagnostic_value": 2.5, "measurement_quality": 2.0, "consistency": 1.5},
    "signal": {"signal_strength": 2.0, "noise_level": 1.5, "temporal_stability": 1.5, "local_density": 1.0},
}
