"""Checks of parameters and of data; the latter as one aggregate query."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckError(ValueError):
    """A parameter or table isn't what an operator needs."""


def threshold(t: float, name: str = "threshold") -> float:
    if isinstance(t, bool) or not isinstance(t, (int, float)) or not math.isfinite(t):
        raise CheckError(f"{name} must be a finite number, not {t!r}")
    return float(t)


def threshold_pair(ti: float, tq: float) -> tuple[float, float]:
    if threshold(ti, "threshold_i") > threshold(tq, "threshold_q"):
        raise CheckError(f"threshold_i {ti} is above threshold_q {tq}")
    return float(ti), float(tq)


def probability(p: float, name: str = "probability") -> float:
    if not 0 <= threshold(p, name) <= 1:
        raise CheckError(f"{name} must lie in [0, 1], not {p}")
    return float(p)


def window_size(n: int, name: str = "window") -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise CheckError(f"{name} must be a positive integer, not {n!r}")
    return n


def positive(x: float, name: str = "value") -> float:
    if threshold(x, name) <= 0:
        raise CheckError(f"{name} must be above 0, not {x}")
    return x


def non_negative(x: float, name: str = "value") -> float:
    if threshold(x, name) < 0:
        raise CheckError(f"{name} must be 0 or more, not {x}")
    return x


def state_bits(i: int, q: int) -> tuple[int, int]:
    if i not in (0, 1) or q not in (0, 1):
        raise CheckError(f"state bits must be 0 or 1, not {i!r}, {q!r}")
    return i, q


def columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise CheckError(f"missing columns: {', '.join(missing)}")
    return df


def same_length(*frames: DataFrame) -> int:
    sizes = {df.count() for df in frames}
    if len(sizes) > 1:
        raise CheckError(f"tables differ in length: {sorted(sizes)}")
    return sizes.pop()


def finite(df: DataFrame, *names: str) -> DataFrame:
    """An error if a column has nulls, NaN or infinities; one pass."""
    bad = df.agg(*[F.count_if(F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))).alias(n) for n in names]).first()
    found = {n: bad[n] for n in names if bad[n]}
    if found:
        raise CheckError(f"values that aren't finite: {found}")
    return df


def fitted(method: Callable) -> Callable:
    """Decorator: the object must have been fitted."""

    @wraps(method)
    def checked(self, *args, **kwargs):
        if getattr(self, "params", None) is None:
            raise RuntimeError(f"{type(self).__name__} must be fitted before {method.__name__}")
        return method(self, *args, **kwargs)

    return checked


class Context:
    """Puts a name before errors raised inside."""

    def __init__(self, name: str):
        self.name = name

    def __enter__(self) -> Context:
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if isinstance(error, CheckError):
            raise CheckError(f"{self.name}: {error}") from error
        return False
