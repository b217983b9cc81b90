"""Nested states: ARRAY<TINYINT>, one code for each level from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fourfold.functions.state import SYMBOLS, col, from_name, symbol


def nested(*levels: str | Column) -> Column:
    return F.array(*[col(x).cast("tinyint") for x in levels])


def depth(a: str | Column) -> Column:
    """Largest level; -1 for no levels."""
    return F.size(col(a)) - 1


def total_bits(a: str | Column) -> Column:
    return F.size(col(a)) * 2


def total_states(a: str | Column) -> Column:
    return F.pow(F.lit(4), F.size(col(a))).cast("long")


def level(a: str | Column, k: int) -> Column:
    """State of a level; an error where it is absent."""
    return F.element_at(col(a), k + 1)


def set_level(a: str | Column, k: int, state: int | Column) -> Column:
    """Replace a level, or append the one after the last; an error beyond it."""
    a = col(a)
    new = F.array((F.lit(state) if isinstance(state, int) else state).cast("tinyint"))
    put = F.concat(F.slice(a, 1, k), new, F.slice(a, k + 2, F.greatest(F.size(a) - k - 1, F.lit(0))))
    return F.when(F.size(a) < k, F.raise_error(F.lit("levels must be contiguous"))).otherwise(put)


def all_are(a: str | Column, code: int) -> Column:
    return F.forall(col(a), lambda x: x == code)


def any_is(a: str | Column, code: int) -> Column:
    return F.exists(col(a), lambda x: x == code)


def count_of(a: str | Column, code: int) -> Column:
    return F.size(F.filter(col(a), lambda x: x == code))


def path(a: str | Column, separator: str = ".") -> Column:
    return F.array_join(F.transform(col(a), symbol), separator)


def from_path(p: str | Column, separator: str = ".") -> Column:
    return F.transform(F.split(col(p), "\\Q" + separator + "\\E"), from_name)


def path_matches(a: str | Column, pattern: str, separator: str = ".") -> Column:
    """Level by level against symbols or ``*``; other lengths never match."""
    want = pattern.split(separator)
    a = col(a)
    tests = [F.element_at(a, k + 1) == SYMBOLS.index(w) for k, w in enumerate(want) if w != "*"]
    out = F.size(a) == len(want)
    for t in tests:
        out = F.when(out, t).otherwise(F.lit(False))
    return out


def to_map(a: str | Column) -> Column:
    return F.map_from_entries(F.transform(col(a), lambda x, k: F.struct(k.alias("key"), x.alias("value"))))


def meet_levels(a: str | Column) -> Column:
    return F.aggregate(col(a), F.lit(3).cast("tinyint"), lambda x, y: x.bitwiseAND(y))


def join_levels(a: str | Column) -> Column:
    return F.aggregate(col(a), F.lit(0).cast("tinyint"), lambda x, y: x.bitwiseOR(y))
