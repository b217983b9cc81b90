"""Parallel channels: MAP<STRING, TINYINT>."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fourfold.functions.state import Op, SYMBOLS, col, i_bit, lit, q_bit, symbol


def channels(**named: str | Column) -> Column:
    return F.create_map(*[x for k, v in named.items() for x in (F.lit(k), col(v).cast("tinyint"))])


def count_of(m: str | Column, code: int) -> Column:
    return F.size(F.filter(F.map_values(col(m)), lambda x: x == code))


def distribution(m: str | Column) -> Column:
    return F.struct(*[count_of(m, k).alias(n) for k, n in enumerate(("empty", "phi", "delta", "psi"))])


def all_are(m: str | Column, code: int) -> Column:
    return F.forall(F.map_values(col(m)), lambda x: x == code)


def any_is(m: str | Column, code: int) -> Column:
    return F.exists(F.map_values(col(m)), lambda x: x == code)


def majority_is(m: str | Column, code: int) -> Column:
    return count_of(m, code) * 2 > F.size(col(m))


def names_in(m: str | Column, code: int) -> Column:
    return F.map_keys(F.map_filter(col(m), lambda _, v: v == code))


def apply_all(m: str | Column, op: Op) -> Column:
    return F.transform_values(col(m), lambda _, v: op(v))


def keep(m: str | Column, predicate: Callable[[Column, Column], Column]) -> Column:
    return F.map_filter(col(m), predicate)


def select(m: str | Column, names: Sequence[str]) -> Column:
    """Channels by name; missing names are left out."""
    return F.map_filter(col(m), lambda k, _: k.isin(*names))


def put(m: str | Column, name: str, state: int | Column) -> Column:
    state = F.lit(state) if isinstance(state, int) else state
    rest = F.map_filter(col(m), lambda k, _: k != name)
    return F.map_concat(rest, F.create_map(F.lit(name), state.cast("tinyint")))


def meet(m: str | Column) -> Column:
    """AND of all channels; psi without any."""
    return F.aggregate(F.map_values(col(m)), lit(3), lambda a, b: a.bitwiseAND(b))


def join(m: str | Column) -> Column:
    """OR of all channels; empty without any."""
    return F.aggregate(F.map_values(col(m)), lit(0), lambda a, b: a.bitwiseOR(b))


def weighted_vote(m: str | Column, weights: dict[str, float] | None = None) -> Column:
    """Each bit by weighted majority, strictly over half; channels without a weight count 1."""
    table = F.create_map(*[F.lit(x) for k, v in (weights or {}).items() for x in (k, float(v))]) if weights else F.create_map().cast("map<string,double>")
    weight = lambda k: F.coalesce(F.try_element_at(table, k), F.lit(1.0))
    entries = F.map_entries(col(m))
    total = F.aggregate(entries, F.lit(0.0), lambda a, e: a + weight(e["key"]))
    side = lambda bit: F.aggregate(entries, F.lit(0.0), lambda a, e: a + weight(e["key"]) * bit(e["value"]).cast("double"))
    over = lambda bit: (side(bit) > total / 2).cast("tinyint")
    return (over(i_bit) * 2 + over(q_bit)).cast("tinyint")


def matches(m: str | Column, pattern: dict[str, int | Sequence[int] | str]) -> Column:
    """Each named channel is in the given state or states, or, for ``*``, is there at all."""
    out = F.lit(True)
    for name, want in pattern.items():
        got = F.try_element_at(col(m), F.lit(name))
        test = got.isNotNull() if want == "*" else got.isin(*([want] if isinstance(want, int) else want))
        out = out & F.coalesce(test, F.lit(False))
    return out


def combine(a: str | Column, b: str | Column, op: Callable[[Column, Column], Column], missing: str = "skip") -> Column:
    """Channels of two sets by name: skip, keep_left, keep_right or keep_both for names of one side."""
    if missing not in {"skip", "keep_left", "keep_right", "keep_both"}:
        raise ValueError(f"unknown mode {missing}")
    left = F.lit(missing in {"keep_left", "keep_both"})
    right = F.lit(missing in {"keep_right", "keep_both"})
    both = F.map_zip_with(col(a), col(b), lambda _, x, y: F.when(x.isNotNull() & y.isNotNull(), op(x, y)).when(x.isNotNull() & left, x).when(y.isNotNull() & right, y))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def merge(a: str | Column, b: str | Column) -> Column:
    return combine(a, b, lambda x, y: x.bitwiseOR(y), "keep_both")


def compact(m: str | Column) -> Column:
    return F.array_join(F.transform(F.map_values(col(m)), symbol), "")


def described(m: str | Column) -> Column:
    parts = F.transform(F.map_entries(col(m)), lambda e: F.concat(e["key"], F.lit(":"), symbol(e["value"])))
    return F.concat(F.lit("("), F.array_join(parts, ", "), F.lit(")"))


def summary(m: str | Column) -> Column:
    """A line for each channel in the order of names, then the share of each state."""
    entries = F.array_sort(F.transform(F.map_entries(col(m)), lambda e: F.concat(e["key"], F.lit(": "), symbol(e["value"]))))
    n = F.greatest(F.size(col(m)), F.lit(1))
    shares = [F.format_string(f"{SYMBOLS[k]} %.1f%%%%", count_of(m, k) * 100.0 / n) for k in range(4)]
    return F.concat_ws("\n", entries, F.concat_ws(", ", *shares))
