"""Two-bit states as TINYINT codes: 2 * presence + membership.

0 empty, 1 phi (expected, not present), 2 delta (present, not validated),
3 psi (present and validated). Everything here maps Columns to Columns, so
chains collapse into one code-generated projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY, PHI, DELTA, PSI = 0, 1, 2, 3
#: Symbols by code, and names with their codes.
SYMBOLS = ("∅", "φ", "δ", "ψ")
NAMES = {"empty": 0, "null": 0, "∅": 0, "phi": 1, "hole": 1, "φ": 1, "delta": 2, "puncture": 2, "δ": 2, "psi": 3, "resonant": 3, "ψ": 3}

Op = Callable[[Column], Column]


def lit(code: int) -> Column:
    return F.lit(code).cast("tinyint")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_bits(i: str | Column, q: str | Column) -> Column:
    """Code of two bits; an error for values other than 0 and 1."""
    i, q = col(i), col(q)
    bad = ~(i.isin(0, 1) & q.isin(0, 1))
    return F.when(bad, F.raise_error(F.lit("state bits must be 0 or 1"))).otherwise(i * 2 + q).cast("tinyint")


def from_int(code: str | Column) -> Column:
    c = col(code)
    return F.when(~c.between(0, 3), F.raise_error(F.lit("state code must be 0..3"))).otherwise(c).cast("tinyint")


def from_name(name: str | Column) -> Column:
    """Code of a name, alias or symbol, in any case; null for unknown names."""
    table = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, v)])
    return F.try_element_at(table, F.lower(F.trim(col(name)))).cast("tinyint")


def i_bit(s: str | Column) -> Column:
    return F.shiftright(col(s).cast("int"), 1).cast("tinyint")


def q_bit(s: str | Column) -> Column:
    return col(s).bitwiseAND(lit(1)).cast("tinyint")


def bits(s: str | Column) -> Column:
    return F.struct(i_bit(s).alias("i"), q_bit(s).alias("q"))


def to_vector(s: str | Column) -> Column:
    return F.array(i_bit(s), q_bit(s))


def to_complex(s: str | Column) -> Column:
    return F.struct(i_bit(s).cast("double").alias("re"), q_bit(s).cast("double").alias("im"))


def symbol(s: str | Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SYMBOLS)), col(s).cast("int") + 1)


def is_present(s: str | Column) -> Column:
    return col(s) >= 2


def is_member(s: str | Column) -> Column:
    return q_bit(s) == 1


def encode(x: str | Column, threshold_i: float | Column, threshold_q: float | Column) -> Column:
    """Presence where x > threshold_i, membership where x > threshold_q, both strictly; null and NaN are empty."""
    x = col(x).cast("double")
    above = lambda t: F.coalesce((x > (F.lit(float(t)) if not isinstance(t, Column) else t)) & ~F.isnan(x), F.lit(False)).cast("tinyint")
    return (above(threshold_i) * 2 + above(threshold_q)).cast("tinyint")


# algebra


def gate(s: str | Column) -> Column:
    """Presence needs membership: delta becomes empty."""
    s = col(s)
    return F.when(s == 2, lit(0)).otherwise(s)


def admit(s: str | Column) -> Column:
    """Presence gives membership: delta becomes psi."""
    s = col(s)
    return F.when(s == 2, lit(3)).otherwise(s)


def overlay(a: str | Column, b: str | Column) -> Column:
    return col(a).bitwiseOR(col(b))


def weave(a: str | Column, b: str | Column) -> Column:
    return col(a).bitwiseAND(col(b))


def comp(s: str | Column) -> Column:
    return col(s).bitwiseXOR(lit(3))


def neg_i(s: str | Column) -> Column:
    return col(s).bitwiseXOR(lit(2))


def neg_q(s: str | Column) -> Column:
    return col(s).bitwiseXOR(lit(1))


def compose(*ops: Op) -> Op:
    """Right-to-left composition; the identity without operations."""
    return pipe(*reversed(ops))


def pipe(*ops: Op) -> Op:
    return lambda s: reduce(lambda c, op: op(c), ops, col(s))


def table_op(table: Sequence[int]) -> Op:
    """Any unary operation, as a table of four codes."""
    if len(table) != 4 or not all(t in (0, 1, 2, 3) for t in table):
        raise ValueError("a unary table has four state codes")
    codes = F.array(*map(lit, table))
    return lambda s: F.element_at(codes, col(s).cast("int") + 1)


def table_op2(table: Sequence[int]) -> Callable[[Column, Column], Column]:
    """Any binary operation, as a table of sixteen codes by 4 * left + right."""
    if len(table) != 16 or not all(t in (0, 1, 2, 3) for t in table):
        raise ValueError("a binary table has sixteen state codes")
    codes = F.array(*map(lit, table))
    return lambda a, b: F.element_at(codes, (col(a).cast("int") * 4 + col(b).cast("int") + 1))


#: Tables of the named unary operations.
TABLES = {"identity": (0, 1, 2, 3), "gate": (0, 1, 0, 3), "admit": (0, 1, 3, 3), "comp": (3, 2, 1, 0), "neg_i": (2, 3, 0, 1), "neg_q": (1, 0, 3, 2)}
_FORMS = {TABLES["identity"]: lambda s: col(s), TABLES["gate"]: gate, TABLES["admit"]: admit, TABLES["comp"]: comp, TABLES["neg_i"]: neg_i, TABLES["neg_q"]: neg_q}


def simplify(names: Sequence[str]) -> tuple[int, ...]:
    """One table for a chain of named operations, applied left to right."""
    table = TABLES["identity"]
    for n in names:
        table = tuple(TABLES[n][t] for t in table)
    return table


def chain(names: Sequence[str]) -> Op:
    """The shortest expression for a chain of named operations (gate twice is gate, comp twice nothing)."""
    table = simplify(names)
    return _FORMS.get(table) or table_op(table)


# lattice: the diamond with empty below, psi above, phi and delta not comparable


def leq(a: str | Column, b: str | Column) -> Column:
    return weave(a, b) == col(a)


def comparable(a: str | Column, b: str | Column) -> Column:
    return leq(a, b) | leq(b, a)


def distance(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def covers(a: str | Column, b: str | Column) -> Column:
    """b is an immediate successor of a."""
    return leq(a, b) & (distance(a, b) == 1)


def complement(s: str | Column) -> Column:
    return comp(s)


def meet_all(s: str | Column) -> Column:
    """Aggregate: greatest lower bound; psi over no rows."""
    return F.coalesce(F.bit_and(col(s)), lit(3))


def join_all(s: str | Column) -> Column:
    """Aggregate: least upper bound; empty over no rows."""
    return F.coalesce(F.bit_or(col(s)), lit(0))


def count_state(s: str | Column, code: int) -> Column:
    return F.count_if(col(s) == code)


def fraction(s: str | Column, code: int) -> Column:
    """Share of rows in a state; null over no rows."""
    return F.avg((col(s) == code).cast("double"))
