"""From states to decisions: rules, learned tables, patterns, machines, votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourfold.functions.state import col, symbol

#: Default decisions and scores by state code.
DEFAULT_RULES = {3: "buy", 2: "hold", 1: "hold", 0: "sell"}
DEFAULT_SCORES = {3: 1.0, 2: 0.3, 1: -0.3, 0: -1.0}


def rules(s: str | Column, table: dict[int, str] | None = None) -> Column:
    """Decision of a state; its symbol where no rule is given."""
    table = DEFAULT_RULES if table is None else table
    out = symbol(s)
    for code, decision in table.items():
        out = F.when(col(s) == code, F.lit(decision)).otherwise(out)
    return out


def prioritised(cases: Sequence[tuple[Column, str]], default: str = "hold") -> Column:
    """The decision of the first case that holds."""
    out = F.lit(default)
    for test, decision in reversed(cases):
        out = F.when(test, F.lit(decision)).otherwise(out)
    return out


def modal_labels(df: DataFrame, s: str, label: str) -> DataFrame:
    """The most frequent label of each state; the smallest of equals."""
    counts = df.where(F.col(label).isNotNull()).groupBy(s, label).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(s).orderBy(F.desc("n"), label)
    return counts.withColumn("r", F.row_number().over(best)).where("r = 1").select(s, F.col(label).alias("decision"))


def lookup(df: DataFrame, s: str, label: str, target: DataFrame | None = None) -> DataFrame:
    """Decide by the modal label of the state; the overall mode for states not seen in training.

    The table has four rows at most.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    overall = counts.orderBy(F.desc("n"), label).limit(1).select(F.col(label).alias("__mode"))
    table = modal_labels(df, s, label)
    return (df if target is None else target).join(F.broadcast(table), s, "left").join(F.broadcast(overall)).withColumn("decision", F.coalesce("decision", "__mode")).drop("__mode")


def probabilities(df: DataFrame, s: str, label: str) -> DataFrame:
    """P(label given state)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(s, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(s)))


def match_patterns(df: DataFrame, s: str, order: list[str], by: list[str], patterns: Sequence[tuple[Sequence[int], str, float]], window: int = 3, default: str = "hold") -> DataFrame:
    """The decision of the surest pattern that the last states end with; the first of equals.

    Patterns longer than ``window`` never match.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    best = F.struct(F.lit(-1.0).alias("c"), F.lit(-len(patterns) - 1).alias("k"), F.lit(default).alias("d"))
    for k, (pattern, decision, sure) in enumerate(patterns):
        if 0 < len(pattern) <= window:
            same = F.lit(True)
            for back, want in enumerate(reversed(pattern)):
                same = same & F.coalesce((F.lag(s, back).over(w) if back else F.col(s)) == want, F.lit(False))
            best = F.greatest(best, F.when(same, F.struct(F.lit(float(sure)).alias("c"), F.lit(-k).alias("k"), F.lit(decision or default).alias("d"))))
    return df.withColumn("decision", best["d"])


def find_pattern(df: DataFrame, s: str, order: list[str], by: list[str], pattern: Sequence[int]) -> DataFrame:
    """Rows at which the pattern starts."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lit(True)
    for k, want in enumerate(pattern):
        same = same & ((F.lead(s, k).over(w) if k else F.col(s)) == want)
    return df.withColumn("__m", same).where("__m").drop("__m")


def ensemble(decisions: Sequence[Column], how: str = "majority", weights: Sequence[float] | None = None) -> Column:
    """majority (ties: smallest), weighted (ties: first) or unanimous (else hold) over decision columns."""
    votes = F.array(*decisions)
    if how == "unanimous":
        return F.when(F.size(F.array_distinct(votes)) == 1, F.element_at(votes, 1)).otherwise(F.lit("hold"))
    w = [float(x) for x in weights] if how == "weighted" and weights else [1.0] * len(decisions)
    if len(w) != len(decisions):
        raise ValueError("a weight for each interpreter")
    total = lambda d: sum((F.when(v == d, F.lit(x)).otherwise(F.lit(0.0)) for v, x in zip(decisions, w, strict=True)), F.lit(0.0))
    ranked = F.transform(votes, lambda d, k: F.struct((-total(d)).alias("t"), (k.cast("string") if how == "weighted" else d).alias("r"), d.alias("d")))
    return F.element_at(F.array_sort(ranked), 1)["d"]
