"""State columns over rows: histograms, roll-ups, channel joins, field-free lattice tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourfold.functions import state as st


def histogram(df: DataFrame, s: str, *by: str) -> DataFrame:
    """Counts of all four states, zeros included, for each group."""
    return df.groupBy(*by).agg(*[st.count_state(s, k).alias(n) for k, n in enumerate(("n_empty", "n_phi", "n_delta", "n_psi"))], F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, s: str, *by: str) -> DataFrame:
    """Long form: one row for each group and occurring state, with its share and rank.

    Ranks go by count, then by state code.
    """
    counts = df.groupBy(*by, F.col(s).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "s")))


def rollup_lattice(df: DataFrame, s: str, *by: str) -> DataFrame:
    """Meet and join of each group's states, and of their counts."""
    return df.groupBy(*by).agg(st.meet_all(s).alias("meet"), st.join_all(s).alias("join"), F.count(F.lit(1)).alias("n"), F.count_if(st.is_present(s)).alias("n_present"), F.count_if(st.is_member(s)).alias("n_member"))


def combine(left: DataFrame, right: DataFrame, keys: list[str], op: Callable[[Column, Column], Column], missing: str = "skip", s: str = "s") -> DataFrame:
    """Two tables of channels in long form, joined on their keys; skip, keep_left, keep_right or keep_both."""
    how = {"skip": "inner", "keep_left": "left", "keep_right": "right", "keep_both": "full_outer"}
    if missing not in how:
        raise ValueError(f"unknown mode {missing}")
    a = left.select(*keys, F.col(s).alias("__a"))
    b = right.select(*keys, F.col(s).alias("__b"))
    both = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), op(F.col("__a"), F.col("__b")))
    return a.join(b, keys, how[missing]).select(*keys, F.coalesce(both, "__a", "__b").alias(s))


def merge(left: DataFrame, right: DataFrame, keys: list[str], s: str = "s") -> DataFrame:
    """OR of both tables' channels; a union and one aggregate, without a join."""
    return left.select(*keys, s).unionByName(right.select(*keys, s)).groupBy(*keys).agg(F.bit_or(s).alias(s))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_semi")


def vote(df: DataFrame, s: str, weight: str | Column, *by: str) -> DataFrame:
    """Weighted majority of each bit over the rows of a group, strictly over half."""
    w = F.coalesce(F.col(weight) if isinstance(weight, str) else weight, F.lit(1.0))
    over = lambda bit: (F.sum(w * bit(s).cast("double")) > F.sum(w) / 2).cast("tinyint")
    return df.groupBy(*by).agg((over(st.i_bit) * 2 + over(st.q_bit)).cast("tinyint").alias("vote"))


def states(spark: SparkSession) -> DataFrame:
    return spark.range(4).select(F.col("id").cast("tinyint").alias("s"))


def truth_table(spark: SparkSession, op: st.Op) -> DataFrame:
    return states(spark).select("s", op(F.col("s")).alias("result"))


def truth_table2(spark: SparkSession, op: Callable[[Column, Column], Column]) -> DataFrame:
    a = spark.range(16).select(F.shiftright("id", 2).cast("tinyint").alias("a"), F.col("id").bitwiseAND(3).cast("tinyint").alias("b"))
    return a.select("a", "b", op(F.col("a"), F.col("b")).alias("result"))


def closed(spark: SparkSession, op: st.Op) -> bool:
    """Whether an operation maps states to states."""
    return truth_table(spark, op).where(F.col("result").isNull() | ~F.col("result").between(0, 3)).isEmpty()


def lattice_table(spark: SparkSession) -> DataFrame:
    """All pairs of states with order, bounds, distance and covering."""
    a, b = F.col("a"), F.col("b")
    pairs = truth_table2(spark, st.weave)
    return pairs.select("a", "b", st.leq(a, b).alias("leq"), st.comparable(a, b).alias("comparable"), F.col("result").alias("meet"), st.overlay(a, b).alias("join"), st.distance(a, b).cast("int").alias("distance"), st.covers(a, b).alias("covers"))


def lattice_properties(spark: SparkSession) -> DataFrame:
    """One row of laws, each checked over all triples of states."""
    t = spark.range(64).select(*[F.shiftright("id", 2 * k).bitwiseAND(3).cast("tinyint").alias(n) for k, n in enumerate("abc")])
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    absorb = (st.weave(a, st.overlay(a, b)) == a) & (st.overlay(a, st.weave(a, b)) == a)
    distributive = st.weave(a, st.overlay(b, c)) == st.overlay(st.weave(a, b), st.weave(a, c))
    modular = ~st.leq(a, c) | (st.overlay(a, st.weave(b, c)) == st.weave(st.overlay(a, b), c))
    complemented = (st.weave(a, st.comp(a)) == 0) & (st.overlay(a, st.comp(a)) == 3)
    return t.agg(F.every(absorb).alias("is_lattice"), F.every(distributive).alias("is_distributive"), F.every(modular).alias("is_modular"), F.every(complemented).alias("is_complemented"), F.countDistinct("a").alias("n_elements"))


def lattice_chains(spark: SparkSession) -> DataFrame:
    """All maximal chains between comparable states, as paths of covers."""
    cover = lattice_table(spark).where("covers").select("a", "b")
    steps = [states(spark).select(F.col("s").alias("a"), F.col("s").alias("b"), F.array("s").alias("chain"))]
    for _ in range(2):
        last = steps[-1].alias("l")
        steps.append(last.join(cover.alias("c"), F.col("l.b") == F.col("c.a")).select(F.col("l.a"), F.col("c.b"), F.concat("l.chain", F.array("c.b")).alias("chain")))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])
