"""Combinators: functions of states lifted to fields, composed, and run as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourfold.functions import state as st
from fourfold.operators import fields
from fourfold.plans import pipeline as plans

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class PointCombinator:
    """A function of one state; a chain of them is one expression."""

    f: st.Op

    def __call__(self, s: str | Column) -> Column:
        return self.f(st.col(s))

    def apply_to_field(self, df: DataFrame, s: str = "s") -> DataFrame:
        return df.withColumn(s, self(s).cast("tinyint"))

    def compose(self, inner: PointCombinator) -> PointCombinator:
        """This one after ``inner``."""
        return PointCombinator(lambda s: self.f(inner.f(s)))


@dataclass(frozen=True)
class FieldCombinator:
    """A transform of a whole field."""

    f: Transform

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.f(df)

    def compose(self, inner: FieldCombinator) -> FieldCombinator:
        return FieldCombinator(plans.compose(self.f, inner.f))

    def parallel(self, other: FieldCombinator) -> FieldCombinator:
        """Overlay of both results."""
        return FieldCombinator(plans.parallel(self.f, other.f))


@dataclass(frozen=True)
class NeighborhoodCombinator:
    """A state from the counts n0 to n3 of the states around a cell (square of ``radius``)."""

    rule: Callable[[DataFrame], Column]
    radius: int = 1
    exclude: str = "cell"

    def __call__(self, df: DataFrame) -> DataFrame:
        near = fields.around(df, self.radius, self.exclude)
        return near.withColumn("s", self.rule(near).cast("tinyint")).select(*fields.KEY, "s")


@dataclass(frozen=True)
class ReductionCombinator:
    """A field as one state, by an aggregate that is associative: bits or-ed (overlay) or and-ed (weave)."""

    how: str = "overlay"
    initial: int = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        return fields.reduce(df, self.how, self.initial)


@dataclass(frozen=True)
class BinaryFieldCombinator:
    """A function of two states, applied where both fields have the cell."""

    f: Callable[[Column, Column], Column]

    def __call__(self, a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.select(*fields.KEY, F.col("s").alias("__b")), list(fields.KEY))
        return both.withColumn("s", self.f(F.col("s"), F.col("__b")).cast("tinyint")).drop("__b")


def lift_point_to_field(f: st.Op) -> FieldCombinator:
    return FieldCombinator(PointCombinator(f).apply_to_field)


def lift_binary_to_field(f: Callable[[Column, Column], Column]) -> BinaryFieldCombinator:
    return BinaryFieldCombinator(f)


def spatial_filter(keep: Callable[[Column, Column], Column]) -> FieldCombinator:
    """Cells whose place (x, y) doesn't match become empty."""
    return FieldCombinator(lambda df: df.withColumn("s", F.when(keep(F.col("x"), F.col("y")), F.col("s")).otherwise(st.lit(0))))


class Pipeline:
    """A field and the transforms applied to it so far; lazy until the field is read."""

    def __init__(self, df: DataFrame):
        self._df = df

    def apply(self, f: Transform) -> Pipeline:
        return Pipeline(f(self._df))

    def apply_if(self, condition: bool | Callable[[DataFrame], bool], f: Transform) -> Pipeline:
        """``condition`` may look at the field; then its plan runs here."""
        return self.apply(f) if (condition(self._df) if callable(condition) else condition) else self

    def parallel(self, *fs: Transform) -> Pipeline:
        return self.apply(plans.parallel(*fs))

    def get(self) -> DataFrame:
        return self._df


def edge_detection_pipeline(df: DataFrame) -> DataFrame:
    """Smoothing, then the cells beside other states."""
    return Pipeline(df).apply(fields.smooth).apply(fields.boundaries).get()


def feature_extraction_pipeline(df: DataFrame, radius: int = 1) -> DataFrame:
    """Gated, dilated, then eroded cells: spots that hold together."""
    return Pipeline(df).apply(lift_point_to_field(st.gate)).apply(lambda d: fields.dilate(d, radius)).apply(lambda d: fields.erode(d, radius)).get()
