"""Lazy field queries: a list of named steps that becomes one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourfold.functions import state as st
from fourfold.operators import fields
from fourfold.sources.tables import written

_POINT = ("gate", "admit", "comp", "neg_i", "neg_q")
_NEAR = {"dilate": fields.dilate, "erode": fields.erode, "smooth": fields.smooth, "detect_boundaries": lambda df, radius=1: fields.boundaries(df)}


@dataclass(frozen=True)
class FieldQuery:
    """Steps over a field; nothing runs before ``compute`` makes the plan.

    Runs of point operations are folded into one table of four states, so any
    chain of them costs one expression, and none where it is the identity.
    """

    source: DataFrame
    steps: tuple[tuple[str, object], ...] = field(default=())

    def _with(self, name: str, arg: object = None) -> FieldQuery:
        return replace(self, steps=(*self.steps, (name, arg)))

    def where(self, predicate: Callable[[Column], Column]) -> FieldQuery:
        """Cells that don't match become empty; rows stay."""
        return self._with("where", predicate)

    def select(self, projection: Callable[[Column], Column]) -> FieldQuery:
        return self._with("select", projection)

    def apply(self, step: Callable[[DataFrame], DataFrame]) -> FieldQuery:
        return self._with("apply", step)

    def gate(self) -> FieldQuery:
        return self._with("gate")

    def admit(self) -> FieldQuery:
        return self._with("admit")

    def comp(self) -> FieldQuery:
        return self._with("comp")

    def dilate(self, radius: int = 1) -> FieldQuery:
        return self._with("dilate", radius)

    def erode(self, radius: int = 1) -> FieldQuery:
        return self._with("erode", radius)

    def smooth(self, radius: int = 1) -> FieldQuery:
        return self._with("smooth", radius)

    def detect_boundaries(self) -> FieldQuery:
        return self._with("detect_boundaries", 1)

    def overlay(self, other: FieldQuery | DataFrame) -> FieldQuery:
        return self._with("overlay", other)

    def weave(self, other: FieldQuery | DataFrame) -> FieldQuery:
        return self._with("weave", other)

    def optimised(self) -> tuple[tuple[str, object], ...]:
        out: list[tuple[str, object]] = []
        for name, arg in self.steps:
            if name in _POINT:
                before = out.pop()[1] if out and out[-1][0] == "point" else ()
                out.append(("point", (*before, name)))
            else:
                out.append((name, arg))
        return tuple(x for x in out if x[0] != "point" or st.simplify(x[1]) != st.TABLES["identity"])

    def compute(self) -> DataFrame:
        df = self.source
        for name, arg in self.optimised():
            if name == "point":
                df = df.withColumn("s", st.chain(arg)(F.col("s")))
            elif name == "where":
                df = df.withColumn("s", F.when(arg(F.col("s")), F.col("s")).otherwise(st.lit(0)))
            elif name == "select":
                df = df.withColumn("s", arg(F.col("s")).cast("tinyint"))
            elif name in {"overlay", "weave"}:
                other = arg.compute() if isinstance(arg, FieldQuery) else arg
                both = df.join(other.select(*fields.KEY, F.col("s").alias("__o")), list(fields.KEY))
                df = both.withColumn("s", (st.overlay if name == "overlay" else st.weave)("s", "__o")).drop("__o")
            elif name == "apply":
                df = arg(df)
            else:
                df = _NEAR[name](df, arg)
        return df

    @property
    def padding(self) -> int:
        """Cells around a region that its result depends on; -1 where a step isn't known to be local."""
        total = 0
        for name, arg in self.steps:
            if name == "apply":
                return -1
            if name in {"overlay", "weave"} and isinstance(arg, FieldQuery):
                inner = arg.padding
                if inner < 0:
                    return -1
                total = max(total, inner)
            elif name in _NEAR:
                total += arg
        return total

    def materialize_region(self, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
        """The result in a half-open rectangle, in the field's own coordinates.

        Only the rectangle and its padding are read, so the filter reaches the
        source; at the field's own edges the padding ends with the field.
        """
        inside = lambda df, p: df.where(F.col("x").between(x0 - p, x1 - 1 + p) & F.col("y").between(y0 - p, y1 - 1 + p))
        if self.padding < 0:
            return inside(self.compute(), 0)
        cut_steps = tuple((n, replace(a, source=inside(a.source, self.padding)) if isinstance(a, FieldQuery) else a) for n, a in self.steps)
        return inside(replace(self, source=inside(self.source, self.padding), steps=cut_steps).compute(), 0)

    def materialize_all(self) -> DataFrame:
        """The whole result, written once and read back."""
        return written(self.compute())

    def stream_rows(self, rows: int = 64) -> Iterator[DataFrame]:
        """The result in bands of ``rows`` lines, each computed on its own with its padding."""
        lo, hi, left, right = self.source.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
        for y in range(lo, hi + 1, rows) if lo is not None else ():
            yield self.materialize_region(left, right + 1, y, min(y + rows, hi + 1))

    def estimate_memory_mb(self) -> float:
        """Two bytes a cell."""
        return self.source.count() * 2 / 1e6

    def explain(self) -> str:
        show = lambda steps: " -> ".join(n if n != "point" else f"point{st.simplify(a)}" for n, a in steps) or "nothing"
        return f"steps: {show(self.steps)}\nafter folding: {show(self.optimised())}"


def query(df: DataFrame) -> FieldQuery:
    return FieldQuery(df)
