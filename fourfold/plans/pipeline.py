"""Pipelines: fitted steps that add columns to one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourfold.functions import state as st
from fourfold.operators import adaptive, interpret, learn, quantiles, series
from fourfold.operators.preprocess import Imputer, Outliers, RobustScaler, StandardScaler, Step, series_features, value


@dataclass
class ChannelPipeline:
    """Preprocess the value column, encode it into ``s``, decide into ``decision``.

    ``encoder`` gives two thresholds for a table; ``rules`` or a label column
    (a learned lookup table) give decisions.
    """

    column: str
    steps: list[Step] = field(default_factory=list)
    encoder: Callable[[DataFrame, str], tuple[float, float]] = learn.percentile_thresholds
    rules: dict[int, str] | None = None
    label: str | None = None
    params: dict | None = None
    #: A table transform that gives ``s`` itself (an encoder that follows the rows' order), and one that gives ``decision``.
    encode_rows: Callable[[DataFrame], DataFrame] | None = None
    decide_rows: Callable[[DataFrame], DataFrame] | None = None
    verbose: bool = False

    def fit(self, df: DataFrame) -> ChannelPipeline:
        rows = df
        for s in self.steps:
            rows = s.fit_transform(rows)
        ti, tq = (None, None) if self.encode_rows else self.encoder(rows, self.column)
        self.params = {"threshold_i": ti, "threshold_q": tq, "table": None}
        if self.label:
            coded = self.encode_rows(rows) if self.encode_rows else rows.withColumn("s", st.encode(self.column, ti, tq))
            table = {int(r.s): str(r.decision) for r in interpret.modal_labels(coded, "s", self.label).collect()}
            mode = coded.where(F.col(self.label).isNotNull()).groupBy(self.label).count().orderBy(F.desc("count"), self.label).first()
            self.params["table"] = {k: table.get(k, str(mode[0]) if mode else st.SYMBOLS[k]) for k in range(4)}
        return self

    def transform(self, df: DataFrame, until: str = "interpret") -> DataFrame:
        """The plan up to ``preprocess``, ``encode`` or ``interpret``."""
        if self.params is None:
            raise RuntimeError("the pipeline must be fitted before transform")
        for s in self.steps:
            df = s.transform(df)
        if until == "preprocess":
            return df
        df = self.encode_rows(df) if self.encode_rows else df.withColumn("s", st.encode(self.column, self.params["threshold_i"], self.params["threshold_q"]))
        if until == "encode":
            return df
        return self.decide_rows(df) if self.decide_rows else df.withColumn("decision", interpret.rules("s", self.params["table"] or self.rules))

    def get_stage_output(self, df: DataFrame, stage: str) -> DataFrame:
        """The rows after ``preprocess``, ``encode`` or ``interpret``."""
        if stage not in {"preprocess", "encode", "interpret"}:
            raise ValueError(f"unknown stage: {stage}")
        return self.transform(df, stage)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        out = self.fit(df).transform(df)
        if self.verbose:
            print(self.summary())
        return out

    def summary(self) -> str:
        lines = [f"column {self.column}", *(f"preprocess {type(s).__name__}({', '.join(s.columns)})" for s in self.steps), f"encode {getattr(self.encoder, '__name__', 'encoder')}"]
        return "\n".join([*lines, f"interpret {'lookup by ' + self.label if self.label else 'rules'}", "fitted" if self.params else "not fitted"])


class SeriesFeatures(Step):
    """Features of each group's series, one row a group; the column becomes one of them. Nothing to fit."""

    def __init__(self, column: str, order: list[str], by: list[str], window: int = 10, feature: str = "mean"):
        super().__init__(column)
        self.order, self.by, self.window, self.feature = order, by, window, feature

    def fit(self, df: DataFrame) -> SeriesFeatures:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return series_features(df, self.columns[0], self.order, self.by, self.window).withColumn(self.columns[0], F.col(self.feature))


class PipelineBuilder:
    """Fluent construction of a pipeline over one column."""

    def __init__(self, column: str):
        self._made = ChannelPipeline(column)

    def _step(self, step: Step) -> PipelineBuilder:
        self._made.steps.append(step)
        return self

    def with_missing_data_handling(self, strategy: str = "median") -> PipelineBuilder:
        return self._step(Imputer(self._made.column, strategy=strategy))

    def with_outlier_removal(self, method: str = "clip") -> PipelineBuilder:
        return self._step(Outliers(self._made.column, method=method))

    def with_standard_scaling(self) -> PipelineBuilder:
        return self._step(StandardScaler(self._made.column))

    def with_robust_scaling(self) -> PipelineBuilder:
        return self._step(RobustScaler(self._made.column))

    def with_learned_encoding(self, method: str = "percentile", label: str | None = None) -> PipelineBuilder:
        made = {"percentile": learn.percentile_thresholds, "kmeans": learn.kmeans_thresholds}
        self._made.encoder = made.get(method) or (lambda df, c: learn.supervised_thresholds(df, c, label or "label"))
        return self

    def with_fixed_encoding(self, ti: float = 0.5, tq: float = 0.75) -> PipelineBuilder:
        self._made.encoder = lambda df, c: (ti, tq)
        return self

    def with_time_series_features(self, order: list[str], by: list[str], window: int = 10, feature: str = "mean") -> PipelineBuilder:
        """Features of the value column's series within ``by`` in the order of ``order``; ``feature`` is encoded."""
        return self._step(SeriesFeatures(self._made.column, order, by, window, feature))

    def with_adaptive_encoding(self, order: list[str], by: list[str], alpha: float = 0.01) -> PipelineBuilder:
        """States by thresholds that follow each group's values."""
        self._made.encode_rows = lambda df: adaptive.track_moments(df, self._made.column, by, order, alpha, df.columns)
        return self

    def with_topology_encoding(self, order: list[str], by: list[str], window: int = 1000, every: int = 100) -> PipelineBuilder:
        """States by thresholds that follow the shape of each group's recent values."""
        self._made.encode_rows = lambda df: adaptive.track_shape(df, self._made.column, by, order, window, every, df.columns)
        return self

    def with_score_based_interpretation(self, order: list[str], by: list[str], scores: dict[int, float] | None = None) -> PipelineBuilder:
        """Decisions by a score that adds up over each group's states and fades."""
        self._made.decide_rows = lambda df: series.score_fold(df, "s", by, order, scores or interpret.DEFAULT_SCORES, carry=df.columns)
        return self

    def verbose(self, on: bool = True) -> PipelineBuilder:
        """Print the summary after ``fit_transform``."""
        self._made.verbose = on
        return self

    def with_rule_based_interpretation(self, rules: dict[int, str] | None = None) -> PipelineBuilder:
        self._made.rules = rules
        return self

    def with_lookup_interpretation(self, label: str) -> PipelineBuilder:
        self._made.label = label
        return self

    def build(self) -> ChannelPipeline:
        return self._made


def auto_pipeline(df: DataFrame, column: str, label: str | None = None) -> ChannelPipeline:
    """Steps by one look at the data: imputation where values are missing, clipping where the tails are long; always scaled."""
    x = value(column)
    low, q1, q3, high, missing = quantiles.values(df, *[(x, p) for p in (0.01, 0.25, 0.75, 0.99)], also=[F.count_if(x.isNull())])
    b = PipelineBuilder(column)
    if missing:
        b.with_missing_data_handling()
    if low is not None and high - low > 10 * (q3 - q1):
        b.with_outlier_removal()
    b.with_standard_scaling().with_learned_encoding()
    return (b.with_lookup_interpretation(label) if label else b).build()


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Right-to-left composition of table transforms."""

    def run(df: DataFrame) -> DataFrame:
        for s in reversed(steps):
            df = s(df)
        return df

    return run


def parallel(*steps: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("field_id", "x", "y"), s: str = "s") -> Callable[[DataFrame], DataFrame]:
    """Overlay of several transforms of one field: a union and one aggregate."""

    def run(df: DataFrame) -> DataFrame:
        if not steps:
            return df
        parts = [f(df).select(*keys, s) for f in steps]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy(*keys).agg(F.bit_or(s).alias(s))

    return run
