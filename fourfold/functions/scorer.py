"""Scorers with named dimensions: columns of scores, their combination, explanations and a recorded history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourfold.functions import scoring


@dataclass(frozen=True)
class ScoreDimension:
    """A name, an expression over the rows of a table, and a weight."""

    name: str
    scorer: Callable[[], Column]
    weight: float = 1.0
    description: str = ""

    def score(self) -> Column:
        """The score clipped to [0, 1]; 0.5 where the expression gives null."""
        x = self.scorer()
        return F.when(x.isNull(), 0.5).otherwise(scoring.clip(x))


class FeatureScorer:
    """Dimensions that are scored together in one projection."""

    def __init__(self, *dimensions: ScoreDimension):
        self.dimensions = {d.name: d for d in dimensions}

    def add_dimension(self, name: str, scorer: Callable[[], Column], weight: float = 1.0, description: str = "") -> FeatureScorer:
        self.dimensions[name] = ScoreDimension(name, scorer, weight, description)
        return self

    def scores(self) -> dict[str, Column]:
        return {n: d.score() for n, d in self.dimensions.items()}

    def score_feature(self, df: DataFrame) -> DataFrame:
        """``df`` with one column for each dimension."""
        return df.withColumns(self.scores())

    def aggregate_scores(self, scores: dict[str, Column], method: str = "weighted_average") -> Column:
        return scoring.combine(scores, {n: d.weight for n, d in self.dimensions.items()}, method)

    def score_and_aggregate(self, df: DataFrame, method: str = "weighted_average", out: str = "score") -> DataFrame:
        return self.score_feature(df).withColumn(out, self.aggregate_scores({n: F.col(n) for n in self.dimensions}, method))

    def explain_score(self, df: DataFrame, out: str = "explanation") -> DataFrame:
        """A line for the total and one for each dimension, best first; ties go by name."""
        scored = self.score_and_aggregate(df, out="__total")
        line = lambda n, d: F.struct((-F.col(n)).alias("k"), F.lit(n).alias("n"), F.concat(F.lit(f"{n}: "), scoring.fixed(F.col(n)), F.lit(f" (weight {d.weight:g})" + (f" - {d.description}" if d.description else ""))).alias("t"))
        lines = F.transform(F.array_sort(F.array(*[line(n, d) for n, d in self.dimensions.items()])), lambda x: x["t"])
        return scored.withColumn(out, F.array_join(F.concat(F.array(F.concat(F.lit("overall: "), scoring.fixed(F.col("__total")))), lines), "\n")).drop("__total")

    def record_score(self, df: DataFrame, path: str, outcome: str | None = None) -> None:
        """Append the scores of a table's rows, and their outcomes, to a history of Parquet files."""
        scored = self.score_and_aggregate(df).select(*self.dimensions, "score", (F.col(outcome) if outcome else F.lit(None)).cast("double").alias("outcome"))
        scored.write.mode("append").parquet(path)

    def get_dimension_statistics(self, history: DataFrame, *names: str) -> DataFrame:
        """(dimension, n, mean, std, min, max, median) of a table of recorded scores."""
        names = names or tuple(self.dimensions)
        long = history.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("v")) for n in names])).alias("x")).select("x.*")
        stats = [F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile("v", F.lit(0.5)).alias("median")]
        return long.groupBy("dimension").agg(*stats)


def preset(name: str, **scorers: Callable[[], Column]) -> FeatureScorer:
    """A scorer with the dimensions and weights of a preset; ``scorers`` gives each dimension's expression."""
    weights = scoring.PRESETS[name]
    if set(scorers) != set(weights):
        raise ValueError(f"{name} needs the dimensions {', '.join(weights)}")
    return FeatureScorer(*[ScoreDimension(n, scorers[n], w) for n, w in weights.items()])


def create_trading_scorer(strength: Callable[[], Column], confidence: Callable[[], Column], timeliness: Callable[[], Column], stability: Callable[[], Column]) -> FeatureScorer:
    return preset("trading", strength=strength, confidence=confidence, timeliness=timeliness, stability=stability)


def create_medical_scorer(diagnostic_value: Callable[[], Column], measurement_quality: Callable[[], Column], consistency: Callable[[], Column]) -> FeatureScorer:
    return preset("medical", diagnostic_value=diagnostic_value, measurement_quality=measurement_quality, consistency=consistency)


def create_signal_scorer(signal_strength: Callable[[], Column], noise_level: Callable[[], Column], temporal_stability: Callable[[], Column], local_density: Callable[[], Column]) -> FeatureScorer:
    return preset("signal", signal_strength=signal_strength, noise_level=noise_level, temporal_stability=temporal_stability, local_density=local_density)
