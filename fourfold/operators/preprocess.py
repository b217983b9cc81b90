"""Scaling, imputation, outliers and series features: fit is an aggregate, transform a projection.

Fitted numbers stay on the driver as literals (a row a column), so transform
adds no join. NULL and NaN both count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourfold.functions.checks import fitted
from fourfold.operators import quantiles


def value(c: str | Column) -> Column:
    """The column as a double, NaN read as null."""
    c = F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    return F.when(~F.isnan(c), c)


class Step:
    """A preprocessing step over named columns."""

    def __init__(self, *columns: str):
        self.columns = list(columns)
        self.params: dict[str, dict[str, float | None]] | None = None

    def stats(self, c: str) -> dict[str, Column]:
        return {}

    def percentiles(self) -> dict[str, float]:
        return {}

    def derived(self, p: dict[str, float | None]) -> dict[str, float | None]:
        return p

    def fit(self, df: DataFrame) -> Step:
        points = [(c, k, q) for c in self.columns for k, q in self.percentiles().items()]
        wanted = {(c, k): x for c in self.columns for k, x in self.stats(c).items()}
        got = quantiles.values(df, *[(value(c), q) for c, _, q in points], also=list(wanted.values()))
        self.params = {c: {} for c in self.columns}
        for (c, k), x in zip([(c, k) for c, k, _ in points] + list(wanted), got, strict=True):
            self.params[c][k] = x
        self.params = {c: self.derived(p) for c, p in self.params.items()}
        return self

    def expr(self, c: str) -> Column:
        return F.col(c)

    @fitted
    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expr(c) for c in self.columns})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def _or(x: float | None, other: float) -> float:
    return other if x is None or x != x or x == 0 else float(x)


class StandardScaler(Step):
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""

    def stats(self, c):
        return {"mean": F.avg(value(c)), "std": F.stddev_pop(value(c))}

    def expr(self, c):
        p = self.params[c]
        return (value(c) - F.lit(p["mean"]).cast("double")) / F.lit(_or(p["std"], 1.0))


class RobustScaler(Step):
    """(x - median) / interquartile range; a range of 0 counts as 1."""

    def percentiles(self):
        return {"median": 0.5, "q1": 0.25, "q3": 0.75}

    def derived(self, p):
        return {"median": p["median"], "iqr": None if p["q1"] is None else p["q3"] - p["q1"]}

    def expr(self, c):
        p = self.params[c]
        return (value(c) - F.lit(p["median"]).cast("double")) / F.lit(_or(p["iqr"], 1.0))


class MinMaxScaler(Step):
    """Into [low, high]; a constant column becomes low."""

    def __init__(self, *columns: str, low: float = 0.0, high: float = 1.0):
        super().__init__(*columns)
        self.low, self.high = low, high

    def stats(self, c):
        return {"min": F.min(value(c)), "max": F.max(value(c))}

    def expr(self, c):
        p = self.params[c]
        width = _or((p["max"] or 0.0) - (p["min"] or 0.0), 1.0)
        return (value(c) - F.lit(p["min"]).cast("double")) / F.lit(width) * F.lit(self.high - self.low) + F.lit(self.low)


class Imputer(Step):
    """mean, median, most_frequent (ties: smallest), constant or drop."""

    def __init__(self, *columns: str, strategy: str = "median", constant: float = 0.0):
        super().__init__(*columns)
        if strategy not in {"mean", "median", "most_frequent", "constant", "drop"}:
            raise ValueError(f"unknown strategy {strategy}")
        self.strategy, self.constant = strategy, constant

    def stats(self, c):
        return {"mean": {"fill": F.avg(value(c))}, "most_frequent": {"fill": F.mode(value(c), True)}}.get(self.strategy, {})

    def percentiles(self):
        return {"fill": 0.5} if self.strategy == "median" else {}

    def expr(self, c):
        fill = self.constant if self.strategy == "constant" else self.params[c].get("fill")
        return F.coalesce(value(c), F.lit(fill).cast("double"))

    @fitted
    def transform(self, df):
        if self.strategy == "drop":
            keep = F.lit(True)
            for c in self.columns:
                keep = keep & value(c).isNotNull()
            return df.where(keep)
        return super().transform(df)


class Outliers(Step):
    """clip (or winsorize), remove, or flag values outside bounds: percentiles, z scores or IQR fences.

    Missing values are never outliers.
    """

    def __init__(self, *columns: str, method: str = "clip", bounds: str = "percentile", low: float = 0.01, high: float = 0.99, width: float = 3.0):
        super().__init__(*columns)
        if bounds not in {"percentile", "zscore", "iqr"}:
            raise ValueError(f"unknown bounds {bounds}")
        self.method, self.bounds, self.low, self.high, self.width = method, bounds, low, high, width

    def stats(self, c):
        middle, spread = F.avg(value(c)), F.stddev_pop(value(c))
        return {"lo": middle - self.width * spread, "hi": middle + self.width * spread} if self.bounds == "zscore" else {}

    def percentiles(self):
        return {"percentile": {"lo": self.low, "hi": self.high}, "iqr": {"lo": 0.25, "hi": 0.75}}.get(self.bounds, {})

    def derived(self, p):
        if self.bounds != "iqr" or p["lo"] is None:
            return p
        spread = p["hi"] - p["lo"]
        return {"lo": p["lo"] - self.width * spread, "hi": p["hi"] + self.width * spread}

    def expr(self, c):
        p = self.params[c]
        x = value(c)
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(p["lo"]).cast("double")), F.lit(p["hi"]).cast("double")))

    def outside(self, c: str) -> Column:
        p = self.params[c]
        return F.coalesce((value(c) < F.lit(p["lo"]).cast("double")) | (value(c) > F.lit(p["hi"]).cast("double")), F.lit(False))

    @fitted
    def transform(self, df):
        if self.method in {"clip", "winsorize"}:
            return super().transform(df)
        out = F.lit(False)
        for c in self.columns:
            out = out | self.outside(c)
        if self.method == "remove":
            return df.where(~out)
        return df.withColumn("is_outlier", out) if self.method == "flag" else df


def forward_fill(df: DataFrame, c: str, order: list[str], by: list[str], out: str | None = None) -> DataFrame:
    """The last value that isn't missing; leading ones stay missing."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out or c, F.last(value(c), True).over(w))


def backward_fill(df: DataFrame, c: str, order: list[str], by: list[str], out: str | None = None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out or c, F.first(value(c), True).over(w))


def interpolate(df: DataFrame, c: str, order: list[str], by: list[str], out: str | None = None) -> DataFrame:
    """Linear between neighbours by row position; at the ends the nearest value."""
    own = Window.partitionBy(*by).orderBy(*order)
    back, on = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(value(c).isNotNull(), F.struct(F.col("__n").alias("n"), value(c).alias("v")))
    df = df.withColumn("__n", F.row_number().over(own))
    df = df.withColumn("__a", F.last(at, True).over(back)).withColumn("__b", F.first(at, True).over(on))
    a, b, n = F.col("__a"), F.col("__b"), F.col("__n")
    between = a["v"] + (b["v"] - a["v"]) * (n - a["n"]) / F.greatest(b["n"] - a["n"], F.lit(1))
    return df.withColumn(out or c, F.coalesce(between, a["v"], b["v"])).drop("__n", "__a", "__b")


def series_features(df: DataFrame, c: str, order: list[str], by: list[str], window: int = 10) -> DataFrame:
    """For each series: mean, deviation, extremes, slope on position, deviation of rolling deviations, change a row."""
    own = Window.partitionBy(*by).orderBy(*order)
    x = F.col(c).cast("double")
    rows = df.withColumn("__n", F.row_number().over(own) - 1).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    rolling = F.stddev_pop(x).over(own.rowsBetween(0, window - 1))
    rows = rows.withColumn("__r", F.when(F.col("__n") <= F.col("__all") - window, rolling))
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.coalesce(F.regr_slope(x, F.col("__n").cast("double")), F.lit(0.0)).alias("slope"),
        F.when(n >= window, F.stddev_pop("__r")).otherwise(F.stddev_pop(x)).alias("volatility"),
        ((F.max_by(x, "__n") - F.min_by(x, "__n")) / n).alias("momentum"), n.alias("n"),
    )


def shape_features(df: DataFrame, c: str, *by: str) -> DataFrame:
    """For each group: mean, median, deviation, population skewness and excess kurtosis, quartiles, range, IQR."""
    x = F.col(c).cast("double")
    moments = [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.coalesce(F.skewness(x), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis(x), F.lit(0.0)).alias("kurt"), (F.max(x) - F.min(x)).alias("range")]
    out = quantiles.quantiles(df, [(x, {"p25": 0.25, "median": 0.5, "p75": 0.75})], *by, also=moments)
    return out.select(*by, "mean", "median", "std", "skew", "kurt", "p25", "p75", "range", (F.col("p75") - F.col("p25")).alias("iqr"))
