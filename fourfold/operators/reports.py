"""Reports: one row that joins the metrics of an encoding, a threshold's history, or an interpreter."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourfold.functions.scoring import clip
from fourfold.operators import metrics


def _beside(*rows: DataFrame) -> DataFrame:
    """One-row tables next to each other."""
    out = rows[0]
    for r in rows[1:]:
        out = out.join(F.broadcast(r))
    return out


def encoding_quality_report(df: DataFrame, s: str, label: str, feature: str, by: Sequence[str] = (), order: Sequence[str] | None = None, window: int = 10) -> DataFrame:
    """accuracy, discrimination, bits, balance, consistency and overall (their mean, with bits halved).

    Accuracy is the share of rows whose label is their state's most frequent
    one; discrimination is the feature's variance between states over all;
    balance is the entropy over 2 bits; consistency is the mean share of the
    modal state in windows along the feature, within ``by``.
    """
    counts = df.groupBy(s, label).agg(F.count(F.lit(1)).alias("n"))
    accuracy = counts.groupBy(s).agg(F.max("n").alias("best"), F.sum("n").alias("n")).agg((F.sum("best") / F.sum("n")).alias("accuracy"))
    states = df.groupBy(s).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = states.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    bits = states.join(F.broadcast(total)).agg((-F.sum(share * F.log2(share))).alias("bits"))
    each = df.groupBy(s).agg(F.count(F.lit(1)).alias("n"), F.avg(feature).alias("m"), F.var_pop(feature).alias("v"))
    means = each.agg(F.sum(F.col("n") * F.col("v")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("between"))
    ratio = means.select(F.coalesce(F.try_divide(F.col("between"), F.col("between") + F.col("within")), F.lit(0.0)).alias("discrimination"))
    steady = metrics.consistency(df, s, order or [feature], by, window).agg((F.sum(F.col("consistency") * F.col("windows")) / F.sum("windows")).alias("consistency"))
    out = _beside(accuracy, ratio, bits, steady).withColumn("balance", F.col("bits") / 2)
    five = F.col("accuracy") + F.col("discrimination") + F.col("bits") / 2 + F.col("balance") + F.col("consistency")
    return out.select("accuracy", "discrimination", "bits", "balance", "consistency", (five / 5).alias("overall"))


def compare_encoders(df: DataFrame, encoders: dict[str, Column], label: str, feature: str, by: Sequence[str] = (), order: Sequence[str] | None = None) -> DataFrame:
    """The reports of several encodings, with ``winner`` marking the best overall (ties: the first by name)."""
    rows = None
    for name, s in encoders.items():
        one = encoding_quality_report(df.withColumn("__s", s), "__s", label, feature, by, order).withColumn("encoder", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.agg(F.min_by("encoder", F.struct(-F.round("overall", 12), F.col("encoder"))).alias("__best"))
    return rows.join(F.broadcast(best)).withColumn("winner", F.col("encoder") == F.col("__best")).drop("__best")


def stability_score(variance: Column, drift: Column, regimes: Column, adaptation: Column) -> Column:
    """0.3 (1 - variance) + 0.3 (1 - drift / 0.01) + 0.2 regimes + 0.2 adaptation, the first two clipped."""
    return 0.3 * clip(1 - variance) + 0.3 * clip(1 - drift / 0.01) + 0.2 * regimes + 0.2 * adaptation


def adaptation_quality(df: DataFrame, c: str, threshold: str, by: Sequence[str], order: Sequence[str], p: float = 0.5, window: int = 101) -> DataFrame:
    """How closely and smoothly a threshold follows the rolling percentile of the values.

    tracking_error is the mean distance, responsiveness the correlation of the
    two series' steps (0 without variation), smoothness 1 / (1 + variance of
    the threshold's steps), tradeoff the mean of 1 / (1 + error) and smoothness.
    """
    w = metrics.ordered(by, order)
    rows = df.withColumn("__o", F.percentile(c, F.lit(p)).over(w.rowsBetween(1 - window, 0)))
    rows = rows.withColumn("__dt", F.col(threshold) - F.lag(threshold).over(w)).withColumn("__do", F.col("__o") - F.lag("__o").over(w))
    found = rows.groupBy(*by).agg(F.avg(F.abs(F.col(threshold) - F.col("__o"))).alias("tracking_error"), F.coalesce(F.nanvl(F.corr("__dt", "__do"), F.lit(0.0)), F.lit(0.0)).alias("responsiveness"), (1 / (1 + F.coalesce(F.var_pop("__dt"), F.lit(0.0)))).alias("smoothness"))
    return found.withColumn("tradeoff", (1 / (1 + F.col("tracking_error")) + F.col("smoothness")) / 2)


def stability_report(df: DataFrame, c: str, threshold_i: str, threshold_q: str, by: Sequence[str], order: Sequence[str], regime: str | None = None, window: int = 101) -> DataFrame:
    """variance, drift (means over both thresholds), regimes, adaptation and overall for each group of ``by``."""
    w = metrics.ordered(by, order)
    rows = df.withColumn("__i", F.abs(F.col(threshold_i) - F.lag(threshold_i).over(w))).withColumn("__q", F.abs(F.col(threshold_q) - F.lag(threshold_q).over(w)))
    basic = rows.groupBy(*by).agg(((F.var_pop(threshold_i) + F.var_pop(threshold_q)) / 2).alias("variance"), ((F.coalesce(F.avg("__i"), F.lit(0.0)) + F.coalesce(F.avg("__q"), F.lit(0.0))) / 2).alias("drift"))
    adapted = adaptation_quality(df, c, threshold_i, by, order, window=window).select(*by, F.col("tradeoff").alias("adaptation"))
    if regime:
        each = df.groupBy(*by, regime).agg(F.avg(threshold_i).alias("m"), F.var_pop(threshold_i).alias("v")).groupBy(*by).agg(F.avg("v").alias("within"), F.var_pop("m").alias("between"))
        regimes = each.select(*by, F.coalesce(F.try_divide(F.col("between"), F.col("between") + F.col("within")), F.lit(1.0)).alias("regimes"))
    else:
        regimes = basic.select(*by, F.lit(0.0).alias("regimes"))
    out = basic.join(adapted, list(by)).join(regimes, list(by)) if by else _beside(basic, adapted, regimes)
    return out.withColumn("overall", stability_score(F.col("variance"), F.col("drift"), F.col("regimes"), F.col("adaptation")))


def rule_complexity(rules: dict[int, str] | None, method: str = "count") -> float:
    """Rules, the depth of a tree of them, or their conditions; 5 and 3 (depth) where the rules aren't known."""
    if method not in {"count", "depth", "conditions"}:
        raise ValueError(f"unknown method: {method}")
    if rules is None:
        return 3.0 if method == "depth" else 5.0
    return math.log2(max(len(rules), 1)) if method == "depth" else float(len(rules))


def explanation_completeness(df: DataFrame, s: str, decision: str, explained: str | None = None) -> DataFrame:
    """0.5 coverage + 0.2 (0.5 without explanations) + 0.3 mean of length / 100, at most 1, over the states that occur."""
    each = df.groupBy(s).agg(F.max(F.col(decision).isNotNull().cast("double")).alias("has"), *([F.max(F.least(F.length(explained) / 100.0, F.lit(1.0))).alias("quality")] if explained else []))
    if not explained:
        return each.agg((0.5 * F.avg("has") + 0.1).alias("completeness"))
    return each.agg((0.5 * F.avg("has") + 0.2 + 0.3 * F.avg(F.coalesce("quality", F.lit(0.0)))).alias("completeness"))


def explainability_score(df: DataFrame, s: str, decision: str, rules: dict[int, str] | None = None, explained: str | None = None) -> DataFrame:
    """clarity, complexity, completeness, consistency and overall of an interpreter's decisions."""
    clarity = metrics.decision_clarity(df, s, decision).select("clarity")
    complete = explanation_completeness(df, s, decision, explained)
    steady = metrics.interpretation_consistency(df, s, decision).select("consistency")
    out = _beside(clarity, complete, steady).withColumn("complexity", F.lit(rule_complexity(rules)))
    simple = F.greatest(F.lit(0.0), 1 - F.col("complexity") / 10)
    return out.select("clarity", "complexity", "completeness", "consistency", (0.3 * F.col("clarity") + 0.3 * simple + 0.2 * F.col("completeness") + 0.2 * F.col("consistency")).alias("overall"))


def compare_explainability(df: DataFrame, s: str, interpreters: dict[str, tuple[str, dict[int, str] | None]]) -> DataFrame:
    """Reports of several decision columns, with ``winner`` marking the best overall (ties: the first by name)."""
    rows = None
    for name, (decision, rules) in interpreters.items():
        one = explainability_score(df, s, decision, rules).withColumn("interpreter", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.agg(F.min_by("interpreter", F.struct(-F.round("overall", 12), F.col("interpreter"))).alias("__best"))
    return rows.join(F.broadcast(best)).withColumn("winner", F.col("interpreter") == F.col("__best")).drop("__best")
