"""Two applications of the operators: trading signals and patient monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourfold.functions import state as st
from fourfold.operators import series
from fourfold.operators.quantiles import quantiles

# trading


def trading_channels(bars: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Price (close above SMA 20; RSI above 60 or below 40), volume (above MA 50; above 1.5 MA 50) and volatility (ATR 14 above its median; above its 75 %)."""
    w = series.ordered(by, order)
    rows = series.atr(series.rsi(bars, "close", by, order), by, order)
    no = F.lit(False)
    bit = lambda test: F.coalesce(test, no).cast("tinyint")
    mean = series.sma("volume", w, 50)
    rows = rows.withColumn("__ma", mean).withColumn("price", (bit(F.col("close") > series.sma("close", w, 20)) * 2 + bit((F.col("rsi") > 60) | (F.col("rsi") < 40))).cast("tinyint"))
    rows = rows.withColumn("volume_state", (bit(F.col("volume") > F.col("__ma")) * 2 + bit(F.col("volume") > 1.5 * F.col("__ma"))).cast("tinyint")).drop("__ma")
    marks = quantiles(rows, [(F.col("atr"), {"__m": 0.5, "__h": 0.75})], *by)
    rows = rows.join(marks, list(by)) if by else rows.join(F.broadcast(marks))
    return rows.withColumn("volatility_state", (bit(F.col("atr") > F.col("__m")) * 2 + bit(F.col("atr") > F.col("__h"))).cast("tinyint")).drop("__m", "__h")


def signal(price: Column, volume: Column, volatility: Column) -> Column:
    """Struct (action, size, confidence) by the first rule that holds."""
    make = lambda a, n, c: F.struct(F.lit(a).alias("action"), F.lit(n).alias("size"), F.lit(c).alias("confidence"))
    all_psi = (price == 3) & (volume == 3) & (volatility == 3)
    return F.when(all_psi, make("buy", 1.0, 1.0)).when((price == 3) & (volume == 3), make("buy", 0.8, 0.8)).when((price == 0) | (volume == 0) | (volatility == 0), make("sell", 1.0, 0.9)).otherwise(make("hold", 0.0, 0.5))


def adjusted(confidence: Column, regime: Column) -> Column:
    """Confidence by regime, in any case of its name, at most 1."""
    r = F.lower(regime)
    factor = F.when(r == "volatile", 0.8).when(r == "stable", 1.1).when(r == "trending", 1.05).when(r == "transitioning", 0.95).otherwise(1.0)
    return F.least(F.lit(1.0), confidence * factor)


def position_size(capital: Column, price: Column, risk: float = 0.02) -> Column:
    return capital * risk / price


#: The momentum machine (mode, price state, next mode, action).
MOMENTUM = [
    ("waiting", 2, "accumulating", "buy_small"), ("waiting", 3, "holding", "buy"), ("accumulating", 3, "holding", "buy"), ("accumulating", 0, "waiting", "sell"),
    ("accumulating", 1, "waiting", "sell"), ("holding", 2, "distributing", "sell_small"), ("holding", 0, "waiting", "sell"), ("holding", 1, "distributing", "sell_small"),
    ("distributing", 3, "holding", "buy"), ("distributing", 0, "waiting", "sell"),
]


# patients: maps of measurements by name

#: Normal ranges of vital signs.
VITALS = {"temperature": (36.1, 37.2), "heart_rate": (60.0, 100.0), "systolic_bp": (90.0, 120.0), "diastolic_bp": (60.0, 80.0), "oxygen_saturation": (95.0, 100.0)}


def mean_of(m: str | Column) -> Column:
    """Mean of a map's values, null for an empty or missing map."""
    v = F.map_values(F.col(m) if isinstance(m, str) else m)
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v))


def symptoms_state(m: str) -> Column:
    return st.encode(mean_of(m), 0.3, 0.7)


def history_state(m: str) -> Column:
    return st.encode(mean_of(m), 0.5, 0.8)


def tests_state(m: str, abnormal: float = 0.5, critical: float = 0.8) -> Column:
    """Presence where over 30 % of the tests are abnormal, membership where over 20 % are critical."""
    v = F.map_values(F.col(m))
    share = lambda t: F.coalesce(F.try_divide(F.size(F.filter(v, lambda x: x > t)), F.size(v)), F.lit(0.0))
    return ((share(abnormal) > 0.3).cast("tinyint") * 2 + (share(critical) > 0.2).cast("tinyint")).cast("tinyint")


def vitals_state(m: str) -> Column:
    """Presence where a vital sign lies over 10 % outside its range, membership where more than one does."""
    off = F.lit(0)
    for name, (lo, hi) in VITALS.items():
        x = F.try_element_at(F.col(m), F.lit(name))
        off = off + F.coalesce((x < 0.9 * lo) | (x > 1.1 * hi), F.lit(False)).cast("int")
    return ((off > 0).cast("tinyint") * 2 + (off > 1).cast("tinyint")).cast("tinyint")


def diagnosis(symptoms: Column, tests: Column, vitals: Column, history: Column) -> Column:
    """Struct (urgency, recommendation, confidence) by the first rule that holds."""
    each = (symptoms, tests, vitals, history)
    psi = sum(((s == 3).cast("int") for s in each), F.lit(0))
    abnormal = sum((s.isin(2, 3).cast("int") for s in each), F.lit(0))
    make = lambda u, r, c: F.struct(F.lit(u).alias("urgency"), F.lit(r).alias("recommendation"), F.lit(c).alias("confidence"))
    return (
        F.when(psi >= 2, make("CRITICAL", "immediate_attention", 0.95)).when((tests == 3) & symptoms.isin(2, 3), make("HIGH", "urgent_care", 0.85))
        .when((vitals == 3) & (history == 3), make("HIGH", "urgent_care", 0.80)).when(abnormal >= 2, make("MEDIUM", "schedule_appointment", 0.7))
        .when(abnormal == 1, make("LOW", "monitor", 0.6)).otherwise(make("LOW", "no_action", 0.9))
    )


def diagnosis_summary(df: DataFrame, urgency: str = "urgency", recommendation: str = "recommendation", confidence: str = "confidence") -> DataFrame:
    """Counts and mean confidence by urgency, by recommendation, and over all, in one pass."""
    sets = df.groupingSets([[urgency], [recommendation], []], urgency, recommendation)
    return sets.agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.grouping_id().cast("int").alias("level"))


def alerts(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "confidence") -> DataFrame:
    """A row for each alert: changed urgency, confidence fallen by over 0.3, and changes of over 0.5."""
    w = series.ordered(by, order)
    rows = df.withColumn("__u", F.lag("urgency").over(w)).withColumn("__d", F.col(value) - F.lag(value).over(w))
    found = F.array_compact(F.array(F.when(F.col("urgency") != F.col("__u"), "URGENCY_CHANGE"), F.when(F.col("__d") < -0.3, "DETERIORATION"), F.when(F.abs("__d") > 0.5, "CRITICAL_CHANGE")))
    return rows.select(*df.columns, F.explode(found).alias("alert"))


def trend(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """First and last value of each series, and which is larger."""
    at = F.struct(*order)
    a, b = F.min_by(value, at), F.max_by(value, at)
    return df.groupBy(*by).agg(a.alias("first"), b.alias("last"), F.when(b > a, "increasing").when(b < a, "decreasing").otherwise("stable").alias("trend"))
