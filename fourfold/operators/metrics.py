"""Quality, stability and explainability of encodings, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourfold.functions import state as st
from fourfold.operators.interpret import modal_labels
from fourfold.operators.series import ordered


def _plogp(share: Column, base: str = "log2") -> Column:
    return -share * (F.log2(share) if base == "log2" else F.ln(share))


def information(df: DataFrame, s: str, *by: str) -> DataFrame:
    """Entropy of the states in bits, and as a share of the possible 2."""
    counts = df.groupBy(*by, s).agg(F.count(F.lit(1)).cast("double").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*(by or (F.lit(0),))))
    bits = F.coalesce(F.sum("__e"), F.lit(0.0))
    return counts.withColumn("__e", _plogp(share)).groupBy(*by).agg(bits.alias("bits"), (bits / 2).alias("balance"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information in bits over the smaller entropy; 0 where that is 0."""
    cells = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    nx, ny = F.sum("n").over(Window.partitionBy("x")), F.sum("n").over(Window.partitionBy("y"))
    rows = cells.select("n", total.alias("t"), nx.alias("nx"), ny.alias("ny"))
    p = F.col("n") / F.col("t")
    agg = rows.agg(F.sum(p * F.log2(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"), F.sum(-p * F.log2(F.col("nx") / F.col("t"))).alias("hx"), F.sum(-p * F.log2(F.col("ny") / F.col("t"))).alias("hy"))
    least = F.least("hx", "hy")
    return agg.select("mi", "hx", "hy", F.when(least > 0, F.greatest(F.lit(0.0), F.col("mi") / least)).otherwise(0.0).alias("normalised"))


def accuracy(df: DataFrame, s: str, label: str, method: str = "state_label") -> DataFrame:
    """Share of labels that the state tells: its modal label, psi as positive, or the presence bit."""
    rows = df.where(F.col(label).isNotNull())
    if method == "state_label":
        guess = rows.join(F.broadcast(modal_labels(rows, s, label)), s)
        return guess.agg(F.avg((F.col("decision") == F.col(label)).cast("double")).alias("accuracy"))
    bit = (F.col(s) == 3).cast("int") if method == "psi_positive" else st.i_bit(s).cast("int")
    return rows.agg(F.avg((bit == F.col(label).cast("int")).cast("double")).alias("accuracy"))


def variance_ratio(df: DataFrame, s: str, c: str) -> DataFrame:
    """Variance between states over all variance; 1 where nothing varies within states."""
    each = df.groupBy(s).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n") - mean * mean
    within = F.sum(F.col("n") * F.col("v")) / F.sum("n")
    return each.agg(between.alias("between"), within.alias("within")).select("between", "within", F.when(F.col("within") == 0, F.lit(1.0)).otherwise(F.col("between") / (F.col("between") + F.col("within"))).alias("ratio"))


def consistency(df: DataFrame, s: str, order: Sequence[str], by: Sequence[str], window: int = 10) -> DataFrame:
    """Mean share of the modal state in sliding windows over rows in the order of a feature."""
    w = ordered(by, order)
    frame = w.rowsBetween(0, window - 1)
    shares = F.greatest(*[F.sum((F.col(s) == k).cast("int")).over(frame) for k in range(4)]) / F.lit(float(window))
    rows = df.withColumn("__c", F.count(F.lit(1)).over(frame)).withColumn("__m", shares)
    return rows.where(F.col("__c") == window).groupBy(*by).agg(F.avg("__m").alias("consistency"), F.count(F.lit(1)).alias("windows"))


def overall_quality(discrimination: Column, bits: Column, balance: Column, steady: Column) -> Column:
    return 0.3 * discrimination + 0.25 * bits / 2 + 0.25 * balance + 0.2 * steady


def threshold_stability(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], window: int = 50) -> DataFrame:
    """Variance, mean absolute change, range and mean rolling variance of a threshold's history."""
    w = ordered(by, order)
    frame = w.rowsBetween(1 - window, 0)
    rows = df.withColumn("__d", F.abs(F.col(c) - F.lag(c).over(w))).withColumn("__v", F.when(F.count(F.lit(1)).over(frame) == window, F.var_pop(c).over(frame)))
    return rows.groupBy(*by).agg(F.var_pop(c).alias("variance"), F.coalesce(F.avg("__d"), F.lit(0.0)).alias("drift"), (F.max(c) - F.min(c)).alias("range"), F.avg("__v").alias("rolling_variance"))


def regime_consistency(df: DataFrame, c: str, regime: str) -> DataFrame:
    """Mean variance within regimes against the variance of their means; 1 where both are 0."""
    each = df.groupBy(regime).agg(F.avg(c).alias("m"), F.var_pop(c).alias("v"))
    agg = each.agg(F.avg("v").alias("within"), F.var_pop("m").alias("between"))
    total = F.col("within") + F.col("between")
    return agg.select("within", "between", F.when(total > 0, F.col("between") / total).otherwise(1.0).alias("consistency"))


def tracking_error(df: DataFrame, c: str, threshold: str, by: Sequence[str], order: Sequence[str], p: float = 0.5, window: int = 101) -> DataFrame:
    """Mean distance of a threshold from the rolling percentile of the values."""
    frame = ordered(by, order).rowsBetween(1 - window, 0)
    rows = df.withColumn("__t", F.abs(F.col(threshold) - F.percentile(c, F.lit(p)).over(frame)))
    return rows.groupBy(*by).agg(F.avg("__t").alias("tracking_error"), F.max("__t").alias("worst"))


def mann_whitney(df: DataFrame, c: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """U of the rows with group 1 against 0, with tied ranks, and its z score (normal approximation)."""
    w, own = Window.partitionBy(*by, c), Window.partitionBy(*by).orderBy(c)
    rows = df.withColumn("__r", F.rank().over(own) + (F.count(F.lit(1)).over(w) - 1) / 2.0).withColumn("__t", F.count(F.lit(1)).over(w))
    one = F.col(group) == 1
    agg = rows.groupBy(*by).agg(F.count_if(one).cast("double").alias("n1"), F.count_if(~one).cast("double").alias("n0"), F.sum(F.when(one, F.col("__r"))).alias("rs"), F.sum(F.col("__t").cast("double") * F.col("__t") - 1).alias("ties"))
    n = F.col("n1") + F.col("n0")
    u = F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return agg.select(*by, "n1", "n0", u.alias("u"), F.coalesce(F.try_divide(u - F.col("n1") * F.col("n0") / 2, sd), F.lit(0.0)).alias("z"))


def drift(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], window: int = 50, z: float = 1.96) -> DataFrame:
    """Adjacent windows (half a window apart) whose values differ by the rank test."""
    half = max(1, window // 2)
    rows = df.withColumn("__n", F.row_number().over(ordered(by, order)) - 1).withColumn("__b", F.expr(f"cast(__n div {half} as long)"))
    spans = rows.withColumn("start", F.explode(F.array(*[F.col("__b") - k for k in range(4)]))).where("start >= 0").withColumn("later", (F.col("__b") >= F.col("start") + 2).cast("int"))
    full = spans.withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(*by, "start"))).where(F.col("__all") == 4 * half)
    return mann_whitney(full, c, "later", [*by, "start"]).withColumn("drifted", F.abs("z") > z)


def decision_clarity(df: DataFrame, s: str, decision: str) -> DataFrame:
    """Share of states with one decision, coverage of the four states, and their mix."""
    each = df.groupBy(s).agg(F.countDistinct(decision).alias("d"))
    ambiguous = F.avg((F.col("d") > 1).cast("double"))
    single = F.avg(1.0 / F.greatest(F.col("d"), F.lit(1)))
    cover = F.count(F.lit(1)) / 4.0
    return each.agg(ambiguous.alias("ambiguity"), single.alias("determinism"), cover.alias("coverage"), (0.3 * (1 - ambiguous) + 0.4 * single + 0.3 * cover).alias("clarity"))


def interpretation_consistency(df: DataFrame, s: str, decision: str) -> DataFrame:
    """Share of equal decisions among rows whose states differ by one bit; 0.5 without such rows."""
    counts = df.groupBy(F.col(s).alias("s"), F.col(decision).alias("d")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    a, b = counts.alias("a"), F.broadcast(counts).alias("b")
    pairs = a.join(b, (F.col("a.s") < F.col("b.s")) & (st.distance("a.s", "b.s") == 1))
    both = F.col("a.n") * F.col("b.n")
    return pairs.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("a.d") == F.col("b.d"), both).otherwise(0.0)), F.sum(both)), F.lit(0.5)).alias("consistency"))


def explanation(s: Column, decision: Column, detail: str = "medium") -> Column:
    """A sentence for a state and its decision."""
    why = F.element_at(F.array(*map(F.lit, ("nothing is there", "it is expected but absent", "it is there but not validated", "it is there and validated"))), s.cast("int") + 1)
    short = F.concat(F.lit("Decision "), decision)
    if detail == "brief":
        return short
    medium = F.concat(short, F.lit(": state "), st.symbol(s), F.lit(", "), why)
    return medium if detail == "medium" else F.concat(medium, F.format_string(" (presence %d, membership %d)", st.i_bit(s).cast("int"), st.q_bit(s).cast("int")))
