"""Ordered series: indicators, sequence statistics, folds, drawdown and backtest.

Window functions wherever a frame expresses the operator. Recurrences that
have no frame (EMA, clipped scores, machines, ledgers) fold a group's rows in
order: ``fold`` gathers one key's ordered rows in one value and runs a JVM
higher-order function; ``fold_pandas`` streams them through a Python step and
is the choice for keys whose history doesn't fit in one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from fourfold.sources.tables import written


def ordered(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def full(x: Column, w: WindowSpec, n: int) -> Column:
    """x where the frame of n rows is complete."""
    return F.when(F.count(F.lit(1)).over(w.rowsBetween(1 - n, 0)) == n, x)


def sma(c: str, w: WindowSpec, n: int = 20) -> Column:
    return full(F.avg(c).over(w.rowsBetween(1 - n, 0)), w, n)


def rolling_std(c: str, w: WindowSpec, n: int = 20) -> Column:
    return full(F.stddev_samp(c).over(w.rowsBetween(1 - n, 0)), w, n)


def bollinger(c: str, w: WindowSpec, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    middle, spread = sma(c, w, n), rolling_std(c, w, n)
    return middle + k * spread, middle, middle - k * spread


def rsi(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], n: int = 14, out: str = "rsi") -> DataFrame:
    """100 - 100 / (1 + mean gain / mean loss) over simple rolling means; the first change counts as 0."""
    w = ordered(by, order)
    df = df.withColumn("__d", F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)))
    frame = w.rowsBetween(1 - n, 0)
    gain = F.avg(F.greatest("__d", F.lit(0.0))).over(frame)
    loss = F.avg(F.greatest(-F.col("__d"), F.lit(0.0))).over(frame)
    value = F.when(loss > 0, 100 - 100 / (1 + F.try_divide(gain, loss))).when(gain > 0, F.lit(100.0))
    return df.withColumn(out, full(value, w, n)).drop("__d")


def atr(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int = 14, out: str = "atr", high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    w = ordered(by, order)
    last = F.lag(close).over(w)
    df = df.withColumn("__tr", F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - last), F.abs(F.col(low) - last)))
    return df.withColumn(out, full(F.avg("__tr").over(w.rowsBetween(1 - n, 0)), w, n)).drop("__tr")


def obv(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "obv", close: str = "close", volume: str = "volume") -> DataFrame:
    w = ordered(by, order)
    df = df.withColumn("__v", F.coalesce(F.signum(F.col(close) - F.lag(close).over(w)) * F.col(volume), F.lit(0.0)))
    return df.withColumn(out, F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__v")


def volatility(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], n: int = 19, year: float = 252.0, out: str = "volatility") -> DataFrame:
    """Population deviation of the last n log changes, by year."""
    w = ordered(by, order)
    df = df.withColumn("__r", F.ln(F.col(c) / F.lag(c).over(w)))
    return df.withColumn(out, F.stddev_pop("__r").over(w.rowsBetween(1 - n, 0)) * F.sqrt(F.lit(year))).drop("__r")


def drawdown(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The deepest relative fall below the highest value so far, for each series."""
    top = F.max(c).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__d", (F.col(c) - top) / top).groupBy(*by).agg(F.min("__d").alias("max_drawdown"))


def transitions(df: DataFrame, s: str, by: Sequence[str], order: Sequence[str], n: int = 2) -> DataFrame:
    """Counts of runs of n states that follow each other, as columns s0, s1, ..."""
    w = ordered(by, order)
    grams = df.select(F.col(s).alias("s0"), *[F.lead(s, k).over(w).alias(f"s{k}") for k in range(1, n)])
    return grams.where(F.col(f"s{n - 1}").isNotNull()).groupBy(*[f"s{k}" for k in range(n)]).agg(F.count(F.lit(1)).alias("n"))


def runs(df: DataFrame, test: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Longest run and number of runs of rows where the test holds, for each series (gaps and islands)."""
    w = ordered(by, order)
    rows = df.withColumn("__t", F.coalesce(test, F.lit(False)).cast("int")).withColumn("__n", F.row_number().over(w))
    rows = rows.withColumn("__g", F.col("__n") - F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = rows.groupBy(*by, "__g").agg(F.sum("__t").alias("length"))
    return each.groupBy(*by).agg(F.max("length").alias("longest"), F.count_if(F.col("length") > 0).alias("runs"))


def fold(df: DataFrame, by: Sequence[str], order: Sequence[str], row: Column, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, out: str = "folded") -> DataFrame:
    """The state after each key's ordered rows."""
    rows = F.array_sort(F.collect_list(F.struct(*order, row.alias("__row"))))
    done = F.aggregate(F.transform(rows, lambda r: r["__row"]), start, step, finish) if finish else F.aggregate(F.transform(rows, lambda r: r["__row"]), start, step)
    return df.groupBy(*by).agg(done.alias(out))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "n") -> DataFrame:
    """Rows with their number, from 1, in the order of their key; no task sees all rows of a key.

    Rows are sorted by ranges and stored, and the ranges' counts give where each one starts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    rows = written(dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__key", F.struct(F.lit(0), *by)).withColumn("__part", F.shiftright("__at", 33))
    own = rows.groupBy("__key", "__part").agg(F.count(F.lit(1)).alias("__many"), F.min("__at").alias("__first"))
    before = F.sum("__many").over(Window.partitionBy("__key").orderBy("__part")) - F.col("__many")
    starts = own.select("__key", "__part", (before - F.col("__first") + 1).alias("__shift"))
    same = F.col("r.__key").eqNullSafe(F.col("s.__key")) & (F.col("r.__part") == F.col("s.__part"))
    return rows.alias("r").join(starts.alias("s"), same).select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("__at") + F.col("__shift")).alias(out))


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], step: Callable[[dict, pd.Series], dict], start: Callable[[], dict], outputs: dict[str, str], inputs: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """The state after every row, in order; one pass over each key's rows, which are sorted by the shuffle.

    Rows keep ``by``, ``order``, ``inputs`` and those of ``carry`` that no output replaces.
    """
    keep = list(dict.fromkeys([*by, *order, *inputs, *(c for c in carry if c not in outputs)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields) + ", " + ", ".join(f"`{k}` {t}" for k, t in outputs.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            found: dict[str, list] = {k: [] for k in outputs}
            keys = list(zip(*(batch[c] for c in by), strict=True)) if by else [()] * len(batch)
            columns = [batch[c].tolist() for c in inputs]
            for k, *values in zip(keys, *columns, strict=True):
                if k != key or state is None:
                    key, state = k, start()
                got = step(state, dict(zip(inputs, values, strict=True)))
                for name in outputs:
                    found[name].append(got[name])
            yield batch[keep].assign(**found)

    dealt = df.select(*keep).repartition(*by) if by else df.select(*keep).coalesce(1)
    return dealt.sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def ema(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], spans: dict[str, int]) -> DataFrame:
    """Exponential means with weight 2 / (span + 1), started at the first value; one column for each span."""

    def step(state: dict, row: dict) -> dict:
        x = row[c]
        for name, n in spans.items():
            a = 2.0 / (n + 1)
            state[name] = x if name not in state else (1 - a) * state[name] + a * x
        return state

    return scan(df, by, order, step, dict, {k: "double" for k in spans}, [c])


def macd(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    def step(state: dict, row: dict) -> dict:
        def mean(name: str, x: float, n: int) -> float:
            a = 2.0 / (n + 1)
            state[name] = x if name not in state else (1 - a) * state[name] + a * x
            return state[name]

        line = mean("f", row[c], fast) - mean("s", row[c], slow)
        own = mean("g", line, signal)
        return {"macd": line, "signal": own, "histogram": line - own}

    return scan(df, by, order, step, dict, {"macd": "double", "signal": "double", "histogram": "double"}, [c])


def score_fold(df: DataFrame, s: str, by: Sequence[str], order: Sequence[str], scores: dict[int, float], decay: float = 0.9, bound: float = 10.0, buy: float = 0.7, sell: float = -0.7, carry: Sequence[str] = ()) -> DataFrame:
    """score = clip(decay * score + weight of the state, +-bound) after each row, and its decision."""

    def step(state: dict, row: dict) -> dict:
        state["v"] = max(-bound, min(bound, decay * state.get("v", 0.0) + scores[int(row[s])]))
        return {"score": state["v"], "decision": "buy" if state["v"] >= buy else "sell" if state["v"] <= sell else "hold"}

    return scan(df, by, order, step, dict, {"score": "double", "decision": "string"}, [s], carry)


def accumulate(df: DataFrame, s: str, by: Sequence[str], order: Sequence[str], weights: dict[int, float], threshold: float = 3.0, decay: float = 0.9) -> DataFrame:
    """A decayed sum that fires, and starts again from 0, at the threshold."""

    def step(state: dict, row: dict) -> dict:
        v = decay * state.get("v", 0.0) + weights[int(row[s])]
        fired = v >= threshold
        state["v"] = 0.0 if fired else v
        return {"level": v, "fired": fired}

    return scan(df, by, order, step, dict, {"level": "double", "fired": "boolean"}, [s])


def machine(df: DataFrame, s: str, by: Sequence[str], order: Sequence[str], table: Sequence[tuple[str, int, str, str]], start: str, default: str = "hold") -> DataFrame:
    """A finite-state machine: rows (mode, input state, next mode, action); the first match wins, none keeps the mode."""
    moves: dict[tuple[str, int], tuple[str, str]] = {}
    for mode, code, to, action in table:
        moves.setdefault((mode, code), (to, action))

    def step(state: dict, row: dict) -> dict:
        to, action = moves.get((state.get("mode", start), int(row[s])), (state.get("mode", start), default))
        state["mode"] = to
        return {"mode": to, "action": action}

    return scan(df, by, order, step, dict, {"mode": "string", "action": "string"}, [s])


def backtest(df: DataFrame, by: Sequence[str], order: Sequence[str], price: str = "close", decision: str = "decision", size: str | None = None, capital: float = 10_000.0, commission: float = 0.001) -> DataFrame:
    """Cash, shares and equity after each row: buys spend a share of cash, sells all shares; both pay commission."""
    inputs = [price, decision, *([size] if size else [])]

    def step(state: dict, row: dict) -> dict:
        cash, shares = state.get("cash", capital), state.get("shares", 0.0)
        p, what = row[price], str(row[decision]).lower()
        traded = False
        if what == "buy" and cash > 0:
            spent = cash * (row[size] if size else 1.0)
            bought = spent * (1 - commission) / p
            cash, shares, traded = cash - spent, shares + bought, spent > 0
        elif what == "sell" and shares > 0:
            cash, shares, traded = cash + shares * p * (1 - commission), 0.0, True
        state["cash"], state["shares"] = cash, shares
        return {"cash": cash, "shares": shares, "equity": cash + shares * p, "traded": traded}

    return scan(df, by, order, step, dict, {"cash": "double", "shares": "double", "equity": "double", "traded": "boolean"}, inputs)


def performance(curve: DataFrame, by: Sequence[str], order: Sequence[str], capital: float = 10_000.0, year: float = 252.0) -> DataFrame:
    """Final equity, total return, Sharpe ratio, deepest drawdown and trades of each equity curve."""
    w = ordered(by, order)
    top = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumn("__r", F.col("equity") / F.lag("equity").over(w) - 1).withColumn("__d", (F.col("equity") - top) / top).withColumn("__n", F.row_number().over(w))
    sharpe = F.coalesce(F.try_divide(F.avg("__r") * F.sqrt(F.lit(year)), F.stddev_pop("__r")), F.lit(0.0))
    last = F.max_by("equity", "__n")
    return rows.groupBy(*by).agg(last.alias("final_equity"), (last / capital - 1).alias("total_return"), sharpe.alias("sharpe"), F.min("__d").alias("max_drawdown"), F.count_if("traded").alias("trades"))


def bars(events: DataFrame, ts: str = "ts", tie: str = "event_id", value: str = "value", *by: str) -> DataFrame:
    """Daily open, high, low, close and volume."""
    at = F.struct(ts, tie)
    return events.groupBy(*by, F.to_date(ts).alias("day")).agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
