"""Queries on ordered series: indicators, folds, trackers, sequences, streams, applications."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourfold.catalog.core import E, coded, near, table
from fourfold.functions import scoring
from fourfold.functions import state as st
from fourfold.operators import adaptive, apps, interpret, metrics, series, signals
from fourfold.streaming import stateful, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BY, ORDER = ["user_id"], ["ts", "event_id"]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def bars(spark, d):
    """Daily bars of each event type."""
    return series.bars(table(spark, d, "events"), "ts", "event_id", "value", "event_type")


B = """bars as (select event_type, cast(ts as date) as day, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*)::double as volume from events group by all)"""
W = "window w as (partition by event_type order by day)"
K, O = ["event_type"], ["day"]


def full(x: str, n: int) -> str:
    return f"case when count(*) over (w rows between {n - 1} preceding and current row) = {n} then {x} over (w rows between {n - 1} preceding and current row) end"


def r(x: str, n: int = 6) -> str:
    return f"round({x} + 3.21e-11, {n})"


@query(f"with {B} select event_type, day, open, high, low, close, volume from bars")
def daily_bars(spark, d):
    return bars(spark, d)


@query(f"with {B}, x as (select event_type, day, {full('avg(close)', 5)} v from bars {W}) select event_type, day, {r('v')} as sma from x")
def ind_sma(spark, d):
    return bars(spark, d).withColumn("sma", near(series.sma("close", series.ordered(K, O), 5))).select(*K, *O, "sma")


@query(f"with {B}, x as (select event_type, day, {full('avg(close)', 5)} m, {full('stddev_samp(close)', 5)} s from bars {W}) select event_type, day, {r('m + 2 * s')} as upper, {r('m')} as middle, {r('m - 2 * s')} as lower from x")
def ind_bollinger(spark, d):
    up, mid, low = series.bollinger("close", series.ordered(K, O), 5)
    return bars(spark, d).select(*K, *O, near(up).alias("upper"), near(mid).alias("middle"), near(low).alias("lower"))


@query(f"""with {B}, c as (select event_type, day, coalesce(close - lag(close) over w, 0) d from bars {W}),
g as (select event_type, day, count(*) over f n, avg(greatest(d, 0)) over f g, avg(greatest(-d, 0)) over f l from c window f as (partition by event_type order by day rows between 4 preceding and current row))
select event_type, day, {r('case when n = 5 then case when l > 0 then 100 - 100 / (1 + g / l) when g > 0 then 100 end end')} as rsi from g""")
def ind_rsi(spark, d):
    return series.rsi(bars(spark, d), "close", K, O, 5).select(*K, *O, near(F.col("rsi")).alias("rsi"))


@query(f"""with {B}, t as (select event_type, day, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) tr from bars {W})
select event_type, day, {r(full('avg(tr)', 5))} as atr from t {W}""")
def ind_atr(spark, d):
    return series.atr(bars(spark, d), K, O, 5).select(*K, *O, near(F.col("atr")).alias("atr"))


@query(f"""with {B}, t as (select event_type, day, coalesce(sign(close - lag(close) over w) * volume, 0) v from bars {W}) select event_type, day, {r('sum(v) over (w rows unbounded preceding)')} as obv from t {W}""")
def ind_obv(spark, d):
    return series.obv(bars(spark, d), K, O).select(*K, *O, near(F.col("obv")).alias("obv"))


@query(f"""with {B}, t as (select event_type, day, ln(close / lag(close) over w) v from bars {W}) select event_type, day, {r('stddev_pop(v) over (w rows between 4 preceding and current row) * sqrt(252)')} as volatility from t {W}""")
def ind_volatility(spark, d):
    return series.volatility(bars(spark, d), "close", K, O, 5).select(*K, *O, near(F.col("volatility")).alias("volatility"))


@query(f"""with {B}, t as (select event_type, close, max(close) over (w rows unbounded preceding) m from bars {W}) select event_type, {r('min((close - m) / m)')} as max_drawdown from t group by event_type""")
def max_drawdown(spark, d):
    return series.drawdown(bars(spark, d), "close", K, O).select("event_type", near(F.col("max_drawdown")).alias("max_drawdown"))


NUM = f"""{B}, n as (select *, row_number() over (partition by event_type order by day) rn from bars)"""


@query(f"""with recursive {NUM}, e as (select event_type, day, rn, close as ema from n where rn = 1 union all select n.event_type, n.day, n.rn, (1 - 2.0::double / 6) * e.ema + 2.0::double / 6 * n.close from e join n on n.event_type = e.event_type and n.rn = e.rn + 1)
select event_type, day, {r('ema')} as ema from e""")
def ind_ema(spark, d):
    return series.ema(bars(spark, d), "close", K, O, {"ema": 5}).select(*K, *O, near(F.col("ema")).alias("ema"))


@query(f"""with recursive {NUM}, e as (select event_type, day, rn, close as f, close as s, 0.0::double as g from n where rn = 1
union all select n.event_type, n.day, n.rn, f + 2.0::double / 4 * (n.close - f), s + 2.0::double / 7 * (n.close - s), g + 2.0::double / 5 * ((f + 2.0::double / 4 * (n.close - f)) - (s + 2.0::double / 7 * (n.close - s)) - g) from e join n on n.event_type = e.event_type and n.rn = e.rn + 1)
select event_type, day, {r('f - s')} as macd, {r('g')} as signal, {r('f - s - g')} as histogram from e""")
def ind_macd(spark, d):
    return series.macd(bars(spark, d), "close", K, O, 3, 6, 4).select(*K, *O, *[near(F.col(c)).alias(c) for c in ("macd", "signal", "histogram")])


NUMBERED = f"{E}, n as (select *, row_number() over (partition by user_id order by ts, event_id) rn from events_s)"


@query(f"""with recursive {NUMBERED}, f as (select user_id, event_id, rn, (case s when 3 then 1.0 when 2 then 0.3 when 1 then -0.3 else -1.0 end)::double score from n where rn = 1
union all select n.user_id, n.event_id, n.rn, greatest(-10, least(10, 0.9::double * f.score + (case n.s when 3 then 1.0 when 2 then 0.3 when 1 then -0.3 else -1.0 end)::double)) from f join n on n.user_id = f.user_id and n.rn = f.rn + 1)
select event_id, {r('score')} as score, case when score >= 0.7 then 'buy' when score <= -0.7 then 'sell' else 'hold' end as decision from f""")
def score_fold(spark, d):
    out = series.score_fold(coded(spark, d), "s", BY, ORDER, interpret.DEFAULT_SCORES)
    return out.select("event_id", near(F.col("score")).alias("score"), "decision")


@query(f"""with recursive {NUMBERED}, m as (select * from (values ('idle', 3, 'active', 'start'), ('idle', 2, 'watch', 'look'), ('watch', 3, 'active', 'start'), ('watch', 0, 'idle', 'drop'), ('active', 0, 'idle', 'stop')) as t(mode, s, nxt, action)),
f as (select n.user_id, event_id, rn, coalesce(nxt, 'idle') mode, coalesce(action, 'hold') action from n left join m on m.mode = 'idle' and m.s = n.s where rn = 1
union all select n.user_id, n.event_id, n.rn, coalesce(m.nxt, f.mode), coalesce(m.action, 'hold') from f join n on n.user_id = f.user_id and n.rn = f.rn + 1 left join m on m.mode = f.mode and m.s = n.s)
select event_id, mode, action from f""")
def fsm_fold(spark, d):
    moves = [("idle", 3, "active", "start"), ("idle", 2, "watch", "look"), ("watch", 3, "active", "start"), ("watch", 0, "idle", "drop"), ("active", 0, "idle", "stop")]
    return series.machine(coded(spark, d), "s", BY, ORDER, moves, "idle").select("event_id", "mode", "action")


@query(f"""with recursive {NUMBERED}, w as (select *, (case s when 3 then 1.0 when 2 then 0.6 when 1 then 0.3 else 0.0 end)::double v from n), f as (select user_id, event_id, rn, v as level, v >= 3 as fired from w where rn = 1
union all select w.user_id, w.event_id, w.rn, 0.9::double * case when f.fired then 0 else f.level end + w.v, 0.9::double * case when f.fired then 0 else f.level end + w.v >= 3 from f join w on w.user_id = f.user_id and w.rn = f.rn + 1)
select event_id, {r('level')} as level, fired from f""")
def accumulator_fold(spark, d):
    out = series.accumulate(coded(spark, d), "s", BY, ORDER, {3: 1.0, 2: 0.6, 1: 0.3, 0: 0.0})
    return out.select("event_id", near(F.col("level")).alias("level"), "fired")


@query(f"with {E} select user_id, cast(sum(s) as bigint) as total, string_agg(cast(s as varchar), '' order by ts, event_id) as path from events_s group by user_id")
def fold_states(spark, d):
    """The JVM fold: all states of a user in order, as one text and their sum."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit("").alias("path"))
    step = lambda a, s: F.struct((a["total"] + s).alias("total"), F.concat(a["path"], s.cast("string")).alias("path"))
    return series.fold(coded(spark, d), BY, ORDER, F.col("s"), zero, step).select("user_id", "folded.total", "folded.path")


_SIG = f"""with recursive {NUM}, s as (select *, case when close > lag(close) over w and close > lag(close, 2) over w then 'buy' when close < lag(close) over w then 'sell' else 'hold' end decision from n {W}),
f as (select event_type, day, rn, 10000.0::double cash, 0.0::double shares, close, false traded from s where rn = 1 and decision = 'hold'
union all select s.event_type, s.day, s.rn, case when s.decision = 'buy' and f.cash > 0 then 0.0::double when s.decision = 'sell' and f.shares > 0 then f.cash + f.shares * s.close * (1 - 0.001::double) else f.cash end,
case when s.decision = 'buy' and f.cash > 0 then f.shares + f.cash * (1 - 0.001::double) / s.close when s.decision = 'sell' and f.shares > 0 then 0.0::double else f.shares end, s.close, (s.decision = 'buy' and f.cash > 0) or (s.decision = 'sell' and f.shares > 0)
from f join s on s.event_type = f.event_type and s.rn = f.rn + 1)"""


@query(f"{_SIG} select event_type, day, {r('cash', 4)} as cash, {r('cash + shares * close', 4)} as equity, traded from f")
def backtest_fold(spark, d):
    w = series.ordered(K, O)
    up = (F.col("close") > F.lag("close").over(w)) & (F.col("close") > F.lag("close", 2).over(w))
    rows = bars(spark, d).withColumn("decision", F.when(up, "buy").when(F.col("close") < F.lag("close").over(w), "sell").otherwise("hold"))
    out = series.backtest(rows, K, O)
    return out.select(*K, *O, near(F.col("cash"), 4).alias("cash"), near(F.col("equity"), 4).alias("equity"), "traded")


@query()
def backtest_performance(spark, d):
    rows = apps.trading_channels(bars(spark, d), K, O)
    got = apps.signal(F.col("price"), F.col("volume_state"), F.col("volatility_state"))
    curve = series.backtest(rows.withColumn("g", got).withColumn("decision", F.col("g.action")).withColumn("size", F.col("g.size")), K, O, size="size")
    return series.performance(curve, K, O)


@query()
def trading_signals(spark, d):
    rows = apps.trading_channels(bars(spark, d), K, O)
    got = apps.signal(F.col("price"), F.col("volume_state"), F.col("volatility_state"))
    return rows.select(*K, *O, F.col("price").cast("int").alias("price"), F.col("volume_state").cast("int").alias("volume_state"), got["action"].alias("action"), signals.rsi_state(F.col("rsi")).cast("int").alias("rsi_state"))


# sequences


@query(f"with {E}, p as (select s, lead(s) over (partition by user_id order by ts, event_id) b from events_s) select cast(s as int) as s0, cast(b as int) as s1, count(*) as n from p where b is not null group by all")
def transitions(spark, d):
    out = series.transitions(coded(spark, d), "s", BY, ORDER)
    return out.select(F.col("s0").cast("int").alias("s0"), F.col("s1").cast("int").alias("s1"), "n")


@query("""with p as (select role s0, lead(role) over w s1, lead(role, 2) over w s2 from conversations window w as (partition by conv_id order by turn)) select s0, s1, s2, count(*) as n from p where s2 is not null group by all""")
def ngrams(spark, d):
    return series.transitions(table(spark, d, "conversations"), "role", ["conv_id"], ["turn"], 3)


@query(f"""with {E}, n as (select user_id, (s = 0)::int t, row_number() over w rn, sum((s = 0)::int) over (w rows unbounded preceding) c from events_s window w as (partition by user_id order by ts, event_id)),
g as (select user_id, rn - c g, sum(t) l from n group by all) select user_id, cast(max(l) as bigint) as longest, count(*) filter (l > 0) as runs from g group by user_id""")
def longest_gap(spark, d):
    return series.runs(coded(spark, d), F.col("s") == 0, BY, ORDER)


@query(f"""with {E}, l as (select event_id, s, lead(s) over w b from events_s window w as (partition by user_id order by ts, event_id)) select event_id from l where s = 3 and b = 0""")
def find_pattern(spark, d):
    return interpret.find_pattern(coded(spark, d), "s", ORDER, BY, [3, 0]).select("event_id")


@query("""select event_id, case when event_id % 7 = 0 then 'null' when event_id % 11 = 0 then 'nan' when value > 200 then 'too_large' when value < 1 then 'too_small' else 'ok' end as reason,
cast(case when event_id % 7 = 0 or event_id % 11 = 0 then 1 when value > 200 or value < 1 then 2 else 3 end as int) as s from events""")
def missing_rules(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = table(spark, d, "events").select("event_id", v.alias("v"))
    reason = interpret.prioritised([(F.col("v").isNull(), "null"), (F.isnan("v"), "nan"), (F.col("v") > 200, "too_large"), (F.col("v") < 1, "too_small")], "ok")
    s = F.when(reason.isin("null", "nan"), 1).when(reason == "ok", 3).otherwise(2)
    return rows.select("event_id", reason.alias("reason"), s.alias("s"))


@query("select event_type, count(*) as n, count(*) filter (event_id % 7 = 0) as missing, round(count(*) filter (event_id % 7 = 0) / count(*) + 3.21e-11, 6) as rate, count(*) filter (event_id % 7 = 0) / count(*) > 0.14 as alert from events group by event_type")
def missing_rates(spark, d):
    lost = F.count_if(F.col("event_id") % 7 == 0)
    n = F.count(F.lit(1))
    return table(spark, d, "events").groupBy("event_type").agg(n.alias("n"), lost.alias("missing"), near(lost / n).alias("rate"), (lost / n > 0.14).alias("alert"))


@query(f"with {E} select event_id, case when c >= 4 then 'HIGH' when c >= 2 then 'MEDIUM' else 'LOW' end as level from (select event_id, sum((s = 3)::int) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) c from events_s)")
def rolling_psi(spark, d):
    n = F.sum((F.col("s") == 3).cast("int")).over(series.ordered(BY, ORDER).rowsBetween(-4, 0))
    return coded(spark, d).select("event_id", F.when(n >= 4, "HIGH").when(n >= 2, "MEDIUM").otherwise("LOW").alias("level"))


# scores


@query(f"with x as (select event_id, epoch(timestamp '2024-02-01' - ts) age from events) select event_id, {r('power(0.5, age / 86400.0)')} as freshness from x")
def score_freshness(spark, d):
    exact = F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", near(scoring.freshness(exact / 1e6, 86400.0)).alias("freshness"))


@query(f"select user_id, {r('case when count(*) < 3 or avg(value) = 0 then 0.5 else 1 / (1 + stddev_pop(value) / abs(avg(value))) end')} as stability from events group by user_id")
def score_stability(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(near(scoring.stability(F.count(F.lit(1)), F.avg("value"), F.stddev_pop("value"))).alias("stability"))


_NEAR = "count(*) over (partition by event_type order by value range between 5 preceding and 5 following)"


@query(f"with x as (select event_id, {_NEAR} near, count(*) over (partition by event_type) n from events) select event_id, {r('case when n < 10 then 0.5 else least(near / n / 0.2, 1) end')} as density from x")
def score_density(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    rows.createOrReplaceTempView("score_density_rows")
    got = spark.sql("select event_id, count(*) over (partition by event_type order by value range between 5D preceding and 5D following) near, count(*) over (partition by event_type) n from score_density_rows")
    return got.select("event_id", near(scoring.density(F.col("near"), F.col("n"))).alias("density"))


@query(f"""with x as (select event_id, avg((user_id % 2)::double * 2 - 1) over f m, count(*) over f near, count(*) over (partition by event_type) n from events window f as (partition by event_type order by value range between 5 preceding and 5 following))
select event_id, {r('case when n < 10 or near < 5 then 0.5 else least(greatest((m + 1) / 2, 0), 1) end')} as relevance from x""")
def score_relevance(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value", ((F.col("user_id") % 2).cast("double") * 2 - 1).alias("outcome"))
    rows.createOrReplaceTempView("score_relevance_rows")
    got = spark.sql("select event_id, avg(outcome) over f m, count(*) over f near, count(*) over (partition by event_type) n from score_relevance_rows window f as (partition by event_type order by value range between 5D preceding and 5D following)")
    return got.select("event_id", near(scoring.relevance(F.col("m"), F.col("near"), F.col("n"))).alias("relevance"))


_CONF = "least(greatest(least(count(*) / 30.0, 1) * (1 - count(*) filter (event_id % 7 = 0) / count(*)) / (1 + stddev_pop(value) / 100), 0), 1)"


@query(f"select user_id, {r(_CONF)} as confidence from events group by user_id")
def score_confidence(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "events").groupBy("user_id").agg(near(scoring.confidence(n, F.count_if(F.col("event_id") % 7 == 0) / n, F.stddev_pop("value") / 100)).alias("confidence"))


@query(f"""with x as (select user_id, {_CONF} a, case when count(*) < 3 or avg(value) = 0 then 0.5 else 1 / (1 + stddev_pop(value) / abs(avg(value))) end b from events group by user_id)
select user_id, {r('(a * 1.5 + b) / 2.5')} as mean, {r('least(a, b)')} as low, {r('greatest(a, b)')} as high, {r('a * b')} as product from x""")
def score_aggregate(spark, d):
    n = F.count(F.lit(1))
    rows = table(spark, d, "events").groupBy("user_id").agg(scoring.confidence(n, F.count_if(F.col("event_id") % 7 == 0) / n, F.stddev_pop("value") / 100).alias("a"), scoring.stability(n, F.avg("value"), F.stddev_pop("value")).alias("b"))
    own = {"confidence": F.col("a"), "stability": F.col("b")}
    how = {"mean": "weighted_average", "low": "min", "high": "max", "product": "product"}
    return rows.select("user_id", *[near(scoring.combine(own, {"confidence": 1.5}, h)).alias(k) for k, h in how.items()])


# trackers


@query(f"""with recursive n as (select user_id, event_id, value v, row_number() over (partition by user_id order by ts, event_id) rn from events),
f as (select user_id, event_id, rn, v mean, 0.0::double m2, 0.0::double ti, 0.0::double tq, v from n where rn = 1
union all select n.user_id, n.event_id, n.rn, mean + (n.v - mean) / n.rn, m2 + (n.v - mean) * (n.v - (mean + (n.v - mean) / n.rn)), ti + 0.01::double * (mean + (n.v - mean) / n.rn - ti),
tq + 0.01::double * (mean + (n.v - mean) / n.rn + 0.5 * sqrt((m2 + (n.v - mean) * (n.v - (mean + (n.v - mean) / n.rn))) / (n.rn - 1)) - tq), n.v from f join n on n.user_id = f.user_id and n.rn = f.rn + 1)
select event_id, {r('ti')} as threshold_i, {r('tq')} as threshold_q, cast(case when v > ti then 2 else 0 end + case when v > tq then 1 else 0 end as int) as s from f""")
def adaptive_streaming(spark, d):
    out = adaptive.track_moments(table(spark, d, "events"), "value", BY, ORDER)
    return out.select("event_id", near(F.col("threshold_i")).alias("threshold_i"), near(F.col("threshold_q")).alias("threshold_q"), F.col("s").cast("int").alias("s"))


@query()
def adaptive_topology(spark, d):
    return adaptive.track_shape(table(spark, d, "events"), "value", ["event_type"], ORDER).select("event_id", "threshold_i", "threshold_q", "strategy", "modality", "changed")


@query()
def multiscale_regimes(spark, d):
    return adaptive.track_scales(table(spark, d, "events"), "value", ["event_type"], ORDER).select("event_id", "regime", "confidence", "changes", F.col("s").cast("int").alias("s"))


@query("""with p as (select event_type, value low, lead(value) over (partition by event_type order by value) high from events), m as (select event_type, quantile_cont(high - low, 0.5) m from p where high is not null group by 1)
select event_type, low, high from p join m using (event_type) where m > 0 and high - low > 40 * m""")
def topo_gaps(spark, d):
    return adaptive.gaps(table(spark, d, "events"), "value", "event_type", times=40.0)


@query("""with e as (select event_type, min(value) a, max(value) b from events group by 1), c as (select event_type, least(49, floor((value - a) / (b - a) * 50))::int bin, count(*) n from events join e using (event_type) group by all),
g as (select event_type, unnest(range(50))::int bin from e), f as (select g.event_type, g.bin, coalesce(n, 0) n from g left join c using (event_type, bin)),
t as (select event_type, n > lag(n) over w and n > lead(n) over w and n > 0.05 * max(n) over (partition by event_type) t from f window w as (partition by event_type order by bin))
select event_type, greatest(1, count(*) filter (t)) as modality from t group by event_type""")
def topo_histogram_modes(spark, d):
    return adaptive.histogram_modes(table(spark, d, "events"), "value", "event_type")


@query(f"""with m as (select event_type t, avg(value) m, stddev_pop(value) s from events group by 1), a as (select event_type, avg(power((value - m) / s, 3)) sk, kurtosis_pop(value) ku, avg(value) me, stddev_pop(value) sd, quantile_cont(value, 0.5) p50, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) iqr from events join m on t = event_type group by event_type)
select event_type, {r('sk')} as skew, {r('ku')} as kurt, case when ku > 3 then 'heavy_tailed' when abs(sk) > 1 then 'skewed' else 'normal' end as strategy, {r('case when ku > 3 or sk > 1 then p50 when sk < -1 then p50 - 0.5 * iqr else me end')} as threshold_i,
{r('case when ku > 3 then p50 + iqr when sk > 1 then p50 + 1.5 * iqr when sk < -1 then p50 + 0.5 * iqr else me + 0.5 * sd end')} as threshold_q from a""")
def topo_strategy(spark, d):
    out = adaptive.strategy(table(spark, d, "events"), "value", "event_type")
    return out.select("event_type", "strategy", *[near(F.col(c)).alias(c) for c in ("skew", "kurt", "threshold_i", "threshold_q")])


# indicators, patterns and signals as states


@query(f"""with {B}, i as (select event_type, day, close, {full('avg(close)', 5)} m, {full('stddev_samp(close)', 5)} sd from bars {W})
select event_type, day, (case when close > m + sd then 3 when close > m then 2 when close > m - sd then 1 else 0 end)::int as band, (case when close is null then 1 when close between 20 and 80 then 3 when close between 8 and 92 then 2 else 0 end)::int as ranged from i""")
def encode_indicators(spark, d):
    up, mid, low = series.bollinger("close", series.ordered(K, O), 5, 1.0)
    rows = bars(spark, d).select(*K, *O, "close", up.alias("u"), mid.alias("m"), low.alias("l"))
    return rows.select(*K, *O, signals.band_state(F.col("close"), F.col("u"), F.col("m"), F.col("l")).cast("int").alias("band"), signals.range_state(F.col("close"), 20.0, 80.0).cast("int").alias("ranged"))


@query(f"""with {E}, x as (select event_id, s, value v, lag(value) over w - lag(value, 2) over w a, value - lag(value) over w b from events_s window w as (partition by user_id order by ts, event_id)),
p as (select event_id, s, case when a > 0 and b > 0 then case when b > 2 * a then 'accelerating' else 'increasing' end when a < 0 and b < 0 then case when b < 2 * a then 'crashing' else 'decreasing' end when abs(a) + abs(b) > 0.1 * abs(v) then 'volatile' else 'stable' end pattern from x)
select event_id, pattern, (case pattern when 'accelerating' then s | 1 when 'crashing' then s & 2 when 'volatile' then case s when 2 then 0 else s end else s end)::int as s from p""")
def encode_pattern(spark, d):
    rows = signals.recent_pattern(coded(spark, d), "value", BY, ORDER)
    return rows.select("event_id", "pattern", signals.pattern_adjusted(F.col("s"), F.col("pattern")).cast("int").alias("s"))


@query("""with x as (select event_id, value, count(value) over f n, avg(value) over f m, stddev_samp(value) over f s from events window f as (partition by event_type order by ts, event_id rows between 50 preceding and 1 preceding))
select event_id, coalesce(abs(case when n >= 10 and s > 0 then (value - m) / s end) > 3, false) as anomaly from x""")
def signal_anomalies(spark, d):
    return signals.anomalies(table(spark, d, "events"), "value", K, ORDER).select("event_id", "anomaly")


@query("""with x as (select event_id, count(value) over b nb, count(value) over o no, avg(value) over b mb, avg(value) over o mo, stddev_pop(value) over z s from events window b as (partition by event_type order by ts, event_id rows between 20 preceding and 1 preceding), o as (partition by event_type order by ts, event_id rows between current row and 19 following), z as (partition by event_type order by ts, event_id rows between 20 preceding and 19 following))
select event_id, round((mo - mb) / s + 3.21e-11, 6) as shift from x where nb = 20 and no = 20 and abs((mo - mb) / s) > 0.8""")
def signal_change_points(spark, d):
    return signals.change_points(table(spark, d, "events"), "value", K, ORDER, 20, 0.8).select("event_id", near(F.col("shift")).alias("shift"))


@query("""with h as (select l_orderkey, l_linenumber, l_partkey, l_quantity q, case when l_partkey % 9 = 0 then null else l_extendedprice end p from lineitem), r as (select regr_slope(p, q) a, regr_intercept(p, q) b from h)
select l_partkey, round(sum(coalesce(p, a * q + b)) + 3.21e-11, 3) as price from h, r group by l_partkey""")
def impute_predictive(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_quantity", F.when(F.col("l_partkey") % 9 == 0, None).otherwise(F.col("l_extendedprice")).alias("p"))
    return signals.predicted_fill(rows, "p", "l_quantity").groupBy("l_partkey").agg(near(F.sum("p"), 3).alias("price"))


# stability of thresholds


@query(f"""with {B}, x as (select event_type, close, abs(close - lag(close) over w) d, {full('var_pop(close)', 5)} v from bars {W})
select event_type, {r('var_pop(close)', 4)} as variance, {r('avg(d)')} as drift, {r('max(close) - min(close)')} as range, {r('avg(v)', 4)} as rolling_variance from x group by event_type""")
def st_variance(spark, d):
    out = metrics.threshold_stability(bars(spark, d), "close", K, O, 5)
    return out.select("event_type", near(F.col("variance"), 4).alias("variance"), near(F.col("drift")).alias("drift"), near(F.col("range")).alias("range"), near(F.col("rolling_variance"), 4).alias("rolling_variance"))


@query(f"""with e as (select event_type, avg(value) m, var_pop(value) v from events group by 1), a as (select avg(v) w, var_pop(m) b from e) select {r('w', 4)} as within, {r('b', 4)} as "between", {r('b / (w + b)')} as consistency from a""")
def st_regime_consistency(spark, d):
    out = metrics.regime_consistency(table(spark, d, "events"), "value", "event_type")
    return out.select(near(F.col("within"), 4).alias("within"), near(F.col("between"), 4).alias("between"), near(F.col("consistency")).alias("consistency"))


@query(f"""with {B}, x as (select event_type, abs(open - quantile_cont(close, 0.5) over (w rows between 4 preceding and current row)) t from bars {W}) select event_type, {r('avg(t)')} as tracking_error, {r('max(t)')} as worst from x group by event_type""")
def st_tracking_error(spark, d):
    out = metrics.tracking_error(bars(spark, d), "close", "open", K, O, 0.5, 5)
    return out.select("event_type", near(F.col("tracking_error")).alias("tracking_error"), near(F.col("worst")).alias("worst"))


@query(f"""with r as (select event_type, user_id % 2 g, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0 r, count(*) over (partition by event_type, value) t from events),
a as (select event_type, count(*) filter (g = 1)::double n1, count(*) filter (g = 0)::double n0, sum(r) filter (g = 1)::double rs, sum(t * t - 1)::double ties from r group by event_type)
select event_type, n1, n0, {r('rs - n1 * (n1 + 1) / 2')} as u, {r('(rs - n1 * (n1 + 1) / 2 - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1))))')} as z from a""")
def st_mann_whitney(spark, d):
    out = metrics.mann_whitney(table(spark, d, "events").withColumn("g", F.col("user_id") % 2), "value", "g", ["event_type"])
    return out.select("event_type", "n1", "n0", near(F.col("u")).alias("u"), near(F.col("z")).alias("z"))


@query()
def st_drift(spark, d):
    return metrics.drift(table(spark, d, "events"), "value", ["event_type"], ORDER)


# patients: an order's lines as measurements


def patients(spark, d):
    """Measurements in the order of the table's rows, as their means are sums of doubles."""
    li = table(spark, d, "lineitem").withColumn("at", F.struct("_metadata.file_name", "_metadata.row_index"))
    vital = [F.max(F.when(F.col("l_linenumber") == k + 1, F.col("l_quantity") * 2 + 40)) for k in range(len(apps.VITALS))]
    v = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, apps.VITALS)), F.array(*vital)), lambda _, x: x.isNotNull())
    lines = F.array_sort(F.collect_list(F.struct("at", (F.col("l_discount") * 10).alias("a"), (F.col("l_quantity") / 50).alias("b"), (F.col("l_tax") * 11.7).alias("c"))))
    rows = li.groupBy("l_orderkey").agg(lines.alias("lines"), F.max("l_shipdate").alias("ts"), v.alias("vitals"))
    m = lambda x: F.map_from_entries(F.transform(F.filter("lines", lambda r: r[x].isNotNull()), lambda r, k: F.struct(k.cast("string"), r[x])))
    return rows.select("l_orderkey", m("a").alias("symptoms"), m("b").alias("tests"), m("c").alias("history"), "ts", "vitals")


def diagnosed(spark, d):
    rows = patients(spark, d)
    each = {"s": apps.symptoms_state("symptoms"), "t": apps.tests_state("tests"), "v": apps.vitals_state("vitals"), "h": apps.history_state("history")}
    rows = rows.select("l_orderkey", "ts", *[x.alias(k) for k, x in each.items()])
    return rows.withColumn("g", apps.diagnosis(*(F.col(k) for k in each))).select("l_orderkey", "ts", "s", "t", "v", "h", "g.*")


_V = " + ".join(f"coalesce((max(x) filter (l_linenumber = {k + 1}) < 0.9 * {lo} or max(x) filter (l_linenumber = {k + 1}) > 1.1 * {hi})::int, 0)" for k, (lo, hi) in enumerate(apps.VITALS.values()))
_M = f"""p as (select *, l_quantity * 2 + 40 x from lineitem), c as (select l_orderkey, max(l_shipdate) ts, avg(l_discount * 10) sy, avg((l_quantity / 50 > 0.5)::int) t1, avg((l_quantity / 50 > 0.8)::int) t2, avg(l_tax * 11.7::double) hi, {_V} o from p group by l_orderkey),
k as (select l_orderkey, ts, (sy > 0.3)::int * 2 + (sy > 0.7)::int s, (t1 > 0.3)::int * 2 + (t2 > 0.2)::int t, (o > 0)::int * 2 + (o > 1)::int v, (hi > 0.5)::int * 2 + (hi > 0.8)::int h from c),
g as (select *, (s = 3)::int + (t = 3)::int + (v = 3)::int + (h = 3)::int psi, (s >= 2)::int + (t >= 2)::int + (v >= 2)::int + (h >= 2)::int ab from k),
dx as (select *, case when psi >= 2 then 'CRITICAL' when t = 3 and s >= 2 then 'HIGH' when v = 3 and h = 3 then 'HIGH' when ab >= 2 then 'MEDIUM' else 'LOW' end urgency, case when psi >= 2 then 'immediate_attention' when t = 3 and s >= 2 then 'urgent_care' when v = 3 and h = 3 then 'urgent_care' when ab >= 2 then 'schedule_appointment' when ab = 1 then 'monitor' else 'no_action' end recommendation,
(case when psi >= 2 then 0.95 when t = 3 and s >= 2 then 0.85 when v = 3 and h = 3 then 0.8 when ab >= 2 then 0.7 when ab = 1 then 0.6 else 0.9 end)::double confidence from g)"""


@query(f"with {_M} select l_orderkey, s::int as s, t::int as t, v::int as v, h::int as h from dx")
def med_encode(spark, d):
    return diagnosed(spark, d).select("l_orderkey", *[F.col(c).cast("int").alias(c) for c in "stvh"])


@query(f"with {_M} select l_orderkey, urgency, recommendation, confidence from dx")
def med_diagnose(spark, d):
    return diagnosed(spark, d).select("l_orderkey", "urgency", "recommendation", "confidence")


@query(f"with {_M} select urgency, recommendation, count(*) as n, {r('avg(confidence)')} as mean_confidence, cast(grouping_id(urgency, recommendation) as int) as level from dx group by grouping sets ((urgency), (recommendation), ())")
def med_summary_grouping_sets(spark, d):
    out = apps.diagnosis_summary(diagnosed(spark, d))
    return out.withColumn("mean_confidence", near(F.col("mean_confidence")))


_A = f"{_M}, o as (select dx.*, o_custkey from dx join orders on o_orderkey = l_orderkey), l as (select *, lag(urgency) over w u, confidence - lag(confidence) over w dc from o window w as (partition by o_custkey order by ts, l_orderkey))"


@query(f"with {_A}, a as (select l_orderkey, unnest([case when urgency <> u then 'URGENCY_CHANGE' end, case when dc < -0.3 then 'DETERIORATION' end, case when abs(dc) > 0.3 then 'CRITICAL_CHANGE' end]) alert from l) select l_orderkey, alert from a where alert is not null and alert <> 'CRITICAL_CHANGE'")
def med_alerts(spark, d):
    rows = diagnosed(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return apps.alerts(rows, ["o_custkey"], ["ts", "l_orderkey"]).where("alert <> 'CRITICAL_CHANGE'").select("l_orderkey", "alert")


# streams, run to the end of what is there


@query("select event_type, date_trunc('hour', ts) as start, count(*) as n, round(sum(value) + 3.21e-11, 4) as total from events group by all")
def stream_tumbling(spark, d):
    out = windows.tumbling(windows.source(spark, f"{d}/events.parquet"), "ts", "1 hour", ["event_type"], "value")
    return windows.run(out, "complete").select("event_type", "start", "n", near(F.col("total"), 4).alias("total"))


@query("""with s as (select event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as start from events) select event_type, start, count(*) as n, round(sum(value) + 3.21e-11, 4) as total from s group by all""")
def stream_sliding(spark, d):
    out = windows.sliding(windows.source(spark, f"{d}/events.parquet"), "ts", "2 hours", "1 hour", ["event_type"], "value")
    return windows.run(out, "complete").select("event_type", "start", "n", near(F.col("total"), 4).alias("total"))


@query("""with g as (select user_id, ts, case when ts > lag(ts) over w + interval 6 hour then 1 else 0 end b from events window w as (partition by user_id order by ts)), i as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g)
select user_id, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) as n from i group by user_id, k""")
def stream_session(spark, d):
    out = windows.sessions(windows.source(spark, f"{d}/events.parquet"), "ts", "6 hours", ["user_id"])
    return windows.run(out, "complete").select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


@query("select distinct user_id, event_type from events")
def stream_dedup(spark, d):
    out = windows.distinct(windows.source(spark, f"{d}/events.parquet"), ["user_id", "event_type"])
    return windows.run(out, "append")


@query("""with n as (select user_id, value v, row_number() over (partition by user_id order by ts, event_id) rn from events) select user_id, count(*) as n, round(avg(v) + 3.21e-11, 6) as mean, round(coalesce(stddev_samp(v), 0) + 3.21e-11, 6) as std from n group by user_id""")
def stream_adaptive(spark, d):
    """Trackers as streaming state; the last row of each key is its state at the end."""
    out = windows.run(stateful.moments(windows.source(spark, f"{d}/events.parquet"), "user_id", "ts", "event_id", "value"), "append")
    last = out.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n")))).where("r = 1")
    return last.select("user_id", "n", near(F.col("mean")).alias("mean"), near(F.col("std")).alias("std"))
