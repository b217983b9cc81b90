"""Queries on scorers, reports, combinators, volumes, pipeline stages and summaries of clouds and graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourfold.catalog import series as _series
from fourfold.catalog import space as _space
from fourfold.catalog.core import E, coded, near, table
from fourfold.catalog.space import G, PATHS, PTS, VOTE, counted, field, offs, points, shown
from fourfold.functions import scorer, scoring
from fourfold.functions import state as st
from fourfold.operators import combinators, fields, interpret, learn, reports, topology
from fourfold.plans.lazy import query as field_query
from fourfold.plans.pipeline import PipelineBuilder

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


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[near(F.col(c)).alias(c) if c in names else c for c in df.columns])


# scorers

_USERS = "u as (select user_id, count(*) n, avg(value) m, stddev_pop(value) s, max(value) x from events group by 1), d as (select user_id, least(greatest(m / 100, 0), 1) signal_strength, least(greatest(least(n / 30.0, 1) / (1 + s / 100), 0), 1) noise_level, case when n < 3 then 0.5 else 1 / (1 + s / abs(m)) end temporal_stability, least(x / 400, 1) local_density from u)"


def _scored(spark, d, in_order: bool = False):
    """Values by user; ``in_order`` takes means and deviations in the order of the table's rows, as they are sums of doubles."""
    rows, m, s = table(spark, d, "events"), F.avg("value"), F.stddev_pop("value")
    if in_order:
        w = Window.partitionBy("user_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.select("user_id", "value", F.struct("_metadata.file_name", "_metadata.row_index").alias("at"))
        rows, m, s = rows.select("user_id", "value", m.over(w).alias("m"), s.over(w).alias("s")), F.max("m"), F.max("s")
    rows = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), m.alias("m"), s.alias("s"), F.max("value").alias("x"))
    made = scorer.create_signal_scorer(lambda: F.col("m") / 100, lambda: scoring.confidence(F.col("n"), F.lit(0.0), F.col("s") / 100), lambda: scoring.stability(F.col("n"), F.col("m"), F.col("s")), lambda: F.col("x") / 400)
    return rows, made


@query(f"with {_USERS} select user_id, round((2 * signal_strength + 1.5 * noise_level + 1.5 * temporal_stability + local_density) / 6 + 3.21e-11, 6) as score, round(least(signal_strength, noise_level, temporal_stability, local_density) + 3.21e-11, 6) as lowest from d")
def scorer_signal(spark, d):
    rows, made = _scored(spark, d)
    low = made.score_and_aggregate(rows, "min", "lowest").select("user_id", "lowest")
    return rounded(made.score_and_aggregate(rows).select("user_id", "score").join(low, "user_id"), "score", "lowest")


@query(f"""with {_USERS}, l as (select user_id, unnest([{{'k': signal_strength, 'n': 'signal_strength', 'w': '2'}}, {{'k': noise_level, 'n': 'noise_level', 'w': '1.5'}}, {{'k': temporal_stability, 'n': 'temporal_stability', 'w': '1.5'}}, {{'k': local_density, 'n': 'local_density', 'w': '1'}}]) x, (2 * signal_strength + 1.5 * noise_level + 1.5 * temporal_stability + local_density) / 6 t from d)
select user_id, printf('overall: %.3f', any_value(t)) || chr(10) || string_agg(printf('%s: %.3f (weight %s)', x.n, x.k, x.w), chr(10) order by x.k desc, x.n) as explanation from l group by user_id""")
def scorer_explain(spark, d):
    rows, made = _scored(spark, d, in_order=True)
    return made.explain_score(rows).select("user_id", "explanation")


@query(f"""with {_USERS}, l as (unpivot (select signal_strength, noise_level, temporal_stability, local_density from d) on signal_strength, noise_level, temporal_stability, local_density into name dimension value v)
select dimension, count(*) as n, round(avg(v) + 3.21e-11, 6) as mean, round(stddev_pop(v) + 3.21e-11, 6) as std, round(min(v) + 3.21e-11, 6) as min, round(max(v) + 3.21e-11, 6) as max, round(quantile_cont(v, 0.5) + 3.21e-11, 6) as median from l group by dimension""")
def scorer_statistics(spark, d):
    rows, made = _scored(spark, d)
    return rounded(made.get_dimension_statistics(made.score_feature(rows)), "mean", "std", "min", "max", "median")


# reports


def _quality(s: str) -> str:
    return f"""(with e as (select *, {s} as z from events), c as (select z, event_type, count(*) n from e group by all), a as (select sum(b) / sum(n) x from (select max(n) b, sum(n) n from c group by z)),
g as (select z, count(*) n, avg(value) m, var_pop(value) v from e group by z), w as (select sum(n * v) i, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) b from g), p as (select -sum(n / t * log2(n / t)) h from (select n, sum(n) over () t from g)),
f as (select event_type, count(*) over q c, greatest(sum((z = 0)::int) over q, sum((z = 1)::int) over q, sum((z = 2)::int) over q, sum((z = 3)::int) over q) / 10.0 m from e window q as (partition by event_type order by value, event_id rows between current row and 9 following)), k as (select avg(m) y from f where c = 10)
select a.x as accuracy, w.b / (w.b + w.i) as discrimination, p.h as bits, k.y as consistency, p.h / 2 as balance, (a.x + w.b / (w.b + w.i) + p.h + k.y) / 5 as overall from a, w, p, k)"""


_FIVE = ("accuracy", "discrimination", "bits", "balance", "consistency", "overall")
_SHOW = ", ".join(f"round({c} + 3.21e-11, 6) as {c}" for c in _FIVE)
_CODE = "(case when value > {0} then 2 else 0 end + case when value > {1} then 1 else 0 end)"


@query(f"select {_SHOW} from {_quality(_CODE.format('20', '60'))}")
def quality_report(spark, d):
    return rounded(reports.encoding_quality_report(coded(spark, d), "s", "event_type", "value", ["event_type"], ["value", "event_id"]), *_FIVE)


@query(f"with r as (select 'fixed' as encoder, * from {_quality(_CODE.format('20', '60'))} union all select 'high' as encoder, * from {_quality(_CODE.format('80', '120'))}) select encoder, {_SHOW}, encoder = (select arg_min(encoder, (-round(overall, 12), encoder)) from r) as winner from r")
def compare_encoders(spark, d):
    rows = table(spark, d, "events")
    return rounded(reports.compare_encoders(rows, {"fixed": st.encode("value", 20.0, 60.0), "high": st.encode("value", 80.0, 120.0)}, "event_type", "value", ["event_type"], ["value", "event_id"]), *_FIVE)


@query("""with h as (select event_type, event_id, ts, value, user_id % 3 g, avg(value) over w ti, avg(value) over w + stddev_pop(value) over w / 2 tq, quantile_cont(value, 0.5) over (partition by event_type order by ts, event_id rows between 100 preceding and current row) o from events window w as (partition by event_type order by ts, event_id rows between 49 preceding and current row)),
x as (select *, ti - lag(ti) over w di, tq - lag(tq) over w dq, o - lag(o) over w dd from h window w as (partition by event_type order by ts, event_id)),
b as (select event_type, (var_pop(ti) + var_pop(tq)) / 2 variance, (coalesce(avg(abs(di)), 0) + coalesce(avg(abs(dq)), 0)) / 2 drift, avg(abs(ti - o)) e, 1 / (1 + coalesce(var_pop(di), 0)) sm, corr(di, dd) co from x group by 1),
r as (select event_type, avg(v) i, var_pop(m) b from (select event_type, g, avg(ti) m, var_pop(ti) v from h group by all) group by 1), f as (select event_type, variance, drift, (1 / (1 + e) + sm) / 2 adaptation, r.b / (r.b + r.i) regimes from b join r using (event_type))
select event_type, round(variance + 3.21e-11, 6) as variance, round(drift + 3.21e-11, 6) as drift, round(adaptation + 3.21e-11, 6) as adaptation, round(regimes + 3.21e-11, 6) as regimes, round(0.3 * least(greatest(1 - variance, 0), 1) + 0.3 * least(greatest(1 - drift / 0.01, 0), 1) + 0.2 * regimes + 0.2 * adaptation + 3.21e-11, 6) as overall from f""")
def stability_report(spark, d):
    rows = _history(spark, d)
    out = reports.stability_report(rows, "value", "ti", "tq", ["event_type"], ORDER, "g")
    return rounded(out, "variance", "drift", "adaptation", "regimes", "overall")


def _history(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("event_type").orderBy(*ORDER).rowsBetween(-49, 0)
    return table(spark, d, "events").select("event_type", *ORDER, "value", (F.col("user_id") % 3).alias("g"), F.avg("value").over(w).alias("ti"), (F.avg("value").over(w) + F.stddev_pop("value").over(w) / 2).alias("tq"))


@query("""with h as (select event_type, event_id, ts, avg(value) over w ti, quantile_cont(value, 0.5) over (partition by event_type order by ts, event_id rows between 100 preceding and current row) o from events window w as (partition by event_type order by ts, event_id rows between 49 preceding and current row)),
x as (select *, ti - lag(ti) over w di, o - lag(o) over w dd from h window w as (partition by event_type order by ts, event_id))
select event_type, round(avg(abs(ti - o)) + 3.21e-11, 6) as tracking_error, round(coalesce(corr(di, dd), 0) + 3.21e-11, 6) as responsiveness, round(1 / (1 + coalesce(var_pop(di), 0)) + 3.21e-11, 6) as smoothness, round((1 / (1 + avg(abs(ti - o))) + 1 / (1 + coalesce(var_pop(di), 0))) / 2 + 3.21e-11, 6) as tradeoff from x group by event_type""")
def adaptation_quality(spark, d):
    return rounded(reports.adaptation_quality(_history(spark, d), "value", "ti", ["event_type"], ORDER), "tracking_error", "responsiveness", "smoothness", "tradeoff")


def _explained(decision: str, rules: float) -> str:
    return f"""(with r as (select {_CODE.format('20', '60')} s, {decision} x from events), e as (select s, count(distinct x) n from r group by s), c as (select 0.3 * (1 - avg((n > 1)::int)) + 0.4 * avg(1.0 / greatest(n, 1)) + 0.3 * count(*) / 4.0 clarity from e), m as (select s, x, count(*)::double n from r group by all),
k as (select coalesce(sum(case when a.x = b.x then a.n * b.n else 0 end) / sum(a.n * b.n), 0.5) y from m a join m b on a.s < b.s and bit_count(xor(a.s, b.s)) = 1)
select clarity, {rules}::double as complexity, 0.6::double as completeness, y as consistency, 0.3 * clarity + 0.3 * greatest(0, 1 - {rules} / 10.0) + 0.2 * 0.6 + 0.2 * y as overall from c, k)"""


_VALUE = "(case when value > 40 then 'buy' else 'sell' end)"
_PLAIN_OF = f"(case {_CODE.format('20', '60')} when 3 then 'buy' when 2 then 'hold' when 1 then 'wait' else 'sell' end)"
_CLEAR = ", ".join(f"round({c} + 3.21e-11, 6) as {c}" for c in ("clarity", "completeness", "consistency", "overall"))


@query(f"with r as (select 'rules' as interpreter, * from {_explained(_PLAIN_OF, 4)} union all select 'value' as interpreter, * from {_explained(_VALUE, 5)}) select interpreter, complexity, {_CLEAR}, interpreter = (select arg_min(interpreter, (-round(overall, 12), interpreter)) from r) as winner from r")
def compare_explainability(spark, d):
    rules = {3: "buy", 2: "hold", 1: "wait", 0: "sell"}
    rows = coded(spark, d).withColumn("a", interpret.rules("s", rules)).withColumn("b", F.when(F.col("value") > 40, "buy").otherwise("sell"))
    return rounded(reports.compare_explainability(rows, "s", {"rules": ("a", rules), "value": ("b", None)}), "clarity", "completeness", "consistency", "overall")


# combinators


@query(f"with {G} select x, y, (case when x < 10 or y >= 12 then (3 - case s when 2 then 0 else s end) else 0 end)::int as s from g")
def combinator_points(spark, d):
    both = combinators.lift_point_to_field(st.comp).compose(combinators.lift_point_to_field(st.gate))
    return shown(combinators.spatial_filter(lambda x, y: (x < 10) | (y >= 12)).compose(both)(field(spark, d)))


@query(f"with {G} select g.x, g.y, (g.s & m.s)::int as s from g join g m on m.x = (g.x + 1) % 31 and m.y = g.y")
def combinator_binary(spark, d):
    f = field(spark, d)
    return shown(combinators.lift_binary_to_field(st.weave)(f, f.withColumn("x", F.pmod(F.col("x") - 1, F.lit(31)))))


@query(f"with {G}, {counted(1, False)} select x, y, (case when n3 >= 2 then 3 when n0 >= 5 then 0 else s end)::int as s from k")
def combinator_neighbourhood(spark, d):
    rule = lambda near: F.when(F.col("n3") >= 2, 3).when(F.col("n0") >= 5, 0).otherwise(F.col("s"))
    return shown(combinators.NeighborhoodCombinator(rule)(field(spark, d)))


@query(f"""with {G}, {counted(1)}, v as (select x, y, n0 + (s = 0)::int n0, n1 + (s = 1)::int n1, n2 + (s = 2)::int n2, n3 + (s = 3)::int n3 from k), h as (select x, y, ({VOTE})::int s from v),
b as (select h.x, h.y, h.s, count(*) n, count(*) filter (m.s = h.s) e from h cross join {offs(1)} o join h m on m.x = h.x + o.dx and m.y = h.y + o.dy group by all) select x, y, (case when n > e then 3 else 0 end)::int as s from b""")
def combinator_edges(spark, d):
    return shown(combinators.edge_detection_pipeline(field(spark, d)))


# volumes

_V = "v as (select x::int x, y::int y, z::int z, (x * 7 + y * 3 + z * 5 + x * y * z) % 4 s from (select unnest(range(7)) x), (select unnest(range(6)) y), (select unnest(range(5)) z))"
_CUBE = "(select unnest([-1, 0, 1]) dx) a, (select unnest([-1, 0, 1]) dy) b, (select unnest([-1, 0, 1]) dz) c"


def volume(spark):
    return fields.grid3(spark, 7, 6, 5, (F.col("x") * 7 + F.col("y") * 3 + F.col("z") * 5 + F.col("x") * F.col("y") * F.col("z")) % 4)


def _parts(where: str, steps: int) -> str:
    return f"""c as (select *, (z * 10000 + y * 100 + x) id from v where {where}), e as (select a.id a, b.id b from c a join c b on a.id <> b.id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and abs(a.z - b.z) <= 1 and abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= {steps}),
t as (select id, id root from c union select e.b, t.root from t join e on e.a = t.id), l as (select id, min(root) root from t group by id)"""


for _n in (1, 2, 3):

    def _run(spark, d, n=_n):
        return fields.components3(volume(spark), 3, n).select("x", "y", "z", F.col("label").cast("long").alias("label"))

    QUERIES[f"volume_components_{_n}"] = _run
    SQL[f"volume_components_{_n}"] = f"with recursive {_V}, {_parts('s = 3', _n)} select (id % 100)::int as x, (id // 100 % 100)::int as y, (id // 10000)::int as z, dense_rank() over (order by root) as label from l"


_PLACES = {"zero": "{0} + d{0}", "constant": "{0} + d{0}", "periodic": "({0} + d{0} + {1}) % {1}", "extend": "least(greatest({0} + d{0}, 0), {1} - 1)", "reflect": "case when {0} + d{0} < 0 then -({0} + d{0}) when {0} + d{0} >= {1} then 2 * {1} - 1 - {0} - d{0} else {0} + d{0} end"}
for _b, _p in _PLACES.items():

    def _run(spark, d, b=_b):
        return fields.convolve3(volume(spark), None, b).select("x", "y", "z", F.col("s").cast("int").alias("s"))

    QUERIES[f"volume_convolve_{_b}"] = _run
    _outside = "coalesce(m.s, 0)" if _b == "zero" else "m.s"
    SQL[f"volume_convolve_{_b}"] = f"with {_V}, p as (select x, y, z, {_p.format('x', 7)} px, {_p.format('y', 6)} py, {_p.format('z', 5)} pz from v, {_CUBE}), k as (select p.x, p.y, p.z, {', '.join(f'count(*) filter ({_outside} = {k}) n{k}' for k in range(4))} from p left join v m on m.x = px and m.y = py and m.z = pz group by all) select x, y, z, ({VOTE})::int as s from k"


@query(f"""with {_V}, w as (select {", ".join(f"exp(-({k}) / 2.0) w{k}" for k in range(4))}), k as (select v.x, v.y, v.z, {", ".join(f"sum(case when coalesce(m.s, 0) = {s} then exp(-(dx * dx + dy * dy + dz * dz) / 2.0) else 0 end) n{s}" for s in range(4))} from v cross join (select * from {_CUBE}) o left join v m on m.x = v.x + dx and m.y = v.y + dy and m.z = v.z + dz group by all) select x, y, z, ({VOTE.replace('>=', '>= -1e-9 +')})::int as s from k""")
def volume_gaussian(spark, d):
    return fields.convolve3(volume(spark), fields.gaussian3(3, 1.0)).select("x", "y", "z", F.col("s").cast("int").alias("s"))


def _cubes(dx: int, dy: int, dz: int) -> str:
    cells = [(a, b, c) for a in range(dx + 1) for b in range(dy + 1) for c in range(dz + 1)]
    return "(select count(*) from o a " + " ".join(f"join o t{k} on t{k}.x = a.x + {x} and t{k}.y = a.y + {y} and t{k}.z = a.z + {z}" for k, (x, y, z) in enumerate(cells)) + ")"


@query(f"""with recursive {_V}, {_parts('s = 3', 1)}, o as (select x, y, z from c), c2 as (select *, (z * 10000 + y * 100 + x) id from v where s <> 3), e2 as (select a.id a, b.id b from c2 a join c2 b on a.id <> b.id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and abs(a.z - b.z) <= 1), t2 as (select id, id root from c2 union select e2.b, t2.root from t2 join e2 on e2.a = t2.id),
l2 as (select root, bool_or(x in (0, 6) or y in (0, 5) or z in (0, 4)) o from (select id, min(root) root from t2 group by id) join c2 using (id) group by root),
n as (select (select count(distinct root) from l) b0, (select count(*) from l2 where not o) b2, {_cubes(0, 0, 0)} - {_cubes(1, 0, 0)} - {_cubes(0, 1, 0)} - {_cubes(0, 0, 1)} + {_cubes(1, 1, 0)} + {_cubes(1, 0, 1)} + {_cubes(0, 1, 1)} - {_cubes(1, 1, 1)} euler)
select b0, b0 + b2 - euler as b1, b2, euler from n""")
def volume_betti(spark, d):
    return fields.betti3(volume(spark)).drop("field_id")


# lazy fields


@query(f"with {G}, w as (select x, y, case when s >= 2 then s else 0 end s from g), k as (select g.x, g.y, g.s, count(*) filter (m.s = 3) n3 from w g cross join {offs(2)} o left join w m on m.x = g.x + o.dx and m.y = g.y + o.dy group by all) select x, y, (case when n3 > 0 then 3 else s end)::int as s from k where x between 4 and 17 and y between 0 and 9")
def field_lazy_region(spark, d):
    return shown(field_query(field(spark, d)).where(lambda s: s >= 2).dilate(2).materialize_region(4, 18, 0, 10))


@query(f"with {G}, k as (select g.x, g.y, g.s, count(*) filter (m.s = 3) n3 from g cross join {offs(1)} o left join g m on m.x = g.x + o.dx and m.y = g.y + o.dy group by all) select x, y, (case when n3 > 0 then 3 else s end)::int as s from k")
def field_lazy_bands(spark, d):
    bands = list(field_query(field(spark, d)).dilate().stream_rows(7))
    out = bands[0]
    for b in bands[1:]:
        out = out.unionByName(b)
    return shown(out)


# pipeline stages

SQL["builder_adaptive"] = _series.SQL["adaptive_streaming"]
SQL["builder_score"] = _series.SQL["score_fold"]


@query()
def builder_adaptive(spark, d):
    made = PipelineBuilder("value").with_adaptive_encoding(ORDER, BY).build().fit(table(spark, d, "events"))
    out = made.get_stage_output(table(spark, d, "events"), "encode")
    return rounded(out.select("event_id", "threshold_i", "threshold_q", F.col("s").cast("int").alias("s")), "threshold_i", "threshold_q")


@query()
def builder_score(spark, d):
    made = PipelineBuilder("value").with_fixed_encoding(20.0, 60.0).with_score_based_interpretation(ORDER, BY).build()
    return rounded(made.fit_transform(table(spark, d, "events")).select("event_id", "score", "decision"), "score")


@query(f"with u as (select user_id, avg(value) m from events group by 1) select user_id, round(m + 3.21e-11, 6) as value, ({_CODE.replace('value', 'm').format('30', '50')})::int as s from u")
def builder_series_features(spark, d):
    made = PipelineBuilder("value").with_time_series_features(ORDER, BY).with_fixed_encoding(30.0, 50.0).build()
    events = table(spark, d, "events")
    return rounded(made.fit(events).get_stage_output(events, "encode").select("user_id", "value", F.col("s").cast("int").alias("s")), "value")


@query("""select 'l_quantity' as feature, quantile_cont(l_quantity, 0.5) as threshold_i, quantile_cont(l_quantity, 0.75) as threshold_q from lineitem union all select 'l_discount', quantile_cont(l_discount, 0.25), quantile_cont(l_discount, 0.9) from lineitem""")
def multi_feature_thresholds(spark, d):
    made = learn.MultiFeatureThresholds().add_feature("l_quantity").add_feature("l_discount", lambda df, c: learn.percentile_thresholds(df, c, 0.25, 0.9)).add_feature("missing")
    found = made.fit(table(spark, d, "lineitem")).get_all_thresholds()
    return spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in found.items()], "feature string, threshold_i double, threshold_q double")


# transitions, clouds, mapper


@query(f"with recursive {PATHS} select s.a as source, t.b as target, exists (select 1 from q where q.source = s.a and q.target = t.b) as reachable from (select unnest(range(4))::int a) s, (select unnest(range(4))::int b) t")
def transition_reachability(spark, d):
    return topology.reachability(topology.transition_edges(spark))


@query(f"with recursive {PATHS}, r as (select *, array_to_string(ops, ',') o from q), c as (select 'cost' strategy, *, row_number() over (partition by source, target order by cost, len, o) k from r union all select 'risk', *, row_number() over (partition by source, target order by risk, len, o) from r union all select 'length', *, row_number() over (partition by source, target order by len, len, o) from r) select strategy, source, target, o as ops, round(cost + 3.21e-11, 6) as cost, risk, len as length from c where k = 1")
def transition_strategies(spark, d):
    found = topology.compare_strategies(topology.paths(spark, topology.transition_edges(spark)))
    return rounded(found.select("strategy", "source", "target", F.array_join("ops", ",").alias("ops"), "cost", "risk", "length"), "cost")


_CURVE = ", ".join(str(round(1.0 + 0.05 * k, 2)) for k in range(8))
_CURVES = f"""{_space.SQL['persistence_h0'].split('\nselect 0::int as dim')[0].removeprefix('with recursive ')}, deaths as (select best from t where step = (select count(*) from p) and id <> (select first from f)),
pr as (select l.id a, r.id b, list_distance(l.v, r.v) d from p l join p r on l.id < r.id), th as (select unnest([{_CURVE}])::double h), cu as (select h, (select count(*) from p) - (select count(*) from deaths where best <= h) b0, (select count(*) from pr where d <= h) e from th), bc as (select h, b0, greatest(0, e - (select count(*) from p) + b0) b1 from cu)"""


def _curves(spark, d):
    return topology.betti_curves(points(spark, d), [round(1.0 + 0.05 * k, 2) for k in range(8)])


@query(f"with recursive {_CURVES} select h as threshold, b0, b1, printf('β₀=%d-β₁=%d-β₂=%d', b0, b1, 0) as signature, b0 + 2 * b1 as complexity from bc")
def betti_tracker(spark, d):
    b0, b1 = F.col("b0"), F.col("b1")
    return _curves(spark, d).select("threshold", "b0", "b1", topology.betti_signature(b0, b1).alias("signature"), topology.complexity(b0, b1).alias("complexity"))


@query(f"with recursive {_CURVES} select (select arg_min(b0, (-n, b0)) from (select b0, count(*) n from bc group by b0)) as clusters, (select max(b1) from bc) as loops")
def betti_clusters(spark, d):
    from fourfold.sources.tables import written

    curves = written(_curves(spark, d))
    return topology.clusters_by_betti(curves).join(F.broadcast(topology.loops_by_betti(curves)))


_MAPPER = _space.SQL["mapper_first_coordinate"].split("\nselect node as a")[0]


def _mapper(spark, d):
    return topology.mapper(points(spark, d), 5, filter_col=F.col("p")[0])


@query(f"{_MAPPER} select x.node, round(avg(embedding[2]::double) + 3.21e-11, 6) as value, count(*) as n from x join embeddings on vec_id = x.id group by x.node")
def mapper_values(spark, d):
    return rounded(topology.mapper_values(_mapper(spark, d)[0], points(spark, d), F.col("p")[1]), "value")


@query(f"{_MAPPER}, ed as (select a, b from s union all select b, a from s), nd as (select distinct node from x), mt as (select node, node root from nd union select ed.b, mt.root from mt join ed on ed.a = mt.node) select (select count(*) from nd) as nodes, (select count(*) from s) as edges, (select round(count(*) / count(distinct node) + 3.21e-11, 6) from x) as mean_size, (select round(2 * count(*) / (select count(*) from nd) + 3.21e-11, 6) from s) as mean_degree, (select count(distinct r) from (select node, min(root) r from mt group by node)) as components")
def mapper_summary(spark, d):
    return rounded(topology.mapper_summary(*_mapper(spark, d)), "mean_size", "mean_degree")
