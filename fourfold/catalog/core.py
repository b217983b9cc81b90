"""Queries on states, algebra, channels, preprocessing, learners and interpreters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.functions import nested as ns
from fourfold.functions import parallel as pl
from fourfold.functions import state as st
from fourfold.operators import interpret, learn, metrics, preprocess, tables
from fourfold.plans.pipeline import PipelineBuilder, auto_pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def near(x, digits: int = 6):
    """Rounded with a tiny shift, so that exact halves fall alike in any engine."""
    return F.round(x + 3.21e-11, digits)


SHOWN = "case {0} when 0 then '∅' when 1 then 'φ' when 2 then 'δ' else 'ψ' end"
CODED = "(case when value > {0} then 2 else 0 end + case when value > {1} then 1 else 0 end)"


def coded(spark: SparkSession, d: str, ti: float = 20.0, tq: float = 60.0) -> DataFrame:
    return table(spark, d, "events").withColumn("s", st.encode("value", ti, tq))


E = f"events_s as (select *, {CODED.format(20, 60)} as s from events)"


@query(f"with {E} select event_id, cast(s as int) as s, {SHOWN.format('s')} as symbol, cast(s // 2 as int) as i, cast(s % 2 as int) as q from events_s")
def state_encode_fixed(spark, d):
    return coded(spark, d).select("event_id", F.col("s").cast("int").alias("s"), st.symbol("s").alias("symbol"), st.i_bit("s").cast("int").alias("i"), st.q_bit("s").cast("int").alias("q"))


@query("""with n as (select event_id, (['PSI', ' delta ', 'hole', 'null', 'resonant', '∅', 'nobody'])[event_id % 7 + 1] as name from events)
select event_id, cast(case lower(trim(name)) when 'psi' then 3 when 'delta' then 2 when 'hole' then 1 when 'null' then 0 when 'resonant' then 3 when '∅' then 0 else -1 end as int) as s from n""")
def state_decode_symbols(spark, d):
    names = F.array(*map(F.lit, ["PSI", " delta ", "hole", "null", "resonant", "∅", "nobody"]))
    name = F.element_at(names, (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.coalesce(st.from_name(name).cast("int"), F.lit(-1)).alias("s"))


@query(f"with {E} select event_type, count(*) as n, count(*) filter (s >= 2) as n_present, count(*) filter (s % 2 = 1) as n_member, count(*) filter (s = 0) as n_empty, cast(sum(s) as bigint) as codes from events_s group by event_type")
def state_predicates(spark, d):
    return coded(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(st.is_present("s")).alias("n_present"), F.count_if(st.is_member("s")).alias("n_member"), F.count_if(F.col("s") == 0).alias("n_empty"), F.sum("s").alias("codes"))


@query(f"""with p as (select event_type, quantile_cont(value, 0.5) ti, quantile_cont(value, 0.75) tq from events group by event_type),
e as (select event_type, {CODED.format('ti', 'tq')} as s from events join p using (event_type))
select event_type, count(*) filter (s = 0) as n_empty, count(*) filter (s = 1) as n_phi, count(*) filter (s = 2) as n_delta, count(*) filter (s = 3) as n_psi, count(*) as n from e group by event_type""")
def state_histogram(spark, d):
    """Flagship: encode by each group's own percentiles, then count states."""
    e = table(spark, d, "events").select("event_type", "value")
    return tables.histogram(learn.grouped_percentile_encode(e, "value", ["event_type"]), "s", "event_type")


@query(f"with {E}, c as (select event_type, s, count(*) n from events_s group by all) select event_type, cast(s as int) as s, n, round(n / sum(n) over (partition by event_type) + 3.21e-11, 6) as share, row_number() over (partition by event_type order by n desc, s) as rank from c")
def state_fractions(spark, d):
    out = tables.distribution(coded(spark, d), "s", "event_type")
    return out.select("event_type", F.col("s").cast("int").alias("s"), "n", near(F.col("share")).alias("share"), F.col("rank").cast("long").alias("rank"))


@query(f"with {E} select user_id, cast(bit_and(s) as int) as meet, cast(bit_or(s) as int) as \"join\", count(*) as n, count(*) filter (s >= 2) as n_present, count(*) filter (s % 2 = 1) as n_member from events_s group by user_id")
def lattice_rollup(spark, d):
    out = tables.rollup_lattice(coded(spark, d), "s", "user_id")
    return out.withColumn("meet", F.col("meet").cast("int")).withColumn("join", F.col("join").cast("int"))


@query(f"with {E} select event_id, cast(case s when 2 then 0 else s end as int) as gated, cast(case s when 2 then 3 else s end as int) as admitted, cast(xor(s, 3) as int) as complement, cast(xor(s, 2) as int) as flip_i, cast(xor(s, 1) as int) as flip_q from events_s")
def algebra_unary(spark, d):
    s = F.col("s")
    ops = {"gated": st.gate, "admitted": st.admit, "complement": st.comp, "flip_i": st.neg_i, "flip_q": st.neg_q}
    return coded(spark, d).select("event_id", *[f(s).cast("int").alias(n) for n, f in ops.items()])


@query(f"with {E}, p as (select *, lag(s, 1, 0) over (partition by user_id order by ts, event_id) b from events_s) select event_id, cast(s | b as int) as overlay, cast(s & b as int) as weave, cast(bit_count(xor(s, b)) as int) as distance, (s & b) = s as leq, (s & b) in (s, b) as comparable from p")
def algebra_binary(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = coded(spark, d).withColumn("b", F.lag("s", 1, 0).over(w))
    return rows.select("event_id", st.overlay("s", "b").cast("int").alias("overlay"), st.weave("s", "b").cast("int").alias("weave"), st.distance("s", "b").cast("int").alias("distance"), st.leq("s", "b").alias("leq"), st.comparable("s", "b").alias("comparable"))


@query(f"""with {E}, a as (select event_id, s, xor(s, 2) x from events_s), b as (select *, case x when 2 then 3 else x end y from a)
select event_id, cast(case y when 2 then 0 else y end as int) as composed, cast(s as int) as twice, cast(case s when 2 then 0 else s end as int) as folded from b""")
def algebra_compose(spark, d):
    s = F.col("s")
    return coded(spark, d).select("event_id", st.compose(st.gate, st.admit, st.neg_i)(s).cast("int").alias("composed"), st.chain(["comp", "comp"])(s).cast("int").alias("twice"), st.chain(["gate", "admit", "gate"])(s).cast("int").alias("folded"))


@query("""with s as (select unnest([0, 1, 2, 3]) as a), p as (select x.a, y.a as b from s x, s y)
select cast(a as int) as a, cast(b as int) as b, (a & b) = a as leq, (a & b) in (a, b) as comparable, cast(a & b as int) as meet, cast(a | b as int) as "join", cast(bit_count(xor(a, b)) as int) as distance, ((a & b) = a and bit_count(xor(a, b)) = 1) as covers from p""")
def lattice_order(spark, d):
    out = tables.lattice_table(spark)
    return out.select(*[F.col(c).cast("int").alias(c) if t == "tinyint" else F.col(c) for c, t in out.dtypes])


@query("""with recursive s as (select unnest([0, 1, 2, 3]) as a), cover as (select x.a, y.a as b from s x, s y where (x.a & y.a) = x.a and bit_count(xor(x.a, y.a)) = 1),
chains as (select a, a as b, cast(a as varchar) as chain from s union all select c.a, v.b, c.chain || '<' || v.b from chains c join cover v on c.b = v.a)
select cast(a as int) as a, cast(b as int) as b, chain from chains""")
def lattice_chains(spark, d):
    return tables.lattice_chains(spark).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.concat_ws("<", F.transform("chain", lambda x: x.cast("string"))).alias("chain"))


@query("select true as is_lattice, true as is_distributive, true as is_modular, true as is_complemented, cast(4 as bigint) as n_elements")
def lattice_laws(spark, d):
    return tables.lattice_properties(spark)


@query("select cast(s as int) as s, cast(case s when 2 then 0 else s end as int) as gate, cast(case s when 2 then 3 else s end as int) as admit, cast(3 - s as int) as comp from (select unnest([0, 1, 2, 3]) as s)")
def truth_tables(spark, d):
    t = [tables.truth_table(spark, f).withColumnRenamed("result", n) for n, f in (("gate", st.gate), ("admit", st.admit), ("comp", st.comp))]
    out = t[0].join(t[1], "s").join(t[2], "s")
    return out.select(*[F.col(c).cast("int").alias(c) for c in out.columns])


def _levels(spark, d):
    """Levels region, nation, supplier of each supplier as nested states of account balances."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    rows = s.join(F.broadcast(n), "n_nationkey")
    own = lambda by: rows.groupBy(by).agg(F.avg("s_acctbal").alias("m")).select(by, st.encode("m", 4000.0, 5000.0).alias(f"l_{by}"))
    rows = rows.join(F.broadcast(own("n_regionkey")), "n_regionkey").join(F.broadcast(own("n_nationkey")), "n_nationkey")
    return rows.select("s_suppkey", ns.nested("l_n_regionkey", "l_n_nationkey", st.encode("s_acctbal", 4000.0, 5000.0)).alias("a"))


_L = """r as (select *, n_regionkey rk, n_nationkey nk from supplier join nation on s_nationkey = n_nationkey),
c as (select s_suppkey, avg(s_acctbal) over (partition by rk) x0, avg(s_acctbal) over (partition by nk) x1, s_acctbal x2 from r),
l as (select s_suppkey, list_transform([x0, x1, x2], lambda x: case when x > 4000 then 2 else 0 end + case when x > 5000 then 1 else 0 end) a from c)"""


@query(f"with {_L} select s_suppkey, array_to_string(list_transform(a, lambda x: {SHOWN.format('x')}), '.') as path, cast(len(a) - 1 as int) as depth, cast(64 as bigint) as total_states, cast(a[1] | a[2] | a[3] as int) as \"join\", cast(a[1] & a[2] & a[3] as int) as meet from l")
def nested_path(spark, d):
    return _levels(spark, d).select("s_suppkey", ns.path("a").alias("path"), ns.depth("a").alias("depth"), ns.total_states("a").alias("total_states"), ns.join_levels("a").cast("int").alias("join"), ns.meet_levels("a").cast("int").alias("meet"))


@query(f"with {_L} select s_suppkey, a[1] = 3 and a[3] = 3 as m1, a[2] = 0 as m2, false as m3 from l")
def nested_match(spark, d):
    return _levels(spark, d).select("s_suppkey", ns.path_matches("a", "ψ.*.ψ").alias("m1"), ns.path_matches("a", "*.∅.*").alias("m2"), ns.path_matches("a", "ψ.*").alias("m3"))


@query(f"with {_L} select s_suppkey, cast(len(list_filter(a, lambda x: x = 3)) as int) as n_psi, cast(len(list_filter(a, lambda x: x = 0)) as int) as n_empty, len(list_filter(a, lambda x: x = 3)) = 3 as all_psi, len(list_filter(a, lambda x: x = 0)) > 0 as any_empty, cast(a[2] as int) as level1, array_to_string([a[1], 3, a[3]], '') as replaced from l")
def nested_counts(spark, d):
    return _levels(spark, d).select("s_suppkey", ns.count_of("a", 3).alias("n_psi"), ns.count_of("a", 0).alias("n_empty"), ns.all_are("a", 3).alias("all_psi"), ns.any_is("a", 0).alias("any_empty"), ns.level("a", 1).cast("int").alias("level1"), F.array_join(F.transform(ns.set_level("a", 1, 3), lambda x: x.cast("string")), "").alias("replaced"))


def _channels(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", pl.channels(quantity=st.encode("l_quantity", 15.0, 35.0), price=st.encode("l_extendedprice", 20000.0, 50000.0), discount=st.encode("l_discount", 0.03, 0.07)).alias("m"))


def _c(x, a, b):
    return f"(case when {x} > {a} then 2 else 0 end + case when {x} > {b} then 1 else 0 end)"


_P = f"c as (select l_orderkey, l_linenumber, {_c('l_quantity', 15, 35)} a, {_c('l_extendedprice', 20000, 50000)} b, {_c('l_discount', 'cast(0.03 as double)', 'cast(0.07 as double)')} e from lineitem)"
_PSI = "((a = 3)::int + (b = 3)::int + (e = 3)::int)"


@query(f"with {_P} select {_PSI}::int as n_psi, ((a = 0)::int + (b = 0)::int + (e = 0)::int)::int as n_empty, count(*) as n from c group by all")
def parallel_counts(spark, d):
    return _channels(spark, d).groupBy(pl.count_of("m", 3).alias("n_psi"), pl.count_of("m", 0).alias("n_empty")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_P} select cast(a & b & e as int) as meet, cast(a | b | e as int) as \"join\", count(*) as n from c group by all")
def parallel_meet_join(spark, d):
    return _channels(spark, d).groupBy(pl.meet("m").cast("int").alias("meet"), pl.join("m").cast("int").alias("join")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_P} select cast(case when (a // 2) * 2.0 + (b // 2) + (e // 2) * 0.5 > 1.75 then 2 else 0 end + case when (a % 2) * 2.0 + (b % 2) + (e % 2) * 0.5 > 1.75 then 1 else 0 end as int) as vote, count(*) as n from c group by all")
def weighted_vote(spark, d):
    return _channels(spark, d).groupBy(pl.weighted_vote("m", {"quantity": 2.0, "discount": 0.5}).cast("int").alias("vote")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_P} select a = 3 and b in (2, 3) as hit, false as absent, {_PSI} * 2 > 3 as majority, count(*) as n from c group by all")
def pattern_match(spark, d):
    return _channels(spark, d).groupBy(pl.matches("m", {"quantity": 3, "price": [2, 3], "discount": "*"}).alias("hit"), pl.matches("m", {"weight": "*"}).alias("absent"), pl.majority_is("m", 3).alias("majority")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_P} select replace(replace(concat({SHOWN.format('a')}, {SHOWN.format('b')}, {SHOWN.format('e')}), 'δ', 'ψ'), '_', '') as text, count(*) as n from c group by all")
def parallel_apply(spark, d):
    return _channels(spark, d).groupBy(pl.compact(pl.apply_all("m", st.admit)).alias("text")).agg(F.count(F.lit(1)).alias("n"))


def _sides(spark, d):
    """Nations by the mean balance of all their suppliers, and of all their customers; a side has the nations whose mean is high enough."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("m")).where("m > 4000")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("m")).where("m > 4400")
    return [x.select("nation", st.encode("m", 4400.0, 4700.0).alias("s")) for x in (s, c)]


_S = f"""a as (select s_nationkey nation, {_c('avg(s_acctbal)', 4400, 4700)} s from supplier group by 1 having avg(s_acctbal) > 4000),
b as (select c_nationkey nation, {_c('avg(c_acctbal)', 4400, 4700)} s from customer group by 1 having avg(c_acctbal) > 4400)"""


def _combine_sql(join: str) -> str:
    return f"with {_S} select coalesce(a.nation, b.nation) as nation, cast(coalesce(a.s & b.s, a.s, b.s) as int) as s from a {join} join b on a.nation = b.nation"


def _int(df: DataFrame) -> DataFrame:
    return df.withColumn("s", F.col("s").cast("int"))


@query(_combine_sql("inner"))
def combine_inner(spark, d):
    return _int(tables.combine(*_sides(spark, d), ["nation"], st.weave, "skip"))


@query(_combine_sql("left"))
def combine_left(spark, d):
    return _int(tables.combine(*_sides(spark, d), ["nation"], st.weave, "keep_left"))


@query(_combine_sql("right"))
def combine_right(spark, d):
    return _int(tables.combine(*_sides(spark, d), ["nation"], st.weave, "keep_right"))


@query(_combine_sql("full"))
def combine_full(spark, d):
    return _int(tables.combine(*_sides(spark, d), ["nation"], st.weave, "keep_both"))


@query(f"with {_S} select nation, cast(bit_or(s) as int) as s from (select * from a union all select * from b) group by nation")
def merge_overlay(spark, d):
    return _int(tables.merge(*_sides(spark, d), ["nation"]))


@query(f"with {_S} select nation, cast(s as int) as s from a where nation in (select nation from b)")
def channels_semi(spark, d):
    return _int(tables.matched(*_sides(spark, d), ["nation"]))


@query(f"with {_S} select nation, cast(s as int) as s from a where nation not in (select nation from b)")
def channels_anti(spark, d):
    return _int(tables.unmatched(*_sides(spark, d), ["nation"]))


# preprocessing


def _values(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value")


def _step(step, sql):
    return lambda spark, d: step(_values(spark, d))


@query("with p as (select avg(value) m, stddev_pop(value) s from events) select event_id, round((value - m) / s + 3.21e-11, 6) as value from events, p")
def scale_standard(spark, d):
    return preprocess.StandardScaler("value").fit_transform(_values(spark, d)).select("event_id", near(F.col("value")).alias("value"))


@query("with p as (select quantile_cont(value, 0.5) m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) s from events) select event_id, round((value - m) / s + 3.21e-11, 6) as value from events, p")
def scale_robust(spark, d):
    return preprocess.RobustScaler("value").fit_transform(_values(spark, d)).select("event_id", near(F.col("value")).alias("value"))


@query("with p as (select min(value) a, max(value) b from events) select event_id, round((value - a) / (b - a) * 2 - 1 + 3.21e-11, 6) as value from events, p")
def scale_minmax(spark, d):
    return preprocess.MinMaxScaler("value", low=-1.0, high=1.0).fit_transform(_values(spark, d)).select("event_id", near(F.col("value")).alias("value"))


def _holes(spark, d):
    """Every seventh value missing, every eleventh NaN."""
    v = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return _values(spark, d).withColumn("value", v)


_H = "h as (select event_id, user_id, ts, case when event_id % 7 = 0 or event_id % 11 = 0 then null else value end as value from events)"


@query(f"with {_H} select event_id, round(coalesce(value, (select avg(value) from h)) + 3.21e-11, 6) as value from h")
def impute_mean(spark, d):
    return preprocess.Imputer("value", strategy="mean").fit_transform(_holes(spark, d)).select("event_id", near(F.col("value")).alias("value"))


@query(f"with {_H} select event_id, round(coalesce(value, (select quantile_cont(value, 0.5) from h)) + 3.21e-11, 6) as value from h")
def impute_median(spark, d):
    return preprocess.Imputer("value", strategy="median").fit_transform(_holes(spark, d)).select("event_id", near(F.col("value")).alias("value"))


@query(f"with {_H} select event_id, round(last_value(value ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) + 3.21e-11, 6) as value from h")
def impute_ffill(spark, d):
    return preprocess.forward_fill(_holes(spark, d), "value", ["ts", "event_id"], ["user_id"]).select("event_id", near(F.col("value")).alias("value"))


@query(f"with {_H} select event_id, round(first_value(value ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) + 3.21e-11, 6) as value from h")
def impute_bfill(spark, d):
    return preprocess.backward_fill(_holes(spark, d), "value", ["ts", "event_id"], ["user_id"]).select("event_id", near(F.col("value")).alias("value"))


@query(f"""with {_H}, n as (select *, row_number() over w rn from h window w as (partition by user_id order by ts, event_id)),
k as (select *, last_value(case when value is not null then rn end ignore nulls) over (partition by user_id order by rn rows unbounded preceding) ra, first_value(case when value is not null then rn end ignore nulls) over (partition by user_id order by rn rows between current row and unbounded following) rb from n),
j as (select k.event_id, k.rn, a.value va, b.value vb, k.ra, k.rb from k left join n a on a.user_id = k.user_id and a.rn = k.ra left join n b on b.user_id = k.user_id and b.rn = k.rb)
select event_id, round(coalesce(va + (vb - va) * (rn - ra) / greatest(rb - ra, 1), va, vb) + 3.21e-11, 6) as value from j""")
def impute_linear(spark, d):
    return preprocess.interpolate(_holes(spark, d), "value", ["ts", "event_id"], ["user_id"]).select("event_id", near(F.col("value")).alias("value"))


@query(f"with {_H} select event_id, value from h where value is not null")
def drop_missing(spark, d):
    return preprocess.Imputer("value", strategy="drop").fit_transform(_holes(spark, d)).select("event_id", "value")


@query("with p as (select quantile_cont(value, 0.01) a, quantile_cont(value, 0.99) b from events) select event_id, round(least(greatest(value, a), b) + 3.21e-11, 6) as value from events, p")
def clip_outliers(spark, d):
    return preprocess.Outliers("value").fit_transform(_values(spark, d)).select("event_id", near(F.col("value")).alias("value"))


@query("with p as (select quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) a, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) b from events) select event_id, value from events, p where value between a and b")
def remove_outliers(spark, d):
    return preprocess.Outliers("value", method="remove", bounds="iqr", width=1.5).fit_transform(_values(spark, d)).select("event_id", "value")


@query("with p as (select avg(value) - 2 * stddev_pop(value) a, avg(value) + 2 * stddev_pop(value) b from events) select event_id, value not between a and b as is_outlier from events, p")
def flag_outliers(spark, d):
    return preprocess.Outliers("value", method="flag", bounds="zscore", width=2.0).fit_transform(_values(spark, d)).select("event_id", "is_outlier")


@query("""with n as (select user_id, value v, row_number() over w - 1 n, count(*) over (partition by user_id) t, stddev_pop(value) over (w rows between current row and 9 following) r from events window w as (partition by user_id order by ts, event_id))
select user_id, round(avg(v) + 3.21e-11, 6) as mean, round(stddev_pop(v) + 3.21e-11, 6) as std, min(v) as min, max(v) as max, round(coalesce(regr_slope(v, n), 0) + 3.21e-11, 6) as slope,
round(case when count(*) >= 10 then stddev_pop(case when n <= t - 10 then r end) else stddev_pop(v) end + 3.21e-11, 6) as volatility, round((arg_max(v, n) - arg_min(v, n)) / count(*) + 3.21e-11, 6) as momentum, count(*) as n from n group by user_id""")
def ts_features(spark, d):
    out = preprocess.series_features(_values(spark, d), "value", ["ts", "event_id"], ["user_id"])
    return out.select("user_id", *[near(F.col(c)).alias(c) for c in ("mean", "std", "slope", "volatility", "momentum")], "min", "max", "n")


@query("""with m as (select event_type t, avg(value) m, stddev_pop(value) s from events group by 1)
select event_type, round(avg(value) + 3.21e-11, 6) as mean, quantile_cont(value, 0.5) as median, round(any_value(s) + 3.21e-11, 6) as std, round(avg(power((value - m) / s, 3)) + 3.21e-11, 6) as skew, round(kurtosis_pop(value) + 3.21e-11, 6) as kurt,
round(quantile_cont(value, 0.25) + 3.21e-11, 6) as p25, round(quantile_cont(value, 0.75) + 3.21e-11, 6) as p75, round(max(value) - min(value) + 3.21e-11, 6) as range, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25) + 3.21e-11, 6) as iqr from events join m on t = event_type group by event_type""")
def stat_features(spark, d):
    out = preprocess.shape_features(table(spark, d, "events"), "value", "event_type")
    return out.select("event_type", "median", *[near(F.col(c)).alias(c) for c in out.columns if c not in {"event_type", "median"}])


# encoders and learners


@query(f"with p as (select quantile_cont(value, 0.5) ti, quantile_cont(value, 0.75) tq from events) select event_type, cast({CODED.format('ti', 'tq')} as int) as s, count(*) as n from events, p group by all")
def encode_percentile(spark, d):
    e = table(spark, d, "events")
    ti, tq = learn.percentile_thresholds(e, "value")
    return e.groupBy("event_type", st.encode("value", ti, tq).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with p as (select hour(ts) h, quantile_cont(value, 0.5) ti, quantile_cont(value, 0.75) tq from events group by 1)
select h as hour, cast({CODED.format('ti', 'tq')} as int) as s, count(*) as n from events join p on hour(ts) = h group by all""")
def encode_time_of_day(spark, d):
    e = table(spark, d, "events").select(F.hour("ts").cast("long").alias("hour"), "value")
    return learn.grouped_percentile_encode(e, "value", ["hour"]).groupBy("hour", F.col("s").cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"))


@query()
def encode_density_regions(spark, d):
    out = learn.density_regions_encode(table(spark, d, "events"), "value")
    return out.groupBy("event_type", F.col("s").cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"))


@query("with p as (select quantile_cont(l_quantity, 0.5) a, quantile_cont(l_extendedprice, 0.5) b from lineitem) select l_returnflag, cast(case when l_quantity > a then 2 else 0 end + case when l_extendedprice > b then 1 else 0 end as int) as s, count(*) as n from lineitem, p group by all")
def encode_dual(spark, d):
    out = learn.dual_encode(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.groupBy("l_returnflag", F.col("s").cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
_Q = "p as (select " + ", ".join(f"quantile_cont({c}, 0.5) i{k}, quantile_cont({c}, 0.75) q{k}" for k, c in enumerate(_COLS)) + " from lineitem), b as (select l_linestatus, " + ", ".join(f"({c} > i{k})::int x{k}, ({c} > q{k})::int y{k}" for k, c in enumerate(_COLS)) + " from lineitem, p)"


def _multi(how):
    def run(spark, d):
        out = learn.multi_encode(table(spark, d, "lineitem"), _COLS, how)
        return out.groupBy("l_linestatus", F.col("s").cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"))

    return run


for _name, _how, _i, _q in (("encode_multi_vote", "majority_vote", "x0 + x1 + x2 > 1.5", "y0 + y1 + y2 > 1.5"), ("encode_multi_all", "all", "x0 * x1 * x2 = 1", "y0 * y1 * y2 = 1"), ("encode_multi_any", "any", "x0 + x1 + x2 > 0", "y0 + y1 + y2 > 0")):
    QUERIES[_name] = _multi(_how)
    SQL[_name] = f"with {_Q} select l_linestatus, cast(case when {_i} then 2 else 0 end + case when {_q} then 1 else 0 end as int) as s, count(*) as n from b group by all"


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")


_CAND = """c as (select unnest(quantile_cont(l_quantity, [0.1, 0.3, 0.5, 0.7, 0.9])) t, generate_subscripts(quantile_cont(l_quantity, [0.1, 0.3, 0.5, 0.7, 0.9]), 1) - 1 k from lineitem),
x as (select k, t, (l_quantity > t)::int bit, (l_returnflag = 'R')::int y from lineitem, c)"""


def _scored(metric):
    def run(spark, d):
        li = table(spark, d, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
        cuts = li.agg(F.percentile("l_quantity", F.array(*map(F.lit, [0.1, 0.3, 0.5, 0.7, 0.9])))).first()[0]
        return learn.scored_candidates(li, "l_quantity", "y", cuts, metric).select(F.col("k").cast("long").alias("k"), "t", near(F.col("score")).alias("score"))

    return run


QUERIES["learn_correlation"] = _scored("correlation")
SQL["learn_correlation"] = f"with {_CAND} select k, t, round(coalesce(corr(bit, y), 0) + 3.21e-11, 6) as score from x group by k, t"
QUERIES["learn_accuracy"] = _scored("accuracy")
SQL["learn_accuracy"] = f"with {_CAND} select k, t, round(avg((bit = y)::int) + 3.21e-11, 6) as score from x group by k, t"
QUERIES["learn_mutual_info"] = _scored("mutual_info")
SQL["learn_mutual_info"] = f"""with {_CAND}, n as (select k, t, bit, y, count(*)::double n from x group by all), m as (select *, sum(n) over (partition by k) a, sum(n) over (partition by k, bit) b, sum(n) over (partition by k, y) e from n)
select k, t, round(sum(n / a * ln(n * a / (b * e))) + 3.21e-11, 6) as score from m group by k, t"""


@query("""select 'rsi' as feature, cast(50 as double) as ti, cast(70 as double) as tq union all select 'value', quantile_cont(value, 0.5), quantile_cont(value, 0.75) from events""")
def learn_domain(spark, d):
    e = table(spark, d, "events")
    rows = [("rsi", *learn.domain_thresholds(e, "rsi", "trading")), ("value", *learn.domain_thresholds(e, "value", "trading"))]
    return spark.createDataFrame(rows, "feature string, ti double, tq double")


@query()
def learn_supervised(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    ti, tq = learn.supervised_thresholds(li, "l_quantity", "y")
    return spark.createDataFrame([(ti, tq, learn.optimal_threshold(li, "l_quantity", "y"))], "ti double, tq double, best double")


@query()
def learn_kmeans(spark, d):
    return spark.createDataFrame([learn.kmeans_thresholds(table(spark, d, "events"), "value")], "ti double, tq double")


@query()
def bootstrap_ci(spark, d):
    return learn.bootstrap(table(spark, d, "events"), "value")


# interpreters


@query(f"with {E} select event_id, (['sell', 'hold', 'hold', 'buy'])[s + 1] as decision, (['∅', 'review', 'δ', 'go'])[s + 1] as custom from events_s")
def interpret_rules(spark, d):
    return coded(spark, d).select("event_id", interpret.rules("s").alias("decision"), interpret.rules("s", {1: "review", 3: "go"}).alias("custom"))


_D = f"d as (select d.doc_id, {_c('n_chars', 1000, 3000)} s, quality from documents d left join labels l using (doc_id))"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("s", st.encode("n_chars", 1000.0, 3000.0))


@query(f"""with {_D}, c as (select s, quality, count(*) n from d where quality is not null group by all), b as (select s, quality, row_number() over (partition by s order by n desc, quality) r from c),
o as (select quality from (select quality, sum(n) n from c group by 1) order by n desc, quality limit 1)
select d.doc_id, cast(d.s as int) as s, coalesce(b.quality, (select quality from o)) as decision from d left join b on b.s = d.s and r = 1""")
def interpret_lookup(spark, d):
    return interpret.lookup(_docs(spark, d), "s", "quality").select("doc_id", F.col("s").cast("int").alias("s"), "decision")


@query(f"with {_D}, c as (select s, quality, count(*) n from d where quality is not null group by all) select cast(s as int) as s, quality, n, round(n / sum(n) over (partition by s) + 3.21e-11, 6) as p from c")
def interpret_probabilistic(spark, d):
    return interpret.probabilities(_docs(spark, d), "s", "quality").select(F.col("s").cast("int").alias("s"), "quality", "n", near(F.col("p")).alias("p"))


@query(f"""with {E}, v as (select event_id, (['sell', 'hold', 'hold', 'buy'])[s + 1] a, (case when value > 40 then 'buy' else 'sell' end) b, (case when user_id % 2 = 0 then 'buy' else 'hold' end) c from events_s)
select event_id, case when a = b or a = c then a when b = c then b else least(a, b, c) end as majority, case when a = b and b = c then a else 'hold' end as unanimous, case when b = c then b else a end as weighted from v""")
def interpret_ensemble(spark, d):
    votes = [interpret.rules("s"), F.when(F.col("value") > 40, "buy").otherwise("sell"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("hold")]
    return coded(spark, d).select("event_id", interpret.ensemble(votes).alias("majority"), interpret.ensemble(votes, "unanimous").alias("unanimous"), interpret.ensemble(votes, "weighted", [1.5, 1.0, 1.0]).alias("weighted"))


@query(f"""with {E}, l as (select event_id, s, lag(s) over w a, lag(s, 2) over w b from events_s window w as (partition by user_id order by ts, event_id))
select event_id, case when s = 3 and a = 3 and b = 3 then 'strong' when s = 3 and a = 0 then 'jump' when s = 0 then 'quiet' else 'hold' end as decision from l""")
def pattern_sequences(spark, d):
    return interpret.match_patterns(coded(spark, d), "s", ["ts", "event_id"], ["user_id"], [((0,), "quiet", 0.3), ((0, 3), "jump", 0.6), ((3, 3, 3), "strong", 0.9), ((3, 3, 3, 3), "never", 1.0)]).select("event_id", "decision")


# pipelines and quality


@query(f"""with {_H}, f as (select event_id, coalesce(value, (select quantile_cont(value, 0.5) from h)) v from h), b as (select quantile_cont(v, 0.01) a, quantile_cont(v, 0.99) z from f), k as (select event_id, least(greatest(v, a), z) v from f, b),
p as (select avg(v) m, stddev_pop(v) s from k), x as (select event_id, (v - m) / s v from k, p), t as (select quantile_cont(v, 0.5) ti, quantile_cont(v, 0.75) tq from x)
select decision, count(*) as n from (select (['sell', 'hold', 'hold', 'buy'])[(case when v > ti then 2 else 0 end + case when v > tq then 1 else 0 end) + 1] decision from x, t) group by decision""")
def pipeline_end_to_end(spark, d):
    made = PipelineBuilder("value").with_missing_data_handling().with_outlier_removal().with_standard_scaling().with_learned_encoding().with_rule_based_interpretation().build()
    return made.fit_transform(_holes(spark, d)).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query()
def pipeline_auto(spark, d):
    rows = _holes(spark, d)
    return auto_pipeline(rows, "value").fit_transform(rows).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {E}, c as (select event_type, s, count(*)::double n from events_s group by all), p as (select event_type, n / sum(n) over (partition by event_type) p from c) select event_type, round(-sum(p * log2(p)) + 3.21e-11, 6) as bits, round(-sum(p * log2(p)) / 2 + 3.21e-11, 6) as balance from p group by event_type")
def q_entropy(spark, d):
    return metrics.information(coded(spark, d), "s", "event_type").select("event_type", near(F.col("bits")).alias("bits"), near(F.col("balance")).alias("balance"))


@query(f"""with {_D}, c as (select s, quality, count(*) n from d where quality is not null group by all), b as (select s, quality, row_number() over (partition by s order by n desc, quality) r from c)
select round(avg((b.quality = d.quality)::int) + 3.21e-11, 6) as accuracy from d join b on b.s = d.s and r = 1 where d.quality is not null""")
def q_accuracy(spark, d):
    return metrics.accuracy(_docs(spark, d), "s", "quality").select(near(F.col("accuracy")).alias("accuracy"))


@query(f"""with {E}, n as (select s x, event_type y, count(*)::double n from events_s group by all), m as (select n, sum(n) over () t, sum(n) over (partition by x) nx, sum(n) over (partition by y) ny from n),
a as (select sum(n / t * log2(n * t / (nx * ny))) mi, -sum(n / t * log2(nx / t)) hx, -sum(n / t * log2(ny / t)) hy from m)
select round(mi + 3.21e-11, 6) as mi, round(hx + 3.21e-11, 6) as hx, round(hy + 3.21e-11, 6) as hy, round(greatest(0, mi / least(hx, hy)) + 3.21e-11, 6) as normalised from a""")
def q_mutual_information(spark, d):
    out = metrics.mutual_information(coded(spark, d), "s", "event_type")
    return out.select(*[near(F.col(c)).alias(c) for c in out.columns])


@query(f"""with {E}, g as (select s, count(*)::double n, avg(value) m, var_pop(value) v from events_s group by s), a as (select sum(n * m * m) / sum(n) - power(sum(n * m) / sum(n), 2) b, sum(n * v) / sum(n) w from g)
select round(b + 3.21e-11, 4) as between, round(w + 3.21e-11, 4) as within, round(b / (b + w) + 3.21e-11, 6) as ratio from a""".replace(" as between", ' as "between"'))
def q_variance_ratio(spark, d):
    out = metrics.variance_ratio(coded(spark, d), "s", "value")
    return out.select(near(F.col("between"), 4).alias("between"), near(F.col("within"), 4).alias("within"), near(F.col("ratio")).alias("ratio"))


@query(f"""with {E}, w as (select event_type, count(*) over f c, greatest(sum((s = 0)::int) over f, sum((s = 1)::int) over f, sum((s = 2)::int) over f, sum((s = 3)::int) over f) / 10.0 m from events_s window f as (partition by event_type order by ts, event_id rows between current row and 9 following))
select event_type, round(avg(m) + 3.21e-11, 6) as consistency, count(*) as windows from w where c = 10 group by event_type""")
def q_consistency(spark, d):
    return metrics.consistency(coded(spark, d), "s", ["ts", "event_id"], ["event_type"]).select("event_type", near(F.col("consistency")).alias("consistency"), "windows")


@query(f"""with {E}, r as (select s, (case when value > 40 then 'buy' else 'sell' end) d from events_s), e as (select s, count(distinct d) n from r group by s)
select round(avg((n > 1)::int) + 3.21e-11, 6) as ambiguity, round(avg(1.0 / n) + 3.21e-11, 6) as determinism, count(*) / 4.0 as coverage, round(0.3 * (1 - avg((n > 1)::int)) + 0.4 * avg(1.0 / n) + 0.3 * count(*) / 4.0 + 3.21e-11, 6) as clarity from e""")
def x_clarity(spark, d):
    out = metrics.decision_clarity(coded(spark, d).withColumn("d", F.when(F.col("value") > 40, "buy").otherwise("sell")), "s", "d")
    return out.select(*[near(F.col(c)).alias(c) for c in out.columns])


@query(f"""with {E}, c as (select s, (case when value > 40 then 'buy' else 'sell' end) d, count(*)::double n from events_s group by all)
select round(sum(case when a.d = b.d then a.n * b.n else 0 end) / sum(a.n * b.n) + 3.21e-11, 6) as consistency from c a join c b on a.s < b.s and bit_count(xor(a.s, b.s)) = 1""")
def x_consistency(spark, d):
    out = metrics.interpretation_consistency(coded(spark, d).withColumn("d", F.when(F.col("value") > 40, "buy").otherwise("sell")), "s", "d")
    return out.select(near(F.col("consistency")).alias("consistency"))
