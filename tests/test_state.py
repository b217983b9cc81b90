"""States, algebra, lattice, nested and parallel channels: all combinations against plain Python."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from fourfold.functions import checks
from fourfold.functions import nested as ns
from fourfold.functions import parallel as pl
from fourfold.functions import state as st
from fourfold.operators import tables
from fourfold.sources import tables as io

E, P, D, S = 0, 1, 2, 3


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(list(itertools.product(range(4), range(4))), "a tinyint, b tinyint").cache()


def test_algebra(spark, pairs):
    a, b = F.col("a"), F.col("b")
    got = pairs.select("a", "b", *[f(a).alias(n) for n, f in (("gate", st.gate), ("admit", st.admit), ("comp", st.comp), ("ni", st.neg_i), ("nq", st.neg_q))], st.overlay(a, b).alias("o"), st.weave(a, b).alias("w"), st.distance(a, b).alias("d"), st.leq(a, b).alias("leq"), st.comparable(a, b).alias("c"), st.symbol(a).alias("symbol")).collect()
    for r in got:
        i, q = r.a >> 1, r.a & 1
        assert r.gate == (0 if not q and i else r.a) and r.admit == (3 if i else r.a)
        assert (r.comp, r.ni, r.nq) == (3 - r.a, r.a ^ 2, r.a ^ 1)
        assert (r.o, r.w, r.d) == (r.a | r.b, r.a & r.b, bin(r.a ^ r.b).count("1"))
        assert r.leq == (r.a & r.b == r.a) and r.c == (r.a & r.b in (r.a, r.b)) and r.symbol == "∅φδψ"[r.a]
    assert dict(pairs.select(st.gate("a").alias("x")).dtypes) == {"x": "tinyint"}


def test_every_unary_table_and_chain(spark, pairs):
    some = [(0, 0, 0, 0), (3, 1, 2, 0), (1, 2, 3, 3)]
    rows = pairs.select("a", *[st.table_op(t)("a").alias(f"t{k}") for k, t in enumerate(some)]).distinct().collect()
    assert all(r[1 + k] == t[r.a] for r in rows for k, t in enumerate(some))
    for names in itertools.product(["gate", "admit", "comp", "neg_i"], repeat=3):
        table = list(range(4))
        for n in names:
            table = [st.TABLES[n][t] for t in table]
        assert st.simplify(names) == tuple(table)
    assert st.simplify(["gate", "admit", "gate"]) == st.TABLES["gate"] and st.simplify(["comp", "comp"]) == st.TABLES["identity"]
    two = st.table_op2([min(a, b) for a in range(4) for b in range(4)])
    assert all(r.m == min(r.a, r.b) for r in pairs.select("a", "b", two("a", "b").alias("m")).collect())
    with pytest.raises(ValueError):
        st.table_op((0, 1, 2, 4))


def test_stated_examples(spark):
    df = spark.createDataFrame([(k, s) for k, s in enumerate([S, D, P, E])], "pos int, s tinyint")
    column = lambda f: [r[0] for r in df.orderBy("pos").select(f).collect()]
    assert column(st.gate("s")) == [S, E, P, E] and column(st.admit("s")) == [S, S, P, E]
    assert column(st.compose(st.gate, st.admit, st.neg_i)("s"))[3] == S
    rows = spark.createDataFrame([(E, P, S, D), (D, P, S, P)], "a tinyint, b tinyint, c tinyint, d tinyint")
    assert [tuple(r) for r in rows.select(st.overlay("a", "b"), st.weave("c", "d")).collect()] == [(P, D), (S, P)]


def test_encoding_of_odd_values(spark):
    rows = [(None, E), (float("nan"), E), (0.5, E), (0.6, D), (0.75, D), (0.8, S), (float("inf"), S), (-1.0, E)]
    got = spark.createDataFrame([r[:1] for r in rows], "x double").select(st.encode("x", 0.5, 0.75)).collect()
    assert [r[0] for r in got] == [r[1] for r in rows]


def test_names_bits_and_errors(spark):
    names = spark.createDataFrame([(n,) for n in ["PSI", " hole ", "puncture", "null", "δ", "what", None]], "n string")
    assert [r[0] for r in names.select(st.from_name("n")).collect()] == [S, P, D, E, D, None, None]
    bits = spark.createDataFrame([(1, 0), (0, 1)], "i int, q int")
    assert [r[0] for r in bits.select(st.from_bits("i", "q")).collect()] == [D, P]
    with pytest.raises(Exception, match="0 or 1"):
        spark.createDataFrame([(2, 0)], "i int, q int").select(st.from_bits("i", "q")).collect()
    with pytest.raises(Exception, match="0..3"):
        spark.range(5, 6).select(st.from_int("id")).collect()


def test_aggregates_and_laws(spark):
    df = spark.createDataFrame([("a", S), ("a", D), ("b", P), ("b", None)], "k string, s tinyint")
    got = {r.k: (r.meet, r.join) for r in tables.rollup_lattice(df, "s", "k").collect()}
    assert got == {"a": (D, S), "b": (P, P)}
    assert df.where("false").agg(st.meet_all("s"), st.join_all("s")).first()[:] == (S, E)
    laws = tables.lattice_properties(spark).first()
    assert all(laws[:4]) and laws.n_elements == 4
    chains = {tuple(r.chain) for r in tables.lattice_chains(spark).where("a = 0 and b = 3").collect()}
    assert chains == {(E, D, S), (E, P, S)}
    assert tables.closed(spark, st.gate) and not tables.closed(spark, lambda s: s + 2)
    assert [r.n_psi for r in tables.histogram(df, "s").collect()] == [1]
    assert {r.s: r["rank"] for r in tables.distribution(df.where("k = 'a'"), "s").collect()} == {D: 1, S: 2}


def test_channel_joins(spark):
    a = spark.createDataFrame([("x", D), ("y", S), ("w", P)], "k string, s tinyint")
    b = spark.createDataFrame([("y", P), ("z", S), ("w", D)], "k string, s tinyint")
    got = lambda m: {r.k: r.s for r in tables.combine(a, b, ["k"], st.weave, m).collect()}
    both = {"y": P, "w": E}
    assert got("skip") == both and got("keep_left") == both | {"x": D} and got("keep_right") == both | {"z": S} and got("keep_both") == both | {"x": D, "z": S}
    assert {r.k: r.s for r in tables.merge(a, b, ["k"]).collect()} == {"x": D, "y": S, "z": S, "w": S}
    assert [r.k for r in tables.unmatched(a, b, ["k"]).collect()] == ["x"] and tables.matched(a, b, ["k"]).count() == 2
    with pytest.raises(ValueError):
        got("other")
    votes = spark.createDataFrame([("g", S, 1.0), ("g", D, 1.0), ("g", E, None)], "g string, s tinyint, w double")
    assert tables.vote(votes, "s", "w", "g").first().vote == D


def test_nested(spark):
    df = spark.createDataFrame([([S, P],), ([],), ([E, E, S],)], "a array<tinyint>")
    got = df.select(ns.depth("a").alias("d"), ns.path("a").alias("p"), ns.all_are("a", S).alias("all"), ns.count_of("a", E).alias("n"), ns.path_matches("a", "ψ.*").alias("m1"), ns.path_matches("a", "δ.*").alias("m2"), ns.total_states("a").alias("t"), ns.meet_levels("a").alias("meet"), ns.to_map("a").alias("map")).collect()
    assert [tuple(r) for r in got] == [(1, "ψ.φ", False, 0, True, False, 16, P, {0: S, 1: P}), (-1, "", True, 0, False, False, 1, S, {}), (2, "∅.∅.ψ", False, 2, False, False, 64, E, {0: E, 1: E, 2: S})]
    assert df.select(ns.set_level("a", 0, D)).collect()[0][0] == [D, P]
    assert df.where(F.size("a") == 2).select(ns.set_level("a", 2, D)).first()[0] == [S, P, D]
    with pytest.raises(Exception, match="contiguous"):
        df.select(ns.set_level("a", 3, D)).collect()
    assert spark.createDataFrame([("ψ.φ.δ",)], "p string").select(ns.from_path("p")).first()[0] == [S, P, D]


def test_parallel(spark):
    df = spark.createDataFrame([({"a": S, "b": D, "c": P},), ({},)], "m map<string,tinyint>")
    r = df.select(pl.meet("m").alias("meet"), pl.join("m").alias("join"), pl.matches("m", {"a": S, "b": [D, P]}).alias("hit"), pl.matches("m", {"z": "*"}).alias("absent"), pl.weighted_vote("m").alias("v"), pl.weighted_vote("m", {"b": 5.0}).alias("w"), pl.compact("m").alias("t"), pl.names_in("m", D).alias("n"), pl.majority_is("m", S).alias("maj"), pl.described("m").alias("d"), pl.summary("m").alias("sum"), pl.distribution("m").alias("dist")).collect()
    assert (r[0].meet, r[0].join, r[0].hit, r[0].absent, r[0].v, r[0].w, r[0].t, r[0].n, r[0].maj) == (E, S, True, False, S, D, "ψδφ", ["b"], False)
    assert r[0].d == "(a:ψ, b:δ, c:φ)" and r[0]["sum"].startswith("a: ψ\nb: δ\nc: φ\n∅ 0.0%") and r[0].dist.psi == 1
    assert (r[1].meet, r[1].join, r[1].t) == (S, E, "")
    two = spark.createDataFrame([({"a": S, "b": D}, {"b": P, "c": S})], "x map<string,tinyint>, y map<string,tinyint>")
    assert two.select(pl.merge("x", "y")).first()[0] == {"a": S, "b": S, "c": S}
    assert two.select(pl.combine("x", "y", st.weave)).first()[0] == {"b": E}
    assert two.select(pl.put("x", "b", E), pl.select("x", ["a", "q"]), pl.apply_all("x", st.admit)).first()[:] == ({"a": S, "b": E}, {"a": S}, {"a": S, "b": S})


def test_checks(spark):
    assert checks.threshold_pair(0.1, 0.2) == (0.1, 0.2) and checks.window_size(3) == 3 and checks.state_bits(1, 0) == (1, 0)
    for bad in (lambda: checks.threshold_pair(2, 1), lambda: checks.threshold(math.nan), lambda: checks.probability(1.5), lambda: checks.window_size(0), lambda: checks.positive(0), lambda: checks.state_bits(2, 0), lambda: checks.columns(spark.range(1), "x"), lambda: checks.finite(spark.createDataFrame([(None,)], "x double"), "x"), lambda: checks.same_length(spark.range(1), spark.range(2))):
        with pytest.raises(checks.CheckError):
            bad()
    with pytest.raises(checks.CheckError, match="load: "), checks.Context("load"):
        checks.positive(-1)


def test_json_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(D, [S, P], {"a": D})], "s tinyint, a array<tinyint>, m map<string,tinyint>")
    text = df.select(io.state_json("s").alias("s"), io.nested_json("a").alias("a"), io.channels_json("m").alias("m"))
    assert text.select(io.state_from_json("s"), io.nested_from_json("a"), io.channels_from_json("m")).first()[:] == (D, [S, P], {"a": D})
    io.write_batch({"one": df, "two": spark.range(3).toDF("x")}, str(tmp_path / "batch"))
    back = io.read_batch(spark, str(tmp_path / "batch"))
    assert back["one"].first() == df.first() and back["two"].count() == 3
    io.save_params(spark, str(tmp_path / "p"), {"ti": 0.5, "names": ["a"]})
    assert io.load_params(spark, str(tmp_path / "p")) == {"ti": 0.5, "names": ["a"]}
    with pytest.raises(ValueError):
        io.load_params(spark, str(tmp_path / "p"), version="2")
    io.write(df.select("s"), str(tmp_path / "x.json"), "json")
    assert io.read(spark, str(tmp_path / "x.json")).first()[0] == D
