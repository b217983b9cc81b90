"""Series, learners, fields, topology, metrics, plans, streams on small inputs with known answers."""

from __future__ import annotations

import math
import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from fourfold.functions import scorer, scoring
from fourfold.functions import state as st
from fourfold.operators import adaptive, apps, combinators, fields, graphs, interpret, learn, metrics, preprocess, series, topology
from fourfold.plans import pipeline
from fourfold.plans.lazy import query
from fourfold.sources import generators
from fourfold.streaming import stateful, windows

NAN = float("nan")


def column(df, c, order="t"):
    return [r[0] for r in df.orderBy(order).select(c).collect()]


def line(spark, values):
    return spark.createDataFrame([("k", t, None if v is None else float(v)) for t, v in enumerate(values)], "k string, t int, v double")


def test_missing_values(spark):
    df = line(spark, [1, 2, NAN, None, 5, NAN, 7])
    assert column(preprocess.forward_fill(df, "v", ["t"], ["k"]), "v") == [1, 2, 2, 2, 5, 5, 7]
    assert column(preprocess.backward_fill(df, "v", ["t"], ["k"]), "v") == [1, 2, 5, 5, 5, 7, 7]
    assert column(preprocess.interpolate(line(spark, [1, 2, NAN, NAN, 5]), "v", ["t"], ["k"]), "v") == [1, 2, 3, 4, 5]
    assert column(preprocess.Imputer("v", strategy="mean").fit_transform(line(spark, [1, 2, NAN, 4, NAN, 6])), "v")[2] == 3.25
    assert column(preprocess.Imputer("v", strategy="drop").fit_transform(df), "v") == [1, 2, 5, 7]
    assert column(preprocess.Imputer("v", strategy="most_frequent").fit_transform(line(spark, [2, 2, 1, 1, None])), "v")[4] == 1
    nothing = line(spark, [None, NAN])
    assert column(preprocess.Imputer("v").fit_transform(nothing), "v") == [None, None] and column(preprocess.forward_fill(nothing, "v", ["t"], ["k"]), "v") == [None, None]


def test_scalers(spark):
    same = line(spark, [4, 4, 4])
    for s, want in ((preprocess.StandardScaler("v"), 0.0), (preprocess.RobustScaler("v"), 0.0), (preprocess.MinMaxScaler("v", low=2.0, high=3.0), 2.0)):
        assert column(s.fit_transform(same), "v") == [want] * 3
    assert column(preprocess.MinMaxScaler("v").fit_transform(line(spark, [0, 5, 10])), "v") == [0, 0.5, 1]
    with pytest.raises(RuntimeError):
        preprocess.StandardScaler("v").transform(same)
    kept = preprocess.Outliers("v", method="remove", bounds="iqr", width=1.5).fit_transform(line(spark, [1, 2, 3, 4, 100, None]))
    assert column(kept, "v") == [1, 2, 3, 4, None]


def test_learners(spark):
    df = spark.createDataFrame([(float(k), int(k > 60)) for k in range(1, 101)], "x double, y int")
    ti, tq = learn.supervised_thresholds(df, "x", "y")
    assert 55 < ti < 65 and tq >= ti
    assert abs(learn.optimal_threshold(df, "x", "y") - 60) < 2 and abs(learn.optimal_threshold(df, "x") - 50) < 2
    brute = {t: np.corrcoef([x > t for x in range(1, 101)], [x > 60 for x in range(1, 101)])[0, 1] for t in (20.0, 60.0)}
    got = {r.t: r.score for r in learn.scored_candidates(df, "x", "y", [20.0, 60.0]).collect()}
    assert all(got[t] == pytest.approx(brute[t]) for t in brute)
    assert learn.domain_thresholds(df, "rsi", "trading") == (50.0, 70.0) and learn.domain_thresholds(df, "x", "none") == (50.5, 75.25)
    few = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert learn.kmeans_thresholds(few, "x") == (1.0, 1.0)
    a = learn.bootstrap(df, "x", 40).first()
    assert list(a) == pytest.approx(list(learn.bootstrap(df.repartition(5), "x", 40).first())) and abs(a.ti_mean - 50) < 4 and a.ti_low < a.ti_high and a.replicates == 40
    weights = learn.label_weights(df.withColumn("c", F.lit(1.0)), ["x", "c"], "y")
    assert weights[0] > 0.8 and weights[1] == 0.0
    coded = learn.multi_encode(df.withColumn("z", -F.col("x")), ["x", "z"], "weighted", weights=[3.0, 1.0])
    assert coded.where("x = 100").first().s == 3 and coded.where("x = 1").first().s == 0
    regions = learn.density_regions_encode(df, "x", 3, 10)
    assert regions.count() == 100 and regions.where("s = 3").count() > 10 and learn.density_regions_encode(df, "x", 3, 10, "middle").where("s = 3").count() > 10
    hours = df.withColumn("g", F.when(F.col("x") <= 2, 0).otherwise(1))
    assert learn.grouped_percentile_encode(hours, "x", ["g"], least_rows=10).where("x = 2").first().s == 0


def test_interpreters(spark):
    df = spark.createDataFrame([("k", t, s, y) for t, (s, y) in enumerate([(3, "b"), (3, "a"), (0, "a"), (2, None), (3, "a")])], "k string, t int, s tinyint, y string")
    assert {r.s: r.decision for r in interpret.lookup(df, "s", "y").select("s", "decision").distinct().collect()} == {3: "a", 0: "a", 2: "a"}
    assert {(r.s, r.y): r.p for r in interpret.probabilities(df, "s", "y").collect()}[(3, "a")] == pytest.approx(2 / 3)
    out = interpret.match_patterns(df, "s", ["t"], ["k"], [((3,), "low", 0.2), ((3, 3), "high", 0.8), ((2, 3), "", 0.9)])
    assert column(out, "decision") == ["low", "high", "hold", "hold", "hold"]
    votes = [F.lit("b"), F.lit("a"), F.lit("c")]
    assert df.limit(1).select(interpret.ensemble(votes), interpret.ensemble(votes, "weighted", [1, 1, 1]), interpret.ensemble(votes, "weighted", [1, 1, 5]), interpret.ensemble(votes, "unanimous")).first()[:] == ("a", "b", "c", "hold")
    assert [r.t for r in interpret.find_pattern(df, "s", ["t"], ["k"], [3, 0]).collect()] == [1]


def test_indicators(spark):
    df = line(spark, [10, 11, 12, 11, 13])
    w = series.ordered(["k"], ["t"])
    assert column(df.withColumn("m", series.sma("v", w, 3)), "m") == [None, None, 11, pytest.approx(34 / 3), 12]
    assert column(series.rsi(df, "v", ["k"], ["t"], 3), "rsi")[2:] == [100.0, pytest.approx(100 - 100 / 3), pytest.approx(75)]
    flat = series.rsi(line(spark, [5, 5, 5, 5]), "v", ["k"], ["t"], 3)
    assert column(flat, "rsi") == [None] * 4
    assert column(series.ema(df, "v", ["k"], ["t"], {"e": 3}), "e") == [10, 10.5, 11.25, 11.125, 12.0625]
    assert series.drawdown(df, "v", ["k"], ["t"]).first().max_drawdown == pytest.approx(-1 / 12)
    gone = series.runs(df, F.col("v") > 10.5, ["k"], ["t"]).first()
    assert (gone.longest, gone.runs) == (4, 1)


def test_folds(spark):
    df = spark.createDataFrame([("k", t, s) for t, s in [(2, 0), (0, 3), (1, 3), (3, 2)]] + [("j", 0, 1)], "k string, t int, s tinyint")
    out = series.score_fold(df, "s", ["k"], ["t"], interpret.DEFAULT_SCORES)
    assert column(out.where("k = 'k'"), "score") == [1.0, 1.9, pytest.approx(0.71), pytest.approx(0.939)] and column(out.where("k = 'j'"), "decision") == ["hold"]
    moves = [("a", 3, "b", "go"), ("b", 3, "b", "stay"), ("b", 0, "a", "back"), ("a", 3, "c", "never")]
    got = series.machine(df, "s", ["k"], ["t"], moves, "a")
    assert column(got.where("k = 'k'"), "action") == ["go", "stay", "back", "hold"] and column(got.where("k = 'k'"), "mode") == ["b", "b", "a", "a"]
    fired = series.accumulate(df, "s", ["k"], ["t"], {3: 2.0, 2: 1.0, 1: 0.5, 0: 0.0})
    assert column(fired.where("k = 'k'"), "fired") == [False, True, False, False]
    total = series.fold(df, ["k"], ["t"], F.col("s"), F.lit(""), lambda a, s: F.concat(a, s.cast("string")))
    assert {r.k: r.folded for r in total.collect()} == {"k": "3302", "j": "1"}
    book = spark.createDataFrame([("k", t, p, a) for t, (p, a) in enumerate([(10.0, "buy"), (20.0, "hold"), (20.0, "sell"), (5.0, "sell")])], "k string, t int, close double, decision string")
    curve = series.backtest(book, ["k"], ["t"], capital=1000.0, commission=0.0)
    assert column(curve, "equity") == [1000, 2000, 2000, 2000] and column(curve, "traded") == [True, False, True, False]
    assert series.performance(curve, ["k"], ["t"], 1000.0).first().total_return == 1.0


def test_trackers(spark):
    rng = np.random.default_rng(0)
    values = [float(x) for x in rng.normal(10, 2, 400)]
    df = spark.createDataFrame([("k", t, v) for t, v in enumerate(values)], "k string, t int, v double").repartition(3)
    last = adaptive.track_moments(df, "v", ["k"], ["t"]).orderBy(F.desc("t")).first()
    assert last.mean == pytest.approx(np.mean(values)) and last.std == pytest.approx(np.std(values, ddof=1))
    first = adaptive.track_moments(df, "v", ["k"], ["t"]).orderBy("t").first()
    assert (first.threshold_i, first.threshold_q, first.s) == (0.0, 0.0, 3)
    two = np.concatenate([rng.normal(0, 1, 300), rng.normal(20, 1, 300)])
    assert adaptive.shape(two)["modality"] == 2 and adaptive.shape(two)["components"] == 2
    name, ti, tq = adaptive.shape_thresholds(two, adaptive.shape(two))
    assert name == "multimodal" and -3 < ti < 20.5 and 18 < tq < 22
    tail = rng.exponential(1, 500) ** 2
    assert adaptive.shape_thresholds(tail, adaptive.shape(tail) | {"modality": 1})[0] == "heavy_tailed"
    assert adaptive.shape(np.ones(50))["modality"] == 1 and adaptive.shape(np.ones(3))["skew"] == 0.0
    assert [adaptive.classify(*x) for x in ((0.1, 0.2, 0.3), (1, 3, 3), (1, 3, 1), (0.2, 1, 1), (1, 0.2, 0.6), (1, 1, 1))] == ["stable", "volatile", "transitioning", "trending", "mean_reverting", "unknown"]
    scales = adaptive.track_scales(df, "v", ["k"], ["t"])
    assert scales.count() == 400 and scales.where("regime <> 'unknown'").count() > 0


def cells(spark, rows):
    return spark.createDataFrame([(0, x, y, s) for y, r in enumerate(rows) for x, s in enumerate(r)], "field_id int, x int, y int, s tinyint")


def drawn(df, c="s"):
    rows = df.select("x", "y", c).collect()
    out = [[None] * (max(r.x for r in rows) + 1) for _ in range(max(r.y for r in rows) + 1)]
    for r in rows:
        out[r.y][r.x] = r[c]
    return out


def test_fields_by_hand(spark):
    f = cells(spark, [[3, 0, 0], [0, 0, 0], [0, 0, 2]])
    assert drawn(fields.dilate(f)) == [[3, 3, 0], [3, 3, 0], [0, 0, 2]]
    assert drawn(fields.erode(f))[0][0] == 2
    assert drawn(fields.boundaries(f)) == [[3, 3, 0], [3, 3, 3], [0, 3, 3]]
    one = cells(spark, [[3]])
    assert drawn(fields.convolve(one, "box", "zero")) == [[0]]
    for b in ("periodic", "extend", "constant"):
        assert drawn(fields.convolve(one, "box", b)) == [[3]]
    assert drawn(fields.gradient(cells(spark, [[0, 2, 2]])), "grad_i") == [[1.0, 0.5, 0.0]]
    assert {(r.x, r.y): r.label for r in fields.components(cells(spark, [[3, 0, 3], [3, 0, 3], [0, 3, 0]])).collect()} == {(0, 0): 1, (0, 1): 1, (2, 0): 2, (2, 1): 2, (1, 2): 3}
    assert {r.label for r in fields.components(cells(spark, [[3, 0, 3], [3, 0, 3], [0, 3, 0]]), full=True).collect()} == {1}
    ring = cells(spark, [[3, 3, 3], [3, 0, 3], [3, 3, 3]])
    assert fields.euler(ring).first().euler == 0
    blinker = cells(spark, [[0, 0, 0], [3, 3, 3], [0, 0, 0]])
    assert drawn(fields.automaton(blinker, fields.life)) == [[0, 3, 0], [0, 3, 0], [0, 3, 0]]
    assert drawn(fields.automaton(blinker, fields.life, 6)) == drawn(blinker)
    assert fields.distance(ring, blinker).first().similarity == pytest.approx(2 / 9)
    assert fields.match(ring, [(0, 0, 3), (1, 0, 0)], 1.0).count() == 1
    assert fields.reduce(ring, "weave", 3).first().s == 0 and fields.reduce(ring).first().s == 3
    assert drawn(fields.plane(fields.grid3(spark, 2, 2, 2, F.col("z") + F.col("x")), "x", 1)) == [[1, 2], [1, 2]]
    made = fields.grid(spark, 8, 8, fields.mandelbrot(8, 8))
    assert made.agg(F.countDistinct("s")).first()[0] > 1 and made.where("x = 5 and y = 4").first().s == 3


def test_field_queries(spark):
    f = cells(spark, [[3, 2], [1, 0]])
    q = query(f).gate().admit().comp().comp().where(lambda s: s >= 2).dilate()
    assert drawn(q.compute()) == [[3, 3], [3, 3]] and "point(0, 1, 0, 3)" in q.explain()
    assert drawn(query(f).comp().comp().compute()) == [[3, 2], [1, 0]] and query(f).comp().comp().optimised() == ()
    assert drawn(query(f).overlay(query(f).comp()).compute()) == [[3, 3], [3, 3]] and drawn(query(f).select(lambda s: s.bitwiseAND(st.lit(1))).compute()) == [[1, 0], [1, 0]]
    both = pipeline.parallel(fields.dilate, fields.boundaries)(f)
    assert drawn(both) == [[3, 3], [3, 3]] and drawn(pipeline.compose(fields.erode, fields.dilate)(f)) == [[3, 3], [3, 3]]


def test_point_clouds(spark):
    rng = np.random.default_rng(2)
    data = np.vstack([rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (15, 3))])
    points = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(data)], "id long, p array<double>")
    d = np.sqrt(((data[:, None] - data[None]) ** 2).sum(axis=2))
    for t in (0.15, 1.0, 12.0):
        assert topology.close_pairs(points, t).count() == int((d[np.triu_indices(35, 1)] <= t).sum())
    found = topology.betti(points, 1.0).first()
    assert found.b0 == 2 and found.b1 == found.e - found.v + 2
    h0 = topology.persistence_h0(points)
    assert topology.alive(h0, 1.0).first().betti == 2 and topology.top_features(h0.where("death < 1e9"), 1).first().persistence > 5
    assert topology.pca_dimension(points) == 1
    near = topology.nearest(points, points.where("id = 0"), 3)
    assert [r.id for r in near.orderBy("rank").collect()] == np.argsort(d[0])[1:4].tolist()
    assert all(len({m for m in f(data, 5)[:20] if m >= 0} & {m for m in f(data, 5)[20:] if m >= 0}) == 0 for f in (topology.cluster_linkage, topology.cluster_density, topology.cluster_means, topology.cluster_components))
    assert topology.manifold(points).first()[:4] == (3, 1, pytest.approx(1 / 3), True) and 0 <= topology.curvature(points, points.where("id < 3"), 8).agg(F.max("curvature")).first()[0] < 1
    nodes, edges = topology.mapper(points, 5)
    assert nodes.select("node").distinct().count() >= 2 and edges.where("a >= b").count() == 0


def test_persistence_of_a_circle():
    angle = np.arange(12) / 12 * 2 * math.pi
    found = topology.rips(np.stack([np.cos(angle), np.sin(angle)], axis=1), 3.0)
    loops = [(b, e) for dim, b, e in found if dim == 1 and e - b > 0.3]
    assert len(loops) == 1 and sum(dim == 0 and math.isinf(e) for dim, _, e in found) == 1
    a, b = np.array([[0.0, 2.0], [1.0, 1.5]]), np.array([[0.0, 2.2]])
    assert topology.matching_distance(a, b) == pytest.approx(0.25) and topology.matching_distance(a, b, 1) == pytest.approx(0.45) and topology.matching_distance(a, a, 2) == 0


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(5)
    data = np.round(rng.random((90, 2)), 1)  # ties
    data[60:] = data[60]
    points = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(data)], "id long, p array<double>")
    d = np.sqrt(((data[:, None] - data[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = topology.nearest(points, points.where("id % 7 = 0"), 5, query_block=4, block=20).orderBy("query", "rank").collect()
    want = [(q, int(x)) for q in range(0, 90, 7) for x in np.argsort(d[q], kind="stable")[:5]]
    assert [(r.query, r.id) for r in got] == want
    assert topology.nearest(points.where("id < 3"), points.where("id = 0"), 5).count() == 2


def test_local_curvature_asks_for_a_hundredth(spark):
    from fourfold import catalog

    sf = "/root/testdata/sf0.001"
    points = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(points))
    data = np.stack([points[k] for k in ids])
    got = {r.query: r.curvature for r in catalog.QUERIES["local_curvature"](spark, sf).collect()}
    assert sorted(got) == [k for k in ids if k % 100 == 0]
    for q, found in got.items():
        d = np.sqrt(((data - points[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        values = np.linalg.eigvalsh(np.cov(data[np.argsort(d, kind="stable")[:80]].T))
        assert found == pytest.approx(max(values[0], 0) / values[-1], abs=1e-9)


def test_loops_of_edges_equal_the_whole_reduction():
    rng = np.random.default_rng(1)
    for n, dims, limit in ((0, 2, 1.0), (1, 2, 9.0), (12, 2, math.inf), (25, 3, math.inf), (30, 2, 0.5), (40, 2, 0.4), (30, 8, 1.1)):
        data = rng.random((n, dims))
        if dims == 3:
            data = np.round(data, 1)  # ties
        if n == 40:
            data[5:9] = data[4]
        whole = [x for x in topology.rips(data, limit, 2) if x[0] < 2]
        assert topology.rips(data, limit) == whole and topology.rips(data, limit, 0) == [x for x in whole if x[0] == 0]


def test_loops_of_a_dense_group():
    """2.6 million triangles, which nearly all die with their longest edge."""
    data = np.random.default_rng(3).random((250, 6))
    start = time.monotonic()
    found = topology.rips(data, math.inf)
    assert sum(dim == 0 for dim, _, _ in found) == 250 and all(b < e < math.inf for dim, b, e in found if dim == 1)
    assert time.monotonic() - start < 20


def test_loops_hold_edges_not_pairs(monkeypatch):
    """6,000 points on a circle with a gap: 18 million pairs, 400,000 edges, and the gap's own edge among the last."""
    angle = np.arange(6000) / 6000 * 6.2
    data = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    gap = float(np.sqrt(((data[0] - data[-1]) ** 2).sum()))
    tracemalloc.start()
    try:
        found = topology.rips(data, gap)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(b, e) for dim, b, e in found if dim == 1] == [(gap, math.inf)] and most < 250_000_000
    data = np.random.default_rng(6).random((120, 8))
    want = topology.rips(data, 1.1)
    monkeypatch.setattr(topology, "COLUMN_BYTES", 0)
    assert topology.rips(data, 1.1) == want and any(dim for dim, _, _ in want)


def test_density_of_many_values():
    """The series over grid points gives the sum over all values; a window of 10,000 takes milliseconds."""
    rng = np.random.default_rng(4)
    for data in (rng.exponential(50, 10_000), np.concatenate([rng.normal(0, 1, 300), rng.normal(9, 1, 300)]), rng.standard_t(1.5, 5000), np.round(rng.random(201), 1)):
        grid, y = adaptive.density(data)
        z = (grid[:, None] - data[None, :]) / (0.1 * data.std(ddof=1))
        want = np.exp(-0.5 * z**2).mean(axis=1) / (0.1 * data.std(ddof=1) * math.sqrt(2 * math.pi))
        assert np.abs(y - want).max() <= 1e-12 * want.max()
    data, start = rng.exponential(50, 10_000), time.monotonic()
    for _ in range(50):
        adaptive.shape(data)
    assert time.monotonic() - start < 2


def test_scales_in_chunks_equal_the_tracker(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.exponential(50, 12_000), rng.normal(300, 5, 11_030)])
    rows = [("long", t, float(x)) for t, x in enumerate(values)] + [("short", t, float(t)) for t in range(130)] + [(None, t, float(t % 7)) for t in range(249)]
    rows += [("gaps", t, None if t % 9 == 0 else float(t % 31)) for t in range(260)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(7)
    got = {(r.k, r.t): (r.regime, r.confidence, r.changes, r.s) for r in adaptive.track_scales(df, "v", ["k"], ["t"]).collect()}
    assert len(got) == len(rows)
    tracker, key = None, ""
    for k, t, v in rows:
        if k != key:
            tracker, key = adaptive.ScaleTracker(), k
        x = NAN if v is None else v
        tracker.step(x)
        assert got[k, t] == (tracker.regime, None if math.isnan(tracker.confidence) else tracker.confidence, tracker.changes, tracker.encode(x)), (k, t)
    one = adaptive.track_scales(df.where("k = 'short'"), "v", [], ["t"])
    assert one.columns == ["t", "v", "regime", "confidence", "changes", "s"] and one.count() == 130
    most = series.numbered(df, ["k"], ["t"]).groupBy("k").agg(F.max("n").alias("n"), F.count_distinct("n").alias("m")).collect()
    assert {(r.k, r.n, r.m) for r in most} == {("long", 23_030, 23_030), ("short", 130, 130), (None, 249, 249), ("gaps", 260, 260)}


def test_fixed_decimals_as_printf(spark):
    rng = random.Random(8)
    values = [k / 2000 for k in range(0, 4001)] + [math.nextafter(k / 2000, side) for k in range(1, 2001, 2) for side in (0, 9)] + [rng.random() for _ in range(500)] + [-0.0625, -1.4175, 123456.0005, 0.1 + 0.2, 1e-300]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", scoring.fixed(F.col("v")).alias("t"), scoring.fixed(F.col("v"), 1).alias("u")).collect()
    assert [(r.t, r.u) for r in got] == [(f"{r.v:.3f}", f"{r.v:.1f}") for r in got]
    assert spark.createDataFrame([(0.5225,)], "v double").select(scoring.fixed(F.col("v"))).first()[0] == "0.522"


def test_transition_paths(spark):
    found = topology.paths(spark, topology.transition_edges(spark))
    safest = topology.best_path(found, "risk").where("source = 0 and target = 3").first()
    assert safest.risk == pytest.approx(0.2) and safest.ops == ["set_i", "admit"]
    assert topology.best_path(found, "length", avoid=[2]).where("source = 1 and target = 2").count() == 1
    assert found.where("source = target").count() == 4
    assert topology.transition_matrix(topology.transition_edges(spark)).groupBy("a").agg(F.sum("p").alias("p")).where("abs(p - 1) > 1e-9").count() == 0


def test_metrics(spark):
    rows = spark.createDataFrame([(s, y) for s, y in [(0, 0), (1, 0), (2, 1), (3, 1)] * 25], "s tinyint, y int")
    assert metrics.information(rows, "s").first()[:] == (2.0, 1.0) and metrics.information(rows.where("s = 3"), "s").first().bits == 0
    assert metrics.mutual_information(rows, "s", "y").first().normalised == pytest.approx(1.0)
    assert [metrics.accuracy(rows, "s", "y", m).first()[0] for m in ("state_label", "psi_positive", "i_bit")] == [1.0, 0.75, 1.0]
    assert metrics.variance_ratio(rows, "s", "s").first().ratio == 1.0
    groups = spark.createDataFrame([(float(v), g) for v, g in [(1, 0), (2, 0), (2, 1), (3, 1), (4, 1)]], "v double, g int")
    assert metrics.mann_whitney(groups, "v", "g").first().u == 5.5
    moved = spark.createDataFrame([("k", t, float(t % 7) + (10 if t >= 100 else 0)) for t in range(200)], "k string, t int, v double")
    assert metrics.drift(moved, "v", ["k"], ["t"], 40).where("drifted").count() >= 1
    text = rows.limit(1).select(metrics.explanation(F.col("s"), F.lit("buy"), "detailed")).first()[0]
    assert text.startswith("Decision buy: state ∅")
    assert rows.limit(1).select(scoring.combine({}), scoring.combine({"a": F.lit(None).cast("double"), "b": F.lit(1.0)}, how="product")).first()[:] == (0.5, 0.5)


def test_pipelines(spark):
    df = spark.createDataFrame([(k, float(k), "hi" if k > 50 else "lo") for k in range(100)] + [(100, None, None)], "id int, x double, y string")
    made = pipeline.PipelineBuilder("x").with_missing_data_handling().with_standard_scaling().with_learned_encoding().with_lookup_interpretation("y").build()
    out = made.fit_transform(df)
    assert out.where("decision = y").count() >= 98 and made.transform(df, "encode").columns == [*df.columns, "s"] and "fitted" in made.summary()
    with pytest.raises(RuntimeError):
        pipeline.PipelineBuilder("x").build().transform(df)
    auto = pipeline.auto_pipeline(df, "x")
    assert [type(s).__name__ for s in auto.steps] == ["Imputer", "StandardScaler"] and auto.fit_transform(df).count() == 101
    fixed = pipeline.PipelineBuilder("x").with_fixed_encoding(10, 90).build().fit_transform(df)
    assert fixed.where("decision = 'buy'").count() == 9


def test_applications(spark):
    df = spark.createDataFrame([(3, 3, 3), (3, 3, 1), (0, 3, 3), (2, 2, 2)], "p tinyint, v tinyint, w tinyint")
    assert [r[0] for r in df.select(apps.signal(F.col("p"), F.col("v"), F.col("w"))["action"]).collect()] == ["buy", "buy", "sell", "hold"]
    sick = spark.createDataFrame([({"a": 0.9, "b": 0.8}, {"t": 0.9}, {"temperature": 45.0, "heart_rate": 150.0}, {})], "s map<string,double>, t map<string,double>, v map<string,double>, h map<string,double>")
    got = sick.select(apps.symptoms_state("s").alias("s"), apps.tests_state("t").alias("t"), apps.vitals_state("v").alias("v"), apps.history_state("h").alias("h"))
    assert got.first()[:] == (3, 3, 3, 0)
    assert got.select(apps.diagnosis(*map(F.col, "stvh"))["urgency"]).first()[0] == "CRITICAL"
    log = spark.createDataFrame([("p", 1, "LOW", 0.9), ("p", 2, "HIGH", 0.85), ("p", 3, "HIGH", 0.2)], "k string, t int, urgency string, confidence double")
    assert [r.alert for r in apps.alerts(log, ["k"], ["t"]).orderBy("t", "alert").collect()] == ["URGENCY_CHANGE", "CRITICAL_CHANGE", "DETERIORATION"]
    assert apps.trend(log, ["k"], ["t"], "confidence").first().trend == "decreasing"


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, k % 3, float(rng.randrange(100)), 1_700_000_000 + 600 * k) for k in range(90)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double, at long").withColumn("ts", F.timestamp_seconds("at"))
    df.repartition(3).write.parquet(str(tmp_path / "e.parquet"))
    s = lambda: windows.source(spark, str(tmp_path / "e.parquet"))
    got = windows.run(windows.tumbling(s(), "ts", "1 hour", ["user_id"], "value"), "complete")
    want = df.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.sum("value").alias("total")).select("user_id", "w.start", "total")
    assert sorted(got.select("user_id", "start", "total").collect()) == sorted(want.collect())
    assert windows.run(windows.distinct(s(), ["user_id"])).count() == 3
    batch = adaptive.track_moments(df, "value", ["user_id"], ["ts", "event_id"])
    live = windows.run(stateful.moments(s(), "user_id", "ts", "event_id", "value"))
    assert {r.user_id: r.mean for r in live.where("n = 30").collect()} == pytest.approx({r.user_id: r.mean for r in batch.where("n = 30").collect()})
    moves = [("a", 3, "b", "go"), ("b", 0, "a", "back")]
    coded = df.withColumn("s", st.encode("value", 30.0, 60.0))
    coded.coalesce(1).write.parquet(str(tmp_path / "c.parquet"))
    live = windows.run(stateful.machine(windows.source(spark, str(tmp_path / "c.parquet")), "user_id", "ts", "event_id", "s", moves, "a"))
    assert {r.event_id: r.action for r in live.collect()} == {r.event_id: r.action for r in series.machine(coded.withColumn("event_id", F.col("event_id")), "s", ["user_id"], ["ts", "event_id"], moves, "a").select("event_id", "action").collect()}


def test_generators(spark):
    assert generators.classification(spark, 50).count() == 50 and generators.regimes(spark, 90).agg(F.countDistinct("regime")).first()[0] == 3
    a, b = generators.time_series(spark, 100), generators.time_series(spark, 100).repartition(7)
    assert sorted(a.collect()) == sorted(b.collect())
    bars = generators.walk(spark, 60)
    assert bars.where("high < greatest(open, close) or low > least(open, close)").count() == 0
    assert generators.patients(spark, 400).agg(F.avg(F.col("label").cast("int"))).first()[0] == pytest.approx(0.2, abs=0.08)
    assert generators.state_chain(spark, 20).first().s == 3 and generators.state_cycle(spark, 30).count() == 30
    assert generators.nested_states(spark).agg(F.max(F.size("levels"))).first()[0] <= 3 and generators.parallel_channels(spark).first().channels.keys() == {"technical", "business", "team", "market"}
    assert generators.signal(spark, 10).count() == 10 and generators.states(spark, 4, 2).agg(F.sum("s")).first()[0] == 8 and generators.rate_stream(spark).isStreaming


def test_spanning_forest_over_rounds(spark):
    """Rounds of joins give the edges that one sorted pass gives."""
    rng = np.random.default_rng(4)
    data = rng.normal(size=(90, 5))
    points = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(data)], "id long, p array<double>")
    want = np.sort(topology.spanning_edges(data))
    tree = topology.spanning_tree(points, block=20)
    assert np.allclose(np.sort([r.d for r in tree.collect()]), want)
    d = topology.distances(data)
    edges = spark.createDataFrame([(a, b, float(d[a, b])) for a in range(90) for b in range(a + 1, 90)], "a long, b long, d double")
    assert np.allclose(np.sort([r.d for r in graphs.spanning_forest(edges, limit=200).collect()]), want)


def test_hollow_volume(spark):
    """A hollow cube has one hole, a frame around a tunnel one loop."""
    inside = (F.col("x").between(1, 3)) & (F.col("y").between(1, 3)) & (F.col("z").between(1, 3))
    core = (F.col("x") == 2) & (F.col("y") == 2) & (F.col("z") == 2)
    tunnel = (F.col("x") == 2) & (F.col("y") == 2)
    for keep, want in ((inside & ~core, (1, 0, 1)), (inside & ~tunnel, (1, 1, 0)), (inside & ~core & ~tunnel & (F.col("z") > 9), (0, 0, 0))):
        v = fields.grid3(spark, 5, 5, 5, F.when(keep, 3).otherwise(0))
        assert tuple(fields.betti3(v).select("b0", "b1", "b2").first()) == want


def test_scorer_history(spark, tmp_path):
    df = spark.createDataFrame([(0.2, 1.0), (0.8, 0.0), (None, 1.0)], "v double, y double")
    made = scorer.FeatureScorer().add_dimension("v2", lambda: F.col("v") * 1, 2.0).add_dimension("half", lambda: F.lit(None).cast("double"))
    made.record_score(df, str(tmp_path / "h"), "y")
    made.record_score(df, str(tmp_path / "h"))
    history = spark.read.parquet(str(tmp_path / "h"))
    got = {r.dimension: (r.n, r.min, r.max) for r in made.get_dimension_statistics(history).collect()}
    assert got == {"v2": (6, 0.2, 0.8), "half": (6, 0.5, 0.5)} and history.where("outcome is null").count() == 3
    with pytest.raises(ValueError):
        scorer.preset("medical", strength=lambda: F.lit(1.0))


def test_steps_of_combinators(spark):
    f = fields.grid(spark, 4, 4, F.lit(2).cast("tinyint"))
    made = combinators.Pipeline(f).apply_if(False, fields.erode).apply_if(lambda d: d.count() == 16, combinators.lift_point_to_field(st.admit)).get()
    assert {r.s for r in made.collect()} == {3} and combinators.ReductionCombinator()(made).first().s == 3
    assert combinators.feature_extraction_pipeline(made).count() == 16
