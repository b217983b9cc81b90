"""Registered queries against their SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import itertools
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered
from fourfold import catalog

SF = "/root/testdata/sf0.001"
SOME = [
    "state_histogram", "state_fractions", "algebra_binary", "lattice_chains", "nested_match", "weighted_vote", "combine_full", "impute_linear", "ts_features", "encode_multi_vote", "learn_mutual_info", "interpret_ensemble",
    "pattern_sequences", "pipeline_end_to_end", "q_consistency", "ind_rsi", "ind_macd", "fsm_fold", "backtest_fold", "adaptive_streaming", "longest_gap", "score_density", "st_mann_whitney", "med_alerts", "stream_session",
    "close_pairs", "correlation_dimension", "cloud_covariance", "mapper_first_coordinate", "persistence_h0", "persistence_entropy", "scorer_explain", "quality_report", "stability_report", "compare_explainability", "combinator_edges",
    "volume_components_2", "volume_convolve_periodic", "volume_betti", "field_lazy_region", "builder_score", "betti_tracker", "mapper_summary", "transition_strategies",
    "field_convolve_reflect", "field_smooth", "field_components", "betti_threshold", "transition_paths",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def plain(rows, columns):
    def one(v):
        return round(v, 7) if isinstance(v, float) and math.isfinite(v) else str(v) if isinstance(v, float) else v

    return sorted((tuple(one(r[c]) for c in sorted(columns)) for r in rows), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a = plain([r.asDict() for r in got.collect()], got.columns)
    b = plain([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], want.columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert [str(v) for v in x] == [str(v) for v in y] or all(u == pytest.approx(v, abs=1e-6) if isinstance(v, float) else str(u) == str(v) for u, v in zip(x, y, strict=True))


def test_means_of_patients_add_in_the_order_of_rows(spark, tmp_path):
    """Sums of doubles depend on their order; Spark reads the larger file first, the table's order is that of names."""
    hundredths = [(8, 1, 0), (1, 1, 7), (1, 7, 1), (7, 1, 1), *itertools.permutations((2, 3, 4)), *itertools.permutations((4, 8, 9)), (6, 6, 9), (6, 9, 6)]
    con = duckdb.connect(config={"threads": 1})
    con.sql("set timezone = 'UTC'")
    con.sql("create table l (l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp)")
    lines = [(k, n, 30.0, x / 100, 0.01 * n) for k, own in enumerate(hundredths) for n, x in enumerate(own, 1)]
    lines += [(100, 1, None, None, 0.02), (100, 2, 10.0, 0.05, None)]
    for k, n, quantity, discount, tax in lines:
        con.execute("insert into l values (?, ?, ?, ?, ?, timestamp '2000-01-01')", [k, n, quantity, discount, tax])
    (tmp_path / "lineitem.parquet").mkdir()
    con.sql(f"copy (from l where l_linenumber < 3) to '{tmp_path}/lineitem.parquet/a.parquet'")
    con.sql(f"copy (from (from l where l_linenumber = 3) union all by name (select range + 1000 l_orderkey, 1 l_linenumber, 9.0 l_quantity, 0.05 l_discount, 0.05 l_tax, timestamp '2000-01-01' l_shipdate from range(3000))) to '{tmp_path}/lineitem.parquet/b.parquet'")
    con.sql(f"create view lineitem as from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.sql(catalog.SQL["med_encode"])
    got = catalog.QUERIES["med_encode"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_explained_scores_add_in_the_order_of_rows(spark, tmp_path):
    """Means of three values that print as halves: (a + b) + c and a + (b + c) fall on both sides of them."""
    con = duckdb.connect(config={"threads": 1})
    con.sql("set timezone = 'UTC'")
    con.sql("create table v as select u user_id, [1 + u * 37 % 2000, 1 + u * 91 % 3000] c, 30 * (200 + u % 97) + 15 total from range(400) r(u)")
    con.sql("create table e as select user_id * 3 + k event_id, user_id, ([c[1], c[2], total - c[1] - c[2]])[k + 1] / 100.0::double as value, k from v, range(3) r(k) order by user_id, k")
    (tmp_path / "events.parquet").mkdir()
    con.sql(f"copy (select event_id, user_id, value from e where k = 0 order by event_id) to '{tmp_path}/events.parquet/a.parquet'")
    con.sql(f"copy (from (select event_id, user_id, value from e where k > 0 order by event_id) union all select 10000 + range, 1000 + range, 1.0 from range(3000)) to '{tmp_path}/events.parquet/b.parquet'")
    con.sql(f"create view events as from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.sql(catalog.SQL["scorer_explain"])
    got = catalog.QUERIES["scorer_explain"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_entry(spark):
    queries, sql = registered.queries(), registered.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) <= set(queries) and set(catalog.SQL) <= set(catalog.QUERIES)
    assert registered.entry(spark).count() > 0
