"""Operators that group or order rows: exact deduplication and mixing."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fourfold.llm import exact_dedup as ded
from fourfold.llm import mixing as mix

TEXTS = ["", None, "a b", "a  b", "a\t\nb", " a b", "b", "B", "é", "long " * 500, "long  " * 500, "a b"]


def weak(text):
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, 1)


@pytest.mark.parametrize("hashed", [ded.content_hash, weak, lambda text: F.lit("x")])
def test_exact_dedup_equals_brute_force(spark, hashed, monkeypatch):
    monkeypatch.setattr(ded, "GROUP_SLICE", 3)
    rng = random.Random(1)
    rows = [(k * 7 % 101, rng.choice(TEXTS), "x") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for k, t, _ in rows:
        groups[norm(t)].append(k)
    out = ded.exact_dedup(docs, hashed=hashed).collect()
    assert len(out) == 100
    texts = {k: t for k, t, _ in rows}
    for r in out:
        own = groups[norm(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), r.doc_id == min(own))
        assert r.row.keep_id == "x" and r.row.text == texts[r.doc_id]


def test_exact_dedup_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (None, "a"), (None, "c"), (None, "c")], "doc_id long, text string")
    out = ded.exact_dedup(docs).collect()
    assert sorted((r.row.text, r.kept) for r in out) == [("a", False), ("a", False), ("a", False), ("a", True), ("c", False), ("c", True)]
    assert all(r.doc_id == 1 for r in out if r.row.text == "a" and r.kept)
    assert ded.exact_dedup(docs.limit(0)).count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["a", "a", "a", "a", "b", "c", None]), "t") for k in range(900)]
    rows += [(1000, None, "a", "t"), (1001, "", "d", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    out = mix.fair_mix(docs, keep=docs.columns).collect()
    again = mix.fair_mix(docs.repartition(7), keep=docs.columns).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    by = defaultdict(int)
    for r in out:
        by[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.row.taken == "t"
    total = sum(r.size for r in out)
    assert total - 40 <= sum(by.values()) <= total
    for r in out:
        assert abs(by[r.source] - r.target) <= 80 and r.target <= 3 * r.source_size + 1e-9
    assert sum({r.source: r.target for r in out}.values()) == pytest.approx(total)


def test_mix_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)], "doc_id long, text string, source string")
    assert sum(r.taken for r in mix.fair_mix(docs).collect()) <= 5
    assert mix.fair_mix(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, "s")], "doc_id long, text string, source string")
    assert [r.taken for r in mix.fair_mix(none).collect()] == [0]
