"""Operators with trained models: licences, lattice scores, toxicity, quality; and the pipeline."""

from __future__ import annotations

import math
import random
import re
import textwrap
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fourfold.llm import cotrain, lattice_lm, licence, linear, toxicity
from fourfold.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_linear_models():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=500) > 0).astype(float)
    coef = linear.fit_logistic(x, y)
    assert ((linear.logits(x, coef) > 0) == y).mean() > 0.9
    assert ((linear.out_of_fold(x, y, np.arange(500) % 5, 1.0) > 0) == y).mean() > 0.88
    assert np.isfinite(linear.fit_logistic(np.zeros((0, 3)), np.zeros(0))).all()
    w, b = linear.fit_softmax(x, x.argmax(axis=1), 3)
    assert ((x @ w + b).argmax(axis=1) == x.argmax(axis=1)).mean() > 0.9


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def spelt(word: bytes, logs: dict[bytes, float]) -> float:
    """All segmentations, one by one."""
    if not word:
        return 1.0
    return sum(math.exp(logs[word[:k]]) * spelt(word[k:], logs) for k in range(1, len(word) + 1) if word[:k] in logs)


def test_lattice_sums_all_segmentations():
    pieces = sorted({b" ", b" a", b"ab", b"b", b"abb", b" ab", *(bytes([k]) for k in range(256))})
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(len(pieces))))
    table = dict(zip(pieces, logs, strict=True))
    model = lattice_lm.Lattice(pieces, logs)
    words = [b"ab", b"abbab", b"x", b"bb", b"\xc3\xa9a", b"aaaaaab"]
    got, uses = model.run(words, np.ones(len(words)))
    for w, g in zip(words, got, strict=True):
        assert g == pytest.approx(math.log(spelt(b" " + w, table)))
    assert sum(n * len(p) for n, p in zip(uses, pieces, strict=True)) == pytest.approx(sum(len(w) + 1 for w in words))
    long, long_uses = model.run([b"ab" * 80], np.ones(1))
    assert np.isfinite(long).all() and sum(n * len(p) for n, p in zip(long_uses, pieces, strict=True)) == pytest.approx(161)


def test_scores_follow_the_contract(spark, path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(100_000, None), (100_001, ""), (None, "the of")], "doc_id long, text string"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    held = {k: zlib.crc32((str(k) if k is not None else "").encode()) % 10 == 0 for k, _ in rows}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    c = Counter(w for k, t in rows if not held[k] for w in [*split(t), None])
    n, v = sum(c.values()), len(c)
    out = lattice_lm.lm_scores(docs, path, rounds=1, head_words=500).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        tokens = [*split(texts[r.doc_id]), None]
        assert r.held_out == held[r.doc_id] and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(w in c for w in tokens))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert r.score < 0 and math.isfinite(r.score)
    again = {r.doc_id: r.score for r in lattice_lm.lm_scores(docs, path, rounds=1, head_words=20).collect()}
    for r in out:
        assert again[r.doc_id] == pytest.approx(r.score)


def test_scores_mix_classes(spark, path):
    """The score equals the plain sum over classes, for any split of head and joined words; clashing columns, rare and null classes included."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "lang", "1 as k", "2 as word", "3 as tag", "4 as held_out").limit(300)
    docs = cut(docs.withColumn("lang", F.expr("case when doc_id % 50 = 0 then null when doc_id % 97 = 0 then 'rare' else lang end")))
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    training = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 10]
    sizes = Counter(g for _, _, g in training)
    kind = lambda g: g if g is not None and sizes[g] >= lattice_lm.CLASS_SHARE * len(training) else None
    by: dict = {}
    for _, t, g in training:
        by.setdefault(kind(g), Counter()).update([*lattice_lm.words_of(t), None])
    counts = cut(lattice_lm.word_counts(docs.where("crc32(cast(doc_id as string)) % 10 <> 0").select("text", F.lit(0).alias("k"))))
    pieces, logs, end = lattice_lm.train(counts, path, 1)
    known = sorted({w for _, t, _ in rows for w in lattice_lm.words_of(t)})
    mark = dict(zip(known, lattice_lm.Lattice(pieces, logs).run(known)[0], strict=True)) | {None: end}
    share = {}
    for g, c in by.items():
        n, once, two = sum(c.values()), sum(w is not None and m == 1 for w, m in c.items()), sum(w is not None and m == 2 for w, m in c.items())
        d = min(0.9, max(0.1, once / (once + 2 * two))) if once else 0.5
        share[g] = (sum(kind(x) == g for _, _, x in training) / len(training), n, d, d * len(c) / n)

    def plain(text: str) -> float:
        tokens = [*lattice_lm.words_of(text), None]
        each = [math.log(p) + sum(math.log(max(by[g][w] - d, 0) / n + free * math.exp(mark[w])) for w in tokens) for g, (p, n, d, free) in share.items()]
        return float(np.logaddexp.reduce(each)) / math.log(10)

    for head in (10_000_000, 30):
        got = {r.doc_id: r.score for r in lattice_lm.lm_scores(docs, path, class_col="lang", rounds=1, head_words=head).collect()}
        assert len(got) == len(rows)
        for k, t, _ in rows:
            assert got[k] == pytest.approx(plain(t))


def test_known_languages_beat_the_base_on_held_out_texts(spark, path):
    scores = lattice_lm.lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), path, class_col="lang")
    held, base = scores.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held > base


def test_long_words_go_by_the_block(monkeypatch):
    pieces = sorted({b" a", b"ab", b"abb", b"bbab", *(bytes([k]) for k in range(256))})
    logs = np.log(np.random.default_rng(4).dirichlet(np.ones(len(pieces))))
    model = lattice_lm.Lattice(pieces, logs)
    word = bytes(np.random.default_rng(5).choice(list(b"ab"), 5000))
    whole = model.run([word], np.ones(1))
    monkeypatch.setattr(lattice_lm, "BLOCK", 7)
    parts = model.run([word], np.ones(1))
    assert parts[0] == pytest.approx(whole[0]) and parts[1] == pytest.approx(whole[1])


def test_lattice_of_words_of_many_lengths(monkeypatch):
    """Words that go through the recursion together have the sums and uses that a plain recursion gives them one by one."""
    rng = np.random.default_rng(6)
    pieces = sorted({b" a", b" ab", b"ab", b"abc", b"abcab", b"bca", b"ca", b"c" * 25, *(bytes([k]) for k in range(256))})
    logs = np.log(rng.dirichlet(np.ones(len(pieces))))
    sizes = [*rng.integers(1, 30, 300), *rng.integers(97, 130, 50), 260, 300]
    words = [bytes(rng.choice(list(b"aabbccx"), n)) for n in sizes] + [b"c" * 60, b"\xff\x00"]
    weights = rng.random(len(words))
    table = dict(zip(pieces, logs, strict=True))

    def plain(word: bytes, weight: float, uses: Counter) -> float:
        alpha, beta = np.full(len(word) + 1, -np.inf), np.full(len(word) + 1, -np.inf)
        alpha[0] = beta[-1] = 0.0
        arcs = [(i, i + n, word[i : i + n]) for i in range(len(word)) for n in range(1, 26) if word[i : i + n] in table and i + n <= len(word)]
        for i, j, p in arcs:
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + table[p])
        for i, j, p in reversed(arcs):
            beta[i] = np.logaddexp(beta[i], beta[j] + table[p])
        for i, j, p in arcs:
            uses[p] += weight * math.exp(alpha[i] + table[p] + beta[j] - alpha[-1])
        return alpha[-1]

    uses: Counter = Counter()
    wanted = [plain(b" " + w, x, uses) for w, x in zip(words, weights, strict=True)]
    for cells in (1, 300, 50_000):
        monkeypatch.setattr(lattice_lm, "CELLS", cells)
        got, found = lattice_lm.Lattice(pieces, logs).run(words, weights)
        assert got == pytest.approx(wanted)
        assert found == pytest.approx([uses[p] for p in pieces])


def test_the_lattice_spells_counted_words_once(monkeypatch):
    """Texts of the training part don't ask the lattice for their rare words again: the counts have the scores."""
    pieces = [bytes([k]) for k in range(256)]
    head = lattice_lm.Head({b"the": 0}, np.zeros(1), np.zeros(1), np.array([0, 1]), np.zeros(1, np.int64), np.zeros(1))
    shared = SimpleNamespace(value=(pieces, np.full(256, -6.0), np.zeros(1), np.zeros(1), -1.0, head))
    run, asked = lattice_lm.Lattice.run, []
    monkeypatch.setattr(lattice_lm.Lattice, "run", lambda self, words, *a: (asked.extend(words), run(self, words, *a))[1])
    batch = pa.RecordBatch.from_pydict({"tag": [1, 2, 3], "text": ["the rare rare word", "the held word", ""], "held_out": [False, True, False]})
    (out,) = lattice_lm._scored(shared)(iter([batch]))
    assert sorted(asked) == [b"held", b"word"]
    tail = [{t["word"]: (t["times"], t["mark"]) for t in own} for own in out.column("tail").to_pylist()]
    assert tail == [{b"rare": (2, None), b"word": (1, None)}, {b"held": (1, pytest.approx(-30.0)), b"word": (1, pytest.approx(-30.0))}, {}]


def test_scores_are_probabilities(spark, path):
    """Over a small closed set of texts the mass stays under one; unseen training gives finite scores."""
    docs = spark.createDataFrame([(k, "a b") for k in range(30)] + [(999, "b a")], "doc_id long, text string")
    out = {r.doc_id: r.score for r in lattice_lm.lm_scores(docs, path, rounds=1).collect()}
    assert 10 ** out[0] + 10 ** out[999] < 1 and out[0] > -3
    only = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:2]
    none = lattice_lm.lm_scores(spark.createDataFrame([(k, "a b") for k in only], "doc_id long, text string"), path).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    assert lattice_lm.lm_scores(docs.limit(0), path).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    assert chain.categories == ["toxic", "severe_toxic"] and len(chain.coefs[1]) == len(chain.coefs[0]) + 1
    out = toxicity.toxicity(docs, chain, with_rows=False).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id")
    hit, missed, wrong, right = out.agg(F.count_if(F.expr("toxic and label = 1")), F.count_if(F.expr("not toxic and label = 1")), F.count_if(F.expr("toxic and label = 0")), F.count_if(F.expr("not toxic and label = 0"))).first()
    assert hit / (hit + missed) > 0.8 and wrong / (wrong + right) < 0.01


def test_toxicity_odd_rows(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["ok", "fine", "good", "day"]) for _ in range(9)) + (" awful" if k % 4 == 0 else "")) for k in range(120)]
    docs = spark.createDataFrame([(*r, False) for r in rows] + [(None, None, False), (500, "", False), (1, "awful", True)], "doc_id long, text string, toxic boolean")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 123
    for r in out:
        assert r.toxic == ("awful" in (r.row.text or ""))
    nothing = toxicity.toxicity(docs, toxicity.train(docs, labels.limit(0)))
    assert nothing.where("toxic").count() == 0
    assert toxicity.toxicity(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    views = cotrain.train(docs, labels.where("doc_id % 2 = 0"))
    out = cotrain.quality(docs, views).join(labels.where("doc_id % 2 = 1"), "doc_id")
    right, n, scores = out.agg(F.count_if((F.col("quality") == 1) == F.col("high_quality")), F.count(F.lit(1)), F.count_if(F.expr("quality_score between 0 and 1"))).first()
    assert right / n > 0.95 and scores == n
    odd = spark.createDataFrame([(None, None, None, None, None, 1.0), (1, "", "en", "s", 3, 1.0), (1, "", "en", "s", 3, 1.0)], "doc_id long, text string, lang string, source string, n_chars long, text_score double")
    assert cotrain.quality(odd, views).count() == 3
    assert cotrain.quality(odd.limit(0), cotrain.train(odd.limit(0), labels.limit(0))).count() == 0
    assert cotrain.quality(odd, cotrain.train(odd, labels.limit(0))).count() == 3


def test_pseudo_labels_help():
    """With few labels, the pool lets a view learn what only the other one sees."""
    rng = np.random.default_rng(5)
    n = 1200
    y = rng.integers(0, 2, n).astype(float)
    x = np.zeros((n, cotrain.TEXT_SIZE + cotrain.META_SIZE))
    x[:, 0] = y * 4 + rng.normal(size=n)
    x[:, cotrain.TEXT_SIZE] = y * 4 + rng.normal(size=n)
    pool = cotrain.LocalPool(x[40:1000])
    n, middle, spread = cotrain.scaling(cotrain.LocalPool(x[:1000]), x.shape[1])
    views = cotrain.co_train(x[:40], y[:40], pool, 960, middle, spread)
    text, meta, both = views.scores(x[1000:])
    assert n == 1000 and all(((p > 0.5) == y[1000:]).mean() > 0.93 for p in (text, meta, both))


def test_training_over_a_table_equals_one_matrix(spark):
    rng = np.random.default_rng(6)
    width = cotrain.TEXT_SIZE + cotrain.META_SIZE
    x = rng.normal(size=(300, width)).astype(np.float32)
    y = (x[:, 0] + x[:, cotrain.TEXT_SIZE] > 0).astype(float)
    table = spark.createDataFrame([(r.tobytes(),) for r in x[50:]], "x binary").repartition(5)
    pools = [cotrain.LocalPool(x[50:].astype(float)), cotrain.TablePool(table, width)]
    a, b = ((s := cotrain.scaling(p, width)) and cotrain.co_train(x[:50].astype(float), y[:50], p, 250, s[1], s[2], 2) for p in pools)
    assert all(np.allclose(u, v, atol=1e-6) for u, v in zip(vars(a).values(), vars(b).values(), strict=True))


def test_licences(spark):
    ordinary = [f"line {k} of words that say nothing in particular about {w}" for k, w in enumerate("sun moon rain wind snow trees rivers hills cats dogs".split() * 20)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "Released under the MIT License."), (4, ordinary[0] + "\nLicensed under the Apache License, Version 2.0.\n" + ordinary[1]), (5, "He lost his driver's license."), (6, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."), (7, ordinary[3])]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows] + [(100 + k, t, "x") for k, t in enumerate(ordinary)] + [(3, rows[3][1], "x")], "doc_id long, text string, families string")
    model = licence.fit(ordinary)
    got = licence.licence_scan(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert [by[k].families for k in range(8)] == ["", "", "", "mit", "apache", "", "cc-by-nc,gpl", ""]
    assert all(r.families == "" for r in got if r.doc_id >= 100)
    assert sum(r.families == "mit" for r in got) == 2 and by[3].best_family == "mit" and by[3].best_probability > model.threshold
    assert licence.licence_scan(docs.limit(0), model).count() == 0
    assert licence.fit([]).threshold >= 0.5


def test_licences_equal_a_plain_computation(spark):
    """The DataFrame plan against the same model applied in Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = licence.fit(licence.sample_paragraphs(docs))
    place = {g: k for k, g in enumerate(model.grams)}
    got = {r.doc_id: r.families for r in licence.licence_scan(docs, model).collect()}
    pairs = {(f, t): {g for g in licence._grams(t) if " " in g} for f in licence.TEMPLATES for t in licence.TEMPLATES[f]}
    for r in docs.collect():
        found = set()
        for line in (r.text or "").split("\n"):
            own = set(licence._grams(line))
            z = (sum((model.weights[place[g]] for g in own & place.keys()), np.zeros(len(model.families))) + model.bias) * model.scale
            p = np.exp(z - max(0, z.max())) / (np.exp(-max(0, z.max())) + np.exp(z - max(0, z.max())).sum())
            best = model.families[int(z.argmax())]
            if line and p.max() >= model.threshold and max(len(own & g) / len(g) for (f, _), g in pairs.items() if f == best and g) >= licence.CONFIRM:
                found.add(best)
        assert got[r.doc_id] == ",".join(sorted(found)), r.doc_id


def test_pipeline_equals_its_stages(spark):
    """Decisions of each stage, checked on what it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, kept, SF)
        assert set(kept.columns) >= set(docs.columns), name
        if name != "mixing":
            same = [c for c in docs.columns if name != "decontamination" or c not in ("text", "n_chars")]
            assert kept.columns == docs.columns
            assert kept.join(before, same, "left_anti").count() == 0
        kept = spark.createDataFrame(kept.collect(), kept.schema)
    ran = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.times) for r in df.select("doc_id", "times").collect())
    assert key(ran) == key(kept) and len(key(ran)) > 50


def test_pipeline_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, names that clash and an empty table."""
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [(1, None, None, None, 1, "x", None), (2, "", "en", "a", 2, None, 0), (2, "", "en", "a", 2, None, 0), (3, long, "en", None, 3, "z", 0), (None, "some words", None, "a", 4, None, 1), (4, long + " more", "de", "b", 5, "q", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, mix_size string, `a.b` int")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns and stage(spark, empty, SF).count() == 0, name
        if name in ("toxicity", "decontamination"):
            assert out.count() == len(rows)
        elif name == "exact dedup":
            assert sorted((str(r.doc_id), r.text == long) for r in out.collect()) == [("1", False), ("3", True), ("4", False), ("None", False)]
        elif name == "near-duplicates":
            assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "2", "3", "None"]
        else:
            assert {"mix_mix_size", "source_size", "times"} <= set(out.columns)


def test_licences_short_and_wrapped(spark):
    """A notice counts whole, however short it is and wherever its lines are broken."""
    ordinary = [f"line {k} of words that say nothing in particular about {w}" for k, w in enumerate("sun moon rain wind snow trees rivers hills cats dogs".split() * 20)]
    isc, bsd = next(t for t in licence.TEMPLATES["isc"] if t.startswith("Permission")), next(t for t in licence.TEMPLATES["bsd"] if t.startswith("Redistribution"))
    wrap = lambda t, n: "\n".join(textwrap.wrap(t, n))
    texts = ["All rights reserved.", "Copyright 2019 Jane Doe. All rights reserved.", wrap(isc, 72), wrap(bsd, 72), wrap(bsd, 20), "\n".join([*ordinary[:9], wrap(isc, 60), *ordinary[:9]]), " ".join(isc.split()[:10]) + "\n\n" + " ".join(isc.split()[10:]), "MIT License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licence.licence_scan(docs, licence.fit(ordinary)).collect()}
    assert [got[k].families for k in range(8)] == ["proprietary", "proprietary", "isc", "bsd", "bsd", "isc", "", "mit"]
    assert all(got[k].n_confirmed == 1 and got[k].n_paragraphs == texts[k].count("\n") + 1 for k in (0, 1, 2, 3, 4, 5, 7))


def test_licences_learn_from_all_lines(spark):
    """Notices in the corpus don't turn their own words into ordinary ones; counts equal a plain computation."""
    ordinary = [f"line {k} of the words that say nothing in particular about all {w} and the license" for k, w in enumerate("sun moon rain wind snow trees rivers hills cats dogs".split() * 60)]
    notices = ["All rights reserved.", "License: MIT", "Released under the ISC License."]
    docs = spark.createDataFrame(list(enumerate([*notices * 3, *ordinary, None, ""])), "doc_id long, text string")
    got = {r.doc_id: r.families for r in licence.licence_scan(docs).collect()}
    assert [got[k] for k in range(9)] == ["proprietary", "mit", "isc"] * 3
    assert all(v == "" for k, v in got.items() if k >= 9)
    counts, n = licence.ordinary_counts(docs)
    known = licence.known_grams()
    plain = [own for t in [*notices * 3, *ordinary] for own in [set(licence._grams(t)) & known] if not licence.notice_like(own)]
    assert len(ordinary) - 9 < n == len(plain) <= len(ordinary) and counts == Counter(g for own in plain for g in own)
    model = licence.fit_counts(counts, n)
    rest = [k for k, g in enumerate(model.grams) if not set(g.split()) & set(model.telling)]
    assert rest and (model.bias + np.maximum(model.weights[rest], 0).sum(axis=0) < 0).all()
