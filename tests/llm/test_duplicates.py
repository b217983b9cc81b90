"""Near-duplicate groups and repeated byte strings against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fourfold.llm import kernels
from fourfold.llm import minhash as near
from fourfold.llm import suffix_dedup as suffix


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    n = min(size, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def grouped(texts):
    """component id by doc id, by comparing all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 75 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def family(rng, size, copies, changes):
    words = [f"w{rng.randrange(400)}" for _ in range(size)]
    out = [" ".join(words)]
    for _ in range(copies):
        if rng.random() < 0.7:
            words = list(words)
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(len(words))] = f"X{rng.randrange(90)}"
        out.append(rng.choice([" ", "\n"]).join(words))
    return out


@pytest.mark.parametrize("rare", [64, 2, 0])
def test_near_duplicates_equal_brute_force(spark, rare):
    rng = random.Random(rare)
    texts = ["", None, "  ", "a", "A", "a b c", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(12):
        texts += family(rng, rng.choice([8, 40, 120]), rng.randrange(1, 14), 3)
    common = " ".join(f"p{k}" for k in range(40))
    texts += [common + " " + " ".join(f"u{rng.randrange(999)}" for _ in range(rng.choice([5, 30]))) for _ in range(30)]
    rng.shuffle(texts)
    rows = [(k * 13 % 10007, t, True) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    want = grouped({k: t for k, t, _ in rows})
    out = near.near_duplicates(docs, rare=rare).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id) and r.row.kept


def test_near_duplicates_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (2, None)], "doc_id long, text string")
    out = near.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in out) == [("1", 1, "1", False), ("1", 1, "1", True), ("2", 0, "2", True), ("None", 0, "None", True), ("None", 1, "1", False)]
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_across_components(spark):
    """A large group whose members mostly miss the leader, and two shared templates."""
    rng = random.Random(5)
    template = [[f"t{j}w{k}" for k in range(60)] for j in range(2)]
    texts = []
    for k in range(160):
        words = list(template[k % 2]) + ([f"s{k % 7}x{j}" for j in range(rng.choice([0, 4, 16]))])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"e{rng.randrange(30)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    want = grouped(dict(rows))
    for rare in (64, 1):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rare=rare, with_rows=False).collect()}
        assert got == want


def test_words_of_equal_polynomial_hash():
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    a, b = kernels.word_hashes(f"{word} {word.translate(str.maketrans('ab', 'ba'))}".encode())
    assert a != b


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.75, 0.9):
        agree = []
        for _ in range(60):
            both = rng.integers(0, 2**63, int(200 * share)).astype(np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, 200 - len(both)).astype(np.uint64)])) for _ in range(2))
            agree.append((kernels.superminhash(a, 128) == kernels.superminhash(b, 128)).mean())
        truth = share / (2 - share)
        assert abs(np.mean(agree) - truth) < 0.02
        assert np.var(agree) < 1.1 * truth * (1 - truth) / 128 + 0.0004
    for n in (1, 2, 7):
        assert np.isfinite(kernels.superminhash(np.arange(1, n + 1, dtype=np.uint64), 128)).all()


def test_union_find_over_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    frame = spark.createDataFrame([(min(p), max(p)) for p in links], "a long, b long").repartition(7)
    got = {r.node: r.label for r in near.components(frame).collect()}
    for x in root:
        assert got.get(x, x) == find(x)


def removed(texts, length):
    """(n_bytes, n_removed, n_spans, digest) by counting every string."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[k : k + length] for raw in raws for k in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "sorted_blocks"), [(20, 5, 20_000), (20, 5, 2), (200, 32, 20_000)])
def test_repeated_bytes_equal_brute_force(spark, length, gram, sorted_blocks):
    rng = random.Random(length + sorted_blocks)
    word = lambda n: "".join(rng.choice("abcdé \n\0") for _ in range(n))
    passages = [word(length + rng.randrange(3 * length)) for _ in range(5)] + ["a" * 3 * length, "ab" * 2 * length]
    texts = [None, "", "x" * (length - 1), "y" * length, "z" * (length + 1)]
    for _ in range(60):
        t = word(rng.randrange(2 * length))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += rng.choice([p, p[a:], p[:a], p[:a] + "!" + p[a:]]) + word(rng.randrange(length))
        texts.append(t)
    texts += [texts[20], texts[21], texts[22]]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] , "doc_id long, text string, n_bytes int").repartition(4)
    got = {r.doc_id: r for r in suffix.repeated_bytes(docs, length=length, gram=gram, bucket_windows=500, sorted_blocks=sorted_blocks).collect()}
    for k, want in enumerate(removed(texts, length)):
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, k


def test_repeated_rows(spark):
    text = "".join(random.Random(1).choice("abc") for _ in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "q" + text[:200]), (None, "w")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in suffix.repeated_bytes(docs).collect())
    assert got == [("1", 300, 1), ("1", 300, 1), ("None", 0, 0), ("None", 200, 1)]
    assert suffix.repeated_bytes(docs.limit(0)).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    raw = b" aa bbb  cccc " * 50 + b"d" * 300 + b" e"
    want = kernels.word_hashes(raw)
    blocks = sum(len(x[0]) for x in suffix._runs(raw, 20, 5))
    monkeypatch.setattr(kernels, "PIECE", 64)
    assert (kernels.word_hashes(raw) == want).all()
    windows = defaultdict(int)
    for _, at, n, *_ in suffix._runs(raw, 20, 5):
        for s, k in zip(at.tolist(), n.tolist()):
            for j in range(k):
                windows[s + j] += 1
    assert sorted(windows) == list(range(len(raw) - 19)) and set(windows.values()) == {1} and blocks
