"""Operators that pass once over the texts: token counts and decontamination."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fourfold.llm import decontaminate as dec
from fourfold.llm import token_count as tok

ODD = ["", None, "a", "  \n\t x", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "it's we'll I'M", "ß é 漢字  x\x1cy\x85z", "a" * 5000, "1234 56,7;;!!", "\r\n\r\n  end "]


@pytest.fixture(scope="module")
def library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return P.path("byte_bpe_50k.json"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(spark, library):
    path, tokenizer = library
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcdeth inou  \n'.,éß1漢 ") for _ in range(rng.randrange(80))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in tok.token_counts(docs, path).collect()}
    for k, t in enumerate(texts):
        assert got[k].n_tokens == len(tokenizer.encode(t or "", add_special_tokens=False).ids), repr(t)
        assert got[k].n_bytes == len((t or "").encode())
    assert tok.token_counts(docs.limit(0), path).count() == 0


def test_white_space_class_equals_the_library(library):
    path, tokenizer = library
    count = tok.counter(tok.read_merges(path))
    for c in [*range(1, 0x3100), 0xFEFF, 0x1F600]:
        if not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}{chr(c)} b{chr(c)}"
            assert count(t) == len(tokenizer.encode(t, add_special_tokens=False).ids), hex(c)


def test_counts_on_table(spark, library):
    path, tokenizer = library
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in tok.token_counts(docs, path).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)


def brute(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    hit, found = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), item or ""))
        n = min(window, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(str(name))
    names = sorted(found)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_words", [1_000_000, 25])
def test_decontamination_equals_brute_force(spark, block_words):
    rng = random.Random(block_words)
    vocabulary = ["a", "b", "C", "d1", "É", "zz"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 3, 4, 5, 8, 9]))) for k in range(25)] + [(99, None), (7, "a b d1 zz C"), (100, "...")]
    texts = [text(rng.randrange(60)) for _ in range(120)] + [None, "", "a", "x-a,b"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, spans int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = dec.contamination(docs.union(docs.limit(3)), benchmark, window=4, block_words=block_words).collect()
    assert len(out) == len(texts) + 3
    for r in out:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(texts[r.doc_id], items, 4), texts[r.doc_id]
        assert r.row.spans == 1 and r.row.text == texts[r.doc_id]


def test_decontamination_on_table(spark):
    path = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    out = dec.op3_decontaminate(spark, path).collect()
    assert len(out) == len(texts)
    for r in out:
        assert tuple(r)[1:] == brute(texts[r.doc_id], items, 13)


def test_repeated_words_match_in_linear_time():
    took = []
    for n in (4_000, 32_000):
        machine = dec.Automaton([("i", [b"a"] * n)])
        began = time.perf_counter()
        spans, items = machine.match([b"a"] * n)
        took.append(time.perf_counter() - began)
        assert spans == [[0, n]] and items == {"i"}
    assert took[1] < 30 * took[0] + 0.2


def test_spans_leave_the_texts(spark):
    item = [f"q{k}" for k in range(15)]
    clean = " ".join(f"c{k}" for k in range(600))
    rows = [(1, f"{clean} {' '.join(item)} {clean}", 9), (2, " ".join(item), 9), (3, clean, 9), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(f"z{k}" for k in range(20)))], "item_id long, text string")
    for words in (1_000_000, 10):
        got = {r.doc_id: (r.text, r.n_chars) for r in dec.decontaminated(docs, benchmark, block_words=words).collect()}
        assert got == {1: (f"{clean}  {clean}", len(clean) * 2 + 2), 3: (clean, 9), 4: (None, None)}


def test_spans_are_cut_out():
    assert dec.without_spans("Ab, cd! ef gh", [[1, 3]]) == "Ab,  gh"[:4] + " gh"
    assert dec.without_spans("one two", [[0, 2]]) == ""


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert dec.contamination(docs, benchmark).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert dec.contamination(some, benchmark).select(F.max("n_hit")).first()[0] == 0
