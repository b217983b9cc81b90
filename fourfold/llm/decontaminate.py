"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fourfold.llm.common import cut, text_of

WINDOW = 13
#: A document is contaminated when COVER_TIMES * hit words >= all words.
COVER_TIMES = 20
#: Words of benchmark items in one automaton; more items make more automata, matched one after the other.
BLOCK_WORDS = 1_000_000

_words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z only."""
    return _words((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """All word sequences inside the items of one block, with the items at each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.items: dict[int, set[str]] = {}  # by the state of a window
        short: dict[int, dict[int, set[str]]] = {}  # whole items under a window's length, by state and length
        for name, codes in coded:
            state = held = 0
            for c in codes:
                state, held = self._step(state, held, c)
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                held = min(held, self.length[state])
                if held >= window:
                    held = window
                    self.items.setdefault(state, set()).add(name)
            if len(codes) < window:
                short.setdefault(state, {}).setdefault(len(codes), set()).add(name)
        self.short = short
        self.above = [-1] * len(self.link)  # the nearest state on the way to the root that ends whole short items
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.above[s] = s if s in short else self.above[self.link[s]] if s else -1
        self.last = list(range(len(self.link)))  # the last state on the way to the root that is at least a window long
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[self.link[s]] >= window:
                self.last[s] = self.last[self.link[s]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _step(self, state: int, held: int, c: int) -> tuple[int, int]:
        nxt, link, length = self.next, self.link, self.length
        while state and c not in nxt[state]:
            state = link[state]
            held = length[state]
        if c in nxt[state]:
            return nxt[state][c], held + 1
        return 0, 0

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Spans [from, to) of words inside window occurrences, merged, and the items that occur."""
        spans: list[list[int]] = []
        found: set[str] = set()
        nxt, link, length, above, window = self.next, self.link, self.length, self.above, self.window
        seen: set[int] = set()
        state = held = 0
        for k, c in enumerate(map(self.ids.get, words)):
            if c is None:
                state = held = 0
                continue
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                held = length[state]
                to = nxt[state].get(c)
            if to is None:
                held = 0
                continue
            state = to
            held += 1
            hit = 0
            if held >= window:
                s = self.last[state]
                if s not in seen:
                    seen.add(s)
                    found |= self.items.get(s, set())
                hit = window
            s = above[state]
            while s > 0:
                for n, names in self.short[s].items():
                    if n <= held:
                        found |= names
                        hit = max(hit, n)
                s = above[link[s]]
            if hit:
                start = k + 1 - hit
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = k + 1
                else:
                    spans.append([start, k + 1])
        return spans, found


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of about ``block_words``, read one partition at a time."""
    block, held, first = [], 0, True
    for name, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        words = words_of(text)
        if words:
            block.append((name or "", words))
            held += len(words)
        if held >= block_words:
            yield block
            block, held, first = [], 0, False
    if block or first:
        yield block


def _digest(spans: list, items: list[str], n_words: int) -> tuple[int, int, str, bool]:
    hit = sum(b - a for a, b in spans)
    names = sorted(set(items))
    return hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and COVER_TIMES * hit >= n_words


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Which words of each document lie in passages of benchmark items.

    Words stream through a suffix automaton of the items, which gives the length
    of the longest item passage that ends at each word; passages of ``window``
    words, or whole shorter items, mark their words. An automaton takes items of
    ``block_words`` words at most and is broadcast; a larger benchmark is matched
    block by block, and a document's marks are then united.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans
    (word positions [from, to)), items, kept_text (the text without its spans,
    for documents that have some and aren't contaminated, else null) and the input row as struct ``row``. Null
    and empty texts have no words and no hits; items without words are never
    found; an item without an id counts under the empty id. Repeated rows are
    each judged. An empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.struct("*").alias("row"))
    blocks = item_blocks(benchmark, item_id_col, item_text_col, block_words)
    first, second = next(blocks), next(blocks, None)
    send = lambda block: spark.sparkContext.broadcast(vars(Automaton(block, window)))
    if second is None:
        return rows.mapInArrow(_matcher(send(first)), _schema(rows))
    keyed = rows.withColumn("__key", F.md5(F.encode("text", "UTF-8")))
    texts = cut(keyed.select("__key", "text").dropDuplicates(["__key"]).select(F.col("__key").alias("doc_id"), "text", F.struct(F.lit(0).alias("none")).alias("row")))
    found = []
    for block in itertools.chain([first, second], blocks):
        machine = send(block)  # one at a time: its matches are written before the next is built
        found.append(cut(texts.mapInArrow(_matcher(machine), _schema(texts)).where("n_hit > 0").select(F.col("doc_id").alias("__key"), "spans", "items")))
        machine.destroy()
    united = functools.reduce(DataFrame.unionByName, found).groupBy("__key").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"))
    joined = keyed.join(united, "__key", "left").drop("__key")
    return joined.mapInArrow(_united, _schema(rows))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", *, length_col: str | None = "n_chars", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without its benchmark passages, in the same columns.

    Documents over the coverage limit (contaminated) go. Of the others, the
    words of all spans, which are at least ``window`` words or a whole shorter
    item long, and what lies between them, are cut out of the text; the column
    ``length_col``, where there is one, then counts the characters left.
    Documents without a span stay as they are, null texts too.
    """
    kept = contamination(docs, benchmark, id_col, text_col, item_id_col, item_text_col, window=window, block_words=block_words).where("not contaminated")
    changed = F.col("kept_text").isNotNull()
    out = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == text_col:
            old = F.coalesce("kept_text", old.cast("string")) if docs.schema[c].dataType.simpleString() == "string" else F.when(changed, F.col("kept_text")).otherwise(old)
        elif c == length_col:
            old = F.when(changed, F.char_length("kept_text").cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return kept.select(*out)


def _schema(rows: DataFrame) -> T.StructType:
    digest = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>, items array<string>, kept_text string"
    return T.StructType([rows.schema["doc_id"], rows.schema["row"], *T.StructType.fromDDL(digest).fields])


def _batch(batch: pa.RecordBatch, texts: list[str], words: list[int], spans: list, items: list) -> pa.RecordBatch:
    hit, n, sha, bad = zip(*map(_digest, spans, items, words), strict=True) if words else ((), (), (), ())
    kept = [without_spans(t, s) if s and not b else None for t, s, b in zip(texts, spans, bad, strict=True)]
    columns = [pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], ["doc_id", "row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items", "kept_text"])


def _matcher(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.__new__(Automaton)
        vars(automaton).update(machine.value)
        for batch in batches:
            words, spans, items = [], [], []
            texts = batch.column("text").to_pylist()
            for text in texts:
                own = words_of(text)
                s, i = automaton.match(own)
                words.append(len(own))
                spans.append(s)
                items.append(list(i))
            yield _batch(batch, texts, words, spans, items)

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        words = [len(words_of(t)) for t in texts]
        spans = []
        for found in batch.column("__spans").to_pylist():
            merged: list[list[int]] = []
            for a, b in sorted(found or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            spans.append(merged)
        yield _batch(batch, texts, words, spans, [x or [] for x in batch.column("__items").to_pylist()])


def without_spans(text: str, spans: list[list[int]]) -> str:
    """The text with the words of the spans, and what lies between them, taken out."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw.lower())]
    kept, last = [], 0
    for a, b in spans:
        kept.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
