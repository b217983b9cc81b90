"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list of symbols."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.llm.common import text_of

#: Fixed value: the pre-tokeniser's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 1_000_000
#: Pre-tokens above this length aren't remembered.
LONG = 64
LIMIT = 1024
POSITION_BITS = 40


def read_merges(path: str) -> dict:
    """Ranks of symbol pairs and special strings of a byte-level BPE ``tokenizer.json``.

    Symbols are numbers: 0-255 for bytes, 256 + rank for merged pairs. The
    result's size is that of the vocabulary.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    others = [b for b in range(256) if b not in set(plain)]
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    symbol: dict[str, int] = dict(letter)
    ranks: dict[int, int] = {}
    for rank, merge in enumerate(spec["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        ranks[symbol[left] << 20 | symbol[right]] = rank
        symbol.setdefault(left + right, 256 + rank)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    return {"ranks": ranks, "special": special}


def merged_count(word: bytes, ranks: dict[int, int]) -> int:
    """Symbols left when no adjacent pair has a rank: initial symbols minus merges."""
    n = len(word)
    if n < 2:
        return n
    symbols, get = list(word), ranks.get
    heap = [rank << POSITION_BITS | k for k in range(n - 1) if (rank := get(symbols[k] << 20 | symbols[k + 1])) is not None]
    if not heap:
        return n
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges, mask = 0, (1 << POSITION_BITS) - 1
    while heap:
        top = heappop(heap)
        k, rank = top & mask, top >> POSITION_BITS
        left = symbols[k]
        if left < 0 or (right := after[k]) >= n or get(left << 20 | symbols[right]) != rank:
            continue  # one of the two has been merged since
        symbols[k], symbols[right] = 256 + rank, -1
        merges += 1
        after[k] = follow = after[right]
        if follow < n:
            before[follow] = k
            if (r := get(symbols[k] << 20 | symbols[follow])) is not None:
                heappush(heap, r << POSITION_BITS | k)
        if (p := before[k]) >= 0 and (r := get(symbols[p] << 20 | symbols[k])) is not None:
            heappush(heap, r << POSITION_BITS | p)
    return n - merges


class Counts(dict):
    """Counts of pre-tokens; computes those that it doesn't remember."""

    def __init__(self, ranks: dict[int, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> int:
        n = merged_count(word.encode("utf-8", "surrogatepass"), self.ranks)
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def counter(model: dict):
    """A function from text to its number of tokens."""
    import regex

    pattern = regex.compile(PATTERN)
    special = regex.compile("|".join(map(regex.escape, sorted(model["special"], key=len, reverse=True)))) if model["special"] else None
    first = model["special"][0] if model["special"] else ""
    memory = sys.__dict__.setdefault("_fourfold_bpe", {})  # lives as long as the worker
    key = (len(model["ranks"]), hash(frozenset(model["ranks"].items())))
    counts = memory.get(key)
    if counts is None:
        memory.clear()
        counts = memory[key] = Counts(model["ranks"])
    get = counts.__getitem__

    def plain(text: str) -> int:
        if len(text) > 1_000_000:
            return sum(get(m.group()) for m in pattern.finditer(text))
        return sum(map(get, pattern.findall(text)))

    def count(text: str) -> int:
        if special is None or not any(s in text for s in model["special"]):
            return plain(text)
        parts = special.split(text)
        return sum(map(plain, parts)) + len(parts) - 1

    return count if first or special is None else plain


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Tokens of each whole text under the byte-level BPE vocabulary at ``path``.

    No identifiers are made. The vocabulary is read on the driver and broadcast;
    its size doesn't depend on the data. A null text is empty and has no
    tokens; special strings inside a text count as one token, as the library
    has it. Repeated rows are each counted; null ids pass through.

    Returns doc_id, n_bytes, n_tokens, over_limit.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_merges(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model.value)
        for batch in batches:
            n = pa.array([count(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
