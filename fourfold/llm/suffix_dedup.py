"""Removal of long byte strings that occur more than once, by sorting suffixes bucket after bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.llm import kernels
from fourfold.llm.common import cut, partitions, text_of

LENGTH = 200
#: Bytes whose hash picks the cover sample.
GRAM = 32
#: Suffixes sorted at once.
BUCKET_WINDOWS = 1_000_000
#: Different blocks around one sample string up to which one task sorts them; above, windows are counted one by one.
SORTED_BLOCKS = 20_000


#: Bytes put through a nonlinear table, for a second hash that is independent of the first.
OTHER_BYTES = kernels.mix(np.arange(256, dtype=np.uint64))


def _runs(raw: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of starts of ``length``-byte windows that share their sample position.

    A window's sample position is the leftmost one with the least hash of
    ``gram`` bytes inside it, so equal windows have it in the same place. Gives
    (sample hash, start, windows, two hashes of all bytes of the block) arrays.
    """
    width = length - gram + 1
    b = np.frombuffer(raw, np.uint8)
    for first in range(0, len(b) - length + 1, kernels.PIECE):
        part = b[first : first + kernels.PIECE + length - 1]
        sums, down = kernels.prefix_hash(part)
        h = kernels.mix((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        m = kernels.sliding(h, width, np.minimum)
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (h[: len(m) - 1] == m[:-1])
        starts = np.flatnonzero(new)
        n = np.diff(np.append(starts, len(m)))
        name = kernels.mix((sums[starts + n - 1 + length] - sums[starts]) * down[starts] + n.astype(np.uint64))
        twice, _ = kernels.prefix_hash(OTHER_BYTES[part])
        twin = kernels.mix((twice[starts + n - 1 + length] - twice[starts]) * down[starts])
        yield m[starts], starts + first, n, name, twin


def _blocks(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sample", "name", "twin", "rk", "start", "n"]
        for batch in batches:
            found: list[tuple] = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) >= length:
                    found += [(m, name, twin, np.full(len(m), row), at, n) for m, at, n, name, twin in _runs(raw, length, gram)]
            if found:
                m, name, twin, row, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (m, name, twin)), batch.column("rk").take(pa.array(row)), pa.array(at.astype(np.int64)), pa.array(n.astype(np.int32))], names)

    return run


def _contexts(length: int, gram: int):
    """The bytes of the blocks that have to be sorted, with the place of the sample position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = length - gram + 1
        for batch in batches:
            out: list[tuple] = []
            for rk, text, blocks in zip(batch.column("rk").to_pylist(), batch.column("text").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for x in blocks:
                    if x["wanted"]:
                        at, n = x["start"], x["n"]
                        own = raw[at : at + n - 1 + length]
                        sums, down = kernels.prefix_hash(np.frombuffer(own, np.uint8))
                        h = kernels.mix((sums[gram:] - sums[:-gram]) * down[: len(own) - gram + 1])
                        place = n - 1 + int(np.argmin(h[n - 1 : width]))
                        out.append((x["sample"], own, place, n, 1 if x["single"] else 2, rk, at, x["hot"]))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sample", "bytes", "place", "n", "copies", "rk", "start", "hot"])

    return run


def _sorted_parts(group: np.ndarray, parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the parts by group and bytes, and common bytes with the part before (-1: another group)."""
    size = -(-max(size, 1) // 8) * 8
    padded = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in parts), np.uint8).reshape(len(parts), size)
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), group])
    rows = padded[order]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), size)
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def sort_bucket(group: np.ndarray, parts: list[bytes], place: np.ndarray, n: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """Which windows of each block have an equal window elsewhere in the bucket; a matrix by block and window.

    The suffixes at sample positions are sorted, and so are the reversed bytes
    before them. A tie of any length between two windows is resolved by those
    ranks: two windows with the sample at the same place are equal just where
    both halves are, which the common bytes of neighbours in rank order tell.
    """
    right, right_common = _sorted_parts(group, [p[k:] for p, k in zip(parts, place, strict=True)], length)
    left, left_common = _sorted_parts(group, [p[:k][::-1] for p, k in zip(parts, place, strict=True)], length)
    found = np.zeros((len(parts), int(n.max())), bool)
    right_class, left_class = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for before in range(int((place - n + 1).min()), int(place.max()) + 1):
        rows = np.flatnonzero((place - n + 1 <= before) & (before <= place))
        if not len(rows):
            continue
        right_class[right] = np.cumsum(right_common < length - before)
        left_class[left] = np.cumsum(left_common < before) if before else np.cumsum(left_common < 0)
        _, inverse = np.unique(right_class[rows] * (len(parts) + 1) + left_class[rows], return_inverse=True)
        total = np.bincount(inverse, weights=copies[rows])
        hit = rows[total[inverse] >= 2]
        found[hit, place[hit] - before] = True
    return found


def _sort_buckets(length: int, bucket_windows: int):
    """Sort the blocks of a partition, which come in order of their sample hash, one bucket of samples at a time."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        sample, parts, place, n, copies, rk, start = zip(*held, strict=True)
        n_of = np.array(n)
        found = sort_bucket(np.array(sample), list(parts), np.array(place), n_of, np.array(copies), length)
        single = np.flatnonzero((np.array(copies) == 1) & found.any(axis=1))
        bits = [np.packbits(found[k, : n_of[k]]).tobytes() for k in single]
        return pa.RecordBatch.from_arrays([pa.array([rk[k] for k in single], pa.binary()), pa.array([start[k] for k in single], pa.int64()), pa.array(bits, pa.binary())], ["rk", "start", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("sample", "bytes", "place", "n", "copies", "rk", "start")), strict=True):
                if row[0] != last and windows >= bucket_windows:
                    yield flush(held)
                    held, windows = [], 0
                held.append(row)
                windows += row[3]
                last = row[0]
        if held:
            yield flush(held)

    return run


def _windows(length: int):
    """Every window of a block by two 64-bit hashes, for samples with too many blocks for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, n, copies, rk, start in zip(*(batch.column(c).to_pylist() for c in ("bytes", "n", "copies", "rk", "start")), strict=True):
                b = np.frombuffer(own, np.uint8)
                sums, down = kernels.prefix_hash(b)
                twice, _ = kernels.prefix_hash(OTHER_BYTES[b])
                one = (sums[length:] - sums[:-length]) * down[:n]
                two = kernels.mix((twice[length:] - twice[:-length]) * down[:n])
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(n, copies, np.int64)), pa.array([rk] * n, pa.binary()), pa.array(np.arange(start, start + n))], ["one", "two", "copies", "rk", "at"])

    return run


def _removal(length: int):
    """Spans of removed bytes and digests from the blocks and windows that are found elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests = [], [], []
            for text, blocks, bits, alone in zip(*(batch.column(c).to_pylist() for c in ("text", "blocks", "bits", "alone")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                edge = np.zeros(len(raw) + 1, np.int64)
                for x in blocks:
                    if x["covered"]:
                        edge[x["start"]] += 1
                        edge[x["start"] + x["n"] - 1 + length] -= 1
                starts = [x["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(x["bits"], np.uint8))) for x in bits or []] + [np.array(alone or [], np.int64)]
                at = np.concatenate(starts)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                change = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                removed.append(int(gone.sum()))
                spans.append(change.reshape(-1, 2).tolist())
                digests.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("rk"), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(digests, pa.string())], ["rk", "n_removed", "spans", "kept_sha256"])

    return run


def _row(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text; the id's length keeps the two apart."""
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(own).cast("string"), F.col(id_col).isNull().cast("string"), own, F.col(text_col))))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, gram: int = GRAM, bucket_windows: int = BUCKET_WINDOWS, sorted_blocks: int = SORTED_BLOCKS) -> DataFrame:
    """Bytes covered by a ``length``-byte string that also starts somewhere else.

    Suffixes are sorted by the ``length`` bytes that matter, one bucket at a
    time, and long ties are resolved by the ranks of a cover sample. The sample
    is picked by content: each window's least hash of ``gram`` bytes. Windows
    that follow each other mostly share their sample and form a block. Blocks
    whose sample occurs once hold nothing repeated; those whose bytes all occur
    twice are repeated as a whole. Only the rest (the ends of repeated passages)
    are sorted, in tasks that take them sample by sample; samples with more than
    ``sorted_blocks`` different blocks are counted window by window over all
    tasks instead. All joins are on hashes and may be split where a key is hot.
    Blocks and counted windows are told by 128 bits of two hashes, rows by the
    128 bits of an MD5 of id and text.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte
    offsets [from, to)). Null texts are empty; texts under ``length`` bytes keep
    all. Strings may overlap their equals. Rows that repeat a whole row each
    lose what the other repeats.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("rk", _row("doc_id", "text"))
    blocks = cut(base.mapInArrow(_blocks(length, gram), "sample long, name long, twin long, rk binary, start long, n int"))
    samples = cut(blocks.groupBy("sample").agg(F.count(F.lit(1)).alias("c"), F.min("name").alias("lo"), F.max("name").alias("hi"), F.min("twin").alias("lo2"), F.max("twin").alias("hi2")).where("c > 1").select("sample", ((F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2"))).alias("same")))
    met = cut(blocks.join(samples, "sample"))
    mixed = met.where("not same").drop("same")
    classes = cut(mixed.groupBy("sample", "name", "twin").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rk", "start")).alias("first")))
    groups = cut(classes.groupBy("sample").agg(F.min("c").alias("least"), (F.count(F.lit(1)) > sorted_blocks).alias("hot")).where("least = 1").select(F.col("sample").alias("s"), "hot"))
    judged = mixed.join(classes, ["sample", "name", "twin"])
    judged = cut(judged.select("sample", "rk", "start", "n", (F.col("c") == 1).alias("single"), (F.struct("rk", "start") == F.col("first")).alias("is_first")))
    asked = judged.where("single or is_first").join(groups, F.col("sample") == F.col("s"))
    asked = asked.select("rk", F.struct("start", "n", "sample", "single", F.lit(False).alias("covered"), F.lit(True).alias("wanted"), "hot").alias("x"))
    no = F.lit(False)
    whole = [df.select("rk", F.struct("start", "n", "sample", no.alias("single"), F.lit(True).alias("covered"), no.alias("wanted"), no.alias("hot")).alias("x")) for df in (met.where("same"), judged.where("not single"))]
    of_docs = asked.unionByName(whole[0]).unionByName(whole[1]).groupBy("rk").agg(F.collect_list("x").alias("blocks"))
    texts = cut(base.select("rk", "text").join(of_docs, "rk"))
    contexts = texts.mapInArrow(_contexts(length, gram), "sample long, bytes binary, place int, n int, copies int, rk binary, start long, hot boolean")
    contexts = cut(contexts)
    bits = contexts.where("not hot").drop("hot").repartition(partitions(spark), "sample").sortWithinPartitions("sample").mapInArrow(_sort_buckets(length, bucket_windows), "rk binary, start long, bits binary")
    bits = cut(bits).groupBy("rk").agg(F.collect_set(F.struct("start", "bits")).alias("bits"))
    if contexts.where("hot").limit(1).count():
        windows = cut(contexts.where("hot").mapInArrow(_windows(length), "one long, two long, copies long, rk binary, at long"))
        twice = cut(windows.groupBy("one", "two").agg(F.sum("copies").alias("c")).where("c > 1").select("one", "two"))
        alone = windows.where("copies = 1").join(twice, ["one", "two"]).groupBy("rk").agg(F.collect_set("at").alias("alone"))
    else:
        alone = spark.createDataFrame([], "rk binary, alone array<long>")
    done = texts.dropDuplicates(["rk"]).join(bits, "rk", "left").join(alone, "rk", "left").mapInArrow(_removal(length), "rk binary, n_removed long, spans array<array<long>>, kept_sha256 string")
    plain = base.select("doc_id", "rk", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    out = plain.join(done, "rk", "left")
    spans = F.coalesce("spans", F.array().cast("array<array<long>>"))
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.size(spans).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), spans.alias("spans"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_bytes(docs).drop("spans")
