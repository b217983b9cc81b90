"""Language-model scores: the probability of a text over all its segmentations into subwords."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.llm import kernels
from fourfold.llm.common import cut, text_of

FOLDS = 10
SMOOTH = 0.1
#: Rounds of expectation maximisation over the words of the training documents.
ROUNDS = 4
#: Classes of documents with less than this share of the training documents count as one.
CLASS_SHARE = 0.01
#: The most frequent words whose counts are broadcast; those of others are joined.
HEAD_WORDS = 200_000
HEAD_BYTES = 64
#: Different words a task counts before it hands them on.
HELD_WORDS = 200_000
#: Longer words go through the recursion by themselves, this many positions at a time.
LONG_WORD = 96
BLOCK = 8192
#: Bits, at most, of the places by which pieces and their beginnings of a length are looked up.
SIEVE_BITS = 18
#: Bytes of words that go through the recursion together.
CELLS = 50_000


def words_of(text: str) -> list[bytes]:
    """Of bytes, lower() and split() know A-Z and the white space 20, 09-0D alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def read_pieces(path: str) -> list[tuple[bytes, float]]:
    """Pieces and scores of a sentencepiece vocabulary as bytes, a space for its word mark; all 256 bytes are pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            continue
        piece = bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            found[piece] = max(found.get(piece, -1e30), model.get_score(k))
    least = min(found.values(), default=0.0)
    for b in range(256):
        found.setdefault(bytes([b]), least)
    return sorted(found.items())


def _log_sum(terms: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials by column; one of the terms is finite, as all bytes are pieces. Overwrites them."""
    most = terms.max(axis=0)
    terms -= most
    return most + np.log(np.exp(terms, out=terms).sum(axis=0))


class Lattice:
    """Pieces with log probabilities; scores and expected piece counts of words."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.pieces, self.logs = pieces, logs
        starts: dict[int, dict[bytes, int]] = {}  # by length: what pieces start with, and which piece it is itself (or -1)
        for p in pieces:
            for n in range(1, len(p)):
                starts.setdefault(n, {})[p[:n]] = -1
        for k, p in enumerate(pieces):
            starts.setdefault(len(p), {})[p] = k
        self.tables = []  # (length, first entry by hash place or -1, hashes, piece of each or -1, bits of a place, most entries of one)
        for n, own in sorted(starts.items()):
            h = self._hashes(*kernels.prefix_hash(np.frombuffer(b"".join(own), np.uint8)), np.arange(len(own)) * n, n)
            bits = min(SIEVE_BITS, len(own).bit_length() + 4)
            slot = self._slot(h, bits)
            order = np.argsort(slot, kind="stable")
            used, at, many = np.unique(slot[order], return_index=True, return_counts=True)
            first = np.full(1 << bits, -1, np.int32)
            first[used] = at
            kept = np.append(h[order], np.zeros(many.max(), np.uint64))
            piece = np.append(np.fromiter(own.values(), np.int64, len(own))[order], np.full(many.max(), -1))
            self.tables.append((n, first, kept, piece, bits, int(many.max())))

    @staticmethod
    def _hashes(sums: np.ndarray, down: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return (sums[at + n] - sums[at]) * down[at]

    @staticmethod
    def _slot(h: np.ndarray, bits: int) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)

    def _edges(self, flat: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, pieces) of all pieces in a run of bytes; only where one can still go on are longer ones looked for.

        Words may follow each other, each after its space: no piece has a space but at its start.
        """
        sums, down = kernels.prefix_hash(flat)
        at = np.arange(len(flat))
        out = []
        for n, first, table, own, bits, most in self.tables:
            at = at[: np.searchsorted(at, len(flat) - n, "right")]
            if not len(at):
                break
            h = self._hashes(sums, down, at, n)
            place = first[self._slot(h, bits)]
            may = np.flatnonzero(place >= 0)
            at, h, place = at[may], h[may], place[may]
            wrong = np.flatnonzero(table[place] != h)
            for _ in range(1, most):  # others of the same place; an entry of another place has another hash
                place[wrong] += 1
                wrong = wrong[table[place[wrong]] != h[wrong]]
            if len(wrong):
                good = np.ones(len(at), bool)
                good[wrong] = False
                at, place = at[good], place[good]
            piece = own[place]
            is_one = np.flatnonzero(piece >= 0)
            if len(is_one):
                out.append((n, at[is_one], piece[is_one]))
        return out

    def run(self, words: list[bytes], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each word's probability over all segmentations of " " + word;
        with weights, also the expected number of uses of each piece."""
        scores = np.zeros(len(words))
        uses = np.zeros(len(self.pieces)) if weights is not None else None
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths[order])
        first = 0
        with np.errstate(invalid="ignore"):
            while first < len(order):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CELLS, "right")))
                own = order[first:last]
                most = max(LONG_WORD, int(lengths[own[31]]) if len(own) > 31 else 0)
                alone = int(np.searchsorted(-lengths[own], -most, "left"))
                for k in own[:alone].tolist():
                    scores[k] = self._long(b" " + words[k], None if weights is None else weights[k], uses)
                if alone < len(own):
                    own = own[alone:]
                    scores[own] = self._sorted([words[k] for k in own.tolist()], lengths[own], None if weights is None else weights[own], uses)
                first = last
        return scores, uses

    def _sorted(self, words: list[bytes], lengths: np.ndarray, weights: np.ndarray | None, uses: np.ndarray | None) -> np.ndarray:
        """``run`` for words whose ``lengths``, with their space, don't rise.

        Row j of a table of states holds position j of the first ``many[j]`` words, all that are so long.
        """
        flat = np.frombuffer(b" " + b" ".join(words), np.uint8)
        size = int(lengths[0])
        many = np.searchsorted(-lengths, -np.arange(size + 1), "right")
        row = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        state = row[place] + word
        edges = self._edges(flat)
        arcs = []
        for n, at, piece in edges:
            logs = np.full(row[-1], -np.inf)
            logs[state[at]] = self.logs[piece]
            arcs.append((n, logs))
        terms = np.empty((len(arcs), len(words)))
        alpha = np.zeros(row[-1])
        for j in range(1, size + 1):
            k, own = many[j], [(n, logs) for n, logs in arcs if n <= j]
            for term, (n, logs) in zip(terms, own, strict=False):
                i = row[j - n]
                np.add(alpha[i : i + k], logs[i : i + k], out=term[:k])
            alpha[row[j] : row[j] + k] = _log_sum(terms[: len(own), :k])
        scores = alpha[row[lengths] + np.arange(len(words))]
        if uses is not None:
            beta = np.zeros(row[-1])  # ends stay 0
            for i in range(size - 1, -1, -1):
                k, own = many[i + 1], [(n, logs) for n, logs in arcs if i + n <= size]
                for term, (n, logs) in zip(terms, own, strict=False):
                    m, j = many[i + n], row[i + n]
                    np.add(logs[row[i] : row[i] + m], beta[j : j + m], out=term[:m])
                    term[m:k] = -np.inf
                beta[row[i] : row[i] + k] = _log_sum(terms[: len(own), :k])
            at, piece = np.concatenate([at for _, at, _ in edges]), np.concatenate([piece for *_, piece in edges])
            end = row[place[at] + np.repeat([n for n, *_ in edges], [len(at) for _, at, _ in edges])] + word[at]
            share = np.exp(alpha[state[at]] + self.logs[piece] + beta[end] - scores[word[at]]) * weights[word[at]]
            uses += np.bincount(piece, weights=share, minlength=len(uses))
        return scores

    def _starts(self, word: bytes, first: int) -> list[list[tuple[int, int, float]]]:
        """Of each position in the block from ``first``: (length, piece, log probability) of the pieces there."""
        size = min(BLOCK, len(word) - first)
        longest = self.tables[-1][0]
        starts: list[list[tuple[int, int, float]]] = [[] for _ in range(size)]
        for n, at, piece in self._edges(np.frombuffer(word[first : first + size + longest - 1], np.uint8)):
            for i, k, log in zip(at.tolist(), piece.tolist(), self.logs[piece].tolist(), strict=True):
                if i < size:
                    starts[i].append((n, k, log))
        return starts

    def _long(self, word: bytes, weight: float | None, uses: np.ndarray | None) -> float:
        """The same recursion for one word, over positions; pieces are looked up by the block."""
        size = len(word)
        alpha = np.full(size + 1, -np.inf)
        alpha[0] = 0.0
        for first in range(0, size, BLOCK):
            for i, own in enumerate(self._starts(word, first), first):
                for n, _, log in own:
                    alpha[i + n] = np.logaddexp(alpha[i + n], alpha[i] + log)
        if weight is not None and uses is not None:
            beta = np.full(size + 1, -np.inf)
            beta[size] = 0.0
            for first in reversed(range(0, size, BLOCK)):
                starts = self._starts(word, first)
                for i in range(first + len(starts) - 1, first - 1, -1):
                    for n, piece, log in starts[i - first]:
                        beta[i] = np.logaddexp(beta[i], log + beta[i + n])
                        uses[piece] += weight * np.exp(alpha[i] + log + beta[i + n] - alpha[size])
        return float(alpha[size])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {}

    def flush() -> pa.RecordBatch:
        words = pa.array([w for own in counts.values() for w in own], pa.binary())
        kinds = pa.array(np.repeat(np.array(list(counts), np.int32), [len(own) for own in counts.values()]))
        times = pa.array([c for own in counts.values() for c in own.values()], pa.int64())
        counts.clear()
        return pa.RecordBatch.from_arrays([words, kinds, times], ["word", "k", "c"])

    for batch in batches:
        for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(k, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield flush()
    if counts:
        yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c, by) over all rows of (text, k): a word's count, and its counts by class k.

    Counted in tasks before the one shuffle, by word; a word has at most as many rows as tasks send and ``by`` as many entries as there are classes.
    """
    sent = texts.select("text", "k").mapInArrow(_counted, "word binary, k int, c long").repartition("word")
    return sent.groupBy("word", "k").agg(F.sum("c").alias("c")).groupBy("word").agg(F.sum("c").alias("c"), F.collect_list(F.struct("k", "c")).alias("by"))


def _expected(lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattice(*lattice.value)
        total = np.zeros(len(model.pieces))
        for batch in batches:
            total += model.run(batch.column("word").to_pylist(), np.ones(batch.num_rows))[1]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "uses"])

    return run


def train(counts: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray, float]:
    """Pieces, log probabilities and that of a text's end among words.

    The vocabulary is taken as it is; its scores (ranks, in this format) give
    the first weights, and each round sets a piece's probability to its smoothed
    expected share of all uses over the different words of the counts: the
    lattice is to spell words that the counts don't know. Only sums by piece
    reach the driver: their number is that of the vocabulary.
    """
    spark = counts.sparkSession
    pieces, scores = zip(*read_pieces(path), strict=True)
    logs = -np.log(2.0 - np.array(scores))
    logs -= np.log(np.exp(logs).sum() * 2.0)
    end = -np.log(2.0)
    for _ in range(rounds):
        lattice = spark.sparkContext.broadcast((list(pieces), logs))
        uses = np.zeros(len(pieces))
        for piece, n in counts.select("word").mapInArrow(_expected(lattice), "piece int, uses double").groupBy("piece").agg(F.sum("uses")).collect():
            uses[piece] = round(n, 6)  # so that the order of sums leaves no trace
        total = uses.sum() + 1 + SMOOTH * (len(pieces) + 1)
        logs, end = np.log((uses + SMOOTH) / total), np.log((1 + SMOOTH) / total)
        lattice.unpersist()
    starts = sum(np.exp(x) for p, x in zip(pieces, logs, strict=True) if p[:1] == b" ")
    return list(pieces), logs, float(end - np.log(starts + np.exp(end)))


class Classes(NamedTuple):
    """Word shares of each class of documents.

    In class k a word with c of its ``tokens[k]`` tokens has the share
    (c - discount[k]) / tokens[k]; what the discounts free, ``spelt[k]``, is
    given out again by the lattice. ``prior`` is the classes' share of documents.
    """

    prior: np.ndarray
    tokens: np.ndarray
    discount: np.ndarray
    spelt: np.ndarray

    def gain(self, k: np.ndarray, c: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Log of a word's probability in class k over that of its spellings alone."""
        return np.logaddexp(0.0, np.log((c - self.discount[k]) / (self.tokens[k] * self.spelt[k])) - mark)


def _classes(counts: DataFrame, documents: np.ndarray) -> Classes:
    """Shares by class, from the words' counts and the number of documents, whose ends are tokens too."""
    if not documents.sum():
        one = np.ones(1)
        return Classes(one, one, 0 * one, one)
    n = len(documents)
    tokens, kinds, once, two = (np.zeros(n) for _ in range(4))
    sums = counts.select(F.inline("by")).groupBy("k").agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2))
    for k, *own in sums.collect():  # a row a class
        tokens[k], kinds[k], once[k], two[k] = own
    used = documents > 0
    tokens, kinds = np.where(used, tokens + documents, 1.0), kinds + used
    discount = np.where(once > 0, np.clip(once / np.maximum(once + 2.0 * two, 1.0), 0.1, 0.9), 0.5)
    return Classes(documents / documents.sum(), tokens, discount, np.where(used, discount * kinds / tokens, 1.0))


class Head(NamedTuple):
    """Frequent words by place: base scores, lattice scores, and gains in the classes ``kind[start[i]:start[i + 1]]``."""

    place: dict[bytes, int]
    base: np.ndarray
    mark: np.ndarray
    start: np.ndarray
    kind: np.ndarray
    gain: np.ndarray


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums by place; floats even where there is nothing to add."""
    return np.bincount(at, weights=values, minlength=size).astype(np.float64)


def _marked(shared):
    """Of counted words: the count, the lattice score and by class the gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logs, classes = shared.value
        model = Lattice(pieces, logs)
        for batch in batches:
            marks, _ = model.run(batch.column("word").to_pylist())
            many = batch.column("by").value_lengths().to_numpy()
            entries = batch.column("by").flatten()
            kind = entries.field("k")
            gain = classes.gain(kind.to_numpy(), entries.field("c").to_numpy(), np.repeat(marks, many))
            ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(many, dtype=np.int32)])
            gains = pa.MapArray.from_arrays(pa.array(ends), kind, pa.array(gain))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(marks), gains], ["word", "c", "known_mark", "known_gains"])

    return run


def _scored(shared):
    """Sums over the frequent words of texts, and lists of all others. Only held-out texts have words that
    aren't counted, so only their lists have lattice scores; other words get them beside their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logs, first_gain, step, end, head = shared.value
        model = Lattice(pieces, logs)
        names = ["tag", "n_tokens", "head", "head_known", "spelt", "gains", "tail"]
        get = head.place.get
        kinds = len(step)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                docs = [Counter(words_of(t)) for t in batch.column("text").to_pylist()]
                names_in = [w for d in docs for w in d]
                many = np.fromiter(map(len, docs), np.int64, len(docs))
                every = np.repeat(np.arange(len(docs)), many)
                count = np.fromiter(chain.from_iterable(d.values() for d in docs), np.int64, len(names_in))
                place = np.fromiter(map(get, names_in, repeat(-1)), np.int64, len(names_in))
                far = np.flatnonzero(place < 0)
                tail = [names_in[i] for i in far.tolist()]
                asked = batch.column("held_out").to_numpy(zero_copy_only=False)[every[far]]
                rest = list(dict.fromkeys(names_in[i] for i in far[asked].tolist()))
                scores = dict(zip(rest, model.run(rest)[0].tolist(), strict=True))
                marks = np.fromiter(map(scores.get, tail, repeat(0.0)), np.float64, len(tail))
                near = np.flatnonzero(place >= 0)
                row, at, times = every[near], place[near], count[near].astype(np.float64)
                size = len(docs)
                n = _sums(every, count.astype(np.float64), size).astype(np.int64) + 1
                base, known, spelt = (_sums(row, x, size) for x in (times * head.base[at], times, times * head.mark[at]))
                spelt += end
                many = head.start[at + 1] - head.start[at]
                entry = np.arange(many.sum()) + np.repeat(head.start[at] - np.cumsum(many) + many, many)
                gains = _sums(np.repeat(row, many) * kinds + head.kind[entry], np.repeat(times, many) * head.gain[entry], size * kinds).reshape(size, kinds)
                gains += first_gain + n[:, None] * step
                gains = pa.FixedSizeListArray.from_arrays(pa.array(gains.reshape(-1)), kinds).cast(pa.list_(pa.float64()))
                fields = {"word": pa.array(tail, pa.binary()), "times": pa.array(count[far]), "mark": pa.array(marks, mask=~asked)}
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(every[far], minlength=size))])
                joined = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
                yield pa.RecordBatch.from_arrays([batch.column("tag"), pa.array(n), pa.array(base), pa.array(known.astype(np.int64)), pa.array(spelt), gains, joined], names)

    return run


def lm_scores(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, *, folds: int = FOLDS, rounds: int = ROUNDS, head_words: int = HEAD_WORDS) -> DataFrame:
    """Scores of all texts by a subword lattice that learns from the documents outside one fold.

    A text is its words, each after a space, and an end. A word's lattice has
    all segmentations into pieces of the given vocabulary and one arc over the
    whole word, weighted by the word's discounted share of the training tokens;
    the discount pays for the other segmentations. Its probability is the sum
    over all paths, by forward recursion in log space, and a text's is the
    product over its words and the end; these sum to one over all texts.

    With ``class_col`` (say, the language) the arcs over whole words are learnt
    by class, and a text's probability is the sum over classes of the class's
    share of training documents times the text's probability in it. The class
    of a text that is scored isn't looked at. Null classes, and those with less
    than ``CLASS_SHARE`` of the training documents, are one class together, so
    that there are at most 101. Without ``class_col`` there is one class.

    ``base_score`` is the smoothed word unigram score, ``lattice_score`` that of
    the segmentations into pieces of the vocabulary alone, without whole words.
    Words are counted in tasks and summed by key; counts of the ``head_words``
    most frequent are broadcast, those of all others are joined to the documents.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    lattice_score (all log10). Null texts are empty: they have their end only.
    Null ids count as the empty string in the split. Repeated rows are each
    learnt and scored. With an empty training part, words have the smoothed mass
    alone.
    """
    spark = docs.sparkSession
    label = F.lit(None).cast("string") if class_col is None else F.col(class_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), label.alias("label"))
    rows = rows.withColumn("held_out", F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(folds)) == 0)
    training = rows.where("not held_out")
    n_docs = training.count()
    sizes = training.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CLASS_SHARE * n_docs).orderBy("label").collect()
    documents = np.array([n_docs - sum(r.n for r in sizes), *(r.n for r in sizes)], np.float64)  # class 0: all others
    k = F.coalesce(F.array_position(F.array(*[F.lit(r.label) for r in sizes]), F.col("label")), F.lit(0)) if sizes else F.lit(0)
    counts = cut(word_counts(training.select("text", k.cast("int").alias("k"))))
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, kinds = n_words + n_docs, distinct + bool(n_docs)
    scale = tokens + SMOOTH * (kinds + 1)
    pieces, logs, end = train(counts, path, rounds)
    model = _classes(counts, documents)
    head, others = _head(counts, head_words, Lattice(pieces, logs), model, scale)
    used = np.flatnonzero(model.prior)
    with np.errstate(divide="ignore"):
        first_gain, step = np.log(model.prior), np.log(model.spelt)
    first_gain[used] += model.gain(used, documents[used], end) if n_docs else 0.0
    shared = spark.sparkContext.broadcast((pieces, logs, first_gain, step, end, head))
    tagged = rows.withColumn("tag", F.monotonically_increasing_id())
    schema = "tag long, n_tokens long, head double, head_known long, spelt double, gains array<double>, tail array<struct<word:binary,times:long,mark:double>>"
    scored = cut(_with(tagged, ("doc_id", "held_out"), _scored(shared), schema))
    tail = scored.select("tag", F.explode("tail").alias("t")).select("tag", "t.word", "t.times", "t.mark")
    known = others.mapInArrow(_marked(spark.sparkContext.broadcast((pieces, logs, model))), "word binary, c long, known_mark double, known_gains map<int,double>")
    joined = tail.join(known, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = joined.groupBy("tag").agg(
        F.sum(F.col("times") * F.log10((F.col("c") + SMOOTH) / F.lit(float(scale)))).alias("rest"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("times") * F.coalesce("known_mark", "mark")).alias("rest_spelt"),
        *[F.sum(F.col("times") * F.element_at("known_gains", F.lit(int(j)))).alias(f"rest_{j}") for j in used],
    )
    none = F.lit(0.0)
    out = scored.drop("tail").join(sums, "tag", "left").withColumn("spelt", F.col("spelt") + F.coalesce("rest_spelt", none))
    parts = F.array(*[F.element_at("gains", int(j) + 1) + F.coalesce(f"rest_{j}", none) for j in used])
    out = out.withColumn("parts", parts).withColumn("most", F.array_max("parts"))
    score = F.col("spelt") + F.col("most") + F.log(F.aggregate("parts", none, lambda a, x: a + F.exp(x - F.col("most"))))
    ten = F.lit(float(np.log(10.0)))
    end_base = float(np.log10((n_docs + SMOOTH) / scale))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rest_known", F.lit(0)) + (1 if n_docs else 0)).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("head") + F.coalesce("rest", none) + F.lit(end_base)).alias("base_score"), (score / ten).alias("score"), (F.col("spelt") / ten).alias("lattice_score"))


def _head(counts: DataFrame, most: int, lattice: Lattice, model: Classes, scale: float) -> tuple[Head, DataFrame]:
    """The words from the least count that ``most`` words or fewer reach, and the counts of all others."""
    is_short = F.length("word") <= HEAD_BYTES
    short = counts.where(is_short)
    steps = sorted({round(2 ** (k / 4)) for k in range(200)})
    reached = short.agg(*[F.count_if(F.col("c") >= t).alias(f"t{k}") for k, t in enumerate(steps)]).first()
    least = next(t for k, t in enumerate(steps) if reached[k] <= most)
    table = short.where(F.col("c") >= least).toArrow().combine_chunks()
    words, times = table.column("word").to_pylist(), table.column("c").to_numpy()
    marks = np.concatenate([np.zeros(0), *(lattice.run(words[k : k + 20_000])[0] for k in range(0, len(words), 20_000))])
    by = table.column("by")
    many = np.array([x for chunk in by.chunks for x in chunk.value_lengths().to_pylist()], np.int64)
    entries = [chunk.flatten() for chunk in by.chunks]
    kind, own = (np.concatenate([np.zeros(0, np.int64), *(e.field(f).to_numpy() for e in entries)]).astype(np.int64) for f in ("k", "c"))
    gain = model.gain(kind, own, np.repeat(marks, many))
    start = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])
    head = Head({w: k for k, w in enumerate(words)}, np.log10((times + SMOOTH) / scale), marks, start, kind, gain)
    return head, counts.where(~is_short | (F.col("c") < least))


def _with(rows: DataFrame, carried: tuple[str, ...], run, schema: str) -> DataFrame:
    """mapInArrow that also passes ``carried`` columns through."""
    from pyspark.sql import types as T

    kept = T.StructType([rows.schema[c] for c in carried])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for out in run(iter([batch])):
                columns = [batch.column(c).slice(at, out.num_rows) for c in carried]
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([*columns, *out.columns], [*carried, *out.schema.names])

    return rows.mapInArrow(both, T.StructType([*kept.fields, *T._parse_datatype_string(schema).fields]))


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scores(docs, public_tokenizers.path("piece_bpe_32k.model"), class_col="lang" if "lang" in docs.columns else None)
