"""Quality by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.llm import kernels
from fourfold.llm.common import cut, text_of
from fourfold.llm.linear import fit_logistic, logits, sigmoid

#: Labelled rows that the views learn from at most, taken in the order of a hash of the id. All rows without labels take part.
LABELLED = 6_000
ROUNDS = 5
#: Pseudo-labels that a view hands over in a round at most, as a share of all unlabelled rows, and how sure it must be.
HANDED, SURE = 0.1, 0.95
#: Weight of a pseudo-label; all of them together weigh at most this share of the true labels.
PSEUDO_WEIGHT = 0.5
FOLDS = 5
L2 = 1.0
#: Newton steps a round, each one pass over the unlabelled rows; rounds start from the round before.
STEPS = 3
WORD_BUCKETS, LANG_BUCKETS, SOURCE_BUCKETS = 128, 16, 64
#: Bins of calibrated logits, from which the surest rows are told.
BINS, REACH = 2_400, 12.0

_KIND = np.full(256, 4)
_KIND[[*range(48, 58)]] = 0  # digits
_KIND[[*range(97, 123), *range(128, 256)]] = 1  # letters, bytes of non-ASCII letters
_KIND[[*range(65, 91)]] = 2  # capitals
_KIND[[32, *range(9, 14)]] = 3  # white space
_KIND[[*b".,;:!?'\"-()"]] = 5  # common marks; all else stays 4: symbols


def text_features(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    shares = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6) / max(n, 1)
    words = raw.split()
    lines = raw.count(b"\n") + 1
    k = max(len(words), 1)
    bars = raw.count(b" | ")
    ends = sum(raw.count(c + b" ") + raw.count(c + b"\n") for c in (b".", b"!", b"?"))
    h = kernels.word_hashes(raw.lower())
    buckets = np.bincount((h % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=WORD_BUCKETS) / max(len(h), 1)
    return [np.log1p(n), *shares.tolist(), len(set(words)) / k, n / k, np.log1p(n / lines), ends / k, bars / k, float(n == 0), *buckets.tolist()]


def meta_features(lang: str | None, source: str | None) -> list[float]:
    """Language and source, and whether they are known; nothing that the text tells."""
    out = [0.0] * (LANG_BUCKETS + SOURCE_BUCKETS)
    if lang is not None:
        out[zlib.crc32(lang.encode()) % LANG_BUCKETS] = 1.0
    if source is not None:
        out[LANG_BUCKETS + zlib.crc32(source.encode()) % SOURCE_BUCKETS] = 1.0
    return [*out, float(lang is None), float(source is None)]


TEXT_SIZE, META_SIZE = len(text_features("")), len(meta_features(None, None))
PARTS = (slice(0, TEXT_SIZE), slice(TEXT_SIZE, None))


@dataclass
class Views:
    """Scaling and models of the two views, their calibrations, and the combination's coefficients."""

    middle: np.ndarray
    spread: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    both: np.ndarray

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view, and both."""
        z = (x - self.middle) / self.spread
        a = logits(logits(z[:, :TEXT_SIZE], self.text)[:, None], self.text_scale)
        b = logits(logits(z[:, TEXT_SIZE:], self.meta)[:, None], self.meta_scale)
        return sigmoid(a), sigmoid(b), sigmoid(logits(np.stack([a, b], axis=1), self.both))


class LocalPool:
    """Unlabelled rows in one matrix."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def total(self, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        return f(self.x)


class TablePool:
    """Unlabelled rows in a table of packed features: a pass sums over tasks, and only sums reach the driver."""

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width = rows.select("x"), width

    def total(self, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        width = self.width

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = f(np.zeros((0, width)))
            for batch in batches:
                held = held + f(np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, width).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()])], ["v"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                for v in batch.column("v").to_pylist():
                    held = np.frombuffer(v) if held is None else held + np.frombuffer(v)
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()])], ["v"])

        sums = self.rows.mapInArrow(part, "v binary").repartition(4).mapInArrow(add, "v binary").collect()
        return sum((np.frombuffer(r.v) for r in sums), f(np.zeros((0, width))))


@dataclass
class Handover:
    """What a round hands over: both views' models and calibrations, and the bins of logits from and up to which they are sure."""

    models: tuple[np.ndarray, np.ndarray]
    scales: tuple[np.ndarray, np.ndarray]
    high: tuple[int, int]
    low: tuple[int, int]


def _bins(z: np.ndarray, view: int, models, scales) -> np.ndarray:
    """Bin of each row's calibrated logit in a view."""
    at = logits(logits(z[:, PARTS[view]], models[view])[:, None], scales[view])
    return np.clip((at + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(int)


def _given(z: np.ndarray, view: int, rounds: list[Handover]) -> np.ndarray:
    """Pseudo-label of each row for a view: the first one that the other view was sure of; -1 without."""
    out, other = np.full(len(z), -1.0), 1 - view
    for r in rounds:
        at = _bins(z, other, r.models, r.scales)
        free = out < 0
        out[free & (at >= r.high[other])] = 1.0
        out[free & (at <= r.low[other])] = 0.0
    return out


def co_train(x: np.ndarray, y: np.ndarray, pool: LocalPool | TablePool, pooled: int, middle: np.ndarray, spread: np.ndarray, rounds: int = ROUNDS) -> Views:
    """x, y: labelled features and labels; pool: ``pooled`` rows without labels; middle, spread: scaling of all rows.

    In a round each view, fitted on the labels and what the other handed it,
    labels the rows of the pool that it is surest of for the other one. A row's
    pseudo-label follows from the models of the rounds so far, so no row is
    stored with it. Fits are Newton steps on gradients and curvatures summed
    over the pool. Calibrations and the combination are fitted on out-of-fold
    logits of true labels only; the models of all folds share a curvature.
    """
    own = (x - middle) / spread
    fold = np.arange(len(y)) % FOLDS
    sizes = [TEXT_SIZE + 1, META_SIZE + 1]
    soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))  # targets keep away from 0 and 1, as Platt has it
    coefs = [[fit_logistic(own[:, PARTS[v]], y, L2), *[fit_logistic(own[fold != k][:, PARTS[v]], y[fold != k], L2) for k in range(FOLDS)]] for v in (0, 1)]

    def held_out(v: int) -> np.ndarray:
        out = np.zeros(len(y))
        for k in range(FOLDS):
            out[fold == k] = logits(own[fold == k][:, PARTS[v]], coefs[v][1 + k])
        return out

    def calibration(v: int) -> np.ndarray:
        """Platt's scaling of out-of-fold logits; a view whose logits don't rise with the label gives the classes' odds."""
        scale = fit_logistic(held_out(v)[:, None], soft, 1e-3)
        return scale if scale[0] > 0 else np.array([0.0, np.log(soft.mean() / (1 - soft.mean())) if len(soft) else 0.0])

    def sums(z: np.ndarray, label: np.ndarray, v: int, models: list[np.ndarray], keep: list[np.ndarray]) -> np.ndarray:
        """Curvature under the first model, then a gradient for each model, over the rows it keeps."""
        a = np.hstack([z[:, PARTS[v]], np.ones((len(z), 1))])
        p = sigmoid(a @ models[0])
        curve = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a
        gradients = [a.T @ (rows * (sigmoid(a @ m) - label)) for m, rows in zip(models, keep, strict=True)]
        return np.concatenate([curve.ravel(), *gradients])

    scales = [calibration(v) for v in (0, 1)]
    past: list[Handover] = []
    most, prior = HANDED * pooled, float(y.mean()) if len(y) else 0.5
    learns = 0 < y.sum() < len(y) and pooled > 0
    for _ in range(rounds if learns else 0):
        models = (coefs[0][0], coefs[1][0])

        def counted(raw: np.ndarray, models=models, scales=tuple(scales)) -> np.ndarray:
            z = (raw - middle) / spread
            return np.concatenate([np.bincount(_bins(z, v, models, scales), minlength=BINS) for v in (0, 1)]).astype(float)

        counts = pool.total(counted).reshape(2, BINS)
        sure = int((np.log(SURE / (1 - SURE)) + REACH) * (BINS / (2 * REACH))) + 1
        above, below = counts[:, ::-1].cumsum(axis=1), counts.cumsum(axis=1)
        high, low = [], []
        for v in (0, 1):
            # both classes in the proportion of the true labels, as many as the scarcer one allows
            rows = min(most, above[v][BINS - 1 - sure] / prior, below[v][BINS - 1 - sure] / (1 - prior))
            high.append(max(sure, BINS - int((above[v] <= rows * prior).sum())))
            low.append(min(BINS - 1 - sure, int((below[v] <= rows * (1 - prior)).sum()) - 1))
        past.append(Handover(models, tuple(scales), tuple(high), tuple(low)))
        for _ in range(STEPS):

            def summed(raw: np.ndarray, now=[list(c) for c in coefs], past=list(past)) -> np.ndarray:
                z = (raw - middle) / spread
                out = []
                for v in (0, 1):
                    label = _given(z, v, past)
                    some = label >= 0
                    out += [sums(z[some], label[some], v, now[v], [np.ones(int(some.sum()))] * (1 + FOLDS)), [float(some.sum())]]
                return np.concatenate(out)

            pseudo, at = pool.total(summed), 0
            for v in (0, 1):
                n = sizes[v]
                keep = [np.ones(len(y)), *[(fold != k).astype(float) for k in range(FOLDS)]]
                size = n * n + (1 + FOLDS) * n
                weight = PSEUDO_WEIGHT * min(1.0, len(y) / max(pseudo[at + size], 1.0))
                total = weight * pseudo[at : at + size] + sums(own, y, v, coefs[v], keep)
                at += size + 1
                ridge = np.append(np.full(n - 1, L2), 1e-6)
                curve = total[: n * n].reshape(n, n) + np.diag(ridge)
                for k in range(1 + FOLDS):
                    step = np.linalg.solve(curve, total[n * n + k * n : n * n + (k + 1) * n] + ridge * coefs[v][k])
                    coefs[v][k] = coefs[v][k] - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        scales = [calibration(v) for v in (0, 1)]
    calibrated = np.stack([logits(held_out(v)[:, None], scales[v]) for v in (0, 1)], axis=1) if len(y) else np.zeros((0, 2))
    return Views(middle, spread, coefs[0][0], coefs[1][0], scales[0], scales[1], fit_logistic(calibrated, soft, 1e-3))


def scaling(pool: LocalPool | TablePool, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and deviations of all features."""
    got = pool.total(lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    n, mean = max(got[0], 1.0), got[1 : width + 1] / max(got[0], 1.0)
    spread = np.sqrt(np.maximum(got[width + 1 :] / n - mean * mean, 0.0))
    return int(got[0]), mean, np.where(spread > 1e-6, spread, 1.0)


def features_of(text: str, lang: str | None, source: str | None) -> list[float]:
    return [*text_features(text), *meta_features(lang, source)]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.array(features_of(*row), np.float32).tobytes() for row in zip(*(batch.column(k).to_pylist() for k in ("text", "lang", "source")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "x"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids, texts and metadata; a column that is missing is null."""
    meta = [(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")]
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *meta)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", *, labelled: int = LABELLED, rounds: int = ROUNDS) -> Views:
    """Fit both views on a bounded sample of labelled rows and on all rows without labels.

    Null labels and rows without an id teach nothing as labels; of labels for one id the largest
    holds, and of an id's different texts the one whose features are least. Labelled rows beyond the bound serve as unlabelled ones.
    """
    label = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col)).cast("double").alias("y"))
    some = cut(label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    table = cut(rows.mapInArrow(_featured, f"doc_id {kind}, x binary").join(F.broadcast(some), "doc_id", "left"))
    got = table.where("y is not null").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id)))
    width = TEXT_SIZE + META_SIZE
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], float).reshape(-1, width)
    y = np.array([float(r.y > 0) for r in got])
    _, middle, spread = scaling(TablePool(table, width), width)
    free = table.where("y is null")
    return co_train(x, y, TablePool(free, width), free.count(), middle, spread, rounds)


def quality(docs: DataFrame, views: Views, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every document by both views and their combination, in one pass.

    Returns doc_id, text_score, meta_score, quality_score (probabilities) and
    high_quality (0.5 or more). Null texts are empty; missing metadata has
    features of its own. Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(views))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Views(**shared.value)
        for batch in batches:
            x = np.array([features_of(*row) for row in zip(*(batch.column(k).to_pylist() for k in ("text", "lang", "source")), strict=True)]).reshape(batch.num_rows, TEXT_SIZE + META_SIZE)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, model.scores(x))], ["doc_id", "text_score", "meta_score", "quality_score"])

    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, quality_score double").withColumn("high_quality", F.col("quality_score") >= 0.5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
