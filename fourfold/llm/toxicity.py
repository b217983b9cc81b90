"""Toxicity by a chain of linear classifiers over word features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.llm.common import cut, text_of
from fourfold.llm.linear import fit_logistic, logits, out_of_fold, sigmoid

#: Labelled rows the chain learns from at most, taken in the order of a hash of the id.
SAMPLE_ROWS = 6_000
#: Words with the clearest difference between classes that become features at most.
FEATURES = 400
#: Standard deviations of a word's difference in document share.
CLEAR = 5.0
FOLDS = 5
L2 = 0.05
THRESHOLD = 0.5

#: Lengths of word beginnings that are features too (written with a star).
STEMS = (4, 5, 6, 7)

_words = re.compile(r"\w+").findall


def features_of(text: str) -> set[str]:
    words = set(_words(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


@dataclass
class Chain:
    """categories: in order; coefs: for each the weights of words, of earlier categories' probabilities, and the intercept."""

    categories: list[str]
    words: list[str]
    coefs: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        for coef in self.coefs:
            x = np.hstack([x, sigmoid(logits(x, coef))[:, None]])
        return x[:, len(self.words) :]


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, categories: list[str], words: list[str], l2: float = L2) -> Chain:
    """Each category's model sees the words and the out-of-fold probabilities of the categories before it."""
    coefs, seen = [], x
    for k in range(len(categories)):
        coefs.append(fit_logistic(seen, y[:, k], l2))
        seen = np.hstack([seen, sigmoid(out_of_fold(seen, y[:, k], fold, l2))[:, None]])
    return Chain(categories, words, coefs)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [list(features_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(words, pa.list_(pa.string()))], ["doc_id", "y", "words"])


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("toxic",), severe: str | None = "severe_toxic", id_col: str = "doc_id", text_col: str = "text", *, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, clear: float = CLEAR) -> Chain:
    """Fit a chain on a bounded sample of labelled rows.

    ``categories`` are 0/1 columns of ``labels``; null counts as 0, and of rows
    with the same id the largest label holds. ``severe`` adds a category after
    them: documents of the first category with at least as many different
    telling words as half of that category's documents with any. Words and their
    beginnings become features by the difference of their shares of documents of the two classes
    of any category. Rows without an id are not learnt from.
    """
    names = list(categories)
    label = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c), F.lit(0))).cast("int").alias(c) for c in names])
    sample = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", F.array(*names).alias("y"))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    seen = cut(texts.mapInArrow(_distinct_words, f"doc_id {id_type}, y array<int>, words array<string>").dropDuplicates(["doc_id"]))
    rows = sorted(((r.doc_id, list(r.y)) for r in seen.select("doc_id", "y").collect()), key=lambda r: str(r[0]))
    y = np.array([r[1] for r in rows], float).reshape(len(rows), len(names))
    word = seen.select("y", F.explode("words").alias("word"))
    strong: set[str] = set()
    telling: set[str] = set()
    for k in range(len(names)):
        n1, n0 = float(y[:, k].sum()), float(len(y) - y[:, k].sum())
        if not n1 or not n0:
            continue
        share = word.groupBy("word").agg(F.sum(F.col("y")[k]).cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n")).where("n >= 3")
        pooled = F.col("n") / (n0 + n1)
        z = (F.col("a") / n1 - (F.col("n") - F.col("a")) / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
        best = share.withColumn("z", z).where(F.abs("z") >= clear).orderBy(F.desc(F.abs("z")), "word").limit(features).collect()
        strong |= {r.word for r in best}
        telling |= {r.word for r in best if k == 0 and r.z > 0 and r.a >= 0.8 * r.n}
    words = sorted(strong)
    known = F.array(*map(F.lit, words)).cast("array<string>")
    place = {w: k for k, w in enumerate(words)}
    at = {r[0]: k for k, r in enumerate(rows)}
    x = np.zeros((len(rows), len(words)))
    for doc_id, own in seen.select("doc_id", F.array_intersect("words", known)).toLocalIterator():
        x[at[doc_id], [place[w] for w in own]] = 1.0
    if severe:
        hits = x[:, [place[w] for w in words if w in telling]].sum(axis=1) * y[:, 0]
        some = hits[hits > 0]
        y = np.hstack([y, ((hits > 0) & (hits >= (np.median(some) if len(some) else np.inf)))[:, None].astype(float)])
        names = [*names, severe]
    fold = np.arange(len(rows)) % FOLDS
    return fit_chain(x, y, fold, names, words)


def toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, with_rows: bool = True) -> DataFrame:
    """Probabilities of all categories for every document, in one pass.

    Returns doc_id, one double for each category (named p_<category>), toxic
    (any category above ``threshold``, so nothing without labels) and, ``with_rows``, the input row as
    struct ``row``. Null and empty texts have no words: their probabilities are
    the chain's for a document without features. Repeated rows score alike.
    """
    from pyspark.sql import types as T

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *([F.struct("*").alias("row")] if with_rows else []))
    shared = docs.sparkSession.sparkContext.broadcast((chain.categories, chain.words, chain.coefs))
    carried = [f for f in rows.schema.fields if f.name != "text"]
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(*shared.value)
        place = {w: k for k, w in enumerate(model.words)}
        known = place.keys()
        for batch in batches:
            x = np.zeros((batch.num_rows, len(place)))
            for k, text in enumerate(batch.column("text").to_pylist()):
                hit = known & features_of(text)
                if hit:
                    x[k, [place[w] for w in hit]] = 1.0
            p = model.probabilities(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in carried), *(pa.array(p[:, k]) for k in range(len(names)))], [*(f.name for f in carried), *names])

    schema = T.StructType([*carried, *(T.StructField(n, T.DoubleType()) for n in names)])
    scored = rows.mapInArrow(run, schema)
    return scored.withColumn("toxic", F.greatest(*map(F.col, names), F.lit(0.0)) > threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, train(docs, labels), with_rows=False)
