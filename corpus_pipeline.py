"""A training-data pipeline over ``documents``: five stages, each writing what the next one reads.

All stages take nulls in any column, empty and very long texts, repeated rows,
empty tables and further columns of any name, which they carry along. A null or
empty text isn't toxic, near to nothing and clean; of exact copies of it the one
with the smallest id stays, and the mix takes it once. Rows without an id count
as the largest id. Ties go as each operator's docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.llm import decontaminate, exact_dedup, minhash, mixing, toxicity
from fourfold.llm.common import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain rejects go."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(docs, chain).where("not toxic").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays."""
    return exact_dedup.exact_dedup(docs).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the smallest doc_id stays."""
    return minhash.near_duplicates(docs).where("kept").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages cover by a twentieth or more go; shorter passages are cut out of the others, and n_chars follows. All others stay as they are."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with size, source_size, target, times and taken; names that ``docs`` has too get ``mix_`` before them until they are new."""
    mixed = mixing.fair_mix(docs, keep=docs.columns).where("times > 0")
    known = {c.lower() for c in docs.columns}
    added = []
    for c in ("size", "source_size", "target", "times", "taken"):
        name = c
        while name in known:
            name = f"mix_{name}"
        known.add(name)
        added.append(F.col(c).alias(name))
    return mixed.select("row.*", *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity stage applies a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
