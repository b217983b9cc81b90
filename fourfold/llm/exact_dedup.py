"""Exact deduplication: 128-bit content hashes, then a byte comparison inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.llm.common import SPACE, cut, packed

#: Members of one group that are compared with one copy of the text that stays.
GROUP_SLICE = 2048


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, normalise: Callable[[Column], Column] = normalised, hashed: Callable[[Column], Column] = content_hash, with_rows: bool = True) -> DataFrame:
    """Which rows have equal texts, and the one of each group that stays.

    Rows are grouped by a 128-bit hash of the normalised text; only counts and
    smallest ids are shuffled for that, summed before the shuffle. Members of
    groups of two or more are then compared, byte by byte, with the text of the
    group's smallest id. A group's members are dealt over slices of
    ``GROUP_SLICE``, each with its own copy of that text, so no task holds a
    large group. Texts that differ in spite of equal hashes form groups of
    their own in a further round.

    Returns doc_id, keep_id, group_size, kept, text_sha256 and (``with_rows``)
    the input row as struct ``row``. A null text counts as empty. Null ids are
    larger than any other. Of rows that share the smallest id too, one stays.
    An empty table gives an empty result.
    """
    rows = packed(docs, id_col, text_col)
    rows = rows.select("doc_id", normalise(F.col("text")).alias("__text"), *(["row"] if with_rows else []))
    todo = rows.withColumn("__h", hashed(F.col("__text"))).withColumn("__sha", F.sha2(F.encode("__text", "UTF-8"), 256))
    carried = ["row"] if with_rows else []
    done = None
    while True:
        groups = cut(todo.groupBy("__h").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
        # A left join of two shuffled inputs, so that adaptive execution may split a hot group.
        met = todo.join(groups, "__h", "left").withColumn("__tag", F.monotonically_increasing_id())
        met = met.withColumn("__text", F.when(F.col("group_size").isNotNull(), F.col("__text")))
        met = cut(met)
        single = met.where("group_size is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256"), *carried)
        many = met.where("group_size is not null")
        slices = F.expr(f"group_size div {GROUP_SLICE} + 1")
        stays = many.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("__h").agg(F.min_by("__text", "__tag").alias("__stays"), F.min("__tag").alias("__stays_tag"), F.min("group_size").alias("group_size"))
        stays = stays.select("__h", "__stays", "__stays_tag", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("__slice"))
        compared = many.withColumn("__slice", F.pmod(F.col("__tag"), slices)).join(stays, ["__h", "__slice"])
        compared = compared.withColumn("__same", F.col("__text") == F.col("__stays")).withColumn("kept", F.col("__tag") == F.col("__stays_tag"))
        verdict = cut(compared.select("doc_id", "keep_id", "group_size", "kept", "__sha", "__h", "__same", F.when(~F.col("__same"), F.col("__text")).alias("__text"), *carried))
        clash = verdict.where("not __same")
        clashes = clash.limit(1).count() > 0
        same = verdict.where("__same")
        if clashes:
            sizes = same.groupBy("__h").agg(F.count(F.lit(1)).alias("__size"))
            same = same.join(sizes, "__h").withColumn("group_size", F.col("__size"))
        same = same.select("doc_id", "keep_id", "group_size", "kept", F.col("__sha").alias("text_sha256"), *carried)
        found = single.unionByName(same)
        done = found if done is None else done.unionByName(found)
        if not clashes:
            return done
        todo = clash.select("doc_id", "__text", *carried, "__h", "__sha")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, with_rows=False)


OP7_SQL = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), g as (
  select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm
)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""
