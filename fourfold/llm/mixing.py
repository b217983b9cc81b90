"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.llm.common import WORD, cut, global_running_sum, quoted, small, text_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int, budget: float = 1.0) -> DataFrame:
    """(source, source_size) with its weight and target.

    Sources take the weights in turn, in order of their code points, null last.
    Shares of ``budget`` times all sizes go out by weight; a source gets
    ``max_repeats`` times its size at most, and what it can't take is shared out
    again among the others until none is above. Every round is one sum over the
    table of sources; only sums reach the driver.
    """
    ranked = sizes.withColumn("__last", F.col("source").isNull()).withColumn("__one", F.lit(1).cast("long"))
    ranked = global_running_sum(ranked, ["__last", "source"], "__one", "__rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * max_repeats).cast("double").alias("most")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share = float(total) * budget
    level = None  # target for each unit of weight
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("most")
        taken, open_weight = ranked.agg(F.sum(F.when(capped, F.col("most")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        new = (share - taken) / open_weight
        if level is not None and new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least("most", F.col("weight") * F.lit(level if level is not None else 0.0)))


def fair_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, budget: float = 1.0, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """How often the mix takes each document.

    A source's documents queue in the order of a hash of seed and id, and the
    queue starts again up to ``max_repeats`` times. A document's virtual finish
    time is the words its source has sent up to its end, over the source's
    target. All queued documents are sorted by it over all sources, and the mix
    is the longest beginning of that order within the budget.

    Returns doc_id, source, size, source_size, target, times, taken and
    ``keep``'s columns (inside struct ``row``). A null text has no words, and
    a document without words is taken once with its place in the queue's first
    round. Null sources form the last source. Ties in time go by source, then
    queue. Repeated rows queue one after the other. Empty tables give empty
    results.
    """
    size = word_count(text_of(text_col))
    carried = [F.struct(*map(quoted, keep)).alias("row")] if keep else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *carried)
    rows = rows.withColumn("__shuffle", F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16))
    rows = cut(rows.withColumn("__tag", F.monotonically_increasing_id()))
    slim = rows.drop("row")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, max_repeats, budget))
    queued = global_running_sum(slim, ["source", "__shuffle", "doc_id", "__tag"], "size", "__all")
    starts = queued.groupBy("source").agg(F.min(F.col("__all") - F.col("size")).alias("__start"))
    with_starts = cut(targets.join(starts, targets["source"].eqNullSafe(starts["source"])).select(targets["source"], "source_size", "target", "__start"))
    joined = cut(queued.withColumnRenamed("source", "__s").join(small(with_starts), F.col("__s").eqNullSafe(F.col("source"))).drop("__s"))
    rounds = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    copies = joined.where("size > 0").withColumn("__round", F.explode(rounds))
    finish = (F.col("__round") * F.col("source_size") + F.col("__all") - F.col("__start")).cast("double") / F.col("target")
    copies = copies.select("__tag", "size", "source", "__shuffle", "doc_id", "__round", finish.alias("__finish"))
    line = global_running_sum(copies, ["__finish", "source", "__round", "__shuffle", "doc_id", "__tag"], "size", "__sent")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    limit = F.lit(float(total) * budget)
    times = line.where(F.col("__sent") <= limit).groupBy("__tag").agg(F.count(F.lit(1)).alias("times"))
    out = joined.join(times, "__tag", "left")
    out = out.withColumn("times", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.coalesce("times", F.lit(0))).cast("long"))
    out = out.select("__tag", "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "times", (F.col("times") * F.col("size")).alias("taken"))
    return out.join(rows.select("__tag", "row"), "__tag").drop("__tag") if keep else out.drop("__tag")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fair_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         substr(md5(concat('mix:', coalesce(cast(doc_id as varchar), ''))), 1, 16) as shuffled
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as rk from d group by source
), w as (
  select *, cast([5, 2, 1][(rk - 1) % 3 + 1] as double) as weight, cast(source_size * 3 as double) as most from s
), o as (
  select *, coalesce(sum(most) over before, 0) as c0, sum(weight) over () - coalesce(sum(weight) over before, 0) as w0,
         cast(sum(source_size) over () as double) as budget, row_number() over (order by most / weight, rk) as j
  from w window before as (order by most / weight, rk rows between unbounded preceding and 1 preceding)
), l as (
  select arg_min((budget - c0) / w0, j) as level from o where (budget - c0) / w0 <= most / weight
), t as (
  select source, source_size, least(most, weight * level) as target, budget from o, l
), q as (
  select d.*, t.source_size, t.target, t.budget,
         cast(sum(size) over (partition by d.source order by shuffled, doc_id rows unbounded preceding) as bigint) as sent
  from d join t on d.source is not distinct from t.source
), c as (
  select q.*, round, cast(cast(round * source_size + sent as bigint) as double) / target as finish
  from q cross join (select unnest([0, 1, 2]) as round) where size > 0
), m as (
  select *, sum(size) over (order by finish, source nulls first, round, shuffled, doc_id rows unbounded preceding) as line from c
), n as (
  select doc_id, count(*) as times from m where line <= budget group by doc_id
)
select q.doc_id, q.size, q.source_size, q.target, cast(coalesce(n.times, 0) * q.size as bigint) as taken
from q left join n on q.doc_id is not distinct from n.doc_id
"""
