"""What the operators share: materialising, packing rows, distributed ranks."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space and words as the contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        told = "file:///tmp/checkpoints/fourfold"
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends there,
    so lost executors cost a reread, and later uses do not compute it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete cut tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            with contextlib.suppress(Exception):
                path = jvm.org.apache.hadoop.fs.Path(file)
                if path.getName().startswith("cut-"):
                    path.getFileSystem(conf).delete(path, True)


#: Rows up to which a table of narrow rows is broadcast.
BROADCAST_ROWS = 200_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a cut table of narrow rows for broadcast if a count shows that it is small;
    else leave it to a shuffled join, in which adaptive execution splits hot keys."""
    return F.broadcast(table) if table.count() <= rows else table


def text_of(text: str | Column = "text") -> Column:
    """The text column as a string, null read as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as (doc_id, text, row): the input's own columns stay inside ``row``,
    so that none of their names can clash with an operator's."""
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.struct("*").alias("row"))


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's id and text: rows share one only if both agree."""
    return F.xxhash64(*cols)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def global_running_sum(df: DataFrame, order: list[str], value: str, out: str, rank: str | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` (a long) over a total order of all rows, without one task that sees them all.

    Rows are range-partitioned by ``order`` and written with their partition's
    number; a partition sums its own rows, and the sums of the partitions before
    it are joined in. ``rank`` also asks for the row number. Where ``order``
    ties, rows of a tie take their places in any order; with equal values the
    result is the same as a multiset. Nulls sort first.
    """
    spark = df.sparkSession
    n = partitions(spark)
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = cut(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = totals.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__first"))
    own = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__own", F.sum(value).over(own)).withColumn("__n", F.row_number().over(own)) if rank else ranged.withColumn("__own", F.sum(value).over(own))
    summed = summed.join(F.broadcast(starts), "__part")
    summed = summed.withColumn(out, F.col("__own") + F.col("__start"))
    if rank:
        summed = summed.withColumn(rank, F.col("__n") + F.col("__first"))
    return summed.drop("__part", "__own", "__n", "__start", "__first")
