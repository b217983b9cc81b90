"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fourfold.llm import kernels
from fourfold.llm.common import cut, row_key, small, text_of
from fourfold.operators.graphs import components

SHINGLE = 5
BANDS, ROWS = 32, 4
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Holders up to which a shingle's holders meet each other.
RARE = 64


def _signed(bands: int, rows: int, shingle: int):
    size = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, signs = [], [], []
            for text in batch.column("text").to_pylist():
                own = kernels.shingle_set(text.encode("utf-8", "surrogatepass").lower(), shingle)
                n.append(len(own))
                if len(own):
                    keys.append(kernels.digest(own))
                    values = kernels.superminhash(own, size).view(np.uint64)
                    signs.append((kernels.mix(values) >> np.uint64(48)).astype("<u2").tobytes())
                else:
                    keys.append(None)
                    signs.append(None)
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], [*names, "n_shingles", "set_key", "sign"])

    return run


def _sets(shingle: int):
    """Sorted distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = batch.column("node"), batch.column("text").to_pylist()
            for first in range(0, len(texts), 64):
                own = [kernels.shingle_set(t.encode("utf-8", "surrogatepass").lower(), shingle).view(np.int64) for t in texts[first : first + 64]]
                ends = np.cumsum([0, *map(len, own)])
                values = np.concatenate(own)
                if len(values) < 1 << 31:
                    arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                    yield pa.RecordBatch.from_arrays([nodes.slice(first, len(own)), arrays], ["node", "hs"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole shingle sets are similar enough."""
    size = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"))
    near = pairs.join(size("a"), "a").join(size("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")
    with_b = near.join(sets.select(F.col("node").alias("b"), F.col("hs").alias("hs_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("hs_a")), "a")
    common = F.size(F.array_intersect("hs_a", "hs_b"))
    return cut(both.where(100 * common >= percent * (F.size("hs_a") + F.size("hs_b") - common)).select("a", "b"))


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after further links: components of the components that these join."""
    own = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    between = found.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("label_a", "a").alias("x"), F.coalesce("label_b", "b").alias("y")).where("x <> y")
    joined = cut(components(between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))))
    moved = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    fresh = joined.join(labels.select("node"), "node", "left_anti")
    return cut(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")).unionByName(fresh))


def _tokens(sets: DataFrame) -> DataFrame:
    return sets.select("node", "label", "n", F.explode("hs").alias("h"))


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``df`` with each node's component in ``label``; nodes without links are their own."""
    return df.drop("label").join(small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _opened(members: DataFrame) -> DataFrame:
    """Members (key, node, label) of buckets that hold several components, with ``out`` for those outside the bucket's largest."""
    counts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("many"))
    several = counts.groupBy("key").agg(F.max_by("label", F.struct("many", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("key", "main")
    return cut(members.join(small(cut(several)), "key").withColumn("out", F.col("label") != F.col("main")).drop("main"))


def _alive(sets: DataFrame, percent: int, rare: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that may have a link to another component, and the shingles (h, c holders) that several components hold.

    A link between two components shares shingles that both hold, and at least
    ``percent`` of either set; nodes with fewer such shingles (m) go, whatever
    their number. This is done twice, as shingles may lose their second holder.
    f of the m shingles have more than ``rare`` holders.
    """
    alive = sets
    for _ in range(2):
        holders = _tokens(alive).groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi").select("h", "c")
        holders = cut(holders)
        shared = _tokens(alive).join(small(holders), "h").groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("c") > rare, 1)).alias("f"))
        alive = cut(alive.select("node", "label", "n", "hs").join(shared, "node").where(100 * F.col("m") >= percent * F.col("n")))
    return alive, holders


def _central_pairs(members: DataFrame) -> DataFrame:
    """Each member with its bucket's most central one, that with the largest share of shingles that other components hold too."""
    central = members.groupBy("key").agg(F.max_by(F.struct("node", "label"), F.struct(F.col("m") / F.col("n"), -F.col("node"))).alias("x"))
    met = members.join(small(cut(central)), "key").where(F.col("label") != F.col("x.label"))
    return met.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct()


def _open_pairs(members: DataFrame, alive: DataFrame, holders: DataFrame, percent: int, rare: int) -> DataFrame:
    """Pairs that may yet be links between different components of a bucket, without meeting all members.

    A pair either shares a shingle of at most ``rare`` holders (a join on those,
    from the rarest ones that a link can't miss), or its frequent shingles alone
    must reach the share (a join on the bucket that keeps only pairs whose
    counts allow it).
    """
    outs = members.where("out").select("node").distinct()
    seldom = _tokens(alive).join(holders.where(F.col("c") <= rare), "h")
    # n - ceil(n * percent / 100) + 1 shingles can't all be missed; those that no other component holds come first and meet nobody
    need = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - (F.col("n") - F.col("m"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("c", "h"))
    asked = seldom.join(outs, "node").join(alive.select("node", "m"), "node").withColumn("place", place).where(F.col("place") <= need)
    asked = asked.select(F.col("node").alias("o"), F.col("label").alias("lo"), "h")
    by_shingle = asked.join(seldom.select("node", "label", "h"), "h").where("lo <> label").select(F.least("o", "node").alias("a"), F.greatest("o", "node").alias("b"))
    often = cut(members.where(100 * F.col("f") >= F.col("n") * percent))
    left = often.where("out").select("key", *[F.col(c).alias(f"{c}_o") for c in ("node", "label", "n", "f")])
    common = F.least("f", "f_o")
    may = (F.col("label") != F.col("label_o")) & (100 * common >= percent * (F.col("n") + F.col("n_o") - common)) & (~F.col("out") | (F.col("node_o") < F.col("node")))
    right = often.withColumnRenamed("key", "bucket")
    by_bucket = left.join(right, (F.col("key") == F.col("bucket")) & may).select(F.least("node", "node_o").alias("a"), F.greatest("node", "node_o").alias("b"))
    return by_shingle.unionByName(by_bucket).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, rare: int = RARE, with_rows: bool = True) -> DataFrame:
    """Groups of documents linked by the similarity of their word shingles.

    Documents with equal sets fall together first, so copies meet nobody twice.
    Each distinct set has a SuperMinHash signature of bands * rows positions.
    In the bucket of a band, every member meets the smallest; pairs are verified
    on whole shingle sets, and union-find turns links into components. Where a
    bucket still holds several components, members with too few shingles in
    common with other components go (``_alive``), the rest meet the bucket's most
    central member, and bounds on the shared shingles leave the pairs that may
    yet be links (``_open_pairs``); they are verified too. No pair of a bucket is skipped unless it is in one component
    already or its counts rule a link out. A pair at 75 % shares no bucket with
    probability 5e-6.

    Returns doc_id, n_shingles, component_id, kept and, ``with_rows``, the input
    row as struct ``row``. Null and empty texts, and texts of white space, have
    empty sets: each is its own component and stays. Null ids are larger than
    any other. Of repeated rows with the smallest id, one stays. Long texts are
    hashed piece by piece; columns of ``docs`` with any names stay inside ``row``.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *([F.struct("*").alias("row")] if with_rows else []))
    base = base.withColumn("rk", row_key("doc_id", "text"))
    schema = T.StructType([f for f in base.schema.fields if f.name != "text"]).add("n_shingles", "long").add("set_key", "binary").add("sign", "binary")
    signed = cut(base.mapInArrow(_signed(bands, rows, shingle), schema).withColumn("tag", F.monotonically_increasing_id()))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    classes = signed.where("set_key is not null").groupBy("set_key").agg(F.min_by(F.struct(first.alias("first"), "rk", "n_shingles", "sign"), first).alias("x"))
    classes = cut(classes.select("set_key", F.col("x.first").alias("first"), F.col("x.first.tag").alias("node"), "x.rk", F.col("x.n_shingles").alias("n"), "x.sign"))
    width = rows * 2
    bands_of = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.substring("sign", k * width + 1, F.lit(width))))
    keyed = classes.select("node", F.explode(bands_of).alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).where("size > 1").select("key", "leader")
    members = cut(keyed.join(small(cut(buckets)), "key"))
    wanted = cut(members.select("node").distinct().join(classes.select("node", "rk", "n", F.col("first.doc_id").alias("id")), "node"))
    source = base.select("doc_id", "text", "rk")
    texts = source.join(small(wanted), (source["rk"] == wanted["rk"]) & source["doc_id"].eqNullSafe(wanted["id"])).select("node", "text")
    arrays = texts.mapInArrow(_sets(shingle), "node long, hs array<long>").groupBy("node").agg(F.first("hs").alias("hs"))  # repeated rows give a set twice
    sets = cut(arrays.withColumn("n", F.size("hs").cast("long")))
    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    labels = cut(components(_linked(pairs, sets, percent)))
    left_open = _opened(_labelled(members.select("key", "node"), labels))
    alive, holders = _alive(sets.join(small(cut(left_open.select("node", "label").distinct())), "node"), percent, rare)
    left_open = cut(left_open.select("key", "node", "label").join(alive.select("node", "n", "m", "f"), "node"))
    labels = _merged(labels, _linked(cut(_central_pairs(left_open)), sets, percent))
    left_open = _opened(_labelled(left_open, labels))
    found = _linked(cut(_open_pairs(left_open, cut(_labelled(alive, labels)), holders, percent, rare)), sets, percent)
    labels = _merged(labels, found)
    linked = cut(labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct()).join(classes.select("node", "first"), "node"))
    least = cut(linked.groupBy("label").agg(F.min("first").alias("least")))
    groups = linked.join(small(least), "label").select("node", "least")
    names = classes.join(groups, "node", "left").withColumn("least", F.coalesce("least", "first"))
    names = cut(names.select("set_key", F.col("least.doc_id").alias("component_id"), F.col("least.tag").alias("stays")))
    out = signed.drop("sign", "rk").join(names, "set_key", "left")
    alone = F.col("set_key").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("tag") == F.col("stays"))).alias("kept"), *(["row"] if with_rows else []))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, with_rows=False)
