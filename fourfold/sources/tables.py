"""Reading, writing and cutting lineage; parameters and states as JSON."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: written tables need a folder that all executors share")
    return (told or "file:///tmp/checkpoints/fourfold").rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so that lost executors cost a reread only."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, path: str, kind: str = "auto", **options: Any) -> DataFrame:
    """parquet, json (also .json.gz), csv or orc; auto goes by the name's ending."""
    if kind == "auto":
        name = path.lower().removesuffix(".gz")
        kind = next((k for k in ("json", "csv", "orc") if name.endswith(f".{k}")), "parquet")
    return spark.read.options(**options).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists", **options: Any) -> None:
    out = df.write.mode(mode).options(**options).format(kind)
    (out.partitionBy(*by) if by else out).save(path)


def write_batch(frames: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """A folder with one table for each name and a manifest of names and schemas."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        write(df, f"{path}/{name}", kind)
    spark.createDataFrame([(n, kind, df.schema.json()) for n, df in frames.items()], "name string, kind string, schema string").coalesce(1).write.json(f"{path}/_manifest")


def read_batch(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    from pyspark.sql.types import StructType

    rows = spark.read.schema("name string, kind string, schema string").json(f"{path}/_manifest").collect()
    return {r.name: spark.read.schema(StructType.fromJson(json.loads(r.schema))).format(r.kind).load(f"{path}/{r.name}") for r in rows}


def save_params(spark: SparkSession, path: str, params: dict[str, Any], version: str = "1") -> None:
    """Fitted numbers as one JSON row; no code is stored, so loading runs none."""
    spark.createDataFrame([(version, json.dumps(params, sort_keys=True))], "version string, params string").coalesce(1).write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str, version: str = "1") -> dict[str, Any]:
    row = spark.read.schema("version string, params string").json(path).first()
    if row is None or row.version != version:
        raise ValueError(f"parameters at {path} have version {row and row.version}, not {version}")
    return json.loads(row.params)


def state_json(s: str | Column) -> Column:
    from fourfold.functions import state as st

    return F.to_json(F.struct(F.lit("state").alias("type"), st.i_bit(s).alias("i"), st.q_bit(s).alias("q")))


def state_from_json(text: str | Column) -> Column:
    got = F.from_json(F.col(text) if isinstance(text, str) else text, "type string, i tinyint, q tinyint")
    return (got["i"] * 2 + got["q"]).cast("tinyint")


def nested_json(a: str | Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.to_json(F.struct(F.lit("nested").alias("type"), a.alias("levels")))


def nested_from_json(text: str | Column) -> Column:
    return F.from_json(F.col(text) if isinstance(text, str) else text, "type string, levels array<tinyint>")["levels"]


def channels_json(m: str | Column) -> Column:
    m = F.col(m) if isinstance(m, str) else m
    return F.to_json(F.struct(F.lit("channels").alias("type"), m.alias("channels")))


def channels_from_json(text: str | Column) -> Column:
    return F.from_json(F.col(text) if isinstance(text, str) else text, "type string, channels map<string,tinyint>")["channels"]
