"""Saved answers, memory layers, vector logs and traces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWER = "struct<question:string,ground_truth:string,prediction:string,retrieved_ids:array<string>,evidence:array<string>,category:int,f1:double,judge_score:int,retrieved_tokens:int>"


def answers(files: DataFrame) -> DataFrame:
    """``files`` (value: JSON text) as answers with their index: records as a map by index or as a list; broken files are empty."""
    head = F.from_json("value", "struct<method:string,conv_id:string,records:string>")
    rows = files.withColumn("h", head).select("h.method", "h.conv_id", F.col("h.records").alias("r"))
    keyed = rows.select("method", "conv_id", F.explode(F.from_json("r", f"map<string,{ANSWER}>")).alias("k", "a")).select("method", "conv_id", F.col("k").cast("int").alias("q_index"), "a.*")
    listed = rows.where(F.col("r").startswith("[")).select("method", "conv_id", F.posexplode(F.from_json("r", f"array<{ANSWER}>")).alias("q_index", "a")).select("method", "conv_id", "q_index", "a.*")
    return keyed.where("q_index is not null").union(listed)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """The answers of files with one JSON document a line."""
    return answers(spark.read.text(path))


def write_layers(layers: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """Each layer as Parquet under ``path``, in directories by a bucket of the conversation.

    Spark deals rows by bucket into tasks of about the advised partition size: small buckets share a task, large ones are split.
    """
    for name, rows in layers.items():
        bucketed = rows.withColumn("conv_bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int"))
        bucketed.hint("rebalance", "conv_bucket").write.mode("overwrite").partitionBy("conv_bucket").parquet(f"{path}/{name}")


def read_layer(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("conv_bucket")


def compacted(log: DataFrame) -> DataFrame:
    """The latest row of each id; rows without vector or metadata are dropped first."""
    rows = log.where(F.col("vector").isNotNull() & F.col("metadata").isNotNull())
    w = Window.partitionBy("id").orderBy(F.desc("seq_id"))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def float32_vector(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats as a vector; null and empty blobs are empty."""
    return blobs.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) else np.empty(0, np.float32))


def vector_metadata(memory_type: Column, memory_id: Column, fields: Column) -> tuple[Column, Column]:
    """The item's key and its metadata without nulls. ``fields``: a map from name to text (lists as JSON)."""
    return F.concat_ws(":", memory_type, memory_id), F.map_filter(fields, lambda k, v: v.isNotNull())


def trace(stages: dict[str, DataFrame], key: str = "q_index") -> DataFrame:
    """One row for each query and stage, with the stage's columns as JSON. Each frame has ``key``."""
    out = None
    for order, (name, rows) in enumerate(stages.items()):
        data = F.to_json(F.struct(*(c for c in rows.columns if c != key)))
        part = rows.select(key, F.lit(order).alias("step_order"), F.lit(name).alias("step"), data.alias("data"))
        out = part if out is None else out.union(part)
    return out


def write_report(table: DataFrame, markdown: DataFrame, path: str) -> None:
    """A report as JSON, CSV with header and Markdown. It has a row for each method, so one file each."""
    table.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    markdown.coalesce(1).sortWithinPartitions("line").select("text").write.mode("overwrite").text(f"{path}/markdown")
