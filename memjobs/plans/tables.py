"""Adapters: the given tables as turns, topic records, memories, queries and answers.

Topic records need a language model; here a rule on the text stands in for it, the same in Spark and in SQL.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjobs.functions import text as X

WORD = r"[^ \t\n\r\f\x0b]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share. In local mode, where all are one process, one is made if none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/core-{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read again: what several later steps read is made once."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def query_id():
    """The number of a turn that asks: its conversation and its place in it."""
    return (F.col("conv_id") * 1_000_000 + F.col("turn_ord")).alias("query_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.lit(1).alias("session_num"), F.col("turn").cast("int").alias("turn_ord"),
        F.concat(F.lit("D1:"), (F.col("turn") + 1).cast("string")).alias("dia_id"), F.col("role").alias("speaker"), "text",
    )


TURNS = "SELECT conv_id, 1 AS session_num, CAST(turn AS INT) AS turn_ord, 'D1:' || (turn + 1) AS dia_id, role AS speaker, text FROM conversations"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of(turns(spark, sf_dir))


def records_of(rows: DataFrame) -> DataFrame:
    """One topic record for each turn."""
    words = X.tokens_of(F.col("text"))
    return rows.select(
        "conv_id", "turn_ord", F.lit(0).alias("rec_ord"), "dia_id", "speaker",
        F.concat(F.lit("t"), (F.length("text") % 3).cast("string")).alias("topic"),
        F.concat(F.lit("e"), (F.col("conv_id") % 10).cast("string")).alias("core_entity"),
        F.concat(F.lit("i"), (F.size(words) % 2).cast("string"), F.lit(" "), F.element_at(F.array(F.lit("plan"), F.lit("ask"), F.lit("tell")), F.length("text") % 3 + 1)).alias("intent"),
        F.transform(F.slice(words, 1, 3), F.lower).alias("entities"),
        ((F.length("text") % 100) / 100).alias("confidence"),
        F.lit("rule").alias("reasoning"), F.col("text").alias("user_input"), F.lit("").alias("assistant_output"),
    )


RECORDS = f"""SELECT conv_id, CAST(turn AS INT) AS turn_ord, 0 AS rec_ord, 'D1:' || (turn + 1) AS dia_id, role AS speaker,
    't' || (length(text) % 3) AS topic, 'e' || (conv_id % 10) AS core_entity,
    'i' || (len(regexp_extract_all(text, '{WORD}')) % 2) || ' ' || (['plan', 'ask', 'tell'])[length(text) % 3 + 1] AS intent,
    list_transform(list_slice(regexp_extract_all(text, '{WORD}'), 1, 3), lambda w: lower(w)) AS entities,
    CAST(length(text) % 100 AS DOUBLE) / 100 AS confidence, text AS user_input, '' AS assistant_output
    FROM conversations"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))


QUERY_VECTORS = "SELECT vec_id AS query_id, embedding AS query, label AS query_label FROM embeddings WHERE vec_id % 100 = 0"
