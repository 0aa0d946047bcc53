"""Nested dialogue documents as tables of turns and questions.

A document is ``{"sample_id", "conversation": {"session_<n>": [turns], "session_<n>_date_time": text}, "qa": [questions]}``.
Its session keys are dynamic, so the conversation is read as a map from key to JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjobs.functions.text import session_time

DOCUMENT = "struct<sample_id:string,conversation:map<string,string>,qa:array<string>>"
TURN = "array<struct<speaker:string,dia_id:string,text:string>>"
QUESTION = "struct<question:string,answer:string,evidence:array<string>,category:int>"


def read_documents(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """The documents of JSON files, each a document or a list of them. Broken files and documents are left out; ``first``
    keeps so many of the others in input order: by the file's path, then by the place in its list."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parts = F.from_json("value", "array<string>")
    rows = files.select("file", F.posexplode(F.when(parts.isNotNull(), parts).otherwise(F.array("value"))).alias("position", "document"))
    return parsed(rows, first)


def parsed(rows: DataFrame, first: int | None = None) -> DataFrame:
    """``rows`` (position, document, and the file if there are several) with the parsed fields; malformed documents are skipped."""
    order = [c for c in ("file", "position") if c in rows.columns]
    found = rows.withColumn("d", F.from_json("document", DOCUMENT)).where(F.col("d.conversation").isNotNull())
    found = found.select(*order, F.coalesce("d.sample_id", F.concat(F.lit("conv_"), "position")).alias("conv_id"), "d.conversation", "d.qa")
    return found.orderBy(*order).limit(first) if first is not None else found


def turns(documents: DataFrame) -> DataFrame:
    """One row for each turn: sessions in the order of their numbers, without empty ones; missing fields are empty."""
    each = documents.select("conv_id", "conversation", F.explode("conversation").alias("key", "value")).where(F.col("key").rlike(r"^session_\d+$"))
    number = F.regexp_extract("key", r"(\d+)$", 1).cast("int")
    raw = F.coalesce(F.try_element_at("conversation", F.concat(F.col("key"), F.lit("_date_time"))), F.lit(""))
    rows = each.select("conv_id", number.alias("session_num"), raw.alias("ts_raw"), F.posexplode(F.from_json("value", TURN)).alias("place", "t"))
    text = [F.coalesce(F.col(f"t.{c}"), F.lit("")).alias(c) for c in ("dia_id", "speaker", "text")]
    order = F.col("session_num").cast("long") * 1_000_000 + F.col("place")
    return rows.select("conv_id", "session_num", order.alias("turn_ord"), *text, "ts_raw", session_time(F.col("ts_raw")).alias("ts"))


def questions(documents: DataFrame) -> DataFrame:
    """One row for each question: the answer as text, category 1 and no evidence where missing."""
    rows = documents.select("conv_id", F.posexplode("qa").alias("q_index", "raw")).withColumn("q", F.from_json("raw", QUESTION))
    return rows.select(
        "conv_id", "q_index", F.coalesce("q.question", F.lit("")).alias("question"), F.coalesce("q.answer", F.lit("")).alias("answer"),
        F.coalesce("q.evidence", F.array().cast("array<string>")).alias("evidence"), F.coalesce("q.category", F.lit(1)).alias("category"),
    )
