"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
personal data is masked, and the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
``documents``. ``run`` writes every stage's rows to the shared folder and reads them again, so an executor that is lost
costs the current stage only. Models are fitted on the stage's own input (labels come from the tables).

Null texts are empty: never toxic, without duplicates, contamination or personal data, and encoded as no ids. Rows without
an id stay to the end. Rows that repeat an id are one document to the second stage, which keeps one of them. Columns
besides the contract's come out of all stages but the last as they were, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjobs.llm import decontamination, jaccard, pii, sentencepiece, toxicity
from memjobs.llm.common import set_aside, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), train_when=toxicity.fold() != 0)
    rows, back = set_aside(docs, ("score", "predicted"))
    return toxicity.score_toxicity(rows, model).where("predicted = 0").drop("score", "predicted").withColumnsRenamed(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of documents with a 5-gram similarity of at least 0.75."""
    return jaccard.keep_one(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in windows of benchmark items."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked, and their new lengths."""
    masked = pii.redact(docs, pii.fit_pii(docs))
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", size).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of its ids, and whether decoding gives the text back."""
    model = sentencepiece.load_model(sentencepiece.DEFAULT_MODEL)
    return sentencepiece.encode_digest(docs.select("doc_id", "text"), model, keep=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("sentencepiece", encode),
]

#: The stages' models can't be expressed in SQL; tests/llm compares them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
