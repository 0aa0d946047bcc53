"""A deterministic signed hashing embedder, as a plain function and as a Spark job that embeds each text once."""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memjobs.functions.text import bound

DIMENSIONS = 128
#: Adds the vector of a text column: (rows, text column, name of the vector) to rows.
Embed = Callable[[DataFrame, str, str], DataFrame]
_TOKEN = re.compile(r"[一-鿿]|[a-zA-Z0-9_]+")


class HashingEmbedder:
    """Each token adds or subtracts 1 in the bucket of its hash; the sum is scaled to length 1 (no tokens: all zero)."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.known: dict[str, tuple[int, float]] = {}

    def place(self, token: str) -> tuple[int, float]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
            found = self.known[token] = int.from_bytes(digest[:4], "big") % self.dimensions, 1.0 if digest[4] % 2 == 0 else -1.0
        return found

    def token_sum(self, text: str | None) -> np.ndarray:
        """The sum before scaling. It is whole, and that of texts joined by other than word characters is the sum of theirs."""
        out = np.zeros(self.dimensions)
        for token in _TOKEN.findall(text or ""):
            bucket, sign = self.place(token.lower())
            out[bucket] += sign
        return out

    @staticmethod
    def scaled(total: np.ndarray) -> np.ndarray:
        norm = np.sqrt((total**2).sum())
        return total / norm if norm else total

    def __call__(self, text: str | None) -> np.ndarray:
        return self.scaled(self.token_sum(text))


def embed_column(dimensions: int = DIMENSIONS):
    """A pandas UDF from text to vector."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        embedder = HashingEmbedder(dimensions)
        return texts.map(lambda t: embedder(t).astype(np.float32))

    return embed


def embed_once(rows: DataFrame, text_col: str, out_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """``rows`` with the vector of each text, computed once for each distinct text."""
    vectors = rows.select(F.col(text_col).alias("__text")).where("__text is not null").distinct().withColumn(out_col, embed_column(dimensions)("__text"))
    return rows.join(vectors, rows[text_col] == F.col("__text"), "left").drop("__text")


def hit_rate(rows: DataFrame, text_col: str) -> DataFrame:
    """How often a text was seen before: 1 - distinct / all."""
    return rows.agg(F.count(text_col).alias("n_texts"), F.countDistinct(text_col).alias("n_distinct")).withColumn(
        "hit_rate", F.round(F.when(F.col("n_texts") > 0, 1 - F.col("n_distinct") / F.col("n_texts")).otherwise(0.0), 6)
    )


def letter_counts(text: Column) -> Column:
    """How often each of the letters a to z stands in a text, in either case; null for null. No Python is called."""
    def counts(low: Column) -> Column:
        return F.transform(F.sequence(F.lit(97), F.lit(122)), lambda c: (F.length(low) - F.length(F.replace(low, F.char(c), F.lit("")))).cast("float"))

    return F.when(text.isNotNull(), bound(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), counts))


def embed_letters(rows: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
    """``rows`` with letter counts as vectors: a plain embedder whose results can be computed anew in SQL."""
    return rows.withColumn(out_col, letter_counts(F.col(text_col)))
