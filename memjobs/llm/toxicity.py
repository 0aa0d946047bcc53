"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

``fit_toxicity`` takes a bounded sample of labelled rows (``max_rows``, part of the interface), splits it by a
hash of the text (so copies stay together) and learns in turn

1. a lexicon of words and word beginnings that toxic documents have and others hardly have,
2. boosted trees over lexicon densities, second-person proximity, capitals, punctuation and obfuscation rates,
3. an isotonic map from their margin to a probability.

``score_toxicity`` then scores every row of any table in one pass, batch by batch, without a shuffle.

Null and empty texts have no words; they get the score of an all-zero feature row. Rows whose label is null
or not 0/1 aren't learned from; with no labelled rows at all every score is 0. Repeated rows are scored alike; equal
margins get equal scores. An id with several labels has the larger one. A row without an id is in no fold
(``held_out`` null). An empty table gives no rows. Texts of any
length are read whole, words of any length can enter the lexicon. Other columns pass through; one named ``score`` or
``predicted`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjobs.llm.boosting import Boosted, Isotonic, fit_boosted, fit_isotonic
from memjobs.llm.common import crc_fold, extended, labelled_sample, raw_texts, sliced, stored, table

#: Second-person words of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie ihnen "
    "tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro vuestra".split()
)
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("@4310!|57$8+", "aaeioiistsbt")

_WORD = re.compile(r"[^\W_]+")
#: Starts where a run of letters starts: a search from within a run finds nothing more, and makes long runs quadratic.
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[@$!*|+.\-_0-9][^\W_]+)+")
_STEMS = (4, 5, 6, 7, 8)
N_FEATURES = 16


@dataclass
class ToxicityModel:
    words: dict[str, float]
    stems: frozenset[str]
    trees: Boosted
    calibration: Isotonic

    def score(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration(self.trees.probability(features)), 0.0, 1.0)


class _Codes(dict):
    """Of a word: 1 if in the lexicon, 2 if it begins like lexicon words, 4 if second person. Kept for words seen before."""

    def __reduce__(self):  # travels without what it has kept
        return _Codes, (self.words, self.stems)

    def __init__(self, words: dict[str, float], stems: frozenset[str]):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = (w in self.words) | 2 * any(w[:k] in self.stems for k in _STEMS if len(w) >= k) | 4 * (w in SECOND_PERSON)
        self[w] = found
        return found


def features(raws: list[bytes], codes: _Codes) -> np.ndarray:
    """A row of ``N_FEATURES`` numbers for each text."""
    words = codes.words
    out = np.zeros((len(raws), N_FEATURES))
    for row, raw in zip(out, raws, strict=True):
        if not raw:
            continue
        low = raw.decode("utf-8", "replace").lower()
        found = _WORD.findall(low)
        n = len(found)
        code = np.fromiter(map(codes.__getitem__, found), dtype=np.int8, count=n)
        hits, stem, you = (np.flatnonzero(code & bit) for bit in (1, 2, 4))
        weights = [words[found[i]] for i in hits]
        size, letters = max(n, 1), np.frombuffer(raw, dtype=np.uint8)
        near = 0
        if len(you) and len(hits) + len(stem):
            marks = np.union1d(hits, stem)
            at = np.searchsorted(you, marks)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - marks), np.abs(you[np.maximum(at - 1, 0)] - marks))
            near = int((gap <= 5).sum())
        hidden = 0
        for token in _DISGUISED.findall(low):
            plain = token.translate(DISGUISE)
            bare = re.sub(r"[\W_]+", "", plain)
            if not any(part in words for part in _WORD.findall(token)) and (plain in words or bare in words):
                hidden += 1
        upper = int(((letters >= 65) & (letters <= 90)).sum())
        small = int(((letters >= 97) & (letters <= 122)).sum())
        triple = int(((letters[2:] == letters[1:-1]) & (letters[1:-1] == letters[:-2]) & (letters[2:] > 64)).sum())
        row[:] = (
            np.log1p(n),
            len(hits) / size,
            np.log1p(len(hits)),
            len({found[i] for i in hits}),
            max(weights, default=0.0),
            sum(weights) / size,
            len(stem) / size,
            np.log1p(len(stem)),
            len({found[i] for i in stem}),
            len(you) / size,
            near / size,
            upper / max(upper + small, 1),
            raw.count(b"!") / size,
            (raw.count(b"?") + raw.count(b"*") + raw.count(b"#")) / size,
            hidden / size,
            triple / size,
        )
    return out


def _word_counts(train: DataFrame) -> DataFrame:
    """word, toxic and clean: in how many documents with either label the word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            clean, toxic = ([c[y] for c in counts.values()] for y in (0, 1))
            made = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "clean": pa.array(clean, pa.int64()), "toxic": pa.array(toxic, pa.int64())})
            counts.clear()
            return made

        for batch in sliced(batches):
            for raw, y in zip(raw_texts(batch, "text"), batch.column("y").to_pylist(), strict=True):
                for w in set(_WORD.findall(raw.decode("utf-8", "replace").lower())):
                    counts.setdefault(w, [0, 0])[y] += 1
            if len(counts) > 300_000:
                yield flush()
        yield flush()

    rows = train.select("text", "y").mapInArrow(run, "word string, clean long, toxic long")
    return rows.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train_when=None,
    max_rows: int = 16_000,
    least_docs: int = 3,
) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled documents. ``train_when``: a condition on the ids that may be learned from."""
    if train_when is not None:
        labels = labels.where(train_when)
    sample = labelled_sample(labels.select(id_col, label_col), id_col, label_col, max_rows)
    train = stored(
        docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(sample), id_col)
        .select("text", F.col(label_col).alias("y"), F.pmod(F.xxhash64("text"), F.lit(10)).cast("int").alias("part")),
        "toxicity-train",
    )
    counts = stored(_word_counts(train.where("part < 5")), "toxicity-words")
    total = train.where("part < 5").agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n_toxic, n_clean = float(total[0] or 0) + 1, float(total[1] or 0) + 1

    def odds(t, c):
        return F.log((t + 0.2) / n_toxic) - F.log((c + 0.2) / n_clean)

    strong = counts.where(F.col("toxic") >= least_docs).withColumn("w", odds(F.col("toxic"), F.col("clean")))
    words = {r[0]: float(r[1]) for r in strong.where("w > 2.5").select("word", "w").collect()}
    starts = counts.select(
        F.explode(F.array(*(F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in _STEMS))).alias("stem"),
        "toxic",
        "clean",
    ).where(F.col("stem").isNotNull())
    found = (
        starts.groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum(F.when(F.col("toxic") > 0, 1)).alias("kinds"))
        .where((F.col("toxic") >= 4 * least_docs) & (F.col("kinds") >= 3))
        .where(odds(F.col("toxic"), F.col("clean")) > 3.0)
    )
    stems = frozenset(r[0] for r in found.select("stem").collect())

    codes = _Codes(words, stems)

    def compute(batch: pa.RecordBatch):
        x = features(raw_texts(batch, "text"), codes)
        yield pa.array(list(x), pa.list_(pa.float64()))

    rows = (
        extended(train.where("part >= 5"), compute, [T.StructField("x", T.ArrayType(T.DoubleType()))], ["y", "part"])
        .toPandas()
        .sort_values(["part", "y"], kind="stable")
    )
    x = np.array(rows["x"].tolist()).reshape(-1, N_FEATURES)
    order = np.lexsort([*x.T, rows["y"].to_numpy()]) if len(x) else np.arange(0)
    x, y, part = x[order], rows["y"].to_numpy()[order], rows["part"].to_numpy()[order]
    trees = fit_boosted(x[part < 8], y[part < 8])
    if (part >= 8).sum() >= 40 and 0 < y[part >= 8].sum() < (part >= 8).sum():
        calibration = fit_isotonic(trees.probability(x[part >= 8]), y[part >= 8])
    else:
        calibration = Isotonic(np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return ToxicityModel(words, stems, trees, calibration)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` up)."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    codes = _Codes(model.words, model.stems)

    def compute(batch: pa.RecordBatch):
        score = np.round(model.score(features(raw_texts(batch, text_col), codes)), 6)
        yield pa.array(score, pa.float64())
        yield pa.array((score >= threshold).astype(np.int32), pa.int32())

    return extended(docs, compute, fields, keep)


def fold(id_col: str = "doc_id"):
    """The held-out fold is 0."""
    return crc_fold(id_col, 5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), train_when=fold() != 0)
    scored = score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")
