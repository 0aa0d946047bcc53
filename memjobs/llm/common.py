"""Helpers that the training-data operators share.

Word splitting works on UTF-8 bytes: every separator of the contracts is an ASCII character, and no
byte of a multi-byte character is ASCII, so splitting the bytes equals splitting the text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z; all other ASCII but digits and letters to a space.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: A-Z to a-z and nothing else.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, where all are one process, one is made if none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, so a lost executor costs no rerun."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def space_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return raw.split()


def alnum_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return raw.translate(_ALNUM).split()


def lower_ascii(raw: bytes) -> bytes:
    return raw.translate(_LOWER)


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before; forgets all when it grows past ``limit``."""

    def __init__(self, limit: int = 400_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word, self.seed)
        return found

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all windows of ``n`` consecutive word hashes, by repeated doubling of the window length."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out, done, part, size, left = None, 0, h, 1, n
    while left:
        if left & 1:
            piece = part[done : done + len(h) - n + 1]
            out = mixed(piece + np.uint64(size)) if out is None else mixed(out * np.uint64(factor) + piece)
            done += size
        left >>= 1
        if left:
            part = mixed(part[: len(part) - size] * np.uint64(factor) + part[size:] + np.uint64(1))
            size *= 2
    return out


def extended(
    df: DataFrame,
    compute: Callable[[pa.RecordBatch], Iterable[pa.Array]],
    fields: Sequence[T.StructField],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with the columns that ``compute`` makes of each Arrow batch; one output row for each input row.

    A column of ``df`` with the name of a computed one is replaced. ``keep`` names the input columns to
    return (all by default), so that long texts needn't travel back.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = list(compute(batch))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), *made], names=[f.name for f in schema.fields]
            )

    return df.mapInArrow(run, schema)


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` whose columns of these names have unused ones, and by those the names to give back in the end."""
    wanted, used = {n.lower() for n in names}, {c.lower() for c in df.columns}
    back = {}
    for c in df.columns:
        if c.lower() in wanted:
            free = next(f"__aside{k}" for k in range(len(used) + 1) if f"__aside{k}" not in used)
            used.add(free)
            back[free] = c
    return df.withColumnsRenamed({c: free for free, c in back.items()}), back


def crc_fold(id_col: str, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int, seed: int = 7) -> DataFrame:
    """At most ``max_rows`` ids with a 0/1 label, chosen by a hash of the id; ids labelled twice get the larger label.

    The result is bounded by ``max_rows``, so it may be broadcast.
    """
    return (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.max(label_col).cast("int").alias(label_col))
        .orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)
        .limit(max_rows)
    )
