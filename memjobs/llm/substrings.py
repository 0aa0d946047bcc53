"""Removal of long passages that other documents have too, by level-wise doubling.

A window is a run of ``length`` consecutive words (split at ASCII white space). A word is removed if a window that
covers it also starts in a document with a smaller id; windows are judged on the input.

Levels have ``length / 2`` and ``length`` words; at each level only what repeated at the level before is extended to
twice its length, and no level follows the last: a longer repeated run consists of repeated windows of ``length``,
so it couldn't remove other words.

* First level: of the half-length windows only those are kept whose hash is the least among those inside some
  full-length window (about one in thirteen for 50 words). Equal full windows keep the same ones, so no repeat is
  lost. Those that only one document has are dropped.
* Second level: only full windows around surviving ones are hashed, twice with 64 bits, over word hashes of two seeds.

Each task settles what it can by itself before rows are shuffled: of the documents that share a window within a task,
the smallest speaks for all. A window that a third of all documents share thus has a row for each task, not for each
document, in the group that is compared.

Null texts have no words. Documents without an id are never less than others, so they remove and lose nothing. An id
that is repeated with the same text gives the same result on each row; repeated with other texts, its rows share
their removed places. Ids are whole numbers. An empty table gives no rows, texts of
any length are used whole. Columns other than id and text pass through ``remove_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjobs.llm.common import WordHashes, extended, mixed, raw_texts, set_aside, sliced, space_words, stored, table, window_hashes

#: Windows that a task gathers before it settles them; bounds its memory, not the result.
CHUNK = 1_000_000


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """The least or largest of each ``n`` consecutive values."""
    size, out = 1, x
    while size * 2 <= n:
        out = pick(out[: len(out) - size], out[size:])
        size *= 2
    rest = n - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def chosen_windows(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places whose hash is the least of some ``span`` consecutive ones."""
    if len(hashes) < span:
        return np.empty(0, dtype=np.int64)
    least = _sliding(hashes, span, np.minimum)
    padded = np.concatenate([np.zeros(span - 1, dtype=hashes.dtype), least, np.zeros(span - 1, dtype=hashes.dtype)])
    return np.flatnonzero(hashes == _sliding(padded, span, np.maximum))


ROWS = T.StructType(
    [
        T.StructField("h1", T.LongType()),
        T.StructField("h2", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("settled", T.BooleanType()),
    ]
)


def _settle(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, start: np.ndarray, smaller_only: bool) -> pa.RecordBatch:
    """A row for each window and document, with all its places.

    Settled rows need no other task: their window is in another document of this task (in a smaller one, if that is
    asked for). They get keys of their own, so that they don't meet in one group.
    """
    order = np.lexsort((start, doc, h2, h1))
    h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
    n = len(h1)
    new_key = np.ones(n, dtype=bool)
    new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new_row = new_key.copy()
    new_row[1:] |= doc[1:] != doc[:-1]
    rows = np.flatnonzero(new_row)
    first = new_key[rows]
    group = np.cumsum(first) - 1
    settled = ~first
    speaks = first
    if not smaller_only:
        several = np.bincount(group)[group] > 1
        settled = several
    h1, h2 = h1[rows].copy(), h2[rows].copy()
    own = ~speaks
    h1[own], h2[own] = mixed(doc[rows].astype(np.uint64))[own], mixed(start[rows].astype(np.uint64) + h2)[own]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(h1.view(np.int64)),
            pa.array(h2.view(np.int64)),
            pa.array(doc[rows]),
            pa.ListArray.from_arrays(pa.array(np.append(rows, n), pa.int32()), pa.array(start, pa.int32())),
            pa.array(settled),
        ],
        names=[f.name for f in ROWS.fields],
    )


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]], smaller_only: bool) -> Iterator[pa.RecordBatch]:
    """Settle windows chunk by chunk, and hand them on in batches of bounded size."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush():
        if held:
            batch = _settle(*(np.concatenate(c) for c in zip(*held, strict=True)), smaller_only)
            for at in range(0, batch.num_rows, 100_000):
                yield batch.slice(at, 100_000)
            held.clear()

    for h1, h2, doc, start in parts:
        held.append((h1, h2, np.full(len(h1), doc, dtype=np.int64), start))
        count += len(h1)
        if count >= CHUNK:
            yield from flush()
            count = 0
    yield from flush()


def _half_windows(docs: DataFrame, length: int) -> DataFrame:
    half = length // 2

    def parts(batches):
        hashes = WordHashes(150_000)
        for batch in sliced(batches):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch, "text"), strict=True):
                words = space_words(raw)
                if doc is not None and len(words) >= length:
                    g = window_hashes(hashes.of(words), half)
                    at = chosen_windows(g, length - half + 1)
                    yield g[at], np.zeros(len(at), dtype=np.uint64), doc, at

    return docs.mapInArrow(lambda batches: _gathered(parts(batches), smaller_only=False), ROWS)


def _full_windows(suspects: DataFrame, length: int) -> DataFrame:
    """``suspects``: doc_id, text, and the ``places`` of surviving half-length windows."""
    half = length // 2

    def parts(batches):
        hashes, again = WordHashes(100_000), WordHashes(100_000, seed=1)
        for batch in sliced(batches):
            places = batch.column("places")
            for k, (doc, raw) in enumerate(zip(batch.column("doc_id").to_pylist(), raw_texts(batch, "text"), strict=True)):
                words = space_words(raw)
                if len(words) < length:
                    continue
                h, last = hashes.of(words), len(words) - length
                at = np.asarray(places[k].values)
                edge = np.zeros(last + 2, dtype=np.int64)
                np.add.at(edge, np.clip(at - (length - half), 0, last + 1), 1)
                np.add.at(edge, np.clip(at + 1, 0, last + 1), -1)
                start = np.flatnonzero(np.cumsum(edge)[: last + 1] > 0)
                yield window_hashes(h, length)[start], window_hashes(again.of(words), length)[start], doc, start

    return suspects.mapInArrow(lambda batches: _gathered(parts(batches), smaller_only=True), ROWS)


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """doc_id and the sorted ``starts`` of its windows that a document with a smaller id has too."""
    base = docs
    if docs.dtypes != [("doc_id", "bigint"), ("text", "string")]:
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.where("doc_id is not null")
    by_hash = Window.partitionBy("h1", "h2")
    level = _half_windows(base, length)
    level = level.withColumn("others", F.count(F.lit(1)).over(by_hash)).where(F.col("settled") | (F.col("others") > 1))
    places = stored(level.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("places")), "repeated-halves")
    full = _full_windows(base.join(places, "doc_id"), length)
    full = full.withColumn("least", F.min("doc_id").over(by_hash)).where(F.col("settled") | (F.col("least") < F.col("doc_id")))
    return full.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def covered_words(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` words the windows at ``starts`` cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = starts[starts <= n - length]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:n] > 0


def _with_places(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    found = repeated_places(docs, id_col, text_col, length).withColumnRenamed("doc_id", "__at_id").withColumnRenamed("starts", "__starts")
    # without null ids this reads the same shuffled texts as the join in repeated_places does, which Spark then makes once
    known = docs.where(F.col(id_col).isNotNull())
    key = F.col(id_col) if dict(docs.dtypes)[id_col] == "bigint" else F.col(id_col).cast("long")
    rows = known.join(found, key == F.col("__at_id"), "left").drop("__at_id")
    return rows.union(docs.where(F.col(id_col).isNull()).withColumn("__starts", F.lit(None).cast("array<int>")))


def _places(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.empty(0, dtype=np.int64) if x is None else np.asarray(x, dtype=np.int64) for x in batch.column("__starts").to_pylist()]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``docs`` whose texts are the kept words, joined by one space, where words were removed; other texts are unchanged."""
    docs, back = set_aside(docs, ("__starts", "__at_id"))
    rows = _with_places(docs, id_col, text_col, length)
    position = rows.columns.index(text_col)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "__starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(text_col).to_pylist()
            for k, starts in enumerate(_places(batch)):
                if len(starts) and texts[k]:
                    words = space_words(texts[k].encode())
                    gone = covered_words(len(words), starts, length)
                    texts[k] = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
            made = batch.set_column(position, batch.schema.field(position), pa.array(texts, batch.schema.field(position).type))
            yield made.drop_columns(["__starts"])

    return rows.mapInArrow(run, schema).withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str, length: int = 50) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = _with_places(docs, "doc_id", "text", length)

    def compute(batch: pa.RecordBatch):
        n, removed, digests = [], [], []
        for raw, starts in zip(raw_texts(batch, "text"), _places(batch), strict=True):
            words = space_words(raw)
            gone = covered_words(len(words), starts, length) if len(starts) else None
            kept = words if gone is None else [w for w, g in zip(words, gone, strict=True) if not g]
            n.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.array(n, pa.int64())
        yield pa.array(removed, pa.int64())
        yield pa.array(digests, pa.string())

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return extended(rows, compute, fields, ["doc_id"])


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
    SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)
), m AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN m USING (h) WHERE least < doc_id
), word AS (
    SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
