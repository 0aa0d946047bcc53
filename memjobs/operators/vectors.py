"""Vector search: cosine, exact top-k in blocks, scoped top-k, nearest above a threshold, approximate neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries and items that are multiplied at once.
BLOCK, SLICE = 2048, 4096
#: Items of a part, where the queries are too many to send to every task; of one parent, where items are searched by parent.
PART, SCOPE_PART = 1 << 18, 1 << 14
#: Similarities to centres that a block of queries holds; numbers of the query vectors of a block and codes of a part, where an index is searched.
CENTRE_SCORES, ASKED_VALUES, CODE_PART = 1 << 23, 1 << 20, 1 << 16
#: Decimals of a similarity.
DIGITS = 12


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either vector is zero."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - _dot(a, b) / norms)


def similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cosine_distance(a, b)))


def ranked(pairs: DataFrame, k: int, query_col: str = "query_id", id_col: str = "id") -> DataFrame:
    """The first ``k`` of each query by similarity, then id, with ``rank``."""
    w = Window.partitionBy(query_col).orderBy(F.desc("similarity"), id_col)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(
    queries: DataFrame, items: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query", item_id: str = "id", item_vector: str = "embedding",
    same: tuple[str, str] | None = None, least: float | None = None, values: int = 1 << 22, digits: int = DIGITS,
) -> DataFrame:
    """query_id, id, similarity, rank: exact nearest items. ``same``: a query column and an item column that must be equal.

    Queries of at most ``values`` numbers in all, which are counted first, are sent to the tasks, and the items aren't
    shuffled. More of them are dealt into blocks of about that size and the items into parts of about ``PART`` rows; each
    pair of a block and a part is streamed from a sorted partition, so that memory holds one block. Either way a task keeps
    its own first ``k``, so k rows for each query and task are shuffled, whatever the number of items. A condition is
    applied before the ranking. A zero vector has similarity 0, a null one or one with a null number isn't compared.
    Similarities are rounded to ``digits`` before the ranking, so that what is equal when shown goes by id.
    """
    scope = [F.col(c).cast("string").alias("s") for c in same] if same else [F.lit(None).cast("string").alias("s")] * 2
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vector).cast("array<float>").alias("v"), scope[0]).where("v is not null")
    pool = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_vector).cast("array<float>").alias("v"), scope[1]).where("v is not null")
    if same:  # null equals nothing
        asked, pool = asked.where("s is not null"), pool.where("s is not null")
    size = asked.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]
    out = "query_id long, id long, similarity double"
    if size <= values:
        block = items.sparkSession.sparkContext.broadcast(asked.toArrow().combine_chunks().to_batches())
        return ranked(pool.mapInArrow(_against(block, k, bool(same), least, digits), out), k)
    parts, blocks = -(-pool.count() // PART), -(-size // values)
    if not parts:
        return ranked(pool.sparkSession.createDataFrame([], out), k)
    left = asked.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "*")
    right = pool.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "*")
    pairs = left.union(right).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    return ranked(pairs.mapInArrow(_pairwise(lambda q: _Nearest(q, k, bool(same), least, digits)), out), k)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m**2).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of an array column, one a row."""
    sizes = np.asarray(column.value_lengths())
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError("the vectors have unequal lengths")
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1 if len(sizes) and sizes[0] else 0))


def _ids(batch: pa.RecordBatch, name: str = "id") -> np.ndarray:
    """Whole numbers or texts, in an array that sorts them as Spark does."""
    column = batch.column(name)
    return np.array(column.to_pylist(), dtype=np.str_) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else np.asarray(column, dtype=np.int64)


def _once(items: pa.RecordBatch, by: tuple[str, ...] = ("s", "v")) -> pa.RecordBatch:
    """Without repeats of an id with the same vector and scope, which would take the place of others."""
    ids = items.column("id").to_pylist()
    if len(set(ids)) == len(ids):
        return items
    rows = zip(ids, *([tuple(x) if isinstance(x, list) else x for x in items.column(c).to_pylist()] for c in by), strict=True)
    return items.take(list({row: k for k, row in reversed(list(enumerate(rows)))}.values())[::-1])


class _Nearest:
    """The first ``k`` items of each of some queries, by similarity and then id, of all items added so far."""

    def __init__(self, asked: pa.RecordBatch, k: int, scoped: bool, least: float | None, digits: int):
        self.k, self.scoped, self.digits = k, scoped, digits
        self.ids, self.matrix = _ids(asked, "q" if "q" in asked.schema.names else "id"), _matrix(asked.column("v"))
        self.scopes = np.array(asked.column("s").to_pylist(), dtype=object) if scoped else None
        self.row, self.item, self.score = np.empty(0, np.int64), np.empty(0, _ids(asked.slice(0, 0)).dtype), np.empty(0)
        self.floor = np.full(len(self.ids), least or 0.0)

    def add(self, items: pa.RecordBatch) -> None:
        items = _once(items)
        score = np.round(np.clip(self.matrix @ _matrix(items.column("v")).T, 0.0, 1.0), self.digits)
        if self.scoped:
            score[self.scopes[:, None] != np.array(items.column("s").to_pylist(), dtype=object)[None, :]] = -1.0
        np.nan_to_num(score, copy=False, nan=-1.0)
        k = min(self.k, score.shape[1])
        row, at = np.nonzero(score >= np.maximum(self.floor, np.partition(score, -k, axis=1)[:, -k])[:, None])
        self.keep(row, _ids(items)[at], score[row, at])

    def keep(self, row: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        row, item, score = (np.concatenate(c) for c in ((self.row, row), (self.item, item), (self.score, score)))
        order = np.lexsort((item, -score, row))
        again = np.zeros(len(order), dtype=bool)  # a repeated item takes one place
        again[1:] = (row[order[1:]] == row[order[:-1]]) & (item[order[1:]] == item[order[:-1]]) & (score[order[1:]] == score[order[:-1]])
        order = order[~again]
        order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < self.k]
        self.row, self.item, self.score = row[order], item[order], score[order]
        counts = np.bincount(self.row, minlength=len(self.ids))
        full = counts == self.k
        self.floor[full] = self.score[(np.cumsum(counts) - 1)[full]]

    def found(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.item), pa.array(self.score)], names=["query_id", "id", "similarity"])


def every_pair(
    queries: DataFrame, items: DataFrame, same: tuple[str, str], query_id: str = "query_id", query_vector: str = "query", item_id: str = "id", item_vector: str = "embedding", values: int = 1 << 22,
) -> DataFrame:
    """query_id, id, similarity of every query and item whose ``same`` columns are equal, as ``similarity`` gives it.

    Query vectors of at most ``values`` numbers in all are sent to the tasks and multiplied with the items in blocks; the items
    aren't shuffled. More of them, and vectors that are null, not finite or of another length, are joined row by row.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<float>").alias("v"), F.col(same[0]).cast("string").alias("s")).where("s is not null")
    pool = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_vector).cast("array<float>").alias("w"), F.col(same[1]).cast("string").alias("s")).where("s is not null")
    size, width = asked.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, "s").select(F.col("q").alias("query_id"), F.col("i").alias("id"), similarity(F.col("v"), F.col("w")).alias("similarity"))

    if size > values:
        return joined(asked, pool)

    def plain(v: str) -> Column:
        odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return F.coalesce((F.size(v) == width) & ~odd, F.lit(False))

    block = queries.sparkSession.sparkContext.broadcast(asked.where(plain("v")).toArrow().combine_chunks().to_batches())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_scope: dict[str, list] = {}
        for b in block.value:
            ids, unit, scopes = _ids(b, "q"), _matrix(b.column("v")), np.array(b.column("s").to_pylist(), dtype=object)
            for s in set(scopes):
                by_scope.setdefault(s, []).extend((ids[scopes == s][at : at + BLOCK], unit[scopes == s][at : at + BLOCK]) for at in range(0, int((scopes == s).sum()), BLOCK))
        for batch in batches:
            ids, unit, scopes = _ids(batch, "i"), _matrix(batch.column("w")), np.array(batch.column("s").to_pylist(), dtype=object)
            for s in set(scopes) & set(by_scope):
                for at in range(0, int((scopes == s).sum()), 64):
                    own, near = ids[scopes == s][at : at + 64], unit[scopes == s][at : at + 64]
                    for asking, vectors in by_scope[s]:
                        score = np.clip(near @ vectors.T, 0.0, 1.0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.tile(asking, len(own))), pa.array(np.repeat(own, len(asking))), pa.array(score.ravel())], names=["query_id", "id", "similarity"])

    found = pool.where(plain("w")).mapInArrow(run, "query_id long, id long, similarity double")
    return found.union(joined(asked, pool.where(~plain("w")))).union(joined(asked.where(~plain("v")), pool.where(plain("w"))))


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _against(block, k: int, scoped: bool, least: float | None, digits: int):
    """Compares the items of a task with the queries that were sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [_Nearest(b, k, scoped, least, digits) for whole in block.value for b in _slices(whole, BLOCK)]
        for batch in batches:
            for part in _slices(batch, SLICE):
                for n in near:
                    n.add(part)
        for n in near:
            yield from n.found()

    return run


def _pairwise(asking: Callable[[pa.RecordBatch], _Nearest | _Reach]):
    """Compares, for each block and part, the queries, which come first, with the items behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, near = None, []
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("block", "part", "kind")], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                if key != tuple(keys[a, :2]):
                    for n in near:
                        yield from n.found()
                    key, near = tuple(keys[a, :2]), []
                same = batch.slice(a, b - a)
                if keys[a, 2] == 0:
                    near += [asking(q) for q in _slices(same, BLOCK)]
                    continue
                for part in _slices(same, SLICE):
                    for n in near:
                        n.add(part)
        for n in near:
            yield from n.found()

    return run


def scoped_top_k(queries: DataFrame, scope: DataFrame, items: DataFrame, k: int, parent: str, block: int = BLOCK, part: int = SCOPE_PART, digits: int = DIGITS) -> DataFrame:
    """Nearest items among the children of a query's allowed parents: query_id, id, similarity, rank.

    ``queries`` (query_id, query), ``scope`` (query_id, parent), ``items`` (id, parent, embedding). An empty scope gives
    no rows; ``k`` holds for the whole scope. Only children of allowed parents are compared, and no row with a pair of
    vectors is made: the items of a parent that has more than ``part`` of them are dealt into parts, its queries beyond
    ``block`` into blocks, and a task streams each part past each block and hands on ``k`` rows a query. A hot parent is
    thus spread over tasks, and a task holds one block. An item that several allowed parents have counts once.
    """
    wide = {"q": queries.schema["query_id"].dataType, "id": items.schema["id"].dataType}
    wide = {c: "string" if isinstance(t, T.StringType) else "long" for c, t in wide.items()}
    allowed = scope.select("query_id", F.col(parent).cast("string").alias("s")).where("s is not null").distinct()
    asked = queries.select("query_id", F.col("query").cast("array<float>").alias("v")).where("v is not null").join(allowed, "query_id").withColumnRenamed("query_id", "of")
    pool = items.select(F.col("id").alias("of"), F.col("embedding").cast("array<float>").alias("v"), F.col(parent).cast("string").alias("s")).where("v is not null and s is not null")

    def large(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy("s").agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1)

    # only parents with several parts or blocks are listed, at most one for each ``part`` items or ``block`` queries
    many = large(items.select(F.col(parent).cast("string").alias("s")), part, "parts").join(large(allowed, block, "blocks"), "s", "full_outer")

    def dealt(rows: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        """Each row to its own block or part, and to all of the other side's."""
        sized = rows.join(many, "s", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("parts", "blocks")})
        sized = sized.withColumn(f"in_{own}", F.pmod(F.xxhash64("of"), F.col(own)).cast("int")).withColumn(f"in_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        ids = [F.col("of").cast(t).alias(c) if (c == "q") == (kind == 0) else F.lit(None).cast(t).alias(c) for c, t in wide.items()]
        return sized.select(F.xxhash64("s", "in_blocks").alias("block"), F.col("in_parts").alias("part"), F.lit(kind).alias("kind"), *ids, "v", "s")

    both = dealt(asked, "blocks", "parts", 0).union(dealt(pool.join(allowed.select("s").distinct(), "s", "left_semi"), "parts", "blocks", 1))
    met = both.repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    found = met.mapInArrow(_pairwise(lambda q: _Nearest(q, k, True, None, digits)), f"query_id {wide['q']}, id {wide['id']}, similarity double").distinct()
    return ranked(found, k)


def nearest_above(queries: DataFrame, items: DataFrame, least: float = 0.82, k: int = 5, **names) -> DataFrame:
    """The nearest of the first ``k`` items, if it is similar enough."""
    return top_k(queries, items, k, **names).where((F.col("similarity") >= least) & (F.col("rank") == 1))


@dataclass
class InvertedFile:
    """An index for approximate search. ``cells`` (cell, coarse, centre), ``codes`` (id, cell, code, scale): all items, a byte a number."""

    coarse: np.ndarray
    cells: DataFrame
    codes: DataFrame
    n_cells: int
    n_items: int


#: Rows that fine centres are fitted on, for each of them, and the most fine centres of a coarse one.
FIT_ROWS, MOST_FINE = 64, 1024


def build_index(
    items: DataFrame, rows_per_cell: int = 1024, sample_rows: int = 20_000, most_coarse: int = 256, seed: int = 5, step: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> InvertedFile:
    """Cells in two levels, as many as the items need, and the residuals of all items to their cell's centre in 8 bits a number.

    The number of cells grows with the items: about one for ``rows_per_cell`` of them, its root (``most_coarse`` at most) at
    the first level. Coarse centres are fitted on ``sample_rows`` rows chosen by a hash of the id and sent to the tasks; the
    fine centres of each coarse cell are fitted in a task of their own, on about ``FIT_ROWS`` of its rows for each. Every item
    goes to the nearest fine centre of its nearest coarse one: a search by parent, so hot cells are spread. ``items``
    (id, embedding); null vectors aren't indexed. ``step`` may write what is read several times and return it as read again.
    """
    v = F.col("embedding").cast("array<float>")
    pool = items.select(F.col("id").cast("long").alias("id"), v.alias("v")).where("v is not null")
    n = pool.count()
    sample = [r["v"] for r in pool.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).select("v").collect()]
    total = max(1, -(-n // rows_per_cell))
    coarse = _centres(_unit(np.array(sample, dtype=np.float64).reshape(len(sample), -1 if sample else 1)), min(most_coarse, math.ceil(math.sqrt(total))), seed)
    placed = step(pool.withColumn("coarse", _nearest_centres(pool, coarse, 1)("v")[0]))
    counts = placed.groupBy("coarse").agg(F.count("*").alias("n"))  # at most a row a coarse cell
    fine = F.least(F.lit(MOST_FINE), F.ceil(F.col("n") / rows_per_cell)).cast("int")
    some = placed.join(F.broadcast(counts), "coarse").where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), "n") < F.greatest(fine * FIT_ROWS, F.lit(FIT_ROWS)))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        found = _centres(_unit(np.array(rows["v"].tolist(), dtype=np.float64)), int(rows["fine"].iloc[0]), seed)
        return pd.DataFrame({"coarse": rows["coarse"].iloc[0], "number": np.arange(len(found)), "centre": list(found.astype(np.float32))})

    near = some.select("coarse", "id", "v", fine.alias("fine")).groupBy("coarse").applyInPandas(fitted, "coarse int, number int, centre array<float>")
    cells = step(near.select((F.col("coarse").cast("long") * MOST_FINE + F.col("number")).alias("cell"), "coarse", "centre"))
    own = scoped_top_k(placed.select(F.col("id").alias("query_id"), F.col("v").alias("query")), placed.select(F.col("id").alias("query_id"), "coarse"), cells.select(F.col("cell").alias("id"), "coarse", F.col("centre").alias("embedding")), 1, "coarse")
    known = placed.join(own.select(F.col("query_id").alias("id"), F.col("id").alias("cell")), "id").join(cells.select("cell", "centre"), "cell")

    @F.pandas_udf("struct<code:binary,scale:float>")
    def coded(vectors: pd.Series, centres: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"code": pd.Series([], dtype=object), "scale": pd.Series([], dtype=np.float32)})
        rest = _unit(np.array(vectors.tolist(), dtype=np.float64)) - np.array(centres.tolist(), dtype=np.float64)
        scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
        return pd.DataFrame({"code": [r.tobytes() for r in np.rint(rest / scale[:, None]).astype(np.int8)], "scale": scale.astype(np.float32)})

    codes = step(known.select("id", "cell", coded("v", "centre").alias("c")).select("id", "cell", "c.code", "c.scale"))
    return InvertedFile(coarse, cells, codes, total, n)


def _nearest_centres(rows: DataFrame, centres: np.ndarray, n: int):
    """A pandas UDF from a vector to the numbers of its ``n`` nearest centres, which are sent to the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(vectors: pd.Series) -> pd.Series:
        near = _unit(np.array(vectors.tolist(), dtype=np.float64)) @ shared.value.T if len(vectors) else np.empty((0, 1))
        return pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))


def _centre_scores(asked: np.ndarray, allowed: np.ndarray, coarse: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Similarities of queries to fine centres; -1 where a query doesn't look into the coarse cell."""
    score = np.round(np.clip(asked @ centres.T, 0.0, 1.0), DIGITS)
    score[~allowed[:, coarse]] = -1.0
    return np.nan_to_num(score, copy=False, nan=-1.0)


def _within(score: np.ndarray, cells: np.ndarray, edge: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a query looks into a cell: it is nearer than the last one that the query looks into, or as near and not behind it by number."""
    return (score > edge[:, None]) | ((score == edge[:, None]) & (cells <= last[:, None]))


class _Reach:
    """How far each of some queries looks: the similarity ``edge`` and the number ``last`` of the last of its ``probes`` nearest cells.

    Cells are added in the order of their numbers. ``form`` says what is returned: the queries with what they may look into
    (``edge``), a row for each query and cell (``pair``) or the number of queries of each cell (``count``).
    """

    def __init__(self, asked: pa.RecordBatch, probes: int, n_coarse: int, form: str):
        self.asked, self.probes, self.form, self.matrix = asked, probes, form, _matrix(asked.column("v"))
        near = asked.column("near")
        self.allowed = np.zeros((asked.num_rows, n_coarse), dtype=bool)
        self.allowed[np.repeat(np.arange(asked.num_rows), np.asarray(near.value_lengths())), np.asarray(near.flatten())] = True
        self.cells, self.scores = [np.empty(0, np.int64)], [np.empty((asked.num_rows, 0))]

    def add(self, cells: pa.RecordBatch) -> None:
        self.cells.append(_ids(cells))
        self.scores.append(_centre_scores(self.matrix, self.allowed, np.asarray(cells.column("coarse")), _matrix(cells.column("v"))))

    def found(self) -> Iterator[pa.RecordBatch]:
        cells, scores = np.concatenate(self.cells), np.concatenate(self.scores, axis=1)
        edge, last = np.zeros(len(scores)), np.full(len(scores), np.iinfo(np.int64).max)  # all cells of the allowed coarse ones
        for i, score in enumerate(scores if len(cells) > self.probes else ()):
            least = np.partition(score, -self.probes)[-self.probes]
            if least >= 0:
                edge[i], last[i] = least, cells[np.flatnonzero(score == least)[self.probes - 1 - (score > least).sum()]]
        if self.form == "edge":
            bits = [row.tobytes() for row in np.packbits(self.allowed, axis=1)]
            yield pa.RecordBatch.from_arrays([self.asked.column("id"), self.asked.column("v"), pa.array(bits, pa.binary()), pa.array(edge), pa.array(last)], names=["id", "v", "bits", "edge", "last"])
        elif self.form == "count":
            counts = _within(scores, cells, edge, last).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts.astype(np.int64))], names=["cell", "n_queries"])
        else:
            for i, of in enumerate(_ids(self.asked)):
                seen = cells[_within(scores[i : i + 1], cells, edge[i : i + 1], last[i : i + 1])[0]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), of)), pa.array(seen)], names=["query_id", "cell"])


class _Probing(_Nearest):
    """The first ``k`` of the codes in the cells that each query looks into; a query is compared with no others.

    Codes are added in the order of cell and id. Candidates are gathered and ranked together, a cell hands on ``k`` at most.
    """

    def __init__(self, asked: pa.RecordBatch, k: int, n_coarse: int, digits: int = DIGITS):
        super().__init__(asked, k, False, None, digits)
        bits = np.frombuffer(b"".join(asked.column("bits").to_pylist()), np.uint8).reshape(asked.num_rows, -1)
        self.allowed = np.unpackbits(bits, axis=1, count=n_coarse).astype(bool)
        self.edge, self.last = np.asarray(asked.column("edge")), np.asarray(asked.column("last"))
        self.behind = np.full(len(self.ids), np.iinfo(np.int64).max)  # the item that stands last, where all ``k`` are found
        self.waiting, self.n_waiting = [], 0

    def add(self, items: pa.RecordBatch) -> None:
        items = _once(items, ("cell", "code", "scale"))
        ids, cells = _ids(items), np.asarray(items.column("cell"))
        starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        ends, own = np.append(starts[1:], len(cells)), items.take(pa.array(starts))
        score = _centre_scores(self.matrix, self.allowed, np.asarray(own.column("coarse")), _matrix(own.column("v")))
        within = _within(score, cells[starts], self.edge, self.last)
        centres = np.asarray(own.column("v").flatten()).reshape(len(starts), -1)
        codes = np.frombuffer(b"".join(items.column("code").to_pylist()), np.int8).reshape(len(ids), -1)
        decoded = codes * np.asarray(items.column("scale"))[:, None] + np.repeat(centres, ends - starts, axis=0)
        near = _unit(decoded.astype(np.float64))
        for j, (a, b) in enumerate(zip(starts, ends)):
            rows = np.flatnonzero(within[:, j])
            if not len(rows):
                continue
            score = np.round(np.clip(self.matrix[rows] @ near[a:b].T, 0.0, 1.0), self.digits)
            np.nan_to_num(score, copy=False, nan=-1.0)
            item = np.broadcast_to(ids[a:b], score.shape)
            if b - a > self.k:
                order = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
                item, score = ids[a:b][order], np.take_along_axis(score, order, axis=1)
            floor = self.floor[rows][:, None]
            row, at = np.nonzero((score > floor) | ((score == floor) & (item < self.behind[rows][:, None])))
            self.waiting.append((rows[row], item[row, at], score[row, at]))
            self.n_waiting += len(row)
            if self.n_waiting > max(SLICE, 2 * self.k * len(self.ids)):
                self.rank()

    def rank(self) -> None:
        if self.waiting:
            self.keep(*(np.concatenate(c) for c in zip(*self.waiting)))
            counts = np.bincount(self.row, minlength=len(self.ids))
            full = counts == self.k
            self.behind[full] = self.item[(np.cumsum(counts) - 1)[full]]
        self.waiting, self.n_waiting = [], 0

    def found(self) -> Iterator[pa.RecordBatch]:
        self.rank()
        yield from super().found()


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("query_id").cast("long").alias("id"), F.col("query").cast("array<float>").alias("v")).where("v is not null")


def _probed(index: InvertedFile, asked: DataFrame, n_asked: int, share: float, form: str, schema: str) -> DataFrame:
    """What ``_Reach`` gives for all queries: all cells stream past each block of them, which holds ``CENTRE_SCORES`` similarities."""
    n_coarse, blocks = len(index.coarse), max(1, -(-n_asked * index.n_cells // CENTRE_SCORES))
    probes, look = max(1, math.ceil(share * index.n_cells)), max(1, math.ceil(math.sqrt(share) * n_coarse))
    left = asked.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("part"), F.lit(0).alias("kind"), "id", "v", _nearest_centres(asked, index.coarse, look)("v").alias("near"), F.lit(None).cast("int").alias("coarse"))
    right = index.cells.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("part"), F.lit(1).alias("kind"), F.col("cell").alias("id"), F.col("centre").alias("v"), F.lit(None).cast("array<int>").alias("near"), "coarse")
    met = left.union(right).repartition("block").sortWithinPartitions("block", "part", "kind", "id")
    return met.mapInArrow(_pairwise(lambda q: _Reach(q, probes, n_coarse, form)), schema)


def looks_by_cell(index: InvertedFile, queries: DataFrame, share: float = 0.1) -> DataFrame:
    """(cell, n_queries): how many queries look into each cell when the index is searched; no row a query and cell is made."""
    if not len(index.coarse):
        return queries.sparkSession.createDataFrame([], "cell long, n_queries long")
    asked = _asked(queries)
    return _probed(index, asked, asked.count(), share, "count", "cell long, n_queries long").groupBy("cell").agg(F.sum("n_queries").alias("n_queries"))


def search_index(index: InvertedFile, queries: DataFrame, items: DataFrame, k: int, share: float = 0.1, refine: int = 10) -> tuple[DataFrame, DataFrame]:
    """The approximate nearest items, with exact similarities and ranks, and (query_id, cell), the cells looked into.

    A query looks into the ``share`` of the cells whose centres are nearest, among those of its nearest coarse cells, ranks
    what lies there by the 8-bit codes, and compares the first ``refine * k`` with the items themselves. Which cells these
    are goes with a query as the similarity and number of the last of them, so no row of a query and a cell is shuffled.
    Codes are dealt into parts of about ``CODE_PART``, cell by cell; a task streams a part past a block of queries and hands
    on ``refine * k`` rows a query. A cell of more than ``SCOPE_PART`` codes is dealt itself.
    """
    if not len(index.coarse):
        none = queries.sparkSession.createDataFrame([], "query_id long, id long, similarity double, rank int")
        return none, none.select("query_id", F.col("id").alias("cell"))
    asked, n_coarse = _asked(queries), len(index.coarse)
    n_asked = asked.count()
    parts, blocks = max(1, -(-index.n_items // CODE_PART)), max(1, -(-n_asked * index.coarse.shape[1] // ASKED_VALUES))
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in (("coarse", "int"), ("bits", "binary"), ("edge", "double"), ("last", "long"), ("code", "binary"), ("scale", "float"))}
    reach = _probed(index, asked, n_asked, share, "edge", "id long, v array<float>, bits binary, edge double, last long")
    left = reach.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"),
        "id", F.lit(-1).cast("long").alias("cell"), "v", empty["coarse"], "bits", "edge", "last", empty["code"], empty["scale"],
    )
    large = index.codes.groupBy("cell").agg(F.ceil(F.count("*") / SCOPE_PART).alias("pieces")).where("pieces > 1")  # a row for each SCOPE_PART codes at most
    dealt = F.pmod(F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1)))), F.lit(parts)).cast("int")
    right = index.codes.join(index.cells, "cell").join(large, "cell", "left").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), dealt.alias("part"), F.lit(1).alias("kind"),
        "id", "cell", F.col("centre").alias("v"), "coarse", empty["bits"], empty["edge"], empty["last"], "code", "scale",
    )
    met = left.union(right).repartition("block", "part").sortWithinPartitions("block", "part", "kind", "cell", "id")
    near = met.mapInArrow(_pairwise(lambda q: _Probing(q, refine * k, n_coarse)), "query_id long, id long, similarity double")
    found = ranked(near, refine * k)
    exact = items.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    pairs = found.select("query_id", "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("query")), "query_id").join(exact, "id")  # refine * k rows a query
    looked = _probed(index, asked, n_asked, share, "pair", "query_id long, cell long")
    return ranked(pairs.select("query_id", "id", F.round(similarity(F.col("query"), F.col("embedding")), 12).alias("similarity")), k), looked


def approximate_top_k(queries: DataFrame, items: DataFrame, k: int, share: float = 0.1, refine: int = 10, step: Callable[[DataFrame], DataFrame] = lambda df: df, **options) -> DataFrame:
    """Neighbours from an index made for this search; it may miss neighbours in cells that aren't looked into."""
    return search_index(build_index(items, step=step, **options), queries, items, k, share, refine)[0]


def _centres(sample: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Unit centres by the usual alternation of assigning and averaging; fewer if there are fewer rows."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:cells]]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1) if len(sample) else np.empty(0, dtype=np.int64)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(axis=0)
        centres = _unit(centres)
    return centres


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found; one row."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count("*").alias("n_exact"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 4).alias("recall"))
