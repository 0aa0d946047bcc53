"""Whitening of embeddings from exact integer statistics, by a bit-sliced scatter matrix.

Entries become whole numbers ``x = floor(256 c)``. The fit list is each distinct ``x`` vector once. A task shifts every
dimension of some rows by its least value there, cuts the shifted numbers into bit planes and packs each plane across
rows into 64-bit words. The AND of two planes, its set bits counted and weighted by both planes' powers of two, adds up
to the exact sum of products. Tasks hand on these sums in limbs of 32 bits, which Spark adds as longs, so nothing
overflows or rounds, however many rows there are. The driver gets one number a pair of dimensions, centres them as
integers (``n C - S S'``), and only then turns to doubles for the eigenvectors.

Rows count if their vector isn't null and holds no null, NaN or infinite entry; a vector that is shorter than the longest
lacks entries and is dropped too, as are empty ones. Entries beyond the range of a long are held at its ends. Repeated
rows weigh once in the fit and come out each; null ids come out as null. A direction without variance (fewer distinct
vectors than components, constant dimensions) has ``whitened`` 0 and stays out of ``identity_error``. Without a usable row
there are no rows. Of equal eigenvalues the order is that of the decomposition; the largest entry of an eigenvector is
positive. Other columns of ``whiten`` pass through; one named as a computed column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjobs.llm.common import extended, stored, table

#: Rows whose bit planes are compared at once.
BLOCK = 8192
LIMBS = 5


@dataclass
class Whitening:
    """``basis``: a column for each component, already over the root of its eigenvalue."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    explained: list[float] = field(default_factory=list)
    identity_error: float = 0.0


def whole_numbers(vectors: DataFrame, vector_col: str, into: str) -> DataFrame:
    """``vectors`` with the entries of usable vectors as whole numbers in ``into``; other rows are dropped."""
    c = F.col(vector_col).cast("array<double>")
    usable = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull()).where(usable & (F.size(vector_col) > 0))
    return rows.withColumn(into, F.transform(c, lambda e: F.floor(256 * e).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def bit_sliced_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums by dimension, and sums of products by pair (upper triangle), of whole-number rows, as Python integers."""
    rows, width = x.shape
    least = x.min(axis=0)
    shifted = x.view(np.uint64) - least.view(np.uint64)  # wraps to the true distance, whatever the range
    bits = [int(m).bit_length() for m in shifted.max(axis=0)]
    places = np.array([(i, a) for i in range(width) for a in range(bits[i])], dtype=np.int64).reshape(-1, 2)
    first = np.concatenate([[0], np.cumsum(bits)])  # first plane of each dimension
    packed = np.zeros((len(places), -(-rows // 64) * 8), dtype=np.uint8)
    for i in range(width):
        if bits[i]:
            planes = (shifted[:, i][None, :] >> np.arange(bits[i], dtype=np.uint64)[:, None]) & np.uint64(1)
            packed[first[i] : first[i + 1], : -(-rows // 8)] = np.packbits(planes.astype(np.uint8), axis=1)
    words = packed.view(np.uint64)
    counted = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    small = max(bits, default=0) <= 24  # then all sums of a block fit into a long
    weight = np.array([1 << int(a) for a in places[:, 1]], dtype=np.int64 if small else object)
    products = np.zeros((width, width), dtype=object)
    live = [i for i in range(width) if bits[i]]
    sums = np.zeros(width, dtype=object)
    for i in live:
        here = slice(first[i], first[i + 1])
        sums[i] = int((counted[here] * weight[here]).sum())
        later = [j for j in live if j >= i]
        starts = first[later] - first[i]
        row = np.zeros(len(later), dtype=weight.dtype)
        for p in range(first[i], first[i + 1]):
            both = np.bitwise_count(words[first[i] :] & words[p]).sum(axis=1, dtype=np.int64)
            row = row + np.add.reduceat(both * weight[first[i] :], starts) * weight[p]
        products[i, later] = [int(v) for v in row]
    m = least.astype(object)
    products = products + np.triu(np.outer(m, sums) + np.outer(sums, m) + rows * np.outer(m, m))
    return sums + rows * m, products


def _scatter(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and sums of products over the fit list, exact."""
    upper = np.triu_indices(width)

    def limbs(values: list[int]) -> list[list[int]]:
        low = [[v >> 32 * k & 0xFFFFFFFF for v in values] for k in range(LIMBS - 1)]
        return [*low, [v >> 32 * (LIMBS - 1) for v in values]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(at, BLOCK), width)
                s, p = bit_sliced_products(np.ascontiguousarray(x))
                n, sums, products = n + len(x), sums + s, products + p
        if n:
            # the count stands at (-1, -1), sums at (i, -1)
            i, j = [-1, *range(width), *upper[0].tolist()], [-1] * (width + 1) + upper[1].tolist()
            values = [n, *map(int, sums), *map(int, products[upper])]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(v, pa.int64()) for v in limbs(values))], names=names)

    names = ["i", "j", *(f"limb{k}" for k in range(LIMBS))]
    parts = fit.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"limb{k} long" for k in range(LIMBS)))
    totals = parts.groupBy("i", "j").agg(*(F.sum(f"limb{k}").alias(f"limb{k}") for k in range(LIMBS))).toArrow().to_pydict()
    n, sums, products = 0, [0] * width, [[0] * width for _ in range(width)]
    for r, (i, j) in enumerate(zip(totals["i"], totals["j"], strict=True)):
        value = sum(totals[f"limb{k}"][r] << 32 * k for k in range(LIMBS))
        if i < 0:
            n = value
        elif j < 0:
            sums[i] = value
        else:
            products[i][j] = products[j][i] = value
    return n, sums, products


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n`` as doubles: the whole part is taken off as an integer, so nothing cancels."""
    whole = [s // n for s in sums]
    rest = np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])
    if len(x) and max(abs(int(x.min())), abs(int(x.max())), *map(abs, whole)) >= 1 << 62:
        return (x.astype(object) - np.array(whole, dtype=object)).astype(np.float64) - rest
    return (x - np.array(whole, dtype=np.int64)).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of ``(n x - S)^2`` of each row, exact."""
    whole = [s // n for s in sums]
    rest = [s - n * w for s, w in zip(sums, whole, strict=True)]  # in [0, n)
    y = x.astype(object) - np.array(whole, dtype=object)
    top = max((max(abs(int(v.min())), abs(int(v.max()))) for v in (x, np.array(whole, dtype=object))), default=0) * 2 if len(x) else 0
    if x.shape[1] * max(top * top, top * max(rest, default=0)) < 1 << 62:
        y = x - np.array(whole, dtype=np.int64)
        squares, mixed = (y * y).sum(axis=1).tolist(), (y @ np.array(rest, dtype=np.int64)).tolist()
    else:
        squares, mixed = (y * y).sum(axis=1).tolist(), (y * np.array(rest, dtype=object)).sum(axis=1).tolist()
    last = sum(r * r for r in rest)
    return [n * n * a - 2 * n * b + last for a, b in zip(squares, mixed, strict=True)]


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", components: int = 4) -> Whitening:
    """Components by falling eigenvalue of the covariance of the distinct whole-number vectors (divisor n)."""
    fit = stored(whole_numbers(vectors.select(vector_col), vector_col, "x").select("x").distinct(), "whitening-fit")
    width = fit.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return Whitening()
    fit = fit.where(F.size("x") == width)
    n, sums, products = _scatter(fit, width)
    covariance = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(width)] for i in range(width)])
    values, vectors_ = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, basis, trace = values[order], vectors_[:, order], float(np.trace(covariance))
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    varied = values > trace * width * np.finfo(float).eps
    basis = basis * np.where(varied, 1 / np.sqrt(np.where(varied, values, 1.0)), 0.0)
    model = Whitening(n, sums, basis, [float(max(v, 0.0) / trace) if trace > 0 else 0.0 for v in values])
    model.identity_error = _identity_error(fit, model, varied)
    return model


def _identity_error(fit: DataFrame, model: Whitening, varied: np.ndarray) -> float:
    """Measured on the fit list: the largest absolute entry of the whitened covariance minus the identity."""
    k = model.basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                z = centred(_matrix(batch.column(0), len(model.sums)), model.n, model.sums) @ model.basis
                total += z.T @ z
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    found = np.zeros((k, k))
    for i, j, v in fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        found[i, j] = v / model.n - (i == j)
    return float(np.abs(found[np.ix_(varied, varied)]).max()) if varied.any() else 0.0


WHITENED = [T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))]


def whiten(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The usable rows of ``vectors`` with ``whitened``, a number for each component, and ``deviation``, the exact integer
    distance ``sum (n x - S)^2`` from the mean."""
    rows = whole_numbers(vectors, vector_col, "__x").where(F.size("__x") == len(model.sums))
    keep = [c for c in (keep if keep is not None else vectors.columns) if c not in ("deviation", "whitened")]
    rows = rows.select(*(F.col(f"`{c}`") for c in keep), "__x")

    def compute(batch: pa.RecordBatch):
        x = _matrix(batch.column("__x"), max(1, len(model.sums)))
        z = centred(x, model.n, model.sums) @ model.basis if len(x) else np.zeros((0, 1))
        yield pa.array(deviations(x, model.n, model.sums) if len(x) else [], pa.decimal128(38, 0))
        yield pa.array(list(z), pa.list_(pa.float64()))

    return extended(rows, compute, WHITENED, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component. ``deviation`` is null where the exact number doesn't fit into a long."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(vectors)
    rows = whiten(vectors, model, keep=["vec_id"]).withColumn("deviation", F.col("deviation").try_cast("long"))
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, model.explained or [0.0])), F.col("at") + 1)
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
