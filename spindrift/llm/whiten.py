"""Whitening of embeddings by exact integer statistics.

Vectors become integers; sums, centred products and deviations are exact. A task cuts its centred integers into small limbs, multiplies
limb matrices as doubles (whose sums stay below 2^53, so BLAS makes no error), and puts the limb products together as big integers. These
leave the task as 31-bit digits in longs, which Spark sums; the driver gets one sum per digit and pair of dimensions and decomposes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

SCALE, SHIFT = 64, 1_000_000
#: Bits of a limb and rows of a product: 2 * LIMB + log2(ROWS) is at most 53.
LIMB, ROWS = 18, 1 << 16
#: Bits of the digits that tasks send and Spark sums, and eigenvalues (of the largest) below which a component is no direction of the data.
DIGIT, NOTHING = 31, 1e-12


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """64-bit integers as matrices of limbs, lowest first, the last one signed; only as many as the values need."""
    out, rest = [], x
    while np.abs(rest).max(initial=0) >= 1 << (LIMB - 1):
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    return [*out, rest.astype(np.float64)]


def gram(x: np.ndarray) -> np.ndarray:
    """x^T x of 64-bit integers, as Python's integers."""
    total = np.zeros((x.shape[1],) * 2, object)
    for at in range(0, len(x), ROWS):
        parts = limbs(x[at : at + ROWS])
        for i, p in enumerate(parts):
            for j, q in enumerate(parts[i:], i):
                product = (p.T @ q).astype(np.int64).astype(object) << (LIMB * (i + j))
                total = total + (product if i == j else product + product.T)
    return total


def digits(values: np.ndarray) -> list[list[int]]:
    """Big integers as digits of DIGIT bits, lowest first, the last one signed."""
    out, rest = [], list(values)
    while any(abs(v) >> DIGIT for v in rest):
        out.append([v & ((1 << DIGIT) - 1) for v in rest])
        rest = [v >> DIGIT for v in rest]
    return [*out, rest]


def _integers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = np.floor(SCALE * vectors.matrix(column))
    if np.abs(x).max(initial=0) >= 2.0**62:
        raise OverflowError("a component is too large: floor(64 c) doesn't fit a 64-bit integer")
    return x.astype(np.int64) + SHIFT


def _summed(parts: DataFrame) -> dict[int, int]:
    """Big integers by cell, from the digits (cell, place, value) of all tasks."""
    out: dict[int, int] = {}
    for r in parts.groupBy("cell", "place").agg(F.sum("value").alias("value")).collect():  # a few for each pair of dimensions
        out[r["cell"]] = out.get(r["cell"], 0) + (r["value"] << (DIGIT * r["place"]))
    return out


def _sent(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for place, row in enumerate(digits(values)):
        cells = np.arange(len(row), dtype=np.int64)
        yield pa.record_batch([pa.array(cells), pa.array(np.full(len(row), place)), pa.array(row, pa.int64())], names=["cell", "place", "value"])


_DIGITS = "cell long, place long, value long"


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S in 64 bits."""
    if n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums)) >= 1 << 62:
        raise OverflowError("n x - S doesn't fit a 64-bit integer")
    return n * x - np.array(sums, np.int64)


def _longs(stream: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The fit list's vectors of each batch."""
    for b in stream:
        if b.num_rows:
            x = b.column("x")
            yield x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def whiten(rows: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of rows (vec_id, embedding).

    The fit list is every distinct integer vector once. Components are numbered from 1 by falling eigenvalue of its covariance; as many
    are returned as asked for, as the vectors are long, and as have an eigenvalue above NOTHING of the largest: with a single distinct
    vector there is none, and an empty result. Vectors that are null, empty or hold a null or non-finite entry are dropped, and so are those
    of another length than most have (the longest among equals). Null ids and repeated rows are returned like any other. Integers beyond
    64 bits raise OverflowError. An empty table gives an empty result; further columns are ignored.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    own = common.only(rows, "vec_id", "embedding").select(F.col("vec_id").cast("bigint"), F.col("embedding").alias("v")).where(vectors.finite(F.col("v")))
    lengths = own.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    own, dim = own.where(F.size("v") == lengths["dim"]), lengths["dim"]

    def quantised(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            if b.num_rows:
                x = _integers(b.column("v"))
                yield pa.record_batch([pa.ListArray.from_arrays(np.arange(0, x.size + 1, dim, dtype=np.int32), x.ravel())], names=["x"])

    fit = common.checkpoint(own.select("v").mapInArrow(quantised, "x array<long>").distinct())

    def sums_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1, object)
        for x in _longs(stream):
            total += np.r_[((x >> 31).sum(axis=0).astype(object) << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object), len(x)]
        yield from _sent(total)

    found = _summed(fit.mapInArrow(sums_of, _DIGITS))
    n, sums = found[dim], [found[i] for i in range(dim)]

    def products_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for x in _longs(stream):
            total = total + gram(centred(x, n, sums))
        yield from _sent(total[np.triu_indices(dim)])

    found = _summed(fit.mapInArrow(products_of, _DIGITS))
    covariance = np.zeros((dim, dim))
    for c, (i, j) in enumerate(zip(*np.triu_indices(dim), strict=True)):
        covariance[i, j] = covariance[j, i] = float(Fraction(found[c], n**3))
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    m = int((values[:components] > NOTHING * max(values[0], 0)).sum())
    if not m:
        return spark.createDataFrame([], schema)
    project, explained = axes[:, :m] / np.sqrt(values[:m]) / n, values[:m] / np.trace(covariance)

    def checked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((m, m)), np.zeros(m)
        for x in _longs(stream):
            w = centred(x, n, sums).astype(np.float64) @ project
            total, mean = total + w.T @ w, mean + w.sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(m * m + m)), pa.array(np.r_[total.ravel(), mean])], names=["cell", "value"])

    got = {r["cell"]: r["value"] / n for r in fit.mapInArrow(checked, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    mean = np.array([got[m * m + i] for i in range(m)])  # nought but for rounding
    error = float(np.abs(np.array([got[i] for i in range(m * m)]).reshape(m, m) - np.outer(mean, mean) - np.eye(m)).max())

    def projected(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for at in range(0, b.num_rows, ROWS // 16):
                part = b.slice(at, ROWS // 16)
                y = centred(_integers(part.column("v")), n, sums)
                if dim * float(np.abs(y).max()) ** 2 >= 2.0**63:
                    raise OverflowError("a deviation doesn't fit a 64-bit integer")
                w, k = y.astype(np.float64) @ project, len(y)
                columns = [part.column("vec_id").take(pa.array(np.repeat(np.arange(k), m))), np.tile(np.arange(1, m + 1, dtype=np.int32), k), np.full(k * m, n), np.repeat((y * y).sum(axis=1), m), w.ravel(), np.tile(explained, k), np.full(k * m, error)]
                yield pa.record_batch([pa.array(c) for c in columns], names=[c.split()[0] for c in schema.split(", ")])

    return own.mapInArrow(projected, schema)
