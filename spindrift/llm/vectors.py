"""Shared helpers of the vector operators: usable rows, shards and query blocks of bounded size, Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows to a shard and queries to a block, on average; a task holds one of each.
SHARD, BLOCK = 16_384, 8_192


def finite(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    ok = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    return F.coalesce((F.size(vector) > 0) & ok, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def parts(rows: DataFrame, size: int) -> int:
    """How many parts of about size rows the rows make."""
    return max(1, -(-rows.count() // size))


def against(rows: DataFrame, queries: DataFrame, key: str, query_key: str, work: Callable[[pa.Table, pa.Table], list[np.ndarray]], schema: str, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """work(a shard of rows, a block of queries) for every shard and block of vectors ``v`` of one length.

    A stated query set against all rows: rows go to one shard each and are copied to every block, queries the other way round, and a
    task gets a shard and a block, whatever the tables' sizes. Rows and queries are dealt by the hashes of their keys, so that equal
    or similar vectors don't gather. Nothing passes through the driver but the two counts.
    """
    n, m = parts(rows, shard), parts(queries, block)
    part = lambda c, count: F.pmod(F.xxhash64(F.col(c)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.withColumn("dim", F.size("v")).withColumn("shard", part(key, n)).withColumn("block", every(m))
    right = queries.withColumn("dim", F.size("v")).withColumn("block", part(query_key, m)).withColumn("shard", every(n))
    return left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInArrow(_both(work, schema), schema)


def _both(work: Callable, schema: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Calls work where both sides have rows, and makes its result have the declared columns."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = work(left, right) if left.num_rows and right.num_rows else [[]] * len(names)
        return pa.table([pa.array(x, {"long": pa.int64(), "double": pa.float64()}[k]) for x, k in zip(found, kinds, strict=True)], names=names)

    return run


def first(rows: DataFrame, by: list[str], order: list[Column], most: int, rank: str = "rank") -> DataFrame:
    """The first rows of each group, numbered from 1; a task sends no more than these of any group."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= most)


def firsts(group: np.ndarray, score: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first entries of each group by falling score, ties by the smaller tie, ordered by group."""
    at = np.lexsort((tie, -score, group))
    g = group[at]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return at[place < most]
