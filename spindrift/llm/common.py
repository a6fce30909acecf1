"""Shared helpers of the corpus operators: storage between stages, checked broadcasts, splits and words."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpoint as checkpoint
from ..storage import shared_dir as shared_dir

#: ASCII white space as the contracts name it; a word is a maximal run of anything else.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of letters, digits and everything beyond ASCII, after lower-casing A-Z.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows beyond which a side is no longer broadcast.
BROADCAST_ROWS = 500_000


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def store(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """df written to a table of its own in the shared folder, and what removes that again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), lambda: remove(spark, path)


def broadcast_if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """Marks df for broadcast if a count shows at most ``most`` (BROADCAST_ROWS) rows; else leaves the join to a shuffle that AQE splits.

    df should be cheap to count: a checkpoint or an aggregate of one.
    """
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def crc_rem(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % modulus


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does the same, faster, where there is nothing beyond ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column, pattern: str) -> Column:
    """All matches of the pattern, an empty array for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def meet(rows: DataFrame, others: DataFrame, how: str = "inner") -> DataFrame:
    """The join on the struct column key, by which the result stays partitioned and sorted: what groups by key next takes no shuffle.

    Both keys get one type, as fields that are nullable on one side only would make the join deal by a cast of the key; and the hint
    keeps a small other side from being broadcast after the rows were dealt. Null fields meet each other.
    """
    kind = others.schema["key"].dataType.simpleString()
    return rows.withColumn("key", F.col("key").cast(kind)).join(others.withColumn("key", F.col("key").cast(kind)).hint("merge"), "key", how)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, so that further columns of the input can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
