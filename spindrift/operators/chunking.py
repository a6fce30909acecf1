"""Large diffs in pieces, and items in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CHARS = 20_000
#: Headers of a file's part and of a hunk; the latter only if its line ends with the second pair of signs (fixed patterns).
FILE_HEADER, HUNK_HEADER = r"diff --git a/[^\n]*? b/[^\n]*?\n", r"@@[^\n]*?@@\n"


def at_headers(text: Column, header: str) -> Column:
    """The text from each header to the next; the whole text if it has none. What stands before the first header is dropped."""
    parts = F.filter(F.split(text, f"(?={header})", -1), lambda p: p.rlike(f"^(?:{header})"))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def pack(parts: Column, most: int = MOST_CHARS) -> Column:
    """Neighbouring parts put together as long as they stay within most characters; a larger part stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        full = (F.length(acc["open"]) + F.length(x) > most) & (acc["open"] != "")
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, x).otherwise(F.concat(acc["open"], x)).alias("open"))

    finish = lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    return F.aggregate(parts, start, step, finish)


def by_hunk(text: Column, most: int = MOST_CHARS) -> Column:
    """The hunks of a file's diff, packed; the file's header is dropped. A diff without hunk headers stays whole."""
    return F.when(text.rlike(HUNK_HEADER), pack(at_headers(text, HUNK_HEADER), most)).otherwise(F.array(text))


def by_file(text: Column, most: int = MOST_CHARS) -> Column:
    """A diff by files, the larger ones by hunks; without any file header the whole text."""
    each = F.transform(at_headers(text, FILE_HEADER), lambda p: F.when((F.length(p) > most) & p.rlike(f"^(?:{FILE_HEADER})"), by_hunk(p, most)).otherwise(F.array(p)))
    return F.flatten(each)


def chunks(diffs: DataFrame, text: str = "diff", most: int = MOST_CHARS) -> DataFrame:
    """The columns of diffs but the text, chunk_no, chunk, chunked: a text beyond the limit in pieces, any other whole."""
    long = F.length(text) > most
    kept = [F.col(f"`{c}`") for c in diffs.columns if c != text]
    return diffs.select(*kept, long.alias("chunked"), F.posexplode(F.when(long, by_file(F.col(text), most)).otherwise(F.array(F.col(text)))).alias("chunk_no", "chunk"))


def batches(items: DataFrame, group: list[str], order: list[str], size: int, item: str = "item") -> DataFrame:
    """group, batch_no (from 0), items: the items of a group in order, size to a batch."""
    no = F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size).cast("int")
    held = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.col(item).alias("x"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    return items.withColumn("batch_no", no).groupBy(*group, "batch_no").agg(F.transform(held, lambda s: s["x"]).alias("items"))


def oversize(items: DataFrame, group: list[str], most: int) -> DataFrame:
    """items without the groups of more than most rows."""
    few = items.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select(*group)
    return items.join(few, group, "left_semi")
