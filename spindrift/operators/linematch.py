"""Matching lines of two texts, as Python's matcher finds them, for texts of any length.

The matcher takes the longest block of equal lines (the first one of the old text, then of the new, among equals) and goes on to the
left and to the right of it. Short texts are matched in one go by a task. For long ones the blocks of equal lines are rows: pairs of equal
lines on one diagonal in runs. In rounds, over all texts at once, each open range takes its longest run, and what the runs have to the left
and the right of it falls into two new ranges. A range that has become short is matched by a task of its own.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage

#: Lines of both sides of a range that one task matches, and pairs of equal lines up to which a longer text is matched by rounds.
SHORT, PAIRS = 20_000, 200_000_000
#: Where Python ends a line (fixed values).
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_RANGE = ["key", "alo", "ahi", "blo", "bhi"]


def split_lines(text: Column) -> Column:
    """Lines without their ends; none of an empty or null text, and none behind the last end."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _local(ranges: DataFrame, key: str) -> DataFrame:
    """key, i, j, n of ranges (key, alo, blo, a, b), a and b being the lines of the range."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                found = difflib.SequenceMatcher(None, list(r.a), list(r.b), autojunk=False).get_matching_blocks()[:-1]
                out += [(r.key, int(r.alo) + m.a, int(r.blo) + m.b, m.size) for m in found]
            yield pd.DataFrame(out, columns=["key", "i", "j", "n"])

    return ranges.select("key", "alo", "blo", "a", "b").mapInPandas(run, f"key {key}, i int, j int, n int")


def _runs(pairs: DataFrame) -> DataFrame:
    """Runs of equal lines on a diagonal, in the range of the whole texts."""
    side = lambda c, at: pairs.select("key", F.posexplode(c).alias(at, "line"))
    met = side("a", "i").join(side("b", "j"), ["key", "line"]).select("key", "i", (F.col("i") - F.col("j")).alias("d"))
    gap = F.col("i") - F.row_number().over(Window.partitionBy("key", "d").orderBy("i"))
    runs = met.withColumn("gap", gap).groupBy("key", "d", "gap").agg(F.min("i").alias("i"), F.count(F.lit(1)).cast("int").alias("n"))
    whole = pairs.select("key", F.lit(0).alias("alo"), F.size("a").alias("ahi"), F.lit(0).alias("blo"), F.size("b").alias("bhi"))
    return runs.select("key", "i", (F.col("i") - F.col("d")).alias("j"), "n").join(whole, "key")


def _round(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The longest run of each range, and what is left of the runs in the ranges to its left and right."""
    best = runs.groupBy(*_RANGE).agg(F.max_by(F.struct("i", "j", "n"), F.struct("n", -F.col("i"), -F.col("j"))).alias("m"))
    met = runs.join(best, _RANGE)
    i, j, n = F.col("m.i"), F.col("m.j"), F.col("m.n")
    left = F.least(F.col("n"), i - F.col("i"), j - F.col("j"))
    skip = F.greatest(F.lit(0), i + n - F.col("i"), j + n - F.col("j"))
    part = lambda alo, ahi, blo, bhi, at, to, size: F.struct(alo.alias("alo"), ahi.alias("ahi"), blo.alias("blo"), bhi.alias("bhi"), at.alias("i"), to.alias("j"), size.alias("n"))
    before = part(F.col("alo"), i, F.col("blo"), j, F.col("i"), F.col("j"), left)
    after = part(i + n, F.col("ahi"), j + n, F.col("bhi"), F.col("i") + skip, F.col("j") + skip, F.col("n") - skip)
    rest = met.select("key", F.explode(F.array(before, after)).alias("p")).select("key", "p.*").where("n > 0")
    return best.select("key", "m.*"), rest


def matching_blocks(pairs: DataFrame, short: int = SHORT, most_pairs: int = PAIRS) -> DataFrame:
    """key, i, j, n: the blocks of equal lines of pairs (key, a, b), a and b being lists of lines and keys unique.

    Equal to what the matcher gives without its heuristics. Null lists are empty. A long text whose equal lines make more than most_pairs pairs
    is matched by one task, as a short one is.
    """
    none = F.array().cast("array<string>")
    pairs = pairs.select("key", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    kind = pairs.schema["key"].dataType.simpleString()
    long = F.size("a") + F.size("b") > short
    whole = lambda df: df.select("key", F.lit(0).alias("alo"), F.lit(0).alias("blo"), "a", "b")
    found = [_local(whole(pairs.where(~long)), kind)]
    large = pairs.where(long)
    if large.limit(1).count():
        count = lambda c, n: large.select("key", F.explode(c).alias("line")).groupBy("key", "line").agg(F.count(F.lit(1)).alias(n))
        dense = storage.checkpoint(count("a", "x").join(count("b", "y"), ["key", "line"]).groupBy("key").agg(F.sum(F.col("x") * F.col("y")).alias("met")).where(F.col("met") > most_pairs).select("key"))
        found.append(_local(whole(large.join(dense, "key", "left_semi")), kind))
        large = large.join(dense, "key", "left_anti")
        runs = storage.checkpoint(_runs(large))
        while runs.limit(1).count():
            best, rest = _round(runs)
            found.append(storage.checkpoint(best))
            rest = storage.checkpoint(rest)
            small = F.col("ahi") - F.col("alo") + F.col("bhi") - F.col("blo") <= short
            ranges = rest.where(small).select(*_RANGE).distinct().join(large, "key")
            cut = lambda c, lo, hi: F.slice(c, F.col(lo) + 1, F.col(hi) - F.col(lo)).alias(c)
            found.append(_local(ranges.select("key", "alo", "blo", cut("a", "alo", "ahi"), cut("b", "blo", "bhi")), kind))
            runs = rest.where(~small)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    w = Window.partitionBy("key").orderBy("i", "j")
    follows = (F.lag(F.col("i") + F.col("n")).over(w) == F.col("i")) & (F.lag(F.col("j") + F.col("n")).over(w) == F.col("j"))
    joined = out.withColumn("starts", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("block", F.sum("starts").over(w))
    return joined.groupBy("key", "block").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.sum("n").cast("int").alias("n")).drop("block")


def changed_lines(texts: DataFrame, short: int = SHORT) -> DataFrame:
    """key, before, after: the numbers of the lines of either text (key, before, after) that no block has; all lines where the texts
    differ but no line does."""
    pairs = texts.select("key", split_lines(F.col("before")).alias("a"), split_lines(F.col("after")).alias("b"), (~F.coalesce("before", F.lit("")).eqNullSafe(F.coalesce("after", F.lit("")))).alias("differ"))
    blocks = matching_blocks(pairs, short)
    spread = lambda c: F.flatten(F.collect_list(F.sequence(F.col(c), F.col(c) + F.col("n") - 1)))
    kept = blocks.groupBy("key").agg(spread("i").alias("x"), spread("j").alias("y"))
    none = F.array().cast("array<int>")
    # Only how many lines there are goes on to the blocks, not the lines.
    sizes = pairs.select("key", "differ", F.size("a").alias("n_a"), F.size("b").alias("n_b"))
    every = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(none)
    left = lambda n, x: F.array_except(every(n), F.coalesce(x, none))
    rows = sizes.join(kept, "key", "left").select("key", "differ", every("n_a").alias("a"), every("n_b").alias("b"), left("n_a", "x").alias("before"), left("n_b", "y").alias("after"))
    whole = (F.size("before") == 0) & (F.size("after") == 0) & F.col("differ")
    return rows.select("key", F.when(whole, F.col("a")).otherwise(F.col("before")).alias("before"), F.when(whole, F.col("b")).otherwise(F.col("after")).alias("after"))
