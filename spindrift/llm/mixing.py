"""Mixing sources to target weights by pivotal dependent rounding (operator 2), in DataFrame functions only.

A source whose target is r times its size takes every document r times on average: floor(r) times for certain and once more with
the fraction. The fractions are rounded pairwise: of two documents with fractions p, q and sizes v, w, either p rises and q falls
or the other way round, by the same number of *words*, until one of them is 0 or 1; the direction is drawn so that each keeps
its expected value. The taken words of a pair, and so of a source, stay as they were. Large documents of a chunk are paired first, so
that smaller ones take up what they leave; the fraction of the one document that is left in the end goes to the nearer of 0 and 1,
and a source misses its target by half a document at most.

The pairs form a tree: chunks of ``WIDTH`` documents are folded, each leaves at most one fraction, chunks of those are folded
again, and so on. A chunk holds documents of one source picked by a hash, so a large source has many chunks and no task holds more
than its share; each level has 1/WIDTH of the rows of the one before. Rows move once per level and carry no text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, broadcast_if_small, checkpoint, meet, uniform, union_all

#: Documents to a chunk of the reduction tree.
WIDTH = 64
ITEM = "struct<order:double,u:bigint,p:double,w:double,m:bigint,whole:bigint,key:struct<doc_id:{0},source:{1},size:bigint,tag:bigint>>"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size -> and target: the sources by code point, null last, share all words by the repeating weights.

    A target stops at cap times its source's size, and the others share the excess by weight. In order of size to weight the
    stopped sources come first, so the common factor of the others follows from running sums. One row per source: the unpartitioned
    windows see as many rows as there are sources.
    """
    everything, by_name = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight"))
    s = s.withColumns({"total": F.sum("source_size").over(everything).cast("double"), "ratio": cap * F.col("source_size") / F.col("weight")})
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("factor", (F.col("total") - before) / rest).withColumn("place", F.row_number().over(by_ratio))
    # The first source that its share leaves below its limit; rounding of the sums must not leave none.
    free = F.col("factor") <= F.col("ratio") * (1 + 1e-12)
    common = F.coalesce(F.min_by(F.when(free, F.col("factor")), F.when(free, F.col("place"))).over(everything), F.max("ratio").over(everything))
    return s.select("source", "source_size", F.least(cap * F.col("source_size"), F.col("weight") * common).alias("target"))


def _fold(items: Column, item: str) -> Column:
    """array<item> -> struct(left: the item that is still a fraction or null, done: array<struct(item, bit)>)."""

    def step(acc: Column, b: Column) -> Column:
        a = acc["left"]
        up_a, down_b, down_a, up_b = (1 - a["p"]) * a["w"], b["p"] * b["w"], a["p"] * a["w"], (1 - b["p"]) * b["w"]
        up, down = F.least(up_a, down_b), F.least(down_a, up_b)  # words that may move to a, and from a
        rises = uniform(a["u"], b["u"]) * (up + down) < down
        a_ends = F.when(rises, up_a <= down_b).otherwise(down_a <= up_b)
        pa = F.when(rises, a["p"] + up / a["w"]).otherwise(a["p"] - down / a["w"])
        pb = F.when(rises, b["p"] - up / b["w"]).otherwise(b["p"] + down / b["w"])
        held = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        left = F.when(a_ends, b.withField("p", held(pb))).otherwise(a.withField("p", held(pa)))
        done = F.struct(F.when(a_ends, a).otherwise(b).alias("item"), F.when(a_ends == rises, 1).otherwise(0).cast("bigint").alias("bit"))
        return F.struct(left.alias("left"), F.concat(acc["done"], F.array(done)).alias("done"))

    first = F.struct(F.element_at(items, 1).alias("left"), F.array().cast(f"array<struct<item:{item},bit:bigint>>").alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), first, step)


def mix_counts(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, pattern: str = SPACE_WORD, seed: int = 7) -> DataFrame:
    """How often the mix takes each document. docs: doc_id, source, text; other columns are ignored.

    One row per distinct (doc_id, source, size, tag), tag being a hash of the text: m rows of docs, whole + bit copies in all,
    source_size, target. Null text has size 0, a null source is a source of its own (the last), null ids are ids like any other;
    repeated rows share the copies of their key. Documents of size 0 weigh nothing and are drawn alone. An empty table
    gives an empty result. The draws depend on values and seed alone, so reruns agree.
    """
    source_type, id_type = docs.schema["source"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64("text").alias("tag"))
    base = checkpoint(base.groupBy("doc_id", "source", "size", "tag").agg(F.count(F.lit(1)).alias("m")))
    targets = checkpoint(source_targets(base.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n")).drop("n"), weights, cap))
    named = broadcast_if_small(targets.withColumnRenamed("source", "of"))
    rows = base.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("exact", F.round(rate * F.col("m"), 12)).withColumn("whole", F.floor("exact")).withColumn("p", F.col("exact") - F.col("whole"))
    rows = rows.withColumn("u", F.xxhash64(F.lit(seed), "source", "doc_id", "size", "tag"))
    alone = rows.where("p = 0 or size = 0").withColumn("bit", F.when(uniform(F.col("u")) < F.col("p"), 1).otherwise(0).cast("bigint"))
    out = ["doc_id", "source", "size", "tag", "m", "whole", "bit"]
    parts = [alone.select(*out)]

    item_type = ITEM.format(id_type, source_type)
    key = F.struct("doc_id", "source", "size", "tag")
    level = rows.where("p > 0 and size > 0").select("source", F.struct((-F.col("size")).cast("double").alias("order"), "u", "p", F.col("size").cast("double").alias("w"), "m", "whole", key.alias("key")).alias("item"))
    counts = checkpoint(level.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    most = counts.agg(F.max("n")).first()[0] or 0
    level = level.join(broadcast_if_small(counts.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    depth = 0
    while most:
        chunks = F.ceil(F.col("n") / WIDTH)
        dealt = level.select("source", chunks.alias("n"), F.pmod(F.xxhash64(F.lit(depth), "item.u"), chunks).alias("chunk"), "item")
        folded = dealt.groupBy("source", "n", "chunk").agg(F.array_sort(F.collect_list("item")).alias("items")).select("source", "n", _fold(F.col("items"), item_type).alias("f"))
        folded = checkpoint(folded.select("source", "n", "f.left", "f.done"))
        parts.append(folded.select(F.explode("done").alias("d")).select("d.item.key.*", "d.item.m", "d.item.whole", "d.bit"))
        level, depth = folded.select("source", "n", F.col("left").alias("item")), depth + 1
        if most <= WIDTH:
            break
        most = -(-most // WIDTH)
    if depth:
        last = F.when(F.col("item.p") >= 0.5, 1).otherwise(0).cast("bigint")  # one document a source: the nearer end
        parts.append(level.select("item.key.*", "item.m", "item.whole", last.alias("bit")))
    counted = union_all(parts)
    return counted.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, pattern: str = SPACE_WORD, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of docs; see mix_counts for nulls, ties and repeats."""
    rows = mix_counts(docs, weights, cap, pattern, seed)
    rows = rows.withColumn("all", F.col("whole") + F.col("bit")).withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    copies = F.expr("all div m + if(place < all % m, 1, 0)")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("bigint").alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, pattern: str = SPACE_WORD, seed: int = 7) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, with its own columns and copy (0, 1, ...).

    A column of docs that is named copy is replaced.
    """
    counted = mix_counts(docs, weights, cap, pattern, seed)
    counted = counted.select(F.struct("doc_id", "source", "tag").alias("key"), "m", (F.col("whole") + F.col("bit")).alias("all"))
    kept = [c for c in docs.columns if c != "copy"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.struct("doc_id", "source", F.xxhash64("text").alias("tag")).alias("key"))
    # The join has dealt the rows by key already; numbering the rows of a key takes no further shuffle.
    rows = meet(rows, counted).withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("key")) - 1)
    rows = rows.withColumn("copies", F.expr("all div m + if(place < all % m, 1, 0)")).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).select("row.*", "copy")
