"""Benchmark decontamination by a stored positional inverted index (operator 4), in DataFrame functions only.

One scan of the corpus writes the index: the postings (document, term, position) of every term that the benchmark has, and for each
document a posting of the empty term at its number of words. The benchmark is then looked up in the index alone:

1. Corpus counts of the terms, taken from the index, rank the words of every benchmark window.
2. The posting list of the rarest word, moved by the word's place in the item, gives the alignments (document, item, start) at which the
   window could stand. It is intersected with the list of the second rarest word, moved by its own place.
3. For the alignments that are left the lists of all other words of the item are intersected in the same way. Runs of places that are
   all met, as long as a window, are phrase matches.

Proximity matches hold most words of a window near their places, in any order. As many of a window's rarest words are looked up as
one more than may be missing, each without the second one's condition.

The index goes to the shared folder and is removed when the matches have been checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, ascii_lower, broadcast_if_small, checkpoint, store, words

WINDOW = 13
#: Words of all items up to which the items themselves are broadcast to the alignments.
BROADCAST_WORDS = 4_000_000


def doc_words(text: Column) -> Column:
    return words(ascii_lower(text), ALNUM_WORD)


def doc_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A document's identity: rows that share it have the same words, so they share their matches."""
    return F.struct(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tag"))


def bench_items(bench: DataFrame) -> DataFrame:
    """item_no, ids, words, n: the distinct word sequences of the benchmark; items without words are left out."""
    read = bench.select(F.col("item_id").cast("string").alias("id"), doc_words(F.col("text")).alias("words"))
    same = read.groupBy("words").agg(F.collect_set("id").alias("ids"))
    return checkpoint(same.where(F.size("words") > 0).select(F.monotonically_increasing_id().alias("item_no"), "ids", "words", F.size("words").alias("n")))


def postings(docs: DataFrame, items: DataFrame) -> DataFrame:
    """key, term, pos: the index of docs (doc_id, text) for the words of items. Term '' stands at each row's number of words."""
    terms = items.select(F.explode("words").alias("term")).unionByName(items.sparkSession.createDataFrame([("",)], "term string")).distinct()
    tokens = docs.select(doc_key().alias("key"), F.concat(doc_words(F.col("text")), F.array(F.lit(""))).alias("tokens"))
    # posexplode_outer: the inner form would add a filter that takes the words of every text a second time.
    return tokens.select("key", F.posexplode_outer("tokens").alias("pos", "term")).join(broadcast_if_small(checkpoint(terms)), "term").select("key", "term", "pos")


def term_counts(index: DataFrame) -> DataFrame:
    """term, n: how often the corpus has each word of the benchmark that it has at all."""
    return index.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def ranked_windows(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_no, n, a, r: every window, its first place and its distinct words (df, pos, term), the rarest first.

    A word stands at its first place in the window; words that the corpus lacks come first, with df 0. Ties go by place.
    """
    placed = items.select("item_no", "n", F.posexplode("words").alias("pos", "term")).join(counts.withColumnRenamed("n", "df"), "term", "left")
    ranked = placed.groupBy("item_no", "n").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("df", F.lit(0).cast("bigint")).alias("df"), "term"))).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - window + 1, F.lit(1)))
    each = ranked.select("item_no", "n", "w", F.explode(starts).alias("s")).select("item_no", "n", (F.col("s") - 1).alias("a"), F.slice("w", F.col("s"), F.lit(window)).alias("part"))
    terms = F.transform("part", lambda x: x["term"])
    firsts = F.filter("part", lambda x, i: F.array_position(terms, x["term"]) == i + 1)
    return each.select("item_no", "n", "a", F.array_sort(F.transform(firsts, lambda x: F.struct(x["df"].alias("df"), x["pos"].alias("pos"), x["term"].alias("term")))).alias("r"))


def lookups(ranked: DataFrame) -> DataFrame:
    """term, item_no, n, at, at2, term2: the rarest and second rarest word of every window whose words the corpus has."""
    rare, then = F.element_at("r", 1), F.element_at("r", F.least(F.size("r"), F.lit(2)))
    found = ranked.where(F.element_at("r", 1)["df"] > 0)
    return found.select(rare["term"].alias("term"), "item_no", "n", rare["pos"].alias("at"), then["pos"].alias("at2"), then["term"].alias("term2")).distinct()


def _of_keys(index: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of the documents that found has."""
    return index.join(broadcast_if_small(checkpoint(found.select("key").distinct())), "key", "left_semi")


def phrases(index: DataFrame, items: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, item_no, start0, a, b: on the alignment start0 the places a to b of the item are all met; found: lookups()."""
    start0 = (F.col("pos") - F.col("at")).alias("start0")
    rare = index.join(broadcast_if_small(found), "term").select("key", "item_no", start0, "term2", (F.col("pos") - F.col("at") + F.col("at2")).alias("pos2"))
    rare = checkpoint(rare.distinct())
    here = _of_keys(index, rare)
    both = rare.join(here.select("key", F.col("term").alias("term2"), F.col("pos").alias("pos2")), ["key", "term2", "pos2"], "left_semi")
    aligned = checkpoint(both.select("key", "item_no", "start0").distinct())
    total = items.agg(F.sum("n")).first()[0] or 0
    listed = items.select("item_no", "n", "words")
    wanted = aligned.join(F.broadcast(listed) if total <= BROADCAST_WORDS else listed, "item_no")
    wanted = wanted.select("key", "item_no", "start0", "n", F.posexplode("words").alias("i", "term")).withColumn("pos", F.col("start0") + F.col("i"))
    met = wanted.join(_of_keys(index, aligned), ["key", "term", "pos"]).groupBy("key", "item_no", "start0", "n").agg(F.collect_set("i").alias("met"))
    apart = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("met"))
    met = met.withColumn("edges", F.concat(F.array(F.lit(-1)), apart, F.array(F.col("n"))))
    runs = F.transform(F.sequence(F.lit(0), F.size("edges") - 2), lambda k: F.struct((F.get("edges", k) + 1).alias("a"), F.get("edges", k + 1).alias("b")))
    runs = F.filter(runs, lambda r: r["b"] - r["a"] >= F.least(F.lit(window), F.col("n")))
    return met.select("key", "item_no", "start0", F.explode(runs).alias("r")).select("key", "item_no", "start0", "r.a", "r.b")


def proximities(index: DataFrame, ranked: DataFrame, exact: DataFrame, window: int, slack: int, near: float) -> DataFrame:
    """key, item_no, a, start, end: stretches around a window's place that hold at least the share near of its distinct words.

    The window's place is given by one of its rarest words; alignments that exact has as phrases are left out.
    """
    missing = int((1 - near) * window + 1e-9)
    rare = ranked.select("item_no", "a", F.transform("r", lambda x: x["term"]).alias("terms"), F.explode(F.slice("r", 1, missing + 1)).alias("x")).select("item_no", "a", "terms", F.col("x.term").alias("term"), F.col("x.pos").alias("at"))
    found = index.join(broadcast_if_small(checkpoint(rare)), "term").select("key", "item_no", "a", "terms", (F.col("pos") - F.col("at")).alias("start0")).distinct()
    found = checkpoint(found.join(exact.select("key", "item_no", "start0").distinct(), ["key", "item_no", "start0"], "left_anti"))
    low = F.greatest(F.col("start0") + F.col("a") - slack, F.lit(0))
    found = found.select("key", "item_no", "a", "terms", low.alias("start"), (F.col("start0") + F.col("a") + window + slack).alias("stop"))
    here = _of_keys(index, found)
    ends = here.where("term = ''").select("key", F.col("pos").alias("n_words")).distinct()
    held = found.select("key", "item_no", "a", "start", "stop", F.size("terms").alias("of"), F.explode("terms").alias("term")).join(here, ["key", "term"])
    held = held.where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))).groupBy("key", "item_no", "a", "start", "stop", "of").agg(F.count_distinct("term").alias("has"))
    held = held.where(F.col("has") >= F.col("of") * near - 1e-9).join(ends, "key")
    return held.select("key", "item_no", "a", "start", F.least("stop", "n_words").alias("end"))


def _matches(index: DataFrame, items: DataFrame, window: int, slack: int | None, near: float) -> DataFrame:
    ranked = checkpoint(ranked_windows(items, term_counts(index), window))
    exact = phrases(index, items, checkpoint(lookups(ranked)), window)
    if slack is not None:
        exact = checkpoint(exact)
    place = lambda name: (F.col("start0") + F.col(name)).alias({"a": "start", "b": "end"}[name])
    out = exact.select("key", "item_no", F.lit("phrase").alias("kind"), place("a"), place("b"), F.col("a").alias("item_start"))
    if slack is not None:
        close = proximities(index, ranked, exact, window, slack, near)
        out = out.unionByName(close.select("key", "item_no", F.lit("proximity").alias("kind"), "start", "end", F.col("a").alias("item_start")))
    return out.distinct().join(items.select("item_no", "ids"), "item_no").select("key", "ids", "kind", "start", "end", "item_start")


def matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slack: int | None = None, near: float = 0.8) -> DataFrame:
    """key (doc_id, tag), ids, kind, start, end, item_start: matches of benchmark items in docs (doc_id, text), by word positions.

    phrase: a maximal run of at least window equal words (all words of a shorter item) on one alignment. With slack, also
    proximity: a stretch of window words and slack more to either side, placed by one of the window's rarest words, in which the share
    near or more of its different words occur, but no phrase on that alignment. Null and empty texts match nothing; ids lists the item
    ids, as strings, that share the words (null ids are left out); rows that share id and text share their matches, which are listed
    once. Other columns of docs and bench are ignored; either may be empty.
    """
    items = bench_items(bench)
    index, drop = store(postings(docs, items), "index")
    found = checkpoint(_matches(index, items, window, slack, near))
    drop()
    return found


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted), contaminated, and key: one row per row of docs, from the phrase matches.

    A word is hit if a phrase match covers it; contaminated: any hit, and hits are a twentieth of the words or more. See matches()
    for nulls, ties and repeats; documents without words have zeros.
    """
    items = bench_items(bench)
    index, drop = store(postings(docs, items), "index")
    found = _matches(index, items, window, None, 0.0)
    found = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"))
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["to"], s["end"]).alias("to"), (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"))
    found = found.select("key", F.aggregate("spans", zero, step, lambda acc: acc["n"]).cast("bigint").alias("n_hit"), "item_ids")
    counted = index.where("term = ''").select("key", F.col("pos").cast("bigint").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    out = counted.join(found, "key", "left").select(F.col("key"), F.col("key.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"))
    out = checkpoint(out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))
    drop()
    return out


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated rows, columns and values as they were, whatever their names."""
    bad = contamination(docs, bench, window).where("contaminated").select("key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key().alias("key"))
    return rows.join(broadcast_if_small(checkpoint(bad)), "key", "left_anti").select("row.*")
