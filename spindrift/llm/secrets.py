"""Secret scans with corpus-wide ownership (operator 8), in DataFrame functions only.

Patterns find candidate credentials in the whole text of each document; their positions follow from the lengths of the matches
and of what lies between them. The hash of every candidate is counted over the corpus by distinct repository and owner:
a string that several owners hold is a copied example, one that a single owner holds and that looks live is that owner's credential.
Only hashes and positions are shuffled. The counts aggregate distinct (hash, owner, repository) before they meet by hash, so a
string in a third of all documents arrives as at most one row per owner and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint

#: Kinds in the order in which spans that start together are listed; owned spans come from the ownership counts.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A long run of key characters; it is a candidate if it has digits, both cases and many different characters.
GENERIC = r"[A-Za-z0-9+/_-]{20,}"
MIN_GROUP, MIN_DISTINCT = 6, 12
SPAN = "struct<start:bigint,kind:int,end:bigint,hash:string>"


def _spans(text: Column, pattern: str, kind: int, group: int, keep) -> Column:
    """All leftmost non-overlapping matches for which keep(value of the group), as array<SPAN>; positions in code points."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), F.split(text, pattern, -1).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["all"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.sha2(x["value"], 256).alias("hash"))
        return F.struct(end.alias("pos"), F.when(keep(x["value"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))
    # The last gap has no match behind it.
    return F.aggregate(F.filter(found, lambda x: x["all"].isNotNull()), start, step, lambda acc: acc["out"])


def candidates(text: Column) -> tuple[Column, Column]:
    """(base, more): array<SPAN> of the base kinds and of further candidates that overlap none of them; empty for null."""
    none = F.array().cast(f"array<{SPAN}>")
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    assign = F.when(named, _spans(text, ASSIGN, 0, 2, lambda v: F.length(v) >= MIN_GROUP)).otherwise(none)
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, 1, 0, lambda v: F.lit(True))).otherwise(none)
    hexed = F.when(text.rlike(HEX), _spans(text, HEX, 2, 0, lambda v: F.lit(True))).otherwise(none)
    live = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]") & (F.size(F.array_distinct(F.split(v, ""))) >= MIN_DISTINCT)
    generic = F.when(text.rlike(GENERIC), _spans(text, GENERIC, 3, 0, live)).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexed)), generic


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos of candidates (hash, owner, repo); a null owner or repo counts as one more."""
    pairs = found.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", example_owners: int = 2) -> DataFrame:
    """One row per row of docs: row (a struct of all columns but the text), row_id, base and added (array<SPAN>), n_owned, n_shared.

    base: the spans of the base kinds, whatever their owners. added: further live-looking strings of a single owner. n_owned and
    n_shared count a row's distinct candidate strings that fewer than example_owners owners hold, and those that more do. Null and
    empty texts have no spans; repeated rows are one repository if their repo is the same; null owners are one owner. An empty
    table gives an empty result. Rows keep their own columns in row, whatever their names.
    """
    c = lambda n: F.col(f"`{n}`")
    base, more = candidates(c(text))
    rows = docs.select(F.struct(*[c(n) for n in docs.columns if n != text]).alias("row"), c(owner).alias("owner"), c(repo).alias("repo"), base.alias("base"), more.alias("more"))
    apart = F.filter("more", lambda g: ~F.exists("base", lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"])))
    rows = checkpoint(rows.withColumn("more", apart).withColumn("row_id", F.monotonically_increasing_id()))
    each = rows.select("row_id", "owner", "repo", F.explode(F.concat("base", "more")).alias("span")).select("row_id", "owner", "repo", "span", F.col("span.hash").alias("hash"))
    known = ownership(each).select("hash", "n_owners")
    # One row per document and string meets the counts; a string of very many documents is split by AQE.
    judged = each.groupBy("row_id", "hash").agg(F.collect_list(F.when(F.col("span.kind") == 3, F.col("span"))).alias("more")).join(known, "hash")
    owned = F.col("n_owners") < example_owners
    judged = judged.groupBy("row_id").agg(F.flatten(F.collect_list(F.when(owned, F.col("more")))).alias("added"), F.count(F.when(owned, 1)).alias("n_owned"), F.count(F.when(~owned, 1)).alias("n_shared"))
    zero = F.lit(0).cast("bigint")
    out = rows.select("row", "row_id", "base").join(judged, "row_id", "left")
    return out.select("row", "row_id", "base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"), F.coalesce("n_owned", zero).alias("n_owned"), F.coalesce("n_shared", zero).alias("n_shared"))


def digest(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with each maximal run of spans replaced by the mark; null stays null."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        out = F.when(s["start"] >= acc["pos"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text)))
    return F.aggregate(F.array_sort(spans), start, step, rest)


def mask_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """docs with the base and owned spans of every text masked; rows without one stay as they are, whatever their columns' names.

    Null texts stay null; rows that share repo, owner and text are masked alike; an empty table gives an empty result.
    Base spans are found again where the text is; only the few documents with owned ones meet those by a join, without their text
    moving unless there are very many.
    """
    c = lambda n: F.col(f"`{n}`")
    key = F.struct(c(repo).alias("repo"), c(owner).alias("owner"), F.xxhash64(c(text)).alias("tag"))
    found = scan(docs.select(key.alias("key"), c(owner).alias("owner"), c(repo).alias("repo"), c(text).alias("text")), "text", "owner", "repo")
    owned = found.where(F.size("added") > 0).groupBy("row.key").agg(F.first("added").alias("added"))
    rows = docs.select(F.struct(*[c(n) for n in docs.columns]).alias("row"), key.alias("key")).join(broadcast_if_small(checkpoint(owned)), "key", "left")
    whole = F.col(f"row.`{text}`")
    rows = rows.withColumn("spans", F.concat(candidates(whole)[0], F.coalesce("added", F.array().cast(f"array<{SPAN}>"))))
    new = F.when(F.size("spans") > 0, masked(whole, F.col("spans"))).otherwise(whole)
    return rows.select(*[new.alias(n) if n == text else F.col(f"row.`{n}`") for n in docs.columns])
