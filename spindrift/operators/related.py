"""Which changed elements belong together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import text

COMMIT = ["repo", "commit_no"]
#: Letters to a gram of a name.
GRAM = 3
#: Short names up to which all of them go to every task, so that the parts of the others aren't dealt.
MOST_SHORT = 200_000
#: Active elements under which, and share settled by a round under which, a scan in order takes over from the rounds.
FEW, SLOW = 20_000, 0.1


def file_of(ast_id: Column) -> Column:
    return F.when(F.contains(ast_id, F.lit("::")), F.substring_index(ast_id, "::", 1))


def _grams(name: Column, length: int) -> Column:
    """The distinct parts of a name that are so long."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(name) - (length - 1), F.lit(1)))
    return F.when(F.char_length(name) >= length, F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, length)))).otherwise(F.array().cast("array<string>"))


def containing(names: DataFrame, scope: list[str], name: str = "name") -> DataFrame:
    """scope, part, whole: pairs of names of a scope of which one contains the other, each name with itself included.

    An index has the grams of all names. A name of GRAM letters or more is looked up by its rarest gram, whose names are then
    tested; a shorter one by itself, which is all that it asks of a name. So a pair is made only of names that share their rarest part. Null
    names and scopes take no part. Only short names that were counted are sent to every task: the hints keep the others from being sent
    there by way of the driver, as Spark takes their size from that of the compressed files, far under what they take in memory.
    """
    own = storage.checkpoint(names.select(*scope, F.col(name).alias("whole")).dropna().distinct())
    keys = [*scope, "gram"]
    long = own.where(F.char_length("whole") >= GRAM).select(*scope, "whole", F.posexplode(_grams(F.col("whole"), GRAM)).alias("at", "gram"))
    # How many names have a gram and where it stands are one number: its least is kept by a hash table, without sorting the grams of all names.
    seen = (F.col("n") * (1 << 31) + F.col("at")).alias("seen")
    rarest = long.join(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).hint("merge"), keys).select(*scope, "whole", seen).groupBy(*scope, "whole").agg(F.min("seen").alias("seen"))
    probes = rarest.select(*scope, F.get(_grams(F.col("whole"), GRAM), (F.col("seen") % (1 << 31)).cast("int")).alias("gram"), F.col("whole").alias("part"))
    found = long.join(probes.hint("merge"), keys).where(F.contains("whole", "part"))
    short = storage.checkpoint(own.where(F.char_length("whole") < GRAM).select(*scope, F.col("whole").alias("part")))
    sent = F.broadcast if short.count() <= MOST_SHORT else lambda df: df.hint("merge")
    parts = F.array_union(F.array(F.lit("")), F.flatten(F.array(*[_grams(F.col("whole"), n) for n in range(1, GRAM)])))
    small = own.join(sent(short.select(*scope).distinct()), scope, "left_semi").select(*scope, "whole", F.explode(parts).alias("part")).join(sent(short), [*scope, "part"])
    return found.select(*scope, "part", "whole").unionByName(small.select(*scope, "part", "whole"))


def related_pairs(elements: DataFrame, group: list[str] = COMMIT) -> DataFrame:
    """Pairs (a, b), a < b, of elements (ast_id, operation_type, retrieved_labels) that are related.

    Either names the other in its labels, or both are in one file with the same operation and one short name contains the other.
    The first meets by an equi join on the named id; the second by the grams of the distinct names (``containing``). As there, no side
    of these joins is sent to every task.
    """
    scope = [*group, "file", "op"]
    e = elements.select(*group, F.col("ast_id").alias("a"), file_of(F.col("ast_id")).alias("file"), text.last_segment(F.col("ast_id")).alias("name"), F.col("operation_type").alias("op"))
    named = elements.select(*group, F.col("ast_id").alias("x"), F.explode("retrieved_labels").alias("y")).where("x <> y")
    known = elements.select(*group, F.col("ast_id").alias("y"))
    by_label = named.join(known.hint("merge"), [*group, "y"]).select(*group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    held = e.select(*scope, F.col("name").alias("whole"), F.col("a").alias("y"))
    near = containing(e, scope).join(e.withColumnRenamed("name", "part").hint("merge"), [*scope, "part"]).join(held.hint("merge"), [*scope, "whole"]).where(F.col("a") != F.col("y"))
    return near.select(*group, F.least("a", "y").alias("a"), F.greatest("a", "y").alias("b")).unionByName(by_label).distinct()


def _scan(rows: DataFrame, scope: list[str]) -> DataFrame:
    """scope, ast_id, seed by one pass over the elements (scope, ast_id, tokens, left) of a scope in order.

    An element joins the first element that is open and shares a token with it, else it opens itself with the places that it has left.
    While an element is open no other opens with one of its tokens, so the state is one element per token. Rows stream through; a
    scope's elements are never held together.
    """
    kinds = [rows.schema[c].dataType.simpleString() for c in scope]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_at, left, tokens_of = None, {}, {}, {}
        for f in frames:
            seeds = []
            for *key, i, tokens, places in f[[*scope, "ast_id", "tokens", "left"]].itertuples(index=False):
                if key != now:
                    now, open_at, left, tokens_of = key, {}, {}, {}
                seed = min((open_at[t] for t in tokens if t in open_at), default=None)
                if seed is None:
                    seed = i
                    if places > 0:
                        left[i], tokens_of[i] = places, list(tokens)
                        open_at.update(dict.fromkeys(tokens_of[i], i))
                else:
                    left[seed] -= 1
                    if not left[seed]:
                        del left[seed]
                        for t in tokens_of.pop(seed):
                            del open_at[t]
                seeds.append(seed)
            yield f[[*scope, "ast_id"]].assign(seed=seeds)

    dealt = rows.repartition(*scope).sortWithinPartitions(*scope, "ast_id")
    return dealt.mapInPandas(run, ", ".join(f"`{c}` {k}" for c, k in zip(scope, kinds, strict=True)) + ", ast_id string, seed string")


def _round(active: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a round settles (scope, ast_id, seed), and the elements (scope, ast_id, tokens, left) that stay active.

    An element that is the first active one of all its tokens can be claimed by nobody: it is open. It takes the next elements of its
    tokens, as many as it has places, if nobody before it could claim them. It stays active while it has places left and others share
    its tokens.
    """
    one = [*scope, "ast_id"]
    pairs = active.select(*one, "left", F.explode("tokens").alias("token"))
    firsts = pairs.groupBy(*scope, "token").agg(F.min("ast_id").alias("first"))
    of = storage.checkpoint(pairs.join(firsts, [*scope, "token"]).groupBy(*one, "left").agg(F.min("first").alias("least")))
    opened = of.where("ast_id = least").select(*scope, F.col("ast_id").alias("seed"), "left")
    place = F.row_number().over(Window.partitionBy(*scope, "token").orderBy("ast_id"))
    most = active.agg(F.max("left")).first()[0] + 1
    near = pairs.drop("left").withColumn("place", place).where(F.col("place") <= most).drop("place")
    lists = near.join(firsts.withColumnRenamed("first", "seed"), [*scope, "token"]).where("ast_id <> seed").join(opened, [*scope, "seed"]).select(*one, "seed", "left").distinct()
    turn = F.row_number().over(Window.partitionBy(*scope, "seed").orderBy("ast_id"))
    claimed = storage.checkpoint(lists.withColumn("turn", turn).where("turn <= left").join(of.select(*one, "least"), one).where("least = seed").select(*one, "seed"))
    spent = claimed.groupBy(*scope, F.col("seed").alias("ast_id")).agg(F.count(F.lit(1)).alias("spent"))
    rest = active.join(claimed.select(*one), one, "left_anti").join(spent, one, "left").withColumn("left", F.col("left") - F.coalesce("spent", F.lit(0))).drop("spent")
    shared = _shared(rest.where("left > 0"), scope)
    return claimed, shared


def _shared(rows: DataFrame, scope: list[str]) -> DataFrame:
    """The rows without tokens that no other one has, and only those that keep any."""
    pairs = rows.select(*scope, "ast_id", "left", F.explode("tokens").alias("token"))
    held = pairs.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return pairs.join(held, [*scope, "token"], "left_semi").groupBy(*scope, "ast_id", "left").agg(F.collect_set("token").alias("tokens"))


def related_groups(elements: DataFrame, group: list[str] = COMMIT, most: int = 4, few: int = FEW, slow: float = SLOW) -> DataFrame:
    """group_no and place of each element: greedily, in the order of ids, an element takes later ones of its file that name it, that
    it names, or that share a label with it, up to most.

    Elements are related if they share a token, a token being a label or the own id. In rounds, all elements that no earlier one can
    claim any more take theirs at once, and what is settled leaves; where few are left, or a round settles a small share only (long
    chains), one pass in order settles the rest. Either way gives the sequential result. Ids that repeat in a commit are one element
    with the labels of all its rows; ids without a file and null labels are alone; null ids are left out.
    """
    rows = elements.select(*group, "ast_id", F.coalesce("retrieved_labels", F.array().cast("array<string>")).alias("labels")).where("ast_id is not null")
    ids = rows.select(*group, "ast_id").distinct()
    scope = [*group, "file"]
    tokens = F.filter(F.array_distinct(F.concat(F.array("ast_id"), "labels")), lambda t: t.isNotNull())
    joined = rows.select(*group, file_of(F.col("ast_id")).alias("file"), "ast_id", tokens.alias("tokens")).where("file is not null").withColumn("left", F.lit(most - 1).cast("bigint"))
    active, settled = storage.checkpoint(_shared(joined.select(*scope, "ast_id", "left", F.explode("tokens").alias("t")).groupBy(*scope, "ast_id", "left").agg(F.collect_set("t").alias("tokens")), scope)), None
    n = active.count()
    while n and n > few:
        claimed, rest = _round(active, scope)
        settled = claimed if settled is None else settled.unionByName(claimed)
        active, before = storage.checkpoint(rest), n
        n = active.count()
        if before - n < slow * before:
            break
    if n:
        last = _scan(active, scope).where("ast_id <> seed")
        settled = last if settled is None else settled.unionByName(last)
    if settled is None:
        placed = ids.withColumn("seed", F.col("ast_id"))
    else:
        placed = ids.join(settled.select(*group, "ast_id", "seed"), [*group, "ast_id"], "left").withColumn("seed", F.coalesce("seed", "ast_id"))
    number = F.dense_rank().over(Window.partitionBy(*group).orderBy("seed")) - 1
    place = F.row_number().over(Window.partitionBy(*group, "seed").orderBy("ast_id")) - 1
    return placed.select(*group, "ast_id", number.alias("group_no"), place.alias("place"))
