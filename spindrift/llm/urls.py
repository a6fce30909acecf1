"""URL rules by a sort-merge sweep over reversed hosts (operator 9).

The host of a rule, its labels reversed and each closed by a dot (``www.example.com`` -> ``com.example.www.``), is a prefix of
the key of every host at or below it, so a rule covers one interval of the sorted keys, and two intervals are nested or apart.
Rules and urls are sorted together by key; a rule opens an interval and carries the stack of all rules that are open when it
starts. At a url, the last rule opened before it therefore carries every rule that can be open there, and the url's key and
path say which of them are. The sweep is one window over sorted rows. Urls are dealt to the sweeps in turn and every sweep gets
all rules, so a host that holds a third of the urls is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules beyond this number are refused: each sweep holds all of them.
MAX_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    h = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def with_stacks(rules: DataFrame) -> DataFrame:
    """One row per distinct rule host: key and stack, the rules of this host and of all hosts above it.

    rules: host, path, verdict. Rows with a null in any of them are ignored; of equal (host, path) block wins over allow.
    """
    r = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    r = r.select(host_key(F.col("host")).alias("key"), F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("host_n"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("r"))
    own = r.groupBy("key").agg(F.collect_list("r").alias("own"))
    # A host's ancestors are the prefixes of its key that end in a dot: an equi join, one row per label.
    labels = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("key", r"\.")) - 1), lambda i: F.concat(F.call_function("substring_index", F.col("key"), F.lit("."), i), F.lit(".")))).alias("up"))
    up = own.select(F.col("key").alias("up"), F.col("own").alias("above"))
    return labels.join(up, "up").groupBy("key").agg(F.flatten(F.collect_list(F.transform("above", lambda x: F.struct(F.col("up").alias("up"), x.alias("r"))))).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """All columns of pages and host, path, rule, verdict (columns of these names are replaced).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, at equal length that of the
    longer host. No rule: rule is null and verdict the default. Null, empty and malformed urls have
    an empty host and path. Repeated rows stay; an empty table gives an empty result.
    """
    if (n_rules := rules.limit(max_rules + 1).count()) > max_rules:
        raise ValueError(f"more than {max_rules} rules; judge with blocks of rules")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    points = pages.select(F.struct(*kept).alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    points = points.withColumn("key", host_key(F.col("host")))
    # As many sweeps as shuffle partitions: more rows make larger sorts, not larger groups of one key.
    sweeps = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = points.withColumn("sweep", F.pmod(F.monotonically_increasing_id(), F.lit(sweeps)).cast("int"))
    starts = with_stacks(rules).withColumn("sweep", F.explode(F.sequence(F.lit(0), F.lit(sweeps - 1))))
    events = points.withColumn("is_url", F.lit(1)).unionByName(starts.withColumn("is_url", F.lit(0)), allowMissingColumns=True)
    opened = Window.partitionBy("sweep").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("open", F.last("stack", ignorenulls=True).over(opened)).where("is_url = 1")
    fits = F.filter("open", lambda s: F.startswith(F.col("key"), s["up"]) & F.startswith(F.col("path"), s["r"]["path"]))
    best = F.array_max(F.transform(fits, lambda s: F.struct(s["r"]["n"].alias("n"), s["r"]["host_n"].alias("host_n"), s["r"]["verdict"].alias("verdict"), s["r"]["rule"].alias("rule"))))
    judged = swept.select("row.*", "host", "path", best.alias("best"))
    return judged.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
