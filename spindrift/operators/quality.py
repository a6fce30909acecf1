"""Coverage, status and completion reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMIT = ["repo", "commit_no"]


def file_status(lines: Column, error: Column | None = None) -> Column:
    """missing (no count), empty, error or ok."""
    out = F.when(lines.isNull(), "missing").when(lines == 0, "empty").otherwise("ok")
    return F.when(F.coalesce(error, F.lit(False)), "error").otherwise(out) if error is not None else out


def coverage(commits: DataFrame, counts: DataFrame) -> DataFrame:
    """repo (null: all together), total, ok, missing, empty, error and percent ok, rounded down.

    commits: repo, commit_no; counts: repo, commit_no, n and maybe error (boolean), where an item file was found.
    """
    error = F.col("error") if "error" in counts.columns else None
    rows = commits.select(*COMMIT).distinct().join(counts, COMMIT, "left").withColumn("status", file_status(F.col("n"), error))
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = rows.groupingSets([["repo"], []], "repo").agg(F.count(F.lit(1)).alias("total"), is_("ok"), is_("missing"), is_("empty"), is_("error"))
    return out.withColumn("percent", F.when(F.col("total") == 0, 0).otherwise(F.floor(100 * F.col("ok") / F.col("total"))).cast("int"))


def coverage_issues(commits: DataFrame, counts: DataFrame) -> DataFrame:
    rows = commits.select(*COMMIT).distinct().join(counts, COMMIT, "left")
    error = F.col("error") if "error" in counts.columns else None
    return rows.withColumn("status", file_status(F.col("n"), error)).where("status <> 'ok'").select(*COMMIT, "status")


def repo_status(configured: DataFrame, present: DataFrame) -> DataFrame:
    """repo, status: downloaded, missing (configured only) or untracked (present only)."""
    a = configured.select("repo", F.lit(True).alias("c")).distinct()
    b = present.select("repo", F.lit(True).alias("p")).distinct()
    return a.join(b, "repo", "full_outer").select("repo", F.when(F.col("c") & F.col("p"), "downloaded").when(F.col("c"), "missing").otherwise("untracked").alias("status"))


def configured(repositories: DataFrame) -> DataFrame:
    """Entries with a name."""
    return repositories.where(F.coalesce("name", F.lit("")) != "").select(F.col("name").alias("repo"), "url")


def stage_completion(commits: DataFrame, done: DataFrame) -> DataFrame:
    """repo, commits, done, complete: whether every commit that the stage expects has been done; none expected is not complete.

    done: repo, commit_no of what the stage has written, empty results included.
    """
    rows = commits.select(*COMMIT).distinct().join(done.select(*COMMIT, F.lit(True).alias("d")).distinct(), COMMIT, "left")
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.count_if(F.col("d")).alias("done")).withColumn("complete", F.col("commits") == F.col("done"))


def completion_percent(status: DataFrame) -> DataFrame:
    """Of all repos, the share that is complete."""
    return status.agg(F.count(F.lit(1)).alias("repos"), F.count_if("complete").alias("complete")).withColumn("percent", F.when(F.col("repos") == 0, 0.0).otherwise(F.round(100.0 * F.col("complete") / F.col("repos"), 1)))


def not_done(rows: DataFrame, done: DataFrame, keys: list[str] = COMMIT, force: bool = False) -> DataFrame:
    """The rows whose keys have not been done; all of them by force."""
    return rows if force else rows.join(done.select(*keys).distinct(), keys, "left_anti")


def outputs_per_stage(outputs: dict[str, DataFrame]) -> DataFrame:
    """stage, repo, n over the named outputs."""
    parts = [df.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name)) for name, df in outputs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("stage", "repo", "n")


def run_status(commits: DataFrame, ready: DataFrame, before: DataFrame, rows: DataFrame, broken: Column) -> DataFrame:
    """repo, commit_no, status, reason, rows of a stage's run over commits.

    skipped: what the stage reads is not there (not among the ready), or it was done before; error: a row of the commit is broken;
    success: all others, with as many rows as they gave, maybe none.
    """
    keys = ["repo", "commit_no"]
    mark = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(broken).alias("bad"))
    out = commits.select(*keys).distinct().join(mark(ready, "ready"), keys, "left").join(mark(before, "before"), keys, "left").join(n, keys, "left")
    reason = F.when(F.col("ready").isNull(), "nothing to read").when(F.col("before").isNotNull(), "done before").when(F.col("bad") > 0, F.concat(F.col("bad"), F.lit(" broken rows")))
    status = F.when(F.col("ready").isNull() | F.col("before").isNotNull(), "skipped").when(F.col("bad") > 0, "error").otherwise("success")
    return out.select(*keys, status.alias("status"), reason.alias("reason"), F.when(status == "success", F.coalesce("n", F.lit(0))).otherwise(0).alias("rows"))
