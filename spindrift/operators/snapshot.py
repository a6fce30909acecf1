"""Snapshots of items per commit: last row per id, consecutive commits, and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textdiff

KEYS = ["repo", "commit_no", "id"]


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by the order columns. Rows with a null in any key are left out. Aggregates before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return kept.select(*keys, "row.*").select(*rows.columns)


def id_collisions(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*(keys or KEYS)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def number_commits(commits: DataFrame, order: list[Column | str], newest: int | None = None) -> DataFrame:
    """commit_no from 1 in the given order within a repo; with newest, only that many of the last, numbered again from 1."""
    ordered = Window.partitionBy("repo").orderBy(*order)
    out = commits.withColumn("commit_no", F.row_number().over(ordered))
    if newest is None:
        return out
    total = F.max("commit_no").over(Window.partitionBy("repo"))
    return out.withColumn("skip", F.greatest(total - newest, F.lit(0))).where(F.col("commit_no") > F.col("skip")).withColumn("commit_no", F.col("commit_no") - F.col("skip")).drop("skip")


def neighbours(commits: DataFrame) -> DataFrame:
    """repo, commit_no, prev_no, next_no: the adjacent commits that exist, so gaps are bridged."""
    w = Window.partitionBy("repo").orderBy("commit_no")
    return commits.select("repo", "commit_no").distinct().select("repo", "commit_no", F.lag("commit_no").over(w).alias("prev_no"), F.lead("commit_no").over(w).alias("next_no"))


def previous_snapshot(items: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Each commit's predecessor's items, under the commit's own number; a view, nothing is copied."""
    near = neighbours(commits if commits is not None else items).where("next_no is not null").select("repo", "commit_no", "next_no")
    return items.join(near, ["repo", "commit_no"]).withColumn("commit_no", F.col("next_no")).drop("next_no")


def changes(items: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """The history of items as far as it changes: the columns of items and gone.

    An item has a row at each commit where it appears or differs in any column from the commit before, and a row that says gone, all
    else being null, at the first commit without it. So the size follows the changes, not commits times items, and new commits only add
    rows. ids are unique per commit (last_wins). Pass commits if some have no items at all.
    """
    near = neighbours(commits if commits is not None else items)
    w = Window.partitionBy("repo", "id").orderBy("commit_no")
    rest = [c for c in items.columns if c not in KEYS]
    body = F.struct(*rest)
    rows = items.select(*KEYS, body.alias("body")).join(near, ["repo", "commit_no"])
    rows = rows.select("*", F.lag(F.struct("commit_no", "body")).over(w).alias("old"), F.lead("commit_no").over(w).alias("then"))
    stays = (F.col("old.commit_no") == F.col("prev_no")) & F.col("old.body").eqNullSafe(F.col("body"))
    row = lambda no, gone, what: F.struct(F.col(no).alias("commit_no"), F.lit(gone).alias("gone"), what.alias("body"))
    here = F.when(~F.coalesce(stays, F.lit(False)), row("commit_no", False, F.col("body")))
    left = F.when(F.col("next_no").isNotNull() & ~F.col("then").eqNullSafe(F.col("next_no")), row("next_no", True, F.when(F.lit(False), F.col("body"))))
    out = rows.select("repo", "id", F.explode(F.array_compact(F.array(here, left))).alias("c"))
    return out.select("repo", F.col("c.commit_no").alias("commit_no"), "id", *[F.col(f"c.body.`{c}`").alias(c) for c in rest], F.col("c.gone").alias("gone")).select(*items.columns, "gone")


def intervals(history: DataFrame) -> DataFrame:
    """The items of a history (changes) with valid_from in place of commit_no and valid_to, the first commit at which they are no
    more so; null if they still are."""
    w = Window.partitionBy("repo", "id").orderBy("commit_no")
    return history.withColumn("valid_to", F.lead("commit_no").over(w)).where("not gone").drop("gone").withColumnRenamed("commit_no", "valid_from")


def snapshots(spans: DataFrame, commits: DataFrame, back: int = 0) -> DataFrame:
    """The items of each commit from their intervals; with back, those of so many commits before, under the commit's own number.

    Commits are counted through in their repo and an interval is spread over the counts that it covers, so no item is tested against
    a commit at which it isn't valid.
    """
    order = Window.partitionBy("repo").orderBy("commit_no")
    numbered = commits.select("repo", "commit_no").distinct().withColumn("n", F.row_number().over(order))
    last = numbered.groupBy("repo").agg(F.max("n").alias("last"))
    at = lambda c, n: numbered.select("repo", F.col("commit_no").alias(c), F.col("n").alias(n))
    placed = spans.join(at("valid_from", "first"), ["repo", "valid_from"]).join(at("valid_to", "end"), ["repo", "valid_to"], "left").join(last, "repo")
    stop = F.least(F.coalesce("end", F.col("last") + 1) - 1 + back, "last")
    held = placed.where(F.col("first") + back <= stop).withColumn("n", F.explode(F.sequence(F.col("first") + back, stop)))
    return held.drop("valid_from", "valid_to", "first", "end", "last").join(numbered, ["repo", "n"]).drop("n")


def same_imports(a: Column, b: Column) -> Column:
    """Imports compared as sets: their order in a record has no meaning."""
    norm = lambda c: F.array_sort(F.array_distinct(c))
    return norm(a).eqNullSafe(norm(b))


_CHANGE = ("status", "code_changed", "imports_changed", "before_code", "after_code", "before_imports", "after_imports")


def _change(status: str, **of: Column) -> Column:
    """What a diff says of an item; null where nothing is given."""
    none, no_list, no_flag = (F.lit(None).cast(t) for t in ("string", "array<string>", "boolean"))
    fields = dict(zip(_CHANGE[1:], (no_flag, no_flag, none, none, no_list, no_list), strict=True)) | of
    return F.struct(F.lit(status).alias("status"), *[c.alias(n) for n, c in fields.items()])


def _modified(old: Column, code: Column, imports: Column) -> Column:
    """The change from an item (code, imports) to what it is now; null if both are equal."""
    code_changed = ~code.eqNullSafe(old["code"])
    imports_changed = ~same_imports(imports, old["imports"])
    listed = lambda c: F.when(imports_changed, c)
    return F.when(code_changed | imports_changed, _change("modified", code_changed=code_changed, imports_changed=imports_changed, before_code=old["code"], after_code=code, before_imports=listed(old["imports"]), after_imports=listed(imports)))


def snapshot_diff(items: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """repo, commit_no, id, file, kind, status, code_changed, imports_changed, before_code, after_code, before_imports, after_imports.

    Against the commit before: added, removed, or modified if code or imports differ (null-safe); equal items give no row. file and
    kind are the new item's, for removed ones the old one's; the imports stand on modified rows whose imports changed. ids are
    unique per commit (last_wins). One shuffle by (repo, id): an item meets its own next occurrence in a window, instead of every
    snapshot being joined to the one before. Pass commits if some have no items at all.
    """
    near = neighbours(commits if commits is not None else items)
    w = Window.partitionBy("repo", "id").orderBy("commit_no")
    rows = items.select(*KEYS, "file", "kind", "code", "imports").join(near, ["repo", "commit_no"])
    rows = rows.select("*", F.lag(F.struct("commit_no", "code", "imports")).over(w).alias("old"), F.lead("commit_no").over(w).alias("then"))
    met = F.col("old.commit_no") == F.col("prev_no")
    row = lambda no, c: F.when(c.isNotNull(), F.struct(no.alias("commit_no"), c.alias("c")))
    change = F.when(F.col("prev_no").isNull(), None).when(F.coalesce(met, F.lit(False)), _modified(F.col("old"), F.col("code"), F.col("imports"))).otherwise(_change("added", after_code=F.col("code")))
    gone = F.when(F.col("next_no").isNotNull() & ~F.col("then").eqNullSafe(F.col("next_no")), _change("removed", before_code=F.col("code")))
    out = rows.select("repo", "id", "file", "kind", F.explode(F.array_compact(F.array(row(F.col("commit_no"), change), row(F.col("next_no"), gone)))).alias("d"))
    return out.select("repo", "d.commit_no", "id", "file", "kind", *[f"d.c.{c}" for c in _CHANGE])


def pair_diff(pairs: DataFrame) -> DataFrame:
    """snapshot_diff of items whose two states are in one row: pairs has old and new (file, kind, code, imports), either null if the
    item is not there, in place of these columns. Other columns stay."""
    rest = [c for c in pairs.columns if c not in ("old", "new")]
    old, new = F.col("old"), F.col("new")
    change = F.when(old.isNotNull() & new.isNotNull(), _modified(old, new["code"], new["imports"])).when(new.isNotNull(), _change("added", after_code=new["code"])).when(old.isNotNull(), _change("removed", before_code=old["code"]))
    side = F.coalesce(new, old)
    out = pairs.select(*rest, side["file"].alias("file"), side["kind"].alias("kind"), change.alias("d")).where("d is not null")
    return out.select(*rest, "file", "kind", *[f"d.{c}" for c in _CHANGE])


def diff_counts(items: DataFrame, diffs: DataFrame) -> DataFrame:
    """repo, commit_no, items, changes: also for commits without any change, whose change set is empty but done."""
    n = items.groupBy("repo", "commit_no").agg(F.count(F.lit(1)).alias("items"))
    d = diffs.groupBy("repo", "commit_no").agg(F.count(F.lit(1)).alias("changes"))
    return n.join(d, ["repo", "commit_no"], "left").fillna(0, ["changes"])


def with_spans(diffs: DataFrame) -> DataFrame:
    """diff_span, the lines around the changes of either side, on modified rows; the matcher sees only rows whose code changed."""
    found = F.when((F.col("status") == "modified") & F.col("code_changed"), textdiff.diff_span("before_code", "after_code"))
    same = F.when(F.col("status") == "modified", F.struct(F.lit("").alias("before"), F.lit("").alias("after")))
    changed = diffs.where("status = 'modified' and code_changed").withColumn("diff_span", found)
    return changed.unionByName(diffs.where("not (status = 'modified' and code_changed) or code_changed is null").withColumn("diff_span", same))


def metadata_of(commit: Column, extension: str = ".rs") -> Column:
    """The metadata with the hash of a commit (diff, metadata, commit_hash) whose diff text mentions the extension, else null."""
    return F.when(commit["diff"].contains(extension), commit["metadata"].withField("commit_hash", commit["commit_hash"]))


def with_metadata(diffs: DataFrame, commits: DataFrame, extension: str = ".rs") -> DataFrame:
    """commit_metadata with the hash, of commits whose diff text mentions the extension; null for the others."""
    commit = F.struct("diff", "metadata", "commit_hash")
    meta = commits.select("repo", "commit_no", metadata_of(commit, extension).alias("commit_metadata"))
    return diffs.join(meta, ["repo", "commit_no"], "left")


def modified_files(tree: DataFrame, touched: DataFrame, extensions: tuple[str, ...] = (".rs",)) -> DataFrame:
    """repo, commit_no, files_modified: touched files of the wanted kinds that still exist, with their content.

    tree: repo, commit_no, file_path, content; touched: repo, commit_no, paths (array).
    """
    wanted = F.lit(False)
    for e in extensions:
        wanted = wanted | F.endswith(F.col("file_path"), F.lit(e))
    paths = touched.select("repo", "commit_no", F.explode("paths").alias("file_path")).distinct()
    found = tree.where(wanted).join(paths, ["repo", "commit_no", "file_path"])
    return found.groupBy("repo", "commit_no").agg(F.array_sort(F.collect_list(F.struct("file_path", "content"))).alias("files_modified"))


def compare_trees(old: DataFrame, new: DataFrame) -> DataFrame:
    """snapshot_diff of two item tables (id, file, kind, code, imports), without commits."""
    both = old.select(F.lit("tree").alias("repo"), F.lit(1).alias("commit_no"), "id", "file", "kind", "code", "imports").unionByName(new.select(F.lit("tree").alias("repo"), F.lit(2).alias("commit_no"), "id", "file", "kind", "code", "imports"))
    pair = both.sparkSession.createDataFrame([("tree", 1), ("tree", 2)], "repo string, commit_no int")
    return with_spans(snapshot_diff(both, pair)).drop("repo", "commit_no")
