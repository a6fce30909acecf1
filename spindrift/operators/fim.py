"""Fill-in-the-middle samples of changes, and the series of an item's changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, textdiff

MARGIN = 3
COMMIT = ["repo", "commit_no"]
OPERATIONS = {"modified": "UPDATE", "added": "ADD", "removed": "DELETE"}


def _operation(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv]), status), F.lit("UPDATE"))


def number_series(diffs: DataFrame, order: str = "line_no") -> DataFrame:
    """step, total_steps and change_sequence of each change among those of its item in the commit, before any is dropped."""
    of = Window.partitionBy(*COMMIT, "id")
    ids = F.transform(F.sequence(F.lit(1), F.col("total_steps")), lambda _: F.col("id"))
    return diffs.withColumn("step", F.row_number().over(of.orderBy(order))).withColumn("total_steps", F.count(F.lit(1)).over(of).cast("int")).withColumn("change_sequence", ids)


def find_lines(whole: Column, part: Column) -> Column:
    """First place (from 0) at which the lines of part stand among those of whole; -1 if none."""
    n = F.size(part)
    at = F.filter(F.sequence(F.lit(0), F.size(whole)), lambda i: (i + n <= F.size(whole)) & (F.slice(whole, i + 1, n) == part))
    return F.coalesce(F.get(at, F.lit(0)), F.lit(-1))


def fim_samples(diffs: DataFrame, compat: bool = False, margin: int = MARGIN) -> DataFrame:
    """One sample per change that gives one; columns as the fim_samples schema, without repo-wide grouping.

    Added: everything is the middle. Removed: everything is deleted code. Modified: the changed lines are the middle, between
    the rest of the change's window and margin more lines on either side. compat searches the old window in the old code, so that
    changes with an empty window are lost or misplaced; else the window comes from the lines themselves, so that prefix, middle
    and suffix are lines of the new code in their order for insertions and deletions, too.
    diffs has a line_no, by which an item's changes are ordered.
    """
    rows = number_series(diffs)
    rows = rows.withColumn("op", _operation(F.col("status")))
    meta = lambda f: F.coalesce(F.col(f"commit_metadata.{f}"), F.lit(""))
    shared = [*COMMIT, F.col("id").alias("function_id"), F.coalesce("file", F.lit("")).alias("file_name"), "imports", F.col("op").alias("operation_type"), "fim_prefix", "fim_suffix", "fim_middle", meta("commit_hash").alias("commit_hash"), meta("author_name").alias("author"), meta("commit_message").alias("commit_message"), F.coalesce("kind", F.lit("")).alias("kind"), "diff_context", "series_info"]
    series = F.struct("step", "total_steps", F.col("id").alias("function_id"), "change_sequence", F.lit(True).alias("is_series"))
    rows = rows.withColumn("series_info", F.when(F.col("total_steps") > 1, series))

    def context(before: Column, after: Column, start: Column, end: Column, shown: Column, deleted: Column) -> Column:
        return F.struct(before.cast("int").alias("lines_before_change"), after.cast("int").alias("lines_after_change"), start.cast("int").alias("exact_change_start"), end.cast("int").alias("exact_change_end"), shown.alias("context_window"), deleted.cast("string").alias("deleted_code"))

    def whole(status: str, code: str, middle: Column, shown: str, deleted: Column) -> DataFrame:
        n = F.size(text.lines(F.col(code)))
        part = rows.where((F.col("status") == status) & (F.coalesce(code, F.lit("")) != ""))
        part = part.withColumns({"imports": text.import_lines(F.col(code)), "fim_prefix": F.lit(""), "fim_suffix": F.lit(""), "fim_middle": middle, "diff_context": context(F.lit(0), F.lit(0), F.lit(0), n, F.lit(shown), deleted)})
        return part.select(*shared)

    added = whole("added", "after_code", F.col("after_code"), "entire function (new)", F.lit(None))
    removed = whole("removed", "before_code", F.lit(""), "entire function (deleted)", F.col("before_code"))

    m = rows.where(~F.coalesce(F.col("status").isin("added", "removed"), F.lit(False)))
    if compat:
        m = m.where(F.col("diff_span.before").isNotNull() & F.col("diff_span.after").isNotNull() & ((F.col("diff_span.before") != "") | (F.col("diff_span.after") != "")))
        m = m.withColumns({"sb": F.col("diff_span.before"), "sa": F.col("diff_span.after")})
        m = m.withColumn("x", textdiff.exact_change("sb", "sa"))
        m = m.withColumns({"b": text.lines(F.coalesce("before_code", F.lit(""))), "wb": text.lines(F.col("sb")), "wa": text.lines(F.col("sa"))})
        m = m.withColumn("at", find_lines(F.col("b"), F.col("wb"))).where("at >= 0")
        low = F.greatest(F.col("at") - margin, F.lit(0))
        behind = F.col("at") + F.size("wb")
        high = F.least(F.size("b"), behind + margin)
        head = F.concat(F.slice("b", low + 1, F.col("at") - low), F.slice("wb", F.lit(1), F.col("x.before_start")))
        tail = F.concat(F.slice("wa", F.col("x.after_end") + 1, F.size("wa")), F.slice("b", behind + 1, F.greatest(high - behind, F.lit(0))))
        middle = F.slice("wa", F.col("x.after_start") + 1, F.col("x.after_end") - F.col("x.after_start"))
        start, end = F.col("at") + F.col("x.before_start"), F.col("at") + F.col("x.before_end")
    else:
        m = m.where(F.coalesce("code_changed", ~F.col("before_code").eqNullSafe(F.col("after_code")))).withColumn("e", textdiff.edit_spans("before_code", "after_code")).where(F.size("e") > 0)
        m = m.withColumns({"b": text.lines(F.coalesce("before_code", F.lit(""))), "a": text.lines(F.coalesce("after_code", F.lit("")))})
        first, last = F.element_at("e", 1), F.element_at("e", -1)
        start, end = first["at"], last["at"] + last["n"]
        rest = F.size("b") - end  # lines behind the change are the same on both sides
        stop = F.greatest(F.size("a") - rest, start)
        low, high = F.greatest(start - margin, F.lit(0)), F.least(F.size("b"), end + margin)
        head = F.slice("a", low + 1, start - low)
        tail = F.slice("a", stop + 1, F.lit(margin))
        middle = F.slice("a", start + 1, stop - start)
    shown = F.concat(F.lit("["), low.cast("string"), F.lit(":"), high.cast("string"), F.lit("] of function"))
    m = m.withColumns({"imports": text.import_lines(F.col("after_code")), "fim_prefix": text.join_lines(head), "fim_suffix": text.join_lines(tail), "fim_middle": text.join_lines(middle), "diff_context": context(F.size(head), F.size(tail), start, end, shown, F.lit(None))})
    return added.unionByName(removed).unionByName(m.select(*shared))


def fim_totals(samples: DataFrame) -> DataFrame:
    """Functions and samples per commit; commits without samples have no row."""
    return samples.groupBy(*COMMIT).agg(F.countDistinct("function_id").alias("function_count"), F.count(F.lit(1)).alias("sample_count"))
