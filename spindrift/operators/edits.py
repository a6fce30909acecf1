"""Unified diffs, edit sequences and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, textdiff
from . import linematch

NO_REASONING, NEW_CODE = "No reasoning provided.", "N/A (new code)"
COMMIT = ["repo", "commit_no"]
#: What the system turn of a template says.
TEMPLATE_SYSTEM = "You rewrite the named items of a code base so that the commit's tasks are done. For each item you get its id, its code, why it changes, and the edits to make."


def unified_diffs(diffs: DataFrame, simple: bool = True, separate_imports: bool = True) -> DataFrame:
    """id, file, status, imports_changed, code_changed, diff_string, imports_diff_string of each change."""
    render = textdiff.simple_unified_diff if simple else lambda a, b: textdiff.unified_diff(a, b, F.coalesce("file", F.lit("unknown")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "\n")
    sizes = F.coalesce(F.size("before_imports"), F.lit(0)) + F.coalesce(F.size("after_imports"), F.lit(0))
    wanted = flag("imports_changed") & (sizes > 0) if separate_imports else F.lit(False)
    # Rows without import changes give the matcher two empty texts.
    imports = render(F.when(wanted, joined("before_imports")), F.when(wanted, joined("after_imports")))
    return diffs.select(*COMMIT, "id", F.coalesce("file", F.lit("unknown")).alias("file"), "status", flag("imports_changed").alias("imports_changed"), flag("code_changed").alias("code_changed"), render(F.col("before_code"), F.col("after_code")).alias("diff_string"), imports.alias("imports_diff_string"))


def _edit_places(before: Column, after: Column) -> Column:
    """textdiff.edit_spans of two texts of which one at least isn't empty; the matcher gets none of those where one is."""
    one = (before == "") | (after == "")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.size(linematch.split_lines(before)).alias("n"), before.alias("span_before"), after.alias("span_after")))
    return F.when(one, whole).otherwise(textdiff.edit_spans(F.when(~one, before), F.when(~one, after)))


def edit_sequences(diffs: DataFrame, reasoning: DataFrame | None = None, labels: DataFrame | None = None, placed: bool = False) -> DataFrame:
    """One row per change with at least one edit, reasoning and labels attached where there are any.

    reasoning: repo, commit_no, function_id, reasoning. labels: repo, commit_no, function_id, hops, retrieved_labels. With placed,
    edit_places says at which lines the edits stand. Rows with an empty id are left out.
    """
    before = F.when(F.col("status") == "added", "").otherwise(F.coalesce("before_code", F.lit("")))
    after = F.when(F.col("status") == "removed", "").otherwise(F.coalesce("after_code", F.lit("")))
    meta = lambda f: F.coalesce(F.col(f"commit_metadata.{f}"), F.lit(""))
    rows = diffs.where((F.coalesce("id", F.lit("")) != "") & (before != after)).withColumns({"b": before, "a": after}).withColumn("edit_places", _edit_places(F.col("b"), F.col("a"))).where(F.size("edit_places") > 0)
    rows = rows.withColumn("function_id", F.col("id"))
    none = F.lit(None).cast("string")
    rows = rows.join(reasoning.select(*COMMIT, "function_id", "reasoning"), [*COMMIT, "function_id"], "left") if reasoning is not None else rows.withColumn("reasoning", none)
    if labels is not None:
        rows = rows.join(labels.select(*COMMIT, "function_id", "hops", "retrieved_labels"), [*COMMIT, "function_id"], "left")
    else:
        rows = rows.withColumn("hops", F.lit(None).cast("map<string,array<string>>")).withColumn("retrieved_labels", F.lit(None).cast("array<string>"))
    filled = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)
    metadata = F.struct(meta("commit_hash").alias("commit_hash"), meta("author_name").alias("author"), meta("commit_message").alias("commit_message"), meta("commit_date").alias("timestamp"), F.col("repo").alias("repository"), F.coalesce("file", F.lit("")).alias("file_path"), F.upper("status").alias("operation_type"), F.coalesce("kind", F.lit("")).alias("kind"))
    pairs = F.transform("edit_places", lambda e: F.struct(e["span_before"].alias("span_before"), e["span_after"].alias("span_after")))
    out = [*COMMIT, F.col("id").alias("ast_id"), filled(F.col("b"), F.lit(NEW_CODE)).alias("original_function"), filled(F.col("reasoning"), F.lit(NO_REASONING)).alias("reasoning"), pairs.alias("edit_sequence")]
    out += [F.coalesce("hops", F.create_map().cast("map<string,array<string>>")).alias("hops"), F.coalesce("retrieved_labels", F.array().cast("array<string>")).alias("retrieved_labels"), metadata.alias("metadata")]
    return rows.select(*out, *(["edit_places"] if placed else []))


def retrieval_labels(labels: DataFrame, most: int = 20) -> DataFrame:
    """function_id, hops and retrieved_labels of labels (function_id, hops); rows with empty hops are left out."""
    kept = labels.where(F.size("hops") > 0)
    return kept.withColumn("retrieved_labels", text.merge_labels(F.col("hops"), F.col("function_id"), most))


def edit_totals(sequences: DataFrame) -> DataFrame:
    """Entries and edits per commit."""
    return sequences.groupBy(*COMMIT).agg(F.count(F.lit(1)).alias("entry_count"), F.sum(F.size("edit_sequence")).alias("total_edit_spans"))


def verify_edits(sequences: DataFrame, diffs: DataFrame, compat: bool = False) -> DataFrame:
    """repo, commit_no, ast_id, passed, reason: whether the edits of each sequence lead from the old code to the new.

    compat applies the edits by searching their old text, an empty one standing at the front, so most pure insertions fail; else the
    places in edit_places are used and every sequence that edit_sequences() made passes. Null codes are empty.
    """
    d = diffs.select(*COMMIT, F.col("id").alias("ast_id"), "status", F.coalesce("before_code", F.lit("")).alias("old"), F.coalesce("after_code", F.lit("")).alias("new"), F.lit(True).alias("found"))
    d = d.select(*COMMIT, "ast_id", "status", _digest(F.col("old")).alias("old"), _digest(F.col("new")).alias("new"), F.col("new").alias("expected"), "found")
    own = F.when(F.col("original_function") == NEW_CODE, "").otherwise(F.col("original_function"))
    edits = F.col("edit_sequence")
    applied = text.apply_edits(own, edits) if compat else textdiff.apply_edit_places(own, F.col("edit_places"))
    one = (F.size(edits) == 1) & (F.get(edits, F.lit(0))["span_before"] == "")
    # The texts are compared by their digests, so that they meet only where somebody looks at what was rebuilt and expected.
    made = sequences.select(*COMMIT, "ast_id", (own != "").alias("has_own"), one.alias("one"), F.get(edits, F.lit(0))["span_after"].alias("added"), own.alias("own"), applied.alias("applied"))
    made = made.select(*COMMIT, "ast_id", "has_own", "one", _digest(F.col("added")).alias("added"), _digest(F.col("own")).alias("own"), _digest(F.col("applied")).alias("result"), "applied")
    rows = made.join(d, [*COMMIT, "ast_id"], "left")
    reason = (
        F.when(F.col("found").isNull(), "not among the changes")
        .when(F.col("status") == "added", F.when(F.col("has_own"), "an added item has an original").when(~F.col("one"), "an added item needs one edit of an empty span").when(F.col("added") != F.col("new"), "the edit is not the new code"))
        .when(F.col("own") != F.col("old"), "the original is not the old code")
        .when(F.col("result").isNull(), "a span was not found")
        .when(F.col("result") != F.col("new"), "the result is not the new code")
    )
    return rows.select(*COMMIT, "ast_id", reason.isNull().alias("passed"), reason.alias("reason"), F.when(F.col("status") != "added", F.col("applied")).alias("rebuilt"), "expected")


def _digest(c: Column) -> Column:
    return F.sha2(c, 256)


def failure_report(verified: DataFrame, preview: int = 200) -> DataFrame:
    """The failures with previews and the similarity of what came out to what was expected."""
    bad = verified.where("not passed")
    return bad.select(*COMMIT, "ast_id", "reason", F.left("expected", F.lit(preview)).alias("expected"), F.left("rebuilt", F.lit(preview)).alias("got"), textdiff.similarity("rebuilt", "expected").alias("similarity"))


def verification_totals(verified: DataFrame) -> DataFrame:
    return verified.groupBy(*COMMIT).agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("ast_id")))).alias("failures"))


def render_templates(sequences: DataFrame, tasks: DataFrame, system: str) -> DataFrame:
    """repo, commit_no, template: a chat of the system text, the numbered tasks, and one update block per sequence, by id."""
    block = F.concat_ws("\n", F.lit("<update>"), F.concat(F.lit("<ast_id>"), "ast_id", F.lit("</ast_id>")), F.lit("<original_function>"), "original_function", F.lit("</original_function>"), F.lit("<reasoning>"), "reasoning", F.lit("</reasoning>"), F.lit("<edit_sequence>"), textdiff.indented_json(F.to_json("edit_sequence")), F.lit("</edit_sequence>"), F.lit("</update>"), F.lit(""))
    updates = sequences.select(*COMMIT, F.struct("ast_id", block.alias("block")).alias("u")).groupBy(*COMMIT).agg(F.array_sort(F.collect_list("u")).alias("u"))
    rows = updates.join(tasks.select(*COMMIT, "tasks"), COMMIT, "left").withColumn("tasks", F.coalesce("tasks", F.array().cast("array<string>")))
    numbered = F.transform("tasks", lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t))
    head: list[Column] = [F.lit("<|im_start|>system"), F.lit(system), F.lit("<|im_end|>"), F.lit("<|im_start|>user"), F.lit("**Commit Tasks:**")]
    parts = F.concat(F.array(*head), numbered, F.array(F.lit("<|im_end|>"), F.lit("<|im_start|>assistant"), F.lit("")), F.transform("u", lambda u: u["block"]), F.array(F.lit("<|im_end|>")))
    return rows.select(*COMMIT, F.array_join(parts, "\n").alias("template"))
