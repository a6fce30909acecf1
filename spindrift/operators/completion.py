"""Completion stages: prompt, completion looked up or asked for, parse, check.

A stage builds prompts by column functions, gets their completions by the hash of the prompt, and parses them by column functions.
Completions are a table (prompt_hash, completion): one that is given, or the log of a provider (sources.provider).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import untyped
from . import chunking

COMMIT = ["repo", "commit_no"]


def with_prompt(rows: DataFrame, prompt: Column) -> DataFrame:
    return rows.withColumn("prompt", prompt).withColumn("prompt_hash", F.sha2("prompt", 256))


def from_table(prompts: DataFrame, completions: DataFrame) -> DataFrame:
    """completion of each prompt by its hash; null where the table has none."""
    return prompts.join(completions.select("prompt_hash", "completion").dropDuplicates(["prompt_hash"]), "prompt_hash", "left")


#: Prompt texts are configuration; these are the defaults.
TASK_PROMPT = "List the separate tasks that this change carries out, as JSON with a field tasks.\n\n"
REASONING_PROMPTS = {
    "UPDATE": "Explain which change the function needs and why.\n",
    "ADD": "Explain why the function is needed and what it must do.\n",
    "DELETE": "Explain why the function can go.\n",
}
ELEMENTS_PROMPT = "Write training tasks for this batch of changed elements, as JSON with a field tasks.\n"


def task_prompts(commits: DataFrame, prompt: str = TASK_PROMPT, most: int = chunking.MOST_CHARS) -> DataFrame:
    """One prompt per commit, or per piece of a long diff."""
    return with_prompt(chunking.chunks(commits.select(*COMMIT, "commit_hash", "diff"), "diff", most), F.concat(F.lit(prompt), F.col("chunk")))


def parse_tasks(answers: DataFrame) -> DataFrame:
    """repo, commit_no, commit_hash, tasks, task_count: the tasks of a commit's pieces in order, once each if it was cut.

    An answer that can't be parsed, or is missing, has no tasks.
    """
    parsed = answers.withColumn("t", untyped.task_list(untyped.fenced_or_whole(F.col("completion"))))
    held = parsed.groupBy(*COMMIT, "commit_hash").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "t"))).alias("parts"), F.max("chunked").alias("chunked"))
    together = F.flatten(F.transform("parts", lambda p: p["t"]))
    out = held.withColumn("tasks", F.when(F.col("chunked"), F.array_distinct(together)).otherwise(together))
    return out.select(*COMMIT, "commit_hash", "tasks", F.size("tasks").alias("task_count"))


def reasoning_prompts(diffs: DataFrame, tasks: DataFrame, prompts: dict[str, str] = REASONING_PROMPTS) -> DataFrame:
    """One prompt per changed item of a commit with tasks: code that changed, was added or was removed."""
    from .fim import OPERATIONS

    op = F.try_element_at(F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv]), F.col("status"))
    changed = F.coalesce("code_changed", F.lit(False)) | F.col("status").isin("added", "removed")
    head = F.try_element_at(F.create_map(*[F.lit(x) for kv in prompts.items() for x in kv]), F.col("operation_type"))
    rows = diffs.where(changed).withColumn("operation_type", F.coalesce(op, F.lit("UPDATE"))).join(tasks.select(*COMMIT, "commit_hash", "tasks"), COMMIT)
    text = F.concat_ws("\n", head, F.array_join("tasks", "\n"), F.concat(F.lit("Item: "), "id"), F.lit("Before:"), F.coalesce("before_code", F.lit("")), F.lit("After:"), F.coalesce("after_code", F.lit("")))
    return with_prompt(rows.select(*COMMIT, F.col("id").alias("function_id"), F.col("file").alias("file_name"), "operation_type", "commit_hash", "kind", text.alias("text")), F.col("text")).drop("text")


def parse_reasoning(answers: DataFrame) -> DataFrame:
    """The reasoning schema; an answer without a reasoning text gives an empty one."""
    v = untyped.fenced_or_whole(F.col("completion"))
    found = F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit(""))
    return answers.select(*COMMIT, "function_id", "file_name", "operation_type", found.alias("reasoning"), "commit_hash", "kind")


def element_prompts(sequences: DataFrame, commits: DataFrame, prompt: str = ELEMENTS_PROMPT, batch_size: int = 20, most_elements: int = 500) -> DataFrame:
    """One prompt per batch of a commit's edit sequences; commits with more than most_elements are left out.

    The commit's diff and file contents never reach a prompt; of its message the first 200 characters do, of its files three.
    """
    kept = chunking.oversize(sequences, COMMIT, most_elements)
    item = F.concat_ws("\n", F.concat(F.lit("- ID: "), "ast_id"), F.concat(F.lit("- Operation: "), "metadata.operation_type"), F.concat(F.lit("- Code: "), "original_function"), F.concat(F.lit("- Edits: "), F.size("edit_sequence").cast("string")))
    batch = chunking.batches(kept.withColumn("item", item), COMMIT, ["ast_id"], batch_size)
    files = F.array_join(F.slice(F.transform("files_modified", lambda f: f["file_path"]), 1, 3), ", ")
    about = commits.select(*COMMIT, F.concat_ws("\n", F.concat(F.lit("Commit "), F.left("commit_hash", F.lit(8))), F.concat(F.lit("Author: "), "metadata.author_name"), F.concat(F.lit("Message: "), F.left("metadata.commit_message", F.lit(200))), F.concat(F.lit("Files: "), files)).alias("about"))
    rows = batch.join(about, COMMIT, "left")
    return with_prompt(rows.select(*COMMIT, "batch_no", "about", "items"), F.concat_ws("\n\n", F.lit(prompt), "about", F.array_join("items", "\n\n"))).drop("about", "items")


def parse_enhanced(answers: DataFrame) -> DataFrame:
    """The enhanced_tasks schema: the valid tasks of all batches, by batch and place."""
    v = untyped.braced(F.col("completion"))
    each = answers.select(*COMMIT, "batch_no", F.posexplode(F.try_variant_get(v, "$.tasks", "array<variant>")).alias("place", "v"))
    good = each.where(untyped.valid_task(F.col("v")))
    return good.select(*COMMIT, "batch_no", "place", untyped.typed_task(F.col("v")).alias("t")).select(*COMMIT, "batch_no", "place", "t.*")
