"""The training dataset: one row per task, rendered with chat marks, and the union of all kinds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMIT = ["repo", "commit_no"]


@dataclass(frozen=True)
class SystemTexts:
    """What the system turn of each kind of row says."""

    task: str = "You choose the functions that a change must touch and plan their edits."
    fim: str = "You fill in the missing middle of a piece of code."
    code_completion: str = "You continue a piece of code."
    full_completion: str = "You write the whole implementation of an item."


def _system(text: str) -> Column:
    return F.lit(f"<|im_start|>system\n{text}<|im_end|>")


def _imports() -> Column:
    return F.array_join(F.coalesce("imports", F.array().cast("array<string>")), "\n")


def _rows(rows: DataFrame, system: str, given: Column, output: Column, task_type: str) -> DataFrame:
    return rows.select(_system(system).alias("instruction"), given.alias("input"), output.alias("output"), F.col("commit_hash").alias("commit_id"), F.col("commit_no").cast("int").alias("commit_no"), F.lit(task_type).alias("task_type"))


def fim_rows(tasks: DataFrame, texts: SystemTexts = SystemTexts()) -> DataFrame:
    given = F.concat(F.lit("<|im_start|>user\nTask: Fill in the middle part of the code\nInstruction: Predict the middle part of the code snippet given the prefix and suffix. Include any required imports in the output.\nAST ID: "), "ast_id", F.lit("\n<|fim_prefix|>\n"), "prefix", F.lit("\n<|fim_suffix|>\n"), "suffix", F.lit("\n<|fim_middle|>"))
    output = F.concat("middle", F.lit("\n<|imports|>\n"), _imports(), F.lit("\n<|im_end|>"))
    return _rows(tasks.where("task_type = 'fim'"), texts.fim, given, output, "fim")


def completion_rows(tasks: DataFrame, texts: SystemTexts = SystemTexts()) -> DataFrame:
    given = F.concat(F.lit("<|im_start|>user\nTask: Complete the code\nInstruction: Predict the code for the given ast_id\nAST ID: "), "ast_id", F.lit("\n<|im_end|>\n<|im_start|>worker\n<|code|>\n"), F.col("input"), F.lit("\nOutput:"))
    output = F.concat(F.col("output"), F.lit("\n<|imports|>\n"), _imports(), F.lit("\n<|im_end|>"))
    return _rows(tasks.where("task_type = 'code_completion'"), texts.code_completion, given, output, "code_completion")


def full_rows(tasks: DataFrame, texts: SystemTexts = SystemTexts()) -> DataFrame:
    """The prompt of the task is not part of the row; the id stands for it."""
    given = F.concat(F.lit("<|im_start|>user\nTask: Generate complete implementation\nInstruction: Predict the whole code for the given\nAST ID: "), "ast_id", F.lit("\n<|im_end|>\n<|im_start|>worker\nOutput:"))
    output = F.concat(F.lit("<|imports|>\n"), _imports(), F.lit("\n<|code|>\n"), F.col("output"), F.lit("\n<|im_end|>"))
    return _rows(tasks.where("task_type = 'full_function_prediction'"), texts.full_completion, given, output, "full_completion")


def task_rows(tasks: DataFrame, diffs: DataFrame, texts: SystemTexts = SystemTexts()) -> DataFrame:
    """One row per enhanced task; each selected function with its diff and reasoning, in the order of selection.

    tasks: the enhanced_tasks columns, commit_hash and an order column task_no; diffs: repo, commit_no, id, diff_string.
    """
    keyed = tasks.withColumn("task_key", F.struct(*COMMIT, "task_no"))
    each = keyed.select("task_key", *COMMIT, F.posexplode("selected_functions").alias("place", "id"), "reasoning_update")
    one = diffs.select(*COMMIT, "id", F.nullif("diff_string", F.lit("")).alias("diff_string"))
    met = each.join(one, [*COMMIT, "id"], "left").withColumn("why", F.try_element_at("reasoning_update", "id"))
    block = F.concat(
        F.lit("<|selected|>"), "id", F.lit("\n"),
        F.coalesce(F.concat(F.lit("<|context|>"), "diff_string", F.lit("<|context_end|>\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("<|reasoning|>plan\n"), "why", F.lit("<|reasoning_end|>\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("<|action|>edit\n"), "diff_string", F.lit("\n")), F.lit("")),
        F.lit("<|selection_end|>\n"),
    )
    blocks = met.groupBy("task_key").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))).alias("bs"))
    rows = keyed.join(blocks, "task_key", "left").withColumn("work", F.coalesce(F.array_join(F.transform("bs", lambda b: b["b"]), ""), F.lit("")))
    given = F.concat(F.lit("<|im_start|>user\n"), "task", F.lit("<|im_end|>"))
    output = F.concat(F.lit("<|im_start|>selector\n<|reasoning|>analysis\n"), "reasoning_selection", F.lit("<|reasoning_end|>\n<|select|>"), F.array_join("selected_functions", "<|select|>"), F.lit("<|im_end|>\n<|im_start|>worker\n"), "work", F.lit("<|im_end|>"))
    return _rows(rows, texts.task, given, output, "task")


def build_dataset(commits: DataFrame, enhanced: DataFrame, code_tasks: DataFrame, diffs: DataFrame, texts: SystemTexts = SystemTexts()) -> DataFrame:
    """All rows of commits that have a record; tasks of an unknown kind give none. enhanced has an order column task_no.

    The four kinds are projections of two inputs, put together as a bag; nothing is shuffled but what meets its diffs.
    """
    known = commits.select(*COMMIT, F.coalesce("commit_hash", F.lit("unknown")).alias("commit_hash"))
    tasks, code = enhanced.join(known, COMMIT), code_tasks.withColumn("task_type", F.coalesce("task_type", F.lit("fim"))).join(known, COMMIT)
    return task_rows(tasks, diffs, texts).unionByName(fim_rows(code, texts)).unionByName(completion_rows(code, texts)).unionByName(full_rows(code, texts))


def histogram(dataset: DataFrame) -> DataFrame:
    return dataset.groupBy("task_type").agg(F.count(F.lit(1)).alias("n")).orderBy("task_type")
