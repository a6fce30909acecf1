"""Code tasks from snapshot items: quotas by the number of changes, one cursor over the items in a drawn order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

COMMIT = ["repo", "commit_no"]
#: Tasks per change, least number, and the share of the maximum that a kind may take (fixed values).
RATES = {"fim": (1.5, 2, 2), "code_completion": (1.0, 1, 3), "full_function_prediction": (0.3, 1, 5)}
DEFAULT_CHANGES = 10


def quotas(entries: Column, changes: Column, most: Column | int = 100) -> dict[str, Column]:
    """Per kind of task the number wanted; no changes count as ten. Halves round to even."""
    most = F.lit(most) if isinstance(most, int) else most
    d = F.when(F.coalesce(changes, F.lit(0)) == 0, DEFAULT_CHANGES).otherwise(changes).cast("double")
    cap = lambda part: F.least(F.floor(entries / 3), F.floor(most / part))
    return {kind: F.least(F.greatest(F.bround(d * rate).cast("bigint"), F.lit(least).cast("bigint")), cap(part)).cast("int") for kind, (rate, least, part) in RATES.items()}


def drawn_order(key: Column, seed: str = "order") -> Column:
    """A text by which to sort in an order that looks random and is the same every time."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def assign_kinds(items: DataFrame, group: list[str], order: list[str], eligible: dict[str, str], wanted: dict[str, str]) -> DataFrame:
    """Adds task_type: which kind of task a row is used for, or null.

    One cursor runs over each group in the given order: the first kind takes rows until it has as many eligible ones as wanted,
    the next goes on behind them, and so on. Rows that the cursor passes without being eligible are used up. eligible and wanted
    name columns, by kind, in the order of the kinds. Windows of running sums only; a group is sorted once.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    everything = Window.partitionBy(*group)
    rows = items.withColumn("rank", F.row_number().over(w)).withColumn("cut", F.lit(0))
    kind_of: Column = F.lit(None).cast("string")
    for kind, ok in eligible.items():
        rows = rows.withColumn("ok", F.when((F.col("rank") > F.col("cut")) & F.col(ok), 1).otherwise(0)).withColumn("run", F.sum("ok").over(w))
        # The first rank at which the quota is met; none is used for an empty quota, all for one that is never met.
        met = F.min(F.when((F.col("run") >= F.col(wanted[kind])) & (F.col("rank") > F.col("cut")), F.col("rank"))).over(everything)
        last = F.when(F.col(wanted[kind]) <= 0, F.col("cut")).otherwise(F.coalesce(met, F.max("rank").over(everything)))
        rows = rows.withColumn("next_cut", last)
        rows = rows.withColumn(f"use_{kind}", (F.col("ok") == 1) & (F.col("rank") <= F.col("next_cut")) & (F.col("run") <= F.col(wanted[kind])))
        rows = rows.withColumn("cut", F.col("next_cut"))
        kind_of = F.coalesce(kind_of, F.when(F.col(f"use_{kind}"), F.lit(kind)))
    return rows.withColumn("task_type", kind_of).drop("cut", "next_cut", "ok", "run", *[f"use_{k}" for k in eligible])


def code_tasks(items: DataFrame, changes: DataFrame | None = None, most: int = 100, seed: str = "order", least_lines: int = 5, most_lines: int = 30) -> DataFrame:
    """Tasks of the code_tasks schema. items: the ast_items columns; changes: repo, commit_no, n.

    Items of least to most lines take part, in an order drawn by id. Null codes and ids take no part.
    """
    rows = items.where(text.in_line_range(F.col("code"), least_lines, most_lines))
    total = Window.partitionBy(*COMMIT)
    rows = rows.withColumn("entries", F.count(F.lit(1)).over(total))
    rows = rows.join(changes.select(*COMMIT, F.col("n").alias("changes")), COMMIT, "left") if changes is not None else rows.withColumn("changes", F.lit(0))
    named = F.coalesce("id", F.lit("")) != ""
    mask, cut = text.mask_span(F.col("code")), text.completion_split(F.col("code"), F.col("id"), seed)
    rows = rows.withColumns({"mask": F.when(named, mask), "cut2": F.when(named, cut), "k": drawn_order(F.coalesce("id", F.lit("")), seed)})
    rows = rows.withColumns({"ok_fim": F.col("mask").isNotNull(), "ok_completion": F.col("cut2").isNotNull(), "ok_full": named})
    rows = rows.withColumns({f"want_{kind}": q for kind, q in quotas(F.col("entries"), F.col("changes"), most).items()})
    kinds = list(RATES)
    rows = assign_kinds(rows, COMMIT, ["k", "id", "code"], dict(zip(kinds, ("ok_fim", "ok_completion", "ok_full"), strict=True)), {k: f"want_{k}" for k in kinds}).where("task_type is not null")
    is_ = lambda kind, c: F.when(F.col("task_type") == kind, c)
    prompt = text.full_prompt(F.col("file"), F.col("id"), F.col("kind"), F.col("attributes"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        *COMMIT, "task_type", F.col("id").alias("ast_id"), empty("file").alias("file"), empty("kind").alias("kind"), F.coalesce("imports", F.array().cast("array<string>")).alias("imports"),
        is_("fim", F.col("mask.prefix")).alias("prefix"), is_("fim", F.col("mask.middle")).alias("middle"), is_("fim", F.col("mask.suffix")).alias("suffix"),
        F.coalesce(is_("code_completion", F.col("cut2.input")), is_("full_function_prediction", prompt)).alias("input"),
        F.coalesce(is_("code_completion", F.col("cut2.output")), is_("full_function_prediction", F.col("code"))).alias("output"),
    )
