"""Untyped JSON of completions: found in the text around it, parsed to a variant, checked without being forced into a type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as edges

#: A fenced block that holds an object (fixed pattern); a longest block from the first to the last brace.
FENCED, BRACED = r"(?s)```json\s*(\{.*?\})\s*```", r"(?s)\{.*\}"


def fenced_or_whole(text: Column) -> Column:
    """The variant of the first fenced object, else of the whole text; null if it is no JSON."""
    inner = F.regexp_extract(text, FENCED, 1)
    return F.try_parse_json(F.when(inner != "", inner).otherwise(text))


def braced(text: Column) -> Column:
    """The variant of what stands from the first brace to the last; null if that is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, BRACED, 0), F.lit("")))


def task_list(parsed: Column) -> Column:
    """The tasks field as strings; empty if it is missing or no list."""
    tasks = F.try_variant_get(parsed, "$.tasks", "array<string>")
    return F.coalesce(F.when(_is(F.try_variant_get(parsed, "$.tasks", "variant"), "ARRAY"), tasks), F.array().cast("array<string>"))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def valid_task(task: Column) -> Column:
    """Whether a variant is a task: two texts that are not blank, a list of functions, and a text for each of these.

    The texts are looked up in a map, not by path, as ids hold colons and quotes; a value that is no string counts as missing.
    """
    field = lambda name: F.try_variant_get(task, f"$.{name}", "variant")
    text = lambda v: F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))
    filled = lambda v: F.coalesce(~edges.is_blank(text(v)), F.lit(False))
    chosen = F.when(_is(field("selected_functions"), "ARRAY"), F.try_variant_get(task, "$.selected_functions", "array<string>"))
    updates = F.when(_is(field("reasoning_update"), "OBJECT"), F.try_variant_get(task, "$.reasoning_update", "map<string,variant>"))
    each = F.forall(chosen, lambda f: filled(F.try_element_at(updates, f)))
    return filled(field("task")) & filled(field("reasoning_selection")) & F.coalesce((F.size(chosen) > 0) & updates.isNotNull() & each, F.lit(False))


def typed_task(task: Column) -> Column:
    """A valid task as struct(task, reasoning_selection, selected_functions, reasoning_update)."""
    return F.struct(
        F.try_variant_get(task, "$.task", "string").alias("task"),
        F.try_variant_get(task, "$.reasoning_selection", "string").alias("reasoning_selection"),
        F.try_variant_get(task, "$.selected_functions", "array<string>").alias("selected_functions"),
        F.try_variant_get(task, "$.reasoning_update", "map<string,string>").alias("reasoning_update"),
    )
