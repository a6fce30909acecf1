"""Record types of the engine, as Spark DDL. Every table also has repo STRING and commit_no INT; a key that may be absent is null."""

from __future__ import annotations

from pyspark.sql.types import StructType

_META = "struct<author_name:string,author_email:string,commit_date:string,commit_message:string>"
_META_HASH = "struct<author_name:string,author_email:string,commit_date:string,commit_message:string,commit_hash:string>"
_EDITS = "array<struct<span_before:string,span_after:string>>"

DDL: dict[str, str] = {
    "commits": f"repo string, commit_no int, commit_hash string, diff string, metadata {_META}, files_modified array<struct<file_path:string,content:string>>",
    "ast_items": "repo string, commit_no int, id string, kind string, parent string, code string, file string, imports array<string>, extern_crates array<string>, attributes array<string>, line_no int",
    "ast_diffs": f"repo string, commit_no int, id string, file string, kind string, status string, code_changed boolean, imports_changed boolean, before_code string, after_code string, diff_span struct<before:string,after:string>, before_imports array<string>, after_imports array<string>, commit_metadata {_META_HASH}",
    "unified_diffs": "repo string, commit_no int, id string, file string, status string, imports_changed boolean, code_changed boolean, diff_string string, imports_diff_string string",
    "edit_sequences": f"repo string, commit_no int, ast_id string, original_function string, reasoning string, edit_sequence {_EDITS}, hops map<string,array<string>>, retrieved_labels array<string>, metadata struct<commit_hash:string,author:string,commit_message:string,timestamp:string,repository:string,file_path:string,operation_type:string,kind:string>",
    "fim_samples": "repo string, commit_no int, function_id string, file_name string, imports string, operation_type string, fim_prefix string, fim_suffix string, fim_middle string, commit_hash string, author string, commit_message string, kind string, diff_context struct<lines_before_change:int,lines_after_change:int,exact_change_start:int,exact_change_end:int,context_window:string,deleted_code:string>, series_info struct<step:int,total_steps:int,function_id:string,change_sequence:array<string>,is_series:boolean>",
    "code_tasks": "repo string, commit_no int, task_type string, ast_id string, file string, kind string, imports array<string>, prefix string, middle string, suffix string, input string, output string",
    "tasks": "repo string, commit_no int, commit_hash string, tasks array<string>, task_count int",
    "reasoning": "repo string, commit_no int, function_id string, file_name string, operation_type string, reasoning string, commit_hash string, kind string",
    "labels": "repo string, commit_no int, function_id string, hops map<string,array<string>>",
    "enhanced_tasks": "repo string, commit_no int, task string, reasoning_selection string, selected_functions array<string>, reasoning_update map<string,string>",
    "dataset": "instruction string, input string, output string, commit_id string, commit_no int, task_type string",
    "memory_chunks": "head int, slot bigint, rep array<float>, keys array<array<float>>, vals array<array<float>>",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
