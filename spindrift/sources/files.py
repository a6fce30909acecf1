"""The dataset's file layout: <base>/<repo>/commit_<n>/<file>, as tables and back.

Paths may be in any file system that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshot import last_wins
from ..schemas import DDL

#: Table -> file of a commit's folder (fixed names).
FILES = {
    "commits": "commit_data.json", "ast_items": "ast.jsonl", "ast_diffs": "diff_ast.jsonl", "unified_diffs": "unified_diffs.jsonl", "edit_sequences": "edit_sequence_dataset.json",
    "fim_samples": "fim_dataset.json", "code_tasks": "fim_tasks.jsonl", "tasks": "task.json", "reasoning": "reasoning.json", "labels": "retrieval_labels.json", "enhanced_tasks": "enhanced_tasks.json",
}
_SEQUENCE = "struct<ast_id:string,original_function:string,reasoning:string,edit_sequence:array<struct<span_before:string,span_after:string>>,hops:map<string,array<string>>,retrieved_labels:array<string>,metadata:struct<commit_hash:string,author:string,commit_message:string,timestamp:string,repository:string,file_path:string,operation_type:string,kind:string>>"
_SAMPLE = DDL["fim_samples"].replace("repo string, commit_no int, ", "")
#: Files that hold a document with a list or a map of rows: its schema, and the rows in it.
DOCUMENTS = {
    "edit_sequences": (f"edit_sequences array<{_SEQUENCE}>", "inline(edit_sequences)"),
    "reasoning": ("commit_hash string, function_reasoning array<struct<function_id:string,file_name:string,operation_type:string,reasoning:string,metadata:struct<commit_hash:string,kind:string>>>", "inline(function_reasoning)"),
    "labels": ("function_labels map<string,struct<hops:map<string,array<string>>>>", "explode(function_labels) as (function_id, l)"),
    "fim_samples": (f"fim_functions map<string,array<struct<{_SAMPLE.replace(' string', ':string').replace(' struct<', ':struct<')}>>>", "inline(flatten(map_values(fim_functions)))"),
    "enhanced_tasks": ("tasks array<struct<task:string,reasoning_selection:string,selected_functions:array<string>,reasoning_update:map<string,string>>>", "posexplode(tasks) as (task_no, t)"),
}


def _place() -> list[Column]:
    """repo and commit_no from a row's file path; a dotted number's second part is sub_no."""
    path = F.col("_metadata.file_path")
    return [F.regexp_extract(path, r"([^/]+)/commit_\d+(?:\.\d+)?/[^/]*$", 1).alias("repo"), F.regexp_extract(path, r"/commit_(\d+)(?:\.\d+)?/[^/]*$", 1).cast("int").alias("commit_no"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(path, r"/commit_\d+\.(\d+)/[^/]*$", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(0)).alias("sub_no")]


def commit_folders(spark: SparkSession, base: str) -> DataFrame:
    """repo, commit_no, sub_no of all commit folders that hold any file, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(f"{base}/*/commit_*/*")
    return files.select(*_place()).distinct().orderBy("repo", "commit_no", "sub_no")


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table from its files; lines that are no JSON are skipped, missing files give no rows.

    Line files get line_no, increasing within a file; their rows without an id stay. Documents give the rows in them.
    """
    ddl = DDL[name].replace("repo string, commit_no int, ", "").replace(", line_no int", "")
    schema, rows = DOCUMENTS.get(name, (ddl, None))
    path = f"{base}/*/commit_*/{FILES[name]}"
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(path)
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    if found is None or len(found) == 0:
        return spark.createDataFrame([], DDL[name])
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    raw = reader.option("multiLine", "true" if FILES[name].endswith(".json") else "false").json(path)
    df = raw.select("*", *_place(), F.monotonically_increasing_id().alias("line_no")).where("_corrupt_record is null").drop("_corrupt_record")
    if rows:
        df = df.selectExpr("repo", "commit_no", *(["commit_hash as document_hash"] if name == "reasoning" else []), rows)
    if name == "labels":
        df = df.select("repo", "commit_no", "function_id", F.col("l.hops").alias("hops"))
    if name == "enhanced_tasks":
        df = df.select("repo", "commit_no", "task_no", "t.*")
    if name == "reasoning":
        df = df.select("repo", "commit_no", "function_id", "file_name", "operation_type", "reasoning", F.coalesce("metadata.commit_hash", "document_hash").alias("commit_hash"), F.col("metadata.kind").alias("kind"))
    return df


def read_keyed_items(spark: SparkSession, base: str, name: str = "ast_items") -> DataFrame:
    """Rows with an id, the last of each."""
    rows = read_table(spark, base, name).where(F.coalesce("id", F.lit("")) != "")
    return last_wins(rows, ["repo", "commit_no", "id"], ["line_no"])


def read_reasoning(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "reasoning").where((F.coalesce("function_id", F.lit("")) != "") & (F.coalesce("reasoning", F.lit("")) != ""))
    return last_wins(rows.withColumn("line_no", F.monotonically_increasing_id()), ["repo", "commit_no", "function_id"], ["line_no"])


def commit_metadata(commits: DataFrame) -> DataFrame:
    """Commits without what would give a change away: no diff, and paths without contents."""
    return commits.select("repo", "commit_no", "commit_hash", "metadata", F.transform("files_modified", lambda f: F.struct(f["file_path"].alias("file_path"))).alias("files_modified"))


def write_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a line, in folders by the columns."""
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(*by) if by else w).json(path)


def as_documents(rows: DataFrame, group: list[str], field: str, order: list[str], counts: dict[str, Column] | None = None) -> DataFrame:
    """One row per group with document: the group's columns, the counts and its rows as a list, as JSON."""
    rest = [c for c in rows.columns if c not in group]
    held = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("x"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    docs = rows.groupBy(*group).agg(held.alias("rows"), *[c.alias(n) for n, c in (counts or {}).items()])
    return docs.select(*group, F.to_json(F.struct(*group, *(counts or {}), F.transform("rows", lambda r: r["x"]).alias(field)), {"ignoreNullFields": "false"}).alias("document"))


def write_texts(df: DataFrame, text: str, path: str, by: list[str]) -> None:
    df.select(*by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(*by).option("lineSep", "\n").text(path)


#: Stages whose files may be cleaned away.
CLEANABLE = {"task": "tasks", "reasoning": "reasoning", "fim": "fim_samples"}


def clean(spark: SparkSession, base: str, stages: list[str], repo: str | None = None, dry_run: bool = True) -> list[str]:
    """The files of the stages, of one repo or all; deleted unless it is a dry run."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for stage in stages:
        glob = jvm.org.apache.hadoop.fs.Path(f"{base}/{repo or '*'}/commit_*/{FILES[CLEANABLE[stage]]}")
        fs = glob.getFileSystem(conf)
        for status in fs.globStatus(glob) or []:
            out.append(status.getPath().toString())
            if not dry_run:
                fs.delete(status.getPath(), False)
    return sorted(out)
