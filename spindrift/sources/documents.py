"""Files in the folders of commits, <base>/<repo>/commit_<n>/<file>, as a data source sink that shows all of a job's files or none.

    spark.dataSource.register(CommitFiles)
    rows.write.format("commit_files").option("path", base).option("file", "task.json").mode("append").save()

Rows are repo, commit_no, content. Tasks write to a pending folder of their own; when all are done the driver checks that no commit
comes from two tasks and moves the files to their places, one rename each. A failed task or job leaves nothing but the files that were
there before. Any file system that Arrow knows will do.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators import edits
from .files import FILES

COMMIT = ["repo", "commit_no"]
TEMPLATE = "edit_sequence_template.txt"
#: Renames at a time.
MOVERS = 16


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class _Written(WriterCommitMessage):
    """A task's folder and the commit folders in it."""

    folder: str
    commits: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.file = options["path"].rstrip("/"), options["file"]
        self.end = "\n" if options.get("lines", "false").lower() == "true" else ""
        self.pending = f"{self.path}/.pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Written:
        store, _ = _store(self.path)
        root = posixpath.join(_store(self.pending)[1], str(TaskContext.get().taskAttemptId()))
        seen: dict[str, None] = {}
        out, now = None, None
        try:
            for row in iterator:
                repo, no = row["repo"], row["commit_no"]
                if not repo or no is None or "/" in repo or repo.startswith("."):
                    raise ValueError(f"no folder for repo {repo!r}, commit {no!r}")
                if (commit := f"{repo}/commit_{no}") != now:
                    if out:
                        out.close()
                    if commit in seen:
                        raise ValueError(f"the rows of {commit} don't stand together")
                    seen[commit], now = None, commit
                    store.create_dir(posixpath.join(root, commit))
                    out = store.open_output_stream(posixpath.join(root, commit, self.file))
                    out.write(f"{row['content'] or ''}{self.end}".encode())
                else:
                    out.write(f"{'' if self.end else '\n'}{row['content'] or ''}{self.end}".encode())
        finally:
            if out:
                out.close()
        return _Written(root, list(seen))

    def commit(self, messages: list[_Written | None]) -> None:
        store, base = _store(self.path)
        found = [(m.folder, c) for m in messages if m for c in m.commits]
        if len({c for _, c in found}) < len(found):
            self.abort(messages)
            raise ValueError("the rows of a commit come from more than one task: repartition by repo and commit_no")

        def move(folder: str, commit: str) -> None:
            store.create_dir(posixpath.join(base, commit))
            store.move(posixpath.join(folder, commit, self.file), posixpath.join(base, commit, self.file))

        with ThreadPoolExecutor(MOVERS) as pool:
            for done in [pool.submit(move, *x) for x in found]:
                done.result()
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        """Removes the pending folder."""
        store, at = _store(self.pending)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class CommitFiles(DataSource):
    """Sink for one file in each commit's folder; a file that is there is replaced, all others stay."""

    @classmethod
    def name(cls) -> str:
        return "commit_files"

    def schema(self) -> str:
        return "repo string, commit_no int, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def write_files(rows: DataFrame, base: str, file: str, order: list[str] | None = None) -> None:
    """A file per commit of rows (repo, commit_no, content): a row each, or with an order its rows as lines in that order.

    A commit's rows meet in one task and stream to the file. A null content is empty. Rows without repo or commit_no raise an error.
    """
    rows.sparkSession.dataSource.register(CommitFiles)
    kept = rows.repartition(*COMMIT).sortWithinPartitions(*COMMIT, *(order or []))
    out = kept.select("repo", F.col("commit_no").cast("int").alias("commit_no"), "content")
    out.write.format("commit_files").option("path", base).option("file", file).option("lines", str(order is not None).lower()).mode("append").save()


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("content")


def _entries(rows: DataFrame, order: list[str], *more: Column) -> DataFrame:
    """A row per commit: its rows as the list ``rows``, in order."""
    rest = F.struct(*[c for c in rows.columns if c not in COMMIT])
    held = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), rest.alias("x"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    return rows.groupBy(*COMMIT).agg(F.transform(held, lambda r: r["x"]).alias("rows"), *more)


def _about() -> list[Column]:
    return [F.col("repo").alias("repository"), F.concat(F.lit("commit_"), "commit_no").alias("commit")]


def edit_documents(sequences: DataFrame) -> DataFrame:
    """repo, commit_no, content: a commit's edit sequences by id, with their number and that of their edits."""
    rows = _entries(sequences.drop("edit_places"), ["ast_id"], F.sum(F.size("edit_sequence")).alias("spans"))
    return rows.select(*COMMIT, _json(*_about(), F.col("rows").alias("edit_sequences"), F.size("rows").alias("entry_count"), F.col("spans").alias("total_edit_spans")))


def fim_documents(samples: DataFrame) -> DataFrame:
    """repo, commit_no, content: a commit's samples by function, with the numbers of both."""
    rest = F.struct(*[c for c in samples.columns if c not in COMMIT])
    functions = samples.groupBy(*COMMIT, "function_id").agg(F.collect_list(rest).alias("s"))
    rows = functions.groupBy(*COMMIT).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("function_id", "s")), lambda a, b: F.when(a["function_id"] < b["function_id"], -1).otherwise(1))).alias("f"), F.sum(F.size("s")).alias("n"))
    return rows.select(*COMMIT, _json(*_about(), F.col("f").alias("fim_functions"), F.size("f").alias("function_count"), F.col("n").alias("sample_count")))


def task_documents(tasks: DataFrame, commits: DataFrame) -> DataFrame:
    """repo, commit_no, content: a commit's tasks with its hash and metadata; commits without a task have no document."""
    rows = tasks.where("task_count > 0").join(commits.select(*COMMIT, "metadata"), COMMIT, "left")
    return rows.select(*COMMIT, _json(F.col("commit_no").alias("commit_number"), "commit_hash", F.col("metadata").alias("commit_metadata"), "tasks", "task_count"))


def reasoning_documents(reasoning: DataFrame) -> DataFrame:
    """repo, commit_no, content: what was said about each function of a commit."""
    row = reasoning.select(*COMMIT, "function_id", "file_name", "operation_type", "reasoning", F.struct("commit_hash", "kind").alias("metadata"))
    rows = _entries(row, ["function_id"], F.first("metadata.commit_hash", True).alias("hash"))
    return rows.select(*COMMIT, _json(F.col("commit_no").alias("commit_number"), F.col("hash").alias("commit_hash"), F.col("repo").alias("repository"), F.size("rows").alias("reasoning_count"), F.col("rows").alias("function_reasoning")))


def enhanced_documents(enhanced: DataFrame, commits: DataFrame) -> DataFrame:
    """repo, commit_no, content: a commit's tasks with the functions that they touch, by batch and place."""
    rows = _entries(enhanced, ["batch_no", "place"], F.countDistinct("batch_no").alias("batches")).join(commits.select(*COMMIT, "commit_hash"), COMMIT, "left")
    task = F.transform("rows", lambda r: F.struct(r["task"].alias("task"), r["reasoning_selection"].alias("reasoning_selection"), r["selected_functions"].alias("selected_functions"), r["reasoning_update"].alias("reasoning_update")))
    return rows.select(*COMMIT, _json("commit_hash", F.concat(F.lit("commit_"), "commit_no").alias("commit_name"), F.col("batches").alias("total_batches"), task.alias("tasks"), F.size("rows").alias("task_count")))


def lines(rows: DataFrame) -> DataFrame:
    """repo, commit_no, content, and the columns to order by: each row as a JSON object, keys that are null left out."""
    return rows.select(*rows.columns, F.to_json(F.struct(*[c for c in rows.columns if c not in COMMIT])).alias("content"))


def write_workspace(tables: dict[str, DataFrame], base: str, system: str) -> dict[str, int]:
    """The folder layout of the tables there are (names as in files.FILES): documents, line files and templates; files written of each kind."""
    commits = tables["commits"]
    made = {
        "edit_sequences": edit_documents, "fim_samples": fim_documents, "tasks": lambda t: task_documents(t, commits), "reasoning": reasoning_documents,
        "enhanced_tasks": lambda t: enhanced_documents(t, commits), "commits": lambda t: t.select(*COMMIT, _json(*[F.col(c) for c in t.columns if c not in COMMIT])),
    }
    counts: dict[str, int] = {}
    for name, df in tables.items():
        if name in made:
            rows, order = made[name](df), None
        elif FILES.get(name, "").endswith(".jsonl"):
            rows, order = lines(df), [c for c in ("file", "line_no", "id", "ast_id") if c in df.columns]
        else:
            continue
        write_files(rows, base, FILES[name], order)
        counts[FILES[name]] = rows.select(*COMMIT).distinct().count()
    if "edit_sequences" in tables:
        tasks = tables.get("tasks", commits.select(*COMMIT, F.lit(None).cast("array<string>").alias("tasks")))
        rows = edits.render_templates(tables["edit_sequences"], tasks, system).withColumnRenamed("template", "content")
        write_files(rows, base, TEMPLATE)
        counts[TEMPLATE] = rows.count()
    return counts
