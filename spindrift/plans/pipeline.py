"""The stages of a dataset, each a DataFrame plan that is written as Parquet by repository.

A stage reads what earlier ones wrote, leaves out the commits that it has done before (unless forced), and writes the rest; commits
without rows are noted, so that an empty result counts as done. Spark's own scheduling replaces polling and worker pools.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import rust
from ..operators import codetasks, completion, dataset, edits, fim, quality, snapshot
from ..sources import documents as sink
from ..sources import git, provider
from ..sources.config import Config

COMMIT = ["repo", "commit_no"]


@dataclass
class Workspace:
    """Where the tables of a run are: one folder per stage."""

    spark: SparkSession
    base: str
    config: Config = field(default_factory=Config)
    client: provider.Client | None = None

    def has(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame:
        """A table by its own schema, which is also there if no commit has given it a row."""
        if self.has(f"{name}.schema"):
            return self.spark.read.schema(self.spark.read.parquet(f"{self.base}/{name}.schema").schema).parquet(f"{self.base}/{name}")
        return self.spark.read.parquet(f"{self.base}/{name}")

    def write(self, name: str, df: DataFrame, expected: DataFrame, force: bool = False) -> int:
        """Adds the rows of expected commits that are not done; how many commits that were."""
        todo = quality.not_done(expected.select(*COMMIT).distinct(), self.read(f"{name}.done"), force=force) if self.has(f"{name}.done") else expected.select(*COMMIT).distinct()
        todo = todo.persist()
        try:
            if n := todo.count():
                w = df.join(F.broadcast(todo) if n < 100_000 else todo, COMMIT, "left_semi").write.partitionBy("repo")
                if force:  # only the repositories at hand are replaced
                    w = w.option("partitionOverwriteMode", "dynamic")
                w.mode("overwrite" if force else "append").parquet(f"{self.base}/{name}")
                df.limit(0).write.mode("overwrite").parquet(f"{self.base}/{name}.schema")
                todo.write.mode("append").parquet(f"{self.base}/{name}.done")
            elif not self.has(f"{name}.done"):  # nothing to do is a table without rows
                df.limit(0).write.mode("overwrite").parquet(f"{self.base}/{name}.schema")
                df.limit(0).write.mode("append").partitionBy("repo").parquet(f"{self.base}/{name}")
                todo.write.mode("append").parquet(f"{self.base}/{name}.done")
            return n
        finally:
            todo.unpersist()


def ingest(ws: Workspace, force: bool = False) -> int:
    """commits, from the repositories of the configuration or all that lie in its folder."""
    git.register(ws.spark)
    folder = ws.config.paths.get("repos", "data/repos")
    here = {r["repo"]: r["path"] for r in git.list_repos(ws.spark, folder).collect()}
    wanted = [p for n, p in here.items() if not ws.config.repositories or n in ws.config.repositories]
    reader = lambda f: ws.spark.read.format(f).option("path", ",".join(wanted)).option("extensions", ",".join(ws.config.file_types))
    limit = {"limit": str(ws.config.max_commits), "order": ws.config.commit_order} if ws.config.max_commits else {}
    commits = reader("git_commits").options(**limit).load()
    tree = reader("git_tree").options(**limit).load()
    files = snapshot.modified_files(tree, commits, ws.config.file_types)
    done = ws.write("commits", commits.drop("paths").join(files, COMMIT, "left"), commits, force)
    found = storage.checkpoint(rust.extract_items(tree, ws.config.file_types))
    counts = found.groupBy(*COMMIT).agg(F.count("id").alias("n"), F.max(F.col("error").isNotNull()).alias("error"))
    ws.write("ast_counts", counts, commits, force)
    ws.write("ast_changes", snapshot.changes(snapshot.last_wins(found.where("id is not null"), [*COMMIT, "id"], ["file", "line_no"]), commits), commits, force)
    return done


def items(ws: Workspace) -> DataFrame:
    """The items of every commit, from their changes."""
    return snapshot.snapshots(snapshot.intervals(ws.read("ast_changes")), ws.read("commits"))


def ast_diffs(ws: Workspace, force: bool = False) -> int:
    commits = ws.read("commits")
    diffs = snapshot.with_metadata(snapshot.with_spans(snapshot.snapshot_diff(items(ws), commits)), commits)
    return ws.write("ast_diffs", diffs, snapshot.neighbours(commits).where("prev_no is not null"), force)


def unified(ws: Workspace, force: bool = False) -> int:
    """Besides the diffs, unified_diffs.status says for each commit what became of it in this run."""
    ready = ws.read("ast_diffs.done").select(*COMMIT)
    before = storage.checkpoint(ws.read("unified_diffs.done").select(*COMMIT)) if ws.has("unified_diffs.done") and not force else ready.limit(0)
    n = ws.write("unified_diffs", edits.unified_diffs(ws.read("ast_diffs")), ready, force)
    status = quality.run_status(ws.read("commits"), ready, before, ws.read("unified_diffs"), F.col("diff_string").isNull())
    status.write.mode("overwrite").parquet(f"{ws.base}/unified_diffs.status")
    return n


def edit_sequences(ws: Workspace, force: bool = False) -> int:
    reasoning = ws.read("reasoning") if ws.has("reasoning") else None
    labels = edits.retrieval_labels(ws.read("labels")) if ws.has("labels") else None
    return ws.write("edit_sequences", edits.edit_sequences(ws.read("ast_diffs"), reasoning, labels, placed=True), ws.read("ast_diffs.done"), force)


def fim_samples(ws: Workspace, force: bool = False) -> int:
    return ws.write("fim_samples", fim.fim_samples(ws.read("ast_diffs").withColumn("line_no", F.lit(1))), ws.read("ast_diffs.done"), force)


def code_tasks(ws: Workspace, force: bool = False, most: int = 100) -> int:
    n = ws.read("ast_diffs").groupBy(*COMMIT).agg(F.count(F.lit(1)).alias("n"))
    return ws.write("code_tasks", codetasks.code_tasks(items(ws), n, most), ws.read("commits"), force)


#: Calls in flight and tasks of the stages that no setting covers.
STAGE_LIMITS = provider.Limits(calls=5, tasks=4)


def _answers(ws: Workspace, prompts: DataFrame, limits: provider.Limits = STAGE_LIMITS) -> tuple[DataFrame, DataFrame]:
    """The prompts with their completions, from the table of completions and the log, to which the client adds what is missing; and the
    commits of which a prompt has none."""
    prompts = storage.checkpoint(prompts)
    log = f"{ws.base}/completions.log"
    known = ws.read("completions").select("prompt_hash", "completion") if ws.has("completions") else ws.spark.createDataFrame([], provider.LOG)
    if ws.client:
        provider.ask(prompts.join(known.select("prompt_hash"), "prompt_hash", "left_anti"), ws.client, log, limits)
    answers = storage.checkpoint(completion.from_table(prompts, known.unionByName(provider.read_log(ws.spark, log))))
    return answers, answers.where("completion is null").select(*COMMIT).distinct()


def _answered(ws: Workspace, name: str, prompts: DataFrame, parse: Callable[[DataFrame], DataFrame], expected: DataFrame, force: bool, limits: provider.Limits = STAGE_LIMITS) -> int:
    """Writes what the completions say, for the commits that have all of theirs; the others stay to be done."""
    answers, missing = _answers(ws, prompts, limits)
    return ws.write(name, parse(answers), expected.select(*COMMIT).join(missing, COMMIT, "left_anti"), force)


def tasks(ws: Workspace, force: bool = False) -> int:
    return _answered(ws, "tasks", completion.task_prompts(ws.read("commits")), completion.parse_tasks, ws.read("commits"), force)


def reasoning(ws: Workspace, force: bool = False) -> int:
    return _answered(ws, "reasoning", completion.reasoning_prompts(ws.read("ast_diffs"), ws.read("tasks")), completion.parse_reasoning, ws.read("tasks.done"), force)


def enhanced_tasks(ws: Workspace, force: bool = False) -> int:
    e = ws.config.enhanced_tasks
    prompts = completion.element_prompts(ws.read("edit_sequences"), ws.read("commits"), batch_size=e.max_ast_elements_per_batch, most_elements=e.max_ast_elements_per_commit)
    limits = provider.Limits(calls=e.max_concurrent_llm_calls, tasks=e.max_concurrent_commits)
    return _answered(ws, "enhanced_tasks", prompts, completion.parse_enhanced, ws.read("edit_sequences.done"), force, limits)


def documents(ws: Workspace, force: bool = False) -> int:
    """The folder layout in <base>/documents, with a template for each commit that has edit sequences; how many commits are new."""
    done = f"{ws.base}/documents.done"
    commits = ws.read("commits").select(*COMMIT).distinct()
    todo = (quality.not_done(commits, ws.read("documents.done"), force=force) if ws.has("documents.done") else commits).persist()
    try:
        if n := todo.count():
            tables = {t: ws.read(t).join(todo, COMMIT, "left_semi") for t in ("commits", "ast_diffs", "unified_diffs", "edit_sequences", "fim_samples", "code_tasks", "tasks", "reasoning", "enhanced_tasks") if ws.has(t)}
            tables["ast_items"] = items(ws).drop("error").join(todo, COMMIT, "left_semi")
            sink.write_workspace(tables, f"{ws.base}/documents", edits.TEMPLATE_SYSTEM)
            todo.write.mode("append").parquet(done)
        return n
    finally:
        todo.unpersist()


def build_dataset(ws: Workspace, force: bool = False) -> int:
    enhanced = ws.read("enhanced_tasks").withColumn("task_no", F.struct("batch_no", "place"))
    diffs = snapshot.last_wins(ws.read("unified_diffs").select(*COMMIT, "id", "diff_string"), [*COMMIT, "id"], ["diff_string"])
    rows = dataset.build_dataset(ws.read("commits"), enhanced, ws.read("code_tasks"), diffs)
    rows.write.mode("overwrite").parquet(f"{ws.base}/dataset")
    return ws.read("dataset").count()


STAGES: dict[str, Callable[..., int]] = {
    "ingest": ingest, "ast_diffs": ast_diffs, "unified_diffs": unified, "tasks": tasks, "reasoning": reasoning, "edit_sequences": edit_sequences,
    "fim_samples": fim_samples, "code_tasks": code_tasks, "enhanced_tasks": enhanced_tasks, "documents": documents, "dataset": build_dataset,
}


def run(ws: Workspace, skip: Iterable[str] = (), force: bool = False) -> dict[str, int]:
    """The stages in order but the skipped ones; a failure ends the run. Commits (rows for the dataset) per stage."""
    unknown = set(skip) - set(STAGES)
    if unknown:
        raise ValueError(f"no such stages: {', '.join(sorted(unknown))}")
    return {name: stage(ws, force) for name, stage in STAGES.items() if name not in set(skip)}


def completion_report(ws: Workspace) -> DataFrame:
    """stage, repos, complete, percent."""
    commits = ws.read("commits")
    expected = {"ast_diffs": snapshot.neighbours(commits).where("prev_no is not null")}
    parts = []
    for name in STAGES:
        if name not in ("ingest", "documents", "dataset") and ws.has(f"{name}.done"):
            status = quality.stage_completion(expected.get(name, commits if name in ("tasks", "code_tasks") else expected["ast_diffs"]), ws.read(f"{name}.done"))
            parts.append(quality.completion_percent(status).withColumn("stage", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("stage", "repos", "complete", "percent")
