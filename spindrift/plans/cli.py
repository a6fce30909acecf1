"""Command line: python -m spindrift.plans.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import rust
from ..operators import edits, quality, snapshot
from ..sources import config, files, git, provider
from . import pipeline


def _session() -> SparkSession:
    return SparkSession.builder.appName("spindrift").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spindrift", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, base: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("--config")
        if base:
            c.add_argument("base", help="folder of the run's tables")
        return c

    c = command("run", "all stages in order")
    c.add_argument("--skip", nargs="*", default=[])
    c.add_argument("--force", action="store_true")
    for name in pipeline.STAGES:
        c = command(name.replace("_", "-"), f"the stage {name}")
        c.add_argument("--force", action="store_true")
        if name == "code_tasks":
            c.add_argument("--max-tasks", type=int, default=100)
    command("report", "how far each stage is")
    command("coverage", "commits with and without items")
    command("verify", "whether the edit sequences lead to the new code")
    c = command("export", "a table as JSON lines in folders by repository and commit")
    c.add_argument("table", choices=sorted(files.FILES))
    c.add_argument("to")
    c = command("clean", "files of stages in the folder layout")
    c.add_argument("--stages", nargs="+", choices=sorted(files.CLEANABLE), default=sorted(files.CLEANABLE))
    c.add_argument("--repo")
    c.add_argument("--delete", action="store_true")
    c = command("compare", "items that differ between two source folders", base=False)
    c.add_argument("old")
    c.add_argument("new")
    c = command("sync", "clone the configured repositories that are not there", base=False)
    c = command("status", "configured and present repositories", base=False)
    args = p.parse_args(argv)
    spark, conf = _session(), config.load_config(args.config, strict=bool(args.config))
    ws = pipeline.Workspace(spark, getattr(args, "base", ""), conf, provider.client_from_environment())
    show = lambda df: df.show(1000, False)
    name = args.command.replace("-", "_")
    if name == "run":
        for stage, n in pipeline.run(ws, args.skip, args.force).items():
            print(f"{stage}: {n}")
    elif name in pipeline.STAGES:
        more = {"most": args.max_tasks} if name == "code_tasks" else {}
        print(pipeline.STAGES[name](ws, args.force, **more))
    elif name == "report":
        show(pipeline.completion_report(ws))
    elif name == "coverage":
        counts = ws.read("ast_counts")
        show(quality.coverage(ws.read("commits"), counts).orderBy(F.col("repo").asc_nulls_last()))
        show(quality.coverage_issues(ws.read("commits"), counts))
    elif name == "verify":
        done = edits.verify_edits(ws.read("edit_sequences"), ws.read("ast_diffs"))
        show(edits.verification_totals(done))
        show(edits.failure_report(done))
    elif name == "export":
        files.write_lines(pipeline.items(ws) if args.table == "ast_items" else ws.read(args.table), args.to, ["repo", "commit_no"])
    elif name == "clean":
        for path in files.clean(spark, args.base, args.stages, args.repo, dry_run=not args.delete):
            print(path)
    elif name == "compare":
        read = lambda folder: spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.rs").select(F.lit("tree").alias("repo"), F.lit(1).alias("commit_no"), F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{folder.rstrip('/')}/", "").alias("file_path"), F.col("value").alias("content"))
        old, new = (snapshot.last_wins(rust.extract_items(read(x)).where("id is not null"), ["id"], ["file", "line_no"]) for x in (args.old, args.new))
        show(snapshot.compare_trees(old, new))
    else:
        folder = conf.paths.get("repos", "data/repos")
        if name == "sync":
            for repo, cloned in git.sync_repos(conf.repositories, folder).items():
                print(f"{repo}: {'cloned' if cloned else 'not cloned'}")
        else:
            show(quality.repo_status(quality.configured(config.repositories(spark, conf)), git.list_repos(spark, folder)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
