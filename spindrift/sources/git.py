"""Git repositories as data sources, for tables and streams: git_commits and git_tree.

Nothing is checked out or copied: blobs are read at their commit. The driver plans parts of repositories and never lists commits: a task
lists its repository and reads its share of the list. A stream's offset is the last commit of each repository, so a trigger reads the
commits since the last one; repositories that are new in the folder are read from their first commit. Repositories lie on a file system
that the executors see.

    spark.dataSource.register(GitCommits)
    spark.read.format("git_commits").option("path", "/repos/a,/repos/b").option("limit", "100").option("order", "first").load()
    spark.readStream.format("git_commits").option("folder", "/repos").load()
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BRANCHES = ("main", "master")


def git_dir(repo: str) -> str | None:
    """The .git folder, also if it is put away under another name."""
    return next((d for n in (".git", ".git_disabled") if os.path.isdir(d := os.path.join(repo, n))), None)


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    """Output of a git command on the repository; its errors are raised with git's words."""
    done = subprocess.run(["git", "-c", "safe.directory=*", f"--git-dir={git_dir(repo) or repo}", *args], input=data, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout


def has_branch(repo: str, branch: str) -> bool:
    try:
        git(repo, "show-ref", "--verify", "--quiet", f"refs/heads/{branch}")
    except RuntimeError:
        return False
    return True


def branch_of(repo: str) -> str:
    """main, master or the current branch."""
    return next((b for b in BRANCHES if has_branch(repo, b)), "HEAD")


def last_commit(repo: str) -> str:
    """Hash of the branch's last commit; empty if it has none."""
    try:
        return git(repo, "rev-parse", "--verify", "--quiet", branch_of(repo)).decode().strip()
    except RuntimeError:
        return ""


def commit_hashes(repo: str, limit: int | None = None, order: str = "last", until: str | None = None) -> list[str]:
    """Hashes up to a commit (the branch's last one), from the oldest on; with a limit the newest or, by order "first", the oldest ones."""
    found = git(repo, "rev-list", "--reverse", *([f"--max-count={limit}"] if limit and order == "last" else []), until or branch_of(repo)).decode().split()
    return found[:limit] if limit and order == "first" else found


def new_commits(repo: str, since: str, until: str) -> list[tuple[int, str]]:
    """Numbered commits that came after one (empty: from the first on); numbers go on from what that one had before it.

    Where a merge brings in commits that are older than those read before, they get the next numbers.
    """
    known = int(git(repo, "rev-list", "--count", since)) if since else 0
    return list(enumerate(git(repo, "rev-list", "--reverse", f"{since}..{until}" if since else until).decode().split(), known + 1))


def touched_files(repo: str, commit: str) -> list[str]:
    return [p for p in git(repo, "diff-tree", "--no-commit-id", "--name-only", "-r", "--root", "-z", commit).decode("utf-8", "replace").split("\0") if p]


def tree(repo: str, commit: str, extensions: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    """(path, content) of the files at a commit, contents read by one process; bytes that are no UTF-8 are dropped."""
    entries = [e.split("\t", 1) for e in git(repo, "ls-tree", "-r", "-z", commit).decode("utf-8", "replace").split("\0") if e]
    wanted = [(path, meta.split()[2]) for meta, path in entries if meta.split()[1] == "blob" and path.endswith(extensions)]
    out, at = git(repo, "cat-file", "--batch", data="\n".join(h for _, h in wanted).encode()) if wanted else b"", 0
    for path, _ in wanted:
        end = out.index(b"\n", at)
        size = int(out[at:end].split()[2])
        yield path, out[end + 1 : end + 1 + size].decode("utf-8", "ignore")
        at = end + 2 + size


class _Share(InputPartition):
    """One of several equal runs of a repository's commits, all of them or those between two."""

    def __init__(self, repo: str, part: int, parts: int, since: str | None = None, until: str | None = None):
        self.repo, self.part, self.parts, self.since, self.until = repo, part, parts, since, until


class _Source:
    """What readers of tables and streams share: options, parts of repositories, and the rows of a share (``rows``)."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.folder = options.get("folder")
        self.limit, self.order = int(options["limit"]) if options.get("limit") else None, options.get("order", "last")
        if self.order not in ("first", "last"):
            raise ValueError(f"order is first or last, not {self.order!r}")
        self.extensions = tuple(e for e in options.get("extensions", ".rs").split(",") if e)
        self.parts = int(options.get("parts", "8"))

    def repos(self) -> list[str]:
        return self.paths or repos_in(self.folder or "")

    def shares(self, repo: str, since: str | None = None, until: str | None = None) -> list[InputPartition]:
        return [_Share(repo, i, self.parts, since, until) for i in range(self.parts)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        p = partition
        if p.since is None:
            numbered = list(enumerate(commit_hashes(p.repo, self.limit, self.order), 1)) if last_commit(p.repo) else []
        else:
            numbered = new_commits(p.repo, p.since, p.until)
        n, name = len(numbered), os.path.basename(p.repo.rstrip("/"))
        for no, commit in numbered[n * p.part // p.parts : n * (p.part + 1) // p.parts]:
            yield from self.rows(p.repo, name, no, commit)


class _Table(_Source, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [s for repo in self.repos() for s in self.shares(repo)]


class _Stream(_Source, DataSourceStreamReader):
    """Offsets are JSON maps of repository to hash. A limit doesn't apply."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {repo: found for repo in self.repos() if (found := last_commit(repo))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [s for repo, until in sorted(end.items()) if until != start.get(repo) for s in self.shares(repo, start.get(repo, ""), until)]

    def commit(self, end: dict) -> None:
        pass


class _Commits:
    def rows(self, repo: str, name: str, no: int, commit: str) -> Iterator[tuple]:
        fields = git(repo, "show", "-s", "--format=%an%n%ae%n%ad%n%B", commit).decode("utf-8", "replace").strip().split("\n", 3)
        fields += ["N/A"] * (4 - len(fields))
        diff = git(repo, "show", commit).decode("utf-8", "replace")
        yield name, no, commit, diff, tuple(fields), touched_files(repo, commit)


class _Tree:
    def rows(self, repo: str, name: str, no: int, commit: str) -> Iterator[tuple]:
        for path, content in tree(repo, commit, self.extensions):
            yield name, no, commit, path, content


class _CommitTable(_Commits, _Table):
    pass


class _CommitStream(_Commits, _Stream):
    pass


class _TreeTable(_Tree, _Table):
    pass


class _TreeStream(_Tree, _Stream):
    pass


class GitCommits(DataSource):
    """repo, commit_no (from 1, oldest first), commit_hash, diff (with header and message), metadata, paths touched."""

    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return "repo string, commit_no int, commit_hash string, diff string, metadata struct<author_name:string,author_email:string,commit_date:string,commit_message:string>, paths array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _CommitTable(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _CommitStream(self.options)


class GitTree(DataSource):
    """repo, commit_no, commit_hash, file_path, content of every file of the wanted extensions at every commit."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "repo string, commit_no int, commit_hash string, file_path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeTable(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TreeStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitCommits)
    spark.dataSource.register(GitTree)


def repos_in(folder: str) -> list[str]:
    """Paths of the repositories in a folder, by name."""
    return [p for n in sorted(os.listdir(folder)) if git_dir(p := os.path.join(folder, n))] if os.path.isdir(folder) else []


def list_repos(spark: SparkSession, folder: str):
    """repo, path of the repositories in a folder, by name."""
    return spark.createDataFrame([(os.path.basename(p), p) for p in repos_in(folder)], "repo string, path string").orderBy("repo")


def sync_repos(repositories: dict[str, str], folder: str) -> dict[str, bool]:
    """Clones each configured repository that is not there; whether it was cloned. Any location that git accepts will do."""
    out = {}
    for name, url in repositories.items():
        path = os.path.join(folder, name)
        if git_dir(path):
            out[name] = False
            continue
        out[name] = subprocess.run(["git", "clone", "--quiet", url, path], capture_output=True, check=False).returncode == 0
    return out
