"""Configuration: a YAML file of paths, repositories, processing and task settings."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EnhancedTasks:
    """Settings of the enhanced task stage (defaults are fixed values)."""

    max_ast_elements_per_batch: int = 5
    max_related_group_size: int = 4
    enable_operation_type_reasoning: bool = True
    max_concurrent_llm_calls: int = 5
    max_concurrent_commits: int = 2
    max_ast_elements_per_commit: int = 500


@dataclass(frozen=True)
class Config:
    repositories: dict[str, str] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)
    max_commits: int | None = None
    commit_order: str = "last"
    file_types: tuple[str, ...] = (".rs",)
    enhanced_tasks: EnhancedTasks = EnhancedTasks()


def _scalar(x: str):
    x = x.split(" #")[0].strip()
    if x[:1] in "'\"" and x[-1:] == x[:1] and len(x) > 1:
        return x[1:-1]
    if x.startswith("[") and x.endswith("]"):
        return [_scalar(y) for y in x[1:-1].split(",") if y.strip()]
    if x.lower() in ("true", "false"):
        return x.lower() == "true"
    if x.lower() in ("", "null", "~"):
        return None
    try:
        return int(x)
    except ValueError:
        return x


def parse_yaml(source: str):
    """Maps, lists and plain values of a YAML text, by indentation. No anchors, tags or folded texts."""
    rows = [(len(line) - len(line.lstrip()), line.strip()) for line in source.splitlines() if line.strip() and not line.lstrip().startswith("#")]

    def block(i: int, indent: int):
        if i >= len(rows) or rows[i][0] < indent:
            return None, i
        here = rows[i][0]
        if rows[i][1].startswith("-"):
            out = []
            while i < len(rows) and rows[i][0] == here and rows[i][1].startswith("-"):
                rest = rows[i][1][1:].strip()
                if ":" in rest and rest[:1] not in "'\"":
                    rows[i] = (here + 2, rest)
                    value, i = block(i, here + 1)
                elif rest:
                    value, i = _scalar(rest), i + 1
                else:
                    value, i = block(i + 1, here + 1)
                out.append(value)
            return out, i
        out = {}
        while i < len(rows) and rows[i][0] == here and not rows[i][1].startswith("-"):
            key, _, rest = rows[i][1].partition(":")
            if rest.strip() and not rest.strip().startswith("#"):
                out[key.strip()], i = _scalar(rest), i + 1
            else:
                deeper = i + 1 < len(rows) and (rows[i + 1][0] > here or rows[i + 1][0] == here and rows[i + 1][1].startswith("-"))
                out[key.strip()], i = block(i + 1, rows[i + 1][0]) if deeper else (None, i + 1)
        return out, i

    return block(0, 0)[0] or {}


def find_config(start: str | Path = ".") -> Path | None:
    """config/config.yaml in the folder or the nearest one above it."""
    here = Path(start).resolve()
    return next((p / "config/config.yaml" for p in (here, *here.parents) if (p / "config/config.yaml").is_file()), None)


def load_config(path: str | Path | None = None, strict: bool = True) -> Config:
    """The settings of the file, defaults for what it lacks. Not strict: a missing or broken file gives the defaults."""
    try:
        found = Path(path) if path else find_config()
        if found is None:
            raise FileNotFoundError("config/config.yaml")
        raw = parse_yaml(found.read_text())
    except (OSError, ValueError, IndexError):
        if strict:
            raise
        return Config()
    known = {f.name for f in fields(EnhancedTasks)}
    processing, tasks = raw.get("processing") or {}, raw.get("enhanced_tasks") or {}
    repos = {r["name"]: r.get("url") or "" for r in raw.get("repositories") or [] if isinstance(r, dict) and r.get("name")}
    types = processing.get("file_types") or [".rs"]
    return Config(repos, raw.get("paths") or {}, processing.get("max_commits"), processing.get("commit_order") or "last", tuple(t if t.startswith(".") else f".{t}" for t in types), EnhancedTasks(**{k: v for k, v in tasks.items() if k in known and v is not None}))


def repositories(spark: SparkSession, config: Config) -> DataFrame:
    """name, url of the configured repositories."""
    return spark.createDataFrame(sorted(config.repositories.items()), "name string, url string")
