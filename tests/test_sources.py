import json
import subprocess

import pytest

from spindrift.functions import rust
from spindrift.plans import pipeline
from spindrift.sources import config, files, git
from spindrift.streaming import stateful, store

SOURCE = '''#![allow(x)]
use std::collections::{HashMap, HashSet};
use std::fmt;
// fn not_this() {}
/* fn /* nor */ this() {} */
#[derive(Debug)]
pub struct Point<const N: usize> { x: i32 }
struct Unit;
impl<'a> fmt::Display for Point<3> where Point<3>: Sized {
    fn fmt(&self) -> HashMap<i32, i32> { let s = "fn no() {"; let c = '{'; inner!{ fn no2() {} } fn deep() {} 0 }
}
pub trait Shape { type Out; fn area(&self) -> f64; fn twice(&self) -> f64 { 2.0 } }
mod m { pub const A: [i32; 2] = [1, 2]; pub(crate) async unsafe fn go() {} static mut B: u8 = b'x'; }
type Alias = fn(i32) -> i32;
macro_rules! mac { ($x:expr) => { fn hidden() {} } }
extern "C" { fn c_side(p: *const u8) -> i32; }
union U { a: u8 }
enum E { A, B }
fn raw() -> &'static str { r#"fn no3() { "# }
'''


def test_rust_items():
    rows = rust.extract(SOURCE, "a.rs")
    assert [r["id"] for r in rows] == [
        "a.rs::module", "a.rs::struct::Point", "a.rs::struct::Unit", "a.rs::impl::Point<3>", "a.rs::Point<3>::function::fmt", "a.rs::Point<3>::function::deep", "a.rs::trait::Shape", "a.rs::Shape::function_signature::area",
        "a.rs::Shape::function::twice", "a.rs::mod::m", "a.rs::m::const::A", "a.rs::m::function::go", "a.rs::m::static::B", "a.rs::type::Alias", "a.rs::macro::mac", "a.rs::foreign_mod::extern_C", "a.rs::function_signature::c_side", "a.rs::union::U",
        "a.rs::enum::E", "a.rs::function::raw",
    ]
    by = {r["id"]: r for r in rows}
    assert by["a.rs::module"]["code"] == "#[derive(Debug)]\nuse std::collections::{HashMap, HashSet};\nuse std::fmt;"
    assert by["a.rs::struct::Point"]["code"] == "pub struct Point<const N: usize> { x: i32 }"
    assert by["a.rs::Point<3>::function::fmt"]["imports"] == ["use std::collections::{HashMap, HashSet};", "use std::fmt;"]
    assert by["a.rs::m::function::go"]["code"].startswith("pub(crate) async unsafe fn go")
    assert rust.extract("", "b.rs") == [] and [r["id"].endswith("::f") for r in rust.extract("fn f( {", "c.rs")] == [True]


@pytest.fixture(scope="module")
def repos(tmp_path_factory):
    base = tmp_path_factory.mktemp("repos")
    path = base / "demo"
    path.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    versions = [{"a.rs": "fn f() {\n    a();\n    b();\n    c();\n    d();\n}\n", "n.txt": "x"}, {"a.rs": "fn f() {\n    a();\n    x();\n    c();\n    d();\n}\nfn g() {\n    1;\n    2;\n    3;\n    4;\n}\n"}, {"a.rs": "fn g() {\n    1;\n    2;\n    3;\n    4;\n}\n"}]
    for i, v in enumerate(versions):
        for n, c in v.items():
            (path / n).write_text(c)
        run("add", "-A")
        run("commit", "-q", "-m", f"change {i}\n\nmore")
    (base / "empty").mkdir()
    return base


def test_git_source(spark, repos):
    git.register(spark)
    assert [r.repo for r in git.list_repos(spark, str(repos)).collect()] == ["demo"]
    commits = spark.read.format("git_commits").option("path", f"{repos}/demo").load().orderBy("commit_no").collect()
    assert [c.commit_no for c in commits] == [1, 2, 3] and commits[0].paths == ["a.rs", "n.txt"] and commits[1].metadata.commit_message.startswith("change 1")
    last = spark.read.format("git_commits").option("path", f"{repos}/demo").option("limit", "2").load().orderBy("commit_no").collect()
    assert [c.commit_hash for c in last] == [c.commit_hash for c in commits[1:]]
    tree = spark.read.format("git_tree").option("path", f"{repos}/demo").load()
    assert {(r.commit_no, r.file_path) for r in tree.collect()} == {(1, "a.rs"), (2, "a.rs"), (3, "a.rs")}


def test_commit_order_and_parts(spark, repos):
    git.register(spark)
    read = lambda **o: [(c.commit_no, c.commit_hash) for c in spark.read.format("git_commits").option("folder", str(repos)).options(**o).load().orderBy("commit_no").collect()]
    every = read()
    assert [h for _, h in read(limit=2)] == [h for _, h in every[1:]]
    assert read(limit=2, order="first") == every[:2]
    assert read(parts=1) == read(parts=3) == every
    with pytest.raises(Exception, match="first or last"):
        read(order="middle")


def test_git_stream_reads_new_commits_alone(spark, repos, tmp_path):
    import shutil
    import subprocess

    git.register(spark)
    repos = shutil.copytree(repos, tmp_path / "repos")
    run = lambda repo, *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=N", "-c", "user.email=e@x", *a], check=True, capture_output=True)

    def trigger(kind):
        q = spark.readStream.format(kind).option("folder", str(repos)).option("parts", "3").load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / kind / "state")).trigger(once=True).start(str(tmp_path / kind / "out"))
        q.awaitTermination()
        seen = {tuple(r[:3]) for r in spark.read.parquet(str(tmp_path / kind / "out")).select("repo", "commit_no", "commit_hash").collect()}
        n = q.lastProgress["numInputRows"] if q.lastProgress else 0
        return seen, n

    table = lambda kind: spark.read.format(kind).option("folder", str(repos)).load()
    assert trigger("git_commits")[1] == 3 and trigger("git_tree")[1] == 3
    (repos / "demo/b.rs").write_text("fn b() {}\n")
    run(repos / "demo", "add", "-A")
    run(repos / "demo", "commit", "-q", "-m", "more")
    (repos / "fresh").mkdir()
    run(repos / "fresh", "init", "-q", "-b", "main")
    assert trigger("git_commits")[1] == 1  # a repository without commits has nothing
    (repos / "fresh/c.rs").write_text("fn c() {}\n")
    run(repos / "fresh", "add", "-A")
    run(repos / "fresh", "commit", "-q", "-m", "first")
    seen, n = trigger("git_commits")
    assert n == 1 and seen == {tuple(r) for r in table("git_commits").select("repo", "commit_no", "commit_hash").collect()} and ("fresh", 1) in {s[:2] for s in seen}
    seen, n = trigger("git_tree")
    assert n == 3 and seen == {tuple(r) for r in table("git_tree").select("repo", "commit_no", "commit_hash").collect()}


def test_pipeline_from_git_to_dataset(spark, repos, tmp_path):
    ws = pipeline.Workspace(spark, str(tmp_path / "ws"), config.Config(paths={"repos": str(repos)}))
    done = pipeline.run(ws, skip=["dataset", "enhanced_tasks"])
    assert done["ingest"] == 3 and done["ast_diffs"] == 2
    diffs = {(r.commit_no, r.id): r.status for r in ws.read("ast_diffs").collect()}
    assert diffs == {(2, "a.rs::function::f"): "modified", (2, "a.rs::function::g"): "added", (3, "a.rs::function::f"): "removed"}
    status = lambda: {r.commit_no: (r.status, r.rows) for r in spark.read.parquet(f"{ws.base}/unified_diffs.status").collect()}
    assert status() == {1: ("skipped", 0), 2: ("success", 2), 3: ("success", 1)}
    assert pipeline.run(ws, skip=["dataset", "enhanced_tasks"])["ast_diffs"] == 0  # nothing is done twice
    assert status() == {1: ("skipped", 0), 2: ("skipped", 0), 3: ("skipped", 0)}
    assert sorted(p.name for p in (tmp_path / "ws/documents/demo/commit_2").iterdir()) == ["ast.jsonl", "commit_data.json", "diff_ast.jsonl", "edit_sequence_dataset.json", "edit_sequence_template.txt", "fim_dataset.json", "unified_diffs.jsonl"]
    assert ws.read("ast_diffs").count() == 3
    assert done["tasks"] == 0 and ws.read("tasks").count() == 0  # nobody was asked, so nothing is done
    from spindrift.operators import completion

    prompts = completion.element_prompts(ws.read("edit_sequences"), ws.read("commits"), batch_size=20)
    answer = '{"tasks": [{"task": "t", "reasoning_selection": "r", "selected_functions": ["a.rs::function::f"], "reasoning_update": {"a.rs::function::f": "w"}}, {"task": ""}]}'
    spark.createDataFrame([(r.prompt_hash, answer) for r in prompts.collect()], "prompt_hash string, completion string").write.parquet(f"{ws.base}/completions")
    assert pipeline.enhanced_tasks(ws) == 2
    assert pipeline.build_dataset(ws) >= 2
    kinds = {r.task_type for r in ws.read("dataset").collect()}
    assert "task" in kinds
    report = {r.stage: r.percent for r in pipeline.completion_report(ws).collect()}
    assert report["ast_diffs"] == 100.0
    with pytest.raises(ValueError, match="no such stages"):
        pipeline.run(ws, skip=["nothing"])


def test_folder_layout(spark, tmp_path):
    folder = tmp_path / "base/r/commit_12"
    folder.mkdir(parents=True)
    (folder / "ast.jsonl").write_text('{"id": "a", "code": "1"}\nbroken\n{"id": "a", "code": "2"}\n{"code": "no id"}\n')
    (folder / "reasoning.json").write_text(json.dumps({"commit_hash": "h", "function_reasoning": [{"function_id": "a", "reasoning": "x", "metadata": {"kind": "k"}}, {"function_id": "", "reasoning": "y"}]}, indent=1))
    (folder / "retrieval_labels.json").write_text(json.dumps({"function_labels": {"a": {"hops": {"0": ["b"]}}}}))
    (folder / "fim_dataset.json").write_text("{}")
    base = str(tmp_path / "base")
    assert [(r.repo, r.commit_no, r.code) for r in files.read_keyed_items(spark, base).collect()] == [("r", 12, "2")]
    assert [(r.function_id, r.kind, r.commit_hash) for r in files.read_reasoning(spark, base).collect()] == [("a", "k", "h")]
    assert files.read_table(spark, base, "labels").first().hops == {"0": ["b"]}
    assert files.read_table(spark, base, "unified_diffs").count() == 0
    assert [tuple(r) for r in files.commit_folders(spark, base).collect()] == [("r", 12, 0)]
    assert len(files.clean(spark, base, ["fim"])) == 1 and (folder / "fim_dataset.json").exists()
    assert len(files.clean(spark, base, ["fim", "reasoning"], repo="r", dry_run=False)) == 2 and not (folder / "fim_dataset.json").exists()
    rows = spark.createDataFrame([("r", 1, "b", 2), ("r", 1, "a", 1)], "repo string, commit_no int, id string, n int")
    doc = json.loads(files.as_documents(rows, ["repo", "commit_no"], "entries", ["id"]).first().document)
    assert doc == {"repo": "r", "commit_no": 1, "entries": [{"id": "a", "n": 1}, {"id": "b", "n": 2}]}
    files.write_lines(rows, str(tmp_path / "out"), ["repo"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_config(tmp_path):
    (tmp_path / "config").mkdir()
    (tmp_path / "config/config.yaml").write_text('paths:\n  repos: "x/y"  # here\nrepositories:\n  - name: a\n    url: "https://h/a"\n  - url: "nameless"\nprocessing:\n  max_commits: null\n  file_types: [".rs", "py"]\nenhanced_tasks:\n  max_ast_elements_per_batch: 7\n  other: true\n')
    c = config.load_config(config.find_config(tmp_path))
    assert c.repositories == {"a": "https://h/a"} and c.paths == {"repos": "x/y"} and c.max_commits is None and c.file_types == (".rs", ".py")
    assert c.enhanced_tasks.max_ast_elements_per_batch == 7 and c.enhanced_tasks.max_related_group_size == 4
    assert config.load_config(tmp_path / "none", strict=False) == config.Config()
    with pytest.raises(OSError):
        config.load_config(tmp_path / "none")


def stream(spark, tmp_path, name, schema, batches, plan):
    source = tmp_path / f"{name}-in"
    source.mkdir()
    df = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:
        for i, rows in enumerate(batches):
            (source / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


COMMITS = "repo string, commit_no int, prev_no int, items array<struct<id:string,code:string>>"


def commit(no, prev, repo="r", **items):
    return {"repo": repo, "commit_no": no, "prev_no": prev, "items": [{"id": i, "code": c} for i, c in items.items()]}


def test_commits_out_of_order_give_the_batch_diff(spark, tmp_path):
    import random

    from spindrift.operators import snapshot

    store.use_rocksdb(spark)
    rng, commits = random.Random(3), []
    for repo in ("r", "s"):
        state = {}
        for no in range(1, 13):
            state = {i: rng.choice("xyz") for i in "abcdefgh" if rng.random() < 0.7} if no != 5 else {}
            commits.append(commit(2 * no, 2 * no - 2 if no > 1 else None, repo, **state))
    items = [(c["repo"], c["commit_no"], x["id"], "f", "k", x["code"], None) for c in commits for x in c["items"]]
    table = spark.createDataFrame(items, "repo string, commit_no int, id string, file string, kind string, code string, imports array<string>")
    numbers = spark.createDataFrame([(c["repo"], c["commit_no"]) for c in commits], "repo string, commit_no int")
    want = {tuple(r) for r in snapshot.snapshot_diff(table, numbers).select("repo", "commit_no", "id", "status").collect()}
    rng.shuffle(commits)
    rows = stream(spark, tmp_path, "shuffled", COMMITS, [commits[i : i + 8] for i in range(0, 24, 8)], lambda s: stateful.commit_diffs(s, buckets=3))
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    batch = stateful.as_commits(table, numbers).collect()
    assert {(r.repo, r.commit_no, r.prev_no, len(r["items"])) for r in batch} == {(c["repo"], c["commit_no"], c["prev_no"], len(c["items"])) for c in commits}


def test_a_lost_commit_is_waited_for_and_then_passed_over(spark, tmp_path):
    import time

    store.use_rocksdb(spark)
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(map(json.dumps, [commit(1, None, a="1"), commit(3, 2, a="3", b="1")])))
    df = stateful.commit_diffs(spark.readStream.schema(COMMITS).json(str(source)), buckets=1, patience=5.0)
    q = df.writeStream.format("memory").queryName("lost").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        ends = time.time() + 60
        while time.time() < ends and not spark.table("lost").count():  # timers keep batches coming, so the stream is never through
            time.sleep(0.5)
        assert {tuple(r) for r in spark.table("lost").collect()} == {("r", 3, "a", "modified"), ("r", 3, "b", "added")}
    finally:
        q.stop()


def test_streams(spark, tmp_path):
    chunks = [[{"head": 0, "seq": i} for i in range(14)], [{"head": 0, "seq": 14 + i} for i in range(3)]]
    rows = stream(spark, tmp_path, "fifo", "head int, seq bigint", chunks, lambda s: stateful.fifo_store(s, 16))
    assert [(r.slot, r.evicted, r.size) for r in sorted(rows, key=lambda r: r.seq)][-3:] == [(8, 6, 11), (9, 6, 11), (10, 6, 11)]
    seqs = [[{"key": "k", "seq": 1, "projected": [[1, 0], [0, 2]], "inputs": [[0, 4], [1, 0]]}], [{"key": "k", "seq": 2, "projected": [[1, 1]], "inputs": [[1, 1]]}]]
    rows = stream(spark, tmp_path, "decayed", "key string, seq bigint, projected array<array<double>>, inputs array<array<double>>", seqs, lambda s: stateful.decayed_state(s, 2))
    assert len(rows) == 2 and all(abs(sum(x * x for x in v) - 1) < 1e-9 for r in rows for v in r.state)
