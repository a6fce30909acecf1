"""Documents, line files and templates in the folders of commits."""

import json

import pytest
from pyspark.sql import functions as F

from spindrift.operators import edits
from spindrift.schemas import DDL
from spindrift.sources import documents, files

EDIT = [{"span_before": "a", "span_after": "b"}]


def sequences(spark, n=6):
    meta = {"commit_hash": "h", "author": "é", "commit_message": "m\nn", "timestamp": None, "repository": "r", "file_path": "a.rs", "operation_type": "MODIFIED", "kind": "function"}
    rows = [(f"r{i % 2}", i // 3, f"a.rs::{i}", "fn f() {}", 'why "x"', EDIT * (i % 3 + 1), {"1": [f"l{i}"]}, ["l"], meta) for i in range(n)]
    return spark.createDataFrame(rows, DDL["edit_sequences"])


def listed(base):
    return sorted(str(p.relative_to(base)) for p in base.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def same(a, b):
    columns = sorted(c for c in a.columns if c != "line_no")
    rows = lambda df: sorted(json.dumps([x.asDict(True) if hasattr(x, "asDict") else x for x in r], default=lambda v: v.asDict(True), sort_keys=True) for r in df.select(*columns).collect())
    assert rows(a) == rows(b) and rows(a)


def test_documents_come_back_as_the_table(spark, tmp_path):
    df = sequences(spark)
    documents.write_files(documents.edit_documents(df), str(tmp_path), files.FILES["edit_sequences"])
    assert listed(tmp_path) == sorted(f"r{r}/commit_{c}/edit_sequence_dataset.json" for r in (0, 1) for c in (0, 1))
    same(df, files.read_table(spark, str(tmp_path), "edit_sequences"))
    doc = json.loads((tmp_path / "r0/commit_0/edit_sequence_dataset.json").read_text())
    assert (doc["repository"], doc["commit"], doc["entry_count"], doc["total_edit_spans"]) == ("r0", "commit_0", 2, 1 + 3)
    assert [e["ast_id"] for e in doc["edit_sequences"]] == ["a.rs::0", "a.rs::2"]


def test_other_tables_come_back(spark, tmp_path):
    commits = spark.createDataFrame([("r", 1, "h1", "d", ("a", "e", "t", "m"), [("a.rs", "x")])], DDL["commits"])
    reasoning = spark.createDataFrame([("r", 1, f"f{i}", "a.rs", "ADDED", "because", "h1", "function") for i in range(3)], DDL["reasoning"])
    enhanced = spark.createDataFrame([("r", 1, b, p, f"t{b}{p}", "s", ["f"], {"f": "u"}) for b in (0, 1) for p in (0, 1)], "repo string, commit_no int, batch_no int, place int, task string, reasoning_selection string, selected_functions array<string>, reasoning_update map<string,string>")
    fim = spark.createDataFrame([("r", 1, f"f{i % 2}", "a.rs", "use x;", "MODIFIED", "p", "s", "m", "h1", "a", "m", "k", (1, 2, 3, 4, "w", None), (1, 2, "f", ["ADDED"], True)) for i in range(3)], DDL["fim_samples"])
    items = spark.createDataFrame([("r", 1, f"i{i}", "function", "p", "c\n", "a.rs", ["use x;"], [], None, i) for i in range(12)], DDL["ast_items"])
    tasks = spark.createDataFrame([("r", 1, "h1", ["do", "it"], 2), ("r", 2, "h2", [], 0)], DDL["tasks"])
    counts = documents.write_workspace({"commits": commits, "reasoning": reasoning, "enhanced_tasks": enhanced, "fim_samples": fim, "ast_items": items, "tasks": tasks}, str(tmp_path), "s")
    assert counts == {"commit_data.json": 1, "reasoning.json": 1, "enhanced_tasks.json": 1, "fim_dataset.json": 1, "ast.jsonl": 1, "task.json": 1}
    for name, df in (("commits", commits), ("reasoning", reasoning), ("enhanced_tasks", enhanced.drop("batch_no", "place")), ("fim_samples", fim), ("ast_items", items), ("tasks", tasks.where("task_count > 0"))):
        same(df, files.read_table(spark, str(tmp_path), name))
    assert [json.loads(x)["id"] for x in (tmp_path / "r/commit_1/ast.jsonl").read_text().splitlines()] == [f"i{i}" for i in range(12)]


def test_templates(spark, tmp_path):
    df = sequences(spark, 3)
    tasks = spark.createDataFrame([("r0", 0, ["first", "second"])], "repo string, commit_no int, tasks array<string>")
    documents.write_files(edits.render_templates(df, tasks, "SYS").withColumnRenamed("template", "content"), str(tmp_path), documents.TEMPLATE)
    got = (tmp_path / "r0/commit_0" / documents.TEMPLATE).read_text()
    assert got.startswith("<|im_start|>system\nSYS\n<|im_end|>\n<|im_start|>user\n**Commit Tasks:**\n1. first\n2. second\n<|im_end|>\n<|im_start|>assistant\n\n<update>\n<ast_id>a.rs::0</ast_id>\n")
    assert got.endswith("</update>\n\n<|im_end|>") and got.count("<update>") == 2
    assert json.loads(got.split("<edit_sequence>\n")[1].split("\n</edit_sequence>")[0]) == EDIT


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    good = spark.createDataFrame([(f"r{i}", 1, "old") for i in range(8)], "repo string, commit_no int, content string")
    documents.write_files(good, str(tmp_path), "x.json")
    bad = good.withColumn("content", F.when(F.col("repo") == "r5", F.raise_error(F.lit("broken row")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="broken row"):
        documents.write_files(bad, str(tmp_path), "x.json")
    assert listed(tmp_path) == [f"r{i}/commit_1/x.json" for i in range(8)] and {p.read_text() for p in tmp_path.rglob("x.json")} == {"old"}
    assert not list(tmp_path.glob(".pending*"))
    with pytest.raises(Exception, match="no folder for"):
        documents.write_files(good.withColumn("repo", F.lit("../out")), str(tmp_path), "x.json")
    spark.dataSource.register(documents.CommitFiles)
    with pytest.raises(Exception, match="more than one task"):
        good.withColumn("repo", F.lit("r")).repartition(4).write.format("commit_files").option("path", str(tmp_path)).option("file", "y.json").mode("append").save()
    assert not list(tmp_path.rglob("y.json")) and not list(tmp_path.glob(".pending*"))


def test_replaced_and_empty(spark, tmp_path):
    one = spark.createDataFrame([("r", 1, "a"), ("s", 1, None)], "repo string, commit_no int, content string")
    documents.write_files(one, str(tmp_path), "x.json")
    documents.write_files(one.where("repo = 'r'").withColumn("content", F.lit("b")), str(tmp_path), "x.json")
    assert (tmp_path / "r/commit_1/x.json").read_text() == "b" and (tmp_path / "s/commit_1/x.json").read_text() == ""
    documents.write_files(one.where("false"), str(tmp_path), "z.json")
    assert not list(tmp_path.rglob("z.json"))
