import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.functions import text, textdiff, untyped
from spindrift.operators import chunking, codetasks, completion, dataset, edits, fim, memory, quality, related, snapshot
from spindrift.plans.queries import document_diffs

ITEM = "repo string, commit_no int, id string, file string, kind string, code string, imports array<string>"


def items(spark, rows):
    return spark.createDataFrame([(r, n, i, "f.rs", "function_item", c, im) for r, n, i, c, im in rows], ITEM)


def test_snapshot_diff_against_a_full_outer_join(spark):
    rng = random.Random(3)
    rows = [(r, n, f"i{i}", rng.choice(["x", "y", None]), rng.choice([["u"], ["u", "v"], ["v", "u"], None])) for r in "ab" for n in (1, 2, 4, 7) for i in range(8) if rng.random() < 0.7]
    df = items(spark, rows)
    got = {(r.repo, r.commit_no, r.id): (r.status, r.before_code, r.after_code) for r in snapshot.snapshot_diff(df).collect()}
    want, have = {}, {}
    for r, n, i, c, im in rows:
        have.setdefault((r, n), {})[i] = (c, tuple(sorted(set(im))) if im is not None else None)
    for r in "ab":
        for p, n in ((1, 2), (2, 4), (4, 7)):
            old, new = have.get((r, p), {}), have.get((r, n), {})
            for i in old.keys() | new.keys():
                if i not in old:
                    want[r, n, i] = ("added", None, new[i][0])
                elif i not in new:
                    want[r, n, i] = ("removed", old[i][0], None)
                elif old[i] != new[i]:
                    want[r, n, i] = ("modified", old[i][0], new[i][0])
    assert got == want


def test_snapshot_diff_of_nothing_and_of_itself(spark):
    assert snapshot.snapshot_diff(items(spark, [])).count() == 0
    same = [("a", n, "i", "x", ["u"]) for n in (1, 2)]
    assert snapshot.snapshot_diff(items(spark, same)).count() == 0
    one = snapshot.snapshot_diff(items(spark, same[:1]), spark.createDataFrame([("a", 1), ("a", 2)], "repo string, commit_no int"))
    assert [(r.commit_no, r.status) for r in one.collect()] == [(2, "removed")]


def test_pair_diff_is_the_diff_of_two_snapshots(spark):
    rng = random.Random(4)
    state = lambda: rng.choice([None, ("x", ["u"]), ("x", ["v", "u"]), ("y", None), (None, ["u", "v"])])
    pairs = [(f"i{i}", state(), state()) for i in range(60)]
    rows = [("r", n, i, *s) for i, *both in pairs for n, s in enumerate(both, 1) if s]
    want = snapshot.snapshot_diff(items(spark, rows), spark.createDataFrame([("r", 1), ("r", 2)], "repo string, commit_no int"))
    side = lambda s: s and ("f.rs", "function_item", *s)
    kind = "struct<file:string,kind:string,code:string,imports:array<string>>"
    df = spark.createDataFrame([("r", 2, i, side(a), side(b)) for i, a, b in pairs], f"repo string, commit_no int, id string, old {kind}, new {kind}")
    got = snapshot.pair_diff(df).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 20


def test_texts_are_dealt_once_by_commit(spark):
    plan = document_diffs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "source" in x or "Exchange hashpartitioning" in x and "repo" in x]
    assert 0 < len(dealt) <= 7  # twice the ids and the text by its commit (a reused exchange), and once the text that meets the next


def test_edits_with_an_empty_side_need_no_matcher(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    plain = textdiff.edits
    monkeypatch.setattr(textdiff, "edit_spans", textdiff._arrow(textdiff.PLACED)(lambda b, a: (seen.add(int((b.notna() | a.notna()).sum())), pd.Series([plain(x or "", y or "") for x, y in zip(b, a)]))[1]))
    texts = ["a\r\nb", "a\n\n", "a\x0bb\x1cc\u2028", "\n"]
    d = diffs_of(spark, [(None, t) for t in texts] + [(t, None) for t in texts] + [("", t) for t in texts])
    got = {r.ast_id: [(e.at, e.n, e.span_before, e.span_after) for e in r.edit_places] for r in edits.edit_sequences(d, placed=True).collect()}
    sides = [("", t) for t in texts] + [(t, "") for t in texts] + [("", t) for t in texts]
    assert got == {f"f{k}": [(e["at"], e["n"], e["span_before"], e["span_after"]) for e in plain(a, b)] for k, (a, b) in enumerate(sides, 1)}
    assert seen.value == 0


def test_verification_deals_no_texts(spark):
    d = diffs_of(spark, PAIRS)
    done = edits.verification_totals(edits.verify_edits(edits.edit_sequences(d, placed=True), d))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    join = [x for x in plan[plan.index("Join LeftOuter") :].splitlines() if "Project" in x][:1]
    assert join and "sha2" in plan[plan.index("Join LeftOuter") :] and "sha2" not in plan[: plan.index("Join LeftOuter")]


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), ("b", 1, None)], "id string, line_no int, code string")
    assert sorted(tuple(r) for r in snapshot.last_wins(df, ["id"], ["line_no"]).collect()) == [("a", 2, "y"), ("b", 1, None)]
    assert snapshot.id_collisions(df.where("id is not null"), ["id"]).collect()[0].n == 2


def diffs_of(spark, pairs):
    rows = [("r", k, f"f{k}", "f.rs", "function_item", "modified" if a is not None and b is not None else "added" if a is None else "removed", a, b) for k, (a, b) in enumerate(pairs, 1)]
    df = spark.createDataFrame(rows, "repo string, commit_no int, id string, file string, kind string, status string, before_code string, after_code string")
    df = df.withColumns({"code_changed": F.when(F.col("status") == "modified", ~F.col("before_code").eqNullSafe(F.col("after_code"))), "imports_changed": F.lit(None).cast("boolean"), "before_imports": F.lit(None).cast("array<string>"), "after_imports": F.lit(None).cast("array<string>"), "line_no": F.lit(1)})
    return df.withColumn("commit_metadata", F.lit(None).cast("struct<author_name:string,author_email:string,commit_date:string,commit_message:string,commit_hash:string>"))


A = "fn f() {\n    a();\n    b();\n    c();\n}"
PAIRS = [(A, A.replace("b()", "x()")), ("fn f() {\n    a();\n    b();\n}", "fn f() {\n    a();\n    x();\n    b();\n}"), ("fn f() {\n    a();\n    b();\n}", "fn f() {\n    b();\n}"), ("fn f() {}", "fn f() {}\n"), (None, "new"), ("old", None), ("", "")]


def test_edit_sequences_lead_to_the_new_code(spark):
    d = diffs_of(spark, PAIRS)
    seq = edits.edit_sequences(d, placed=True)
    assert seq.count() == 6  # the empty one has none
    assert {r.ast_id: r.passed for r in edits.verify_edits(seq, d).collect()} == {f"f{i}": True for i in range(1, 7)}
    compat = {r.ast_id: r.passed for r in edits.verify_edits(seq, d, compat=True).collect()}
    assert not compat["f2"] and compat["f1"] and compat["f3"]
    report = edits.failure_report(edits.verify_edits(seq, d, compat=True)).collect()
    assert [r.ast_id for r in report] == ["f2"] and 0 < report[0].similarity < 1
    assert edits.verify_edits(seq, d.where("id <> 'f1'")).where("ast_id = 'f1'").first().reason == "not among the changes"
    row = seq.where("ast_id = 'f5'").first()
    assert row.original_function == edits.NEW_CODE and row.reasoning == edits.NO_REASONING and row.metadata.operation_type == "ADDED"


def test_unified_diffs(spark):
    d = diffs_of(spark, PAIRS[:1]).withColumns({"imports_changed": F.lit(True), "before_imports": F.array(F.lit("use a;")), "after_imports": F.array(F.lit("use b;"))})
    r = edits.unified_diffs(d).first()
    assert r.diff_string == "@@ -3 +3 @@\n-    b();\n+    x();" and r.imports_diff_string == "@@ -1 +1 @@\n-use a;\n+use b;"
    full = edits.unified_diffs(d, simple=False, separate_imports=False).first()
    assert full.diff_string.startswith("--- a/f.rs\n+++ b/f.rs\n@@ -1,5 +1,5 @@\n fn f() {\n\n") and full.imports_diff_string == ""


def test_fim_samples(spark):
    d = snapshot.with_spans(diffs_of(spark, PAIRS))
    compat = {r.function_id: r for r in fim.fim_samples(d, compat=True).collect()}
    assert (compat["f1"].fim_prefix, compat["f1"].fim_middle, compat["f1"].fim_suffix) == ("fn f() {\n    a();", "    x();", "    c();\n}")
    assert compat["f1"].diff_context.exact_change_start == 2 and compat["f1"].diff_context.exact_change_end == 3 and compat["f1"].diff_context.context_window == "[0:5] of function"
    assert "f2" not in compat and (compat["f3"].fim_prefix, compat["f3"].fim_middle, compat["f3"].fim_suffix) == ("", "", "")
    mine = {r.function_id: r for r in fim.fim_samples(d).collect()}
    assert (mine["f2"].fim_prefix, mine["f2"].fim_middle, mine["f2"].fim_suffix) == ("fn f() {\n    a();", "    x();", "    b();\n}")
    assert (mine["f3"].fim_prefix, mine["f3"].fim_middle, mine["f3"].fim_suffix) == ("fn f() {", "", "    b();\n}")
    assert mine["f5"].fim_middle == "new" and mine["f6"].diff_context.deleted_code == "old" and mine["f6"].operation_type == "DELETE"
    assert mine["f1"].series_info is None
    twice = d.where("id = 'f1'").unionByName(d.where("id = 'f1'").withColumn("line_no", F.lit(2)))
    assert sorted((r.series_info.step, r.series_info.total_steps) for r in fim.fim_samples(twice).collect()) == [(1, 2), (2, 2)]


def test_text_functions(spark):
    rows = [("a", "  x\ny \n\n"), ("b", ""), ("c", None), ("d", "use a;\n  import b\nx\n#include <c>")]
    df = spark.createDataFrame(rows, "id string, code string")
    c = F.col("code")
    got = {r.id: r for r in df.select("id", text.line_count(c).alias("n"), text.nonempty_line_count(c).alias("m"), text.import_lines(c).alias("i"), text.in_line_range(c, 1, 3).alias("ok")).collect()}
    assert (got["a"].n, got["a"].m, got["a"].ok) == (2, 2, True) and (got["b"].n, got["b"].ok) == (0, False) and got["c"].ok is False
    assert got["d"].i == "use a;\nimport b\n#include <c>" and got["c"].i == ""


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("fn f() {\n  a;\n  b;\n}\nx", ("fn f() {", "  a;\n  b;", "}\nx")),
        ("fn f() {\n  if x {\n  }\n}", ("fn f() {", "  if x {\n  }", "}")),
        ("fn f() {}\nfn g() {\n  y\n}", None),  # the first block is empty, and four lines are too few
        ("a\nb\nc\nd\ne", ("a", "b\nc", "d\ne")),
        ("} {\na\nb\n}\nc\nd", None),
        ("a\nb", None),
    ],
)
def test_mask_span(spark, code, want):
    got = spark.createDataFrame([(code,)], "code string").select(text.mask_span(F.col("code")).alias("m")).first().m
    if code.startswith("}"):  # depth starts below zero, so no block closes at zero: the middle third is taken
        assert tuple(got) == ("} {\na", "b\n}", "c\nd")
    else:
        assert (tuple(got) if got else None) == want


def simulate(ranks, wanted):
    """The cursor, row by row."""
    out, at = {}, 0
    for kind, ok in wanted:
        n = 0
        while n < ok[1] and at < len(ranks):
            if ranks[at][1][ok[0]]:
                out[ranks[at][0]] = kind
                n += 1
            at += 1
    return out


def test_quota_cursor_against_a_loop(spark):
    rng, rows, want = random.Random(5), [], {}
    for g in range(40):
        n = rng.randrange(0, 14)
        flags = [[rng.random() < 0.6 for _ in range(3)] for _ in range(n)]
        q = [rng.randrange(0, 5) for _ in range(3)]
        rows += [(g, i, *f, *q) for i, f in enumerate(flags)]
        for k, v in simulate([(i, f) for i, f in enumerate(flags)], [("x", (0, q[0])), ("y", (1, q[1])), ("z", (2, q[2]))]).items():
            want[g, k] = v
    df = spark.createDataFrame(rows, "g int, i int, a boolean, b boolean, c boolean, wx int, wy int, wz int")
    got = codetasks.assign_kinds(df, ["g"], ["i"], {"x": "a", "y": "b", "z": "c"}, {"x": "wx", "y": "wy", "z": "wz"}).where("task_type is not null").collect()
    assert {(r.g, r.i): r.task_type for r in got} == want


def test_quotas(spark):
    df = spark.createDataFrame([(1,), (3,), (5,), (0,), (None,)], "d int")
    q = codetasks.quotas(F.lit(30), F.col("d"), 100)
    assert [tuple(r) for r in df.select(*q.values()).collect()] == [(2, 1, 1), (4, 3, 1), (8, 5, 2), (10, 10, 3), (10, 10, 3)]


def test_labels(spark):
    hops = lambda a, b, c: {"0": [f"a{i}" for i in range(a)], "1": [f"b{i}" for i in range(b)], "2": [f"c{i}" for i in range(c)]}
    df = spark.createDataFrame([(1, hops(3, 5, 40)), (2, hops(25, 1, 1)), (3, {"0": ["x"]})], "id int, hops map<string,array<string>>")
    got = {r.id: r.l for r in df.select("id", text.merge_labels(F.col("hops"), F.col("id").cast("string")).alias("l")).collect()}
    assert len(got[1]) == 20 and got[1][:8] == ["a0", "a1", "a2", "b0", "b1", "b2", "b3", "b4"] and len({*got[1][8:]}) == 12
    assert got[2] == [f"a{i}" for i in range(20)] and got[3] == ["x"]


def test_chunks(spark):
    hunk, other = "@@ -1 +1 @@\nx\n", "@@ -5 +5 @@ fn foo()\ny\n"
    one = f"diff --git a/p b/p\nindex\n{hunk}{other}{hunk}"
    df = spark.createDataFrame([(1, "head\n" + one + one), (2, "none"), (3, None)], "id int, diff string")
    got = {r.id: r.c for r in df.select("id", chunking.by_file(F.col("diff"), 10_000).alias("c")).collect()}
    assert got[1] == [one, one] and got[2] == ["none"]
    small = {r.id: r.c for r in df.select("id", chunking.by_file(F.col("diff"), 30).alias("c")).collect()}
    assert small[1] == [hunk + other, hunk, hunk + other, hunk]
    routed = chunking.chunks(df, "diff", 30).where("id < 3").collect()
    assert sum(r.id == 1 for r in routed) == 4 and [r.chunked for r in routed if r.id == 2] == [False]


def test_batches(spark):
    df = spark.range(45).select(F.lit("g").alias("g"), F.col("id").alias("item"))
    got = chunking.batches(df, ["g"], ["item"], 20).orderBy("batch_no").collect()
    assert [len(r["items"]) for r in got] == [20, 20, 5] and got[0]["items"] == list(range(20))
    assert chunking.oversize(df, ["g"], 44).count() == 0 and chunking.oversize(df, ["g"], 45).count() == 45


TASKS = [
    ('{"task": "t", "reasoning_selection": "r", "selected_functions": ["a::f<\'x>"], "reasoning_update": {"a::f<\'x>": "why"}}', True),
    ('{"task": "t", "reasoning_selection": "r", "selected_functions": [], "reasoning_update": {}}', False),
    ('{"task": " ", "reasoning_selection": "r", "selected_functions": ["a"], "reasoning_update": {"a": "w"}}', False),
    ('{"task": "t", "reasoning_selection": "r", "selected_functions": ["a", "b"], "reasoning_update": {"a": "w"}}', False),
    ('{"task": "t", "reasoning_selection": "r", "selected_functions": ["a"], "reasoning_update": {"a": 5}}', False),
    ('{"task": "t", "reasoning_selection": "r", "selected_functions": ["a"], "reasoning_update": ["a"]}', False),
    ('{"task": 3, "reasoning_selection": "r", "selected_functions": ["a"], "reasoning_update": {"a": "w"}}', False),
    ('{"reasoning_selection": "r"}', False),
    ("no json", False),
]


def test_task_validation(spark):
    df = spark.createDataFrame(TASKS, "j string, ok boolean")
    assert all(bool(r.v) == r.ok for r in df.select("ok", F.coalesce(untyped.valid_task(F.try_parse_json("j")), F.lit(False)).alias("v")).collect())


def test_completion_stages(spark):
    commits = spark.createDataFrame([("r", 1, "h1", "short"), ("r", 2, "h2", "diff --git a/x b/x\n" + "y" * 30 + "\ndiff --git a/z b/z\nw")], "repo string, commit_no int, commit_hash string, diff string")
    prompts = completion.task_prompts(commits, most=30)
    assert prompts.count() == 3
    answers = prompts.select("prompt_hash", F.lit('```json\n{"tasks": ["a", "a"]}\n```').alias("completion"))
    got = {r.commit_no: r.tasks for r in completion.parse_tasks(completion.from_table(prompts, answers)).collect()}
    assert got == {1: ["a", "a"], 2: ["a"]}  # repeats go only from a text that was cut
    assert {tuple(r.tasks) for r in completion.parse_tasks(completion.from_table(prompts, answers.where("false"))).collect()} == {()}


def test_task_rows(spark):
    tasks = spark.createDataFrame([("r", 1, "h", 0, "do", "because", ["b", "a", "c"], {"a": "why a"})], "repo string, commit_no int, commit_hash string, task_no int, task string, reasoning_selection string, selected_functions array<string>, reasoning_update map<string,string>")
    diffs = spark.createDataFrame([("r", 1, "a", "-x"), ("r", 1, "b", "")], "repo string, commit_no int, id string, diff_string string")
    row = dataset.task_rows(tasks, diffs).first()
    assert row.output == (
        "<|im_start|>selector\n<|reasoning|>analysis\nbecause<|reasoning_end|>\n<|select|>b<|select|>a<|select|>c<|im_end|>\n<|im_start|>worker\n"
        "<|selected|>b\n<|selection_end|>\n<|selected|>a\n<|context|>-x<|context_end|>\n<|reasoning|>plan\nwhy a<|reasoning_end|>\n<|action|>edit\n-x\n<|selection_end|>\n<|selected|>c\n<|selection_end|>\n<|im_end|>"
    )


def test_coverage(spark):
    commits = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "repo string, commit_no int")
    counts = spark.createDataFrame([("a", 1, 5, False), ("a", 2, 0, False), ("b", 1, 9, True)], "repo string, commit_no int, n int, error boolean")
    got = {r.repo: tuple(r)[1:] for r in quality.coverage(commits, counts).collect()}
    assert got == {"a": (3, 1, 1, 1, 0, 33), "b": (1, 0, 0, 0, 1, 0), None: (4, 1, 1, 1, 1, 25)}
    assert quality.coverage_issues(commits, counts).count() == 3


def test_related(spark):
    e = spark.createDataFrame([("r", 1, "f::run", "M", []), ("r", 1, "f::run_all", "M", []), ("r", 1, "f::run_x", "A", ["g::y"]), ("r", 1, "g::y", "M", ["k"]), ("r", 1, "g::z", "M", ["k"])], "repo string, commit_no int, ast_id string, operation_type string, retrieved_labels array<string>")
    assert {(r.a, r.b) for r in related.related_pairs(e).collect()} == {("f::run", "f::run_all"), ("f::run_x", "g::y")}
    groups = {r.ast_id: r.group_no for r in related.related_groups(e).collect()}
    assert groups["g::y"] == groups["g::z"] and len(set(groups.values())) == 4
    many = spark.createDataFrame([("r", 1, f"f::{i}", "M", ["k"]) for i in range(6)], e.schema)
    assert sorted(r.place for r in related.related_groups(many).collect()) == [0, 0, 1, 1, 2, 3]


@pytest.mark.parametrize(("layers", "wanted", "want"), [(36, None, [0, 6, 12, 18, 24, 30]), (36, 6, [0, 6, 12, 18, 24, 30]), (36, 12, list(range(0, 36, 3))), (36, 36, list(range(36))), (36, 1, [0]), (12, None, [0, 6]), (6, None, [0])])
def test_retrieval_layers(spark, layers, wanted, want):
    df = spark.createDataFrame([(layers, wanted)], "l int, r int")
    assert df.select(memory.retrieval_layers(F.col("l"), F.col("r")).alias("x")).first().x == want


@pytest.mark.parametrize("internal", [False, True])
@pytest.mark.parametrize("external", [False, True])
def test_gates_add_up(spark, internal, external):
    df = spark.createDataFrame([([0.3, -2.0, 5.0], [True, internal, external])], "z array<double>, on array<boolean>")
    g = df.select(memory.gate(F.col("z"), F.col("on")).alias("g")).first().g
    assert abs(sum(g) - 1) < 1e-5 and [x > 0 for x in g] == [True, internal, external]


def test_store(spark):
    assert memory.evicted(14, 3, 16) == 6 and memory.evicted(5, 3, 16) == 0
    config = memory.StoreConfig(memory_size=64, chunk_size=4, k=8)
    def tokens(n, base):
        return spark.range(n).select(F.lit(0).alias("head"), F.col("id").alias("pos"), F.array(F.col("id").cast("double") + base, F.lit(1.0)).alias("key"), F.array(F.col("id").cast("double")).alias("val"))
    store = memory.append(None, memory.chunk(tokens(58, 0), config), config)
    assert memory.store_size(store) == 14 and store.where("slot = 0").first().rep == [1.5, 1.0]
    store = memory.append(store, memory.chunk(tokens(13, 1000), config), config)
    assert memory.store_size(store) == 11 and store.where("slot = 0").first().rep == [25.5, 1.0]
    s = memory.stats(store, config).first()
    assert (s.size, s.is_ready, s.usage) == (11, True, 11 / 16)
    assert memory.stats(memory.reset(store), config).first().size == 0
    q = spark.createDataFrame([(7, 0, [1.0, 0.0])], "query_id int, head int, q array<double>")
    assert [r.slot for r in memory.retrieve(store, q, config).orderBy("rank").collect()] == [10, 9]
    assert memory.retrieve(store, q, config, n=50).count() == 11  # fewer chunks than asked for
    out = memory.attend(memory.retrieve(store, q, config), q).first().context
    assert out[0] == pytest.approx(11.0 - 1 / (1 + 2.718281828), abs=1.0)


def test_recurrent_state(spark):
    eye = [[1.0, 0.0], [0.0, 1.0]]
    df = spark.createDataFrame([(eye, [[1.0, 0.0], [0.0, 2.0]], [[0.0, 4.0], [1.0, 0.0]])], "m array<array<double>>, p array<array<double>>, x array<array<double>>")
    import numpy as np

    want = 0.9 * np.eye(2) + 0.1 * (np.array([[1, 0], [0, 2]]).T @ np.array([[0, 4], [1, 0]])) / 2
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = df.select(memory.update_state(F.col("m"), F.col("p"), F.col("x")).alias("s")).first().s
    assert np.allclose(got, want)
    read = df.select(memory.read_state(F.col("p"), F.col("m"), F.col("m"), F.array(*[F.array(F.lit(0.0), F.lit(0.0)) for _ in range(4)]), F.col("m")).alias("r")).first().r
    assert np.allclose(read, np.array([[1, 0], [0, 2]]) / 2)


def test_strip_is_that_of_python(spark):
    texts = [f"{chr(c)}x y{chr(c)}" for c in range(0x3100) if chr(c).isspace()] + ["", " \n\t ", "​x​", "a", None, "é 　"]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.strip(F.col("t")).alias("s")).collect()]
    assert got == [t.strip() if t is not None else None for t in texts]
