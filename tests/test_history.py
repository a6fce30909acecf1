"""Items as changes and intervals against whole snapshots."""

import random

import pytest

from spindrift.operators import snapshot

SCHEMA = "repo string, commit_no int, id string, code string, imports array<string>, file string"


def history(seed, commits=12, ids=15, repos=2):
    rng = random.Random(seed)
    rows, numbers = [], []
    for r in range(repos):
        state, no = {}, 0
        for _ in range(commits):
            no += rng.randrange(1, 4)
            for _ in range(rng.randrange(3)):
                i = f"i{rng.randrange(ids)}"
                state[i] = (rng.choice(["x", "y", None]), rng.choice([None, [], ["a"], ["a", "b"]]), "f") if rng.random() < 0.7 else None
            numbers.append((f"r{r}", no))
            rows += [(f"r{r}", no, i, *v) for i, v in state.items() if v]
    return rows, numbers


def as_set(df):
    return {(r.repo, r.commit_no, r.id, r.code, tuple(r.imports) if r.imports is not None else None, r.file) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_snapshots_come_back(spark, seed):
    rows, numbers = history(seed)
    items, commits = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(numbers, "repo string, commit_no int")
    past = snapshot.changes(items, commits)
    spans = snapshot.intervals(past)
    assert as_set(snapshot.snapshots(spans, commits)) == as_set(items) and snapshot.snapshots(spans, commits).count() == len(rows)
    assert as_set(snapshot.snapshots(spans, commits, back=1)) == as_set(snapshot.previous_snapshot(items, commits))
    diffs = snapshot.snapshot_diff(items.selectExpr("*", "'k' as kind"), commits).count()
    first = len({(r[0], r[2]) for r in rows if (r[0], r[1]) in {min(n for n in numbers if n[0] == q) for q in ("r0", "r1")}})
    assert past.count() <= diffs + first + sum(1 for r in rows if r[4] is not None)  # imports in another order are a change of the record


def test_size_follows_changes(spark):
    rows = [("r", c, f"i{i}", "same", None, "f") for c in range(1, 41) for i in range(50)]
    rows = [r if (r[1], r[2]) != (20, "i7") else (*r[:3], "other", None, "f") for r in rows if (r[1], r[2]) != (30, "i3")]
    past = snapshot.changes(spark.createDataFrame(rows, SCHEMA))
    assert past.count() == 50 + 2 + 2 and past.where("gone").count() == 1
    assert {(r.valid_from, r.valid_to) for r in snapshot.intervals(past).where("id = 'i3'").collect()} == {(1, 30), (31, None)}
    assert as_set(snapshot.snapshots(snapshot.intervals(past), spark.createDataFrame(rows, SCHEMA))) == {(r[0], r[1], r[2], r[3], None, "f") for r in rows}


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert snapshot.changes(none).count() == 0 and snapshot.snapshots(snapshot.intervals(snapshot.changes(none)), none).count() == 0
