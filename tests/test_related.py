"""Relatedness and grouping against the pairwise definitions."""

import random
import time

import pytest

from spindrift.operators import related

SCHEMA = "repo string, commit_no int, ast_id string, operation_type string, retrieved_labels array<string>"


def plain_pairs(rows):
    out = set()
    for r1, c1, a, op1, l1 in rows:
        for r2, c2, b, op2, l2 in rows:
            if (r1, c1) == (r2, c2) and a < b:
                x, y = a.split("::")[-1], b.split("::")[-1]
                if b in (l1 or []) or a in (l2 or []) or ("::" in a and "::" in b and a.split("::")[0] == b.split("::")[0] and op1 == op2 and (x in y or y in x)):
                    out.add((r1, c1, a, b))
    return out


def plain_groups(rows, most=4):
    """One commit's elements, one after the other."""
    rows = sorted(rows, key=lambda r: r[2])
    used, out, n = set(), {}, 0
    for i, (_, _, a, _, la) in enumerate(rows):
        if i in used:
            continue
        used.add(i)
        out[a], size = (n, 0), 1
        for j in range(i + 1, len(rows)):
            b, lb = rows[j][2], rows[j][4] or []
            if j not in used and size < most and "::" in a and "::" in b and a.split("::")[0] == b.split("::")[0] and (a in lb or b in (la or []) or set(la or []) & set(lb)):
                used.add(j)
                out[b], size = (n, size), size + 1
        n += 1
    return out


def random_rows(seed, n, names, labels, files=2):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        name = "".join(rng.choice("ab") for _ in range(rng.randrange(0, names)))
        i = rng.choice([f"f{rng.randrange(files)}::m::{name}{rng.randrange(50)}", f"f{rng.randrange(files)}::{name}", f"nofile{rng.randrange(9)}"])
        out[i] = ("r", 1, i, rng.choice("AM"), None if rng.random() < 0.1 else [rng.choice([f"t{rng.randrange(labels)}", rng.choice([*out, i])]) for _ in range(rng.randrange(4))])
    return list(out.values())


@pytest.mark.parametrize("seed", range(3))
def test_pairs_are_those_of_the_definition(spark, seed):
    rows = random_rows(seed, 150, 7, 30)
    got = related.related_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_pairs(rows)


def test_pairs_of_a_large_file(spark):
    rng = random.Random(5)
    names = [f"n{rng.getrandbits(60):x}" for _ in range(100_000)]
    rows = [("r", 1, f"f::{x}", "M", []) for x in [*names, "get_" + names[0], names[1] + "_all", names[2][2:]]]
    began = time.time()
    got = {(r.a, r.b) for r in related.related_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    ids = lambda a, b: tuple(sorted((f"f::{a}", f"f::{b}")))
    assert {ids(names[0], "get_" + names[0]), ids(names[1], names[1] + "_all"), ids(names[2], names[2][2:])} <= got
    assert all(a.split("::")[1] in b or b.split("::")[1] in a for a, b in got)
    assert time.time() - began < 120


@pytest.mark.parametrize(("seed", "labels", "few"), [(0, 400, 0), (1, 60, 0), (2, 8, 0), (3, 60, 10**6), (4, 2, 0)])
def test_groups_are_those_of_the_loop(spark, seed, labels, few):
    """few = 0 leaves everything to the rounds, a large one to the pass in order."""
    rows = random_rows(seed, 120, 6, labels, 3)
    got = {r.ast_id: (r.group_no, r.place) for r in related.related_groups(spark.createDataFrame(rows, SCHEMA), few=few, slow=0.0).collect()}
    assert got == plain_groups(rows)


def test_groups_of_a_large_commit(spark):
    """Fifty thousand elements of one file, a third of which share a label."""
    rng = random.Random(6)
    rows = [("r", 1, f"f::{i:06}", "M", ["hot"] * (i % 3 == 0) + [f"t{rng.randrange(20_000)}"]) for i in range(50_000)]
    began = time.time()
    got = {r.ast_id: (r.group_no, r.place) for r in related.related_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert time.time() - began < 120 and len(got) == 50_000
    by_token, seeds, seed_of = {}, {}, {}
    for _, _, i, _, labels in rows:  # the definition, by tokens: an element joins the first open one that shares a token
        s = min((by_token[t] for t in [i, *labels] if t in by_token), default=i)
        seed_of[i] = s
        seeds[s] = seeds.get(s, 0) + 1
        for t in [s, *rows[int(s[3:])][4]]:
            by_token[t] = s
            if seeds[s] == 4:
                del by_token[t]
    numbers = {s: n for n, s in enumerate(sorted(seeds))}
    assert {i: g for i, (g, _) in got.items()} == {i: numbers[s] for i, s in seed_of.items()}


def test_odd_elements(spark):
    rows = [("r", 1, None, "M", ["a"]), ("r", 1, "f::a", None, None), ("r", 1, "f::ab", None, [None, "f::a"]), ("r", 1, "f::ab", None, []), ("r", 1, "f::", "M", []), ("r", 1, "f::x", "M", [])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.a, r.b) for r in related.related_pairs(df).collect()} == {("f::", "f::x"), ("f::a", "f::ab")}
    assert sorted((r.ast_id, r.group_no, r.place) for r in related.related_groups(df).collect()) == [("f::", 0, 0), ("f::a", 1, 0), ("f::ab", 1, 1), ("f::x", 2, 0)]
    none = spark.createDataFrame([], SCHEMA)
    assert related.related_pairs(none).count() == 0 and related.related_groups(none).count() == 0


def test_rarest_parts_are_found_without_sorting_all_parts(spark):
    rows = [("r", n) for n in ("abcabc", "cab", "xabcabcx", "b", "bc", "abx", "zz", "xyzxyz")]
    df = related.containing(spark.createDataFrame(rows, "s string, name string"), ["s"])
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    want = {(a, b) for _, a in rows for _, b in rows if a in b}
    assert sorted((r.part, r.whole) for r in df.collect()) == sorted(want)


@pytest.mark.parametrize(("most", "sent"), [(200_000, 2), (-1, 0)])
def test_only_counted_short_names_are_sent_to_every_task(spark, monkeypatch, most, sent):
    """Spark takes these tables for small ones, as it does with any compressed file under its threshold."""
    monkeypatch.setattr(related, "MOST_SHORT", most)
    rows = random_rows(7, 150, 7, 30)
    df = related.related_pairs(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in df.collect()} == plain_pairs(rows)
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastHashJoin") == sent
