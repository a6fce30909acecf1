"""Pruned and approximate search against all inner products."""

import numpy as np
import pytest

from spindrift.operators import topk


def frames(spark, x, q, heads=1):
    rows = spark.createDataFrame([(h, i, v.tolist()) for h in range(heads) for i, v in enumerate(x * (h + 1))], "head int, slot long, rep array<double>")
    queries = spark.createDataFrame([(i, h, v.tolist()) for h in range(heads) for i, v in enumerate(q)], "query_id long, head int, q array<double>")
    return rows, queries


def grouped(n=6000, dim=16, groups=60, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 3
    return centres[rng.integers(0, groups, n)] + 0.1 * rng.standard_normal((n, dim)), centres[:40] + 0.1 * rng.standard_normal((min(groups, 40), dim))


def brute(x, q, most):
    s = q @ x.T
    return [(i, j, s[i, j]) for i in range(len(q)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:most]]


def found(df, head=0):
    return [(r["query_id"], r["slot"], r["score"]) for r in df.where(f"head = {head}").orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("block", [10_000, 100])
def test_search_is_exact(spark, block):
    x, q = grouped()
    x[50:80] = x[50]  # ties
    rows, queries = frames(spark, x, q, 2)
    got = topk.search(topk.build(rows, block), queries, 8)
    for head in (0, 1):
        want = brute(x * (head + 1), q, 8)
        mine = found(got, head)
        assert [a[:2] for a in mine] == [a[:2] for a in want] and np.allclose([a[2] for a in mine], [a[2] for a in want])


def test_search_skips_blocks(spark):
    x, q = grouped()
    rows, queries = frames(spark, x, q)
    index = topk.build(rows, 100)
    seen = topk.visited(index, queries, 8).collect()
    assert len(seen) == len(q) and all(r["blocks"] > 30 for r in seen)
    assert sum(r["visited"] for r in seen) < 0.3 * sum(r["blocks"] for r in seen)


def test_pieces_and_parts(spark):
    x, q = grouped(900)
    rows, queries = frames(spark, x, q)
    index = topk.build(rows, 10_000)
    asked = queries.withColumn("block", topk.F.lit(0).cast("long"))
    got = topk._first(topk._meet(index.rows, asked, 5, piece=100, part=7), 5)
    assert [a[:2] for a in found(got)] == [a[:2] for a in brute(x, q, 5)]


def test_approximate_search_keeps_its_recall(spark):
    for x, q in (grouped(), (np.random.default_rng(2).standard_normal((3000, 24)), np.random.default_rng(3).standard_normal((60, 24)))):
        rows, queries = frames(spark, x, q)
        index = topk.build(rows, 500)
        tuned = topk.tune(index, queries, 8, 0.92)
        got, want = found(topk.approximate(index, queries, 8, tuned)), brute(x, q, 8)
        assert tuned.recall >= 0.92 and len({a[:2] for a in got} & {a[:2] for a in want}) >= 0.9 * len(want)
        assert all(abs(q[i] @ x[j] - s) < 1e-9 for i, j, s in got)


def test_odd_input(spark):
    rows, queries = frames(spark, np.eye(3), np.eye(3)[:1])
    few = topk.search(topk.build(rows), queries, 8)
    assert [a[:2] for a in found(few)] == [(0, 0), (0, 1), (0, 2)]
    none = topk.build(rows.where("false"))
    assert topk.search(none, queries, 8).count() == 0 and topk.approximate(none, queries, 8, topk.Tables(2, 1.0, 1.0)).count() == 0
    assert topk.search(topk.build(rows), queries.where("false"), 8).count() == 0
    odd = queries.selectExpr("query_id", "9 as head", "q").unionByName(queries.selectExpr("query_id", "head", "null as q"))
    assert topk.search(topk.build(rows), odd, 8).count() == 0
    null = rows.unionByName(rows.selectExpr("head", "slot + 10 as slot", "cast(null as array<double>) as rep"))
    assert topk.search(topk.build(null, 2), queries, 8).count() == 3


def test_visits_come_in_bounded_batches():
    """A query that visits all of many blocks repeats its vector for each: a task holds VISITS of them, not a whole batch's."""
    import pyarrow as pa

    rng, n, blocks = np.random.default_rng(4), 3000, 100
    batch = pa.record_batch([pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array(rng.standard_normal((n, 4)).tolist())], names=["query_id", "head", "q"])
    index = {0: (rng.standard_normal((blocks, 4)), np.ones(blocks), np.ones(blocks, int))}
    everything = lambda part, centres, radii, count: np.divmod(np.arange(part.num_rows * len(centres)), len(centres))
    got = list(topk._chosen(index, everything)(iter([batch])))
    assert max(b.num_rows for b in got) <= topk.VISITS < n * blocks
    pairs = [(i, j) for b in got for i, j in zip(b.column("query_id").to_pylist(), b.column("block").to_pylist(), strict=True)]
    assert pairs == [(i, j) for i in range(n) for j in range(blocks)]
