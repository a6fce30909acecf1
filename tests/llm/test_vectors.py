"""The vector operators against plain versions: neighbours, hard negatives, whitening."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from spindrift.llm import forest, hardneg, vectors, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rank string, ids string, n string"


def frame(spark, rows):
    """Rows (vec_id, embedding[, label]) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else 0, "v", "r", "i", "n") for r in rows], SCHEMA)


def queries(spark, rows):
    return frame(spark, rows).select("vec_id", "embedding").toDF("query_id", "embedding")


ODD = [(1001, None, 1), (1002, [0.0] * 4, 1), (1003, [1.0, None, 0.0, 0.0], 1), (1004, [float("nan")] * 4, 1), (1005, [float("inf"), 0.0, 0.0, 0.0], 1), (1006, [], 1), (None, [1.0] * 4, 1)]


def points(n, dim, seed=1, spread=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    return x if spread is None else (x * rng.lognormal(0, spread, (n, 1))).astype(np.float32)


def brute(rows, asked, k):
    out = {}
    for q, v in asked:
        scored = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize(("dim", "spread"), [(8, None), (48, None), (16, 0.7)])
def test_forest_finds_nine_in_ten_in_any_cut(spark, dim, spread):
    x = points(1500, dim, spread=spread)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = rows[::20]
    want = brute(rows, asked, 10)
    for shard, block in ((10_000, 10_000), (400, 30)):
        got: dict = {}
        for r in forest.nearest(frame(spark, rows), queries(spark, asked), 10, shard, block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
            assert r["rank"] == len(got[r["query_id"]])
        assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
        found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert found >= 0.9 * 10 * len(want)
        for q, near in got.items():
            assert near == sorted(near, key=lambda p: (-p[1], p[0])) and q not in {i for i, _ in near}
            for i, s in near:
                assert s == pytest.approx(float(np.float64(x[q]) @ np.float64(x[i])), abs=1e-12)


def test_forest_leaves_most_of_a_grouped_table_alone():
    rng = np.random.default_rng(2)
    x = (np.repeat(rng.standard_normal((200, 32)), 40, 0) + 0.05 * rng.standard_normal((8000, 32))) / 6
    f = forest.Forest(x)
    scored = []
    f.rough = f.rough.view(type("Counted", (np.ndarray,), {"__getitem__": lambda self, at: (scored.append(np.size(at)), np.ndarray.__getitem__(self, at))[1]}))
    for _, who, row, _ in f.search(x[::400], 20):
        assert all((np.sort(row[who == i]) // 40 == 400 * i // 40).all() for i in range(20))
    assert sum(scored) < 0.1 * 20 * 8000


def test_forest_ties_copies_and_odd_rows(spark):
    same = [(i, [1.0, 2.0, 0.0, 0.0]) for i in range(300)]
    rows = [*same, *ODD, (500, [0.0, 1.0, 0.0, 0.0]), (500, [0.0, 1.0, 0.0, 0.0]), (600, [1.0, 2.0])]
    got = forest.nearest(frame(spark, rows), queries(spark, [*same[:3], *ODD, rows[-1], rows[-1]]), 5).orderBy("query_id", "rank").collect()
    by = {q: [r["vec_id"] for r in got if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert by == {0: [1, 2, 3, 4, 5], 1: [0, 2, 3, 4, 5], 2: [0, 1, 3, 4, 5]}
    few = forest.nearest(frame(spark, rows[-4:]), queries(spark, same[:1]), 5).collect()
    assert [(r["vec_id"], r["score"], r["rank"]) for r in few] == [(500, 2.0, 1)]


def test_forest_of_empty_tables(spark):
    for rows, asked in (([], [(1, [1.0])]), ([(1, [1.0])], []), ([], []), (ODD, ODD)):
        assert forest.nearest(frame(spark, rows), queries(spark, asked)).collect() == []


def plain_negatives(rows, anchors, k=5, least=80):
    ints = {i: ([int(np.floor(256 * float(np.float32(c)))) for c in v], label) for i, v, label in rows}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = set()
    for a in anchors:
        va, la = ints[a]
        scored = sorted((-dot(va, v), i, label) for i, (v, label) in ints.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2] == la][:k]:
            fit = [(i, -s) for s, i, label in scored if label != la and least * -ps <= 100 * -s <= 100 * -ps][:k]
            out |= {(a, p, r, i, -ps, s) for r, (i, s) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("dim", [2, 6, 24])
def test_negatives_equal_the_plain_search(spark, dim):
    x = points(900, dim, 3)
    x[100:160] = x[100]  # copies with ties
    rows = [(i, v.tolist(), int(i * 7 % 11) % 3) for i, v in enumerate(x)]
    anchors = [r for r in rows if r[0] % 25 == 0]
    want = plain_negatives(rows, [a[0] for a in anchors])
    for shard, block in ((10_000, 10_000), (150, 10)):
        got = hardneg.mine(frame(spark, rows + rows[:50]), frame(spark, anchors), shard=shard, block=block).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_negatives_with_bounds_from_the_first_rows(spark, monkeypatch):
    x = points(900, 6, 5)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), int(i * 7 % 11) % 3) for i, v in enumerate(x)]
    anchors = [r for r in rows if r[0] % 25 == 0]
    got = hardneg.mine(frame(spark, rows), frame(spark, anchors), shard=50, block=10, first=3).collect()
    assert {tuple(r) for r in got} == plain_negatives(rows, [a[0] for a in anchors]) and len(got) == len({tuple(r) for r in got})
    # A shard sends nothing below the bound, and candidates of one list leave the others alone.
    best = hardneg._Best(np.array([7.0, -np.inf]), np.arange(10), 2)
    best.add(np.array([1, 1, 1]), np.array([4, 3, 5]), np.array([1, 1, 0]))
    assert [z.tolist() for z in best.found()] == [[1, 1], [3, 4], [1, 1]] and best.least.tolist() == [7.0, 1.0]


def test_products_are_singles_only_if_exact():
    column = lambda v: pa.chunked_array([pa.array([v], pa.list_(pa.float64()))])
    assert hardneg.both_integers(column([15.0, 0.0]), column([16.0, 0.0]))[0].dtype == np.float32
    assert hardneg.both_integers(column([16.0, 0.0]), column([16.0, 0.0]))[0].dtype == np.float64


def test_negatives_odd_rows_and_empty_tables(spark):
    odd = [*ODD, (7, [1.0] * 4, None), (8, [1.0, 1.0], 0)]
    rows = [(1, [1.0] * 4, 0), (2, [1.0] * 4, 0), (3, [0.9] * 4, 5), (4, [2.0] * 4, 5), *odd]
    got = [tuple(r) for r in hardneg.mine(frame(spark, rows), frame(spark, [rows[0], *odd])).collect()]
    assert got == [(1, 2, 1, 3, 4 * 256 * 256, 4 * 256 * 230)]
    for a, b in (([], rows[:1]), (rows, []), (odd, odd)):
        assert hardneg.mine(frame(spark, a), frame(spark, b)).collect() == []
    with pytest.raises(Exception, match="too large"):
        hardneg.mine(frame(spark, [(1, [1e30], 0), (2, [1e30], 0)]), frame(spark, [(1, [1e30], 0)])).collect()


def test_dual_search_skips_node_pairs():
    rng = np.random.default_rng(4)
    x = np.floor(256 * (np.repeat(rng.standard_normal((64, 3)) * 3, 64, 0) + 0.02 * rng.standard_normal((4096, 3))))
    scored, best = [], np.full((4096, 5), -np.inf)

    def score(p, q):
        scored.append(len(p) * len(q))
        best[p] = np.sort(np.hstack([best[p], x[p] @ x[q].T]), axis=1)[:, -5:]

    hardneg.dual(hardneg.Ball(x, np.arange(4096), 32), hardneg.Ball(x, np.arange(4096), 64), lambda p: (best[p, 0].min(), np.inf), score)
    assert sum(scored) < 0.2 * 4096**2
    assert (best == np.sort(x @ x.T, axis=1)[:, -5:]).all()


def test_limbs_and_digits_are_exact():
    rng = np.random.default_rng(5)
    for top in (1, 1000, 1 << 20, 1 << 40, 1 << 61):
        x = rng.integers(-top, top, (300, 5))
        x[0] = [-top, top - 1, 0, -1, 1]
        want = np.array([[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(5)] for i in range(5)], object)
        got = whiten.gram(x)
        assert (got == want).all()
        parts = whiten.digits(got.ravel())
        assert [sum(d[c] << (whiten.DIGIT * k) for k, d in enumerate(parts)) for c in range(25)] == want.ravel().tolist()
        assert all(abs(v) < 1 << 31 for d in parts for v in d)


@pytest.mark.parametrize("dim", [3, 20])
def test_whitening_against_fractions(spark, dim):
    x = points(400, dim, 6) * np.linspace(1, 3, dim).astype(np.float32) + np.float32(2)
    x[50:150] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = whiten.whiten(frame(spark, [*rows, rows[3], *[r for r in ODD if r[0] and r[0] != 1002 and r[0] != 1006]])).collect()
    ints = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in x]
    fit = list({tuple(v) for v in ints})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = np.array([[float(sum((Fraction(v[i]) - Fraction(sums[i], n)) * (v[j] - Fraction(sums[j], n)) for v in fit) / n) for j in range(dim)] for i in range(dim)])
    values, axes = np.linalg.eigh(cov)
    values, axes, m = values[::-1], axes[:, ::-1], min(dim, 16)
    assert len(got) == 401 * m
    by = {(r["vec_id"], r["component"]): r for r in got}
    for i, v in enumerate(ints):
        centred = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums, strict=True)])
        for c in range(m):
            r = by[i, c + 1]
            assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) and r["n"] == n
            sign = np.sign(axes[:, c] @ centred) * np.sign(r["whitened"])
            assert abs(r["whitened"] - sign * (axes[:, c] @ centred) / values[c] ** 0.5) < 1e-9
            assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9
    signs = {c: {np.sign(by[i, c]["whitened"] * (axes[:, c - 1] @ (np.array(ints[i]) - np.array(sums) / n))) for i in range(400) if abs(by[i, c]["whitened"]) > 1e-6} for c in range(1, m + 1)}
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_edges(spark):
    assert whiten.whiten(frame(spark, [])).collect() == [] and whiten.whiten(frame(spark, ODD[:1])).collect() == []
    assert whiten.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # one distinct vector has no spread
    line = whiten.whiten(frame(spark, [(1, [1.0, 2.0]), (None, [2.0, 2.0]), (3, [9.0])])).collect()  # one direction, one odd length
    assert sorted((r["vec_id"] or 0, r["component"], r["n"], abs(round(r["whitened"], 9)), r["deviation"]) for r in line) == [(0, 1, 2, 1.0, 64**2), (1, 1, 2, 1.0, 64**2)]
    with pytest.raises(Exception, match="too large"):
        whiten.whiten(frame(spark, [(1, [1e30]), (2, [2e30])])).collect()


def test_finite_and_firsts(spark):
    rows = frame(spark, [(1, [1.0]), *ODD]).select("vec_id", vectors.finite("embedding").alias("ok")).collect()
    assert {r["vec_id"] for r in rows if r["ok"]} == {1, 1002, None}
    at = vectors.firsts(np.array([1, 0, 1, 1, 0]), np.array([5, 1, 7, 7, 2]), np.array([0, 0, 9, 3, 0]), 2)
    assert at.tolist() == [4, 1, 3, 2]
