"""Hard negatives by dual-tree search over integer vectors.

In a task, ball trees stand over a block of anchors and over a shard of rows. For a pair of nodes the inner products of all their
vectors lie in an interval that centres and radii give; a pair whose interval holds nothing that any anchor of the node still wants is
left with all its anchors and rows at once. Pairs of leaves are scored exactly. Positives are the k-best search inside a label;
negatives are the best in the score windows that the positives open.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

#: Rows to a leaf, and anchors to one.
LEAF, ANCHORS = 512, 128
#: Rows to a shard and anchors to a block; rows that a shard keeps where few rows leave cores idle.
SHARD, BLOCK, LEAST_SHARD = 65_536, 32_768, 8_192
#: One row in so many is searched first if there are twice as many shards; what it gives bounds what a shard of all rows sends.
FIRST = 16
#: Integers up to which products are summed exactly as doubles, and as singles.
EXACT, SINGLE = 2.0**53, 2.0**24


class Ball:
    """A node: the rows (indices), their centre and radius, and two halves unless it is a leaf. Halved along the widest coordinate."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        own = x[rows]
        self.rows, self.centre = rows, own.mean(axis=0)
        self.radius = np.sqrt(((own - self.centre) ** 2).sum(axis=1).max())
        self.length = np.linalg.norm(self.centre)
        self.halves: list[Ball] = []
        if len(rows) > leaf and self.radius > 0:
            by = np.argsort(own[:, np.ptp(own, axis=0).argmax()], kind="stable")
            self.halves = [Ball(x, rows[part], leaf) for part in (by[: len(by) // 2], by[len(by) // 2 :])]
        elif len(rows) > leaf:  # equal vectors: nothing to tell them apart by
            self.halves = [Ball(x, part, leaf) for part in np.array_split(rows, 2)]

    def interval(self, other: Ball) -> tuple[float, float]:
        """Between these all inner products of the two nodes lie; widened by what rounding may cost."""
        middle = float(self.centre @ other.centre)
        reach = self.radius * other.length + other.radius * self.length + self.radius * other.radius
        reach += 1e-9 * (reach + abs(middle)) + 1e-6
        return middle - reach, middle + reach


def dual(anchors: Ball, rows: Ball, wanted: Callable[[np.ndarray], tuple[float, float]], score: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Scores the leaf pairs whose interval meets what the anchors of the pair want; nearer halves come first, so that wants shrink early."""
    stack = [(anchors, rows)]
    while stack:
        a, b = stack.pop()
        (low, high), (least, most) = a.interval(b), wanted(a.rows)
        if high < least or low > most:
            continue
        if not a.halves and not b.halves:
            score(a.rows, b.rows)
            continue
        split_a = bool(a.halves) and (len(a.rows) >= len(b.rows) or not b.halves)
        pairs = [(h, b) for h in a.halves] if split_a else [(a, h) for h in b.halves]
        stack += sorted(pairs, key=lambda p: p[0].interval(p[1])[1])


def integers(column: pa.ChunkedArray) -> np.ndarray:
    """floor(256 * x) as doubles, which 64-bit integers must be able to hold together with their products' sums."""
    x = np.floor(256 * vectors.matrix(column))
    if len(x) and (x**2).sum(axis=1).max() >= EXACT:
        raise OverflowError("components are too large for exact integer products: sums of squares of floor(256 x) reach 2^53")
    return x


def both_integers(rows: pa.ChunkedArray, anchors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of both sides, as singles if no sum of a product's terms can reach 2^24: all of its partial sums are within the lengths' product."""
    x, a = integers(rows), integers(anchors)
    longest = lambda y: np.sqrt((y**2).sum(axis=1).max())
    small = longest(x) * longest(a) < SINGLE and max(np.abs(x).max(), np.abs(a).max()) < SINGLE
    return (x.astype(np.float32), a.astype(np.float32)) if small else (x, a)


class _Best:
    """The k best rows of each of n lists: only the lists that get candidates are looked at. least: the score from which a row is taken."""

    def __init__(self, least: np.ndarray, ids: np.ndarray, k: int):
        self.least, self.ids, self.k = least, ids, k
        self.row, self.score = np.full((len(least), k), -1), np.zeros((len(least), k), np.int64)

    def add(self, of: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        if not len(of):
            return
        lists = np.unique(of)
        held = self.row[lists] >= 0
        of = np.concatenate([np.repeat(lists, held.sum(axis=1)), of])
        row, score = np.concatenate([self.row[lists][held], row]), np.concatenate([self.score[lists][held], score])
        at = vectors.firsts(of, score, self.ids[row], self.k)
        of, row, score = of[at], row[at], score[at]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        self.row[lists] = -1
        self.row[of, place], self.score[of, place] = row, score
        full = lists[self.row[lists, -1] >= 0]
        self.least[full] = np.maximum(self.least[full], self.score[full, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """list, row, score."""
        of, place = np.nonzero(self.row >= 0)
        return of, self.row[of, place], self.score[of, place]


def _least(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Bounds of lists as doubles; none: no bound."""
    return column.cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False).copy()


def _positives(k: int):
    """The k best rows of an anchor's label in the shard, of the score ``least`` at least: anchor_id, vec_id, score."""

    def work(rows: pa.Table, anchors: pa.Table) -> list[np.ndarray]:
        x, a = both_integers(rows["v"], anchors["v"])
        ids, labels, own, of = (t[c].to_numpy() for t, c in ((rows, "vec_id"), (rows, "label"), (anchors, "anchor_id"), (anchors, "label")))
        best = _Best(_least(anchors["least"]), ids, k)

        def score(p: np.ndarray, q: np.ndarray) -> None:
            s = a[p] @ x[q].T
            i, j = np.divmod(np.flatnonzero(s >= best.least[p].astype(s.dtype)[:, None]), len(q))
            other = own[p[i]] != ids[q[j]]
            i, j = i[other], j[other]
            best.add(p[i], q[j], s[i, j].astype(np.int64))

        for label in np.unique(of):
            mine = np.flatnonzero(labels == label)
            if len(mine):
                dual(Ball(a, np.flatnonzero(of == label), ANCHORS), Ball(x, mine), lambda p: (best.least[p].min(), np.inf), score)
        p, q, s = best.found()
        return [own[p], ids[q], s]

    return work


def _negatives(k: int, least: int):
    """The k best rows of other labels in each positive's score window, of its ``least`` at least: anchor_id, positive_id, positive_score,
    vec_id, score."""

    def work(rows: pa.Table, anchors: pa.Table) -> list[np.ndarray]:
        x, a = both_integers(rows["v"], anchors["v"])
        ids, labels, own, of = (t[c].to_numpy() for t, c in ((rows, "vec_id"), (rows, "label"), (anchors, "anchor_id"), (anchors, "label")))
        lists = anchors["positives"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        pair_of = np.repeat(np.arange(len(a)), lists.value_lengths().to_numpy())
        positive, top = (lists.flatten().field(c).to_numpy().astype(np.int64) for c in ("positive_id", "positive_score"))
        starts = np.searchsorted(pair_of, np.arange(len(a) + 1))
        asked = np.flatnonzero(np.diff(starts))
        if not len(asked):
            return [[]] * 5
        # The least whole score of a window, unless more is asked for.
        best = _Best(np.maximum(-(-least * top // 100), _least(lists.flatten().field("least"))), ids, k)
        highest = np.full(len(a), -np.inf)
        highest[asked] = np.maximum.reduceat(top, starts[asked])

        def pairs(p: np.ndarray) -> np.ndarray:
            n = starts[p + 1] - starts[p]
            return np.repeat(starts[p] - np.cumsum(n) + n, n) + np.arange(n.sum())

        def lowest(p: np.ndarray) -> np.ndarray:
            return np.minimum.reduceat(best.least[pairs(p)], np.cumsum(starts[p + 1] - starts[p]) - (starts[p + 1] - starts[p]))

        def wanted(p: np.ndarray) -> tuple[float, float]:
            return best.least[pairs(p)].min(), highest[p].max()

        def score(p: np.ndarray, q: np.ndarray) -> None:
            s = a[p] @ x[q].T
            low, high = (b.astype(s.dtype)[:, None] for b in (lowest(p), highest[p]))
            i, j = np.divmod(np.flatnonzero((s >= low) & (s <= high)), len(q))
            other = of[p[i]] != labels[q[j]]
            i, j = i[other], j[other]
            n = starts[p[i] + 1] - starts[p[i]]
            at, row, s = pairs(p[i]), np.repeat(q[j], n), np.repeat(s[i, j].astype(np.int64), n)
            fit = (s >= best.least[at]) & (s <= top[at])
            best.add(at[fit], row[fit], s[fit])

        dual(Ball(a, asked, ANCHORS), Ball(x, np.arange(len(x))), wanted, score)
        p, q, s = best.found()
        return [own[pair_of[p]], positive[p], top[p], ids[q], s]

    return work


def _bounds(found: DataFrame, by: list[str], score: str, k: int) -> DataFrame:
    """Of each group of which k rows are found the k-th score: none of all rows below it can be among the k best."""
    return found.groupBy(*by).agg(F.min(score).alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")


def mine(rows: DataFrame, anchors: DataFrame, k: int = 5, least: int = 80, shard: int | None = None, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows and anchors (vec_id, label, embedding).

    An anchor's positives are its k best rows of the same label, itself left out; for each the first k rows of other labels score
    between least hundredths of the positive's score and that score. Scores are integer inner products of floor(256 x); ties go to the
    smaller id. Exact. Rows without id or label, and vectors that are null, empty or hold a null or non-finite component, take no part;
    vectors of other lengths never meet; a row that bears the anchor's id is none of its positives; repeated rows count once. Vectors
    too long for exact products (see ``integers``) raise an error. Empty tables give an empty result; further columns are ignored.

    Of many shards, one row in ``first`` is searched before all are: its k-th score of a list is a bound below which no shard sends
    anything, so that what the shards send doesn't grow with their number.
    """
    clean = lambda df, to: common.only(df, "vec_id", "label", "embedding").toDF(to, "label", "v").where(F.col(to).isNotNull() & F.col("label").isNotNull() & vectors.finite(F.col("v"))).withColumns({to: F.col(to).cast("bigint"), "label": F.col("label").cast("bigint")}).distinct()
    own, asked = common.checkpoint(clean(rows, "vec_id")), common.checkpoint(clean(anchors, "anchor_id"))
    n = own.count()
    shard = shard or min(SHARD, max(LEAST_SHARD, -(-n // own.sparkSession.sparkContext.defaultParallelism)))
    few = own.where(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(first)) == 0) if n > 2 * first * shard else None

    def positives(of: DataFrame, bounds: DataFrame | None) -> DataFrame:
        ask = asked.withColumn("least", F.lit(None).cast("bigint")) if bounds is None else asked.join(bounds, "anchor_id", "left")
        found = vectors.against(of, ask, "vec_id", "anchor_id", _positives(k), "anchor_id long, positive_id long, positive_score long", shard, block)
        return vectors.first(found, ["anchor_id"], [F.desc("positive_score"), F.col("positive_id")], k)

    best = common.checkpoint(positives(own, None if few is None else _bounds(positives(few, None), ["anchor_id"], "positive_score", k)))

    def negatives(of: DataFrame, bounds: DataFrame | None) -> DataFrame:
        # A positive's id may be that of several rows, so its score belongs to the list.
        kept = best.withColumn("least", F.lit(None).cast("bigint")) if bounds is None else best.join(bounds, ["anchor_id", "positive_id", "positive_score"], "left")
        lists = kept.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score", "least")).alias("positives"))
        ask = common.checkpoint(asked.join(lists, "anchor_id"))
        found = vectors.against(of, ask, "vec_id", "anchor_id", _negatives(k, least), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", shard, block)
        return vectors.first(found, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.col("negative_id")], k)

    pair = ["anchor_id", "positive_id", "positive_score"]
    found = negatives(own, None if few is None else common.checkpoint(_bounds(negatives(few, None), pair, "negative_score", k)))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
