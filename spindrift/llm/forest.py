"""Approximate nearest neighbours by a hash-prefix forest.

A shard of distinct vectors has TREES sorted arrays of hash strings, each BITS signs of random projections. A query descends every array
to its longest-prefix match and then ascends all of them together, a bit at a time: at prefix length x its candidates are all rows
that share x first bits with it in some tree. It stops, also between the trees of one length, where a row as near as the worst of those
it would return is missed with a probability of MISS at most, by the law of the signs; at length 0 every row is a candidate. So the number of candidates follows the
data: few where vectors lie in groups, a large part where they point anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

TREES, BITS, SEED = 64, 32, 20
#: Accepted probability of missing a row as near as the last one returned.
MISS = 0.05
#: Trees that ascend by a bit before the stop is looked at, queries that ascend together, and pairs that are scored at once.
STEP, TOGETHER, PAIRS = 16, 1024, 1 << 15


class Forest:
    """Sorted hash strings of the rows of x; rows get one more component that makes all their norms equal, so that signs rank inner products."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.x, self.trees, self.bits = x, trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, trees * bits))
        norms = np.linalg.norm(x, axis=1)
        self.norm = norms.max() * (1 + 1e-12)
        self.rough = (x / self.norm).astype(np.float32)
        keys = self.strings(x / self.norm, np.sqrt(np.maximum(1 - (norms / self.norm) ** 2, 0)))
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, 1)

    def strings(self, rows: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The hash strings (tree, row): signs of the projections, the first one highest."""
        out = np.zeros((self.trees, len(rows)), np.uint64)
        for at in range(0, len(rows), 2048):
            signs = (rows[at : at + 2048] @ self.planes[:-1] + last[at : at + 2048, None] * self.planes[-1] > 0).reshape(-1, self.trees, self.bits)
            for b in range(self.bits):
                out[:, at : at + 2048] |= signs[:, :, b].T.astype(np.uint64) << np.uint64(self.bits - 1 - b)
        return out

    def longest(self, strings: np.ndarray) -> np.ndarray:
        """Length of the longest prefix that each query shares with a row, in the best tree."""
        best = np.zeros(strings.shape[1], int)
        for keys, s in zip(self.keys, strings, strict=True):
            at = np.searchsorted(keys, s)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(keys) - 1)):
                best = np.maximum(best, self.bits - np.frexp((keys[near] ^ s).astype(float))[1])
        return best

    def ranges(self, tree: int, strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows stand in the tree's array that share so long a prefix."""
        rest = np.uint64(self.bits - length)
        low = strings >> rest << rest
        return np.searchsorted(self.keys[tree], low), np.searchsorted(self.keys[tree], low + (np.uint64(1) << rest))

    def _unseen(self, tree: int, who: np.ndarray, a: np.ndarray, b: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
        """The pairs (query * rows + row) of these queries with the rows between a and b that weren't seen; marks them.

        Queries of one node have the same rows: where many do, they are taken node by node.
        """
        n, out = len(self.x), []
        if not len(who):
            return out
        who = who[np.lexsort((b[who], a[who]))]
        starts = np.flatnonzero(np.r_[True, (a[who][1:] != a[who][:-1]) | (b[who][1:] != b[who][:-1])])
        if 4 * len(starts) > len(who):
            size = b[who] - a[who]
            keys = np.repeat(who * n, size) + self.order[tree][np.repeat(a[who] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            out.append(keys[~seen[keys]])
        else:
            for own in np.split(who, starts[1:]):
                keys = (own * n)[:, None] + self.order[tree][a[own[0]] : b[own[0]]]
                out.append(keys[~seen[keys]])
        for keys in out:
            seen[keys] = True
        return out

    def search(self, q: np.ndarray, most: int, miss: float = MISS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of queries: the first one's number, then query (from there), row and inner product of the most nearest found."""
        for at in range(0, len(q), TOGETHER):
            yield at, *self._ascend(q[at : at + TOGETHER], most, miss)

    def _ascend(self, q: np.ndarray, most: int, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, norms = len(self.x), np.linalg.norm(q, axis=1)
        strings = self.strings(q / norms[:, None], np.zeros(len(q)))
        at, before = self.longest(strings), [None] * self.trees
        # A first look in single precision, of vectors of length one at most, spares the exact product where it can't matter.
        rough, slack = (q / norms[:, None]).astype(np.float32), 1e-6 * q.shape[1]
        seen, worst = np.zeros(len(q) * n, bool), np.full(len(q), -np.inf)
        best: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        active = np.ones(len(q), bool)
        for length in range(int(at.max()), -1, -1):
            for done in range(0, self.trees, STEP):
                fresh = [np.zeros(0, np.int64)]
                for t in range(done, min(done + STEP, self.trees)):
                    low, high = self.ranges(t, strings[t], length)
                    was = before[t] or (low, low)  # empty so far
                    before[t] = low, high
                    for a, b in ((low, was[0]), (was[1], high)):
                        fresh += self._unseen(t, np.flatnonzero(active & (b > a)), a, b, seen)
                new, found = np.concatenate(fresh), [best]
                for part in np.split(new, range(PAIRS, len(new), PAIRS)):
                    who, row = part // n, part % n
                    near = np.einsum("ij,ij->i", rough[who], self.rough[row]) >= worst[who] / (norms[who] * self.norm) - slack
                    who, row = who[near], row[near]
                    score = np.einsum("ij,ij->i", q[who], self.x[row])
                    keep = score >= worst[who]
                    found.append((who[keep], row[keep], score[keep]))
                joined = [np.concatenate(z) for z in zip(*found, strict=True)]
                chosen = vectors.firsts(joined[0], joined[2], joined[1], most)
                best = tuple(z[chosen] for z in joined)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) >= most)
                worst[full] = best[2][np.searchsorted(best[0], full, "right") - 1]
                with np.errstate(invalid="ignore"):
                    same = np.where(np.isfinite(worst), 1 - np.arccos(np.clip(worst / (norms * self.norm), -1, 1)) / np.pi, 0)
                now = min(done + STEP, self.trees)
                active &= (1 - same**length) ** now * (1 - same ** (length + 1)) ** (self.trees - now) > miss
                if not active.any():
                    return best
        return best


def _searcher(most: int):
    def work(rows: pa.Table, queries: pa.Table) -> list[np.ndarray]:
        ids = rows["ids"].combine_chunks()
        order = np.argsort([i[0].as_py() for i in ids], kind="stable")  # ties of equal products go to the smaller id
        rows, ids = rows.take(order), ids.take(order)
        flat, ends = ids.flatten().to_numpy(), np.cumsum([0, *(len(i) for i in ids)])
        asked, out = queries["query_id"].to_numpy(), []
        for at, who, row, score in Forest(vectors.matrix(rows["v"])).search(vectors.matrix(queries["v"]), most + 1):
            n = ends[row + 1] - ends[row]
            who, score = np.repeat(who, n), np.repeat(score, n)
            vec = flat[np.repeat(ends[row] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            other = np.flatnonzero(vec != asked[at + who])
            chosen = other[vectors.firsts(who[other], score[other], vec[other], most)]
            out.append((asked[at + who[chosen]], vec[chosen], score[chosen]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    return work


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, shard: int = vectors.SHARD, block: int = vectors.BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (query_id, embedding) its k nearest rows (vec_id, embedding) by inner product.

    Nearest first, ties to the smaller id; all candidates where there are fewer. Approximate: rows are found through the forest, scores
    are exact in double precision. A row of the query's own id is no candidate. Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows without an id, take no part; vectors of other lengths never meet. Repeated rows count once. Equal
    vectors are indexed once with their k + 1 smallest ids, which is all that any query can need, so a vector that a third of the rows
    share costs as much as any other. Empty tables give an empty result. Further columns are ignored.
    """
    usable = vectors.finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    own = common.only(rows, "vec_id", "embedding").toDF("vec_id", "v").where(F.col("vec_id").isNotNull() & usable)
    asked = common.only(queries, "query_id", "embedding").toDF("query_id", "v").where(F.col("query_id").isNotNull() & usable).distinct()
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    ids = own.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set(F.col("vec_id").cast("bigint"))).alias("ids"))
    found = vectors.against(common.checkpoint(ids), common.checkpoint(asked.select(F.col("query_id").cast("bigint"), "v")), "ids", "query_id", _searcher(k), "query_id long, vec_id long, score double", shard, block)
    return vectors.first(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")
