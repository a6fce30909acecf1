"""The rows of largest inner product with each query, without meeting every row.

Rows lie in k-means blocks. A block's centre and radius bound what any of its rows can score with a query, so a query visits its most
promising block first and then only those whose bound reaches the score of its last kept row. Exact. The approximate option looks a
query up in hyperplane tables whose recall is measured. Blocks and tables' buckets are cut into pieces, and their visitors into parts, so
that no task holds more than a piece and a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage

#: Rows to a block at first, most blocks of a head, rows that they are fitted on, rows of a piece and visitors of a part.
BLOCK, MOST, SAMPLE, PIECE, PART = 4096, 1024, 20_000, 8192, 2048
#: Pairs of a row and a block that a task looks at together: a batch of visits has no more rows, whatever the number of blocks.
VISITS = 1 << 15
#: Hyperplane tables and the numbers of planes that are tried, and queries on which recall is measured.
TABLES, PLANES, MEASURED, SEED = 24, (16, 14, 12, 10, 8, 6, 4, 2, 0), 200, 7


@dataclass
class Index:
    """rows: head, block, slot, v. Per head: centres (block, place), radii and numbers of rows."""

    rows: DataFrame
    blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _fit(blocks: dict[int, int]):
    """Lloyd's rounds over a head's sample, started from rows that lie spread out."""

    def run(t: pa.Table) -> pa.Table:
        x, head = _matrix(t["v"]), t["head"][0].as_py()
        k, rng = min(blocks[head], len(x)), np.random.default_rng(SEED)
        chosen, far = [int(rng.integers(len(x)))], np.full(len(x), np.inf)
        while len(chosen) < k:
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(rng.choice(len(x), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(x))))
        centres = x[chosen]
        for _ in range(6):
            own = _nearest(x, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            n = np.bincount(own, minlength=k)[:, None]
            centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
        return pa.table({"head": pa.array([head] * k, pa.int32()), "block": pa.array(range(k), pa.int64()), "centre": pa.array(list(centres), pa.list_(pa.float64()))})

    return run


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres**2).sum(axis=1) / 2
    step = max(1, 16 * VISITS // len(centres))
    return np.concatenate([(x[i : i + step] @ centres.T - size).argmax(axis=1) for i in range(0, len(x), step)])


def build(rows: DataFrame, block: int = BLOCK) -> Index:
    """The index of rows (head, slot, rep): slots are unique in a head, vectors of a head have one length; null vectors are left out.

    Blocks are fitted on about SAMPLE rows of a head, every row is assigned to the nearest centre. Centres, radii and counts pass through the
    driver: at most MOST per head.
    """
    own = rows.select(F.col("head").cast("int").alias("head"), F.col("slot").cast("bigint").alias("slot"), F.col("rep").alias("v")).where("v is not null")
    counts = {r["head"]: r["count"] for r in own.groupBy("head").count().collect()}
    wanted = {h: min(MOST, -(-n // block)) for h, n in counts.items()}
    if all(k == 1 for k in wanted.values()):  # nothing to tell apart: no centre, no bound
        return Index(own.withColumn("block", F.lit(0).cast("bigint")), {h: (np.zeros((1, 0)), np.array([np.inf]), np.array([n])) for h, n in counts.items()})
    spark = rows.sparkSession
    rate = spark.createDataFrame([(h, min(1.0, SAMPLE / n)) for h, n in counts.items()], "head int, rate double")
    draw = F.xxhash64("head", "slot").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    drawn = own.join(F.broadcast(rate), "head").where(draw < F.col("rate")).select("head", "v")
    centres: dict[int, np.ndarray] = {}
    for r in drawn.groupBy("head").applyInArrow(_fit(wanted), "head int, block bigint, centre array<double>").orderBy("head", "block").toArrow().to_pylist():
        centres.setdefault(r["head"], []).append(r["centre"])
    centres = {h: np.array(centres[h]) for h in centres}

    def assign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            heads = b.column("head").to_numpy()
            for h in np.unique(heads):
                part = b.filter(pa.array(heads == h))
                x = _matrix(part.column("v"))
                at = _nearest(x, centres[h])
                yield pa.record_batch([part.column("head"), pa.array(at.astype(np.int64)), part.column("slot"), part.column("v"), pa.array(np.linalg.norm(x - centres[h][at], axis=1))], names=["head", "block", "slot", "v", "far"])

    kind = own.schema["v"].dataType.simpleString()
    held = storage.checkpoint(own.where(F.col("head").isin([int(h) for h in centres])).mapInArrow(assign, f"head int, block bigint, slot bigint, v {kind}, far double"))
    blocks = {h: (c, np.full(len(c), -np.inf), np.zeros(len(c), int)) for h, c in centres.items()}
    for r in held.groupBy("head", "block").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        blocks[r["head"]][1][r["block"]], blocks[r["head"]][2][r["block"]] = r["far"], r["n"]
    return Index(held.drop("far"), blocks)


def _best(most: int):
    """The best rows of a piece for each visitor of a part; ties go to the smaller slot."""

    def run(rows: pa.Table, visitors: pa.Table) -> pa.Table:
        if rows.num_rows and visitors.num_rows:
            rows = rows.sort_by("slot")
            x, q, slots = _matrix(rows["v"]), _matrix(visitors["q"]), rows["slot"].to_numpy()
            at, best = [], []
            for i in range(0, len(q), 256):
                s = q[i : i + 256] @ x.T
                if len(slots) > most:
                    edge = np.partition(s, -most, axis=1)[:, -most]
                    near = s >= edge[:, None]
                    who, where = np.nonzero(near)
                    order = np.lexsort((where, -s[who, where], who))
                    who, where = who[order], where[order]
                    first = np.searchsorted(who, np.arange(len(s)))
                    keep = np.arange(len(who)) - first[who] < most
                    who, where = who[keep], where[keep]
                else:
                    who, where = np.divmod(np.arange(s.size), len(slots))
                at.append(i + who)
                best.append((where, s[who, where]))
            who, where, score = np.concatenate(at), np.concatenate([w for w, _ in best]), np.concatenate([s for _, s in best])
            return pa.table([visitors["query_id"].take(pa.array(who)), visitors["head"].take(pa.array(who)), pa.array(slots[where]), pa.array(score)], names=["query_id", "head", "slot", "score"])
        return pa.table({"query_id": visitors["query_id"].slice(0, 0), "head": pa.array([], pa.int32()), "slot": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return run


def _meet(rows: DataFrame, visits: DataFrame, most: int, piece: int = PIECE, part: int = PART) -> DataFrame:
    """query_id, head, slot, score: the best rows (head, block, slot, v) of each block for its visitors (query_id, head, q, block).

    A block that nobody visits is not sent. Rows and visitors of a block are dealt into pieces and parts by hash, and each piece meets each part.
    """
    keys = ["head", "block"]
    n = visits.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces")).join(n, keys)
    dealt = lambda c, count: F.pmod(F.xxhash64(c), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    sizes = storage.checkpoint(sizes)  # a row for each visited block
    left = rows.join(sizes, keys).withColumn("piece", dealt("slot", "pieces")).withColumn("part", every("parts")).drop("parts", "pieces")
    right = visits.join(sizes, keys).withColumn("part", dealt("query_id", "parts")).withColumn("piece", every("pieces")).drop("parts", "pieces")
    by = [*keys, "piece", "part"]
    kind = visits.schema["query_id"].dataType.simpleString()
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best(most), f"query_id {kind}, head int, slot bigint, score double")


def _first(found: DataFrame, most: int) -> DataFrame:
    best = Window.partitionBy("query_id", "head").orderBy(F.desc("score"), "slot")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("head").cast("int").alias("head"), "q").where("q is not null")


def _chosen(blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], bounds):
    """The visits of queries to the blocks that bounds names, in batches of VISITS rows at most."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            heads = b.column("head").to_numpy()
            for h in np.unique(heads):
                if h in blocks:
                    of = b.filter(pa.array(heads == h))
                    step = max(1, VISITS // len(blocks[h][0]))
                    for i in range(0, of.num_rows, step):
                        part = of.slice(i, step)
                        who, block = bounds(part, *blocks[h])
                        yield pa.record_batch([*(part.column(c).take(pa.array(who)) for c in ("query_id", "head", "q")), pa.array(block.astype(np.int64))], names=["query_id", "head", "q", "block"])

    return run


def visits(index: Index, queries: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first visits of queries (query_id, head, q), to the block whose centre promises most, and what they find there; then
    the visits to all other blocks that could still hold a row as good as the last one kept."""
    blocks = index.blocks
    kind = queries.schema["q"].dataType.simpleString()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, head int, q {kind}, block bigint"

    def home(part: pa.RecordBatch, centres: np.ndarray, radii: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = _matrix(part.column("q")) @ centres.T if centres.shape[1] else np.zeros((part.num_rows, 1))
        return np.arange(part.num_rows), np.where(n > 0, s, -np.inf).argmax(axis=1)

    def others(part: pa.RecordBatch, centres: np.ndarray, radii: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, least = _matrix(part.column("q")), part.column("least").to_numpy(zero_copy_only=False)
        s = q @ centres.T
        reach = s + np.linalg.norm(q, axis=1)[:, None] * np.maximum(radii, 0)
        reach += 1e-9 * (np.abs(reach) + 1)  # rounding must not lose a tie
        wanted = (n > 0) & (reach >= np.nan_to_num(least, nan=-np.inf)[:, None])
        wanted[np.arange(len(q)), np.where(n > 0, s, -np.inf).argmax(axis=1)] = False
        return np.nonzero(wanted)

    asked = _asked(queries)
    found = _meet(index.rows, asked.mapInArrow(_chosen(blocks, home), schema), most)
    if all(len(c) == 1 for c, _, _ in blocks.values()):
        return found, None
    found = storage.checkpoint(found)
    least = found.groupBy("query_id", "head").agg(F.when(F.count(F.lit(1)) >= most, F.min("score")).alias("least"))
    more = storage.checkpoint(asked.join(least, ["query_id", "head"], "left").mapInArrow(_chosen(blocks, others), schema))
    return found, more


def search(index: Index, queries: DataFrame, most: int) -> DataFrame:
    """query_id, head, slot, score, rank: for each query (query_id, head, q) the rows of largest inner product; ties to the smaller slot.

    Exact; fewer rows where the head has fewer; none for null queries and heads that the index doesn't have.
    """
    if not index.blocks:
        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, head int, slot bigint, score double, rank int")
    found, more = visits(index, queries, most)
    return _first(found if more is None else found.unionByName(_meet(index.rows, more, most)), most)


def visited(index: Index, queries: DataFrame, most: int) -> DataFrame:
    """query_id, head, visited, blocks: how many blocks a search for each query visits, of how many that hold rows."""
    _, more = visits(index, queries, most)
    full = queries.sparkSession.createDataFrame([(int(h), int((n > 0).sum())) for h, (_, _, n) in index.blocks.items()], "head int, blocks int")
    own = _asked(queries).select("query_id", "head").join(F.broadcast(full), "head")
    n = more.groupBy("query_id", "head").agg(F.count(F.lit(1)).alias("n")) if more is not None else own.select("query_id", "head", F.lit(0).alias("n"))
    return own.join(n, ["query_id", "head"], "left").select("query_id", "head", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("visited"), "blocks")


def _codes(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """The signs of the first planes of each table as numbers (table, row)."""
    signs = (np.einsum("nd,tdb->tnb", x, planes[:, :, :bits]) > 0) if bits else np.zeros((len(planes), len(x), 0), bool)
    return (signs * (1 << np.arange(bits))).sum(axis=2)


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with one more component that makes all norms equal, so that angles rank inner products."""
    return np.hstack([x / norm, np.sqrt(np.maximum(1 - (x**2).sum(axis=1, keepdims=True) / norm**2, 0))])


@dataclass
class Tables:
    """Hyperplane tables: bits of each, and the share of the true best rows of the measured queries that share a bucket with them."""

    bits: int
    recall: float
    norm: float


def tune(index: Index, queries: DataFrame, most: int, target: float = 0.9, tables: int = TABLES) -> Tables:
    """The most bits of PLANES with which the tables find the target share of the best rows, as measured on about MEASURED queries.

    The exact search gives these queries' best rows; whether a pair shares a bucket follows from the two vectors.
    """
    asked = _asked(queries)
    n = asked.count()
    share = F.xxhash64("query_id", "head").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)) < F.lit(MEASURED / max(n, 1))
    best = search(index, asked.where(share), most).join(index.rows.select("head", "slot", "v"), ["head", "slot"]).join(asked, ["query_id", "head"]).select("q", "v").toArrow()
    norm = (index.rows.select(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0] or 1.0) ** 0.5 * (1 + 1e-9) or 1.0
    if not best.num_rows:
        return Tables(0, 1.0, norm)
    q, v = _matrix(best["q"]), _matrix(best["v"])
    planes = _planes(q.shape[1], tables)
    for bits in PLANES:
        differ = _codes(_lifted(v, norm), planes, bits) ^ _codes(np.pad(q, ((0, 0), (0, 1))), planes, bits)
        recall = float(((differ & (differ - 1)) == 0).any(axis=0).mean())  # the own bucket and those one sign away
        if recall >= target:
            break
    return Tables(bits, recall, norm)


def _planes(dim: int, tables: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((tables, dim + 1, max(PLANES)))


def approximate(index: Index, queries: DataFrame, most: int, tuned: Tables, tables: int = TABLES) -> DataFrame:
    """query_id, head, slot, score, rank as ``search``, but of rows that share a bucket with the query in some table, or one beside it."""
    if not index.blocks:
        return search(index, queries, most)
    bits = tuned.bits

    def filed(column: str, query: bool):
        flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int64) if query else np.zeros(1, np.int64)

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in stream:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    x = _matrix(part.column(column))
                    codes = _codes(np.pad(x, ((0, 0), (0, 1))) if query else _lifted(x, tuned.norm), _planes(x.shape[1], tables), bits)
                    block = (codes[:, :, None] ^ flips) + (np.arange(tables, dtype=np.int64) << 32)[:, None, None]
                    who = pa.array(np.broadcast_to(np.arange(len(x))[None, :, None], block.shape).ravel())
                    yield pa.record_batch([*(part.column(c).take(who) for c in part.schema.names), pa.array(block.ravel())], names=[*part.schema.names, "block"])

        return run

    kinds = lambda df: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", block bigint"
    rows, asked = index.rows.select("head", "slot", "v"), _asked(queries)
    found = _meet(rows.mapInArrow(filed("v", False), kinds(rows)), storage.checkpoint(asked.mapInArrow(filed("q", True), kinds(asked))), most)
    return _first(found.groupBy("query_id", "head", "slot").agg(F.max("score").alias("score")), most)  # met in several tables
