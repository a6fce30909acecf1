"""A bounded store of key and value chunks per head: append, evict, retrieve, attend, gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import topk


@dataclass(frozen=True)
class StoreConfig:
    """Tokens held, tokens to a chunk, tokens to retrieve."""

    memory_size: int = 1_048_576
    chunk_size: int = 4
    k: int = 8

    @property
    def max_chunks(self) -> int:
        return self.memory_size // self.chunk_size

    @property
    def chunks_per_query(self) -> int:
        return self.k // self.chunk_size


@dataclass(frozen=True)
class ModelDefaults:
    """Numbers that follow from a model's width."""

    hidden_size: int

    @property
    def slots(self) -> int:
        return self.hidden_size // 128

    @property
    def heads(self) -> int:
        return max(1, self.slots // 4)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def split_heads(rows: DataFrame, vector: str, heads: int, to: str | None = None) -> DataFrame:
    """One row per head, with the head's slice of the vector; the width is a multiple of heads."""
    width = F.size(vector) / heads
    part = F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.struct(h.alias("head"), F.slice(vector, (h * width).cast("int") + 1, width.cast("int")).alias("v")))
    return rows.withColumn("hv", F.explode(part)).drop(vector).select("*", F.col("hv.head").alias("head"), F.col("hv.v").alias(to or vector)).drop("hv")


def mean_vector(vectors: Column) -> Column:
    """Mean of an array of vectors, place by place."""
    n = F.size(vectors)
    first = F.element_at(vectors, 1)
    total = F.aggregate(F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), F.transform(first, lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)


def chunk(tokens: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """head, chunk_no, rep, keys, vals of tokens (head, pos from 0, key, val): whole chunks only, the rest is dropped."""
    held = tokens.withColumn("chunk_no", F.floor(F.col("pos") / config.chunk_size)).groupBy("head", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "val"))).alias("t")).where(F.size("t") == config.chunk_size)
    keys, vals = F.transform("t", lambda t: t["key"]), F.transform("t", lambda t: t["val"])
    return held.select("head", "chunk_no", mean_vector(keys).alias("rep"), keys.alias("keys"), vals.alias("vals"))


def evicted(size: int, incoming: int, max_chunks: int) -> int:
    """Chunks to remove, oldest first, before so many more come in."""
    return min(2 * incoming, max_chunks // 2) if size + incoming >= max_chunks else 0


def append(store: DataFrame | None, chunks: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """The store (head, slot from 0, rep, keys, vals) with the chunks behind what eviction leaves; slots are numbered anew.

    All heads hold the same number of chunks. Two counts decide; slots move by subtraction, so nothing is sorted or shuffled.
    """
    incoming = (chunks.agg(F.max("chunk_no")).first()[0] or 0) + 1 if chunks.limit(1).count() else 0
    size = store_size(store) if store is not None else 0
    gone = min(evicted(size, incoming, config.max_chunks), size)
    new = chunks.withColumn("slot", F.col("chunk_no") + (size - gone)).select("head", F.col("slot").cast("bigint").alias("slot"), "rep", "keys", "vals")
    if store is None:
        return new
    return store.where(F.col("slot") >= gone).withColumn("slot", F.col("slot") - gone).unionByName(new)


def store_size(store: DataFrame) -> int:
    last = store.agg(F.max("slot")).first()[0]
    return 0 if last is None else int(last) + 1


def reset(store: DataFrame) -> DataFrame:
    return store.where("false")


def stats(store: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """size in chunks, is_ready, usage of the capacity."""
    size = F.coalesce(F.max("slot") + 1, F.lit(0).cast("bigint"))
    return store.agg(size.alias("size"), (size > 0).alias("is_ready"), (size / config.max_chunks).alias("usage"))


def retrieve(store: DataFrame, queries: DataFrame, config: StoreConfig = StoreConfig(), n: int | None = None, recall: float | None = None) -> DataFrame:
    """query_id, head, rank, slot, score, keys, vals: the chunks of largest inner product with each query (query_id, head, q).

    Ties go to the older chunk; a store of fewer chunks gives fewer rows. Exact, by blocks of chunks of which a query visits those that
    can matter (topk.search); with a recall, by hyperplane tables that find that share of the best chunks as measured on some of the
    queries. Keys and values join the winners only.
    """
    n = n or config.chunks_per_query
    index = topk.build(store.select("head", "slot", "rep"))
    best = topk.search(index, queries, n) if recall is None else topk.approximate(index, queries, n, topk.tune(index, queries, n, recall))
    return best.join(store.select("head", "slot", "keys", "vals"), ["head", "slot"]).select("query_id", "head", "rank", "slot", "score", "keys", "vals")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def weighted_sum(weights: Column, vectors: Column) -> Column:
    """Sum of the vectors by their weights; null for no vectors."""
    scaled = F.zip_with(weights, vectors, lambda w, v: F.transform(v, lambda x: w * x.cast("double")))
    return F.when(F.size(vectors) > 0, F.aggregate(F.slice(scaled, 2, F.greatest(F.size(scaled) - 1, F.lit(0))), F.element_at(scaled, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y)))


def attend(retrieved: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, head, context: softmax over the retrieved tokens' scaled inner products, applied to their values."""
    tokens = retrieved.groupBy("query_id", "head").agg(F.array_sort(F.collect_list(F.struct("rank", "keys", "vals"))).alias("c"))
    rows = queries.join(tokens, ["query_id", "head"])
    keys, vals = F.flatten(F.transform("c", lambda c: c["keys"])), F.flatten(F.transform("c", lambda c: c["vals"]))
    rows = rows.select("query_id", "head", "q", keys.alias("keys"), vals.alias("vals"))
    scores = F.transform("keys", lambda k: dot(F.col("q"), k) / F.sqrt(F.size("q")))
    return rows.select("query_id", "head", weighted_sum(softmax(scores), F.col("vals")).alias("context"))


def gate(logits: Column, active: Column) -> Column:
    """Softmax over the sources that are there; the others weigh nothing, and the weights add up to one."""
    masked = F.zip_with(logits, active, lambda x, on: F.when(on, x.cast("double")))
    top = F.array_max(masked)
    e = F.transform(masked, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def fuse(logits: Column, sources: Column) -> Column:
    """The gated sum of the source vectors, null ones being inactive."""
    on = F.transform(sources, lambda s: s.isNotNull())
    width = F.array_max(F.transform(sources, F.size))
    filled = F.transform(sources, lambda s: F.coalesce(s, F.array_repeat(F.lit(0.0), width)))
    return weighted_sum(gate(logits, on), filled)


def retrieval_layers(layers: Column, wanted: Column) -> Column:
    """The layers that retrieve: a sixth of them, or as many as wanted, evenly spaced from the first."""
    r = F.when(wanted.isNull(), F.greatest(F.lit(1), F.floor(layers / 6))).otherwise(F.least(wanted, layers)).cast("int")
    return F.transform(F.sequence(F.lit(0), r - 1), lambda k: F.floor(k * layers / r).cast("int"))


def matmul(a: Column, b: Column) -> Column:
    """Product of matrices as arrays of rows."""
    columns = F.transform(F.sequence(F.lit(0), F.size(F.element_at(b, 1)) - 1), lambda j: F.transform(b, lambda r: F.get(r, j)))
    return F.transform(a, lambda r: F.transform(columns, lambda c: dot(r, c)))


def update_state(state: Column, projected: Column, inputs: Column, decay: float = 0.9) -> Column:
    """The recurrent state after a sequence: decayed, the mean outer product of projections and inputs added, rows normalised.

    projected and inputs are sequences of vectors as long as the state is wide.
    """
    across = F.transform(F.sequence(F.lit(0), F.size(state) - 1), lambda i: F.transform(projected, lambda r: F.get(r, i)))
    added = F.transform(matmul(across, inputs), lambda r: F.transform(r, lambda x: x / F.size(projected)))
    mixed = F.zip_with(state, added, lambda s, u: F.zip_with(s, u, lambda x, y: decay * x + (1 - decay) * y))
    norm = lambda r: F.greatest(F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.transform(mixed, lambda r: F.transform(r, lambda x: x / norm(r)))


def read_state(hidden: Column, state: Column, w_in: Column, w_gate: Column, w_out: Column) -> Column:
    """Gated reading of a state by a sequence: r = (H W_in) M W_out, then sigmoid([H; r] W_gate) * r. Weights are inputs."""
    r = matmul(matmul(matmul(hidden, w_in), state), w_out)
    g = matmul(F.zip_with(hidden, r, lambda h, x: F.concat(F.transform(h, lambda v: v.cast("double")), x)), w_gate)
    return F.zip_with(g, r, lambda a, b: F.zip_with(a, b, lambda x, y: y / (1 + F.exp(-x))))
