"""The bounded vector store as a stream: its vectors live in Spark's state store, a head a key.

A call brings tokens, queries or both, as the model does: what is retrieved is what was stored before the call, then the call's tokens
are cut into chunks, the oldest chunks make room (operators.memory.evicted), and the new ones are added. Chunks are map entries under a running
number, so a call writes what it adds and removes what it drives out, and nothing else. A restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import StoreConfig, evicted

#: What a stream's rows are: a token has key and val, a query has query_id and q.
EVENT = "head int, call bigint, pos bigint, key array<double>, val array<double>, query_id bigint, q array<double>"
_CHUNK = "rep array<double>, keys array<array<double>>, vals array<array<double>>"
RETRIEVED = "head int, call bigint, query_id bigint, rank int, slot bigint, score double, keys array<array<double>>, vals array<array<double>>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """State variables need this state store; streams that start later use it."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Store(StatefulProcessor):
    def __init__(self, config: StoreConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.span = handle.getValueState("span", "first bigint, next bigint")
        self.chunks = handle.getMapState("chunks", "no bigint", _CHUNK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows)
        first, following = self.span.get() if self.span.exists() else (0, 0)
        held: dict[int, tuple] | None = None  # read from the state when a query first needs it
        for call, own in events.groupby("call", sort=True):
            asked = own[own["q"].notna()].sort_values("query_id", kind="stable")
            if len(asked) and following > first:
                if held is None:
                    held = {no: tuple(c) for (no,), c in self.chunks.iterator()}
                yield self._retrieve(key[0], call, asked, held, first)
            tokens = own[own["key"].notna()].sort_values("pos", kind="stable")
            new = len(tokens) // self.config.chunk_size
            gone = min(evicted(following - first, new, self.config.max_chunks), following - first) if new else 0
            for no in range(first, first + gone):
                self.chunks.removeKey((no,))
                if held is not None:
                    del held[no]
            for i in range(new):
                part = tokens.iloc[i * self.config.chunk_size : (i + 1) * self.config.chunk_size]
                keys, vals = ([np.asarray(v, float).tolist() for v in part[c]] for c in ("key", "val"))
                chunk = (np.mean(keys, axis=0).tolist(), keys, vals)
                self.chunks.updateValue((following + i,), chunk)
                if held is not None:
                    held[following + i] = chunk
            first, following = first + gone, following + new
        self.span.update((first, following))

    def _retrieve(self, head: int, call: int, asked: pd.DataFrame, held: dict[int, tuple], first: int) -> pd.DataFrame:
        numbers = sorted(held)
        scores = np.array([np.asarray(q, float) for q in asked["q"]]) @ np.array([held[no][0] for no in numbers]).T
        out = []
        for query, s in zip(asked["query_id"], scores, strict=True):
            for rank, at in enumerate(np.argsort(-s, kind="stable")[: self.config.chunks_per_query], 1):
                out.append((head, call, query, rank, numbers[at] - first, s[at], *held[numbers[at]][1:]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in RETRIEVED.split(", ")])

    def close(self) -> None:
        pass


def bounded_store(events: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """head, call, query_id, rank, slot, score, keys, vals: for each query of a stream of events (EVENT) its best chunks, as
    ``operators.memory.retrieve`` finds them in the store of that moment.

    A call's rows come in one micro-batch and calls in order; tokens stand in the order of pos, and those that fill no chunk are
    dropped. A query that finds an empty store has no rows, one that finds fewer chunks than it wants has fewer. Rows that have
    neither a key nor a q, or no head or call, are left out. Call ``use_rocksdb`` before the stream starts.
    """
    kinds = {c.split()[0]: c.split()[1] for c in EVENT.split(", ")}
    rows = events.select(*[F.col(c).cast(kind) for c, kind in kinds.items()]).where("head is not null and call is not null and (key is not null or q is not null)")
    return rows.groupBy("head").transformWithStateInPandas(_Store(config), RETRIEVED, "Append", "none")


def read_store(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The store (head, slot from 0, rep, keys, vals) of a stream that was checkpointed there, as operators.memory has it."""
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    span = state("span").select(F.col("key.head").alias("head"), F.col("value.first").alias("first"))
    chunks = state("chunks").select(F.col("key.head").alias("head"), F.col("user_map_key.no").alias("no"), "user_map_value.*")
    return chunks.join(span, "head").select("head", (F.col("no") - F.col("first")).alias("slot"), "rep", "keys", "vals")
