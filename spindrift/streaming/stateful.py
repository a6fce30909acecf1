"""Streams with state per key. State is kept by Spark's state store and checkpointed with the query, so a lost executor loses none."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memory import evicted
from ..operators.snapshot import neighbours


def fifo_store(chunks: DataFrame, max_chunks: int) -> DataFrame:
    """A bounded store per head over a stream of chunks (head, seq, rep): per arrival the slot, how many it drove out and the size.

    seq orders the chunks of a batch. The state holds a head's count, not its vectors: slots are numbers, and a sink that keeps the
    newest size chunks of a head keeps the store.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, total = state.get if state.exists else (0, 0)
        rows = pd.concat(frames).sort_values("seq", kind="stable")
        gone = min(evicted(size, len(rows), max_chunks), size)
        size += len(rows) - gone
        slots = np.arange(size - len(rows), size)
        state.update((size, total + len(rows)))
        yield pd.DataFrame({"head": key[0], "seq": rows["seq"].to_numpy(), "slot": slots, "evicted": gone, "size": size})

    return chunks.select("head", "seq").groupBy("head").applyInPandasWithState(run, "head int, seq bigint, slot bigint, evicted bigint, size bigint", "size bigint, total bigint", "append", GroupStateTimeout.NoTimeout)


def decayed_state(sequences: DataFrame, width: int, decay: float = 0.9) -> DataFrame:
    """The recurrent state per key over a stream of (key, seq, projected, inputs), each a list of vectors of the width.

    The state starts as the identity; each sequence decays it, adds the mean outer product, and scales its rows to length one.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = np.array(json.loads(state.get[0])) if state.exists else np.eye(width)
        out = []
        for r in pd.concat(frames).sort_values("seq", kind="stable").itertuples():
            p, x = np.array(json.loads(r.projected), float), np.array(json.loads(r.inputs), float)
            m = decay * m + (1 - decay) * (p.T @ x) / len(p)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            out.append((r.key, r.seq, m.tolist()))
        state.update((json.dumps(m.tolist()),))
        yield pd.DataFrame(out, columns=["key", "seq", "state"])

    read = sequences.select("key", "seq", F.to_json("projected").alias("projected"), F.to_json("inputs").alias("inputs"))
    return read.groupBy("key").applyInPandasWithState(run, "key string, seq bigint, state array<array<double>>", "state string", "append", GroupStateTimeout.NoTimeout)


#: Groups that the ids of a repository are dealt into, each with a state of its own, and entries that a group's items are dealt into.
BUCKETS, SLICES = 16, 256
_STATUS = "repo string, commit_no int, id string, status string"


def _slice(i: str) -> int:
    return zlib.crc32(i.encode("utf-8", "surrogatepass")) % SLICES


class _Commits(StatefulProcessor):
    """The digests of the last commit's items, an entry for each slice of ids, and the commits that wait for their predecessor, by its
    number.

    Each access to the state is a call to the JVM, so a call reads the items once, takes all commits whose turn it is, and writes the
    slices that differ. A commit whose turn it is doesn't wait in the state.
    """

    def __init__(self, patience: float | None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "commit_no int")
        self.items = handle.getMapState("items", "slice int", "ids array<string>, digests array<bigint>")
        self.waiting = handle.getMapState("waiting", "prev_no int", "commit_no int, ids array<string>, digests array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._open()
        for frame in rows:
            for r in frame.sort_values("commit_no", kind="stable").itertuples():
                before, commit = NONE if pd.isna(r.prev_no) else int(r.prev_no), (int(r.commit_no), [str(i) for i in r.ids], [int(d) for d in r.digests])
                if before == self.at:
                    if before in self.queue:
                        self._leave(before)
                    yield from self._take(key[0], *commit)
                    yield from self._settle(key[0])
                else:
                    self.waiting.updateValue((before,), commit)
                    self.queue.add(before)
        self._close()
        if self.patience is not None and self.queue and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.patience * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._open()
        waiting = {no: c[0] for (no,), c in self.waiting.iterator()}
        if waiting:  # the predecessor is given up: the earliest that waits follows what came last
            before = min(waiting, key=waiting.get)
            commit = self.waiting.getValue((before,))
            self._leave(before)
            yield from self._take(key[0], *commit)
            yield from self._settle(key[0])
        self._close()
        if self.queue:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.patience * 1000))

    def _open(self) -> None:
        self.at = self.last.get()[0] if self.last.exists() else NONE
        self.queue = {no for (no,) in self.waiting.keys()}
        self.held: dict[str, int] | None = None  # read when a commit's turn comes
        self.touched: set[int] = set()

    def _close(self) -> None:
        """Writes the slices that differ from what was read, no others."""
        if self.held is not None:
            self.last.update((self.at,))
        if not self.touched:
            return
        slices = defaultdict(lambda: ([], []))
        for i, d in self.held.items():
            if (k := _slice(i)) in self.touched:
                slices[k][0].append(i)
                slices[k][1].append(d)
        for k in self.touched:
            if k in slices:
                self.items.updateValue((k,), slices[k])
            else:
                self.items.removeKey((k,))

    def _leave(self, before: int) -> None:
        self.waiting.removeKey((before,))
        self.queue.discard(before)

    def _settle(self, repo: str) -> Iterator[pd.DataFrame]:
        """What the waiting commits changed whose turn it is."""
        while self.at in self.queue:
            commit = self.waiting.getValue((self.at,))
            self._leave(self.at)
            yield from self._take(repo, *commit)

    def _take(self, repo: str, no: int, ids: list[str], digests: list[int]) -> Iterator[pd.DataFrame]:
        if self.held is None:
            self.held = {i: d for _, (own, those) in self.items.iterator() for i, d in zip(own, those, strict=True)}
        now, held = dict(zip(ids, digests, strict=True)), self.held
        out = [(i, "modified" if i in held else "added") for i, d in now.items() if held.get(i) != d] + [(i, "removed") for i in held if i not in now]
        self.touched |= {_slice(i) for i, _ in out}
        first, self.at, self.held = self.at == NONE, no, now
        if not first and out:
            yield pd.DataFrame({"repo": repo, "commit_no": no, "id": [i for i, _ in out], "status": [s for _, s in out]})

    def close(self) -> None:
        pass


#: The predecessor's number of a first commit.
NONE = -1


def commit_diffs(commits: DataFrame, buckets: int = BUCKETS, patience: float | None = None) -> DataFrame:
    """repo, commit_no, id, status: changes against the commit before, over a stream of commits (repo, commit_no, prev_no, items) that
    may come in any order.

    items are all of a commit (id, code); a repository's first commit has a null prev_no and gives nothing. A commit waits in the state
    until the one before it has been taken, with patience for so many seconds: then it follows what came last. The state is kept by
    repository and bucket of ids, an entry per slice of a bucket, so a commit writes the slices that it changes. A commit that comes again is taken once, if
    its predecessor isn't expected any more it waits. Call store.use_rocksdb before the stream starts.
    """
    bucket = lambda i: F.pmod(F.xxhash64(i), F.lit(buckets)).cast("int")
    dealt = commits.select("repo", "commit_no", "prev_no", "items", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    own = dealt.withColumn("items", F.filter("items", lambda x: bucket(x["id"]) == F.col("bucket")))
    rows = own.select("repo", "bucket", "commit_no", "prev_no", F.transform("items", lambda x: x["id"]).alias("ids"), F.transform("items", lambda x: F.xxhash64(x["code"])).alias("digests"))
    mode = "none" if patience is None else "processingTime"
    return rows.groupBy("repo", "bucket").transformWithStateInPandas(_Commits(patience), _STATUS, "Append", mode)


def as_commits(items: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """repo, commit_no, prev_no, items: a table of items (repo, commit_no, id, code) as commits, also those without items."""
    held = items.groupBy("repo", "commit_no").agg(F.collect_list(F.struct("id", "code")).alias("items"))
    near = neighbours(commits if commits is not None else items).drop("next_no")
    none = F.array().cast(held.schema["items"].dataType)
    return near.join(held, ["repo", "commit_no"], "left").select("repo", F.col("commit_no").cast("int").alias("commit_no"), F.col("prev_no").cast("int").alias("prev_no"), F.coalesce("items", none).alias("items"))
