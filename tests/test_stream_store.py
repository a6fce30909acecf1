"""The store as a stream against the store as a table."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import memory
from spindrift.streaming import store

CONFIG = memory.StoreConfig(memory_size=64, chunk_size=4, k=8)


def calls(seed=1, n=7, heads=2, dim=3):
    """Events of calls of different lengths, also one that fills no chunk and one without queries."""
    rng = np.random.default_rng(seed)
    out = []
    for call in range(n):
        rows = []
        for head in range(heads):
            for pos in range([58, 13, 2, 40, 0, 29, 100][call % 7]):
                rows.append({"head": head, "call": call, "pos": pos, "key": rng.standard_normal(dim).tolist(), "val": [float(call), float(pos)]})
            for q in range(0 if call == 5 else 3):
                rows.append({"head": head, "call": call, "query_id": 10 * call + q, "q": rng.standard_normal(dim).tolist()})
        rng.shuffle(rows)
        out.append(rows)
    return out


def as_table(spark, batches):
    """What the table operators give for the same calls, one after the other."""
    table, found = None, []
    for rows in batches:
        df = spark.createDataFrame([{k: r.get(k) for k in ("head", "call", "pos", "key", "val", "query_id", "q")} for r in rows], store.EVENT)
        if table is not None:
            found += [tuple(r) for r in memory.retrieve(table, df.where("q is not null"), CONFIG).join(df.select("query_id", "call").distinct(), "query_id").select("head", "call", "query_id", "rank", "slot", F.round("score", 9), "keys", "vals").collect()]
        chunks = memory.chunk(df.where("key is not null"), CONFIG)
        if chunks.count():
            added = memory.append(table, chunks, CONFIG)
            table = spark.createDataFrame(added.collect(), added.schema)
    return table, found


def plain(rows):
    return sorted(json.dumps([round(x, 9) if isinstance(x, float) else x for x in r]) for r in (list(r) for r in rows))


def run(spark, path, batches, start=0, stop=None):
    """Feeds the batches from start to stop to a stream that goes on from its checkpoint."""
    store.use_rocksdb(spark)
    source, out = path / "in", path / "out"
    source.mkdir(exist_ok=True)
    for i in range(start, stop or len(batches)):
        (source / f"{i:03}.json").write_text("\n".join(map(json.dumps, batches[i])))
        events = spark.readStream.schema(store.EVENT).json(str(source))
        q = store.bounded_store(events, CONFIG).writeStream.format("parquet").option("checkpointLocation", str(path / "state")).trigger(availableNow=True).start(str(out))
        q.awaitTermination()
    return spark.read.schema(store.RETRIEVED).parquet(str(out)), store.read_store(spark, str(path / "state"))


def test_stream_equals_table_and_goes_on_after_restarts(spark, tmp_path):
    batches = calls()
    table, want = as_table(spark, batches)
    found, kept = run(spark, tmp_path, batches)  # every call is a start from the checkpoint of the call before
    assert plain(kept.select("head", "slot", "rep", "keys", "vals").collect()) == plain(table.select("head", "slot", "rep", "keys", "vals").collect())
    assert plain(found.withColumn("score", F.round("score", 9)).collect()) == plain(want) and want
    sizes = {r["head"]: r["n"] for r in kept.groupBy("head").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(sizes.values()) == {memory.store_size(table)} and memory.store_size(table) <= CONFIG.max_chunks + 25


def test_calls_of_one_batch_are_taken_in_order(spark, tmp_path):
    batches = calls(2)
    one = [sum(batches, [])]
    for name, b in (("a", batches), ("b", one)):
        (tmp_path / name).mkdir()
    (found, kept), (again, kept_again) = (run(spark, tmp_path / n, b) for n, b in (("a", batches), ("b", one)))
    assert plain(found.collect()) == plain(again.collect())
    assert plain(kept.collect()) == plain(kept_again.collect())


def test_odd_rows(spark, tmp_path):
    rows = [{"head": None, "call": 0, "key": [1.0]}, {"head": 0, "call": None, "q": [1.0], "query_id": 1}, {"head": 0, "call": 0}, {"head": 0, "call": 0, "q": [1.0], "query_id": 2}]
    found, kept = run(spark, tmp_path, [rows])
    assert found.count() == 0 and kept.count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_retrieval_from_few_chunks(spark, tmp_path, n):
    rows = [{"head": 0, "call": 0, "pos": i, "key": [1.0, float(i)], "val": [0.0]} for i in range(4 * n)]
    found, _ = run(spark, tmp_path, [rows or [{"head": 0, "call": 0}], [{"head": 0, "call": 1, "query_id": 5, "q": [0.0, 2.0]}]])
    assert [(r["rank"], r["slot"], r["score"]) for r in found.collect()] == [(1, 0, 3.0)] * n


class _CountedState:
    """State of a key in a dict; counts what is written."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def exists(self):
        return None in self.held

    def get(self):
        return self.held[None]

    def update(self, v):
        self.updateValue(None, v)

    def getValue(self, k):
        return self.held[k]

    def keys(self):
        return iter(list(self.held))

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, k, v):
        self.writes += 1
        self.held[k] = v

    def removeKey(self, k):
        self.writes += 1
        del self.held[k]


def test_commits_write_slices_not_items():
    from types import SimpleNamespace

    import pandas as pd

    from spindrift.streaming import stateful

    states = {}
    made = lambda name, *_: states.setdefault(name, _CountedState())
    p = stateful._Commits(None)
    p.init(SimpleNamespace(getValueState=made, getMapState=made))
    codes = [{f"i{k}": k * (n + 1) for k in range(3000) if k % (n + 2)} for n in range(4)]
    rows = pd.DataFrame([(n, n - 1 if n else None, list(c), list(c.values())) for n, c in enumerate(codes)], columns=["commit_no", "prev_no", "ids", "digests"])
    found = [*p.handleInputRows(("r",), iter([rows.iloc[[3, 1]]]), None), *p.handleInputRows(("r",), iter([rows.iloc[[2, 0]]]), None)]
    want = [(n, i, "removed" if i not in codes[n] else "modified" if i in codes[n - 1] else "added") for n in (1, 2, 3) for i in codes[n] | codes[n - 1] if codes[n].get(i) != codes[n - 1].get(i)]
    assert sorted(r for f in found for r in f[["commit_no", "id", "status"]].itertuples(index=False, name=None)) == sorted(want)
    assert {i: d for own, those in states["items"].held.values() for i, d in zip(own, those, strict=True)} == codes[3]
    assert not states["waiting"].held and states["last"].get() == (3,) and sum(s.writes for s in states.values()) < 300
