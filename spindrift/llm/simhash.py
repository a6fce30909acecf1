"""SimHash near-duplicates by BK-trees (operator 10).

Each document gets a fingerprint of one or more 64-bit words from its word shingles. Fingerprints that can be within the radius are
brought together by table keys: masks of a fingerprint's bits. With a small radius the masks are exact: the bits are cut into
radius + k blocks, two fingerprints within the radius agree on k of them at least, and every choice of k blocks is a table.
In a bucket (one table, one key) a BK-tree over its fingerprints, children keyed by the integer Hamming distance to their parent, answers all of the bucket's queries together and
follows only edges within the radius of a query's distance. A bucket of more than ``SHARD`` fingerprints is cut into shards, one
tree each, and every pair of shards is a task of its own. A task returns a star for each connected set it finds, never all pairs.

Equal fingerprints are one node from the start, so copies cost one row. Trees stay with the task that owns their shard: they grow
with the corpus, so broadcasting them has no size bound. Components follow from the stars by joins, with a checkpoint each round.

For a similarity of shingle sets (the pipeline's stage) the fingerprints have WORDS words and a radius that similar sets keep but with
a probability of one in a billion. No mask of bits brings such distant fingerprints together, so their tables are bands of least hashes; in a bucket the
BK-tree finds the pairs within the radius, and as the radius admits less similar sets too, each link is then counted on the sets themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, meet

SEED = 42
#: Fingerprints to a tree; larger buckets are cut.
SHARD = 1024
#: Documents with one fingerprint from which they get its component by a broadcast of such fingerprints, not by a shuffle.
HOT = 1000
#: Bands of least hashes and hashes to a band, by which similar shingle sets meet; what rounding may take from a bound on counts.
BANDS, ROWS, SLACK = 32, 5, 1e-6
#: Words of a set's fingerprint and differing bits up to which sets are compared. At a similarity of 0.8 a bit differs with a probability of
#: 0.152 in sets of a hundred shingles or more and of 0.1875 at most (4 shingles and one more): over 88 of 256 bits with 1e-9.
WORDS, RADIUS = 4, 88
#: Bands whose buckets are searched before those of all; shingles to a part of a bucket.
FIRST, PART = 4, 4_000_000

_rng = np.random.default_rng(SEED)
_XOR, _ODD = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64), _rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that makes further words of a fingerprint from the same shingle hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle of the lower-cased text, repeats included; of the whole sequence if it is shorter."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, k: int, n_words: int = 1) -> list[int]:
    """n_words signed 64-bit words; a bit is 1 if more than half of the hashes have it; all zero without a word."""
    return print_of(shingle_hashes(text, k), n_words)


def print_of(h: np.ndarray, n_words: int) -> list[int]:
    """The fingerprint of shingle hashes."""
    out = []
    for i in range(n_words):
        if i:
            h = _mix(h + np.uint64(0x9E3779B97F4A7C15))
        set_bits = np.zeros(64, np.int64)
        for a in range(0, len(h), 1 << 14):
            set_bits += np.unpackbits(h[a : a + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(set_bits * 2 > len(h), bitorder="little").view("<i8")[0]) if len(h) else 0)
    return out


def fingerprints(docs: DataFrame, text: str, shingle: int, n_words: int = 1) -> DataFrame:
    """The columns of docs but the text, and f0, f1, ...: the fingerprint of each whole text (null: as empty)."""
    kept = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"f{i} bigint" for i in range(n_words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            found = np.array([fingerprint(t.as_py(), shingle, n_words) for t in texts], np.int64).reshape(-1, n_words)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(np.ascontiguousarray(found[:, i])) for i in range(n_words)], names=[*names, *[f"f{i}" for i in range(n_words)]])

    return docs.mapInArrow(run, schema)


class BKTree:
    """A BK-tree over rows of 64-bit words. Nodes are in preorder of insertion: the first row of a set is its root."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.nodes: list[tuple[int, list[tuple[int, int]]]] = []  # (row, [(distance, node of the child)])
        todo: list[tuple[np.ndarray, list | None, int]] = [(np.arange(len(rows)), None, 0)] if len(rows) else []
        while todo:
            members, above, distance = todo.pop()
            edges: list[tuple[int, int]] = []
            if above is not None:
                above.append((distance, len(self.nodes)))
            self.nodes.append((int(members[0]), edges))
            if len(rest := members[1:]):
                d = hamming(rows[rest], rows[members[0]])
                if len(rest) == 1:
                    todo.append((rest, edges, int(d[0])))
                    continue
                order = np.argsort(d, kind="stable")
                cuts = np.flatnonzero(np.diff(d[order])) + 1
                for part in np.split(order, cuts):
                    todo.append((rest[part], edges, int(d[part[0]])))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each row with queries within the radius: the row, the queries. All queries go down together."""
        todo = [(0, np.arange(len(queries)))] if self.nodes and len(queries) else []
        while todo:
            node, asked = todo.pop()
            row, edges = self.nodes[node]
            d = hamming(queries[asked], self.rows[row])
            if len(near := asked[d <= radius]):
                yield row, near
            for distance, child in edges:
                if len(go := asked[np.abs(d - distance) <= radius]):
                    todo.append((child, go))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of a (n, words) and the row b, or of rows pairwise."""
    d = np.bitwise_count(a ^ b)
    return d[:, 0].astype(np.int64) if d.shape[1] == 1 else d.sum(axis=1, dtype=np.int64)


def connect(rows: np.ndarray, part: np.ndarray, left: int, right: int, radius: int) -> np.ndarray:
    """For each row the first row of its connected set, from the links between parts left and right (or within one)."""
    label = np.arange(len(rows))

    def joined(members: np.ndarray) -> None:
        of = label[members]
        if (of != of[0]).any():
            of = np.unique(of)
            label[np.isin(label, of)] = of[0]

    # The root's ball comes first: in a bucket of one dense group that is all.
    label[hamming(rows, rows[0]) <= radius] = 0
    if not label.any():
        return label
    trees, queries = np.flatnonzero(part == left), np.flatnonzero(part == right)
    for row, near in BKTree(rows[trees]).search(rows[queries], radius):
        joined(np.append(queries[near], trees[row]))
    return label


def _stars(n_words: int, radius: int):
    """Batches of (table, key, left, right, part, f0, ...), sorted by the first four, -> (a0, ..., b0, ...) star edges."""
    names = [f"{s}{i}" for s in "ab" for i in range(n_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                got = np.stack([np.asarray(c) for c in b.columns], axis=1).astype(np.int64)
                held = got if held is None else np.concatenate([held, got])
            if held is None or not len(held):
                continue
            ends = np.append(np.flatnonzero((held[1:, :4] != held[:-1, :4]).any(axis=1)) + 1, len(held))
            whole = ends if b is None else ends[:-1]  # the last group may go on in the next batch
            starts = np.concatenate(([0], whole[:-1])) if len(whole) else whole
            size, out = whole - starts, []
            for s, e in zip(starts[(many := size > 1)].tolist(), whole[many].tolist(), strict=True):
                group = held[s:e][np.lexsort(held[s:e, 5:].T)]  # by value: the stars of different tables share their centres
                first = connect(np.ascontiguousarray(group[:, 5:]).view(np.uint64), group[:, 4], int(group[0, 2]), int(group[0, 3]), radius)
                if len(linked := np.flatnonzero(first != np.arange(e - s))):
                    out.append(np.concatenate([group[:, 5:][linked], group[:, 5:][first[linked]]], axis=1))
            held = held[whole[-1] :] if len(whole) else held
            if out:
                edges = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, i])) for i in range(2 * n_words)], names=names)

    return run


def exact_masks(radius: int, n: int) -> list[list[int]]:
    """Masks such that any two 64-bit fingerprints within the radius agree under one; narrower ones the larger n is."""
    for agree in range(1, 5):
        blocks = radius + agree
        if agree == 4 or n / 2 ** (64 * agree / blocks) <= 256:
            break
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [[sum(block[i] for i in chosen)] for chosen in itertools.combinations(range(blocks), agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, masks: Sequence[Sequence[int]], radius: int, shard: int = SHARD) -> DataFrame:
    """Star edges (a0, ..., b0, ...) between fingerprints (f0, ..., distinct) within the radius that share a bucket."""
    f = [c for c in nodes.columns if c.startswith("f") and c[1:].isdigit()]
    spark = nodes.sparkSession
    keyed = F.array(*[F.struct(F.lit(t).cast("bigint").alias("table"), F.xxhash64(*[F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(f, mask, strict=True)]).alias("key")) for t, mask in enumerate(masks)])
    rows = nodes.select(F.explode(keyed).alias("k"), *f).select("k.table", "k.key", *f)
    sizes = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard)
    large = broadcast_if_small(checkpoint(sizes.select("table", "key", F.ceil(F.col("n") / shard).alias("parts"))))
    rows = rows.join(large, ["table", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(1), *f), F.col("parts")))
    pair = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("left"), F.greatest(o, F.col("part")).alias("right")))
    rows = rows.withColumn("pair", F.explode(pair)).select("table", "key", "pair.left", "pair.right", "part", *f)
    by = ["table", "key", "left", "right"]
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    schema = ", ".join(f"{s}{i} bigint" for s in "ab" for i in range(len(f)))
    return dealt.mapInArrow(_stars(len(f), radius), schema)


def components(edges: DataFrame) -> DataFrame:
    """node, label: for each end of an edge (a, b; any one orderable type) the least node that it reaches.

    Each round takes the least label of the neighbours and then the label of that label, so long chains halve.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpoint(both)
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("of"), F.col("label").alias("far"))
        after = low.join(jump, F.col("label") == F.col("of"), "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label"))
        after = checkpoint(after)
        changed = after.where("label < was").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels


def cluster(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, radius: int = 4, n_words: int = 1, masks: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """key (doc_id, tag), f0, ..., component_id (smallest doc_id reachable) and component_tag: one row per row of docs.

    Fingerprints link at radius or fewer differing bits; masks (default: exact ones, of one word) decide where links are looked for.
    Null and empty texts have fingerprint zero and link like any other; repeated rows are repeated; a null doc_id is never a
    component_id unless its whole component has no other; other columns of docs are ignored; an empty table gives an empty result.
    """
    f = [f"f{i}" for i in range(n_words)]
    named = docs.select(F.struct(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tag")).alias("key"), F.col(f"`{text}`").alias("text"))
    prints = checkpoint(fingerprints(named.select("key.doc_id", "key.tag", "text"), "text", shingle, n_words))
    # Nulls order last: the least key of a component is its smallest id.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    nodes = checkpoint(prints.groupBy(*f).agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")))
    if masks is None:
        masks = exact_masks(radius, nodes.count())
    found = links(nodes, masks, radius)
    n = len(f)
    edges = found.select(F.struct(*[F.col(f"a{i}").alias(f"f{i}") for i in range(n)]).alias("a"), F.struct(*[F.col(f"b{i}").alias(f"f{i}") for i in range(n)]).alias("b"))
    # A fingerprint has a star per table and pair of shards at most. All of these are one set: hang them on its least member, so that
    # the stars of a group of very many near copies become one edge each before the rounds.
    own = edges.groupBy("a").agg(F.collect_set("b").alias("b")).select(F.array_union("b", F.array("a")).alias("set"))
    labels = components(own.select(F.explode("set").alias("a"), F.array_min("set").alias("b")))
    named_nodes = nodes.select(F.struct(*f).alias("node"), "least", "n")
    inside = labels.join(named_nodes, "node")
    least = inside.groupBy("label").agg(F.min("least").alias("first"))
    firsts = inside.join(least, "label").select("node", "first")
    of = named_nodes.join(firsts, "node", "left").select("node", "n", F.coalesce("first", "least").alias("first"))
    of, rows = checkpoint(of), prints.withColumn("node", F.struct(*f))
    hot = broadcast_if_small(of.where(F.col("n") >= HOT).select("node", "first"))
    rows = rows.join(hot, "node").unionByName(rows.join(hot, "node", "left_anti").join(of.where(F.col("n") < HOT).select("node", "first"), "node"))
    return rows.select(F.struct("doc_id", "tag").alias("key"), *f, F.col("first.doc_id").alias("component_id"), F.col("first.tag").alias("component_tag"))


def min_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of a set of shingle hashes: two sets agree on one with a probability of their Jaccard similarity ** ROWS."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 1 << 12):
        least = np.minimum(least, ((shingles[a : a + (1 << 12)] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    bands, key = least.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) ^ bands[:, r])
    return key.view(np.int64)


def _signatures(named: DataFrame, shingle: int) -> DataFrame:
    """key, s (a hash of the set of shingles), size, f (its fingerprint) and keys of rows (key, text); an empty set has no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary())
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in texts]
            s = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            keys = [min_keys(x) if len(x) else np.empty(0, np.int64) for x in sets]
            prints = [print_of(x, WORDS) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["key", "s", "size", "f", "keys"])

    return named.mapInArrow(run, f"key {named.schema['key'].dataType.simpleString()}, s bigint, size bigint, f array<bigint>, keys array<bigint>")


def _sets(named: DataFrame, shingle: int) -> DataFrame:
    """s and set, the shingle hashes, of rows (s, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary())
            for a in range(0, len(b), 200):
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in texts[a : a + 200]]
                yield pa.RecordBatch.from_arrays([b.column(0)[a : a + 200], pa.array(sets, pa.list_(pa.int64()))], names=["s", "set"])

    return named.select("s", "text").mapInArrow(run, "s bigint, set array<bigint>")


class _Bucket:
    """Sets that share a key: s, size, label and part of each, all its keys, its fingerprint, and the set itself."""

    def __init__(self, columns: list[pa.Array]):
        self.s, self.size, self.label, self.part = (np.array(c) for c in columns[:4])
        self.keys = np.asarray(columns[4].flatten()).reshape(len(self.s), -1)
        self.prints = np.asarray(columns[5].flatten()).view(np.uint64).reshape(len(self.s), -1)
        self.sets, ends = np.asarray(columns[6].flatten()).view(np.uint64), np.asarray(columns[6].value_lengths()).cumsum()
        self.start, self.end = np.append(0, ends[:-1]), ends

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many shingles the set i has in common with each of the others."""
        own, size = self.sets[self.start[i] : self.end[i]], self.size[others]
        flat = self.sets[np.repeat(self.start[others] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        return np.bincount(np.repeat(np.arange(len(others)), size), own[at] == flat, len(others))

    def near(self, left: int, right: int) -> Iterator[tuple[int, np.ndarray]]:
        """Rows of the right part with those of the left one within RADIUS, as a BK-tree over the left fingerprints finds them; each pair once.

        Equal fingerprints are one node. First a single row asks, then more and more together, as the first ones often connect all.
        """
        trees, queries = np.flatnonzero(self.part == left), np.flatnonzero(self.part == right)
        nodes, node = np.unique(self.prints[trees], axis=0, return_inverse=True)
        order = np.argsort(node.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(node.ravel(), minlength=len(nodes)))
        tree, at, step = BKTree(nodes), 0, 1
        while at < len(queries):
            asked, rows = queries[at : at + step], [[] for _ in queries[at : at + step]]
            for n, who in tree.search(self.prints[asked], RADIUS):
                found = trees[order[ends[n - 1] if n else 0 : ends[n]]]
                for q in who.tolist():
                    rows[q].append(found)
            for i, found in zip(asked.tolist(), rows, strict=True):
                if found:
                    found = np.concatenate(found)
                    yield i, found[found > i] if left == right else found
            at, step = at + step, max(1, min(2 * step, 256, 2_000_000 // max(len(trees), 1)))

    def links(self, key: int, left: int, right: int, similarity: float) -> Iterator[tuple[int, int]]:
        """Links that connect the labels of the bucket's parts, each pair being tested under its first common key only."""
        for i, near in self.near(left, right):
            for a in range(0, len(near), 512):
                some = near[a : a + 512]
                fit = np.minimum(self.size[some], self.size[i]) >= similarity * np.maximum(self.size[some], self.size[i]) - SLACK
                some = some[fit & (self.label[some] != self.label[i])]
                some = some[self.keys[i][(self.keys[some] == self.keys[i]).argmax(axis=1)] == key]
                need = (self.size[some] + self.size[i]) * (similarity / (1 + similarity)) - SLACK
                for j in some[self.shared(i, some) >= need].tolist() if len(some) else []:
                    if self.label[i] != self.label[j]:
                        yield int(self.s[i]), int(self.s[j])
                        self.label[self.label == self.label[j]] = self.label[i]
            if (self.label == self.label[0]).all():
                return


def _linked(similarity: float):
    """Batches of (key, left, right, s, size, label, part, keys, f, set), sorted by the first three, -> links (a, b) of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the bucket that may go on in the next batch
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            if sum(map(len, held)) > 1:
                table = pa.Table.from_batches(held).combine_chunks()
                found = list(_Bucket([c.chunk(0) for c in table.columns[3:]]).links(*at, similarity))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
            held.clear()

        for b in batches:
            by = np.stack([np.asarray(c) for c in b.columns[:3]], axis=1)
            cuts = [0, *(np.flatnonzero((by[1:] != by[:-1]).any(axis=1)) + 1).tolist(), len(b)]
            for s, e in itertools.pairwise(cuts):
                if s < e:
                    if at != (now := tuple(by[s].tolist())):
                        yield from close()
                        at = now
                    held.append(b.slice(s, e - s))
        yield from close()

    return run


def _bucket_links(rows: DataFrame, sets: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all similar sets of rows (key, s, size, label) that share a key: found by BK-trees, counted exactly.

    A bucket of more than PART shingles is cut into parts, and every pair of parts is a task of its own.
    """
    # Of keys that the same sets share one is enough: the one of the first band, where each pair's first common key is not missed.
    members = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("s")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "s")).alias("y"), F.min("band").alias("band"))
    kept = members.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("k")).select("k.key")
    rows = checkpoint(rows.join(broadcast_if_small(checkpoint(kept)), "key", "left_semi"))
    sizes = rows.groupBy("key").agg(F.ceil(F.sum("size") / PART).alias("parts")).where("parts > 1")
    rows = rows.select("key", "s", "size", "label").join(broadcast_if_small(checkpoint(sizes)), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")))
    pair = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("left"), F.greatest(o, F.col("part")).alias("right")))
    rows = rows.withColumn("pair", F.explode(pair)).join(_sets_of(sets, rows), "s").join(nodes.select("s", "keys", "f"), "s").select("key", "pair.left", "pair.right", "s", "size", "label", "part", "keys", "f", "set")
    by = ["key", "left", "right"]
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    return checkpoint(dealt.mapInArrow(_linked(similarity), "a bigint, b bigint").distinct())


def _sets_of(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets that wanted (s) names, so that no others are dealt."""
    return sets.join(broadcast_if_small(checkpoint(wanted.select("s").distinct())), "s", "left_semi")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have this Jaccard similarity or more, counted exactly."""
    left, right = (_sets_of(sets, pairs.select(F.col(c).alias("s"))).select(F.col("s").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    need = (F.size("set_a") + F.size("set_b")) * (similarity / (1 + similarity)) - SLACK
    return checkpoint(pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("set_a", "set_b")) >= need).select("a", "b"))


def _label(rows: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """Rows (key, band, s, size) with their component as label: those that meet another component's of fitting size under their key."""
    labels = components(linked)
    rows = rows.select("key", "band", "s", "size").join(labels.select(F.col("node").alias("s"), "label"), "s", "left").withColumn("label", F.coalesce("label", "s"))
    scale = 1e9  # of the sizes' logarithms, as a range takes whole numbers
    reach = int(-np.log(similarity) * scale) + 4
    here = Window.partitionBy("key").orderBy(F.floor(F.log("size") * scale).cast("bigint")).rangeBetween(-reach, reach)
    return checkpoint(rows.withColumn("low", F.min("label").over(here)).withColumn("high", F.max("label").over(here)).where("low < high").drop("low", "high"))


def _centre_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Each s of rows (key, s, size, f, label) with the least centre of its keys within RADIUS; a key's centre is the first row of its least label."""
    met = rows.withColumn("c", F.min(F.struct("label", "s", "size", "f")).over(Window.partitionBy("key")))
    met = met.where(sum(F.bit_count(F.get("f", F.lit(i)).bitwiseXOR(F.get("c.f", F.lit(i)))) for i in range(WORDS)) <= RADIUS)
    met = met.where((F.col("label") != F.col("c.label")) & (F.least("size", "c.size") >= similarity * F.greatest("size", "c.size") - SLACK))
    return met.groupBy(F.col("s").alias("b")).agg(F.min("c.s").alias("a"))


def similar_sets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """s, doc_id, tag and first: every set of shingles, its first document, and the first document (doc_id, tag) of its component.

    Links are pairs of shingle sets whose fingerprints lie within RADIUS and whose Jaccard similarity, counted exactly, is ``similarity``
    or more; a radius of 88 is meant for 0.8 and above. They are looked for among the sets that share a band of ROWS least hashes; a pair at 0.8 shares none of
    BANDS with a probability of (1 - 0.8 ** ROWS) ** BANDS, three in a million. First each set is tested against one centre of its keys, so that a large group is
    joined at the cost of its size; then the sets of a key that are still in different components meet in a bucket's BK-tree, those of the FIRST bands before
    the others, so that what these connect is not tested again. Null and empty texts have the empty set.
    """
    named = docs.select(F.struct(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tag")).alias("key"), F.col(f"`{text}`").alias("text"))
    prints = checkpoint(_signatures(named, shingle))
    order = F.struct(F.col("key.doc_id").isNull().alias("none"), F.col("key.doc_id").alias("doc_id"), F.col("key.tag").alias("tag"))
    nodes = checkpoint(prints.groupBy("s").agg(F.min(order).alias("least"), F.first("size").alias("size"), F.first("f").alias("f"), F.first("keys").alias("keys")))
    rows = nodes.select(F.posexplode("keys").alias("band", "key"), "s", "size", "f").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    rows = checkpoint(rows.where("n > 1").select("key", "band", "s", "size", "f", F.col("s").alias("label")))
    # Only sets that share a key are needed whole, each from its first document.
    wanted = nodes.join(rows.select("s").distinct(), "s", "left_semi").select("s", F.col("least.doc_id").alias("first_id"), F.col("least.tag").alias("first_tag"))
    wanted = broadcast_if_small(checkpoint(wanted))
    texts = named.join(wanted, F.col("key.doc_id").eqNullSafe(F.col("first_id")) & (F.col("key.tag") == F.col("first_tag"))).select("s", "text")
    sets = checkpoint(_sets(texts, shingle).dropDuplicates(["s"]))
    linked = _similar(_centre_pairs(rows, similarity), sets, similarity)
    left = _label(rows, linked, similarity)
    for bands in (FIRST, BANDS):
        linked = linked.unionByName(_bucket_links(left.where(F.col("band") < bands), sets, nodes, similarity))
        left = _label(left, linked, similarity) if bands < BANDS else left
    labels = components(linked)
    of = nodes.select("s", "least").join(labels.select(F.col("node").alias("s"), "label"), "s", "left").select("s", "least", F.coalesce("label", "s").alias("label"))
    firsts = of.groupBy("label").agg(F.min("least").alias("first"))
    return of.join(firsts, "label").select("s", F.col("least.doc_id").alias("doc_id"), F.col("least.tag").alias("tag"), F.struct("first.doc_id", "first.tag").alias("first"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that stay: of each component of similar_sets() the document of the smallest id; of equal rows, one."""
    stay = similar_sets(docs, text, doc_id, **how).select(F.col("first").alias("key")).distinct()
    key = F.struct(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tag"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    return meet(rows, stay, "left_semi").dropDuplicates(["key"]).select("row.*")
