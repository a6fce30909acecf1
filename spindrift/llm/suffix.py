"""Removal of repeated byte strings by suffix arrays (operator 6).

Every ``WIDTH``-byte string is routed by an anchor: of its 32-byte grams, the one with the least hash. Equal strings have equal
anchors at the same place, so an anchor's bucket holds all copies of its strings. Neighbouring strings of a text mostly share
their anchor and travel as one segment, one row for some 35 bytes, without the bytes: (anchor, hash of the segment, document, place).

1. Equal segments: all but the first are repeats throughout. A task keeps the first of those it sees itself and marks the others, so
   that a passage in a third of all documents reaches its bucket as one row per task.
2. Different segments with one anchor may share strings in part. Only their bytes are fetched, and each bucket is cut into shards:
   a suffix array (Larsson-Sadakane refinement: ranks by 8 bytes, doubled for the groups that still tie) and Kasai's common prefixes
   give the strings that occur twice in a shard; the first strings of each shard are found in the sorted ones of the bucket's other
   shards by binary search.
3. A bucket of more than ``LARGE`` different segments (a short line in very many contexts) is dealt once more, string by string, of
   which a task sends equal ones only once for each stretch that it holds.

Documents are ordered by id; rows that share id and text are one document, and the marks meet the texts in one shuffle of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

WIDTH, GRAM = 100, 32
#: Segments that a task sorts at once before they are dealt; segments to a bucket beyond which it is dealt string by string.
HELD, LARGE = 400_000, 2048
#: Bytes to a suffix array.
SHARD = 1 << 18
#: Stands for a null id, which orders last; longest stretch that is hashed at once.
LAST, STRETCH = (1 << 63) - 1, 1 << 23


def _u64(b: np.ndarray) -> np.ndarray:
    """For every place of b the eight bytes from it on, as a little-endian number; zeros follow the end."""
    pad = np.concatenate((b, np.zeros(16, np.uint8)))
    out = np.empty(len(b), np.uint64)
    for r in range(min(8, len(b))):
        part = out[r::8]
        part[:] = pad[r : r + 8 * len(part)].view("<u8")
    return out


_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def anchors(b: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, first string, end of strings, place: the strings that start in [first, end) have the gram at place as their anchor.

    The anchor of a string is the leftmost of its grams whose hash is least in its upper 40 bits; b is at most STRETCH strings.
    """
    u, n = _u64(b), len(b) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for i, m in enumerate(_MULTIPLIERS):
        h ^= u[8 * i : 8 * i + n] * m
        h ^= h >> np.uint64(29)
        h *= _MULTIPLIERS[(i + 1) % 4]
    h ^= h >> np.uint64(32)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    span, grams, strings = 1, width - GRAM + 1, len(b) - width + 1
    while span * 2 <= grams:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    low = np.minimum(low[:strings], low[grams - span : grams - span + strings])
    place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate(([0], cut))
    return h[place[first]], first, np.concatenate((cut, [strings])), place[first]


#: Columns of a row on its way to its bucket; place packs the first string, the number of strings (7 bits) and the anchor's distance (7).
SEGMENT = "anchor bigint, content bigint, doc bigint, tag bigint, place bigint"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tag, text) -> segments, equal ones of the same task once, and marks (content 0): of which all strings are repeats."""
    held: list[np.ndarray] = []
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        held.clear()
        rows = rows[np.lexsort((rows[:, 4], rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        again = np.append(False, (rows[1:, :2] == rows[:-1, :2]).all(axis=1))
        firsts = np.flatnonzero(~again)
        first = rows[firsts[np.cumsum(~again) - 1]]
        itself = (rows[:, 2:] == first[:, 2:]).all(axis=1)
        yield _batch(rows[~again], SEGMENT)
        if len(marks := rows[again & ~itself]):
            doc, tag, start, end = _merged(marks[:, 2], marks[:, 3], marks[:, 4] >> 14, (marks[:, 4] >> 14) + (marks[:, 4] >> 7 & 127) + WIDTH - 1)
            spread = _scatter(doc ^ tag ^ start)
            yield _batch(np.stack([spread, np.zeros_like(doc), doc, tag, start << 31 | (end - start)], axis=1), SEGMENT)

    for b in batches:
        docs, tags, texts = np.asarray(b.column(0)), np.asarray(b.column(1)), _binary(b.column(2))
        for doc, tag, t in zip(docs.tolist(), tags.tolist(), texts, strict=True):
            raw = t.as_py() or b""
            for at in range(0, max(len(raw) - WIDTH + 1, 0), STRETCH):
                piece = raw[at : at + STRETCH + WIDTH - 1]
                h, first, end, place = anchors(np.frombuffer(piece, np.uint8))
                content = np.array([xxhash.xxh3_64_intdigest(piece[s:e]) | 1 for s, e in zip(first.tolist(), (end + WIDTH - 1).tolist(), strict=True)], np.uint64)
                rows = np.empty((len(h), 5), np.int64)
                rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = h.view(np.int64), content.view(np.int64), doc, tag
                rows[:, 4] = (first + at) << 14 | (end - first) << 7 | (place - first)
                held.append(rows)
                n += len(rows)
            if n >= HELD:
                yield from flush()
                n = 0
    if held:
        yield from flush()


def _scatter(x: np.ndarray) -> np.ndarray:
    return (x.view(np.uint64) * _MULTIPLIERS[0]).view(np.int64)


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def _batch(rows: np.ndarray, schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(names))], names=names)


def _merged(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Byte ranges, those of a document that touch or overlap made one."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))
    # The furthest end so far within a document: documents are told apart by an offset larger than any place.
    group = np.cumsum(new)
    reach = np.maximum.accumulate(end + (group << 40)) - (group << 40)
    apart = new | np.append(True, start[1:] > reach[:-1])
    last = np.append(np.flatnonzero(apart)[1:], len(doc)) - 1
    return doc[apart], tag[apart], start[apart], reach[last]


#: Ranges to remove (kind 0: start, end) and segments whose bytes are wanted (kind 1, or 2 from a large bucket: place as packed).
MARK = "doc bigint, tag bigint, kind bigint, start bigint, end bigint, anchor bigint"


def _wanted(rows: np.ndarray, kind: int) -> np.ndarray:
    out = np.zeros((len(rows), 6), np.int64)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3], out[:, 5] = rows[:, 2], rows[:, 3], kind, rows[:, 4], rows[:, 0]
    return out


class _Bucket:
    """The different segments of the bucket that may go on in the next batch: at most LARGE are held."""

    def __init__(self, out: list[np.ndarray]):
        self.out, self.anchor, self.held, self.n, self.large = out, None, [], 0, False

    def close(self) -> None:
        if self.n > 1:
            self.out.append(_wanted(np.concatenate(self.held), 1))
        self.anchor, self.held, self.n, self.large = None, [], 0, False

    def extend(self, rows: np.ndarray) -> None:
        self.anchor = int(rows[0, 0])
        if not self.large and self.n + len(rows) > LARGE:
            rows, self.held, self.n, self.large = np.concatenate([*self.held, rows]), [], 0, True
        if self.large:
            self.out.append(_wanted(rows, 2))
        else:
            self.held.append(rows)
            self.n += len(rows)


def _first_of_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by all columns -> marks."""
    out: list[np.ndarray] = []
    open_, last = _Bucket(out), None  # last: the first row of the content that may go on
    for b in batches:
        rows = np.stack([np.asarray(c) for c in b.columns], axis=1)
        if len(done := rows[rows[:, 1] == 0]):
            marks = np.zeros((len(done), 6), np.int64)
            marks[:, 0], marks[:, 1], marks[:, 3], marks[:, 4] = done[:, 2], done[:, 3], done[:, 4] >> 31, (done[:, 4] >> 31) + (done[:, 4] & 0x7FFFFFFF)
            out.append(marks)
            rows = rows[rows[:, 1] != 0]
        if len(rows):
            full = rows if last is None else np.concatenate((last[None], rows))
            new = np.append(True, (full[1:, :2] != full[:-1, :2]).any(axis=1))
            first = full[np.flatnonzero(new)[np.cumsum(new) - 1]]
            repeat = ~new & (full[:, 2:] != first[:, 2:]).any(axis=1)
            if repeat.any():
                r = full[repeat]
                doc, tag, start, end = _merged(r[:, 2], r[:, 3], r[:, 4] >> 14, (r[:, 4] >> 14) + (r[:, 4] >> 7 & 127) + WIDTH - 1)
                out.append(np.stack([doc, tag, np.zeros_like(doc), start, end, np.zeros_like(doc)], axis=1))
            fresh = full[new] if last is None else full[new][1:]
            last = first[-1]
            if len(fresh):
                starts = np.append(0, np.flatnonzero(np.diff(fresh[:, 0])) + 1)
                sizes = np.diff(np.append(starts, len(fresh)))
                if open_.anchor != fresh[0, 0]:
                    open_.close()
                open_.extend(fresh[: sizes[0]])
                if len(starts) > 1:
                    open_.close()
                    between, size = fresh[starts[1] : starts[-1]], np.repeat(sizes[1:-1], sizes[1:-1])
                    for kind, these in ((1, (size > 1) & (size <= LARGE)), (2, size > LARGE)):
                        if these.any():
                            out.append(_wanted(between[these], kind))
                    open_.extend(fresh[starts[-1] :])
        if out:
            yield _batch(np.concatenate(out), MARK)
            out.clear()
    open_.close()
    if out:
        yield _batch(np.concatenate(out), MARK)


#: A segment's bytes on their way to its bucket's shards; without bytes, a string that is known to be a repeat.
FETCHED = "bucket bigint, doc bigint, tag bigint, start bigint, bytes binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tag, text, wanted: array of (kind, place, anchor)) -> segments; string by string for kind 2.

    Of equal strings that are held together only the first goes to its bucket, so a passage in very many texts arrives as a few rows.
    """
    strings: dict[bytes, tuple[int, int, int]] = {}
    out: list[tuple[int, int, int, int, bytes | None]] = []

    def flush() -> pa.RecordBatch:
        out.extend((xxhash.xxh3_64_intdigest(string) - (1 << 63), *at, string) for string, at in strings.items())
        columns = list(zip(*out, strict=True)) or [[]] * 5
        strings.clear()
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.binary()], strict=True)], names=["bucket", "doc", "tag", "start", "bytes"])

    for b in batches:
        texts = _binary(b.column(2))
        for i, (doc, tag) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            text = texts[i].as_py()
            for w in b.column(3)[i].as_py():
                first, n = w["place"] >> 14, w["place"] >> 7 & 127
                if w["kind"] == 1:
                    out.append((w["anchor"], doc, tag, first, text[first : first + n + WIDTH - 1]))
                    continue
                for s in range(first, first + n):
                    string, at = text[s : s + WIDTH], (doc, tag, s)
                    if (before := strings.setdefault(string, at)) != at:
                        strings[string] = min(before, at)
                        out.append((xxhash.xxh3_64_intdigest(b"%d %d" % (doc, s)) - (1 << 63), *max(before, at), None))
            if len(out) >= 20_000 or len(strings) >= HELD // 4:
                yield flush()
    yield flush()


def suffix_array(b: np.ndarray) -> np.ndarray:
    """Places of b by the order of what follows them, by Larsson-Sadakane refinement.

    Ranks by the first eight bytes come from one sort; then the groups that still tie are sorted by the rank that many places on,
    and the reach doubles. The end orders before any byte.
    """
    n = len(b)
    if n == 0:
        return np.empty(0, np.int64)
    # Eight bytes as a big-endian number; near the end, shorter texts order first by their length.
    key = _u64(b).byteswap()
    sa = np.lexsort((np.minimum(n - np.arange(n), 8), key))
    short = np.minimum(n - sa, 8)
    new = np.append(True, (key[sa][1:] != key[sa][:-1]) | (short[1:] != short[:-1]))
    rank, reach = np.empty(n + 1, np.int64), 8
    rank[n] = -1
    starts = np.flatnonzero(new)
    rank[sa] = starts[np.cumsum(new) - 1]
    while True:
        ends = np.append(np.flatnonzero(new)[1:], n)
        alone = np.repeat(ends - np.flatnonzero(new) == 1, ends - np.flatnonzero(new))
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return sa
        sub = sa[tied]
        group, further = rank[sub], rank[np.minimum(sub + reach, n)]
        order = np.lexsort((further, group))
        sub, group, further = sub[order], group[order], further[order]
        sa[tied] = sub
        new[tied] = np.append(True, (group[1:] != group[:-1]) | (further[1:] != further[:-1]))
        starts = np.flatnonzero(new)
        rank[sa[tied]] = starts[np.searchsorted(starts, tied, "right") - 1]
        reach *= 2


def common_prefixes(b: np.ndarray, sa: np.ndarray, pieces: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """For each place in the order of sa the bytes it has in common with the one before, at most ``most``.

    Kasai's rule (what follows the next byte has at most one less in common) along each piece, all pieces side by side; pieces: the
    places at which b may be cut into stretches of no great length.
    """
    n = len(b)
    at = np.empty(n, np.int64)
    at[sa] = np.arange(n)
    lcp, u = np.zeros(n, np.int64), _u64(b)
    ends = np.append(pieces[1:], n)
    place, h = pieces.copy(), np.zeros(len(pieces), np.int64)
    while len(place):
        r = at[place]
        i = np.flatnonzero(r > 0)
        h[r == 0] = 0
        before = sa[np.maximum(r - 1, 0)]
        while len(i):  # eight bytes a step
            x, y = place[i] + h[i], before[i] + h[i]
            room = np.minimum(n - np.maximum(x, y), most - h[i])
            differ = u[np.minimum(x, n - 1)] ^ u[np.minimum(y, n - 1)]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
            step = np.clip(np.minimum(same, room), 0, 8)
            h[i] += step
            i = i[(step == 8) & (room > 8)]
        lcp[r] = h
        place, h = place + 1, np.maximum(h - 1, 0)
        go = place < ends
        place, h, ends = place[go], h[go], ends[go]
    return lcp


class _Shard:
    """Some segments of a bucket, or of several whole buckets: which of their strings occur before."""

    def __init__(self, rows: list[tuple[int, int, int, int, bytes]]):
        sizes = np.array([len(r[4]) for r in rows])
        begin = np.cumsum(sizes) - sizes
        self.b = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        strings = sizes - WIDTH + 1
        self.segment = np.repeat(np.arange(len(rows)), strings)
        within = np.arange(len(self.segment)) - np.repeat(np.cumsum(strings) - strings, strings)
        self.place = begin[self.segment] + within  # of each string in b
        head = np.array([r[:4] for r in rows], np.int64)
        self.bucket, self.doc, self.tag = (head[self.segment, i] for i in range(3))
        self.start = head[self.segment, 3] + within
        self.repeat = np.zeros(len(self.segment), bool)
        sa = suffix_array(self.b)
        lcp = common_prefixes(self.b, sa, begin)
        string_at = np.full(len(self.b), -1, np.int64)
        string_at[self.place] = np.arange(len(self.place))
        group = np.cumsum(lcp < WIDTH)
        mine = string_at[sa]
        self.order, group = mine[mine >= 0], group[mine >= 0]  # strings by their bytes, equal ones share a group
        by = np.lexsort((self.start[self.order], self.tag[self.order], self.doc[self.order], group))
        ordered, g = self.order[by], group[by]
        first = np.append(True, g[1:] != g[:-1])
        self.firsts = ordered[first]  # of each group, by their bytes
        self.repeat[ordered[~first]] = True

    def keys(self, strings: np.ndarray) -> np.ndarray:
        """The bytes of strings as rows of big-endian numbers."""
        u = _u64(self.b)
        k = np.stack([u[np.minimum(self.place[strings] + 8 * i, len(u) - 1)].byteswap() for i in range(-(-WIDTH // 8))], axis=1)
        if rest := WIDTH % 8:
            k[:, -1] &= ~np.uint64((1 << 8 * (8 - rest)) - 1)
        return k

    def merge(self, other: _Shard) -> None:
        """Strings that are first in both shards: the later one is a repeat. Binary search of one's in the other's."""
        mine, theirs = self.keys(self.firsts), other.keys(other.firsts)
        low, high = np.zeros(len(theirs), np.int64), np.full(len(theirs), len(mine), np.int64)
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high) // 2, 0)
            differ = mine[mid] != theirs
            col = differ.argmax(axis=1)
            less = differ.any(axis=1) & (mine[mid, col] < theirs[np.arange(len(theirs)), col])
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        at = np.minimum(low, len(mine) - 1)
        hit = np.flatnonzero((low < len(mine)) & (mine[at] == theirs).all(axis=1))
        a, b = self.firsts[at[hit]], other.firsts[hit]
        key = lambda s, x: (s.doc[x], s.tag[x], s.start[x])
        earlier = np.zeros(len(hit), bool)
        tie = np.ones(len(hit), bool)
        for x, y in zip(key(self, a), key(other, b), strict=True):
            earlier |= tie & (x < y)
            tie &= x == y
        other.repeat[b[earlier & ~tie]] = True
        self.repeat[a[~earlier & ~tie]] = True


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by bucket -> ranges to remove. Whole buckets share a shard until it is full; a large one takes several."""
    small: list[tuple[int, int, int, int, bytes]] = []
    size = 0

    def ranges(shards: list[_Shard]) -> Iterator[pa.RecordBatch]:
        for i, s in enumerate(shards):
            for t in shards[i + 1 :]:
                s.merge(t)
        for s in shards:
            if (r := s.repeat).any():
                yield _batch(np.stack(_merged(s.doc[r], s.tag[r], s.start[r], s.start[r] + WIDTH), axis=1), "doc bigint, tag bigint, start bigint, end bigint")

    def cut(bucket: list[tuple[int, int, int, int, bytes]]) -> Iterator[list]:
        part, n = [], 0
        for r in bucket:
            if n + len(r[4]) > SHARD and part:
                yield part
                part, n = [], 0
            part.append(r)
            n += len(r[4])
        yield part

    def rows() -> Iterator[tuple[int, int, int, int, bytes]]:
        for b in batches:
            known = pc.is_null(b.column(4))
            if pc.any(known).as_py():  # repeats that need no shard
                doc, tag, start = (np.asarray(c) for c in b.filter(known).columns[1:4])
                found.append(_batch(np.stack(_merged(doc, tag, start, start + WIDTH), axis=1), "doc bigint, tag bigint, start bigint, end bigint"))
                b = b.filter(pc.invert(known))
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    found: list[pa.RecordBatch] = []
    bucket: list[tuple[int, int, int, int, bytes]] = []
    for r in rows():
        while found:
            yield found.pop()
        if bucket and r[0] != bucket[0][0]:
            n = sum(len(x[4]) for x in bucket)
            if n > SHARD:
                yield from ranges([_Shard(p) for p in cut(bucket)])
            elif len(bucket) > 1:
                if size + n > SHARD and small:
                    yield from ranges([_Shard(small)])
                    small, size = [], 0
                small += bucket
                size += n
            bucket = []
        bucket.append(r)
    yield from found
    if sum(len(x[4]) for x in bucket) > SHARD:
        yield from ranges([_Shard(p) for p in cut(bucket)])
    elif len(bucket) > 1:
        small += bucket
    if small:
        yield from ranges([_Shard(small)])


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): doc, tag, text of docs, and per (doc, tag) the byte ranges to remove, an array of (start, end).

    doc is the id (an integer; null orders last), tag a hash of the text. Ranges may overlap.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("tag"), F.col(f"`{text}`").alias("text"))
    segments = read.mapInArrow(_segments, SEGMENT).repartition(parts, "anchor").sortWithinPartitions("anchor", "content", "doc", "tag", "place")
    marks = checkpoint(segments.mapInArrow(_first_of_bucket, MARK))
    texts = read.repartition(parts, "doc", "tag")
    wanted = marks.where("kind > 0").groupBy("doc", "tag").agg(F.collect_list(F.struct("kind", F.col("start").alias("place"), "anchor")).alias("wanted"))
    # One row per document: rows that repeat id and text would bring each string twice.
    fetched = texts.join(wanted, ["doc", "tag"]).dropDuplicates(["doc", "tag"]).select("doc", "tag", "text", "wanted").mapInArrow(_fetch, FETCHED)
    found = fetched.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_shards, "doc bigint, tag bigint, start bigint, end bigint")
    ranges = marks.where("kind = 0").select("doc", "tag", "start", "end").unionByName(found)
    return texts, ranges.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes): one row per row of docs.

    A byte goes if a WIDTH-byte string that covers it also starts earlier: in a document of smaller id (of equal ids, of smaller text
    hash), or further ahead in the same one. Null texts are empty; shorter texts stay whole; null ids order last; rows that share
    id and text are one document and are treated alike; other columns are ignored; an empty table gives an empty result.
    """
    texts, ranges = repeats(docs, text, doc_id)
    kind = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, kept = [], []
            for t, r in zip(_binary(b.column(1)), b.column(2), strict=True):
                raw = t.as_py() or b""
                flat = r.values
                if flat is None or not len(flat):
                    start, end = (), ()
                else:
                    zero = np.zeros(len(flat), np.int64)
                    _, _, start, end = _merged(zero, zero, np.asarray(flat.field("start")), np.asarray(flat.field("end")))
                at, pieces = 0, []
                for s, e in zip(start, end, strict=True):
                    pieces.append(raw[at:s])
                    at = e
                pieces.append(raw[at:])
                left = b"".join(pieces)
                out.append((len(raw), len(raw) - len(left), len(start), hashlib.sha256(left).hexdigest()))
                kept.append(left)
            columns = list(zip(*out, strict=True)) or [[]] * 4
            arrays = [b.column(0), *[pa.array(c, k) for c, k in zip(columns, [*[pa.int64()] * 3, pa.string()], strict=True)]]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.binary())] if keep_bytes else arrays, names=[*names, "kept"] if keep_bytes else names)

    joined = texts.join(ranges, ["doc", "tag"], "left").select("doc", "text", "ranges")
    found = joined.mapInArrow(run, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_bytes else ""))
    return found.withColumnRenamed("doc", doc_id).withColumn(doc_id, F.when(F.col(doc_id) != LAST, F.col(doc_id)).cast(kind))
