"""Cropped and edited copies of images by local descriptors (operator 3).

Corners are found on a pyramid of scales: every place whose corner strength is the greatest within ``APART`` pixels, so their number
grows with the picture's area and a crop has the corners that the whole picture has there. Around each, binary intensity tests are
turned by the corner's own orientation (the direction of the patch's centre of mass) and give 256 bits, which survive crops, overlays,
quarter turns and changes of brightness. Descriptors meet through Hamming tables: fixed samples of bits, joined on equal values. Two
images are linked if enough of the corners they share agree on one similarity transform (scale, turn, shift).

Images of equal bytes are one image from the start. In a table's bucket all pairs of corners are compared; a bucket of more than
``SHARD`` corners is cut into shards, and every pair of shards is a task of its own. Links are counted, so the work on a group of edited
copies grows with the square of its size.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint
from .simhash import components

#: Pixels within which a corner is the strongest, levels of the pyramid, tests, tables and bits to a table.
APART, LEVELS, TESTS, TABLES, BITS = 5, 2, 256, 6, 32
WORDS = TESTS // 64
#: Largest distance of matching descriptors, corners that must agree, tolerance in pixels.
RADIUS, AGREE, TOLERANCE = 24, 5, 3.0
#: Corners of a bucket to a task, pairs compared at once.
SHARD, BLOCK = 1024, 1 << 18
#: Pixels that a corner keeps from the edge; rows of a picture that are held at once, and rows more to either side.
REACH, STRIP, MARGIN = 14, 512, 24

#: Magic number, width, height and maximum of a picture, comments between them.
_HEAD = re.compile(rb"P([56])" + rb"(?:\s|#[^\n]*\n)+(\d{1,9})" * 3 + rb"\s")
_rng = np.random.default_rng(11)
_PAIRS = np.clip(_rng.normal(0, 7.0, (TESTS, 2, 2)), -11, 11)
_TABLES = np.stack([_rng.choice(TESTS, BITS, replace=False) for _ in range(TABLES)])
#: The bits of each table, as words.
_MASKS = np.array([[sum(1 << int(b % 64) for b in t if b // 64 == w) for w in range(WORDS)] for t in _TABLES], np.uint64)
_DISC = np.array([(y, x) for y in range(-6, 7) for x in range(-6, 7) if x * x + y * y <= 36])


def decode(raw: bytes | None) -> np.ndarray | None:
    """A grey image (rows, columns) of binary netpbm bytes of 8 bits (P5, or P6 by its mean), 0 to 255; None if they are none."""
    head = _HEAD.match(raw or b"")
    if not head:
        return None
    w, h, most = (int(x) for x in head.groups()[1:])
    bands, n = (1 if head[1] == b"5" else 3), len(raw) - head.end()
    if not (0 < w <= n and 0 < h <= n and 0 < most < 256 and w * h * bands <= n):
        return None
    data = np.frombuffer(raw, np.uint8, w * h * bands, head.end()).reshape(h, w, bands)
    return np.minimum(data, most).mean(axis=2) * (255 / most)


def encode(grey: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2 r + 1; the edge is repeated."""
    c = np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(axis=0).cumsum(axis=1)
    n = 2 * r + 1
    return c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]


def _highest(a: np.ndarray, r: int) -> np.ndarray:
    """The greatest value within r places either way, along both axes."""
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        wide, span = np.pad(a, pad, constant_values=-np.inf), 1
        cut = lambda x, i, j: x[i:j] if axis == 0 else x[:, i:j]  # noqa: B023, E731
        while span * 2 <= 2 * r + 1:
            n = wide.shape[axis]
            wide, span = np.maximum(cut(wide, 0, n - span), cut(wide, span, n)), span * 2
        more, n = 2 * r + 1 - span, a.shape[axis]
        a = np.maximum(cut(wide, 0, n), cut(wide, more, more + n))
    return a


def _strip(level: np.ndarray, top: int, height: int) -> tuple[np.ndarray, ...]:
    """x, y, angle and the words of the corners in the rows from top on of a level of so many rows; level begins MARGIN above top, if it can."""
    above = min(top, MARGIN)
    smooth = _box(level, 1) / 9
    gy, gx = np.gradient(smooth)
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    peak = (strength > 1.0) & (strength >= _highest(strength, APART))
    y, x = np.nonzero(peak)
    low, high = max(top, REACH), min(top + STRIP, height - REACH)
    ok = (x >= REACH) & (x < level.shape[1] - REACH) & (y - above + top >= low) & (y - above + top < high)
    y, x = y[ok], x[ok]
    patch = smooth[y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
    angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
    bits = np.empty((len(y), WORDS), np.int64)
    for i in range(0, len(y), 1024):
        part = slice(i, i + 1024)
        cos, sin = np.cos(angle[part])[:, None, None], np.sin(angle[part])[:, None, None]
        ty, tx = _PAIRS[None, :, :, 0], _PAIRS[None, :, :, 1]
        py = np.rint(y[part, None, None] + sin * tx + cos * ty).astype(int)
        px = np.rint(x[part, None, None] + cos * tx - sin * ty).astype(int)
        value = smooth[np.clip(py, 0, level.shape[0] - 1), np.clip(px, 0, level.shape[1] - 1)]
        bits[part] = np.packbits(value[:, :, 0] < value[:, :, 1], axis=1, bitorder="little").view("<i8")
    return x, y - above + top, angle, bits


def describe(grey: np.ndarray) -> np.ndarray:
    """Rows (x, y, scale, angle, WORDS 64-bit words as int64) of an image's corners, in a float64 array with the words in its bits."""
    found, level, scale = [], grey.astype(np.float64), 1.0
    for _ in range(LEVELS):
        h, w = level.shape
        if min(h, w) <= 2 * REACH + 2:
            break
        for top in range(0, h, STRIP):
            x, y, angle, bits = _strip(level[max(top - MARGIN, 0) : top + STRIP + MARGIN], top, h)
            found.append(np.column_stack([x * scale, y * scale, np.full(len(x), scale), angle, bits.view(np.float64)]))
        h2, w2 = h // 2 * 2, w // 2 * 2
        level, scale = level[:h2, :w2].reshape(h2 // 2, 2, w2 // 2, 2).mean(axis=(1, 3)), scale * 2
    return np.concatenate(found) if found else np.empty((0, 4 + WORDS))


BITS_OF = [f"bits{w}" for w in range(WORDS)]
CORNER = ", ".join(["image bigint, x double, y double, scale double, angle double", *(f"{b} bigint" for b in BITS_OF)])


FIELDS = [c.split()[0] for c in CORNER.split(", ")][1:]


def corners(images: DataFrame) -> DataFrame:
    """image, digest and corners (array of the FIELDS) of images (image, bytes); bytes that are no image have none.

    Of rows with equal bytes a task describes the first one; corners is null for the others.
    """
    inner = "struct<" + ",".join(c.replace(" ", ":") for c in CORNER.split(", ")[1:]) + ">"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            digests, rows, ends, known = [], [], [0], []
            for raw in b.column(1):
                data = raw.as_py() or b""
                digest = hashlib.sha256(data).digest()
                grey = None if digest in seen else decode(data)
                known.append(digest in seen)
                seen.add(digest)
                digests.append(digest)
                if grey is not None:
                    rows.append(describe(grey))
                ends.append(ends[-1] + (len(rows[-1]) if grey is not None else 0))
            r = np.concatenate(rows) if rows else np.empty((0, 4 + WORDS))
            flat = [pa.array(np.ascontiguousarray(r[:, k]).view(np.int64) if k > 3 else np.ascontiguousarray(r[:, k])) for k in range(4 + WORDS)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, names=FIELDS))
            lists = pc.if_else(pa.array(known), pa.scalar(None, lists.type), lists)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), lists], names=["image", "digest", "corners"])

    return images.select("image", "bytes").mapInArrow(run, f"image bigint, digest binary, corners array<{inner}>")


def _table_key(table: int):
    """The sampled bits of a table as one number."""
    out = F.lit(0).cast("bigint")
    for place, bit in enumerate(_TABLES[table].tolist()):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(BITS_OF[bit // 64], bit % 64).bitwiseAND(F.lit(1).cast("bigint")), place))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[np.ndarray]:
    """Runs of at least so many rows of equal first columns, as float64 with whole numbers in their bits, from sorted batches."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            rows = np.column_stack([np.asarray(c).view(np.float64) for c in b.columns])
            held = rows if held is None else np.concatenate((held, rows))
        if held is None or not len(held):
            continue
        key = np.ascontiguousarray(held[:, :keys]).view(np.int64)
        ends = np.append(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(held))
        whole = ends if b is None else ends[:-1]  # the last run may go on in the next batch
        starts = np.append(0, whole[:-1]) if len(whole) else whole
        large = whole - starts >= least
        for s, e in zip(starts[large].tolist(), whole[large].tolist(), strict=True):
            yield held[s:e]
        if len(whole):
            held = held[whole[-1] :]


MATCH = "left bigint, right bigint, lx double, ly double, ls double, la double, rx double, ry double, rs double, ra double"


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(table, key, left, right, part, image, x, y, scale, angle, bits0, ...) sorted by the first four -> MATCH rows.

    All pairs between the parts left and right (or within one) are compared. A pair is given by the first table that it shares.
    """
    out, n = [], 0
    for g in _groups(batches, 4, 2):
        table, _, first, second = np.ascontiguousarray(g[0, :4]).view(np.int64).tolist()
        part, image = (np.ascontiguousarray(g[:, k]).view(np.int64) for k in (4, 5))
        bits = np.ascontiguousarray(g[:, 10 : 10 + WORDS]).view(np.uint64)
        lows, highs = np.flatnonzero(part == first), np.flatnonzero(part == second)
        step = max(1, BLOCK // max(len(highs), 1))
        for a in range(0, len(lows), step):
            i, j = np.repeat(lows[a : a + step], len(highs)), np.tile(highs, len(lows[a : a + step]))
            if first == second:
                i, j = i[i < j], j[i < j]
            differ = bits[i] ^ bits[j]
            ok = (image[i] != image[j]) & (np.bitwise_count(differ).sum(axis=1) <= RADIUS)
            for mask in _MASKS[:table]:
                ok &= (differ & mask).any(axis=1)
            i, j = i[ok], j[ok]
            i, j = np.where(image[i] < image[j], i, j), np.where(image[i] < image[j], j, i)
            if len(i):
                out.append(np.column_stack([g[i, 5], g[j, 5], g[i, 6:10], g[j, 6:10]]))
                n += len(i)
            if n >= 20_000:
                yield _matches(np.concatenate(out))
                out, n = [], 0
    if out:
        yield _matches(np.concatenate(out))


def _matches(r: np.ndarray) -> pa.RecordBatch:
    names = [c.split()[0] for c in MATCH.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[:, k]).view(np.int64) if k < 2 else np.ascontiguousarray(r[:, k])) for k in range(10)], names=names)


def agreeing(m: np.ndarray) -> int:
    """Rows (lx, ly, ls, la, rx, ry, rs, ra) -> the most corners that one similarity transform takes to their match.

    Each match in turn gives a transform; one that half of the matches agree with is not searched beyond.
    """
    best = 0
    for lx, ly, ls, la, rx, ry, rs, ra in m:
        if best >= max(AGREE, len(m) // 2):
            break
        k, t = rs / ls, ra - la
        cos, sin = k * np.cos(t), k * np.sin(t)
        dx, dy = m[:, 0] - lx, m[:, 1] - ly
        near = np.hypot(rx + cos * dx - sin * dy - m[:, 4], ry + sin * dx + cos * dy - m[:, 5]) <= TOLERANCE * np.maximum(m[:, 6], 1)
        if near.sum() >= max(AGREE, best + 1):
            best = max(best, min(len({*zip(m[near, 0], m[near, 1], strict=True)}), len({*zip(m[near, 4], m[near, 5], strict=True)})))
    return best


def _consensus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MATCH rows sorted by (left, right) -> linked pairs and how many corners agree."""
    out = []
    for g in _groups(batches, 2, AGREE):
        if (n := agreeing(np.unique(g[:, 2:], axis=0))) >= AGREE:
            out.append((*np.ascontiguousarray(g[0, :2]).view(np.int64).tolist(), n))
        if len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["left", "right", "agree"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["left", "right", "agree"])


def copies(images: DataFrame) -> DataFrame:
    """image, class_id, n_links: one row per row of images (image: an integer id, bytes: netpbm).

    class_id is the smallest image id that links reach; n_links counts an image's verified links to different images (all rows of
    equal bytes share them). Null and unreadable bytes have no links but to equal bytes; null ids form a class of their own bytes
    only; other columns are ignored; an empty table gives an empty result.
    """
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    described = checkpoint(corners(images.select(F.col("image").cast("bigint").alias("image"), "bytes")))
    rows = described.select("image", "digest")
    same = rows.groupBy("digest").agg(F.min("image").alias("first"))
    once = described.where("corners is not null").select("digest", "corners").dropDuplicates(["digest"])
    found = once.join(same.where("first is not null"), "digest").select(F.col("first").alias("image"), F.explode("corners").alias("c")).select("image", "c.*")
    keyed = F.explode(F.array(*[F.struct(F.lit(t).cast("bigint").alias("table"), _table_key(t).alias("key")) for t in range(TABLES)]))
    names, by = [c.split()[0] for c in CORNER.split(", ")], ["table", "key", "left", "right"]
    tables = found.select(keyed.alias("k"), *names).select("k.table", "k.key", *names)
    sizes = tables.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD)
    large = broadcast_if_small(checkpoint(sizes.select("table", "key", F.ceil(F.col("n") / SHARD).alias("parts"))))
    tables = tables.join(large, ["table", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    tables = tables.withColumn("part", F.pmod(F.xxhash64("image", "x", "y", "scale"), F.col("parts")))
    pair = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("left"), F.greatest(o, F.col("part")).alias("right")))
    tables = tables.withColumn("pair", F.explode(pair)).select("table", "key", "pair.left", "pair.right", "part", *names)
    dealt = tables.repartition(parts, *by).sortWithinPartitions(*by)
    matched = dealt.mapInArrow(_match, MATCH).repartition(parts, "left", "right").sortWithinPartitions("left", "right")
    links = checkpoint(matched.mapInArrow(_consensus, "left bigint, right bigint, agree bigint"))
    labels = components(links.select(F.col("left").alias("a"), F.col("right").alias("b")))
    degree = links.select(F.explode(F.array("left", "right")).alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    classes = same.join(labels.withColumnRenamed("node", "first"), "first", "left").join(degree, "first", "left")
    classes = classes.select("digest", F.coalesce("label", "first").alias("class_id"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_links"))
    return rows.join(classes, "digest").select("image", "class_id", "n_links")


def render(table: DataFrame, size: int = 96) -> DataFrame:
    """image, bytes from (vec_id, embedding): a picture drawn from the vector; ids that are 1 modulo 5 show an edit of the picture before.

    The edits: a crop, other brightness with noise, an overlay, a quarter turn, by the id. Null vectors have null bytes.
    """
    base = table.select("vec_id", "embedding", (F.col("vec_id") - F.when(F.pmod("vec_id", F.lit(5)) == 1, 1).otherwise(0)).alias("of"))
    drawn = base.join(table.groupBy(F.col("vec_id").alias("of")).agg(F.min("embedding").alias("vector")), "of", "left").select("vec_id", "of", F.coalesce("vector", "embedding").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for i, of, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made.append(None if v is None else encode(_picture(i, of, v, size)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["image", "bytes"])

    return drawn.mapInArrow(run, "image bigint, bytes binary")


def _picture(i: int, of: int, vector: list[float], size: int, grain: float = 30.0) -> np.ndarray:
    rng = np.random.default_rng(np.frombuffer(np.asarray(vector, np.float32).tobytes(), np.uint32))
    a = np.full((size, size), rng.uniform(60, 190))
    for _ in range(45 * size * size // 96**2):
        y, x, h, w = rng.integers(0, size), rng.integers(0, size), rng.integers(6, 26), rng.integers(6, 26)
        a[y : y + h, x : x + w] = rng.uniform(0, 255)
    for r in (1, 3):  # the grain of surfaces, at two scales
        rough = _box(rng.normal(0, 1, (size, size)), r)
        a = a + rough * (grain / rough.std())
    a = _box(a, 1) / 9
    if i == of:
        return a
    kind, rng = i // 5 % 4, np.random.default_rng(i)
    if kind == 0:
        return a[8 : size - 10, 12 : size - 6]
    if kind == 1:
        return a * 0.8 + 25 + rng.normal(0, 2, a.shape)
    if kind == 2:
        a = a.copy()
        a[30:48, 20:70] = 250
        return a
    return np.rot90(a)
