"""Operators on copies: SimHash, repeated byte strings, images, and the pipeline of stages."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import media, simhash, suffix


def by_hand(text, k):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(nodes, linked):
    label = {i: i for i in nodes}
    for a in nodes:
        for b in nodes:
            if label[a] != label[b] and linked(a, b):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def texts_for_simhash():
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh", "é", "X"]) + str(rng.randrange(50)) for _ in range(rng.randrange(0, 120)))) for i in range(120)]
    for i in range(120, 260):  # near copies of a few
        w = rows[i % 7 * 9][1].split()
        if w:
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w)))
    return rows + [(300, None), (301, ""), (301, ""), (302, " \t"), (303, "one two"), (304, "ONE two"), (None, "one two")]


def test_fingerprints():
    for _, t in texts_for_simhash():
        raw = None if t is None else t.encode()
        assert simhash.fingerprint(raw, 4)[0] % 2**64 == by_hand(t, 4)
        assert simhash.fingerprint(raw, 4, 3)[0] == simhash.fingerprint(raw, 4)[0]


def test_bk_tree_finds_all():
    rng = np.random.default_rng(7)
    for words in (1, 2):
        rows = rng.integers(0, 2**63, (80, words)).astype(np.uint64)
        rows[40:] = rows[:40] ^ (np.uint64(1) << rng.integers(0, 64, (40, words)).astype(np.uint64))
        found = {(r, int(q)) for r, near in simhash.BKTree(rows).search(rows, 4) for q in near}
        assert found == {(a, b) for a in range(80) for b in range(80) if sum(bin(int(x ^ y)).count("1") for x, y in zip(rows[a], rows[b], strict=True)) <= 4}


def test_exact_masks_leave_no_pair_out():
    rng = random.Random(8)
    for n in (1, 10**7, 10**10):
        masks = [m for (m,) in simhash.exact_masks(4, n)]
        for _ in range(500):
            flipped = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flipped & m for m in masks)


@pytest.mark.parametrize(("shard", "small", "hot"), [(1024, 12, 1000), (4, 2, 2)])
def test_components_against_a_loop(spark, monkeypatch, shard, small, hot):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "HOT", hot)
    rows = texts_for_simhash()
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("f0", F.lit("clash"))
    if shard == 4:  # cut buckets: the links among them must not get lost
        monkeypatch.setattr(simhash.links, "__defaults__", (shard,))
    got = simhash.cluster(d).collect()
    prints = {i: by_hand(t, 4) for i, t in rows if i is not None}
    want = reach(list(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    assert len(got) == len(rows)
    for r in got:
        i = 303 if r.key.doc_id is None else r.key.doc_id  # the null id shares the text of 303
        assert r.f0 % 2**64 == prints[i] and r.component_id == want[i]
    assert simhash.cluster(d.where("false")).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def removed_by_hand(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def texts_for_removal():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    line = " ".join(word() for _ in range(14))
    rows = [(0, "a" * 450), (1, "ab" * 120), (2, ""), (3, "short"), (4, passages[0][:99]), (5, passages[0][:100]), (6, "é" * 200)]
    for i in range(7, 60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30)))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 80)
            parts += [p[a : a + rng.randrange(60, 300)], line if rng.random() < 0.5 else "", " ".join(word() for _ in range(rng.randrange(0, 20)))]
        rows.append((i, "\n".join(parts)))
    return rows + [(100, rows[20][1]), (101, rows[20][1] + rows[30][1])]


@pytest.mark.parametrize(("large", "shard", "held"), [(8192, 1 << 18, 400_000), (3, 500, 200), (8192, 700, 50)])
def test_removal_against_a_loop(spark, monkeypatch, large, shard, held):
    # Small limits reach the executors by the environment of forked workers only if they were set before: use the functions directly.
    rows = texts_for_removal()
    want = removed_by_hand(rows)
    monkeypatch.setattr(suffix, "LARGE", large)
    monkeypatch.setattr(suffix, "SHARD", shard)
    monkeypatch.setattr(suffix, "HELD", held)
    import pyarrow as pa

    def batches(table, n=37):
        return iter(table.to_batches(max_chunksize=n)) if table.num_rows else iter([])

    first = pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], names=["doc", "tag", "text"])])
    half = first.num_rows // 2
    segments = pa.concat_tables([pa.Table.from_batches(list(suffix._segments(batches(part)))) for part in (first.slice(0, half), first.slice(half))])
    segments = segments.sort_by([(c, "ascending") for c in ("anchor", "content", "doc", "tag", "place")])
    marks = pa.Table.from_batches(list(suffix._first_of_bucket(batches(segments))))
    wanted, ranges = {}, {}
    for m in marks.to_pylist():
        if m["kind"]:
            wanted.setdefault(m["doc"], []).append({"kind": m["kind"], "place": m["start"], "anchor": m["anchor"]})
        else:
            ranges.setdefault(m["doc"], []).append((m["start"], m["end"]))
    texts = dict(rows)
    asked = pa.RecordBatch.from_arrays([pa.array(list(wanted)), pa.array([0] * len(wanted)), pa.array([texts[i] for i in wanted]), pa.array(list(wanted.values()))], names=["doc", "tag", "text", "wanted"])
    fetched = pa.Table.from_batches(list(suffix._fetch(iter([asked])))).sort_by("bucket")
    for batch in suffix._shards(batches(fetched)):
        for r in batch.to_pylist():
            ranges.setdefault(r["doc"], []).append((r["start"], r["end"]))
    for i, t in rows:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for s, e in ranges.get(i, []):
            gone[s:e] = b"\1" * (e - s)
        assert sum(gone) == want[i][1] and hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest() == want[i][3], i


def test_removal_of_rows(spark):
    rows = texts_for_removal()
    want = removed_by_hand(rows)
    d = spark.createDataFrame([*rows, (None, rows[20][1]), (None, None), rows[8], (70, None)], "doc_id long, text string").withColumn("doc", F.lit("clash"))
    got = suffix.remove_repeats(d).collect()
    assert len(got) == d.count()
    for r in got:
        if r.doc_id in want:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        elif r.doc_id is None and r.n_bytes:
            assert r.n_removed == r.n_bytes or r.n_bytes < 100  # null ids come last
    assert suffix.remove_repeats(d.where("false")).count() == 0


def test_suffix_arrays():
    rng = random.Random(10)
    for _ in range(150):
        t = bytes(rng.choice(rng.choice([b"ab", b"abcdefg", b"\0\xff"])) for _ in range(rng.choice([0, 1, 2, 9, 60, 300])))
        b = np.frombuffer(t, np.uint8)
        sa = suffix.suffix_array(b)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        if t:
            lcp = suffix.common_prefixes(b, sa, np.array(sorted({0, *(rng.randrange(len(t)) for _ in range(3))})))
            for r in range(1, len(t)):
                x, y = t[sa[r] :], t[sa[r - 1] :]
                assert lcp[r] == next((k for k in range(min(len(x), len(y), 100)) if x[k] != y[k]), min(len(x), len(y), 100))


def test_image_copies(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=64).astype(float).tolist()) for i in range(40)]
    table = spark.createDataFrame([*rows, (41, None)], "vec_id long, embedding array<float>")
    images = media.render(table).unionByName(spark.createDataFrame([(50, b"no image"), (51, b"no image"), (52, None), (53, b"P5 0 0 255\n"), (None, b"x")], "image long, bytes binary")).withColumn("class_id", F.lit(0))
    got = {r.image: r for r in media.copies(images).collect()}
    for i in range(40):
        want = i - 1 if i % 5 == 1 else i
        assert got[i].class_id == want and (got[i].n_links > 0) == (i % 5 in (0, 1))
    assert got[50].class_id == got[51].class_id == 50 and got[52].class_id in (41, 52) and len(got) == 40 + 1 + 5
    assert media.copies(images.where("false")).count() == 0


def test_netpbm():
    a = np.arange(12).reshape(3, 4) * 20.0
    assert (media.decode(media.encode(a)) == a).all()
    assert media.decode(b"P6\n# note\n1 1\n255\n\x00\x03\x06")[0, 0] == 3 and media.decode(b"P5 9 9 255\n") is None and media.decode(None) is None
    assert media.decode(b"P5 2 1 15\n\x0f\x00").tolist() == [[255.0, 0.0]] and media.decode(b"P5 1 1 65535\n\x00\x00") is None
    for bad in (b"", b"P5", b"P5 " + b"9" * 5000, b"P5 999999999 999999999 255\n\x00", b"P5 -1 1 255\nx", b"P5#" * 50, b"P6 1 1 255\nxx"):
        assert media.decode(bad) is None


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "mixing_sources"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12 34 !!", "en", "s", 8), (9002, None, "en", "s", 0)], docs.schema)
    start = docs.unionByName(extra).unionByName(docs.where("doc_id < 3"))
    known = corpus_pipeline.identify_language(spark, start, SMALL)
    assert known.columns == docs.columns and known.where("doc_id > 9000").count() == 0 and known.count() == start.count() - 2
    one = corpus_pipeline.remove_near_duplicates(spark, known, SMALL).cache()
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in one.collect()}
    assert one.count() == len(kept)  # equal rows go, too
    shingles = {i: {tuple(w[j : j + 5]) for w in [t.lower().split()] for j in range(max(len(w) - 4, 1))} for i, t in rows.items()}
    similar = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    for i in rows:
        best = max((similar(i, j) for j in rows if j != i), default=0)
        if i not in kept:
            assert best > 0.6, (i, best)
    near = [(a, b) for a in kept for b in kept if a < b and similar(a, b) >= 0.88]
    assert not near
    clean = corpus_pipeline.decontaminate(spark, one, SMALL)
    masked = corpus_pipeline.mask_secrets(spark, clean, SMALL)
    assert masked.columns == docs.columns and masked.count() == clean.count()
    mixed = corpus_pipeline.mix_sources(spark, masked, SMALL)
    assert mixed.columns == [*docs.columns, "copy"] and mixed.groupBy("doc_id").count().where("count > 3").count() == 0


def test_near_duplicates_at_the_stated_similarity(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows, want = [], set()
    for k in range(60):  # sets of 90 shingles in a row of 94 words: 80 or 79 of 100 or 101 are common
        body, add = [word() for _ in range(94)], 10 if k % 2 else 11
        rows += [(10 * k, " ".join(body)), (10 * k + 1, " ".join([*body[add:], *[word() for _ in range(add)]]))]
        want |= {10 * k} if k % 2 else {10 * k, 10 * k + 1}
    line = " ".join(word() for _ in range(12))  # one line 60 times does not make texts alike
    rows += [(1000 + i, "\n".join([line] * 60 + [" ".join(word() for _ in range(300))])) for i in range(2)]
    base = [word() for _ in range(200)]  # a chain: every text is like the next only
    rows += [(2000 + i, " ".join(base[8 * i : 8 * i + 84])) for i in range(12)]
    rows += [(3000, None), (3001, " "), (None, "one two"), (3002, "ONE two"), (3002, "ONE two")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in simhash.keep_one(d).collect()]
    assert sorted(got) == sorted(want | {1000, 1001, 2000, 3000, 3002})
    assert simhash.keep_one(d.where("false")).count() == 0


def test_large_group_of_near_copies_against_a_loop(spark):
    rng = random.Random(13)
    base, rows = [f"v{i}" for i in range(100)], []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(100), rng.randrange(0, 6)):
            w[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(96)} for i, t in rows}
    label = reach(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(label.values())


def corner_matches(a, b):
    """Rows for agreeing() of two images' corners that share a table and lie within the radius."""
    bits = [np.ascontiguousarray(x[:, 4:]).view(np.uint64) for x in (a, b)]
    out = []
    for k in range(0, len(a), 256):
        differ = bits[0][k : k + 256, None] ^ bits[1][None]
        i, j = np.nonzero(np.bitwise_count(differ).sum(axis=2) <= media.RADIUS)
        meet = [~(differ[i, j] & m).any(axis=1) for m in media._MASKS]
        i, j = i[np.any(meet, axis=0)], j[np.any(meet, axis=0)]
        out.append(np.column_stack([a[k + i, :4], b[j, :4]]))
    return np.unique(np.concatenate(out), axis=0)


@pytest.mark.parametrize("grain", [30.0, 0.0])
@pytest.mark.parametrize("size, n", [(96, 12), (200, 6), (400, 2)])
def test_edits_are_found_at_any_size(size, n, grain):
    rng, found = np.random.default_rng(size), []
    as_read = lambda p: media.describe(media.decode(media.encode(p)))
    for _ in range(n):
        p = media._picture(0, 0, rng.normal(size=64).tolist(), size, grain)
        y, x = rng.integers(0, size - 79, 2)
        over = p.copy()
        over[size // 3 : size // 2, size // 5 : size * 7 // 10] = 250
        own = as_read(p)
        for edit in (p[y : y + 80, x : x + 80], p * 0.8 + 25 + rng.normal(0, 2, p.shape), np.rot90(p), over):
            m = corner_matches(own, as_read(edit))
            assert len(m) and media.agreeing(m) >= media.AGREE
        found.append(own)
    assert all(media.agreeing(corner_matches(a, b)) < media.AGREE for i, a in enumerate(found) for b in found[:i])


def test_strips_change_nothing(monkeypatch):
    p = media.decode(media.encode(media._picture(0, 0, np.random.default_rng(3).normal(size=64).tolist(), 160)))
    whole = media.describe(p)
    monkeypatch.setattr(media, "STRIP", 50)
    cut = media.describe(p)
    order = lambda d: d[np.lexsort(d[:, :3].T)]
    a, b = order(whole), order(cut)
    assert len(a) > 50 and (a[:, :3] == b[:, :3]).all() and (a[:, 4:].view(np.int64) == b[:, 4:].view(np.int64)).mean() > 0.95


def test_large_groups_of_edited_copies(spark):
    rng = np.random.default_rng(14)
    pictures = [media._picture(0, 0, rng.normal(size=64).tolist(), 96) for _ in range(2)]
    images = [(i, media.encode(pictures[i % 2] * rng.uniform(0.7, 0.9) + 20 + rng.normal(0, 3, (96, 96)))) for i in range(90)]
    got = {r.image: r for r in media.copies(spark.createDataFrame(images, "image long, bytes binary")).collect()}
    found = [media.describe(media.decode(b)) for _, b in images]
    links = [(a, b) for a in range(90) for b in range(a) if len(m := corner_matches(found[b], found[a])) and media.agreeing(m) >= media.AGREE]
    assert len(links) > 2 * 45 * 44 // 2 * 0.9
    for i in range(90):
        assert got[i].class_id == i % 2 and got[i].n_links == sum(i in pair for pair in links)


def test_shards_of_a_bucket_leave_no_pair_out():
    import pyarrow as pa

    rng = np.random.default_rng(15)
    bits = rng.integers(0, 2**63, media.WORDS, dtype=np.int64) ^ (np.int64(1) << rng.integers(0, 63, (120, media.WORDS)))
    rows, want = [], set()
    for left, right in ((0, 0), (0, 1), (1, 1)):
        rows += [(0, 7, left, right, i % 2, i // 2, float(i), 0.0, 1.0, 0.0, *bits[i].tolist()) for i in range(120) if i % 2 in (left, right)]
    for i in range(120):
        want |= {(i, j) for j in range(i + 1, 120) if i // 2 != j // 2}
    names = ["table", "key", "left", "right", "part", "image", "x", "y", "scale", "angle", *media.BITS_OF]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    got = [(int(r["lx"]), int(r["rx"])) for b in media._match(iter([batch.slice(0, 50), batch.slice(50)])) for r in b.to_pylist()]
    assert len(got) == len(want) and set(got) == want


def test_similar_sets_meet_in_trees_of_fingerprints():
    import pyarrow as pa

    rng = np.random.default_rng(16)
    base, rows = rng.integers(0, 2**63, 200), []
    for i in range(80):  # two families, of which the second holds pairs under the similarity as well, in two parts of a bucket
        x = base + (i % 2)
        x[rng.permutation(200)[: int(rng.integers(0, 30))]] = rng.integers(0, 2**63, 1)
        rows.append(np.unique(x.view(np.uint64)))
    prints = np.array([simhash.print_of(x, simhash.WORDS) for x in rows], np.int64)
    alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    for left, right in ((0, 0), (0, 1), (1, 1)):
        at = [i for i in range(80) if (i // 2) % 2 in (left, right)]
        keys = [[7]] * len(at)
        columns = [at, [len(rows[i]) for i in at], at, [(i // 2) % 2 for i in at], keys, prints[at].tolist(), [rows[i].view(np.int64).tolist() for i in at]]
        bucket = simhash._Bucket([pa.array(c, pa.list_(pa.int64()) if isinstance(c[0], list) else pa.int64()) for c in columns])
        far = {(min(i, j), max(i, j)) for i in range(len(at)) for j in range(i) if (bucket.part[i], bucket.part[j]) in ((left, right), (right, left)) and simhash.hamming(prints[at].view(np.uint64)[[i]], prints[at].view(np.uint64)[j])[0] <= simhash.RADIUS}
        assert {(min(i, int(j)), max(i, int(j))) for i, near in bucket.near(left, right) for j in near} == far
        found = list(bucket.links(7, left, right, 0.8))
        assert all(alike(rows[a], rows[b]) for a, b in found)
        want = reach(at, lambda a, b: ((a // 2) % 2, (b // 2) % 2) in ((left, right), (right, left)) and alike(rows[a], rows[b]))
        assert reach(at, lambda a, b: (a, b) in found or (b, a) in found) == want
