"""Operators with models: language, toxicity, language-model scores."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from spindrift.llm import langid, lm, toxicity
from spindrift.llm.queries import QUERIES

CLEAN = {"en": "the cat and the dog went to the house with them and that was all there is to it", "de": "der hund und die katze gingen nach hause und das war alles was sie nicht wollten", "xx": "ω φ ψ ωφψ φωψ ψω ωω φφ"}


def test_grams_against_a_loop():
    rng = random.Random(1)
    for text in ["", "a", "Ab c!", "  é1È  ", "😀", "ß" * 5, "x" * 50] + ["".join(rng.choice("aB é.,\n") for _ in range(rng.randrange(60))) for _ in range(50)]:
        low = "".join(c.lower() if c.isalpha() else " " for c in text)
        padded = " " + " ".join(low.split()) + " "
        want = Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ") if padded.strip() else Counter()
        for piece in (1 << 18, 3):
            langid.PIECE, before = piece, langid.PIECE
            keys, counts = langid.grams(text)
            langid.PIECE = before
            assert sorted(counts.tolist()) == sorted(want.values()), text


def test_out_of_place_by_hand():
    texts = {k: langid.ranked(*langid.grams(v)) for k, v in CLEAN.items()}
    p = langid.Profiles(texts)
    own = langid.ranked(*langid.grams("der hund"))
    want = {}
    for lang, profile in texts.items():
        place = {g: i for i, g in enumerate(profile.tolist())}
        want[lang] = sum(abs(place[g] - i) if g in place else p.most for i, g in enumerate(own.tolist()))
    lang, score = p.predict("der hund")
    assert lang == min(want, key=want.get) == "de" and score == pytest.approx(1 - want["de"] / (p.most * len(own)))
    assert p.predict(None) == p.predict("12 !") == ("und", 0.0) and langid.Profiles({}).predict("x") == ("und", 0.0)


def test_language_of_rows(spark):
    rows = [(i, k, v) for i, (k, v) in enumerate(CLEAN.items())] * 3 + [(9, None, "der hund und die katze"), (10, "en", None), (None, "en", "12")]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("score", F.lit("clash"))
    got = langid.predict(d, langid.learn_profiles(d)).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got if r.lang and r.text and r.text != "12")
    assert {r.lang_pred for r in got if r.doc_id in (10, None)} == {"und"} and [r.lang_pred for r in got if r.doc_id == 9] == ["de"]
    assert langid.learn_profiles(d.where("false")) == {} and langid.predict(d.where("false"), {}).count() == 0


def test_profiles_equal_plain_counting(spark):
    rows = [(i, "de" if i % 3 else "en", f"Wort{i % 7} und der Hund {i} läuft" if i % 3 else f"the dog {i % 5} runs") for i in range(60)]
    got = langid.learn_profiles(spark.createDataFrame(rows, "doc_id long, lang string, text string"), key="doc_id")
    for lang in ("de", "en"):
        n: dict = {}
        for _, k, t in rows:
            if k == lang:
                letters = "".join(c.lower() if c.isalpha() else " " for c in t)
                padded = " " + " ".join(letters.split()) + " " if letters[:1] == " " or letters[-1:] == " " else " " + " ".join(letters.split()) + " "
                for size in (1, 2, 3):
                    for at in range(len(padded) - size + 1):
                        g = padded[at : at + size]
                        if g.strip():
                            n[g] = n.get(g, 0) + 1
        pack = lambda g: sum(ord(c) * (c != " ") << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) | (1 << 63 if len(g) == 2 else 0)
        want = sorted(((-v, pack(g)) for g, v in n.items()))[: langid.PROFILE]
        assert sorted(int(x) for x in got[lang]) == sorted(p for _, p in want)


def test_languages_of_copies_are_learnt(spark):
    rows = spark.range(12_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'xx', 'yy') as lang", "if(id % 2 = 0, 'immer derselbe satz', concat('another sentence ', id)) as text")
    hot = spark.range(6000).selectExpr("id + 20000 as doc_id", "'zz' as lang", "if(id < 5990, 'toujours la même phrase', concat('autre phrase ', id)) as text")
    got = langid.learn_profiles(rows.unionByName(hot), key="doc_id", per_lang=100)
    assert set(got) == {"xx", "yy", "zz"} and all(len(v) for v in got.values())
    p = langid.Profiles(got)
    assert [p.predict(t)[0] for t in ("derselbe satz", "another sentence", "la même phrase")] == ["xx", "yy", "zz"]


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, SMALL).join(docs, "doc_id").where("held_out").collect()
    assert got and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_swaps_keep_scores_together():
    rng, groups = random.Random(4), (("women", "men"),)
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        # The label goes with one group more often than not: a plain model learns the group.
        group = "women" if rng.random() < (0.85 if bad else 0.15) else "men"
        texts.append(" ".join([group, *(["vile"] if bad and rng.random() < 0.5 else []), *(rng.choice("abcdefgh") * 3 for _ in range(6))]))
        labels.append(int(bad))
    swap = toxicity.swaps(groups)
    rows = [sorted({f for w in toxicity.text_words(t) for f in toxicity.features(w)}) for t in texts]
    other = [sorted({f for w in toxicity.text_words(t) for f in toxicity.features(swap.get(w, w))}) for t in texts]
    gap = {}
    for weight in (0.0, 5.0):
        s = toxicity.Scorer(toxicity.fit(rows, labels, list(zip(rows, other, strict=True)), swap_weight=weight))
        gap[weight] = abs(s.score("women aaa bbb") - s.score("men aaa bbb"))
        assert s.score("men vile") > s.score("men aaa")
    assert gap[5.0] < 0.1 < gap[0.0]


def test_toxicity_edges(spark):
    rows = [(i, ("you moron " if i % 2 else "dear friend ") + "x" * (i % 5)) for i in range(60)] + [(60, None), (61, ""), (61, ""), (None, "moron")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(60, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.learn(d, labels)).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[60].score == got[61].score and got[None].predicted == 1
    flat = toxicity.learn(d, labels.where("false"))
    assert flat == (0.0, {}) and toxicity.score(d.where("false"), flat).count() == 0
    assert toxicity.fit([[1], [2]], [1, 1]) == (4.0, {})


def test_fit_against_a_loop():
    """The same steps, weight by weight."""
    rng = random.Random(6)
    rows = [sorted({rng.randrange(12) for _ in range(5)}) for _ in range(40)]
    labels = [int(0 in r or rng.random() < 0.2) for r in rows]
    pairs = [([1, 2], [3]), ([0], [4, 5]), ([77], [1])]
    bias, got = toxicity.fit(rows, labels, pairs, l1=1e-3, swap_weight=2.0, rounds=15, min_rows=2)
    share = sum(labels) / len(labels)
    w, grown = dict.fromkeys(range(12), 0.0), dict.fromkeys(range(12), 1e-10)
    b, b_grown = math.log(share / (1 - share)), 1e-10
    for _ in range(15):
        err = [(0.5 / share if y else 0.5 / (1 - share)) * (1 / (1 + math.exp(-(b + sum(w[f] for f in r)))) - y) / len(rows) for r, y in zip(rows, labels, strict=True)]
        d = [sum(w.get(f, 0) for f in x) - sum(w.get(f, 0) for f in y) for x, y in pairs]
        new = {}
        for f in w:
            g = sum(e for r, e in zip(rows, err, strict=True) if f in r) + sum(2.0 * 2 / len(pairs) * k * ((f in x) - (f in y)) for k, (x, y) in zip(d, pairs, strict=True))
            grown[f] += g * g
            step = 0.3 / math.sqrt(grown[f])
            v = w[f] - step * g
            new[f] = math.copysign(max(abs(v) - step * 1e-3, 0), v)
        w = new
        b_grown += sum(err) ** 2
        b -= 0.3 / math.sqrt(b_grown) * sum(err)
    assert bias == pytest.approx(b) and got == pytest.approx({f: x for f, x in w.items() if x})
    s = toxicity.Scorer((0.25, {toxicity.level(toxicity.features(b"aaaaabc")[1], 2): 1.5, toxicity.features(b"zz")[0]: -1.0}))
    assert s.score("aaaaabc AAAAAbd! zz") == pytest.approx(1 / (1 + math.exp(-0.75))) and s.score("aaaaabc aaaaabc") == pytest.approx(1 / (1 + math.exp(-0.25)))


def test_neutral_mentions_stay_neutral(spark):
    """The penalty is active on the tables, whose texts name no group, and lowers what a mention changes."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    rows, marks, pairs = toxicity.examples(docs, labels)
    assert len(pairs) == len(rows) == len(marks) > 300
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").select("text").collect()][:100]
    terms = [t for g in toxicity.IDENTITY_TERMS for t in g]
    changed, wrong = {}, {}
    for weight in (0.0, 20.0):
        s = toxicity.Scorer(toxicity.fit(rows, marks, pairs, l1=1e-5, swap_weight=weight))
        scores = np.array([[s.score(f"{t} {x}") for x in terms] for t in clean])
        changed[weight], wrong[weight] = float((scores.max(axis=1) - scores.min(axis=1)).mean()), int((scores >= 0.7).sum())
    assert changed[20.0] < changed[0.0] and wrong[20.0] <= wrong[0.0]


def test_held_out_toxicity(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    clean = [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert np.mean([r.score for r in got if r.toxic]) > np.mean([r.score for r in clean]) + 0.3


def some_words(rng, n):
    """Input rows of n words, one to three each."""
    size = rng.integers(1, 4, n)
    return lm.Lists(rng.integers(0, 30, size.sum()), np.cumsum(size) - size, size)


def test_gradient():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm.start_weights(np.ones(20), 30).items()}
    words = some_words(rng, 25)
    x, y = rng.integers(0, 25, (2, lm.WINDOW)), rng.integers(0, 20, (2, lm.WINDOW))
    ok = rng.random(x.shape) < 0.8
    _, g = lm.gradient(w, words, x, y, ok)
    for k in w:
        i = (int(words.flat[words.start[x[0, 0]]]), 3) if k == "emb" else tuple(int(rng.integers(0, s)) for s in w[k].shape)
        e = 1e-5
        w[k][i] += e
        a, _ = lm.gradient(w, words, x, y, ok)
        w[k][i] -= 2 * e
        b, _ = lm.gradient(w, words, x, y, ok)
        w[k][i] += e
        assert (a - b) / (2 * e) == pytest.approx(g[k][i], rel=1e-3, abs=1e-8)


def test_attention_looks_back_only():
    w, rng = lm.start_weights(np.ones(20), 30, seed=1), np.random.default_rng(1)
    words, x = some_words(rng, 20), rng.integers(0, 20, (1, lm.WINDOW))
    a, _ = lm.forward(w, words, x)
    x[0, 20:] = 3
    b, _ = lm.forward(w, words, x)
    assert np.allclose(a[0, :20], b[0, :20]) and not np.allclose(a[0, 20:], b[0, 20:])


def test_each_position_is_scored_once():
    rng = np.random.default_rng(2)
    w, words = lm.start_weights(rng.random(20) * 50, 30, seed=2), some_words(rng, 40)
    lengths = np.array([0, 1, 5, lm.WINDOW - 1, lm.WINDOW, lm.WINDOW + 1, 3 * lm.WINDOW, 200])
    at, classes = rng.integers(0, 40, lengths.sum()), rng.integers(0, 20, lengths.sum())
    reader = lm.Reader(w)
    for part in np.array_split(np.arange(40), 3):
        reader.add(words.vectors(w["emb"], part))
    got, done = reader.nll(at, classes, lengths, batch=3), 0
    for n, total in zip(lengths, got, strict=True):
        seq, aims, done = at[done : done + n], classes[done : done + n], done + n
        inputs, targets, want = np.append(0, seq), np.append(aims, 0), 0.0
        for i in range(n + 1):
            k = 0 if i < lm.WINDOW else -(-(i - lm.WINDOW + 1) // (lm.WINDOW - lm.CONTEXT))
            first = k * (lm.WINDOW - lm.CONTEXT)
            x = np.zeros((1, lm.WINDOW), int)
            x[0, : i - first + 1] = inputs[first : i + 1]
            y, _ = lm.forward(w, words, x)
            want -= float(lm.log_probs(w, y[0, i - first : i - first + 1])[0, targets[i]])
        assert total == pytest.approx(want, rel=1e-4)


def test_shares_by_hand():
    """The chance of a word in its cluster, from plain counts; a cluster's words have at most all of it."""
    rng, cut = np.random.default_rng(3), lm.CLUSTERS * (lm.BEFORE + 2)
    ids_of = [rng.integers(0, 12, rng.integers(1, 4)) for _ in range(60)]
    ids_of = [np.array(x) for x in sorted({tuple(i.tolist()) for i in ids_of})]
    rows = 1 + np.arange(20) // 2  # two ids share a row
    cls = lm.SINGLES + rng.integers(0, 2, len(ids_of))
    counts, id_counts = rng.integers(1, 9, len(ids_of)), rng.integers(0, 50, 20)
    sizes, flat = np.array([len(i) for i in ids_of]), np.concatenate(ids_of)
    steps = Counter()
    for c, i in zip(cls - lm.SINGLES, ids_of, strict=True):
        steps.update(zip([c] * (len(i) + 1), [0, *rows[i]], [*rows[i], 0], strict=True))
    keys, times = np.unique(lm.spelling_keys(cls - lm.SINGLES, rows[flat], sizes), return_counts=True)
    assert keys.max() < cut * lm.N_ROWS and {(int(k) // lm.N_ROWS // (lm.BEFORE + 2), int(k) // lm.N_ROWS % (lm.BEFORE + 2), int(k) % lm.N_ROWS): n for k, n in zip(keys, times, strict=True)} == steps
    n, types = (np.bincount(cls, x, lm.N_CLASSES).astype(int) for x in (counts, np.ones(len(cls))))
    shares = lm.Shares.make(n, types, keys, times, id_counts, rows)
    common = Counter()
    for (_, _, r), k in steps.items():
        common[r] += k
    total = sum(common.values()) + lm.N_ROWS

    def chance(c, ids):
        p, before = 1.0, 0
        for r, i in [*zip(rows[ids], ids, strict=True), (0, None)]:
            own = sum(k for (d, _, x), k in steps.items() if d == c and x == r)
            whole = sum(k for (d, _, _), k in steps.items() if d == c)
            alone = (own + lm.COMMON * (common[r] + 1) / total) / (whole + lm.COMMON)
            here = [k for (d, b, _), k in steps.items() if d == c and b == before]
            p *= (steps[c, before, r] + len(here) * alone) / (sum(here) + len(here)) if here else alone
            if i is not None:
                p *= (id_counts[i] + 1) / (id_counts[rows == r] + 1).sum()
            before = r
        return p

    got = shares.spelled(cls, flat, rows[flat], sizes)
    for c, i, g in zip(cls, ids_of, got, strict=True):
        assert g == pytest.approx((types[c] + 1) * chance(c - lm.SINGLES, i))
    inside = np.exp(shares.inside(cls, counts, got))
    assert all(inside[cls == c].sum() <= 1 for c in set(cls.tolist())) and np.allclose(inside, (counts + got) / (n[cls] + types[cls] + 1))
    strange = shares.spelled(np.array([lm.SINGLES + 5]), np.array([19]), rows[[19]], np.array([1]))
    assert 0 < strange[0] < 1


def test_words_are_encoded_as_if_alone():
    with open(lm.VOCABULARY, "rb") as f:
        pieces = lm.Pieces(f.read())
    plain = [b"the", b"(the)", b"", b"a1234567b", "é!é".encode(), "\u0301x".encode(), b"...", "日本語12".encode(), "👍🏽".encode(), b"x" * 300]
    for words in (plain, [*plain, "a\u00a0b".encode(), "\u3000".encode(), b"end"], [b""], []):
        flat, sizes = pieces(words)
        want = [pieces.encode(" " + w.decode()) if w else [] for w in words]
        assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_windows_are_drawn_whole(spark):
    words = [f"w{i}" for i in range(100)]
    d = spark.createDataFrame([(" ".join(words[:n]),) for n in (0, 1, 31, 32, 63, 100)] + [(None,)], "text string")
    got = lm.draw_windows(d, share=1.0, rounds=3).collect()
    assert {r.turn for r in got} <= {0, 1, 2} and all(len(r.words.split(b" ")) <= lm.WINDOW + 1 for r in got)
    assert sum(len(r.words.split(b" ")) - 1 for r in got) == sum(n + 1 for n in (0, 1, 31, 32, 63, 100, 0))
    assert lm.draw_windows(d.where("false")).count() == 0


def test_coded_windows_are_those_drawn(spark):
    """Words are looked up once: the stored windows hold the rows and single classes of the words that draw_windows() gives."""
    with open(lm.VOCABULARY, "rb") as f:
        ranks = f.read()
    rows, pieces = np.arange(len(ranks.splitlines())) % (lm.N_ROWS - 1) + 1, lm.Pieces(ranks)
    classes = lm.Classes(ranks, {b"": 0, b"the": 1}, rows, np.zeros((lm.N_ROWS, lm.CLUSTERS), np.float32), np.zeros(lm.CLUSTERS, np.float32))
    texts = [None, "", " The end.\t", "a\u00a0b THE x", "x" * 3000, " ".join(f"w{i} the" for i in range(700)), "\x1c \u3000 é"] * 2
    d = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = []
    for r in lm.draw_windows(d).collect():
        words = r.words.split(b" ")
        flat, sizes = pieces(words)
        lists = np.split(rows[flat], np.cumsum(sizes)[:-1])
        want.append((r.turn, [(x.tolist() or [0], {b"": 0, b"the": 1}.get(w, -1)) for w, x in zip(words, lists, strict=True)]))
    got = []
    for b in lm.code_windows(d, classes).toArrow().to_batches():
        for i in range(len(b)):
            c = lm._coded(b.slice(i, 1))
            assert b.column("n")[i].as_py() == len(c.tokens) <= lm.PACK
            flat, size = c.lists.expand(c.words)
            words = [(x.tolist(), k) for x, k in zip(np.split(flat, np.cumsum(size)[:-1]), c.single[c.words].tolist(), strict=True)]
            ends = np.cumsum(c.tokens + 1).tolist()
            got += [(b.column("turn")[i].as_py(), words[e - n - 1 : e]) for e, n in zip(ends, c.tokens.tolist(), strict=True)]
    assert sorted(got) == sorted(want) and len(got) > 60
    assert lm.code_windows(d.where("false"), classes).count() == 0


def test_the_network_learns_from_all_windows(spark):
    words = [f"w{i}" for i in range(400)]
    d = spark.createDataFrame([(" ".join(words[:n]),) for n in (400, 200, 5)], "text string")
    assert lm.draw_windows(d).count() == sum(-(-(n + 1) // lm.WINDOW) for n in (400, 200, 5))


def test_frequent_words_are_looked_up_once():
    """A group of texts costs the encoding of the words that are not frequent, however many the frequent ones are."""
    with open(lm.VOCABULARY, "rb") as f:
        ranks = f.read()
    classes = lm.Classes(ranks, {b"": 0}, np.arange(len(ranks.splitlines())) % (lm.N_ROWS - 1) + 1, np.zeros((lm.N_ROWS, lm.CLUSTERS), np.float32), np.zeros(lm.CLUSTERS, np.float32))
    frequent = {b"the": 9, b"": 4, b"of": 7}
    words, alone, seen = lm._Words(classes, frequent), lm._Words(classes, {}), []
    of = words.pieces.of
    words.pieces = type("Counted", (), {"of": staticmethod(lambda w: (seen.extend(w.to_pylist()), of(w))[1])})
    for text in ([b"the", b"rare", b"of", b"the"], [b"of", b"unheard-of", b"rare"], []):
        seen.clear()
        got, want = words.lists.expand(at) if len(at := words.look(text)) else (), alone.lists.expand(x) if len(x := alone.look(text)) else ()
        assert seen == [w for w in dict.fromkeys(text) if w not in frequent] and all((a == b).all() for a, b in zip(got, want, strict=True))
    assert words.lists.expand(np.array([0]))[0].tolist() == [0]


def test_steps_of_groups_together():
    rng = np.random.default_rng(6)
    size = np.append(rng.integers(1, 6, 30), [70, 3])
    words = lm.Lists(rng.integers(0, 30, size.sum()), np.cumsum(size) - size, size)
    at = np.concatenate([rng.integers(0, 30, 40), [30], rng.integers(0, 30, 20)])
    emb = rng.random((30, lm.WIDTH))
    groups = list(words.all_steps(at, 16))
    assert len(groups) == 4
    for g, held in enumerate(groups):
        own = at[g * 16 : (g + 1) * 16]
        want = [emb[words.expand(np.array([i]))[0]].mean(axis=0) for i in own]
        assert np.allclose(lm.step_means(emb, held), want) and np.allclose(words.vectors(emb, own), want)


def test_large_weights_stay_finite():
    """Where a sum of exponentials leaves single precision, rows are shifted."""
    rng = np.random.default_rng(7)
    words, x = some_words(rng, 25), rng.integers(0, 25, (2, lm.WINDOW))
    for of in (np.float32, np.float64):
        w = {k: v.astype(of) * 40 for k, v in lm.start_weights(np.ones(20), 30).items()}
        loss, g = lm.gradient(w, words, x, x % 20, np.ones(x.shape, bool))
        assert np.isfinite(loss) and all(np.isfinite(v).all() for v in g.values())
    reader = lm.Reader({k: v.astype(np.float32) for k, v in w.items()})
    reader.add(words.vectors(reader.w["emb"], np.arange(25)))
    assert np.isfinite(reader.nll(x.ravel(), x.ravel() % 20, np.array([5, 59]))).all()


def test_rows_met_by_a_loop(spark):
    with open(lm.VOCABULARY, "rb") as f:
        ranks = f.read()
    singles = {b"": 0, b"the": 1, b"of": 2}
    classes = lm.Classes(ranks, singles, np.arange(len(ranks.splitlines())) % (lm.N_ROWS - 1) + 1, np.zeros((lm.N_ROWS, lm.CLUSTERS), np.float32), np.zeros(lm.CLUSTERS, np.float32))
    d = spark.createDataFrame([(" ".join(f"w{i % 40} the of"[: 9 + i % 3] for i in range(n)),) for n in (0, 3, 50, 200)], "text string")
    drawn, want = lm.code_windows(d, classes, frequent={b"the": 5, b"w1": 2}).localCheckpoint(), np.zeros((lm.N_ROWS, lm.SINGLES))
    for b in drawn.toArrow().to_batches():
        c = lm._coded(b)
        for words in np.split(c.words, np.cumsum(c.tokens + 1)[:-1]):
            want[np.ix_(np.unique(c.lists.expand(words)[0]), np.unique(c.single[words][c.single[words] >= 0]))] += 1
    assert want.sum() > 100 and (lm._met(drawn) == want).all() and not lm._met(drawn.where("false")).any()


def test_model_beats_the_word_counts(spark):
    got = QUERIES["op5_lm_scoring"](spark, "/root/testdata/sf0.1").groupBy("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).collect()
    assert len(got) == 2 and all(r.score > r.base for r in got)


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 30])
def test_base_scores_by_hand(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "ROUNDS", 1)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_001, None), (10_002, ""), (10_002, ""), (10_003, "unheard of words"), (None, "THE the")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    learnt = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    model = lm.learn(d.where(F.crc32(F.col("doc_id").cast("string")) % 7 != 2), rounds=1)
    counts = Counter(w for i, t in rows if learnt(i) for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    got = lm.score(d, model).collect()
    assert len(got) == len(rows) and model.tokens == n and model.distinct == v and model.whole == (frequent > 30)
    texts = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    for r in got:
        words = texts[r.doc_id]
        assert r.n_tokens == len(words) and r.n_known == sum(counts[w] > 0 for w in words) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)) and r.score < 0
    met = lm._Words(model.classes, counts, model.shares, model.weights)
    for r in got:
        at = met.look(texts[r.doc_id][:-1])
        want = (met.inside[at].sum() - met.reader.nll(at, met.cls[at], np.array([len(at)]))[0]) / math.log(10)
        assert r.score == pytest.approx(want, rel=1e-4)
    empty = lm.learn(d.where("false"), rounds=1)
    assert {round(r.base_score, 9) for r in lm.score(d, empty).where("n_tokens = 1").collect()} == {0.0} and lm.score(d.where("false"), model).count() == 0
