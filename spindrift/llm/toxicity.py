"""Toxicity by a counterfactual-regularised classifier (operator 7).

A logistic model over the distinct words of a text and the beginnings of its words, with how many words share one. Each labelled text
that mentions a group is paired with itself, the group's term swapped for another of its kind; each that mentions none is paired as
two neutral mentions, one term put into the one and another of its kind into the other, and every second such text is learnt from with
its mention. The squared difference of a pair's scores is added to the loss, so that what the model learns can't rest on which group
is named: a neutral mention stays neutral. An l1 penalty keeps only the weights that the labels need, so long texts don't gather
noise and the model is small enough to travel with every task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows (expected number, drawn by a hash of the text) that the model is fitted on; l1 and counterfactual weights; rounds.
SAMPLE, L1, SWAP_WEIGHT, ROUNDS = 6000, 4e-4, 1.0, 200
#: Features of fewer sampled rows are left out, so the model has at most SAMPLE * (words of a text) / MIN_ROWS weights.
MIN_ROWS = 3
#: Bytes of a word's beginning that are features of their own.
STEMS = (5, 6, 7)
#: Terms of one kind, each swapped for the next; plain and lower-case.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "latino"), ("immigrants", "refugees", "natives"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
#: How many different words of a text with one beginning are told apart.
LEVELS = 4
#: Words that are kept in a task's cache of looked-up words.
CACHE = 400_000


@cache
def _plain() -> bytes:
    """Bytes table: ASCII other than letters and digits to blanks."""
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def text_words(text: str | None) -> set[bytes]:
    """Distinct lower-cased words: runs of letters, digits and everything beyond ASCII."""
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_plain()).split())


def features(word: bytes) -> list[int]:
    """Hashes of the word and of its beginnings."""
    return [xxhash.xxh3_64_intdigest(word)] + [xxhash.xxh3_64_intdigest(word[:n], n) for n in STEMS if len(word) >= n]


_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def level(feature: int, n: int) -> int:
    """The feature of n or more different words that share one; the feature itself for one."""
    return (feature + (n - 1) * _STEP) & _MASK


def text_features(words: Iterable[bytes]) -> list[int]:
    """The features of different words, each at every level that enough words reach; sorted."""
    seen = Counter(f for w in words for f in features(w))
    return sorted({level(f, j) for f, n in seen.items() for j in range(1, min(n, LEVELS) + 1)})


def swaps(groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> dict[bytes, bytes]:
    return {a.encode(): group[(i + 1) % len(group)].encode() for group in groups for i, a in enumerate(group)}


def fit(rows: Sequence[Sequence[int]], labels: Sequence[int], pairs: Sequence[tuple[Sequence[int], Sequence[int]]] = (), l1: float = L1, swap_weight: float = SWAP_WEIGHT, rounds: int = ROUNDS, min_rows: int = MIN_ROWS) -> tuple[float, dict[int, float]]:
    """(bias, weights): minimises the mean logistic loss + swap_weight * mean (score(a) - score(b))**2 over pairs + l1 * |weights|.

    rows and pairs hold the distinct features of texts; what the two of a pair share may be left out. Without both labels the weights are empty and the bias is the label's.
    """
    y = np.asarray(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return (0.0 if len(y) == 0 else 4.0 if y[0] else -4.0), {}
    flat = np.concatenate([np.asarray(r, np.uint64) for r in rows])
    lengths = np.array([len(r) for r in rows])
    known, n = np.unique(flat, return_counts=True)
    known = known[n >= min_rows]
    if not len(known):
        return float(np.log(y.mean() / (1 - y.mean()))), {}

    def matrix(parts: Sequence[Sequence[int]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.asarray(r, np.uint64) for r in parts]) if len(parts) else np.empty(0, np.uint64)
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        ok = known[at] == ids
        return at[ok], np.repeat(np.arange(len(parts)), sizes)[ok]

    col, row = matrix(rows, lengths)
    left, right = [p for p, _ in pairs], [p for _, p in pairs]
    lc, lr = matrix(left, np.array([len(p) for p in left], np.int64))
    rc, rr = matrix(right, np.array([len(p) for p in right], np.int64))
    sc, sr, sv = np.concatenate([lc, rc]), np.concatenate([lr, rr]), np.concatenate([np.ones(len(lc)), -np.ones(len(rc))])
    w, grown, bias, bias_grown = np.zeros(len(known)), np.full(len(known), 1e-10), float(np.log(y.mean() / (1 - y.mean()))), 1e-10
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both labels count alike
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[col], len(y)), -30, 30)))
        err = weight * (p - y) / len(y)
        g = np.bincount(col, err[row], len(known))
        if len(pairs):
            d = np.bincount(sr, sv * w[sc], len(pairs))
            g += swap_weight * 2 / len(pairs) * np.bincount(sc, sv * d[sr], len(known))
        grown += g * g
        step = 0.3 / np.sqrt(grown)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        bias_grown += err.sum() ** 2
        bias -= 0.3 / np.sqrt(bias_grown) * err.sum()
    kept = np.flatnonzero(w)
    return float(bias), dict(zip(known[kept].tolist(), w[kept].tolist(), strict=True))


def counterfactuals(words: set[bytes], swap: Mapping[bytes, bytes], draw: int) -> tuple[set[bytes], set[bytes], set[bytes]]:
    """(words to learn from, the two of the pair) of a text: swapped terms, or mentions put in where it has none, by a drawn number."""
    if not swap:
        return words, words, words
    if not swap.keys().isdisjoint(words):
        return words, words, {swap.get(w, w) for w in words}
    term = sorted(swap)[draw // 2 % len(swap)]
    mention = words | {term}
    return mention if draw % 2 else words, mention, words | {swap[term]}


def examples(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> tuple[list[np.ndarray], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(rows, labels, pairs) for fit(): the features of about sample labelled texts, and of each text's pair those that differ."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and id is not null")
    n = marked.count()
    rows = docs.select(F.col("doc_id").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null").join(marked, "id")
    rows = rows.where((F.xxhash64("text", "id").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))) < F.lit(sample / max(n, 1)))
    swap = swaps(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: tuple[list, list, list] = ([], [], [])
            for t in b.column(0):
                raw = t.as_py()
                own, left, right = counterfactuals(text_words(raw), swap, xxhash.xxh3_64_intdigest(raw.encode("utf-8", "surrogatepass")))
                one, other = set(text_features(left)), set(text_features(right))
                for out, x in zip(found, (text_features(own), sorted(one - other), sorted(other - one)), strict=True):
                    out.append(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array(x, pa.list_(pa.int64())) for x in found]], names=["toxic", "own", "one", "other"])

    got = rows.select("text", "toxic").mapInArrow(run, "toxic int, own array<bigint>, one array<bigint>, other array<bigint>").toArrow()
    unsigned = lambda name: [np.asarray(x.values).view(np.uint64) for x in got[name]]
    pairs = [(a, b) for a, b in zip(unsigned("one"), unsigned("other"), strict=True) if len(a) or len(b)]
    return unsigned("own"), (np.asarray(got["toxic"]) == 1).astype(int), pairs


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, swap_weight: float = SWAP_WEIGHT) -> tuple[float, dict[int, float]]:
    """The model of the texts of docs (doc_id, text) that labels (doc_id, toxic) marks; both hold the rows to learn from only.

    About sample rows, drawn by a hash of the text and the id, reach the driver, as hashed features. Null labels, ids and texts are left
    out; of several labels of a row each counts.
    """
    return fit(*examples(docs, labels, text, sample, groups), swap_weight=swap_weight)


class Scorer:
    def __init__(self, model: tuple[float, Mapping[int, float]]):
        self.bias, self.weights = model
        self.bases = {level(f, 1 - j) for f in self.weights for j in range(LEVELS)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        """1 / (1 + exp(-(bias + weights of the text's features))); the bias alone for a text without words."""
        hit: Counter[int] = Counter()
        for w in text_words(text):
            if (f := self.known.get(w)) is None:
                if len(self.known) >= CACHE:
                    self.known.clear()
                f = self.known[w] = tuple(x for x in features(w) if x in self.bases)
            if f:
                hit.update(f)
        z = self.bias + sum(self.weights.get(level(x, j), 0.0) for x in sorted(hit) for j in range(1, min(hit[x], LEVELS) + 1))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def score(docs: DataFrame, model: tuple[float, dict[int, float]], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The columns of docs but the text, and score, predicted (replaced if there), one row per row; null texts score as empty ones."""
    read = docs.drop("score", "predicted")
    kept = [f for f in read.schema.fields if f.name != text]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double", "predicted int"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            column = lambda n: b.column(b.schema.get_field_index(n))  # noqa: B023, E731
            found = np.array([scorer.score(t.as_py()) for t in column(text)], np.float64)
            yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return read.mapInArrow(run, schema)
