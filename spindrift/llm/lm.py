"""LM scoring by a causal self-attention model on subword ids, with a word-count baseline (operator 5).

A token is a word or the end of a text. The model reads a token as the mean vector of its subword ids (with the blank before it) and
predicts the class of the next token from the tokens before it by a small transformer: one causal attention head, a feed-forward
layer. The most frequent words are classes of their own; every other word belongs to the cluster that its subword ids point to, by the
frequent words they stand among, so words never met have a class as well. Inside a cluster a word has its share of the corpus counts,
interpolated (Witten-Bell) with its spelling: the chance of each of its subword ids after the one before, and of its end. The probabilities of all
words add up to one at most.

Words, subword ids and spellings are counted over the whole training corpus. The network is trained in numpy on the executors, on all
windows of the training texts, another part of them in each round: every task improves the shared weights on its own windows, and the
results are averaged by tokens after the round.

A text is scored in windows of ``WINDOW`` tokens that overlap: every token is predicted once, by the window that gives it most
context. Windows of many texts go through the model together, with the causal mask. The subwords of a word are looked up once for
some megabytes of text, not per occurrence. Words of the training corpus beyond the ``FREQUENT`` most frequent ones are not sent to the tasks: their
counts meet the texts in a join on the word.
"""

from __future__ import annotations

import base64
import itertools
import math
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, store

#: File of a public byte-pair vocabulary: one base64 token and its rank per line. Another one is a parameter of learn().
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PIECES = r" ?\p{L}+| ?\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+"
#: Words with a class of their own (the end among them), clusters of the others; subword ids with a vector of their own, bands of the others.
SINGLES, CLUSTERS, OWN, BANDS = 128, 8, 2048, 64
#: Most frequent subword ids that are told apart as the one before, in the spelling of words.
BEFORE = 512
#: Positions of a window, of which the first ones only give context; sizes of the network.
WINDOW, CONTEXT, WIDTH, HIDDEN = 32, 8, 16, 32
#: Words sent to every task.
FREQUENT = 300_000
#: Rounds that all windows are dealt to, windows that are trained on in a row, windows stored together (their words fit two bytes).
ROUNDS, TASK_WINDOWS, PACK = 4, 8192, 512
#: Parts of the weights, and of other arrays of the tasks, that are summed apart from each other.
SLICES = 64
#: Weight of the subword ids of all words beside those of a cluster's words.
COMMON = 50.0
_OTHER_SPACE = re.compile(r"[^\S ]")
#: The end of a text among the words, which are never empty.
END = ""


@cache
def _encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=table, special_tokens={})


class Pieces:
    """Subword ids of words, each with the blank before it. Hold it: finding it again compares the whole vocabulary."""

    def __init__(self, ranks: bytes):
        self.encode, self.encode_all = _encoder(ranks).encode_ordinary, _encoder(ranks).encode_to_numpy
        table = {int(r): len(base64.b64decode(a)) for a, r in map(bytes.split, ranks.splitlines())}
        self.length = np.zeros(max(table) + 1, np.int64)
        self.length[list(table)] = list(table.values())

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and how many each has; the end (an empty word) has none.

        Words are encoded together: a piece can't go on beyond a blank, unless a word holds white space beyond ASCII.
        """
        sizes = np.zeros(len(words), np.int64)
        texts = [" " + w.decode("utf-8", "replace") for w in words if w]
        whole = "".join(texts)
        if _OTHER_SPACE.search(whole):
            ids = [self.encode(t) for t in texts]
            flat, n = np.fromiter(itertools.chain.from_iterable(ids), np.int64), [len(i) for i in ids]
        else:
            flat = np.array(self.encode(whole), np.int64)
            ends = np.cumsum([len(t.encode()) for t in texts], dtype=np.int64)
            n = np.diff(np.searchsorted(np.cumsum(self.length[flat]), ends) + 1, prepend=0)
        sizes[[i for i, w in enumerate(words) if w]] = n
        return flat, sizes

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of an array of binaries, without a Python object per word."""
        length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        full = length > 0
        if not full.any():
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        held = words if full.all() else words.filter(pa.array(full))
        try:
            whole = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), b" ")[0].as_py().decode()
        except UnicodeDecodeError:
            return self(words.to_pylist())
        if _OTHER_SPACE.search(whole):
            return self(words.to_pylist())
        flat, sizes = self.encode_all(whole).astype(np.int64), np.zeros(len(words), np.int64)
        sizes[full] = np.diff(np.searchsorted(np.cumsum(self.length[flat]), np.cumsum(length[full] + 1)) + 1, prepend=0)
        return flat, sizes


@cache
def pieces_of(ranks: bytes) -> Pieces:
    """Those of a vocabulary, made once a process."""
    return Pieces(ranks)


def text_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, as text_words() has them, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, n = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # none before white space at the beginning, or after that at the end
    if not full.all():
        n = np.bincount(np.repeat(np.arange(len(n)), n)[full], minlength=len(n))
        words = words.filter(pa.array(full))
    return words, n


def _groups(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 23) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Rows of a batch in groups of about so many bytes, with their words end to end and how many each has."""
    for b in batches:
        texts = b.column(b.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1
        for first, stop in itertools.pairwise([0, *cuts.tolist(), len(b)] if len(b) else []):
            yield b.slice(first, stop - first), *split_words(texts.slice(first, stop - first))


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).cast(pa.binary())


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n over all rows of docs; the word '' counts the texts, one end each. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words, _ in _groups(batches, text, 1 << 24):
            seen = words.value_counts()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([b""]), seen.field(0)]).cast(pa.string()), pa.concat_arrays([pa.array([len(b)]), seen.field(1)])], names=["word", "n"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def count_ids(counts: DataFrame, ranks: bytes) -> np.ndarray:
    """How often each subword id occurs in the corpus that counts (word, n) is of. As long as the vocabulary."""
    shared = counts.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(shared.value)
        sums = np.zeros(len(pieces.length), np.int64)
        for b in batches:
            ids, sizes = pieces.of(_binary(b.column(0)))
            sums += np.bincount(ids, np.repeat(np.asarray(b.column(1)), sizes), len(sums)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums)), pa.array(sums[sums > 0])], names=["id", "n"])

    out = np.zeros(len(ranks.splitlines()), np.int64)
    for r in counts.select("word", "n").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def input_rows(counts: np.ndarray) -> np.ndarray:
    """The row of the input vectors that each subword id has: row 0 is the end's, then the frequent ids, then bands of about the same count."""
    order = np.argsort(-counts, kind="stable")
    rows = np.empty(len(counts), np.int64)
    rows[order[:OWN]] = 1 + np.arange(min(OWN, len(counts)))
    if len(rest := order[OWN:]):
        mass = np.cumsum(counts[rest] + 1.0)
        rows[rest] = 1 + OWN + np.minimum((BANDS * (mass - counts[rest] - 1) / mass[-1]).astype(int), BANDS - 1)
    return rows


N_ROWS, N_CLASSES = 1 + OWN + BANDS, SINGLES + CLUSTERS


@dataclass(frozen=True)
class Classes:
    """singles: the words that are classes, END first; rows: input_rows(); points: how far each row's ids point to each cluster."""

    ranks: bytes
    singles: dict[bytes, int]
    rows: np.ndarray
    points: np.ndarray
    level: np.ndarray

    def single(self, words: pa.Array) -> np.ndarray:
        """The class of each word that is one, -1 for the others."""
        return pc.fill_null(pc.index_in(words, value_set=pa.array(list(self.singles), pa.binary())), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def clusters(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The cluster of each word by its rows, end to end."""
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        points = self.points[rows]
        score = np.stack([np.bincount(text_of, points[:, k], len(sizes)) for k in range(points.shape[1])], axis=1) / np.maximum(sizes, 1)[:, None]
        return SINGLES + np.argmax(score - self.level, axis=1)

    def of(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The class of each word; ids: their subword ids end to end (END has none)."""
        single = self.single(words)
        return np.where(single >= 0, single, self.clusters(self.rows[ids], sizes))


def make_clusters(met: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """points and level of Classes from met (rows, SINGLES): how often each row's ids stand in a window with each frequent word.

    K-means over the square roots of the rows' shares, weighted by count, begun at the rows that lie furthest from those before.
    """
    total = met.sum(axis=1)
    x = np.sqrt(met / np.maximum(total, 1)[:, None])
    weight = total / max(total.sum(), 1)
    centres, far = x[[int(np.argmax(total))]], np.full(len(x), np.inf)
    for _ in range(CLUSTERS - 1):
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
        centres = np.concatenate([centres, x[[int(np.argmax(far * weight))]]])
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        mass = np.bincount(near, weight, CLUSTERS)
        sums = np.stack([np.bincount(near, weight * x[:, j], CLUSTERS) for j in range(x.shape[1])], axis=1)
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
    return (x @ centres.T).astype(np.float32), ((centres**2).sum(axis=1) / 2).astype(np.float32)


def spelling_keys(cluster: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(cluster, row before, row) of each step of words' spellings as one number; rows: theirs end to end, to which row 0 adds begin and end."""
    ends = np.cumsum(sizes)
    before, after = np.minimum(np.insert(rows, ends - sizes, 0), BEFORE + 1), np.insert(rows, ends, 0)
    return (np.repeat(cluster, sizes + 1) * (BEFORE + 2) + before) * N_ROWS + after


@dataclass(frozen=True)
class Shares:
    """Of each class the tokens (n) and the different words (types); of spellings the chances of a cluster's rows and of its pairs of rows.

    keys, pairs: spelling_keys() met and log chances there; left: log of what a row before leaves to the chance of the row alone
    (log_rows); in_row: log share of each subword id in its row. At most CLUSTERS * (BEFORE + 2) * N_ROWS pairs, whatever the corpus.
    """

    n: np.ndarray
    types: np.ndarray
    keys: np.ndarray
    pairs: np.ndarray
    left: np.ndarray
    log_rows: np.ndarray
    in_row: np.ndarray

    @staticmethod
    def make(n: np.ndarray, types: np.ndarray, keys: np.ndarray, times: np.ndarray, id_counts: np.ndarray, rows: np.ndarray) -> Shares:
        """keys (sorted) and times: the steps of the spellings of the different words."""
        before, row = keys // N_ROWS, keys % N_ROWS
        met = np.zeros((CLUSTERS, N_ROWS))
        np.add.at(met, (before // (BEFORE + 2), row), times)
        common = met.sum(axis=0) + 1.0
        share = (met + COMMON * common / common.sum()) / (met.sum(axis=1, keepdims=True) + COMMON)
        total, kinds = (np.bincount(before, x, CLUSTERS * (BEFORE + 2)) for x in (times, np.ones(len(keys))))
        pairs = (times + kinds[before] * share[before // (BEFORE + 2), row]) / (total + kinds)[before]
        left = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        in_row = (id_counts + 1.0) / np.bincount(rows, id_counts + 1.0, N_ROWS)[rows]
        return Shares(n, types, keys, np.log(pairs), np.log(left), np.log(share), np.log(in_row))

    def spelled(self, classes: np.ndarray, ids: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(types + 1) * the chance of each word's spelling in its cluster; zero where a class is one word. rows: those of the ids."""
        cluster = np.maximum(classes - SINGLES, 0)
        steps = spelling_keys(cluster, rows, sizes)
        terms = self.left[steps // N_ROWS] + self.log_rows[steps // N_ROWS // (BEFORE + 2), steps % N_ROWS]
        if len(self.keys):
            order = np.argsort(steps)  # neighbours are looked up near each other
            at = np.minimum(np.searchsorted(self.keys, steps[order]), len(self.keys) - 1)
            met = self.keys[at] == steps[order]
            terms[order[met]] = self.pairs[at[met]]
        word_of = np.arange(len(classes))
        log = np.bincount(np.repeat(word_of, sizes + 1), terms, len(classes)) + np.bincount(np.repeat(word_of, sizes), self.in_row[ids], len(classes))
        return np.where(classes >= SINGLES, (self.types[classes] + 1) * np.exp(np.maximum(log, -600.0)), 0.0)

    def inside(self, classes: np.ndarray, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Log share of each word in its class: its count and its spelling, of all counts and one more than the different words."""
        share = (counts + spelled) / (self.n[classes] + self.types[classes] + 1)
        return np.where(classes >= SINGLES, np.log(np.maximum(share, 1e-300)), 0.0)


def start_weights(class_counts: np.ndarray, n_rows: int = N_ROWS, seed: int = 0) -> dict[str, np.ndarray]:
    """Small random weights; the output starts at the frequency of the classes."""
    rng, n = np.random.default_rng(seed), len(class_counts)
    draw = lambda *s: (rng.standard_normal(s) * 0.5 / math.sqrt(s[0] if len(s) > 1 and s[0] <= 64 else 4)).astype(np.float32)
    p = class_counts + 1.0
    return {
        "emb": draw(n_rows, WIDTH), "pos": draw(WINDOW, WIDTH) * 0.2, "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH), "o": draw(WIDTH, WIDTH),
        "w1": draw(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": draw(HIDDEN, WIDTH), "out": draw(WIDTH, n) * 0.2, "bias": np.log(p / p.sum()).astype(np.float32),
    }


_HIDE = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


@dataclass(frozen=True)
class Lists:
    """The input rows of words, end to end: where each begins and how many it has (one at least)."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def expand(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the words at, end to end, and the number of each."""
        size = self.size[at]
        return self.flat[np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    def steps(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """What step_means() takes the rows of the words at by: the first rows of all, then the second rows of those that have two, and so on.

        rows; the word that each is of, as its place in order; how many have a first row, a second one, ...; order: words by falling size; back:
        the place of each in order; size of each in order. A very long word is no reason for many short steps: None for all but rows, places, size.
        """
        size = self.size[at]
        if (most := int(size.max(initial=1))) > 64:
            rows, size = self.expand(at)
            return rows, np.repeat(np.arange(len(size)), size), None, None, None, size
        order = np.argsort(-size.astype(np.int8), kind="stable")
        size, back = size[order], np.empty_like(order)
        back[order] = np.arange(len(order))
        left = len(at) - np.cumsum(np.bincount(size, minlength=most + 1))[:most]
        first = np.cumsum(left) - left
        place = np.arange(first[-1] + left[-1]) - np.repeat(first, left)
        return self.flat[self.start[at[order]][place] + np.repeat(np.arange(most), left)], place, left, order, back, size

    def all_steps(self, at: np.ndarray, each: int) -> Iterator[tuple[np.ndarray, ...]]:
        """steps() of each group of so many words (the last one may have fewer), found together."""
        groups, group = -(-len(at) // each), np.arange(len(at)) // each
        size = self.size[at]
        long = np.maximum.reduceat(size, np.arange(groups) * each) > 64
        size = np.minimum(size, 64)
        most = int(size.max(initial=1))
        order = np.argsort(group * 128 - size)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        order, back, sorted_at, sizes = order - group * each, back - group * each, at[order], size[order]
        left = np.bincount(group, minlength=groups)[:, None] - np.cumsum(np.bincount(group * (most + 1) + size, minlength=groups * (most + 1)).reshape(groups, -1), axis=1)[:, :most]
        n = left.ravel()
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows = self.flat[self.start[sorted_at[place + np.repeat(np.repeat(np.arange(groups) * each, most), n)]] + np.repeat(np.tile(np.arange(most), groups), n)]
        ends = np.cumsum(left.sum(axis=1)).tolist()
        for g, (first, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            own = slice(g * each, (g + 1) * each)
            yield self.steps(at[own]) if long[g] else (rows[first:end], place[first:end], left[g, : sizes[g * each]], order[own], back[own], sizes[own])

    def vectors(self, emb: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The mean of the rows' vectors of each word at."""
        return step_means(emb, self.steps(at))


def means(emb: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The mean vector of each of the groups of rows that lie end to end."""
    if len(size) > 4096 and size.max() <= 64:  # row by row of all groups
        order, start = np.argsort(-size.astype(np.int8), kind="stable"), np.cumsum(size) - size
        out, left = np.zeros((len(size), emb.shape[1]), emb.dtype), np.cumsum(np.bincount(size)[::-1])[::-1]
        first = start[order]
        for j in range(int(size.max())):
            n = int(left[j + 1])
            out[:n] += emb.take(rows[first[:n] + j], axis=0)
        out /= size[order, None].astype(emb.dtype)
        back = np.empty_like(out)
        back[order] = out
        return back
    return np.add.reduceat(emb.take(rows, axis=0), np.cumsum(size) - size) / size[:, None].astype(emb.dtype)


def step_means(emb: np.ndarray, held: tuple[np.ndarray, ...]) -> np.ndarray:
    """The mean vectors of the words that Lists.steps() gave."""
    rows, _, left, _, back, size = held
    if left is None:
        return means(emb, rows, size)
    got = emb.take(rows, axis=0)
    out, first = got[: len(size)], len(size)
    for n in left[1:].tolist():
        out[:n] += got[first : first + n]
        first += n
    out *= (1 / size).astype(emb.dtype)[:, None]
    return out.take(back, axis=0)


def forward(w: dict[str, np.ndarray], words: Lists, x: np.ndarray, held: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, tuple]:
    """Words (windows, WINDOW) -> (windows, WINDOW, WIDTH) before the output layer; what the gradient needs. held: words.steps(x)."""
    flat = step_means(w["emb"], held or words.steps(x.ravel()))
    e = flat.reshape(*x.shape, WIDTH)
    e += w["pos"]
    mix = _mix(w)
    qkv = (flat @ mix).reshape(*x.shape, -1)
    qkv[..., 3 * WIDTH] = 1  # sums over rows ride along in the products: a column of ones beside the values

    def near() -> np.ndarray:
        out = qkv[..., :WIDTH] @ qkv[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1)
        out += _HIDE
        return out

    a, c, _ = _exps(near(), near, lambda a: a @ qkv[..., 2 * WIDTH :])
    c = c.reshape(-1, WIDTH + 1)
    r = 1 / c[:, WIDTH:]
    c = c[:, :WIDTH] * r
    h = c @ w["o"]
    h += flat
    m = h @ w["w1"]
    m += w["b1"]
    np.maximum(m, 0, out=m)
    y = m @ w["w2"]
    y += h
    return y.reshape(*x.shape, WIDTH), (flat, mix, qkv, a, r, c, h, m)


def _mix(w: dict[str, np.ndarray]) -> np.ndarray:
    """Queries (scaled), keys and values in one product, and a column for ones."""
    return np.concatenate([w["q"] * w["q"].dtype.type(1 / math.sqrt(WIDTH)), w["k"], w["v"], np.zeros((WIDTH, 1), w["q"].dtype)], axis=1)


def log_probs(w: dict[str, np.ndarray], y: np.ndarray) -> np.ndarray:
    z = y @ w["out"] + w["bias"]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


_PLACES = np.arange(N_ROWS * WIDTH).reshape(N_ROWS, WIDTH)


def _tall(a: np.ndarray, b: np.ndarray, piece: int = 256) -> np.ndarray:
    """a @ b for many rows of a, by pieces of so many: BLAS has a quicker path for small products."""
    if len(a) <= piece or len(a) % piece:
        return a @ b
    return (a.reshape(-1, piece, a.shape[1]) @ b).reshape(len(a), b.shape[1])


def _over_rows(a: np.ndarray, b: np.ndarray, piece: int = 128) -> np.ndarray:
    """a.T @ b likewise."""
    if len(a) <= piece or len(a) % piece:
        return a.T @ b
    return (a.reshape(-1, piece, a.shape[1]).transpose(0, 2, 1) @ b.reshape(-1, piece, b.shape[1])).sum(axis=0)


def gradient(w: dict[str, np.ndarray], words: Lists, x: np.ndarray, target: np.ndarray, scored: np.ndarray, held: tuple[np.ndarray, ...] | None = None, measured: bool = True) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the scored positions (if measured) and its gradient. held: words.steps(x)."""
    rows, place, _, order, _, size = held = held or words.steps(x.ravel())
    y, (e, mix, qkv, a, r, c, h, m) = forward(w, words, x, held)
    y, every = y.reshape(-1, WIDTH), bool(scored.all())
    at, t = (slice(None), target.ravel()) if every else (np.flatnonzero(scored), target[scored])
    n, each = max(len(t), 1), np.arange(len(t))
    ys = np.ones((len(t), WIDTH + 1), y.dtype)  # one more for the bias
    ys[:, :WIDTH] = y[at]
    head = np.concatenate([w["out"], w["bias"][None]])
    z, ones = _tall(ys, head), np.ones((head.shape[1], 1), head.dtype)
    aim = z[each, t] if measured else 0.0
    z, total, shift = _exps(z, lambda: ys @ head, lambda z: z @ ones)
    total = total[:, 0]
    loss = float((np.log(total) + np.ravel(shift) - aim).sum()) / n if measured else math.nan
    z[each, t] -= total
    part = (1 / (n * total))[:, None].astype(z.dtype)
    ys *= part
    sums = _over_rows(ys, z)
    g = {"out": sums[:WIDTH], "bias": sums[WIDTH]}
    dy = _tall(z, np.ascontiguousarray(w["out"].T))
    dy *= part
    if not every:
        dy, some = np.zeros_like(y), dy
        dy[at] = some
    g["w2"] = m.T @ dy
    dm = dy @ w["w2"].T
    dm *= m > 0
    g["w1"], g["b1"] = h.T @ dm, np.ones(len(dm), dm.dtype) @ dm
    dh = dm @ w["w1"].T
    dh += dy
    g["o"] = c.T @ dh
    # What a row of the softmax takes off is the product of its result and that one's gradient; it rides along as the ones' column.
    dc = np.empty((len(c), WIDTH + 1), c.dtype)
    np.matmul(dh, w["o"].T, out=dc[:, :WIDTH])
    dc[:, WIDTH] = -np.einsum("ij,ij->i", dc[:, :WIDTH], c)
    dc *= r
    dc = dc.reshape(*x.shape, WIDTH + 1)
    q, k, v1 = qkv[..., :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
    ds = dc @ v1.transpose(0, 2, 1)
    ds *= a
    dqkv = np.empty((*x.shape, 3 * WIDTH), y.dtype)
    np.matmul(ds, k, out=dqkv[..., :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., WIDTH : 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), dc[..., :WIDTH], out=dqkv[..., 2 * WIDTH :])
    dqkv = dqkv.reshape(-1, 3 * WIDTH)
    parts = e.T @ dqkv
    g["q"], g["k"], g["v"] = parts[:, :WIDTH] * y.dtype.type(1 / math.sqrt(WIDTH)), parts[:, WIDTH : 2 * WIDTH], parts[:, 2 * WIDTH :]
    de = dqkv @ mix[:, : 3 * WIDTH].T
    de += dh
    g["pos"] = de.reshape(*x.shape, WIDTH).sum(axis=0)
    if order is not None:
        de = de.take(order, axis=0)
    de = de * (1 / size)[:, None]
    g["emb"] = np.bincount(_PLACES.take(rows, axis=0).ravel(), de.take(place, axis=0).ravel(), w["emb"].size).reshape(w["emb"].shape)
    return loss, g


def windows(lengths: np.ndarray, overlap: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many positions, laid end to end: first position of each window, end of its text, first position to score."""
    step = WINDOW - overlap
    n = np.where(lengths <= WINDOW, 1, 1 + -(-(lengths - WINDOW) // step))
    begin = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = begin[text] + place * step
    return first, (begin + lengths)[text], first + np.where(place > 0, overlap, 0)


def train(w: dict[str, np.ndarray], words: Lists, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray, rate: float = 8e-3, batch: int = 16, seed: int = 0) -> tuple[dict[str, np.ndarray], int]:
    """One pass of Adam over windows (inputs: words, targets: classes, of which the first lengths count); the new weights and the positions seen."""
    shapes = {k: v.shape for k, v in w.items()}
    all_w = np.concatenate([v.ravel() for v in w.values()])
    w = dict(zip(shapes, (p.reshape(s) for p, s in zip(np.split(all_w, np.cumsum([v.size for v in w.values()])[:-1]), shapes.values(), strict=True)), strict=True))  # views
    # mean and square: the running sums of Adam, ten and a hundred times the usual ones.
    mean, square, step, flat = np.zeros_like(all_w), np.zeros_like(all_w), np.empty_like(all_w), np.empty_like(all_w)
    slots = {k: p.reshape(w[k].shape) for k, p in zip(w, np.split(flat, np.cumsum([v.size for v in w.values()])[:-1]), strict=True)}
    order = np.random.default_rng(seed).permutation(len(inputs))
    steps, inside = -(-len(order) // batch), np.arange(WINDOW) < lengths[:, None]
    for i in range(steps):
        if i % 64 == 0:
            held = words.all_steps(inputs[order[i * batch : (i + 64) * batch]].ravel(), batch * WINDOW)
        part = order[i * batch : (i + 1) * batch]
        _, g = gradient(w, words, inputs[part], targets[part], inside[part], next(held), measured=False)
        now = rate * min(1.0, (i + 1) / 20) * (1 - 0.9 * i / steps)
        for k, slot in slots.items():
            slot[...] = g[k]
        mean *= 0.9
        mean += flat
        flat *= flat
        square *= 0.99
        square += flat
        np.sqrt(square, out=step)
        size = math.sqrt(0.01 / (1 - 0.99 ** (i + 1)))
        step += 1e-8 / size
        np.divide(mean, step, out=step)
        step *= now * 0.1 / ((1 - 0.9 ** (i + 1)) * size)
        all_w -= step
    return w, int(lengths.sum())


def _exps(z: np.ndarray, again: Callable[[], np.ndarray], sums: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(z - shift) in place, sums() of it, of which the last column has the rows' own, and the shift: none where no sum is very large or small.

    Where one is, again() makes z once more.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        got = sums(np.exp(z, out=z))
    if got[..., -1].min(initial=1.0) > 1e-20 and got[..., -1].max(initial=1.0) < 1e20:
        return z, got, 0.0
    z = again()
    shift = z.max(axis=-1, keepdims=True)
    z -= shift
    return z, sums(np.exp(z, out=z)), shift


class Reader:
    """The network, ready to score: the vectors of words as a growing table."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.qkv = w, _mix(w)
        self.head, self.o = np.concatenate([w["out"], w["bias"][None]]), np.concatenate([w["o"], np.zeros((1, WIDTH), np.float32)])
        self.ones = np.ones((self.head.shape[1], 1), np.float32)
        self.clear()

    def clear(self) -> None:
        self.table, self.n = np.zeros((1024, WIDTH), np.float32), 0

    def add(self, vectors: np.ndarray) -> None:
        end = self.n + len(vectors)
        if end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(end, len(self.table) * 3 // 2) - len(self.table), WIDTH), np.float32)])
        self.table[self.n : end], self.n = vectors, end

    def nll(self, words: np.ndarray, classes: np.ndarray, lengths: np.ndarray, batch: int = 64) -> np.ndarray:
        """Of each text, the sum of -log P(class) over its tokens and the end: forward(), without what only the gradient needs.

        words: table rows of the texts' tokens, end to end (row 0 is the end); classes: theirs.
        """
        w, before = self.w, np.cumsum(lengths)
        inputs, targets = np.insert(words, before - lengths, 0), np.insert(classes, before, 0)
        first, stop, scored_from = windows(lengths + 1)
        text = np.repeat(np.arange(len(lengths)), lengths + 1)
        steps, out = np.arange(WINDOW), np.zeros(len(inputs))
        later, full = scored_from > first, first + WINDOW <= stop
        # Windows of one kind go together: those that begin a text, or only read the first positions; those that a text fills, or not.
        for lead, whole in itertools.product((0, CONTEXT), (True, False)):
            kind = np.flatnonzero((later == (lead > 0)) & (full == whole))
            for i in range(0, len(kind), batch):
                at = first[kind[i : i + batch]][:, None] + steps
                end = stop[kind[i : i + batch]][:, None]
                e = self.table.take(inputs.take(at if whole else np.minimum(at, end - 1)), axis=0)
                e += w["pos"]
                x = (e.reshape(-1, WIDTH) @ self.qkv).reshape(*at.shape, -1)
                x[..., 3 * WIDTH] = 1  # sums over rows ride along in the products: a column of ones beside the values

                def near(x=x, lead=lead) -> np.ndarray:
                    s = x[:, lead:, :WIDTH] @ x[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1)
                    s += _HIDE[lead:]
                    return s

                _, c, _ = _exps(near(), near, lambda a, x=x: a @ x[..., 2 * WIDTH :])
                c, h, place = c.reshape(-1, WIDTH + 1), e[:, lead:].reshape(-1, WIDTH), at[:, lead:].ravel()
                if not whole:
                    scored = np.flatnonzero((at < end)[:, lead:])
                    c, h, place = c.take(scored, axis=0), h.take(scored, axis=0), place.take(scored)
                read = c @ self.o
                read *= 1 / c[:, WIDTH:]
                h += read
                m = h @ w["w1"]
                m += w["b1"]
                y = np.ones((len(h), WIDTH + 1), np.float32)  # one more for the bias
                np.add(h, np.maximum(m, 0, out=m) @ w["w2"], out=y[:, :-1])
                z = _tall(y, self.head)
                aim = z[np.arange(len(place)), targets.take(place)].astype(np.float64)
                _, total, shift = _exps(z, lambda y=y: y @ self.head, lambda z: z @ self.ones)
                out[place] = np.log(total[:, 0]) + np.ravel(shift) - aim
        return np.bincount(text, out, len(lengths))


@dataclass(frozen=True)
class Model:
    """counts: the word counts of the corpus (word, n); frequent: those sent to the tasks, all of them if whole; ends: texts learnt from."""

    weights: dict[str, np.ndarray]
    classes: Classes
    shares: Shares
    counts: DataFrame
    tokens: int
    distinct: int
    frequent: dict[bytes, int]
    whole: bool
    ends: int


def _listed(frequent: dict[bytes, int]) -> tuple[pa.Array, np.ndarray]:
    """Words and counts, by falling count: what is read most lies together, and tasks hold no object per word."""
    counts = np.fromiter(frequent.values(), np.int64, len(frequent))
    order = np.argsort(-counts, kind="stable")
    return pa.array(list(frequent), pa.binary()).take(pa.array(order)), counts[order]


class _Words:
    """The different words of a group of texts: classes, input rows and, if there are shares, log shares and base terms.

    END comes first, then the frequent words, which are looked at once, then those of the group that are none of them.
    """

    def __init__(self, classes: Classes, frequent: dict[bytes, int] | tuple[pa.Array, np.ndarray], shares: Shares | None = None, weights: dict[str, np.ndarray] | None = None):
        self.pieces, self.classes, self.shares = pieces_of(classes.ranks), classes, shares
        self.reader = Reader(weights) if weights else None
        self.frequent, counts = _listed(frequent) if isinstance(frequent, dict) else frequent
        ends = counts[pc.binary_length(self.frequent).to_numpy(zero_copy_only=False) == 0].sum()
        self.kept = self._made(pa.concat_arrays([pa.array([END.encode()], pa.binary()), self.frequent]), np.append(ends, counts))
        self._hold(self.kept)

    def _made(self, words: pa.Array, counts: np.ndarray) -> dict[str, np.ndarray]:
        """What is known of each word."""
        flat, sizes = self.pieces.of(words)
        rows, size = self.classes.rows[flat], np.maximum(sizes, 1)
        if (none := np.flatnonzero(sizes == 0)).size:
            rows = np.insert(rows, (np.cumsum(sizes) - sizes)[none], 0)  # the end's own row
        out = {"flat": rows, "size": size}
        if self.shares:
            full = rows if not none.size else self.classes.rows[flat]
            cls = self.classes.of(words, flat, sizes)
            spelled = self.shares.spelled(cls, flat, full, sizes)
            out |= {"cls": cls, "count": counts, "spelled": spelled, "inside": self.shares.inside(cls, counts, spelled)}
        else:
            out["single"] = self.classes.single(words)
        if self.reader:
            out["vectors"] = means(self.reader.w["emb"], rows, size)
        return out

    def _hold(self, got: dict[str, np.ndarray]) -> None:
        self.flat, self.size = got["flat"], got["size"]
        self.start = np.cumsum(self.size) - self.size
        for k in ("cls", "count", "spelled", "inside", "single"):
            setattr(self, k, got.get(k))
        if self.reader:
            self.reader.table = got["vectors"]

    def look(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """The place of each word (none is END) among the different ones; those of the group before are no longer held."""
        coded = pa.array(words, pa.binary()).dictionary_encode() if isinstance(words, list) else words.dictionary_encode()
        place = 1 + pc.fill_null(pc.index_in(coded.dictionary, value_set=self.frequent), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place == 0)
        place[new] = 1 + len(self.frequent) + np.arange(len(new))
        self.rest = coded.dictionary.take(pa.array(new))
        made = self._made(self.rest, np.zeros(len(new), np.int64))
        self._hold({k: np.concatenate([v, made[k]]) for k, v in self.kept.items()})
        return place[coded.indices.to_numpy(zero_copy_only=False)]

    def __len__(self) -> int:
        return len(self.size)

    def unheard(self, places: np.ndarray) -> pa.Array:
        """The words at these places, none of which is a frequent one."""
        return self.rest.take(pa.array(places - 1 - len(self.frequent)))

    @property
    def lists(self) -> Lists:
        return Lists(self.flat, self.start, self.size)


_workers: dict[str, _Words] = {}


def _worker(name: str, *tools) -> _Words:
    """The process's tools for one model: a later task of the same worker goes on with them."""
    if name not in _workers:
        _workers.clear()
        _workers[name] = _Words(*tools)
    return _workers[name]


def _dealt(sizes: np.ndarray, rng: np.random.Generator, share: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that are drawn from texts of so many words: text, number in it, tokens (ends included), turn."""
    n = -(-(sizes + 1) // WINDOW)
    turn = (rng.random(n.sum()) * (rounds / share)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    drawn = turn < rounds
    text, place = text[drawn], place[drawn]
    return text, place, np.minimum(sizes[text] + 1 - place * WINDOW, WINDOW), turn[drawn]


def draw_windows(docs: DataFrame, text: str = "text", share: float = 1.0, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """turn, words: the windows of the texts, or a share of them, dealt to the rounds.

    words: the word before the window (none at the beginning of a text) and those in it, blanks between them; the end is an empty word.
    Draws go by the row's place in its partition, so copies of a text are drawn apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng((seed, TaskContext.get().partitionId()))
        for b in batches:
            texts = [[b"", *text_words(t.as_py()), b""] for t in _binary(b.column(0))]
            text, place, _, turn = _dealt(np.array([len(t) - 2 for t in texts], np.int64), rng, share, rounds)
            found = [b" ".join(texts[t][k * WINDOW : (k + 1) * WINDOW + 1]) for t, k in zip(text.tolist(), place.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(turn, pa.int32()), pa.array(found, pa.binary())], names=["turn", "words"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "turn int, words binary")


#: Columns of coded windows with the kinds of their numbers: tokens of each window, then its words as places (one more than tokens: the word
#: before is the first); of each different word the number of its rows, its rows, and its class if it is one by itself, else -1.
CODED = {"tokens": np.uint8, "words": np.uint16, "sizes": np.uint32, "rows": np.uint16, "single": np.int16}


def code_windows(docs: DataFrame, classes: Classes, text: str = "text", share: float = 1.0, rounds: int = ROUNDS, seed: int = 0, frequent: dict[bytes, int] | None = None) -> DataFrame:
    """The windows that draw_windows() draws, PACK at most to a row, with input rows for words: turn, n (windows), CODED."""
    shared, name = docs.sparkSession.sparkContext.broadcast((classes, _listed(frequent or {}))), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, words = np.random.default_rng((seed, TaskContext.get().partitionId())), _worker(name, *shared.value)
        for _, found, sizes in _groups(batches, "text"):
            at, ends = words.look(found), np.cumsum(sizes)
            padded = np.zeros(len(at) + len(sizes) + 1, np.int64)  # an end before each text and after the last one
            padded[np.arange(len(at)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = at
            lists, single = words.lists, words.single
            text, place, tokens, turn = _dealt(sizes, rng, share, rounds)
            first = (ends - sizes)[text] + text + place * WINDOW
            out, met, number = [], np.zeros(len(words), bool), np.zeros(len(words), np.int64)
            for r in range(rounds):
                of = np.flatnonzero(turn == r)
                for k in range(0, len(of), PACK):
                    part = of[k : k + PACK]
                    size = tokens[part] + 1
                    where = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    met[padded[where]] = True
                    held = np.flatnonzero(met)
                    met[held], number[held] = False, np.arange(len(held))
                    entry = number[padded[where]]
                    rows, n = lists.expand(held)
                    coded = zip((tokens[part], entry, n, rows, single[held]), CODED.values(), strict=True)
                    out.append((r, len(part), *(x.astype(kind).tobytes() for x, kind in coded)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=pa.schema([("turn", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in CODED)]))

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "turn bigint, n bigint, " + ", ".join(f"{c} binary" for c in CODED))


@dataclass(frozen=True)
class Coded:
    """Windows: tokens of each, words end to end (one more than tokens each) as places in lists and single."""

    tokens: np.ndarray
    words: np.ndarray
    lists: Lists
    single: np.ndarray


def _coded(b: pa.RecordBatch) -> Coded:
    """The windows of the rows of code_windows() together."""
    got = {c: [np.frombuffer(x.as_py(), kind) for x in b.column(c)] for c, kind in CODED.items()}
    different = np.array([len(x) for x in got["sizes"]])
    begin, entries = np.cumsum(different) - different, [len(x) for x in got["words"]]
    tokens, words, size, rows, single = (np.concatenate(x).astype(np.int64) for x in got.values())
    return Coded(tokens, words + np.repeat(begin, entries), Lists(rows, np.cumsum(size) - size, size), single)


def _met(drawn: DataFrame) -> np.ndarray:
    """(rows, SINGLES): how often each input row stands in a window with each single word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros(N_ROWS * SINGLES), []
        for b in batches:
            for i in range(len(b)):
                c = _coded(b.slice(i, 1))
                window = np.repeat(np.arange(len(c.tokens)), c.tokens + 1)
                rows, size = c.lists.expand(c.words)
                has, near = np.zeros((len(c.tokens), N_ROWS), bool), np.zeros((len(c.tokens), SINGLES), bool)
                has[np.repeat(window, size), rows] = True
                single = c.single[c.words]
                near[window[single >= 0], single[single >= 0]] = True
                # Each different row of a window meets each different single word of it.
                (window, row), n = np.divmod(np.flatnonzero(has), N_ROWS), near.sum(axis=1)
                first, n = (np.cumsum(n) - n)[window], n[window]
                place = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                held.append(np.repeat(row * SINGLES, n) + (np.flatnonzero(near) % SINGLES)[place])
                if sum(map(len, held)) > 1 << 20:
                    sums += np.bincount(np.concatenate(held), minlength=len(sums))
                    held = []
        if held:
            sums += np.bincount(np.concatenate(held), minlength=len(sums))
        yield _slices(dict(enumerate(np.array_split(sums, SLICES))))

    got = _summed(drawn.select(*CODED).mapInArrow(run, "slice int, x binary"))
    return (np.zeros(N_ROWS * SINGLES) if got is None else got).reshape(N_ROWS, SINGLES)


def count_shares(counts: DataFrame, classes: Classes, id_counts: np.ndarray) -> Shares:
    """Tokens, different words and their spellings by class, over all words of counts."""
    shared = counts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, pieces = shared.value, pieces_of(shared.value.ranks)
        for b in batches:
            words = _binary(b.column(0))
            flat, sizes = pieces.of(words)
            cls = classes.of(words, flat, sizes)
            inner = np.repeat(cls >= SINGLES, sizes)
            steps = spelling_keys(cls[cls >= SINGLES] - SINGLES, classes.rows[flat[inner]], sizes[cls >= SINGLES])
            for what, (keys, n) in enumerate(((cls, np.asarray(b.column(1))), (cls, np.ones(len(cls))), (steps, np.ones(len(steps))))):
                key, place = np.unique(keys, return_inverse=True)
                sums = np.bincount(place, n, len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), what)), pa.array(key), pa.array(sums)], names=["what", "key", "n"])

    got = counts.select("word", "n").mapInArrow(run, "what bigint, key bigint, n bigint").groupBy("what", "key").agg(F.sum("n").alias("n")).orderBy("what", "key").toArrow()
    what, key, n = (np.asarray(got[c]) for c in ("what", "key", "n"))
    by_class = [np.bincount(key[what == k], n[what == k], N_CLASSES).astype(np.int64) for k in (0, 1)]
    return Shares.make(*by_class, key[what == 2], n[what == 2], id_counts, classes.rows)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with n windows each, gathered to at least TASK_WINDOWS or what is left."""
    held, n = [], 0
    for b in batches:
        for i in range(len(b)):
            held.append(b.slice(i, 1))
            n += b.column("n")[i].as_py()
            if n >= TASK_WINDOWS:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _slices(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "x"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the doubles of each slice, of which there are few and of bounded size."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(x.as_py())
            sums[i] = sums[i] + x if i in sums else x
    yield _slices(sums)


def _summed(found: DataFrame) -> np.ndarray | None:
    """The sum of the arrays that tasks gave in _slices(); None if there are none."""
    got = found.repartition("slice").mapInArrow(_added, "slice int, x binary").collect()
    return np.concatenate([np.frombuffer(r["x"]) for r in sorted(got, key=lambda r: r["slice"])]) if got else None


def learn(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, rounds: int = ROUNDS, share: float = 1.0, seed: int = 0) -> Model:
    """The model and the word counts of docs, all rows of which are training texts. An empty table gives a model that knows no word."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    sc = docs.sparkSession.sparkContext
    counts = checkpoint(count_words(docs, text))
    tokens, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
    # The least count that leaves at most FREQUENT words, from the number of words of each count.
    left, least = 0, 1 << 62
    for n, words in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        left += words
        if left > FREQUENT:
            break
        least = n
    top = counts.where(F.col("n") >= least).toArrow()
    frequent = {w.encode(): n for w, n in zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)}
    most = [r["word"].encode() for r in counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(SINGLES - 1).collect()]
    singles = {w: i for i, w in enumerate([b"", *most])}
    ids = count_ids(counts, ranks)
    classes = Classes(ranks, singles, input_rows(ids), np.zeros((N_ROWS, CLUSTERS), np.float32), np.zeros(CLUSTERS, np.float32))
    # Windows of a part come from many texts. There are no more of them than one to so many tokens and one to a text.
    parts = -(-(tokens // WINDOW + ends) // (TASK_WINDOWS * rounds))
    drawn, drop = store(code_windows(docs, classes, text, share, rounds, seed, frequent).repartition(max(1, int(parts))), "lm_windows")
    classes = Classes(ranks, singles, classes.rows, *make_clusters(_met(drawn)))
    shares = count_shares(counts, classes, ids)
    weights = start_weights(shares.n)

    shapes = {k: v.shape for k, v in weights.items()}
    tools = sc.broadcast(Classes(b"", {}, classes.rows, classes.points, classes.level))
    for turn in range(rounds):
        now = sc.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            total, seen = 0.0, 0
            for b in _runs(batches):
                c = _coded(b)
                cls = np.where(c.single >= 0, c.single, tools.value.clusters(c.lists.flat, c.lists.size))
                inside = np.arange(WINDOW) < c.tokens[:, None]
                inputs, targets = np.zeros((2, *inside.shape), np.int64)
                ends = np.cumsum(c.tokens + 1)
                inputs[inside], targets[inside] = np.delete(c.words, ends - 1), cls[np.delete(c.words, ends - c.tokens - 1)]
                new, n = train(now.value, c.lists, inputs, targets, c.tokens, seed=turn)
                total, seen = total + n * np.concatenate([new[k].ravel() for k in shapes]).astype(np.float64), seen + n
            if seen:
                yield _slices(dict(enumerate(np.array_split(np.append(total, seen), SLICES))))  # the last one counts

        flat = _summed(drawn.where(F.col("turn") == turn).select("n", *CODED).mapInArrow(run, "slice int, x binary"))
        if flat is not None:
            cuts = np.cumsum([math.prod(s) for s in shapes.values()])[:-1]
            weights = {k: v.reshape(s) for (k, s), v in zip(shapes.items(), np.split((flat[:-1] / flat[-1]).astype(np.float32), cuts), strict=True)}
    drop()
    return Model(weights, classes, shares, counts, int(tokens), int(distinct), frequent, len(frequent) == distinct, int(ends))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of docs but the text, and n_tokens, n_known, train_tokens, base_score, score (replaced if there).

    One row per row of docs; a null text is empty and has its end alone; repeated rows are scored each. Sums are in log10.
    """
    sc = docs.sparkSession.sparkContext
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    own = [f for f in docs.schema.fields if f.name != text and f.name not in made]
    read = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in own]).alias("row") if own else F.lit(0).alias("row"), F.monotonically_increasing_id().alias("row_id"), F.col(f"`{text}`").alias("text"))
    shared, name, whole = sc.broadcast((model.classes, _listed(model.frequent), model.shares, model.weights)), uuid.uuid4().hex, model.whole
    end_count, ln10 = model.ends, math.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker(name, *shared.value)
        for part, found, n in _groups(batches, "text"):
            at, text_of = words.look(found), np.repeat(np.arange(len(n)), n)
            c = words.count[at]
            known = np.bincount(text_of, c > 0, len(n)).astype(np.int64) + (end_count > 0)
            base = np.bincount(text_of, np.log10(words.count + 1.0)[at], len(n)) + math.log10(end_count + 1)
            total = (np.bincount(text_of, words.inside[at], len(n)) - words.reader.nll(at, words.cls[at], n)) / ln10
            # The words that the task knows no count of, each once for each text.
            unknown = (c == 0) & (not whole)
            pair, times = np.unique(text_of[unknown] * len(words) + at[unknown], return_counts=True)
            word = pair % len(words)
            rare = pa.StructArray.from_arrays([words.unheard(word).cast(pa.string()), pa.array(times), pa.array(words.spelled[word])], names=["word", "n", "spelled"])
            ends = np.searchsorted(pair // len(words), np.arange(len(n) + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n + 1), pa.array(known), pa.array(base), pa.array(total), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)], names=["row", "row_id", "n_tokens", "n_known", "base", "score", "rare"])

    kind = read.schema["row"].dataType.simpleString()
    found = read.mapInArrow(run, f"row {kind}, row_id bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<word:string,n:bigint,spelled:double>>")
    if not whole:
        found = checkpoint(found)
        each = found.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", F.col("r.n").alias("times"), "r.spelled")
        least = min(model.frequent.values(), default=1 << 62)
        met = each.join(model.counts.where(F.col("n") < least).hint("shuffle_hash"), "word")  # none of these words is frequent, so no part is large
        # What the counts add to the terms that the tasks gave the words as unheard of.
        gain = F.when(F.col("spelled") > 0, F.log10(1 + F.col("n") / F.nullif("spelled", F.lit(0.0)))).otherwise(0.0)  # a class of one word: none
        met = met.groupBy("row_id").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("terms"), F.sum(F.col("times") * gain).alias("gain"))
        found = found.join(met, "row_id", "left")
        found = found.withColumn("n_known", F.col("n_known") + F.coalesce("more", F.lit(0))).withColumn("base", F.col("base") + F.coalesce("terms", F.lit(0.0))).withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0)))
    base = F.col("base") - F.col("n_tokens") * math.log10(model.tokens + model.distinct + 1)
    return found.select(*([f"row.`{f.name}`" for f in own]), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
