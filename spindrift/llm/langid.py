"""Language identification by rank-order n-gram profiles (operator 1).

A profile is the list of the most frequent character n-grams of a language in order of frequency, letters lower-cased and everything
else one blank. A document's own list is compared with each profile: the out-of-place distance adds, over the document's n-grams, how
far the rank differs, and the length of the profile for one that the profile lacks. The nearest profile is the language.

N-grams of up to ``MAX_N`` letters are packed into 64-bit numbers, so a document is one sort. Profiles are counted on the executors
over a bounded sample of labelled rows and cut to their length before they reach the driver; prediction maps over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Longest n-gram, n-grams to a profile, and labelled documents to a language (expected number, drawn by a hash) to learn from.
MAX_N, PROFILE, SAMPLE = 3, 400, 3000
#: Languages beyond this number are refused: every task holds all profiles.
MAX_LANGS = 5000
#: N-grams to a piece while counting; the pieces of one text are added up.
PIECE = 1 << 18


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 for what isn't a letter."""
    return np.array([ord(low) if (c := chr(i)).isalpha() and len(low := c.lower()) == 1 else (i if c.isalpha() else 0) for i in range(0x110000)], np.uint64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the text, packed by 21 bits a character, and their counts; a blank alone is none."""
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = c[(c != 0) | np.append(True, c[:-1] != 0)]  # a run of anything else is one blank
    if not c.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.concatenate((np.zeros(int(c[0] != 0), np.uint64), c, np.zeros(int(c[-1] != 0), np.uint64)))
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(c), PIECE):
        part = c[at : at + PIECE + MAX_N - 1]
        first = part[:PIECE]
        parts, packed = [first[first != 0]], part
        for n in range(2, MAX_N + 1):
            packed = (packed[:-1] << np.uint64(21)) | part[n - 1 :]
            # Odd lengths differ by their leading bits, as two blanks never meet; pairs are marked.
            parts.append(packed[:PIECE] if n > 2 else packed[:PIECE] | np.uint64(1 << 63))
        seen.append(np.unique(np.concatenate(parts), return_counts=True))
    if len(seen) == 1:
        return seen[0]
    keys, place = np.unique(np.concatenate([k for k, _ in seen]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in seen])).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, in order; ties by their number."""
    if len(keys) > 4 * most:  # only those that can be among the first
        least = np.partition(counts, -most)[-most]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:most]]


def learn_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", key: str | None = None, per_lang: int = SAMPLE, most: int = PROFILE) -> dict[str, np.ndarray]:
    """The n-grams of each language by rank. docs: the labelled rows to learn from; rows with a null label or text are left out.

    About per_lang rows of each language, drawn by a hash of the text and the key (an id column; without one, of the text alone), are
    counted, so copies of a text are drawn one by one and a language of nothing but copies is learnt as well. Ties in frequency go by
    the n-gram.
    """
    own = F.col(f"`{key}`").cast("string") if key else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), own.alias("id")).where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return {}
    share = F.broadcast(rows.sparkSession.createDataFrame([(k, per_lang / n) for k, n in sizes.items()], "lang string, share double"))
    picked = rows.join(share, "lang").where((F.xxhash64("text", "id").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))) < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for b in batches:
            for lang_of, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = sums.setdefault(lang_of, {})
                for k, n in zip(*(x.tolist() for x in grams(t.as_py())), strict=True):
                    own[k] = own.get(k, 0) + n
        for lang_of, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang_of] * len(own), pa.string()), pa.array(np.fromiter(own, np.uint64, len(own)).view(np.int64)), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = picked.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found: dict[str, list[int]] = {}
    for r in counted.withColumn("place", place).where(F.col("place") <= most).orderBy("lang", "place").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in found.items()}


class Profiles:
    """Looks n-grams up in all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], most: int = PROFILE):
        self.langs, self.most = sorted(profiles), most
        self.keys = np.unique(np.concatenate([np.empty(0, np.uint64), *profiles.values()]))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)  # the last row: in no profile
        for i, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, profiles[lang]), i] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): und and 0 for a text without a letter or without profiles; ties go to the first by code point.

        score: one less the distance's share of the largest possible one.
        """
        keys, counts = grams(text or "")
        if not len(keys) or not self.langs:
            return "und", 0.0
        own = ranked(keys, counts, self.most)
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == own, at, len(self.keys))
        rank = self.ranks[at]
        d = np.where(rank < 0, self.most, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(d))
        return self.langs[best], 1.0 - float(d[best]) / (self.most * len(own))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", most: int = PROFILE, keep_text: bool = True) -> DataFrame:
    """The columns of docs (without the text if it isn't kept) and lang_pred, score (replaced if there).

    Null and letterless texts: und, 0.0. One row per row; an empty table gives an empty result.
    """
    read = docs.drop("lang_pred", "score")
    kept = [f for f in read.schema.fields if keep_text or f.name != text]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles, most)
        for b in batches:
            column = lambda n: b.column(b.schema.get_field_index(n))  # noqa: B023, E731
            found = [known.predict(t.as_py()) for t in column(text)]
            yield pa.RecordBatch.from_arrays([*map(column, names), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return read.mapInArrow(run, schema)
