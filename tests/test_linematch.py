"""Blocks of equal lines against Python's matcher."""

import difflib
import random
import time

import pytest
from test_textdiff import CASES

from spindrift.functions import textdiff
from spindrift.operators import linematch


def wanted(pairs):
    return {(k, *m) for k, a, b in pairs for m in difflib.SequenceMatcher(None, a or [], b or [], autojunk=False).get_matching_blocks()[:-1]}


def edited(rng, n, alphabet):
    a = [f"l{rng.randrange(alphabet)}" for _ in range(n)]
    b = list(a)
    for _ in range(rng.randrange(1, 8)):
        at, size = rng.randrange(len(b) + 1), rng.randrange(6)
        if rng.random() < 0.5:
            b[at : at + size] = [f"l{rng.randrange(alphabet)}" for _ in range(rng.randrange(5))]
        else:
            part = b[at : at + size]
            del b[at : at + size]
            b[(to := rng.randrange(len(b) + 1)) : to] = part
    return a, b


@pytest.mark.parametrize(("short", "most_pairs"), [(10**6, 10**6), (0, 10**6), (12, 10**6), (12, 150)])
def test_blocks_are_the_matchers(spark, short, most_pairs):
    """By one task, by rounds alone, by rounds and tasks, and with texts whose lines repeat too often for rounds."""
    rng = random.Random(1)
    pairs = [(k, *edited(rng, rng.randrange(1, 40), rng.choice([3, 12, 1000]))) for k in range(60)]
    pairs += [(100, [], ["x"]), (101, None, None), (102, ["x"] * 9, ["x"] * 4), (103, ["a"], ["a"]), (104, list("abxcd"), list("abcd"))]
    df = spark.createDataFrame(pairs, "key long, a array<string>, b array<string>")
    got = [tuple(r) for r in linematch.matching_blocks(df, short, most_pairs).select("key", "i", "j", "n").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted(pairs)


@pytest.mark.parametrize("short", [10**6, 3])
def test_changed_lines_of_the_golden_cases(spark, short):
    texts = [(k, c[0], c[1]) for k, c in CASES.items()] + [("ends", "a\r\nb\x0bc\u2028d", "a\nb\nc\nd\n"), ("null", None, "x"), ("same", "q\n", "q\n"), ("empty", "", "")]
    df = spark.createDataFrame(texts, "key string, before string, after string")
    got = {r.key: (r.before, r.after) for r in linematch.changed_lines(df, short).collect()}
    assert got == {k: textdiff.changed(a or "", b or "") for k, a, b in texts}


def test_long_texts(spark):
    """Three hundred thousand lines and a few hundred changes, matched by rounds; the parts are checked by what they must be."""
    rng = random.Random(2)
    a = [f"{i} {rng.getrandbits(30)}" for i in range(300_000)]
    b = list(a)
    for at in sorted(rng.sample(range(300_000), 12), reverse=True):
        b[at : at + 1] = ["new", "lines"] if rng.random() < 0.5 else []
    df = spark.createDataFrame([(1, "\n".join(a), "\n".join(b))], "key int, before string, after string")
    began = time.time()
    r = linematch.changed_lines(df).first()
    assert [x for i, x in enumerate(a) if i not in set(r.before)] == [x for i, x in enumerate(b) if i not in set(r.after)]
    assert len(r.before) == 12 and all(b[i] in ("new", "lines") for i in r.after)
    assert time.time() - began < 120
