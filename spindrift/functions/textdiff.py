"""Line diffs that must equal those of Python's own matcher, as Arrow-batched functions.

Rows that are equal never reach them: the operators filter first. All take (before, after) text columns; null is empty.
"""

from __future__ import annotations

import difflib
import functools

import pandas as pd
from pyspark.sql import functions as F

def _arrow(returns: str):
    """A pandas function as a column function; made at its first use, as types are parsed by a session."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, returns)(*columns)

        return call

    return wrap


SPANS = "array<struct<span_before:string,span_after:string>>"
#: With positions in lines of the old text, by which edits can be applied without searching.
PLACED = "array<struct<at:int,n:int,span_before:string,span_after:string>>"


def opcodes(before: list[str], after: list[str]) -> list[tuple[str, int, int, int, int]]:
    return [o for o in difflib.SequenceMatcher(None, before, after, autojunk=False).get_opcodes() if o[0] != "equal"]


def changed(before: str, after: str) -> tuple[list[int], list[int]]:
    """Changed lines of either side; all lines if the texts differ but no line does."""
    a, b = before.splitlines(), after.splitlines()
    ops = opcodes(a, b)
    x = sorted({i for _, i1, i2, _, _ in ops for i in range(i1, i2)})
    y = sorted({j for _, _, _, j1, j2 in ops for j in range(j1, j2)})
    return (list(range(len(a))), list(range(len(b)))) if not x and not y and before != after else (x, y)


def window(text: str, at: list[int], context: int = 2) -> str:
    """One stretch of lines around all the given ones."""
    ls = text.splitlines()
    return "\n".join(ls[max(0, at[0] - context) : at[-1] + context + 1]) if at else ""


def edits(before: str, after: str) -> list[dict]:
    """Every stretch of lines that differs, with its line ends, and where it is; one edit if either side is empty."""
    if not before or not after:
        return [{"at": 0, "n": len(before.splitlines()), "span_before": before, "span_after": after}] if before or after else []
    a, b = before.splitlines(keepends=True), after.splitlines(keepends=True)
    return [{"at": i1, "n": i2 - i1, "span_before": "".join(a[i1:i2]), "span_after": "".join(b[j1:j2])} for _, i1, i2, j1, j2 in opcodes(a, b)]


def full_diff(before: str, after: str, file: str) -> str:
    """With file names and context; lines keep their ends, so they are double-spaced when joined."""
    return "\n".join(difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), f"a/{file}", f"b/{file}", lineterm=""))


def simple_diff(before: str, after: str) -> str:
    """Hunk headers and changed lines only."""
    return "\n".join(list(difflib.unified_diff(before.splitlines(), after.splitlines(), lineterm="", n=0))[2:])


def exact_range(before: str, after: str) -> tuple[int, int, int, int]:
    """First and behind the last changed line of either side, split at line feeds; a side without any counts as a whole."""
    a, b = before.split("\n"), after.split("\n")
    ops = opcodes(a, b)
    x, y = [o for o in ops if o[2] > o[1]], [o for o in ops if o[4] > o[3]]
    old = (x[0][1], x[-1][2]) if x else (0, len(a))
    new = (y[0][3], y[-1][4]) if y else (0, len(b))
    return (*old, *new)


def apply_placed(before: str, placed: list[dict]) -> str:
    """Applies edits() by their places; the inverse of taking them."""
    ls = before.splitlines(keepends=True)
    for e in sorted(placed, key=lambda e: -e["at"]):
        ls[e["at"] : e["at"] + e["n"]] = [e["span_after"]]
    return "".join(ls)


def _texts(*columns: pd.Series):
    return zip(*(c.fillna("") for c in columns), strict=True)


@_arrow("struct<before:array<int>,after:array<int>>")
def changed_lines(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([changed(a, b) for a, b in _texts(before, after)], columns=["before", "after"], dtype=object)


@_arrow("struct<before:string,after:string>")
def diff_span(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """The context window of either side around its changed lines."""
    found = [(changed(a, b), a, b) for a, b in _texts(before, after)]
    return pd.DataFrame([(window(a, x), window(b, y)) for (x, y), a, b in found], columns=["before", "after"], dtype=object)


@_arrow(PLACED)
def edit_spans(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([edits(a, b) for a, b in _texts(before, after)])


@_arrow("string")
def unified_diff(before: pd.Series, after: pd.Series, file: pd.Series) -> pd.Series:
    return pd.Series([full_diff(a, b, f) for a, b, f in _texts(before, after, file)])


@_arrow("string")
def simple_unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([simple_diff(a, b) for a, b in _texts(before, after)])


@_arrow("struct<before_start:int,before_end:int,after_start:int,after_end:int>")
def exact_change(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([exact_range(a, b) for a, b in _texts(before, after)], columns=["before_start", "before_end", "after_start", "after_end"])


@_arrow("string")
def apply_edit_places(before: pd.Series, placed: pd.Series) -> pd.Series:
    return pd.Series([apply_placed(a or "", list(p) if p is not None else []) for a, p in zip(before, placed, strict=True)])


@_arrow("double")
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in _texts(a, b)])


@_arrow("string")
def indented_json(edits_json: pd.Series) -> pd.Series:
    import json

    return pd.Series([json.dumps(json.loads(x), indent=2) if x else "[]" for x in edits_json])
