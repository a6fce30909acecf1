"""Items of Rust sources by a small scanner: a lexer that knows comments, strings, lifetimes and raw forms, and a walk over its tokens.

An item's id is file::[parent::]kind::name; the parent is the nearest struct, impl, trait or mod. The name of an impl is the type that it is
for. A file with any use, extern crate or attribute also has a module row. Macro calls are not looked into.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import used_imports

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?r(?P<hash>\#*)"(?:.|\n)*?"(?P=hash))|(?P<string>[bc]?"(?:\\(?:.|\n)|[^"\\])*")"""
    r"""|(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^\\'\n])')|(?P<life>'[A-Za-z_]\w*)|(?P<word>r\#\w+|[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>.)""",
    re.X,
)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
#: The kind of an item as its id has it, and the node type that its row names (fixed values).
KINDS = {
    "struct": "struct_item", "enum": "enum_item", "union": "union_item", "trait": "trait_item", "mod": "mod_item", "const": "const_item", "static": "static_item", "type": "type_item",
    "impl": "impl_item", "function": "function_item", "function_signature": "function_signature_item", "foreign_mod": "foreign_mod_item", "macro": "macro_definition",
}
#: Keywords that begin an item and are followed by its name.
NAMED = ("struct", "enum", "union", "trait", "mod", "const", "static", "type")
QUALIFIERS = {"pub", "async", "unsafe", "const", "extern", "default", "auto"}
#: The node type of a file's own row (a fixed value).
MODULE = "module_declarations"
PARENTS = {"struct", "impl", "trait", "mod"}


def tokens(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of what is neither white space nor a comment."""
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, at = m.lastgroup, m.end()
        if kind == "hash":
            kind = "raw"
        if kind == "block":
            depth = 1
            while depth and at < len(source):
                a, b = source.find("/*", at), source.find("*/", at)
                if b < 0:
                    at = len(source)
                elif 0 <= a < b:
                    depth, at = depth + 1, a + 2
                else:
                    depth, at = depth - 1, b + 2
        elif kind not in ("space", "line"):
            out.append((kind, m.group(), m.start(), at))
    return out


class _File:
    def __init__(self, source: str, file: str):
        self.source, self.file, self.t = source, file, tokens(source)
        self.items: list[dict] = []
        self.imports: list[str] = []
        self.crates: list[str] = []
        self.attributes: list[str] = []
        self.pair = self._pairs()

    def _pairs(self) -> dict[int, int]:
        """Place of each opening bracket -> place of the one that closes it; the end for those that nothing closes."""
        out, open_ = {}, []
        for i, (kind, text, _, _) in enumerate(self.t):
            if kind == "mark" and text in _CLOSE:
                open_.append(i)
            elif kind == "mark" and text in _CLOSE.values():
                while open_ and _CLOSE[self.t[open_[-1]][1]] != text:
                    out[open_.pop()] = i
                if open_:
                    out[open_.pop()] = i
        return out | {i: len(self.t) - 1 for i in open_}

    def text(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) else ""

    def slice(self, a: int, b: int) -> str:
        return self.source[self.t[a][2] : self.t[min(b, len(self.t) - 1)][3]]

    def end(self, i: int, stop: int, body: bool = True) -> tuple[int, int]:
        """(place of the opening brace or -1, last place) of an item whose header goes on at i: a semicolon ends it, or a block."""
        while i < stop:
            x = self.text(i)
            if x == ";":
                return -1, i
            if x == "{" and body:
                return i, self.pair[i]
            i = self.pair[i] + 1 if x in _CLOSE else i + 1
        return -1, stop - 1

    def angle(self, i: int, stop: int) -> int:
        """Behind the generics that begin at i, if any do."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < stop:
            x = self.text(i)
            depth += (x == "<") - (x == ">" and self.text(i - 1) not in ("-", "="))
            i = self.pair[i] + 1 if x in _CLOSE else i + 1
            if depth == 0:
                break
        return i

    def impl_type(self, i: int, body: int) -> str | None:
        """The type between i and the body: behind a for of depth zero, up to a where."""
        first, k, depth = self.angle(i, body), self.angle(i, body), 0
        last = body
        while k < body:
            x = self.text(k)
            depth += (x == "<") - (x == ">" and self.text(k - 1) not in ("-", "="))
            if depth == 0 and x == "for" and self.text(k + 1) != "<":
                first = k + 1
            if depth == 0 and x == "where":
                last = k
                break
            k = self.pair[k] + 1 if x in _CLOSE else k + 1
        if self.text(first) == "!":
            first += 1
        return self.slice(first, last - 1) if last > first else None

    def add(self, kind: str, name: str | None, parent: str | None, a: int, b: int) -> None:
        path = [self.file, *([parent] if parent else []), kind, name or "unknown"]
        self.items.append({"id": "::".join(path), "kind": KINDS[kind], "parent": parent, "code": self.slice(a, b)})

    def walk(self, i: int, stop: int, parent: str | None) -> None:
        while i < stop:
            kind, x = self.t[i][0], self.text(i)
            if x == "#" and kind == "mark" and self.text(i + 1) == "[":
                last = self.pair[i + 1]
                self.attributes.append(self.slice(i, last))
                i = last + 1
            elif x == "#" and self.text(i + 1) == "!" and self.text(i + 2) == "[":
                i = self.pair[i + 2] + 1
            elif kind != "word":
                i += 1
            elif self.text(i + 1) == "!" and x == "macro_rules" and self.text(i + 3) in _CLOSE:
                last = self.pair[i + 3]
                self.add("macro", self.text(i + 2), parent, i, last)
                i = last + 1
            elif self.text(i + 1) == "!" and self.text(i + 2) in _CLOSE:
                i = self.pair[i + 2] + 1
            elif (end := self.item(i, stop, parent)) is not None:
                i = end
            else:
                i += 1

    def item(self, i: int, stop: int, parent: str | None) -> int | None:
        """The place behind the item that begins at i, or None if none does."""
        a = i
        while i < stop and self.text(i) in QUALIFIERS:
            x, then = self.text(i), self.text(i + 1)
            if x == "pub":
                i = self.pair[i + 1] + 1 if then == "(" else i + 1
            elif x == "extern":
                if then == "crate":
                    _, last = self.end(i, stop, body=False)
                    self.crates.append(self.slice(a, last))
                    return last + 1
                quoted = self.t[i + 1][0] in ("string", "raw") if i + 1 < stop else False
                if self.text(i + 1 + quoted) == "{":
                    body = i + 1 + quoted
                    last = self.pair[body]
                    self.add("foreign_mod", f"extern_{then.strip(chr(34))}" if quoted else "extern", parent, a, last)
                    self.walk(body + 1, last, parent)
                    return last + 1
                i += 1 + quoted
            elif x == "const" and then not in QUALIFIERS and then != "fn":
                break
            else:
                i += 1
        x, name = self.text(i), self.text(i + 1)
        named = i + 1 < stop and self.t[i + 1][0] == "word"
        if x == "use":
            _, last = self.end(i, stop, body=False)
            self.imports.append(self.slice(a, last))
            return last + 1
        if x == "impl":
            body, last = self.end(i, stop)
            if body < 0 or self.text(a - 1) in (":", "=", ">", "(", ",", "&", "+", "<"):
                return None  # a type, not an item
            of = self.impl_type(i + 1, body)
            self.add("impl", of, parent, a, last)
            self.walk(body + 1, last, of)
            return last + 1
        if x == "fn" and named:
            body, last = self.end(i, stop)
            self.add("function" if body >= 0 else "function_signature", name, parent, a, last)
            if body >= 0:
                self.walk(body + 1, last, parent)
            return last + 1
        if x in NAMED and named and (x != "union" or self.text(i + 2) in ("{", "<", "where")):
            if x == "const" and self.text(a - 1) in ("*", "<", ","):
                return None  # a pointer or a parameter
            if x == "static" and name == "mut":
                name = self.text(i + 2)
            body, last = self.end(i, stop, body=x not in ("const", "static", "type"))
            if x == "type" and not any(self.text(k) == "=" for k in range(i, last)):
                return last + 1  # a trait's own type
            self.add(x, name, parent, a, last)
            if x in ("const", "static"):
                self.walk(i + 2, last, parent)
            elif body >= 0 and x not in ("enum", "struct", "union"):
                self.walk(body + 1, last, name if x in PARENTS else parent)
            return last + 1
        return None


def extract(source: str, file: str) -> list[dict]:
    """Rows id, kind, parent, code, file, imports, extern_crates, attributes in the order of the source, a module row first.

    imports are all of the file's; which of them an item uses is a column expression of extract_items().
    """
    f = _File(source, file)
    f.walk(0, len(f.t), None)
    rows = []
    if f.crates or f.attributes or f.imports:
        rows.append({"id": f"{file}::module", "kind": MODULE, "parent": None, "code": "\n".join([*f.crates, *f.attributes, *f.imports]), "file": file, "imports": f.imports, "extern_crates": f.crates, "attributes": f.attributes})
    for item in f.items:
        rows.append(item | {"file": file, "imports": f.imports, "extern_crates": None, "attributes": None})
    return rows


ITEMS = "repo string, commit_no int, id string, kind string, parent string, code string, file string, imports array<string>, extern_crates array<string>, attributes array<string>, line_no int, error string"


def extract_items(files: DataFrame, extensions: tuple[str, ...] = (".rs",)) -> DataFrame:
    """ITEMS rows of files (repo, commit_no, file_path, content) of the wanted kinds.

    A file that can't be read gives one row with an error and no id; null contents are empty files.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ITEMS.split(", ")]
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                base = {"repo": r.repo, "commit_no": r.commit_no, "file": r.file_path}
                try:
                    rows += [base | item | {"line_no": i} for i, item in enumerate(extract(r.content or "", r.file_path))]
                except Exception as e:  # noqa: BLE001 - one broken file must not end the job
                    rows.append(base | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns, dtype=object)

    wanted = F.lit(False)
    for e in extensions:
        wanted = wanted | F.endswith(F.col("file_path"), F.lit(e))
    items = files.where(wanted).select("repo", "commit_no", "file_path", "content").mapInPandas(run, ITEMS)
    return items.withColumn("imports", F.when(F.col("parent").isNull() & (F.col("kind") == MODULE), F.col("imports")).otherwise(used_imports(F.col("code"), F.col("imports"))))
