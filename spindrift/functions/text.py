"""Text functions as column expressions; all stay inside the JVM.

Null in, null out unless a function says otherwise. Lines are split at line feeds only; an empty text is one empty line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the edge of a text (fixed values): ASCII's and Unicode's, separators of records among them. As a pattern
#: for SQL, and as characters.
WHITE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WHITE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at either end; looks at the ends alone."""
    return F.btrim(c, F.lit(WHITE_CHARS))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def join_lines(c: Column) -> Column:
    return F.array_join(c, "\n")


def line_count(c: Column) -> Column:
    """Lines of the stripped text, 0 if nothing is left of it."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(lines(s)))


def nonempty_line_count(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: strip(x) != ""))


def in_line_range(code: Column, least: int = 5, most: int = 30) -> Column:
    """Whether a code has least to most lines; false for null and empty."""
    return F.coalesce((code != "") & line_count(code).between(least, most), F.lit(False))


#: Line beginnings by which imports of several languages are told (fixed values).
IMPORT_STARTS = ("import ", "from ", "use ", "#include")


def import_lines(c: Column) -> Column:
    """The stripped lines that import something, one a line; null as empty."""
    stripped = F.transform(lines(F.coalesce(c, F.lit(""))), strip)
    return join_lines(F.filter(stripped, lambda x: F.lit(False) | _any([F.startswith(x, F.lit(s)) for s in IMPORT_STARTS])))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def last_segment(c: Column, separator: str = "::") -> Column:
    return F.element_at(F.split(c, separator, -1), -1)


def used_imports(code: Column, imports: Column) -> Column:
    """The imports whose last name, or one of a braced list of last names, occurs in the code; distinct and sorted.

    Containment is of substrings, so a short name is found in longer ones; aliases are not understood.
    """
    names = lambda i: F.transform(F.split(F.regexp_replace(last_segment(F.regexp_replace(i, ";", "")), r"[{}]", ""), ","), strip)
    return F.array_sort(F.array_distinct(F.filter(imports, lambda i: F.exists(names(i), lambda n: F.contains(code, n)))))


def metadata_fields(raw: Column) -> Column:
    """Author, mail, date and message of a record with one of each a line, the message being all that is left; N/A if absent."""
    parts = F.split(raw, "\n", 4)
    field = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit("N/A"))
    return F.struct(field(0).alias("author_name"), field(1).alias("author_email"), field(2).alias("commit_date"), field(3).alias("commit_message"))


def middle_third(code: Column) -> Column:
    """struct(prefix, middle, suffix) around the middle third of at least five lines; null if it is blank."""
    ls = lines(code)
    n = F.size(ls)
    a, b = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    middle = join_lines(F.slice(ls, a + 1, b - a))
    parts = F.struct(join_lines(F.slice(ls, F.lit(1), a)).alias("prefix"), middle.alias("middle"), join_lines(F.slice(ls, b + 1, n - b)).alias("suffix"))
    return F.when((n >= 5) & ~is_blank(middle), parts)


def mask_span(code: Column) -> Column:
    """struct(prefix, middle, suffix): the first brace-balanced block without the lines of its braces, or the middle third.

    Braces are counted wherever they stand. A block needs a line between those of its braces that is not blank. The balance is
    found over the braces alone, each with its line: a fold over their running depth.
    """
    ls = lines(code)
    # Per line its braces in order; the fold keeps depth, the line of the opening brace and of the one that closes it.
    braces = F.flatten(F.transform(ls, lambda line, i: F.transform(F.regexp_extract_all(line, F.lit(r"[{}]"), F.lit(0)), lambda b: F.struct(b.alias("b"), i.alias("i")))))
    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        opens, found = x["b"] == "{", acc["last"] >= 0
        depth = acc["depth"] + F.when(opens, 1).otherwise(-1)
        first = F.when(opens & (acc["depth"] == 0), x["i"]).otherwise(acc["first"])
        last = F.when(~opens & (depth == 0) & (acc["first"] >= 0), x["i"]).otherwise(F.lit(-1))
        return F.when(found, acc).otherwise(F.struct(depth.alias("depth"), first.alias("first"), last.alias("last")))

    span = F.aggregate(braces, start, step)
    inner = join_lines(F.slice(ls, span["first"] + 2, F.greatest(span["last"] - span["first"] - 1, F.lit(0))))
    block = F.struct(join_lines(F.slice(ls, F.lit(1), span["first"] + 1)).alias("prefix"), inner.alias("middle"), join_lines(F.slice(ls, span["last"] + 1, F.size(ls))).alias("suffix"))
    return F.when((span["first"] >= 0) & (span["last"] > span["first"] + 1) & ~is_blank(inner), block).otherwise(middle_third(code))


def split_point(key: Column, n: Column, seed: str = "split") -> Column:
    """A line between four and six tenths of n, the same for the same key."""
    low, high = F.floor(n * 0.4), F.floor(n * 0.6)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 8), 16, 10).cast("bigint")
    return (low + F.pmod(draw, high - low + 1)).cast("int")


def completion_split(code: Column, key: Column, seed: str = "split") -> Column:
    """struct(input, output) of a code cut at split_point(); null if either side is blank or has too few lines."""
    ls = lines(code)
    n = F.size(ls)
    at = split_point(key, n, seed)
    a, b = join_lines(F.slice(ls, F.lit(1), F.greatest(at, F.lit(0)))), join_lines(F.slice(ls, at + 1, n))
    return F.when((at >= 1) & (at < n - 1) & ~is_blank(a) & ~is_blank(b), F.struct(a.alias("input"), b.alias("output")))


def full_prompt(file: Column, ast_id: Column, kind: Column, attributes: Column | None = None) -> Column:
    """File, id, type and attributes, as far as there are any, and the request for the implementation."""
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    parts = [some("File: ", file), F.concat(F.lit("AST ID: "), ast_id), some("Type: ", kind)]
    if attributes is not None:
        parts.append(some("Attributes: ", F.array_join(attributes, ", ")))
    return F.array_join(F.array_compact(F.array(*parts, F.lit("\nGenerate the complete implementation:"))), "\n")


def merge_labels(hops: Column, key: Column, most: int = 20, seed: str = "hops") -> Column:
    """Up to most labels: hop 0, then hop 1, then hop 2 in an order drawn by key; repeats stay. hops: map of hop to ids."""
    of = lambda h: F.coalesce(F.try_element_at(hops, F.lit(h)), F.array().cast("array<string>"))
    drawn = F.transform(F.array_sort(F.transform(of("2"), lambda x: F.struct(F.md5(F.concat(F.lit(seed), key, x)).alias("k"), x.alias("x")))), lambda s: s["x"])
    return F.slice(F.concat(of("0"), of("1"), drawn), 1, most)


def apply_edits(code: Column, edits: Column) -> Column:
    """Each edit (span_before, span_after) in turn replaces the first occurrence of its span; null if one does not occur.

    An empty span stands at the front.
    """

    def step(acc: Column, e: Column) -> Column:
        at = F.instr(acc, e["span_before"])
        return F.when(at > 0, F.concat(F.substr(acc, F.lit(1), at - 1), e["span_after"], F.substr(acc, at + F.length(e["span_before"]))))

    return F.aggregate(edits, code, step)
