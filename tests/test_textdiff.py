from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.functions import textdiff as t

A = "fn f() {\n    a();\n    b();\n    c();\n}"
CASES = {
    "modify": (A, A.replace("b()", "x()"), ([2], [2]), [("    b();\n", "    x();\n")], "@@ -3 +3 @@\n-    b();\n+    x();"),
    "insert": ("fn f() {\n    a();\n    b();\n}", "fn f() {\n    a();\n    x();\n    b();\n}", ([], [2]), [("", "    x();\n")], "@@ -2,0 +3 @@\n+    x();"),
    "delete": ("fn f() {\n    a();\n    b();\n}", "fn f() {\n    b();\n}", ([1], []), [("    a();\n", "")], "@@ -2 +1,0 @@\n-    a();"),
    "newline": ("fn f() {}", "fn f() {}\n", ([0], [0]), [("fn f() {}", "fn f() {}\n")], ""),
}


def test_golden():
    for before, after, lines, edits, diff in CASES.values():
        assert t.changed(before, after) == lines
        assert [(e["span_before"], e["span_after"]) for e in t.edits(before, after)] == edits
        assert t.simple_diff(before, after) == diff
        assert t.apply_placed(before, t.edits(before, after)) == after


def test_windows():
    before, after = CASES["modify"][:2]
    x, y = t.changed(before, after)
    assert t.window(before, x) == before and t.window(after, y) == after
    assert t.window(CASES["insert"][0], []) == ""
    assert t.exact_range(before, after) == (2, 3, 2, 3)
    assert t.exact_range("", CASES["insert"][1]) == (0, 1, 0, 5)


lines = st.lists(st.sampled_from(["a\n", "b\n", "\n", "c\r\n", "d"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(lines, lines)
def test_edits_lead_from_one_to_the_other(a, b):
    assert t.apply_placed(a, t.edits(a, b)) == b
    assert (t.edits(a, b) == []) == (a == b)
