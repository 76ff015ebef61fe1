"""Patterns in both dialects, places of terms, classes of code, declarations."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import languages as L
from textloom.functions.highlight import as_ansi, as_html, kinds, marked_runs
from textloom.functions.lexical import annotated, classes, stats
from textloom.functions.matching import fuzzy_spans, fuzzy_windows, levenshtein_bytes, literal_spans, lowered, phrase_term, regex_spans
from textloom.functions.patterns import glob_regex, java_regex, path_glob_regex, python_regex


@pytest.mark.parametrize(
    ("pattern", "name", "found"),
    [
        ("*.go", "a.go", True),
        ("*.go", "a/b.go", False),
        ("file?.go", "file1.go", True),
        ("file?.go", "file12.go", False),
        ("file[34].py", "file3.py", True),
        ("file[^34].py", "file3.py", False),
        ("[a-c]x", "bx", True),
        ("a\\*b", "a*b", True),
        ("a\\*b", "axb", False),
        ("[\\]]", "]", True),
    ],
)
def test_globs(pattern, name, found):
    assert bool(re.fullmatch(glob_regex(pattern), name)) is found


@pytest.mark.parametrize("pattern", ["[invalid", "a\\", "[]", "[a-]", "[-a]"])
def test_malformed_globs(pattern):
    assert glob_regex(pattern) is None
    assert path_glob_regex(f"x/{pattern}") is None


def test_path_globs():
    find = lambda g, p: bool(re.search(path_glob_regex(g).replace(r"\z", r"\Z"), p))
    assert find("*/search/*", "pkg/search/file3.py")
    assert find("src/main/*", "src/main/file1.go")
    assert find("vendor/*/*", "a/vendor/lib/x.rs")
    assert not find("main/src", "src/main/x")


def test_regex_dialects():
    assert java_regex("a$") == r"(?d)a\z"
    assert java_regex("(?P<n>x)") == "(?d)(?<n>x)"
    assert java_regex("[[:alpha:]_]") == "(?d)[A-Za-z_]"
    for bad in ("(?=a)", "(?!a)", "(?<=a)b", r"(a)\1", "(", "[a", "a**", r"\k<n>"):
        assert java_regex(bad) is None, bad
        assert python_regex(bad) is None, bad
    assert python_regex("a$").search("a\n") is None
    assert python_regex(r"\w").search("é") is None
    assert python_regex(r"\s").search("\v") is None


def test_literal_places_are_bytes():
    assert literal_spans("aAaA", "aa", False) == [(0, 2), (2, 4)]
    assert literal_spans("aAaA", "a", True) == [(0, 1), (2, 3)]
    assert literal_spans("é cat É", "É", False) == [(0, 2), (7, 9)]
    assert literal_spans("x", "", False) == []
    # lower-casing changes lengths: places are those of the text as it is
    text = "ȺȾjava İx"
    for s, e in literal_spans(text, "java", False):
        assert text.encode()[s:e] == b"java"
    for s, e in literal_spans(text, "x", False):
        assert text.encode()[s:e] == b"x"
    assert lowered("ABC") == ("abc", None)


def test_regex_places():
    assert regex_spans("é12 é3", r"\d+") == [(2, 4), (7, 8)]
    assert regex_spans("abc", "(?=a)") == []


@settings(max_examples=150, deadline=None)
@given(st.text("abcé", max_size=30), st.text("abcé", min_size=1, max_size=6), st.sampled_from([1, 2]))
def test_fuzzy_windows_are_all_within_distance(text, term, distance):
    raw, want = text.encode(), term.encode()
    slow = [i for i in range(len(raw) - len(want) + 1) if _distance(raw[i : i + len(want)], want) <= distance]
    assert fuzzy_windows(raw, want, distance).tolist() == slow


def _distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    return row[-1]


def test_fuzzy_and_distance():
    assert levenshtein_bytes("é", "e") == 2
    assert levenshtein_bytes("kitten", "sitting") == 3
    assert fuzzy_spans("A brown cat is in the house.", "houss", 1, False) == [(22, 27)]
    assert fuzzy_spans("HOUSE", "houss", 1, True) == []
    assert fuzzy_spans("color", "colour", 1, False) == []  # another length
    text = "ȺB house"
    assert [text.encode()[s:e] for s, e in fuzzy_spans(text, "houss", 1, False)] == [b"house"]
    assert phrase_term('"a b"') == "a b" and phrase_term("ab") is None


GO = b'// handler comment\nfunc handler() {\n\tmsg := "handler"\n\thandler()\n}\n'


def test_classes_cover_the_file():
    runs = classes(GO, "Go")
    assert runs[0][0] == 0 and runs[-1][1] == len(GO)
    assert all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))
    assert [GO[s:e] for s, e, c in runs if c == "comment"] == [b"// handler comment"]
    assert [GO[s:e] for s, e, c in runs if c == "string"] == [b'"handler"']
    assert classes(GO, "") == [] and classes(b"", "Go") == []
    assert [c for *_, c in classes(b'x = "a\\"b" # c', "Python")] == ["code", "string", "blank", "comment"]
    assert [c for *_, c in classes(b'"""doc\n"""\n', "Python")][0] == "string"
    assert classes(b"/* never closed", "C") == [(0, 15, "comment")]


def test_stats():
    assert stats(GO, "Go") == {"lines": 5, "code": 4, "comment": 1, "blank": 0, "complexity": 0}
    assert stats(b"if a && b {\n\n}\n// if x\n", "Go")["complexity"] == 2
    assert stats(b"a\n\nb", "") == {"lines": 3, "code": 2, "comment": 0, "blank": 1, "complexity": 0}
    # a docstring at the end of a file is code, and ends it
    assert stats(b'def f():\n    """doc"""', "Python")["lines"] == 2


def test_declaration_tables():
    assert len(L.DECLARATIONS) == 32
    assert sum(map(len, L.DECLARATIONS.values())) == 246
    assert sum(d.binds for ds in L.DECLARATIONS.values() for d in ds) == 34
    assert len(L.STOPWORDS) == 20 and len(L.PROSE) == 23


@pytest.mark.parametrize(
    ("line", "column", "language", "found"),
    [
        ("func handler() {", 5, "Go", True),
        ("func (r *R) handler() {", 12, "Go", True),
        ("const   x = y", 8, "Go", True),
        ("const x = y", 10, "Go", False),
        ("export const client = createClient();", 13, "TypeScript", True),
        ("export const client = createClient();", 22, "TypeScript", False),
        ("return handler", 7, "Python", False),
        ("async def f():", 10, "Python", True),
        ("pub(crate) fn x", 14, "Rust", True),
        ("-type t()", 6, "Erlang", True),
        ("(defn f [x])", 6, "Clojure", True),
        ("func x", 5, "COBOL", False),
    ],
)
def test_declares(line, column, language, found):
    assert L.declares(line, column, language) is found


def test_annotated():
    spans = [{"term": "handler", "s": s, "e": s + 7} for s in (3, 24, 45, 55, 999)]
    got = annotated(GO, "Go", spans)
    assert [x["cls"] for x in got] == ["comment", "code", "string", "code", None]
    assert [x["declares"] for x in got] == [False, True, False, False, False]
    assert [x["on_declaration"] for x in got] == [False, True, False, False, False]
    assert L.snippet_mode("md") == "snippet" and L.snippet_mode("go") == "lines" and L.snippet_mode("go", "grep") == "grep"
    assert L.is_stopword("FUNC", "Go") and not L.is_stopword("handler", "Go") and not L.is_stopword("if", "")


def test_highlighting():
    line = 'func Handler(x) { return "a\\"b" + 12 } // é <note>'
    runs = kinds(line)
    assert "".join(line[s:e] for s, e, _ in runs) == line
    named = {line[s:e]: k for s, e, k in runs}
    assert (named["func"], named["Handler"], named["x"], named["12"], named['"a\\"b"'], named["// é <note>"]) == ("keyword", "type", "plain", "number", "string", "comment")
    at = line.encode().find(b"note")
    assert as_html(line, [(at, at + 4)]).endswith("é &lt;</span><strong>note</strong><span class=\"comment\">&gt;</span>")
    assert as_html("a<b", [(0, 1)]) == "<strong>a</strong>&lt;b"
    assert as_html("") == "" and as_ansi("return x") == "\033[38;5;75mreturn\033[0m x"
    assert "".join(t for t, _ in marked_runs(line, [(0, 3), (2, 9), (99, 120)])) == line


def test_fuzzy_pieces_lose_no_text(spark):
    """Terms with edits of every kind inside longer texts: what goes to Python is all that windows can find."""
    import random

    from textloom.functions.matching import fuzzy_windows
    from textloom.plans.compile import Compiler
    from textloom.query.nodes import Fuzzy

    rng = random.Random(4)
    texts = ["", "Abc", "KELVIN \u212a", "\u0130stanbul"]
    for _ in range(400):
        word = list("Pattern")
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(word))
            word[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "\u00e9", "N"])
            word = word or ["p"]
        texts.append("ab " * rng.randint(0, 3) + "".join(word) + rng.choice(["", " cd efg hi"]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    for term, distance in (("pattern", 1), ("pattern", 2), ("patterns", 2), ("kelvin k", 1), ("ab", 2), ("\u00e9tern", 1)):
        got = {r.id for r in docs.where(Compiler().column(Fuzzy(term, distance))).collect()}
        assert got == {i for i, t in enumerate(texts) if len(fuzzy_windows(t.lower().encode(), term.encode(), distance))}
