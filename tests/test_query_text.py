"""The query language: what parses, what it means, what is refused."""

from __future__ import annotations

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbordex.errors import CatalogueError, InvalidArgument, QuerySyntaxError
from arbordex.functions import literals
from arbordex.functions.fold import changes_by_fold, fold_pairs, fold_text
from arbordex.plans import regexes
from arbordex.plans.compiler import Options, compile_query, validate
from arbordex.plans.focus import focused
from arbordex.plans.implication import subsumes
from arbordex.plans.query_text import parse


def kinds(text):
    return [[(("!" if t.negated else "") + t.kind, t.value) for t in g] for g in parse(text).groups]


@pytest.mark.parametrize(
    "text, want",
    [
        ("", [[]]),
        ("foo |", [[("name", "foo")], []]),
        ("! foo", [[("name", "foo")]]),
        ("!!x !y", [[("name", "x"), ("!name", "y")]]),
        ('""', [[("name", "")]]),
        ('"ext:pdf"', [[("name", "ext:pdf")]]),
        ("C:\\x", [[("path", "C:\\x")]]),
        ("12:30", [[("name", "12:30")]]),
        ("a\\b*", [[("path_wild", "a\\b*")]]),
        ("path:foo?", [[("path_wild", "foo?")]]),
        ('path:"Program Files"', [[("path", "Program Files")]]),
        ("regex:a:b", [[("regex", "a:b")]]),
        ("EXT:.pdf;;txt,.", [[("ext", ("pdf", "txt"))]]),
        ("folder:a* !file:", [[("dir", True), ("wild", "a*"), ("!dir", False)]]),
        ("a\u3000b\x1cc", [[("name", "a"), ("name", "b\x1cc")]]),
        ('x"a b"y', [[("name", 'x"a b"y')]]),
    ],
)
def test_parse(text, want):
    assert kinds(text) == want


#: By rule: quotes close; patterns are sound, bounded and of the dialect; sizes and dates are in range; directories take no negated name.
_REFUSED = {
    "quotes": ['a "b c', 'path:"x', '"'],
    "patterns": ["regex:a)", "regex:x[y", "regex:?a", "regex:z{9,3}", "regex:((ab{90}){90}){9}"],
    "dialect": ["regex:(x)y\\1", "regex:b(?!c)", "regex:(?<=d)e", "regex:f?+"],
    "sizes": ["size:", "size:big", "size:=>7", "size:4..", "size:..", "size:7qb", "size:>99999999999999999999", "size:inf", "size:-7kb", "size:7_0"],
    "dates": ["dm:", "dm:soon", "dm:2024-00-10", "dm:2023-04-31", "dm:1500", "dm:12024"],
    "directories": ["!folder:abc", "!file:a*"],
}


@pytest.mark.parametrize("text", [t for texts in _REFUSED.values() for t in texts])
def test_refused(text):
    assert not validate(text)
    with pytest.raises(QuerySyntaxError):
        compile_query(text)


def test_limits():
    assert validate("|".join("a" * 32)) and not validate("|".join("a" * 33))
    assert validate(" a" * 128) and not validate(" a" * 129)
    assert validate(" regex:a" * 8) and not validate(" regex:a" * 7 + " !regex:a !regex:b")
    assert not validate("x" * 4097)
    with pytest.raises(InvalidArgument):
        parse("é" * 2100)


def test_sizes():
    r = literals.size_range
    assert r("1.5mb") == (1572864, 1572864) and r("1e3") == (1000, 1000) and r("2 KB") == (2048, 2048)
    assert r(">1gb") == ((1 << 30) + 1, literals.U64) and r("<=5b") == (0, 5) and r("5..2") == (5, 2)
    assert r("1.9") == (1, 1) and r("18446744073709551615") == (literals.U64,) * 2 and r("18446744073709551615kb") is None


def test_dates():
    d = literals.date_range
    assert d("2024") == (date(2024, 1, 1), date(2025, 1, 1)) and d("2024/12") == (date(2024, 12, 1), date(2025, 1, 1))
    assert d(">2024") == (date(2025, 1, 1), None) and d("<=2024") == (None, date(2025, 1, 1))
    assert d("2023-02..2024-02-29") == (date(2023, 2, 1), date(2024, 3, 1)) and d("9999-12-31") == (date(9999, 12, 31), None)
    assert d("2023-02-29") is None and d("1-2-3-4") is None


def test_fold_is_not_lower():
    assert fold_text("ÄÉΣſ") == "äéσſ"
    assert all(fold_text(c) == c for c in "İ\u212aȺß")
    a, b = fold_pairs()
    assert len(a) == len(b) and all(len(x.encode()) == len(y.encode()) for x, y in zip(a, b, strict=True))
    assert not changes_by_fold("abc1.") and changes_by_fold("aB")


def test_regex_dialect():
    assert regexes.to_java("a$", False) == r"(?sU)a\z" and regexes.to_java("[$]", True) == "(?iusU)[$]"
    assert regexes.states("(a{10}b){10}") == 110
    assert regexes.escape("a.b\\") == r"a\.b\\"


def test_case_decides_per_term():
    def folded(text, **o):
        return [m.folded for m in compile_query(text, Options(**o)).groups[0]]

    assert folded("abc ABC") == [True, False] and folded("ABC", case="insensitive") == [True] and folded("abc", case="sensitive") == [False]
    with pytest.raises(InvalidArgument):
        Options(sort="nope")
    with pytest.raises(InvalidArgument):
        Options(desc=1)


def test_focused():
    assert focused("") == "" and focused("  ") == "  "
    assert focused("a | path:b ext:c", ("\\w\\",), ("x", "y")) == 'a !path:"\\w\\" ext:x;y | path:b ext:c'
    assert focused('"p|q"', (), ("x",)) == '"p|q" ext:x'


@pytest.mark.parametrize(
    "before, after, want",
    [
        ("", "abc", True), ("ab", "xabx", True), ("abx", "ab", False), ("ab", "AB", True), ("AB", "ab", False), ("a", "a*", True), ("ab*", "abc*", True), ("ab*", "*abc*", False),
        ("*bc", "*abc", True), ("size:>1", "size:5..9", True), ("size:5..9", "size:>1", False), ("ext:a;b", "ext:a", True), ("ext:a", "ext:a;b", False), ("!x", "!x y", True), ("!x", "!xy", False),
        ("a|b", "a", False), ("a", "a|b", False), ("path:a", "path:ab", False), ("path:a", "path:a b", True), ("dm:2024", "dm:2024-05", True), ("dm:<2000", "dm:>1990", False), ("é", "ée", True), ("regex:a", "regex:a b", True),
    ],
)
def test_implication(before, after, want):
    assert subsumes(compile_query(before), compile_query(after)) is want


def test_implication_of_options():
    q = compile_query
    assert not subsumes(q("a"), q("a", Options(include_hidden_system=True)))
    assert subsumes(q("a", Options(include_hidden_system=True)), q("a"))
    assert not subsumes(q("a"), q("a", Options(sort="size"))) and not subsumes(q("a"), q("a", Options(desc=True)))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab"|! *?\\:.;<>=1kmext:sizdregfol(){}[]é', max_size=30))
def test_any_text_parses_or_is_refused(text):
    try:
        compile_query.__wrapped__(text)
    except CatalogueError:
        pass
