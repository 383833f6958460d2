"""Query text to terms: OR groups of AND terms.

Atoms are separated by white space and |; quotes keep both inside. A leading ! negates, twice is
none. ext: path: size: dm: regex: file: folder: are fields; anything else is a name, or a path where
it holds a backslash, and a wildcard where it holds * or ?.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from .. import limits
from ..errors import InvalidArgument, QuerySyntaxError
from ..functions.literals import date_range, size_range

#: Unicode White_Space; Python's \s takes four control characters more.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_TOKEN = re.compile(rf'[{_BLANK}]*(?:(?P<bar>\|)|(?P<not>!*)(?P<atom>(?:[^{_BLANK}|"]|"[^"]*")*)(?P<open>"?))', re.S)


@dataclass(frozen=True)
class Term:
    """kind: name, path, wild, path_wild, regex, ext, size, time or dir; value is its argument."""

    kind: str
    value: object
    negated: bool = False


@dataclass(frozen=True)
class Query:
    groups: tuple[tuple[Term, ...], ...]

    def terms(self) -> list[Term]:
        return [t for g in self.groups for t in g]


def _bare(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text


def _plain(value: str, negated: bool = False) -> Term:
    wild = "*" in value or "?" in value
    if "\\" in value:
        return Term("path_wild" if wild else "path", value, negated)
    return Term("wild" if wild else "name", value, negated)


def _field_terms(field: str, raw: str, negated: bool) -> list[Term]:
    value = _bare(raw)
    if field == "ext":
        parts = (p.strip(_BLANK).lstrip(".") for p in re.split("[;,]", value))
        return [Term("ext", tuple(p for p in parts if p), negated)]
    if field == "path":
        return [Term("path_wild" if "*" in value or "?" in value else "path", value, negated)]
    if field == "regex":
        return [Term("regex", value, negated)]
    if field in ("size", "dm"):
        bounds = (size_range if field == "size" else date_range)(value)
        if bounds is None:
            raise QuerySyntaxError(f"not a {'size' if field == 'size' else 'date'}: {value}")
        return [Term("size" if field == "size" else "time", bounds, negated)]
    if not value:
        return [Term("dir", field == "folder", negated)]
    if negated:
        raise QuerySyntaxError(f"cannot be negated: {field}:{value}")
    return [Term("dir", field == "folder"), _plain(value)]


def _terms(atom: str, negated: bool) -> list[Term]:
    field, colon, raw = atom.partition(":")
    known = {"ext", "path", "size", "dm", "regex", "file", "folder"}
    if colon and atom[0] != '"' and field.isascii() and field.lower() in known:
        return _field_terms(field.lower(), raw, negated)
    return [_plain(_bare(atom), negated)]


def parse(text: str) -> Query:
    """The query of a text; raises QuerySyntaxError, or InvalidArgument if it is too long."""
    if len(text.encode("utf-8", "surrogatepass")) > limits.MAX_QUERY_BYTES:
        raise InvalidArgument("query too long")
    groups: list[list[Term]] = [[]]
    at, n_terms, n_regex = 0, 0, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m["open"]:
            raise QuerySyntaxError("unclosed quote")
        at = m.end()
        if m["bar"]:
            if len(groups) == limits.MAX_QUERY_GROUPS:
                raise QuerySyntaxError("too many groups")
            groups.append([])
        elif m["atom"]:
            new = _terms(m["atom"], len(m["not"]) % 2 == 1)
            n_terms += len(new)
            n_regex += sum(t.kind == "regex" for t in new)
            if n_terms > limits.MAX_QUERY_TERMS or n_regex > limits.MAX_REGEX_TERMS:
                raise QuerySyntaxError("too many terms")
            groups[-1] += new
    return Query(tuple(map(tuple, groups)))


def describe_bounds(term: Term) -> tuple[date | None, date | None]:
    """The civil days of a time term."""
    return term.value
