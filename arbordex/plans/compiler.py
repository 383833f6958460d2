"""Terms to one boolean Column over the catalogue's columns.

Name literals compare against the name or its folded form, whichever the term's case asks for, and
against the canonical forms only where other spellings of the literal exist. Conditions of a group
stand in the order of their cost, so that cheap ones spare the dear ones.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument, QuerySyntaxError
from ..functions.fold import canonical_text, changes_by_fold, fold_text, nfc_text, needs_canonical
from ..functions.literals import midnight_seconds, seconds_to_ticks
from . import regexes
from .query_text import Query, Term, parse

SORTS = ("name", "size", "mtime")
CASES = ("smart", "insensitive", "sensitive")
SCOPES = ("none", "name", "path")
_MAX_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Options:
    """How to search; whole_regex takes the whole text as one pattern over names or paths."""

    sort: str = "name"
    desc: bool = False
    case: str = "smart"
    include_hidden_system: bool = False
    whole_regex: str = "none"
    time_zone: str = "UTC"

    def __post_init__(self):
        if self.sort not in SORTS or self.case not in CASES or self.whole_regex not in SCOPES:
            raise InvalidArgument(f"unknown option in {self}")
        if not all(isinstance(getattr(self, f.name), bool) for f in fields(self) if f.type == "bool"):
            raise InvalidArgument(f"not a boolean in {self}")


@dataclass(frozen=True)
class Matcher:
    """A compiled term: what it compares, on which of a row's texts, at which cost."""

    kind: str
    value: object
    folded: bool = False
    canonical: bool = False
    negated: bool = False

    @property
    def on_path(self) -> bool:
        return self.kind in ("path", "path_regex")

    @property
    def cost(self) -> int:
        base = {"true": 0, "size": 0, "time": 0, "dir": 0, "ext": 1, "prefix": 1, "suffix": 1, "contains": 2, "regex": 3, "path": 4, "path_regex": 5}[self.kind]
        return base + 6 * self.canonical

    def text(self) -> Column:
        names = {(False, False): "name", (True, False): "folded", (False, True): "nfc_name", (True, True): "nfc_folded"}
        name = names[self.folded, self.canonical]
        return F.col(name.replace("name", "path") if "name" in name else name + "_path") if self.on_path else F.col(name)

    def condition(self) -> Column:
        test = self._test()
        return ~test if self.negated else test

    def _test(self) -> Column:
        v = self.value
        if self.kind == "true":
            return F.lit(True)
        if self.kind == "dir":
            return F.col("is_dir") if v else ~F.col("is_dir")
        if self.kind == "size":
            low, high = v
            if low > min(high, _MAX_LONG):
                return F.lit(False)
            bound = F.col("size") >= low
            return ~F.col("is_dir") & (bound if high >= _MAX_LONG else bound & (F.col("size") <= high))
        if self.kind == "time":
            low, high, unknown = v
            m = F.col("mtime_secs")
            known = reduce(Column.__and__, [c for c in ((m >= low) if low is not None else None, (m < high) if high is not None else None) if c is not None], m != 0)
            return known | (m == 0) if unknown else known
        if self.kind == "ext":
            return ~F.col("is_dir") & F.contains(self.text(), F.lit(".")) & F.substring_index(self.text(), ".", -1).isin(list(v)) if v else F.lit(False)
        if self.kind in ("regex", "path_regex"):
            return F.rlike(self.text(), F.lit(v))
        compare = {"contains": F.contains, "path": F.contains, "prefix": F.startswith, "suffix": F.endswith}[self.kind]
        return compare(self.text(), F.lit(v))


@dataclass(frozen=True)
class Plan:
    """A compiled query."""

    groups: tuple[tuple[Matcher, ...], ...]
    options: Options

    @property
    def needs_paths(self) -> bool:
        return any(m.on_path for g in self.groups for m in g)

    @property
    def needs_canonical(self) -> bool:
        return any(m.canonical for g in self.groups for m in g)

    @property
    def matches_all(self) -> bool:
        return any(all(m.kind == "true" and not m.negated for m in g) for g in self.groups)

    def condition(self) -> Column:
        """True for the rows that any group matches; a group without terms matches all."""
        each = [reduce(Column.__and__, [m.condition() for m in g]) if g else F.lit(True) for g in self.groups]
        return reduce(Column.__or__, each)


def _ignores_case(text: str, case: str) -> bool:
    if case != "smart":
        return case == "insensitive"
    return not changes_by_fold(text if text.isascii() else nfc_text(text))


def _literal(kind: str, text: str, case: str, negated: bool) -> Matcher:
    folded = _ignores_case(text, case)
    canonical = needs_canonical(text, folded)
    value = canonical_text(text, folded) if canonical else fold_text(text) if folded else text
    return Matcher(kind, value, folded, canonical, negated)


def _pattern(kind: str, text: str, body: str, insensitive: bool, canonical: bool, negated: bool) -> Matcher:
    java = f"(?{'iu' if insensitive else ''}s){body}"
    regexes.check(java, text)
    return Matcher(kind, java, False, canonical, negated)


def _wildcard(text: str, case: str, negated: bool) -> Matcher:
    inner = text.strip("*")
    if inner and "?" not in text and "*" not in inner:
        begins, ends = text.startswith("*"), text.endswith("*")
        return _literal("contains" if begins and ends else "suffix" if begins else "prefix", inner, case, negated)
    folded = _ignores_case(text, case)
    canonical = needs_canonical(text, folded)
    body = regexes.from_wildcard(nfc_text(text) if canonical else text)
    return _pattern("regex", text, rf"\A{body}\z", folded, canonical, negated)


def compile_term(term: Term, options: Options) -> Matcher:
    kind, v, no, case = term.kind, term.value, term.negated, options.case
    if kind == "name":
        return _literal("contains", v, case, no) if v else Matcher("true", None, negated=no)
    if kind == "path":
        return _literal("path", v, case, no)
    if kind == "wild":
        return _wildcard(v, case, no)
    if kind == "path_wild":
        folded = _ignores_case(v, case)
        canonical = needs_canonical(v, folded)
        return _pattern("path_regex", v, regexes.from_wildcard(nfc_text(v) if canonical else v), folded, canonical, no)
    if kind == "regex":
        return Matcher("regex", regexes.to_java(v, _pattern_ignores_case(v, case)), negated=no)
    if kind == "ext":
        canonical = any(needs_canonical(e, True) for e in v)
        return Matcher("ext", tuple(canonical_text(e, True) if canonical else fold_text(e) for e in v), True, canonical, no)
    if kind == "size":
        return Matcher("size", v, negated=no)
    if kind == "time":
        low, high = (None if d is None else midnight_seconds(d, options.time_zone) for d in v)
        # unknown times count as the first tick of 1601
        unknown = (low is None or seconds_to_ticks(low or -1) <= 0) and (high is None or seconds_to_ticks(high or -1) > 0)
        return Matcher("time", (low, high, unknown), negated=no)
    return Matcher("dir", v, negated=no)


def _pattern_ignores_case(pattern: str, case: str) -> bool:
    """The pattern's own letters decide, so \\D or \\W make it sensitive."""
    return case == "insensitive" or case == "smart" and not changes_by_fold(pattern)


@lru_cache(256)
def compile_query(text: str, options: Options = Options()) -> Plan:
    """The plan of a query text; equal texts and options share one."""
    if options.whole_regex != "none":
        if not text:
            return Plan(((),), options)
        kind = "regex" if options.whole_regex == "name" else "path_regex"
        return Plan(((Matcher(kind, regexes.to_java(text, _pattern_ignores_case(text, options.case))),),), options)
    query: Query = parse(text)
    groups = [sorted((compile_term(t, options) for t in g), key=lambda m: m.cost) for g in query.groups]
    return Plan(tuple(map(tuple, groups)), options)


def validate(text: str) -> bool:
    """Whether the text is a query."""
    try:
        compile_query(text)
    except (QuerySyntaxError, InvalidArgument):
        return False
    return True
