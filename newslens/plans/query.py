"""The query language: text to tree to Column.

    query  := clause+                      one after another means AND
    clause := ['-' | NOT] atom | '(' atom (OR atom)+ ')'
    atom   := word | "phrase" | nearN:"a b" | repeatN:"t" | field:value | field<n | field>n | near:lat,lon,radius[km]

A group holds atoms, not groups. Two atoms in a group without OR between them
belong to one alternative. AND between clauses says nothing. A field that the
view doesn't have is an error, not a word.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslens.functions import scalars, text


class QueryError(ValueError):
    """A query that cannot be understood."""


@dataclass(frozen=True)
class Term:
    value: str
    phrase: bool = False


@dataclass(frozen=True)
class Near:
    distance: int
    value: str


@dataclass(frozen=True)
class Repeat:
    least: int
    value: str


@dataclass(frozen=True)
class Filter:
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class Radius:
    lat: float
    lon: float
    km: float
    unit: str = "mi"


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    of: tuple


@dataclass(frozen=True)
class Or:
    of: tuple


_NUMBER = r"[+-]?\d+(?:\.\d+)?"
_TOKEN = re.compile(
    rf"""\s*(?:
      (?P<open>\() | (?P<close>\))
    | near(?P<near>\d+):"(?P<near_terms>[^"]*)"
    | repeat(?P<repeat>\d+):"(?P<repeat_term>[^"]*)"
    | near:(?P<lat>{_NUMBER}),(?P<lon>{_NUMBER}),(?P<radius>\d+(?:\.\d+)?)(?P<unit>km|mi)?(?=[\s)]|$)
    | (?P<field>[A-Za-z_][A-Za-z0-9_]*)(?P<op>:|<|>)(?:"(?P<quoted>[^"]*)"|(?P<value>[^\s()"]+))
    | "(?P<phrase>[^"]*)"
    | (?P<minus>-)(?=[^\s)])
    | (?P<word>[^\s()"]+)
    )""",
    re.X,
)


def lex(query: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    at = 0
    while query[at:].strip():
        m = _TOKEN.match(query, at)
        if not m:
            raise QueryError(f"cannot read {query[at:].strip()[:30]!r}")
        at, g = m.end(), m.groupdict()
        if g["open"] or g["close"] or g["minus"]:
            out.append((g["open"] or g["close"] or "NOT", None))
        elif g["near"] is not None:
            out.append(("atom", Near(int(g["near"]), g["near_terms"])))
        elif g["repeat"] is not None:
            out.append(("atom", Repeat(int(g["repeat"]), g["repeat_term"])))
        elif g["lat"] is not None:
            unit = g["unit"] or "mi"
            out.append(("atom", Radius(float(g["lat"]), float(g["lon"]), float(g["radius"]) * (1 if unit == "km" else scalars.MILE_KM), unit)))
        elif g["field"] is not None:
            out.append(("atom", Filter(g["field"].lower(), g["op"], g["quoted"] if g["quoted"] is not None else g["value"])))
        elif g["phrase"] is not None:
            out.append(("atom", Term(g["phrase"], True)))
        elif g["word"] in ("AND", "OR", "NOT"):
            out.append((g["word"], None))
        else:
            out.append(("atom", Term(g["word"])))
    return out


def parse(query: str) -> And:
    tokens = lex(query)
    at = 0

    def atom(no: bool) -> object:
        nonlocal at
        kind, value = tokens[at] if at < len(tokens) else ("end", None)
        at += 1
        if kind == "NOT":
            return atom(not no)
        if kind == "(":
            return Not(group()) if no else group()
        if kind != "atom":
            raise QueryError(f"expected a term, not {kind}")
        return Not(value) if no else value

    def group() -> object:
        nonlocal at
        ways: list[list] = [[]]
        while True:
            kind = tokens[at][0] if at < len(tokens) else "end"
            if kind == "end":
                raise QueryError("a group is not closed")
            if kind == "(":
                raise QueryError("a group cannot hold another group")
            if kind == ")":
                at += 1
                break
            if kind in ("OR", "AND"):
                at += 1
                if kind == "OR":
                    ways.append([])
                continue
            ways[-1].append(atom(False))
        if not all(ways):
            raise QueryError("a group has an empty alternative")
        ways_ = [w[0] if len(w) == 1 else And(tuple(w)) for w in ways]
        return ways_[0] if len(ways_) == 1 else Or(tuple(ways_))

    out = []
    while at < len(tokens):
        if tokens[at][0] == "AND":
            at += 1
            continue
        if tokens[at][0] == "OR":
            raise QueryError("OR stands in parentheses only")
        if tokens[at][0] == ")":
            raise QueryError("a group is closed that was not opened")
        out.append(atom(False))
    if not out:
        raise QueryError("an empty query")
    return And(tuple(out))


def terms(node: object) -> list[str]:
    """The words and phrases that a tree asks for, in its order; not those that it excludes."""
    match node:
        case Term(value, _):
            return [value]
        case And(of) | Or(of):
            return [t for x in of for t in terms(x)]
    return []


def show(node: object) -> str:
    """A tree as text that parses to the same tree."""
    match node:
        case Term(value, phrase):
            return f'"{value}"' if phrase else value
        case Near(distance, value):
            return f'near{distance}:"{value}"'
        case Repeat(least, value):
            return f'repeat{least}:"{value}"'
        case Filter(name, op, value):
            return f'{name}{op}"{value}"' if re.search(r'[\s()]', value) or not value else f"{name}{op}{value}"
        case Radius(lat, lon, km, unit):
            return f"near:{lat:g},{lon:g},{km if unit == 'km' else km / scalars.MILE_KM:g}{'km' if unit == 'km' else ''}"
        case Not(of):
            return f"-{show(of)}"
        case And(of):
            return " ".join(map(show, of))
        case Or(of):
            return f"({' OR '.join(map(show, of))})"
    raise TypeError(node)


#: Fields with a number after < or >; the sign ``toneabs`` compares the size of the tone.
Maker = Callable[[str, str], Column]


@dataclass
class View:
    """What a query's atoms mean over a DataFrame: the normalised text, fields by name, and coordinates."""

    norm: Column | None = None
    fields: dict[str, Maker] = field(default_factory=dict)
    lat: Column | None = None
    lon: Column | None = None
    #: Columns that are there for conditions only.
    hidden: tuple[str, ...] = ()

    def term(self, make: Callable[[Column], Column]) -> Column:
        if self.norm is None:
            raise QueryError("this view has no text")
        return make(self.norm)


def equals(column: Column, folded: bool = False) -> Maker:
    """field:value, by lower case. A column that is ``folded`` is in lower case already, so that a scan can be asked."""

    def make(op: str, value: str) -> Column:
        if op != ":":
            raise QueryError("this field takes a colon")
        return (column if folded else F.lower(column)) == value.lower()

    return make


def country(name: Column, code: Column | None = None, folded: bool = False) -> Maker:
    """A country's name in lower case without spaces, or its two-letter code; ``folded`` columns are so written already."""

    def make(op: str, value: str) -> Column:
        key = value.lower().replace(" ", "")
        by_name = (name if folded else scalars.country_key(name)) == key
        return by_name | ((code if folded else F.lower(code)) == key) if code is not None and len(key) == 2 else by_name

    return make


def subdomain(host: Column) -> Maker:
    """A host or any host below it."""
    return lambda op, value: (host == value.lower()) | F.endswith(host, F.lit("." + value.lower()))


def member(values: Column) -> Maker:
    return lambda op, value: F.array_contains(values, value)


def number(column: Column) -> Maker:
    """field<n and field>n, strictly."""

    def make(op: str, value: str) -> Column:
        try:
            n = float(value)
        except ValueError:
            raise QueryError(f"not a number: {value!r}") from None
        if op == ":":
            return column == n
        return column < n if op == "<" else column > n

    return make


def any_of(array: Column, test: Callable[[Column], Maker]) -> Maker:
    """An atom about one of several things, such as a document's images."""
    return lambda op, value: F.exists(array, lambda x: test(x)(op, value))


def text_of(get: Callable[[Column], Column]) -> Callable[[Column], Maker]:
    return lambda x: lambda op, value: text.has(text.norm(get(x)), value)


def _cost(node: object) -> int:
    match node:
        case Filter() | Radius():
            return 0
        case Term():
            return 1
        case Not(of):
            return _cost(of)
        case Repeat():
            return 2
        case Near():
            return 3
        case And(of) | Or(of):
            return max(map(_cost, of))
    return 4


def compile(node: object, view: View) -> Column:
    """The tree as one condition; what is cheap to tell, and what a scan can be asked, comes first."""
    match node:
        case Term(value, _):
            return view.term(lambda n: text.has(n, value))
        case Near(distance, value):
            return view.term(lambda n: text.near(n, [value], distance))
        case Repeat(least, value):
            return view.term(lambda n: text.repeats(n, value, least))
        case Filter(name, op, value):
            if name not in view.fields:
                raise QueryError(f"no field {name!r} here; there are {', '.join(sorted(view.fields)) or 'none'}")
            return view.fields[name](op, value)
        case Radius(lat, lon, km, _):
            if view.lat is None:
                raise QueryError("this view has no places")
            return scalars.within(view.lat, view.lon, lat, lon, km)
        case Not(of):
            return ~F.coalesce(compile(of, view), F.lit(False))
        case And(of):
            return reduce(lambda a, b: a & b, [compile(x, view) for x in sorted(of, key=_cost)])
        case Or(of):
            return reduce(lambda a, b: a | b, [compile(x, view) for x in sorted(of, key=_cost)])
    raise TypeError(node)


def matches(query: str, view: View) -> Column:
    return compile(parse(query), view)
