"""Event filters: a tree of nodes, a small filter language, and what both compile to: one boolean Column.

Null semantics: equality, contains and matches of a missing field are false, and true under NOT; a comparison
of a missing field is false even under NOT. An AND or OR without children is false before its NOT applies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import parse_number
from ..plans import global_lag

Resolver = Callable[[str], Column]


def resolver(df: DataFrame, content: str | None = None, aspects: dict[str, Column] | None = None) -> Resolver:
    """Names to columns: an aspect, else a column (any case), else a JSON path of the content column."""
    known = {c.lower(): F.col(c) for c in df.columns} | {k.lower(): v for k, v in (aspects or {}).items()}

    def resolve(name: str) -> Column:
        if name.lower() in known:
            return known[name.lower()]
        return F.get_json_object(content, "$." + name.replace("/", ".")) if content else F.lit(None).cast("string")

    return resolve


# ---------------------------------------------------------------- tree


@dataclass
class Node:
    negated: bool = field(default=False, kw_only=True)

    def test(self, resolve: Resolver) -> Column:
        raise NotImplementedError

    def column(self, resolve: Resolver) -> Column:
        found = self.test(resolve)
        return ~found if self.negated else found

    def to_json(self) -> str:
        return json.dumps(_plain(self))


@dataclass
class And(Node):
    children: list[Node] = field(default_factory=list)

    def test(self, resolve):
        return reduce(Column.__and__, [c.column(resolve) for c in self.children]) if self.children else F.lit(False)


@dataclass
class Or(Node):
    children: list[Node] = field(default_factory=list)

    def test(self, resolve):
        return reduce(Column.__or__, [c.column(resolve) for c in self.children]) if self.children else F.lit(False)


@dataclass
class Equals(Node):
    name: str
    value: str
    ignore_case: bool = False

    def test(self, resolve):
        c, v = resolve(self.name).cast("string"), self.value
        return F.coalesce(F.lower(c) == v.lower() if self.ignore_case else c == v, F.lit(False))


@dataclass
class Contains(Node):
    name: str
    value: str
    ignore_case: bool = False

    def test(self, resolve):
        c, v = resolve(self.name).cast("string"), self.value
        return F.coalesce(F.upper(c).contains(v.upper()) if self.ignore_case else c.contains(v), F.lit(False))


@dataclass
class Matches(Node):
    name: str
    regex: str

    def test(self, resolve):
        return F.coalesce(resolve(self.name).cast("string").rlike(self.regex), F.lit(False))


@dataclass
class Compare(Node):
    """result -1, 0 or 1: less, equal or greater; kind NUM, ALPHA or TIMESTAMP."""

    name: str
    result: int
    value: str
    kind: str = "NUM"

    def column(self, resolve):
        c = resolve(self.name)
        left, right = (c.cast("string"), F.lit(self.value)) if self.kind == "ALPHA" else (c.try_cast("double"), F.lit(parse_number(self.value)).cast("double"))
        found = {-1: left < right, 0: left == right, 1: left > right}[self.result]
        return F.coalesce(~found if self.negated else found, F.lit(False))


@dataclass
class TraceType(Node):
    kind: str
    child: Node | None = None

    def test(self, resolve):
        own = F.coalesce(resolve("trace_type") == self.kind, F.lit(False))
        return own & self.child.column(resolve) if self.child else own


@dataclass
class Wrapped(Node):
    """Any Column as a node."""

    own: Column

    def test(self, resolve):
        return self.own


def _plain(node: Node) -> dict:
    out = {"node": type(node).__name__}
    for k, v in vars(node).items():
        out[k] = [_plain(x) for x in v] if isinstance(v, list) else _plain(v) if isinstance(v, Node) else v
    return out


def from_json(text: str) -> Node:
    """The inverse of to_json."""

    def build(x: dict) -> Node:
        kinds = {k.__name__: k for k in (And, Or, Equals, Contains, Matches, Compare, TraceType)}
        values = {k: [build(y) for y in v] if isinstance(v, list) else build(v) if isinstance(v, dict) else v for k, v in x.items() if k != "node"}
        return kinds[x["node"]](**values)

    return build(json.loads(text))


def any_regex(columns: list[Column], regex: str) -> Column:
    """A regular expression found in any of the columns."""
    return reduce(Column.__or__, [F.coalesce(c.cast("string").rlike(regex), F.lit(False)) for c in columns])


# ---------------------------------------------------------------- language

_TOKEN = re.compile(r"\s*(?:(?P<op>==|!=|&&|\|\||[<>!()])|(?P<quoted>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<word>[^\s()!=<>&|\"']+))")
_WORDS = ("contains", "matches", "present")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:]!r} at {at}")
        at = m.end()
        if m["op"]:
            out.append(("op", m["op"]))
        elif m["quoted"]:
            out.append(("text", re.sub(r"\\(.)", r"\1", m["quoted"][1:-1])))
        else:
            out.append(("op" if m["word"] in _WORDS else "text", m["word"]))
    return out


class Parser:
    """filter := unit (('&&' | '||') unit)*, folded from left to right without precedence;
    unit := '!'* ( '(' filter ')' | field op value | field 'present' | text )."""

    def __init__(self, text: str, resolve: Resolver, every: list[Column]):
        self.tokens, self.at, self.resolve, self.every = _tokens(text), 0, resolve, every

    def peek(self, k: int = 0):
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else (None, None)

    def next(self):
        token = self.peek()
        self.at += 1
        return token

    def filter(self) -> Column:
        out = self.unit()
        while self.peek() in (("op", "&&"), ("op", "||")):
            _, op = self.next()
            right = self.unit()
            out = out & right if op == "&&" else out | right
        return out

    def unit(self) -> Column:
        if self.peek() == ("op", "!"):
            self.next()
            return ~self.unit()
        if self.peek() == ("op", "("):
            self.next()
            out = self.filter()
            if self.next() != ("op", ")"):
                raise ValueError("a parenthesis is not closed")
            return out
        kind, name = self.next()
        if kind != "text":
            raise ValueError(f"a name is expected, not {name!r}")
        if self.peek() == ("op", "present"):
            self.next()
            return self.resolve(name).isNotNull()
        if self.peek()[0] == "op" and self.peek()[1] in ("==", "!=", "<", ">", "contains", "matches"):
            _, op = self.next()
            kind, value = self.next()
            if kind != "text":
                raise ValueError(f"a value is expected after {op}")
            return self.condition(self.resolve(name), op, value)
        words = [name]
        while self.peek()[0] == "text" and not (self.peek(1)[0] == "op" and self.peek(1)[1] not in ("&&", "||", ")")):
            words.append(self.next()[1])
        return any_regex(self.every, " ".join(words))

    def condition(self, c: Column, op: str, value: str) -> Column:
        text, number = c.cast("string"), parse_number(value)
        if op == "contains":
            found = text.contains(value)
        elif op == "matches":
            found = text.rlike(value)
        elif op in ("==", "!="):
            found = text == value
            if number is not None:
                found = F.coalesce(found, F.lit(False)) | F.coalesce(text.try_cast("double") == F.lit(float(number)), F.lit(False))
        elif number is None:
            raise ValueError(f"{op} needs a number, not {value!r}")
        else:
            left = text.try_cast("double")
            found = left < F.lit(float(number)) if op == "<" else left > F.lit(float(number))
        found = F.coalesce(found, F.lit(False))
        return ~found if op == "!=" else found


def compile_filter(text: str, resolve: Resolver, every: list[Column]) -> Column:
    """The filter language's text as a Column."""
    parser = Parser(text, resolve, every)
    out = parser.filter()
    if parser.at != len(parser.tokens):
        raise ValueError(f"unexpected {parser.peek()[1]!r}")
    return out


def filter_events(df: DataFrame, text: str, content: str | None = None, aspects: dict[str, Column] | None = None) -> DataFrame:
    every = [F.col(c) for c in df.columns] + list((aspects or {}).values())
    return df.where(compile_filter(text, resolver(df, content, aspects), every))


# ---------------------------------------------------------------- order-dependent filters, conditions


def collapse(df: DataFrame, same: list[str], at: str = "ts", order: tuple[str, ...] = ("ts", "rank"), width: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Drops each event that equals the event before it in `same`."""
    if by:
        from pyspark.sql import Window

        w = Window.partitionBy(*by).orderBy(*order)
        rows = df
        for c in same:
            rows = rows.withColumn(f"prev_{c}", F.lag(c).over(w))
    else:
        rows = global_lag(df, at, order, width, same)
    equal = reduce(Column.__and__, [F.col(c) == F.col(f"prev_{c}") for c in same])
    return rows.where(~F.coalesce(equal, F.lit(False))).select(df.columns)


def next_matching(df: DataFrame, rank: int, predicate: Column, backward: bool = False) -> DataFrame:
    """The first event after (before) a rank that matches: a top-1, not a sort."""
    side = F.col("rank") < rank if backward else F.col("rank") > rank
    return df.where(side & predicate).orderBy(F.desc("rank") if backward else F.asc("rank")).limit(1)


def discrete(points: list[int]) -> Callable[[Column, Column], Column]:
    """A condition that holds where an interval contains one of the points (sorted, looked up once an interval)."""
    array = F.array(*[F.lit(p).cast("long") for p in sorted(set(points))])
    return lambda low, high: F.exists(array, lambda p: (p >= low) & (p <= high))


def continuous(low: int, high: int) -> Callable[[Column, Column], Column]:
    return lambda a, b: (a <= high) & (b >= low)


def requirements(df: DataFrame, names: list[str], column: str = "type", level: str = "MANDATORY") -> bool:
    """Whether a trace has the event names: MANDATORY, OPTIONAL, AT_LEAST_ONE or ALL_OR_NOTHING."""
    wanted = list(dict.fromkeys(names))
    n = df.where(F.col(column).isin(wanted)).select(column).distinct().count()
    return {"MANDATORY": n == len(wanted), "OPTIONAL": True, "AT_LEAST_ONE": n > 0 or not wanted, "ALL_OR_NOTHING": n in (0, len(wanted))}[level]
