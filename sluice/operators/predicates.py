"""Filters: a tree of conditions, or its string form, turned into one boolean Column.

The Column is NULL or false for a record that does not pass.  There is no negation above a
condition, so NULL never turns into a pass, and plain comparisons stay visible to the scan.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.values import Field, TypedRecord, literal_number, literal_text

# Operator names of the filter language.
OPERATORS = (
    "eq", "neq", "gt", "gte", "lt", "lte", "contains", "startswith", "endswith", "regex",
    "in", "notin", "exists", "notexists", "null", "notnull",
)
PRESENCE = ("exists", "notexists", "null", "notnull")

# Symbols of the string form, in the order they are looked for.
SYMBOLS = {"~=": "regex", "!=": "neq", ">=": "gte", "<=": "lte", "==": "eq", ">": "gt", "<": "lt"}

_custom: dict[str, Callable[[Field, object], Column]] = {}


def register_operator(name: str, build: Callable[[Field, object], Column]) -> None:
    """Add a filter operator: ``build(field, value)`` returns its boolean Column."""
    if name in OPERATORS:
        raise ValueError(f"operator {name!r} is built in")
    _custom[name] = build


def condition(field: str, op: str, value=None) -> dict:
    return {"field": field, "op": op, "value": value}


def all_of(*nodes: dict) -> dict:
    return {"and": list(nodes)}


def any_of(*nodes: dict) -> dict:
    return {"or": list(nodes)}


# -- checking a specification ------------------------------------------------------------

def check_filter(spec: dict) -> None:
    """Check ``{"root": tree}`` or ``{"expression": text}``; raise ValueError when malformed."""
    has_root, has_text = spec.get("root") is not None, bool(spec.get("expression"))
    if has_root == has_text:
        raise ValueError("give exactly one of root and expression")
    check_node(spec["root"] if has_root else parse_expression(spec["expression"]))


def check_node(node: dict) -> None:
    group = [k for k in ("and", "or") if k in node]
    if group:
        if len(group) > 1 or not node[group[0]]:
            raise ValueError("a group needs one logical operator and at least one condition")
        for child in node[group[0]]:
            check_node(child)
        return
    if not node.get("field"):
        raise ValueError("a condition needs a field")
    op = node.get("op")
    if op not in OPERATORS and op not in _custom:
        raise ValueError(f"unknown operator {op!r}")
    if op not in PRESENCE and node.get("value") is None:
        raise ValueError(f"operator {op} needs a value")


# -- the string form ---------------------------------------------------------------------

_TOKEN = re.compile(r"""
    (?P<space>\s+)
  | (?P<quoted>'[^']*'|"[^"]*")
  | (?P<logic>&&|\|\|)
  | (?P<symbol>[~!<>=]=|[<>])
  | (?P<mark>[()\[\],!])
  | (?P<open>['"])
  | (?P<word>(?:(?!&&|\|\||[~!=]=)[^\s()\[\],!<>])+)
""", re.X)
WORDED = ("contains", "startswith", "endswith", "in", "notin")


class _Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def _tokens(text: str) -> list[_Token]:
    """Blanks apart.  A quote opens only where a token begins, so the apostrophe inside a name is a letter."""
    found, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None or m.lastgroup == "open":
            raise ValueError(f"a quote is not closed in {text!r}" if m else f"cannot read {text[at:]!r}")
        if m.lastgroup != "space":
            found.append(_Token(m.lastgroup, m[0], m.start(), m.end()))
        at = m.end()
    return found


class _Expression:
    """Precedence parser: alternatives of conjunctions of terms."""

    def __init__(self, text: str):
        self.source, self.tokens, self.at = text, _tokens(text), 0

    def peek(self, ahead: int = 0) -> str:
        place = self.at + ahead
        return self.tokens[place].text if place < len(self.tokens) else ""

    def accept(self, *texts: str) -> bool:
        """Step over these tokens if they are the next ones."""
        if any(self.peek(i) != t for i, t in enumerate(texts)):
            return False
        self.at += len(texts)
        return True

    def fail(self):
        raise ValueError(f"cannot read condition {self.source!r}")

    def whole(self) -> dict:
        tree = self.group("||", "or", lambda: self.group("&&", "and", self.term))
        return tree if self.at == len(self.tokens) else self.fail()

    def group(self, mark: str, name: str, part: Callable[[], dict]) -> dict:
        parts = [part()]
        while self.accept(mark):
            parts.append(part())
        return {name: parts} if len(parts) > 1 else parts[0]

    def term(self) -> dict:
        if self.accept("("):
            inner = self.group("||", "or", lambda: self.group("&&", "and", self.term))
            return inner if self.accept(")") else self.fail()
        if self.accept("!", "("):
            field = self.field()
            return condition(field, "notexists") if self.accept("exists", ")") else self.fail()
        field = self.field()
        if self.peek() == "exists" and self.peek(1) in ("", "&&", "||", ")"):
            self.at += 1
            return condition(field, "exists")
        op = self.peek()
        self.at += 1
        value = self.value()
        plain = self.raw(value)
        if op in SYMBOLS:
            if plain == "null" and op in ("==", "!="):
                return condition(field, "null" if op == "==" else "notnull")
            return condition(field, SYMBOLS[op], self.plain(value))
        if op not in WORDED or not value:
            self.fail()
        return condition(field, op, self.items(value) if op in ("in", "notin") else self.plain(value))

    def field(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at].kind != "word":
            self.fail()
        self.at += 1
        return self.tokens[self.at - 1].text.lstrip(".")

    def value(self) -> list[_Token]:
        """Tokens up to the next logical operator or the bracket that closes the term."""
        first, depth = self.at, 0
        while self.at < len(self.tokens):
            text = self.peek()
            if depth == 0 and text in ("&&", "||", ")"):
                break
            depth += (text == "(") - (text == ")")
            self.at += 1
        return self.tokens[first:self.at]

    def raw(self, tokens: list[_Token]) -> str:
        return self.source[tokens[0].start:tokens[-1].end] if tokens else ""

    def plain(self, tokens: list[_Token]) -> str:
        """The text as written, or what a single pair of quotes holds."""
        raw = self.raw(tokens)
        return raw[1:-1] if len(tokens) == 1 and tokens[0].kind == "quoted" else raw

    def items(self, tokens: list[_Token]) -> list[str]:
        """``a, b``, ``[a, b]`` or the printed form ``[a b]``."""
        listed = tokens[0].text == "[" and tokens[-1].text == "]"
        inner = tokens[1:-1] if listed else tokens
        commas = [i for i, token in enumerate(inner) if token.text == ","]
        if listed and not commas:
            return [self.plain([token]) for token in inner]
        cuts = [-1, *commas, len(inner)]
        return [self.plain(inner[a + 1:b]) for a, b in zip(cuts, cuts[1:])]


def parse_expression(text: str) -> dict:
    """``.a == 'x' && (.b > 1 || .c exists)`` as a tree; ``||`` binds weaker than ``&&``."""
    return _Expression(text).whole()


# -- conditions to Columns ---------------------------------------------------------------

def _equal(f: Field, value) -> Column:
    number = literal_number(value)
    if f.variant:
        same = f.text == F.lit(literal_text(value))
        if number is not None and not isinstance(value, str):
            return F.coalesce(f.number == F.lit(number), same)
        return same
    if f.numeric and number is not None:
        # A string literal equals a number only in the form the number is printed in.
        if not isinstance(value, str) or literal_text(number) == value:
            return f.value == F.lit(number)
    if f.string:
        return f.value == F.lit(literal_text(value))
    if isinstance(value, bool) and f.dtype.simpleString() == "boolean":
        return f.value == F.lit(value)
    return f.text == F.lit(literal_text(value))


def _ordered(f: Field, value, op: str) -> Column:
    def compare(left: Column, right: Column) -> Column:
        return {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]

    number = literal_number(value)
    by_text = lambda: compare(f.text, F.lit(literal_text(value)))
    if number is None:
        return by_text()
    if f.numeric:
        return compare(f.value, F.lit(number))
    return F.when(f.number.isNotNull(), compare(f.number, F.lit(float(number)))).otherwise(by_text())


def _member(f: Field, values) -> Column:
    values = list(values) if isinstance(values, (list, tuple, set)) else []
    if not values:
        return F.when(f.present, F.lit(False))
    if f.string:
        return f.value.isin([literal_text(v) for v in values])
    if f.numeric and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return f.value.isin(values)
    return reduce(lambda a, b: a | b, [_equal(f, v) for v in values])


def condition_column(f: Field, op: str, value=None, missing_passes: bool = False) -> Column:
    """One condition on one field.  ``missing_passes`` lets ``neq`` accept a missing field."""
    if op == "exists":
        return f.present
    if op == "notexists":
        return ~f.present
    if op == "null":
        return f.null
    if op == "notnull":
        return ~f.null
    if op in _custom:
        return _custom[op](f, value)
    if op == "eq":
        return _equal(f, value)
    if op == "neq":
        differs = ~_equal(f, value)
        return (differs | ~f.present) if missing_passes else differs
    if op in ("gt", "gte", "lt", "lte"):
        return _ordered(f, value, op)
    if op == "contains":
        return f.text.contains(literal_text(value))
    if op == "startswith":
        return f.text.startswith(literal_text(value))
    if op == "endswith":
        return f.text.endswith(literal_text(value))
    if op == "regex":
        return f.text.rlike(java_regex(literal_text(value)))
    if op == "in":
        return _member(f, value)
    if op == "notin":
        return ~_member(f, value)
    raise ValueError(f"unknown operator {op!r}")


def java_regex(pattern: str) -> str:
    """Named groups ``(?P<n>`` in the spelling Java uses."""
    return pattern.replace("(?P<", "(?<")


def node_column(node: dict, record, missing_passes: bool = False) -> Column:
    """The Column of a tree node; an empty group is true."""
    for name, join in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
        if name in node:
            parts = [node_column(child, record, missing_passes) for child in node[name]]
            return reduce(join, parts) if parts else F.lit(True)
    return condition_column(record.field(node["field"]), node["op"], node.get("value"), missing_passes)


def to_column(spec, record, missing_passes: bool = False) -> Column:
    """Column of a filter given as tree, string, ``{"root"|"expression": …}``, Column or nothing."""
    if isinstance(spec, Column):
        return spec
    if isinstance(spec, dict) and ("root" in spec or "expression" in spec):
        spec = spec.get("root") or spec.get("expression")
    if not spec:
        return F.lit(True)
    if isinstance(spec, str):
        if spec.strip().lower() == "true":
            return F.lit(True)
        spec = parse_expression(spec)
    return node_column(spec, record, missing_passes)


def record_of(df: DataFrame, variant: str | None = None):
    from sluice.functions.values import VariantRecord

    return VariantRecord(variant) if variant else TypedRecord(df.schema)


def where(df: DataFrame, spec, variant: str | None = None, missing_passes: bool = False) -> DataFrame:
    """Rows of ``df`` that pass the filter."""
    if spec is None or (not isinstance(spec, Column) and not spec):
        return df
    return df.filter(to_column(spec, record_of(df, variant), missing_passes))


def passes(df: DataFrame, spec, variant: str | None = None) -> Column:
    """The filter as a true/false Column without NULL."""
    return F.coalesce(to_column(spec, record_of(df, variant)), F.lit(False))


# -- filter report -----------------------------------------------------------------------

def report_rows(df: DataFrame, spec, variant: str | None = None) -> DataFrame:
    """Every input row with ``passed``."""
    return df.withColumn("passed", passes(df, spec, variant))


def report_summary(df: DataFrame, spec, variant: str | None = None) -> DataFrame:
    """One row: total, passed, failed."""
    ok = passes(df, spec, variant)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("passed"),
        F.count_if(~ok).alias("failed"),
    )


# -- time range --------------------------------------------------------------------------

def in_time_range(column: Column, start=None, end=None) -> Column:
    """Inclusive range test; an open side accepts everything."""
    parts = []
    if start is not None:
        parts.append(column >= F.lit(start))
    if end is not None:
        parts.append(column <= F.lit(end))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


# -- ready-made custom operators ---------------------------------------------------------

def ipv4_number(text: Column) -> Column:
    """IPv4 address as a number; NULL when it is not one."""
    parts = F.split(text, r"\.")
    octets = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    valid = reduce(lambda a, b: a & b, [o.between(0, 255) for o in octets]) & (F.size(parts) == 4)
    return F.when(valid, reduce(lambda a, b: a * 256 + b, octets))


def ip_in_range(f: Field, cidr) -> Column:
    network = ipaddress.ip_network(str(cidr), strict=False)
    if network.version != 4:
        raise ValueError("only IPv4 ranges are supported")
    low, high = int(network.network_address), int(network.broadcast_address)
    return ipv4_number(f.text).between(low, high)


def _moment(f: Field) -> Column:
    if not f.variant and f.dtype.simpleString().startswith("timestamp"):
        return f.value.cast("timestamp")
    return f.text.try_cast("timestamp")


def date_after(f: Field, value) -> Column:
    return _moment(f) > F.lit(str(value)).cast("timestamp")


def date_before(f: Field, value) -> Column:
    return _moment(f) < F.lit(str(value)).cast("timestamp")


def jsonpath_exists(f: Field, path) -> Column:
    document = f.value if f.variant else F.try_parse_json(f.text)
    return F.try_variant_get(document, str(path), "variant").isNotNull()


def register_examples() -> None:
    """Register the four ready-made operators under their usual names."""
    for build in (ip_in_range, date_after, date_before, jsonpath_exists):
        register_operator(build.__name__, build)
