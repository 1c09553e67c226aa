"""The filter language over clusters, compiled to a column.

    or := and (OR and)*     and := not (AND not)*     not := NOT not | ( or ) | comparison
    comparison := field (== = != < <= > >=) value | field [NOT] IN ( [value (, value)* [,]] )
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchglass.plans.schema import PRIORITIES


class FilterSyntaxError(ValueError):
    """The text is no filter."""


class FilterEvalError(ValueError):
    """The filter compares what can't be compared."""


FIELDS = {"priority": "priority_rank", "category": "first_category", "ioc_count": "ioc_count", "alert_count": "alert_count", "confidence_score": "confidence"}
OPERATORS = {"==": operator.eq, "=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
TOKEN = re.compile(r"""\s*(?:(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<quoted>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<word>[A-Za-z_][\w.-]*)|(?P<op>==|!=|<=|>=|=|<|>)|(?P<mark>[(),]))""")
KEYWORDS = ("AND", "OR", "NOT", "IN")


@dataclass(frozen=True)
class Token:
    kind: str
    value: str | int | float
    at: int


def tokens(text: str) -> list[Token]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        found = TOKEN.match(text, at)
        if not found:
            raise FilterSyntaxError(f"unexpected {text[at:].strip()[:1]!r} at {at}")
        kind, value, at = found.lastgroup, found.group(found.lastgroup), found.end()
        if kind == "number":
            value = float(value) if "." in value else int(value)
        elif kind == "quoted":
            kind, value = "text", re.sub(r"\\(.)", r"\1", value[1:-1])
        elif kind == "word" and value.upper() in KEYWORDS:
            kind, value = "keyword", value.upper()
        out.append(Token(kind, value, found.start()))
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at].kind in ("keyword", "mark", "op") and self.tokens[self.at].value in values

    def take(self) -> Token:
        if self.at >= len(self.tokens):
            raise FilterSyntaxError("unexpected end")
        self.at += 1
        return self.tokens[self.at - 1]

    def skip(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.skip(value):
            raise FilterSyntaxError(f"{value!r} expected")

    def whole(self) -> Column:
        out = self.either()
        if self.at < len(self.tokens):
            raise FilterSyntaxError(f"unexpected {self.tokens[self.at].value!r}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.skip("OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.negated()
        while self.skip("AND"):
            out = out & self.negated()
        return out

    def negated(self) -> Column:
        if self.skip("NOT"):
            return ~self.negated()
        if self.skip("("):
            out = self.either()
            self.expect(")")
            return out
        return self.comparison()

    def value(self) -> str | int | float:
        token = self.take()
        if token.kind not in ("word", "text", "number"):
            raise FilterSyntaxError(f"a value expected, not {token.value!r}")
        return token.value

    def comparison(self) -> Column:
        token = self.take()
        if token.kind != "word":
            raise FilterSyntaxError(f"a field expected, not {token.value!r}")
        name = str(token.value)
        if name not in FIELDS:
            raise FilterEvalError(f"unknown field {name!r}")
        denied = self.skip("NOT")
        if self.skip("IN"):
            self.expect("(")
            values = []
            while not self.skip(")"):
                values.append(self.value())
                if not self.peek(")"):
                    self.expect(",")
            if name != "category":
                raise FilterEvalError("IN is for category alone")
            found = F.lower(F.col(FIELDS[name])).isin(*[str(v).lower() for v in values]) if values else F.lit(False)
            return ~found if denied else found
        if denied:
            raise FilterSyntaxError("IN expected after NOT")
        op = self.take()
        if op.kind != "op":
            raise FilterSyntaxError(f"an operator expected, not {op.value!r}")
        return compare(name, str(op.value), self.value())


def compare(name: str, op: str, value: str | int | float) -> Column:
    column, apply = F.col(FIELDS[name]), OPERATORS[op]
    ordered = op not in ("==", "=", "!=")
    if name == "priority":
        rank = PRIORITIES.index(str(value).upper()) if str(value).upper() in PRIORITIES else None
        if rank is None and ordered:
            raise FilterEvalError(f"{value!r} is no priority")
        return apply(column, F.lit(-1 if rank is None else rank))
    if name == "category":
        if ordered:
            raise FilterEvalError("category has no order")
        return apply(column, F.lit(str(value)))
    if isinstance(value, str):
        if ordered:
            raise FilterEvalError(f"{name} is a number, {value!r} isn't")
        return F.lit(op == "!=")
    return apply(column, F.lit(value))


def parse_filter(text: str) -> Column:
    """A filter as a Boolean column over clusters; raises where the text or a comparison is wrong."""
    if not text.strip():
        raise FilterSyntaxError("an empty filter")
    return _Parser(text).whole()
