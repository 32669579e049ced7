"""The filter language: ``field op literal`` with AND, OR and parentheses, compiled to a Column.

AND binds tighter than OR, both from left to right. A record without a field doesn't match any
comparison on it: the language has no NOT, so SQL's three-valued logic says just that at the root.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..sources.schema import INT64, Field, Schema

LEXEME = re.compile(r"\s*(?:(?P<open>\()|(?P<close>\))|(?P<op>==|!=|>=|<=|>|<)|(?P<float>-?[0-9]+\.[0-9]*)|(?P<int>-?[0-9]+)|(?P<str>'[^']*')|(?P<word>[A-Za-z_][A-Za-z0-9_]*))")


@dataclass(frozen=True)
class Cmp:
    field: Field
    op: str
    kind: str  #: of the literal: int, float or str
    text: str  #: of the literal, without quotes


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


Node = Cmp | And | Or


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


def tokenize(text: str) -> list[Token]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = LEXEME.match(text, at)
        if m is None:
            raise InvalidQuery(f"unexpected {text[at:at + 10]!r}")
        kind, at = m.lastgroup, m.end()
        word = m[kind]
        if kind in ("int", "float") and at < end and (text[at].isalnum() or text[at] in "_."):
            raise InvalidQuery(f"a number runs on: {text[m.start():at + 1]!r}")
        if kind == "word" and word.lower() in ("and", "or"):
            kind = word.lower()
        out.append(Token(kind, word[1:-1] if kind == "str" else word))
    return out


class _Parser:
    def __init__(self, tokens: list[Token], schema: Schema) -> None:
        self.tokens, self.schema, self.at = tokens, schema, 0

    def peek(self) -> str:
        return self.tokens[self.at].kind if self.at < len(self.tokens) else "end"

    def take(self, *kinds: str) -> Token:
        if self.peek() not in kinds:
            raise InvalidQuery(f"expected {' or '.join(kinds)}, found {self.peek()}")
        self.at += 1
        return self.tokens[self.at - 1]

    def chain(self, word: str, make: type, part) -> Node:
        node = part()
        while self.peek() == word:
            self.take(word)
            node = make(node, part())
        return node

    def either(self) -> Node:
        return self.chain("or", Or, self.both)

    def both(self) -> Node:
        return self.chain("and", And, self.term)

    def term(self) -> Node:
        if self.peek() == "open":
            self.take("open")
            node = self.either()
            self.take("close")
            return node
        name = self.take("word").text
        field = self.schema.field(name)
        if field is None:
            raise InvalidQuery(f"no field {name!r}")
        op, literal = self.take("op").text, self.take("int", "float", "str")
        if field.kind != "string" and literal.kind == "str":
            raise InvalidQuery(f"{name} is {field.kind}; {literal.text!r} is a string")
        if field.kind == "int" and literal.kind == "int" and int(literal.text) not in INT64:
            raise InvalidQuery(f"{literal.text} is not a 64-bit number")
        return Cmp(field, op, literal.kind, literal.text)


def parse(text: str | None, schema: Schema, strict: bool = False) -> Node | None:
    """The tree; None for an empty filter, which matches all (``strict``: raises)."""
    if text is None or not text.strip():
        if strict:
            raise InvalidQuery("the filter is empty")
        return None
    parser = _Parser(tokenize(text), schema)
    node = parser.either()
    parser.take("end") if parser.peek() != "end" else None
    return node


def fields_of(node: Node | None) -> set[str]:
    if node is None:
        return set()
    return {node.field.name} if isinstance(node, Cmp) else fields_of(node.left) | fields_of(node.right)


def comparisons(node: Node | None) -> int:
    """How many comparisons the filter makes (sizes an approximate search)."""
    if node is None:
        return 0
    return 1 if isinstance(node, Cmp) else comparisons(node.left) + comparisons(node.right)


def to_column(node: Node | None) -> Column:
    if node is None:
        return F.lit(True)
    if isinstance(node, And):
        return to_column(node.left) & to_column(node.right)
    if isinstance(node, Or):
        return to_column(node.left) | to_column(node.right)
    column = F.col(f"`{node.field.name}`")
    if node.field.kind == "string":
        if node.op not in ("==", "!="):
            return F.lit(False)  # strings have no order here
        literal = F.lit(node.text)
    elif node.field.kind == "int" and node.kind == "int":
        literal = F.lit(int(node.text)).cast("long")
    else:
        literal = F.lit(float(node.text))
    out = {"==": column == literal, "!=": column != literal, ">": column > literal, ">=": column >= literal, "<": column < literal, "<=": column <= literal}[node.op]
    if node.field.kind == "float" and node.op in (">", ">="):
        out = ~F.isnan(column) & out  # NaN isn't above any number
    return out


def compile_filter(text: str | None, schema: Schema, strict: bool = False) -> Column:
    return to_column(parse(text, schema, strict))
