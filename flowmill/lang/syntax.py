"""Syntax trees of pipeline documents."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class DocumentError(ValueError):
    """A document that can't be read or planned; `line` is where, if known."""

    def __init__(self, message: str, line: int | None = None):
        super().__init__(message if line is None else f"line {line}: {message}")
        self.line = line


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]

    def __str__(self) -> str:
        return ".".join(self.path)


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class NullTest:
    operand: Expr
    negated: bool


@dataclass(frozen=True)
class When:
    branches: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Array:
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class PluginCall:
    plugin: str
    inputs: tuple[tuple[str, Name], ...]


Expr = Literal | Name | Binary | NullTest | When | Call | Array | PluginCall
Attributes = dict[str, Expr]


@dataclass
class Block:
    """Attributes and named blocks inside."""

    attributes: Attributes = field(default_factory=dict)
    blocks: dict[str, Block] = field(default_factory=dict)


@dataclass
class Join:
    alias: str
    table: str
    condition: Expr | None
    how: str = "inner"


@dataclass
class Check:
    kind: str
    name: str
    check: Expr
    message: str | None = None
    action: str | None = None


@dataclass
class Pipeline:
    name: str
    attributes: Attributes = field(default_factory=dict)
    source: Block = field(default_factory=Block)
    target: Block = field(default_factory=Block)
    references: Attributes | None = None
    table_map: dict[str, str] = field(default_factory=dict)
    where: list[tuple[str | None, list[Expr]]] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)
    select: list[tuple[str, Expr]] | None = None
    named_selects: dict[str, list[tuple[str, Expr]]] = field(default_factory=dict)
    checks: list[Check] = field(default_factory=list)
    on_error: Block = field(default_factory=Block)
    paginate: Attributes | None = None
    before: list[str] = field(default_factory=list)
    after: list[str] = field(default_factory=list)
    settings: Attributes = field(default_factory=dict)
    line: int = 0


@dataclass
class Document:
    define: Attributes = field(default_factory=dict)
    execution: Attributes = field(default_factory=dict)
    connections: dict[str, Block] = field(default_factory=dict)
    plugins: dict[str, Block] = field(default_factory=dict)
    pipelines: list[Pipeline] = field(default_factory=list)
    repeated: list[str] = field(default_factory=list)
