"""Syntax tree of a query."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Name:
    """A column, maybe with what it belongs to: ``a``, ``t.a``."""

    path: str


@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool | None


@dataclass(frozen=True)
class Not:
    expr: Expr


@dataclass(frozen=True)
class Binary:
    """AND, OR, LIKE or a comparison."""

    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class InList:
    expr: Expr
    values: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between:
    expr: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    expr: Expr
    negated: bool = False


Expr = Name | Literal | Not | Binary | InList | Between | IsNull


@dataclass(frozen=True)
class Item:
    """One entry of the select list; path '*' stands for all columns."""

    path: str
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    path: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    table: Table
    on: Expr


@dataclass(frozen=True)
class Order:
    path: str
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: Table
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group_by: tuple[str, ...] = ()
    having: Expr | None = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    distinct: bool = False
