"""Aggregates and window functions as items of a select list."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from .refs import ColumnRef, Comparable, Compare, Order, Predicate

AGGREGATES = ("count", "sum", "avg", "min", "max")
RANKING = ("row_number", "rank", "dense_rank", "lag", "lead")


@dataclass(frozen=True, eq=False)
class Item(Comparable):
    """A function of a column; ``window`` holds partition and order where it is a window function."""

    function: str
    column: ColumnRef | None = None
    label: str | None = None
    window: tuple[tuple, tuple] | None = None

    def as_(self, label: str) -> Item:
        return replace(self, label=label)

    def over(self, partition: Any = (), order: Any = ()) -> Item:
        """As a window function with the default frame: up to the current row's peers if ordered, else all rows.

        Keys are references, orders, or text such as ``"salary desc"``.
        """
        many = lambda x: tuple(x) if isinstance(x, (list, tuple)) else (x,)
        return replace(self, window=(many(partition), tuple(parse_order(o) for o in many(order))))

    def asc(self) -> Order:
        return Order(self)

    def desc(self) -> Order:
        return Order(self, True)


def parse_order(key: Any) -> Order:
    """An order from a reference or from text with a direction."""
    if isinstance(key, Order):
        return key
    if isinstance(key, str):
        name, _, direction = key.strip().partition(" ")
        if direction.strip().lower() not in ("", "asc", "desc") or not name.replace(".", "").replace("_", "").isalnum():
            raise ValueError(f"not a sort key: {key!r}")
        table, _, column = name.rpartition(".")
        return Order(ColumnRef(table or None, column), direction.strip().lower() == "desc")
    return Order(key)


def count(column: ColumnRef | None = None) -> Item:
    return Item("count", column)


def sum_(column: ColumnRef) -> Item:
    return Item("sum", column)


def avg(column: ColumnRef) -> Item:
    return Item("avg", column)


def min_(column: ColumnRef) -> Item:
    return Item("min", column)


def max_(column: ColumnRef) -> Item:
    return Item("max", column)


def row_number() -> Item:
    return Item("row_number")


def rank() -> Item:
    return Item("rank")


def dense_rank() -> Item:
    return Item("dense_rank")


def lag(column: ColumnRef) -> Item:
    """The value one row before, null for the first row of a partition."""
    return Item("lag", column)


def lead(column: ColumnRef) -> Item:
    return Item("lead", column)


def count_gt(n: int) -> Predicate:
    return Compare(">", count(), n)


def count_gte(n: int) -> Predicate:
    return Compare(">=", count(), n)


def count_lt(n: int) -> Predicate:
    return Compare("<", count(), n)
