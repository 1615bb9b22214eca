"""Column references and the predicates made from them. All are values; nothing is resolved before a query is lowered."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

OPERATORS = ("=", "<>", ">", ">=", "<", "<=", "like", "not like", "<=>", "not <=>")


class Predicate:
    """A boolean expression; ``&``, ``|`` and ``~`` combine, and None operands are skipped."""

    def __and__(self, other: Predicate | None) -> Predicate:
        return self if other is None else And((self, other))

    def __or__(self, other: Predicate | None) -> Predicate:
        return self if other is None else Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def and_(self, *others: Predicate | None) -> Predicate:
        rest = tuple(o for o in others if o is not None)
        return And((self, *rest)) if rest else self

    def or_(self, *others: Predicate | None) -> Predicate:
        rest = tuple(o for o in others if o is not None)
        return Or((self, *rest)) if rest else self

    def not_(self) -> Predicate:
        return Not(self)

    def __bool__(self) -> bool:
        raise TypeError("use &, | and ~ instead of and, or and not")


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


@dataclass(frozen=True)
class Compare(Predicate):
    """``left op right``: a reference, item or text of SQL on the left; a value, reference or item on the right."""

    op: str
    left: Any
    right: Any

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"no operator {self.op!r}")


@dataclass(frozen=True)
class Between(Predicate):
    left: Any
    low: Any
    high: Any
    negated: bool = False


@dataclass(frozen=True)
class In(Predicate):
    """Membership in values. In an empty list: false; not in an empty list: true."""

    left: Any
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Predicate):
    left: Any
    negated: bool = False


@dataclass(frozen=True)
class Exists(Predicate):
    query: Any
    negated: bool = False


@dataclass(frozen=True)
class InQuery(Predicate):
    left: Any
    query: Any
    negated: bool = False


@dataclass(frozen=True)
class SqlText(Predicate):
    """A condition in SQL text, over the columns of the query's tables."""

    sql: str


@dataclass(frozen=True)
class Raw:
    """SQL text for the left side of a comparison, as in HAVING."""

    sql: str


def raw(sql: str, op: str, value: Any) -> Predicate:
    """A comparison whose left side is SQL text, such as ``sum(amount)``."""
    return Compare(op, Raw(sql), value)


def exists(query: Any) -> Predicate:
    return Exists(query)


def not_exists(query: Any) -> Predicate:
    return Exists(query, True)


class Comparable:
    """What can stand on the left of a predicate."""

    __hash__ = object.__hash__

    def eq(self, v: Any) -> Predicate:
        return Compare("=", self, v)

    def ne(self, v: Any) -> Predicate:
        return Compare("<>", self, v)

    def gt(self, v: Any) -> Predicate:
        return Compare(">", self, v)

    def gte(self, v: Any) -> Predicate:
        return Compare(">=", self, v)

    def lt(self, v: Any) -> Predicate:
        return Compare("<", self, v)

    def lte(self, v: Any) -> Predicate:
        return Compare("<=", self, v)

    __eq__, __ne__, __gt__, __ge__, __lt__, __le__ = eq, ne, gt, gte, lt, lte  # type: ignore[assignment]


@dataclass(frozen=True, eq=False)
class Order:
    """A sort key. Nulls come first when ascending and last when descending, unless said otherwise."""

    key: Any
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True, eq=False)
class ColumnRef(Comparable):
    """A column of a table or alias."""

    table: str | None
    name: str
    label: str | None = None
    #: Of a JSON field: the DDL of its document.
    json: str | None = None

    def document(self, path: str) -> Document:
        """A part of a JSON field's document, with dots for parts of parts."""
        if self.json is None:
            raise ValueError(f"{self.name} is no JSON field")
        return Document(self, path)

    def like(self, pattern: str) -> Predicate:
        return Compare("like", self, pattern)

    def not_like(self, pattern: str) -> Predicate:
        return Compare("not like", self, pattern)

    def eq_distinct(self, v: Any) -> Predicate:
        """Equal, where null equals null."""
        return Compare("<=>", self, v)

    def ne_distinct(self, v: Any) -> Predicate:
        return Compare("not <=>", self, v)

    def in_(self, values: Any) -> Predicate:
        return In(self, tuple(values))

    def not_in(self, values: Any) -> Predicate:
        return In(self, tuple(values), True)

    def between(self, low: Any, high: Any) -> Predicate:
        return Between(self, low, high)

    def not_between(self, low: Any, high: Any) -> Predicate:
        return Between(self, low, high, True)

    def is_null(self) -> Predicate:
        return IsNull(self)

    def is_not_null(self) -> Predicate:
        return IsNull(self, True)

    def eq_col(self, other: ColumnRef) -> Predicate:
        return Compare("=", self, other)

    def compare(self, op: str, other: Any) -> Predicate:
        """Any operator, so joins need not be equi-joins."""
        return Compare(op, self, other)

    def in_query(self, query: Any) -> Predicate:
        return InQuery(self, query)

    def not_in_query(self, query: Any) -> Predicate:
        return InQuery(self, query, True)

    def asc(self, nulls_first: bool | None = None) -> Order:
        return Order(self, False, nulls_first)

    def desc(self, nulls_first: bool | None = None) -> Order:
        return Order(self, True, nulls_first)

    def as_(self, label: str) -> ColumnRef:
        return ColumnRef(self.table, self.name, label, self.json)


@dataclass(frozen=True, eq=False)
class Document(Comparable):
    """A part of the document in a JSON column, typed by the field's DDL; null where the text does not hold it."""

    column: ColumnRef
    path: str
    label: str | None = None

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]

    def as_(self, label: str) -> Document:
        return Document(self.column, self.path, label)

    def is_null(self) -> Predicate:
        return IsNull(self)

    def asc(self, nulls_first: bool | None = None) -> Order:
        return Order(self, False, nulls_first)

    def desc(self, nulls_first: bool | None = None) -> Order:
        return Order(self, True, nulls_first)
