"""The immutable query builder: every method returns a new query, nothing runs before a terminal."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NoRows
from ..functions.refs import And, ColumnRef, Order, Predicate
from ..model import Aliased, Model
from ..plans.lower import Scope, label_of, lower
from . import preload as preloading

KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")


@dataclass(frozen=True)
class Join:
    kind: str
    model: type[Model]
    name: str
    on: Predicate | None


@dataclass(frozen=True, eq=False)
class Query:
    """A SELECT over one model's table, with joins to others."""

    engine: Any
    model: type[Model]
    name: str
    predicates: tuple[Predicate, ...] = ()
    items: tuple[Any, ...] = ()
    joins: tuple[Join, ...] = ()
    groups: tuple[ColumnRef, ...] = ()
    condition: Predicate | None = None
    orders: tuple[Order, ...] = ()
    most: int = 0
    skip: int = 0
    distinct_rows: bool = False
    with_deleted: bool = False
    paths: tuple[str, ...] = ()
    scoped_relations: bool = False
    ctes: tuple[tuple[str, str, dict | None, bool, tuple[str, ...]], ...] = ()
    locked: str | None = None
    sources: dict = field(default_factory=dict)

    # building

    def where(self, *predicates: Predicate | None) -> Query:
        """Conditions, all of which hold; repeated calls add to them."""
        return replace(self, predicates=(*self.predicates, *(p for p in predicates if p is not None)))

    def select(self, *items: Any) -> Query:
        """Columns, aggregates and window functions; repeated calls add to them. None selected: all columns."""
        return replace(self, items=(*self.items, *items))

    def distinct(self) -> Query:
        return replace(self, distinct_rows=True)

    def as_(self, name: str) -> Query:
        """An alias for the query's own table."""
        return replace(self, name=Aliased(self.model, name).name)

    def join(self, other: type[Model] | Aliased, on: Predicate | None = None, kind: str = "inner") -> Query:
        """A join with another table; without a condition the cross join."""
        if kind not in KINDS:
            raise ValueError(f"no join kind {kind!r}; there are {', '.join(KINDS)}")
        if on is None and kind != "inner":
            raise ValueError(f"a {kind} join needs a condition")
        model, name = (other.model, other.name) if isinstance(other, Aliased) else (other, other.__meta__.table)
        return replace(self, joins=(*self.joins, Join(kind, model, name, on)))

    def left_join(self, other: Any, on: Predicate) -> Query:
        return self.join(other, on, "left")

    def right_join(self, other: Any, on: Predicate) -> Query:
        return self.join(other, on, "right")

    def full_join(self, other: Any, on: Predicate) -> Query:
        return self.join(other, on, "full")

    def cross_join(self, other: Any) -> Query:
        return self.join(other)

    def group_by(self, *columns: ColumnRef) -> Query:
        return replace(self, groups=(*self.groups, *columns))

    def having(self, p: Predicate) -> Query:
        """A condition on groups; a repeated call replaces it."""
        return replace(self, condition=p)

    def order_by(self, *orders: Any) -> Query:
        return replace(self, orders=(*self.orders, *(o if isinstance(o, Order) else Order(o) for o in orders)))

    def limit(self, n: int) -> Query:
        """At most n rows; 0 and less: no limit."""
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def unscoped(self) -> Query:
        """With soft-deleted rows."""
        return replace(self, with_deleted=True)

    def preload(self, *paths: str, scoped: bool | None = None) -> Query:
        """Relations to load as nested columns, with dots for relations of relations. ``scoped`` hides their deleted rows."""
        return replace(self, paths=(*self.paths, *paths), scoped_relations=self.scoped_relations if scoped is None else scoped)

    def with_(self, name: str, sql: str, args: dict | None = None, recursive: bool = False, columns: tuple[str, ...] = ()) -> Query:
        """A common table expression, which a model registered under ``name`` can scan."""
        return replace(self, ctes=(*self.ctes, (name, sql, args, recursive, columns)))

    def for_update(self, nowait: bool = False) -> Query:
        """Makes the enclosing transaction fail at its end (with ``nowait``: at once) if the table has changed meanwhile."""
        return replace(self, locked="nowait" if nowait else "update")

    def for_share(self) -> Query:
        return replace(self, locked="share")

    # lowering

    def scan(self, model: type[Model]) -> DataFrame:
        return self.sources[model] if model in self.sources else self.engine.read(model)

    def lowered(self, outer: Scope | None = None) -> DataFrame:
        """The DataFrame of the query as part of another one."""
        q = replace(self, sources={**self.sources, **self.engine.with_ctes(self.ctes)}) if self.ctes else self
        return lower(q, outer)

    def df(self) -> DataFrame:
        """The query as one lazy DataFrame, preloads included."""
        if self.locked:
            self.engine.lock(self.model, self.locked)
        if not self.paths:
            return self.lowered()
        if self.items or self.groups:
            raise ValueError("preload needs whole rows of the model")
        # rows under a limit are looked up more than once, so their order must leave no choice
        keys = [ColumnRef(self.name, k).asc() for k in self.model.__meta__.pk] if self.most > 0 or self.skip > 0 else []
        return preloading.apply(self, replace(self, orders=(*self.orders, *keys)).lowered())

    def explain(self, mode: str = "formatted") -> None:
        self.df().explain(mode)

    def sql(self, redact: Any = None) -> str:
        """The query, without its preloads, as SQL text that can be pasted. ``redact`` tells columns whose values are masked."""
        from ..render import query_sql

        return query_sql(self, redact)

    def plan(self) -> str:
        """The optimised plan as text, for logs."""
        return self.df()._jdf.queryExecution().optimizedPlan().toString()

    def union(self, *others: Query) -> Any:
        from .compound import Compound

        return Compound("union", (self, *others))

    def union_all(self, *others: Query) -> Any:
        from .compound import Compound

        return Compound("union all", (self, *others))

    def intersect(self, *others: Query) -> Any:
        from .compound import Compound

        return Compound("intersect", (self, *others))

    def except_(self, *others: Query) -> Any:
        from .compound import Compound

        return Compound("except", (self, *others))

    # terminals

    def all(self) -> list:
        """Instances of the model, with relations that were preloaded."""
        return self.all_into(self.model)

    def all_into(self, model: type[Model]) -> list:
        """Instances of another model, routed by column name."""
        if self.paths and model is not self.model:
            raise ValueError("preload needs rows of the query's own model")
        return [model.from_row(r) for r in self._run("select", lambda: self.df().collect(), len)]

    def one(self) -> Any:
        """The first row; NoRows without one."""
        rows = self.limit(1).all()
        if not rows:
            raise NoRows(f"{self.model.__meta__.table}: no row")
        return rows[0]

    def count(self) -> int:
        """Rows of the result, before limit and offset; of groups or distinct rows: how many those are."""
        if self.paths:
            raise ValueError("a count has nothing to preload")
        q = replace(self, orders=(), most=0, skip=0)
        return self._run("count", lambda: q.lowered().agg(F.count(F.lit(1))).first()[0], lambda n: 1)

    def _run(self, op: str, work: Any, rows: Any) -> Any:
        began = time.perf_counter()
        try:
            out = work()
        except Exception as e:
            self.engine.observe(op, self, time.perf_counter() - began, None, e)
            raise
        self.engine.observe(op, self, time.perf_counter() - began, rows(out), None)
        return out

    def condition_of(self) -> Predicate | None:
        return And(self.predicates) if self.predicates else None


def describe(q: Query) -> str:
    """A short text of a query for logs; values are told apart in ``observe``."""
    items = ", ".join(label_of(x) for x in q.items) or "*"
    return f"select {items} from {q.model.__meta__.table}" + "".join(f" {j.kind} join {j.name}" for j in q.joins)
