"""Set operations over queries."""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NoRows
from ..functions.refs import ColumnRef, Order
from ..plans.lower import _direct, quoted

_FOLD = {
    "union": lambda a, b: a.union(b).distinct(),
    "union all": lambda a, b: a.union(b),
    "intersect": lambda a, b: a.intersect(b),
    "except": lambda a, b: a.subtract(b),
}


@dataclass(frozen=True, eq=False)
class Compound:
    """One operation over all arms, from the left; order, limit and offset hold for the whole, those of arms are dropped."""

    kind: str
    arms: tuple[Any, ...]
    orders: tuple[Order, ...] = ()
    most: int = 0
    skip: int = 0

    def order_by(self, *orders: Any) -> Compound:
        """By columns of the result, which has the names of the first arm."""
        return replace(self, orders=(*self.orders, *(o if isinstance(o, Order) else Order(o) for o in orders)))

    def limit(self, n: int) -> Compound:
        return replace(self, most=n)

    def offset(self, n: int) -> Compound:
        return replace(self, skip=n)

    def lowered(self, outer: Any = None) -> DataFrame:
        if any(a.paths for a in self.arms):
            raise ValueError("the arms of a set operation cannot preload")
        arms = [replace(a, orders=(), most=0, skip=0).lowered(outer) for a in self.arms]
        first = arms[0].schema
        for a in arms[1:]:
            kinds = [f.dataType.simpleString() for f in a.schema]
            if kinds != [f.dataType.simpleString() for f in first]:
                raise ValueError(f"arms differ: {first.simpleString()} and {a.schema.simpleString()}")
        df = functools.reduce(_FOLD[self.kind], arms)
        if self.orders:
            name = lambda k: k.label or k.name if isinstance(k, ColumnRef) else str(k)
            df = df.orderBy(*(_direct(F.col(quoted(name(o.key))), o) for o in self.orders))
        if self.skip > 0:
            df = df.offset(self.skip)
        return df.limit(self.most) if self.most > 0 else df

    def df(self) -> DataFrame:
        return self.lowered()

    def sql(self, redact: Any = None) -> str:
        """The whole as SQL text that can be pasted."""
        from ..render import query_sql

        return query_sql(self, redact)

    def all(self) -> list:
        return [self.arms[0].model.from_row(r) for r in self._run("select", lambda: self.df().collect(), len)]

    def one(self) -> Any:
        if not (rows := self.limit(1).all()):
            raise NoRows("no row")
        return rows[0]

    def count(self) -> int:
        return self._run("count", lambda: replace(self, orders=()).df().count(), lambda n: 1)

    def _run(self, op: str, work: Any, rows: Any) -> Any:
        first = self.arms[0]
        o, name = first.engine.observer, first.model.__meta__.table
        return first.engine.watched(op, name, f"{self.kind} of {len(self.arms)} queries, first on {name}", o.query_args(self), work, rows, lambda: self.sql(o.redacted))
