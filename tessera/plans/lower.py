"""From query values to Spark columns and DataFrames.

The order is fixed: scan, joins, filter (with the soft-delete predicate), grouping with the aggregates that HAVING and
ORDER BY need beside those selected, HAVING, windows, DISTINCT, ORDER BY, OFFSET, LIMIT, projection, preloads. Catalyst
does the rest: predicates reach the scan, unused columns are never read, joins pick their own strategy.
"""

from __future__ import annotations

import functools
import operator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.items import AGGREGATES, Item
from ..functions.refs import And, Between, ColumnRef, Compare, Document, Exists, In, InQuery, IsNull, Not, Or, Order, Predicate, Raw, SqlText

_COMPARE = {
    "=": operator.eq, "<>": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le,
    "like": lambda a, b: a.like(b), "not like": lambda a, b: ~a.like(b),
    "<=>": lambda a, b: a.eqNullSafe(b), "not <=>": lambda a, b: ~a.eqNullSafe(b),
}


def quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


class Scope:
    """The tables that a query's references can name, and those of the queries around it.

    ``grouped`` maps group keys and aggregates to the columns that grouping has made of them.
    """

    def __init__(self, names: list[str], main: str, outer: Scope | None = None) -> None:
        self.names, self.main, self.outer = names, main, outer
        self.grouped: dict[Any, str] = {}

    def column(self, ref: ColumnRef) -> Column:
        if (name := self.grouped.get((ref.table or self.main, ref.name))) is not None:
            return F.col(quoted(name))
        if self.grouped and (ref.table in (None, *self.names)):
            raise ValueError(f"{ref.table}.{ref.name} is neither grouped nor aggregated")
        if ref.table is None:
            return F.col(quoted(self.main, ref.name))
        if ref.table in self.names:
            return F.col(quoted(ref.table, ref.name))
        scope = self.outer
        while scope is not None:
            if ref.table in scope.names:
                return F.col(quoted(ref.table, ref.name)).outer()
            scope = scope.outer
        raise ValueError(f"no table or alias {ref.table!r} in this query; there are {', '.join(self.names)}")

    def value(self, x: Any) -> Column:
        """A reference, an item, text of SQL or a literal."""
        if isinstance(x, ColumnRef):
            return self.column(x)
        if isinstance(x, Item):
            return self.item(x)
        if isinstance(x, Document):
            return functools.reduce(lambda c, part: c[part], x.path.split("."), F.from_json(self.column(x.column), x.column.json))
        if isinstance(x, Raw):
            return F.col(quoted(self.grouped[x.sql])) if x.sql in self.grouped else F.expr(x.sql)
        return F.lit(x)

    def aggregate(self, x: Item) -> Column:
        if x.function not in AGGREGATES:
            raise ValueError(f"{x.function} needs over()")
        if x.function == "count":
            return F.count(F.lit(1) if x.column is None else self.column(x.column))
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[x.function](self.column(x.column))

    def item(self, x: Item) -> Column:
        if x.window is None:
            if (name := self.grouped.get(item_key(x, self.main))) is not None:
                return F.col(quoted(name))
            return self.aggregate(x)
        partition, order = x.window
        keys = [self.value(p.key if isinstance(p, Order) else (ColumnRef(None, p) if isinstance(p, str) else p)) for p in partition]
        w = Window.partitionBy(*keys)
        if order:
            w = w.orderBy(*(self.order(o) for o in order))
        made = {
            "row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank,
            "lag": lambda: F.lag(self.column(x.column), 1), "lead": lambda: F.lead(self.column(x.column), 1),
        }.get(x.function)
        out = (made() if made else self.aggregate(x)).over(w)
        return out.cast("bigint") if x.function in ("row_number", "rank", "dense_rank") else out

    def order(self, o: Order) -> Column:
        c = self.value(o.key)
        if o.descending:
            return c.desc_nulls_first() if o.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_last() if o.nulls_first is False else c.asc_nulls_first()

    def predicate(self, p: Predicate) -> Column:
        if isinstance(p, And):
            return functools.reduce(operator.and_, map(self.predicate, p.parts))
        if isinstance(p, Or):
            return functools.reduce(operator.or_, map(self.predicate, p.parts))
        if isinstance(p, Not):
            return ~self.predicate(p.part)
        if isinstance(p, SqlText):
            return F.expr(p.sql)
        if isinstance(p, Compare):
            right = p.right if p.op.endswith("like") else self.value(p.right)
            return _COMPARE[p.op](self.value(p.left), right)
        if isinstance(p, Between):
            out = self.value(p.left).between(self.value(p.low), self.value(p.high))
        elif isinstance(p, In):
            if not p.values:
                return F.lit(p.negated)
            out = self.value(p.left).isin(*map(F.lit, p.values))
        elif isinstance(p, IsNull):
            out = self.value(p.left).isNull()
        elif isinstance(p, Exists):
            out = p.query.lowered(self).exists()
        elif isinstance(p, InQuery):
            out = self.value(p.left).isin(p.query.lowered(self))
        else:
            raise TypeError(f"not a predicate: {p!r}")
        return ~out if p.negated else out


def item_key(x: Item, main: str) -> tuple:
    """What makes two aggregates the same, whatever their labels."""
    return (x.function, None if x.column is None else (x.column.table or main, x.column.name))


def aggregates_in(x: Any) -> list[Any]:
    """The aggregates and SQL texts that a predicate, order or item needs."""
    if isinstance(x, Item):
        if x.window is None:
            return [x]
        partition, order = x.window
        return [y for k in (*partition, *(o.key for o in order)) if isinstance(k, Item) for y in aggregates_in(k)]
    if isinstance(x, Raw):
        return [x]
    if isinstance(x, Order):
        return aggregates_in(x.key)
    if isinstance(x, (And, Or)):
        return [y for p in x.parts for y in aggregates_in(p)]
    if isinstance(x, Not):
        return aggregates_in(x.part)
    if isinstance(x, Compare):
        return aggregates_in(x.left) + aggregates_in(x.right)
    if isinstance(x, (Between, In, IsNull)):
        return aggregates_in(x.left)
    return []


def label_of(x: Any) -> str:
    """The name of a select item in the result."""
    if x.label:
        return x.label
    return x.name if isinstance(x, (ColumnRef, Document)) else x.function + (f"_{x.column.name}" if x.column is not None else "")


def lower(q: Any, outer: Scope | None = None) -> DataFrame:
    """The DataFrame of a query without its preloads."""
    meta = q.model.__meta__
    main = q.name
    names = [main, *(j.name for j in q.joins)]
    if len(set(names)) < len(names):
        raise ValueError(f"a table or alias occurs twice: {', '.join(names)}; give one an alias")
    scope = Scope(names, main, outer)
    df = q.scan(q.model).select(*meta.columns).alias(main)
    for j in q.joins:
        other = q.scan(j.model).select(*j.model.__meta__.columns).alias(j.name)
        df = df.crossJoin(other) if j.on is None else df.join(other, scope.predicate(j.on), j.kind)
    where = list(q.predicates)
    if meta.soft_delete and not q.with_deleted:
        where.append(ColumnRef(main, meta.soft_delete).is_null())
    for p in where:
        df = df.where(scope.predicate(p))
    items = list(q.items) or [ColumnRef(main, c) for c in meta.columns]
    needed = [a for x in (*items, *([q.condition] if q.condition is not None else []), *q.orders) for a in aggregates_in(x)]
    grouped = bool(q.groups or any(isinstance(x, Item) and x.window is None for x in items) or q.condition is not None)
    if grouped:
        keys = {(g.table or main, g.name): f"key{i}_" for i, g in enumerate(q.groups)}
        made: dict[Any, tuple[str, Column]] = {}
        for a in needed:
            k = a.sql if isinstance(a, Raw) else item_key(a, main)
            if k not in made:
                made[k] = (f"agg{len(made)}_", F.expr(a.sql) if isinstance(a, Raw) else scope.aggregate(a))
        columns = [scope.column(g).alias(keys[g.table or main, g.name]) for g in q.groups]
        totals = [c.alias(n) for n, c in made.values()] or [F.count(F.lit(1)).alias("agg_")]
        df = df.groupBy(*columns).agg(*totals)
        scope.grouped = keys | {k: n for k, (n, _) in made.items()}
        if q.condition is not None:
            df = df.where(scope.predicate(q.condition))
    windows = [x for x in items if isinstance(x, Item) and x.window is not None]
    selected = [scope.value(x).alias(label_of(x)) for x in items]
    if q.distinct_rows or outer is not None and not q.orders:
        df = df.select(*selected)
        if q.distinct_rows:
            df = df.distinct()
        if q.orders:
            by = {sort_key(x, main): label_of(x) for x in items}
            missing = [o for o in q.orders if sort_key(o.key, main) not in by]
            if missing:
                raise ValueError("with distinct, rows are ordered by selected columns only")
            df = df.orderBy(*(_direct(F.col(quoted(by[sort_key(o.key, main)])), o) for o in q.orders))
    else:
        if windows and q.orders:
            # window values come first, so that rows can be ordered by them
            df = df.select("*", *(scope.value(x).alias(f"win{i}_") for i, x in enumerate(windows)))
            value = {id(x): F.col(f"win{i}_") for i, x in enumerate(windows)}
            same = {sort_key(x, main): value[id(x)] for x in windows}
            orders = [_direct(same[sort_key(o.key, main)], o) if sort_key(o.key, main) in same else scope.order(o) for o in q.orders]
            selected = [(value[id(x)] if id(x) in value else scope.value(x)).alias(label_of(x)) for x in items]
            df = df.orderBy(*orders)
        elif q.orders:
            df = df.orderBy(*map(scope.order, q.orders))
    if q.skip > 0:
        df = df.offset(q.skip)
    if q.most > 0:
        df = df.limit(q.most)
    return df if q.distinct_rows or outer is not None and not q.orders else df.select(*selected)


def _direct(c: Column, o: Order) -> Column:
    if o.descending:
        return c.desc_nulls_first() if o.nulls_first else c.desc_nulls_last()
    return c.asc_nulls_last() if o.nulls_first is False else c.asc_nulls_first()


def sort_key(x: Any, main: str) -> Any:
    """What makes two sort keys or items the same."""
    if isinstance(x, ColumnRef):
        return (x.table or main, x.name)
    if isinstance(x, Item):
        window = None
        if x.window is not None:
            window = tuple(sort_key(p, main) for p in x.window[0]), tuple((sort_key(o.key, main), o.descending) for o in x.window[1])
        return (*item_key(x, main), window)
    if isinstance(x, Document):
        return (x.column.table or main, x.column.name, x.path)
    return x
