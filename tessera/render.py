"""Statements as SQL text that can be pasted: values in place, sensitive ones masked on demand.

The text is for logs, previews and shells; queries run as DataFrames, not by it.
"""

from __future__ import annotations

import dataclasses
import datetime
import math
import re
from collections.abc import Callable
from typing import Any

from .functions.items import Item
from .functions.refs import And, Between, ColumnRef, Compare, Document, Exists, In, InQuery, IsNull, Not, Or, Order, Raw, SqlText
from .observe import MASK, name_of
from .operators.dml import Value, literal

Redact = Callable[[str], bool]


def text_literal(v: Any) -> str:
    """A value as a literal that reads well."""
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float) and math.isfinite(v):
        return f"{v!r}D"
    if isinstance(v, datetime.datetime) and v.tzinfo is None:
        return f"TIMESTAMP_NTZ'{v.isoformat(sep=' ')}'"
    return literal(v).sql


class Renderer:
    def __init__(self, redact: Redact | None = None) -> None:
        self.redact = redact or (lambda column: False)

    def value(self, x: Any, column: str = "", main: str | None = None) -> str:
        if isinstance(x, ColumnRef):
            return ".".join(f"`{p}`" for p in (x.table or main, x.name) if p)
        if isinstance(x, Item):
            return self.item(x, main)
        if isinstance(x, Document):
            return f"from_json({self.value(x.column, main=main)}, {text_literal(x.column.json)}).{x.path}"
        if isinstance(x, (Raw, Value)):
            return x.sql
        return f"'{MASK}'" if self.redact(column) else text_literal(x)

    def item(self, x: Item, main: str | None) -> str:
        out = f"{x.function}({'*' if x.column is None and x.function == 'count' else '' if x.column is None else self.value(x.column, main=main)})"
        if x.window is not None:
            partition, order = x.window
            keys = [self.value(p.key if isinstance(p, Order) else ColumnRef(None, p) if isinstance(p, str) else p, main=main) for p in partition]
            parts = [f"PARTITION BY {', '.join(keys)}"] * bool(keys) + [f"ORDER BY {', '.join(self.order(o, main) for o in order)}"] * bool(order)
            out += f" OVER ({' '.join(parts)})"
        return out

    def order(self, o: Order, main: str | None) -> str:
        first = o.nulls_first if o.nulls_first is not None else not o.descending
        return f"{self.value(o.key, main=main)} {'DESC' if o.descending else 'ASC'} NULLS {'FIRST' if first else 'LAST'}"

    def predicate(self, p: Any, main: str | None = None) -> str:
        if isinstance(p, (And, Or)):
            return "(" + (" AND " if isinstance(p, And) else " OR ").join(self.predicate(x, main) for x in p.parts) + ")"
        if isinstance(p, Not):
            return f"(NOT {self.predicate(p.part, main)})"
        if isinstance(p, SqlText):
            return f"({p.sql})"
        if isinstance(p, Exists):
            return f"{'NOT ' if p.negated else ''}EXISTS ({self.query(p.query)})"
        left, name = self.value(p.left, main=main), name_of(p.left)
        negated = "NOT " if getattr(p, "negated", False) else ""
        if isinstance(p, InQuery):
            return f"{left} {negated}IN ({self.query(p.query)})"
        if isinstance(p, In):
            return f"{left} {negated}IN ({', '.join(self.value(v, name, main) for v in p.values)})" if p.values else "TRUE" if p.negated else "FALSE"
        if isinstance(p, IsNull):
            return f"{left} IS {negated}NULL"
        if isinstance(p, Between):
            return f"{left} {negated}BETWEEN {self.value(p.low, name, main)} AND {self.value(p.high, name, main)}"
        if isinstance(p, Compare):
            right = self.value(p.right, name, main)
            if p.op in ("<=>", "not <=>"):
                return f"{'NOT ' if p.op != '<=>' else ''}({left} <=> {right})"
            return f"{left} {p.op.upper()} {right}"
        raise TypeError(f"not a predicate: {p!r}")

    def query(self, q: Any) -> str:
        if hasattr(q, "arms"):
            kind = q.kind.upper()
            # from the left, whatever binds tighter in SQL
            plain = [dataclasses.replace(a, orders=(), most=0, skip=0) for a in q.arms]
            out = self.query(plain[0])
            for a in plain[1:]:
                out = f"({out}) {kind} ({self.query(a)})"
            name = lambda k: f"`{k.label or k.name}`" if isinstance(k, ColumnRef) else str(k)
            orders = [f"{name(o.key)} {self.order(Order(ColumnRef(None, 'x'), o.descending, o.nulls_first), None).split(' ', 1)[1]}" for o in q.orders]
            return out + self._tail(orders, q)
        from .plans.lower import label_of

        main, meta = q.name, q.model.__meta__
        items = list(q.items) or [ColumnRef(main, c) for c in meta.columns]
        listed = ", ".join(f"{self.value(x, main=main)} AS `{label_of(x)}`" for x in items)
        out = f"SELECT {'DISTINCT ' if q.distinct_rows else ''}{listed} FROM `{meta.table}`" + (f" AS `{main}`" if main != meta.table else "")
        for j in q.joins:
            table = j.model.__meta__.table
            kind = "CROSS" if j.on is None else j.kind.replace("_", " ").upper()
            out += f" {kind} JOIN `{table}`" + (f" AS `{j.name}`" if j.name != table else "")
            out += f" ON {self.predicate(j.on, main)}" if j.on is not None else ""
        where = [self.predicate(p, main) for p in q.predicates]
        if meta.soft_delete and not q.with_deleted:
            where.append(f"`{main}`.`{meta.soft_delete}` IS NULL")
        out += f" WHERE {' AND '.join(where)}" if where else ""
        out += f" GROUP BY {', '.join(self.value(g, main=main) for g in q.groups)}" if q.groups else ""
        out += f" HAVING {self.predicate(q.condition, main)}" if q.condition is not None else ""
        if q.ctes:
            from .operators.statements import bound

            parts = ", ".join(f"`{name}`{'(' + ', '.join(columns) + ')' if columns else ''} AS ({bound(sql, args)})" for name, sql, args, _, columns in q.ctes)
            out = f"WITH {'RECURSIVE ' if any(c[3] for c in q.ctes) else ''}{parts} {out}"
        return out + self._tail([self.order(o, main) for o in q.orders], q)

    @staticmethod
    def _tail(orders: list[str], q: Any) -> str:
        out = f" ORDER BY {', '.join(orders)}" if orders else ""
        out += f" LIMIT {q.most}" if q.most > 0 else ""
        return out + (f" OFFSET {q.skip}" if q.skip > 0 else "")


def query_sql(q: Any, redact: Redact | None = None) -> str:
    return Renderer(redact).query(q)


def insert_sql(i: Any) -> str:
    """An INSERT with its rows, or of a DataFrame, whose rows are not evaluated, its columns only."""
    from pyspark.sql import DataFrame

    r, table = Renderer(i.engine.observer.redacted), i.model.__meta__.table
    if isinstance(i.rows, DataFrame):
        columns = [c for c in i.model.__meta__.columns if c in i.rows.columns]
        body = f"SELECT {', '.join(f'`{c}`' for c in columns)} FROM <DataFrame>"
    else:
        patches = i.patches()
        columns = [c for c in i.model.__meta__.columns if any(c in p for p in patches)]
        body = "VALUES " + ", ".join("(" + ", ".join(r.value(p.get(c), c) for c in columns) + ")" for p in patches)
    out = f"INSERT INTO `{table}` ({', '.join(f'`{c}`' for c in columns)}) {body}"
    if i.action:
        sets = "DO NOTHING" if i.action == "nothing" else "DO UPDATE SET " + ", ".join(f"`{c}` = {readable(x.sql)}" for c, x in i.sets.items())
        out += f" ON CONFLICT ({', '.join(f'`{k}`' for k in i.keys)}) {sets}"
    return out


def readable(sql: str) -> str:
    """``src`` and ``tgt``, as upserts call the incoming and the stored row, by their usual names."""
    return re.sub(r"`tgt`\.", "", re.sub(r"`src`\.", "excluded.", sql))


def update_sql(u: Any) -> str:
    r, table = Renderer(u.engine.observer.redacted), u.model.__meta__.table
    sets = ", ".join(f"`{c}` = {r.value(x, c)}" for c, x in u.changes().items())
    return f"UPDATE `{table}` SET {sets} WHERE {r.predicate(u.condition())}"


def delete_sql(d: Any) -> str:
    r, meta = Renderer(d.engine.observer.redacted), d.model.__meta__
    where = [r.predicate(p) for p in d.predicates]
    if meta.soft_delete and not d.hard:
        where.append(f"`{meta.table}`.`{meta.soft_delete}` IS NULL")
        out = f"UPDATE `{meta.table}` SET `{meta.soft_delete}` = current_timestamp()"
    else:
        out = f"DELETE FROM `{meta.table}`"
    return out + (f" WHERE {' AND '.join(where)}" if where else "")
