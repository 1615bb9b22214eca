"""Schema introspection, drift between models and tables, and relations from foreign keys."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import SchemaDrift
from ..functions.refs import ColumnRef
from ..model import Model, Relation, belongs_to, has_many, models, snake


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool
    default: object = None


@dataclass(frozen=True)
class TableInfo:
    name: str
    columns: tuple[Column, ...]
    pk: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    #: (column, other table, its column)
    foreign: tuple[tuple[str, str, str], ...] = ()
    #: Columns of each index: the keys, and the plain ones told to ``create``.
    indexes: tuple[tuple[str, ...], ...] = ()

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass(frozen=True)
class Diff:
    kind: str
    table: str
    column: str = ""
    detail: str = ""

    def __str__(self) -> str:
        return f"{self.kind}: {self.table}" + (f".{self.column}" if self.column else "") + (f" ({self.detail})" if self.detail else "")


Catalog = dict[str, TableInfo]


def load(engine, *tables: str) -> Catalog:
    """What an engine knows of tables; none named: all of its warehouse, and of its source those of registered models."""
    out: Catalog = {}
    if engine.store is not None:
        for name, v in engine.store.head()[1].items():
            fields = tuple(Column(f.name, f.dataType.simpleString(), f.nullable and f.name not in v.pk, v.defaults.get(f.name)) for f in v.struct)
            out[name] = TableInfo(name, fields, v.pk, v.unique, v.foreign, tuple(x for x in (v.pk, *v.unique, *v.indexes) if x))
    if engine.source is not None:
        for name in tables or [m.__meta__.table for m in models()]:
            if name not in out:
                try:
                    schema = engine.spark.read.parquet(f"{engine.source}/{name}.parquet").schema
                except Exception as e:
                    if "PATH_NOT_FOUND" in str(e):
                        continue
                    raise
                out[name] = TableInfo(name, tuple(Column(f.name, f.dataType.simpleString(), f.nullable) for f in schema))
    return {k: v for k, v in out.items() if not tables or k in tables}


def bind(catalog: Catalog, model: type[Model]) -> list[Diff]:
    """How a model differs from its table."""
    meta = model.__meta__
    if (t := catalog.get(meta.table)) is None:
        return [Diff("table_missing", meta.table)]
    have, want = {c.name for c in t.columns}, set(meta.columns)
    out = [Diff("model_extra_column", meta.table, c) for c in meta.columns if c not in have]
    out += [Diff("missing_column", meta.table, c.name) for c in t.columns if c.name not in want]
    if t.pk and list(t.pk) != meta.pk:
        out.append(Diff("pk_mismatch", meta.table, detail=f"{', '.join(meta.pk)} and {', '.join(t.pk)}"))
    for f in meta.fields.values():
        c = t.column(f.name)
        if c is not None and f.name not in meta.pk and f.nullable != c.nullable and not f.nullable:
            out.append(Diff("nullable_mismatch", meta.table, f.name))
    return out


def must_bind(catalog: Catalog, *bound: type[Model]) -> None:
    if diffs := [d for m in bound for d in bind(catalog, m)]:
        raise SchemaDrift("\n".join(map(str, diffs)))


# How relations are named after tables and columns.


def plural(name: str) -> str:
    """``Category`` to ``Categories``, ``Box`` to ``Boxes``, ``Post`` to ``Posts``."""
    if name.endswith("y") and name[-2:-1] not in "aeiou":
        return name[:-1] + "ies"
    return name + ("es" if name.endswith(("s", "x", "ch", "sh")) else "s")


def relation_name(column: str) -> str:
    """``dept_id`` to ``dept``."""
    for end in ("_id", "_guid"):
        if column.endswith(end) and len(column) > len(end):
            return column[: -len(end)]
    return column


def auto_relations(catalog: Catalog) -> list[tuple[type[Model], str]]:
    """Adds belongs_to and has_many relations for foreign keys between registered models; declared ones win.

    Returns what was added. The child's side is named after the column, the parent's after the child model in plural.
    """
    by_table = {m.__meta__.table: m for m in models()}
    added = []
    for t in catalog.values():
        child = by_table.get(t.name)
        for column, other, ref in t.foreign:
            parent = by_table.get(other)
            if child is None or parent is None:
                continue
            for model, name, r in ((child, relation_name(column), belongs_to(parent, column, ref)), (parent, snake(plural(child.__name__)), has_many(child, column, ref))):
                if name not in model.__meta__.relations and name not in model.__meta__.fields:
                    object.__setattr__(r, "attribute", name)
                    model.__meta__.relations[name] = r
                    setattr(model, name, r)
                    added.append((model, name))
    return added


__all__ = ["Catalog", "Column", "ColumnRef", "Diff", "Relation", "TableInfo", "auto_relations", "bind", "load", "must_bind", "plural", "relation_name"]
