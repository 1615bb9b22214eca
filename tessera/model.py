"""Models: a Python class for each table, with typed columns and relations, declared once.

A field read on the class is a column reference for building queries; on an instance it is a value. An instance remembers
which fields were assigned, so "not set" and "set to None" differ: ``patch()`` holds the assigned ones only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import types as T

from .errors import NotLoaded
from .functions.refs import ColumnRef


def snake(name: str) -> str:
    """``IDCard`` to ``id_card``, ``HTTPServer`` to ``http_server``."""
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()


@dataclass(eq=False)
class Field:
    """A column. ``kind`` is a Spark DDL type; ``json`` marks a text column that holds a document of that type:
    instances have it as Python objects, writes put it into text, and ``document`` reads parts of it in queries."""

    kind: str
    pk: bool = False
    name: str | None = None
    nullable: bool = True
    soft_delete: bool = False
    json: str | None = None
    attribute: str = ""
    owner: Any = None

    def __set_name__(self, owner: type, attribute: str) -> None:
        self.attribute, self.owner = attribute, owner
        self.name = self.name or snake(attribute)

    def __get__(self, row: Any, owner: type) -> Any:
        if row is None:
            return ColumnRef(owner.__meta__.table, self.name, json=self.json)
        return row.__dict__.get("_values", {}).get(self.name)

    def __set__(self, row: Any, value: Any) -> None:
        row._values[self.name] = value
        row._assigned.add(self.name)

    @property
    def type(self) -> T.DataType:
        return T.DataType.fromDDL(self.kind)

    def parsed(self, value: Any) -> Any:
        """A stored value as instances have it: the document of a JSON field, which must be one."""
        return json.loads(value) if self.json and isinstance(value, str) else value


def soft_delete() -> Field:
    """The column ``deleted_at``: rows with a time in it are hidden from queries."""
    return Field("timestamp", name="deleted_at", soft_delete=True)


@dataclass(frozen=True)
class Relation:
    """How rows of one model belong to another; names are columns. ``through`` is the link model of many-to-many."""

    kind: str
    target: Any
    local: str | None = None
    remote: str | None = None
    through: Any = None
    through_local: str | None = None
    through_remote: str | None = None
    attribute: str = ""

    def __set_name__(self, owner: type, attribute: str) -> None:
        object.__setattr__(self, "attribute", attribute)

    def __get__(self, row: Any, owner: type) -> Any:
        if row is None:
            return self
        return row._relations.setdefault(self.attribute, (RelMany if self.kind in ("has_many", "many_to_many") else Rel)())

    def model(self) -> type[Model]:
        return lookup(self.target) if isinstance(self.target, str) else self.target


def has_many(target: Any, fk: str, ref: str | None = None) -> Relation:
    """Rows of ``target`` whose column ``fk`` holds this row's ``ref`` (its primary key by default)."""
    return Relation("has_many", target, ref, fk)


def has_one(target: Any, fk: str, ref: str | None = None) -> Relation:
    """As has_many; of several rows the one with the highest primary key."""
    return Relation("has_one", target, ref, fk)


def belongs_to(target: Any, fk: str, ref: str | None = None) -> Relation:
    """The row of ``target`` whose ``ref`` (its primary key by default) this row's column ``fk`` holds."""
    return Relation("belongs_to", target, fk, ref)


def many_to_many(target: Any, through: Any, left: str, right: str, ref: str | None = None, target_ref: str | None = None) -> Relation:
    """Rows of ``target`` linked by rows of ``through``: its column ``left`` holds this row's key, ``right`` the target's."""
    return Relation("many_to_many", target, ref, target_ref, through, left, right)


class Rel:
    """A relation to one row: not loaded, loaded and empty, or loaded."""

    def __init__(self, value: Any = None, loaded: bool = False) -> None:
        self.loaded, self._value = loaded, value

    @property
    def is_none(self) -> bool:
        return self._value is None

    def get(self) -> Any:
        if not self.loaded:
            raise NotLoaded("the relation was not preloaded")
        return self._value

    def to_json(self) -> Any:
        return _plain(self._value) if self.loaded else None


class RelMany:
    """A relation to many rows."""

    def __init__(self, rows: list | None = None, loaded: bool = False) -> None:
        self.loaded, self._rows = loaded, rows or []

    def all(self) -> list:
        if not self.loaded:
            raise NotLoaded("the relation was not preloaded")
        return self._rows

    def __len__(self) -> int:
        return len(self.all())

    def __iter__(self) -> Iterator:
        return iter(self.all())

    def to_json(self) -> Any:
        return [_plain(r) for r in self._rows] if self.loaded else None


def _plain(x: Any) -> Any:
    return x.to_dict() if isinstance(x, Model) else x


@dataclass
class Meta:
    """What is known of a model: table, columns in order, relations."""

    model: type
    table: str
    fields: dict[str, Field]
    relations: dict[str, Relation]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields.values()]

    @property
    def by_column(self) -> dict[str, Field]:
        return {f.name: f for f in self.fields.values()}

    @property
    def pk(self) -> list[str]:
        """The key columns; without a marked one, the first column."""
        marked = [f.name for f in self.fields.values() if f.pk]
        return marked or self.columns[:1]

    @property
    def soft_delete(self) -> str | None:
        return next((f.name for f in self.fields.values() if f.soft_delete), None)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type, f.nullable and f.name not in self.pk) for f in self.fields.values()])


_MODELS: dict[type, Meta] = {}
_TABLES: dict[str, type] = {}
_NAMES: dict[str, type] = {}


def register(model: type, table: str) -> Meta:
    """Ties a model to a table; the same tie again is fine, another one for either side is an error."""
    if (old := _MODELS.get(model)) is not None:
        if old.table != table:
            raise ValueError(f"{model.__name__} is registered for {old.table}")
        return old
    fields, relations = {}, {}
    for c in reversed(model.__mro__):
        fields |= {k: v for k, v in vars(c).items() if isinstance(v, Field)}
        relations |= {k: v for k, v in vars(c).items() if isinstance(v, Relation)}
    meta = _MODELS[model] = Meta(model, table, fields, relations)
    _TABLES[table] = _NAMES[model.__name__] = model
    return meta


def lookup(name: str) -> type[Model]:
    """A model by table name or class name."""
    if (found := _TABLES.get(name) or _NAMES.get(name)) is None:
        raise KeyError(f"no model for {name}")
    return found


def models() -> list[type[Model]]:
    return list(_MODELS)


class Model:
    """Base of all models: ``class Users(Model, table="users"): id = Field("bigint", pk=True)``."""

    __meta__: ClassVar[Meta]

    def __init_subclass__(cls, table: str | None = None, **rest: Any) -> None:
        super().__init_subclass__(**rest)
        cls.__meta__ = register(cls, table or snake(cls.__name__))

    def __init__(self, **values: Any) -> None:
        self.__dict__.update(_values={}, _assigned=set(), _relations={})
        for k, v in values.items():
            if k not in type(self).__meta__.fields:
                raise TypeError(f"{type(self).__name__} has no field {k}")
            setattr(self, k, v)

    def patch(self) -> dict[str, Any]:
        """The assigned columns and their values."""
        return {c: self._values[c] for c in type(self).__meta__.columns if c in self._assigned}

    def is_set(self, attribute: str) -> bool:
        return type(self).__meta__.fields[attribute].name in self._assigned

    def reset(self, attribute: str) -> None:
        """Makes a field unassigned; its value stays readable."""
        self._assigned.discard(type(self).__meta__.fields[attribute].name)

    def to_dict(self) -> dict[str, Any]:
        meta = type(self).__meta__
        out = {k: self._values.get(f.name) for k, f in meta.fields.items()}
        return out | {k: r.to_json() for k, r in self._relations.items()}

    def __eq__(self, other: object) -> bool:
        return type(other) is type(self) and other._values == self._values

    def __hash__(self) -> int:
        return hash(tuple(self._values.get(c) for c in type(self).__meta__.pk))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self._values.items())})"

    @classmethod
    def from_row(cls, row: Any) -> Any:
        """An instance from a Row, by column name; columns that the model does not have are dropped, nothing is assigned."""
        out, have = cls(), set(row.__fields__)
        out._values.update({f.name: f.parsed(row[f.name]) for f in cls.__meta__.fields.values() if f.name in have})
        for k, r in cls.__meta__.relations.items():
            if k in have:
                target = r.model()
                if r.kind in ("has_many", "many_to_many"):
                    out._relations[k] = RelMany([target.from_row(x) for x in row[k] or []], True)
                else:
                    out._relations[k] = Rel(target.from_row(row[k]) if row[k] is not None else None, True)
        return out

    @classmethod
    def alias(cls, name: str) -> Aliased:
        """The table under another name, for joins of a table with itself and correlated subqueries."""
        return Aliased(cls, name)


class Aliased:
    """A model under an alias: its columns are references to that alias."""

    def __init__(self, model: type[Model], name: str) -> None:
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a name: {name!r}")
        self.model, self.name = model, name

    def __getattr__(self, attribute: str) -> ColumnRef:
        if attribute in (fields := self.model.__meta__.fields):
            return ColumnRef(self.name, fields[attribute].name, json=fields[attribute].json)
        raise AttributeError(attribute)
