"""An engine: a Spark session, where its tables are, and its options."""

from __future__ import annotations

import json
import logging
import re
import time
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .. import tx
from ..errors import ReadOnly
from ..hooks import Hooks
from ..model import Aliased, Model, models, register
from ..observe import Observer, QueryInfo
from ..operators.dml import Delete, Insert, Update
from ..operators.query import Query, describe
from .store import Store, Version

#: Names of temporary views that engines have made.
_VIEWS: set[str] = set()


class Engine:
    """``source``: a folder with one ``<table>.parquet`` for each table, to read. ``warehouse``: a folder of versioned
    tables, to read and write; a table there hides one of the same name in ``source``."""

    def __init__(self, spark: SparkSession, source: str | None = None, warehouse: str | None = None, *, mode: tx.Mode = "savepoint", isolation: tx.Isolation = "snapshot", read_only: bool = False, retries: int = 0, logger: logging.Logger | None = None, slow: float | None = None, store: Store | None = None) -> None:
        """``store`` in place of ``warehouse``: that of another engine, whose open transactions this one then takes part in."""
        self.spark, self.source = spark, source
        self.store = store if store is not None else Store(spark, warehouse) if warehouse else None
        self.options = tx.Options(mode, isolation, read_only, retries)
        self.hooks, self.observer = Hooks(), Observer()
        if logger is not None:
            self.observer.logger = logger
        if slow is not None:
            self.observer.slow = slow
        self.defaults: dict[str, dict[str, Any]] = {}

    # reading

    def query(self, model: type[Model] | Aliased) -> Query:
        if isinstance(model, Aliased):
            return Query(self, model.model, model.name)
        return Query(self, model, model.__meta__.table)

    def read(self, model: type[Model]) -> DataFrame:
        """The table of a model: the version that the open transaction sees, else the last one; else the file."""
        table = model.__meta__.table
        if self.store is not None:
            frame = tx.current(self.store)
            v = frame.version(table) if frame else self.store.head()[1].get(table)
            if v is not None:
                return self.store.read(v)
        if self.source is None:
            raise LookupError(f"no table {table}")
        return self.spark.read.parquet(f"{self.source}/{table}.parquet")

    def raw(self, sql: str, args: Any = None, model: type[Model] | None = None) -> Any:
        """A SQL query, with ``?`` or ``:name`` parameters; with a model a list of its instances, else a DataFrame.

        Tables of registered models can be named as they are.
        """

        def work() -> Any:
            self._named(sql)
            df = self.spark.sql(sql, args=args)
            return df if model is None else [model.from_row(r) for r in df.collect()]

        return self.watched("raw", "", sql, self.observer.raw_args(sql, args), work, lambda out: None if model is None else len(out))

    def views(self, *registered: type[Model]) -> None:
        """Makes tables known to SQL under their names."""
        for m in registered:
            self.read(m).createOrReplaceTempView(m.__meta__.table)
            _VIEWS.add(m.__meta__.table)

    def _named(self, sql: str) -> None:
        """Makes the tables of registered models that a statement names known to SQL, as this engine sees them; names that
        the session knows as something else stay as they are."""
        words = set(re.findall(r"\w+", sql))
        for m in models():
            table = m.__meta__.table
            if table in words and (table in _VIEWS or not self.spark.catalog.tableExists(table)):
                try:
                    self.views(m)
                except (LookupError, AnalysisException):
                    continue  # no such table here: the statement says so itself if it needs one

    def with_ctes(self, ctes: tuple) -> dict[type[Model], DataFrame]:
        """The models that scan common table expressions, each with its rows. Each expression has arguments of its own."""
        from ..operators.statements import bound

        recursive = "RECURSIVE " if any(c[3] for c in ctes) else ""
        parts = ", ".join(f"`{name}`{'(' + ', '.join(columns) + ')' if columns else ''} AS ({bound(sql, args)})" for name, sql, args, _, columns in ctes)
        names = {name for name, *_ in ctes}
        self._named(" ".join(x for _, sql, *_ in ctes for x in re.findall(r"\w+", sql) if x not in names))
        return {m: self.spark.sql(f"WITH {recursive}{parts} SELECT * FROM `{m.__meta__.table}`") for m in models() if m.__meta__.table in names}

    # writing

    def create(self, model: type[Model], rows: DataFrame | None = None, unique: list[list[str]] | None = None, foreign: list[tuple[str, str, str]] | None = None, defaults: dict[str, Any] | None = None, indexes: list[list[str]] | None = None) -> None:
        """A versioned table for a model, with the rows given; keys are taken from the model. ``defaults`` are values for
        columns that a single inserted row leaves out; ``indexes`` are kept for introspection only."""
        meta = model.__meta__

        def work() -> None:
            v = Version(json.dumps(meta.schema.jsonValue()), (), tuple(meta.pk), tuple(map(tuple, unique or [])), tuple(map(tuple, foreign or [])))
            v = replace(v, schema=json.dumps(_loose(meta.schema).jsonValue()), defaults=dict(defaults or {}), indexes=tuple(map(tuple, indexes or [])))
            if rows is not None:
                from pyspark.sql import functions as F

                from .store import cast_to

                segment = self.store.write(cast_to(rows.select(*meta.columns), v.struct), meta.table)
                top = None
                if len(meta.pk) == 1 and v.struct[meta.pk[0]].dataType.typeName() in ("long", "integer", "short"):
                    top = self.store.read(v, [segment]).agg(F.max(meta.pk[0])).first()[0]
                v = v.with_segments([segment], top)
            self.stage(model, v)

        self.write(work)

    def version(self, model: type[Model]) -> Version:
        v = tx.current(self.store).version(model.__meta__.table)
        if v is None:
            raise LookupError(f"no table {model.__meta__.table} in the warehouse")
        return v

    def stage(self, model: type[Model], v: Version | None) -> None:
        tx.current(self.store).stage(model.__meta__.table, v)

    def write(self, work: Callable[[], Any]) -> Any:
        """Runs a write in the open transaction, else in one of its own."""
        if self.store is None:
            raise ReadOnly("the engine has no warehouse")
        frame = tx.current(self.store)
        if (frame.options if frame else self.options).read_only:
            raise ReadOnly("the transaction is read-only")
        return work() if tx.current(self.store) else tx.run(self.store, work, self.options)

    def compact(self, model: type[Model], size: int = 128 << 20) -> int:
        """Puts files below ``size`` bytes together into files of about that size; tells how many files there are less."""

        def work() -> int:
            v = self.version(model)
            count = lambda x: sum(len(x.live.get(s) or self.store.files(s)) for s in x.segments)
            new = self.store.compacted(v, model.__meta__.table, size)
            self.stage(model, new)
            return count(v) - count(new)

        return self.write(work)

    def insert(self, row: Any) -> Insert:
        return Insert(self, type(row), row)

    def insert_batch(self, model: type[Model], rows: Any) -> Insert:
        return Insert(self, model, rows)

    upsert = insert

    def update(self, target: Model | type[Model], patch: dict[str, Any] | None = None) -> Update:
        """An instance's assigned columns, or a patch for a model."""
        if isinstance(target, Model):
            return Update(self, type(target), target.patch(), target)
        return Update(self, target, dict(patch or {}))

    def delete(self, model: type[Model]) -> Delete:
        return Delete(self, model)

    def delete_by_id(self, model: type[Model], key: Any) -> int:
        return self.delete_by_ids(model, {model.__meta__.pk[0]: key})

    def delete_by_ids(self, model: type[Model], keys: dict[str, Any]) -> int:
        """By the columns of the primary key that ``keys`` has; one at least."""
        from ..functions.refs import ColumnRef

        meta = model.__meta__
        found = [ColumnRef(meta.table, k).eq(keys[k]) for k in meta.pk if k in keys]
        if not found:
            raise ValueError("no column of the primary key is given")
        return self.delete(model).where(*found).execute()

    def execute(self, sql: str, args: Any = None) -> Any:
        """A raw write: INSERT, UPDATE or DELETE on a versioned table gives the rows affected, with RETURNING a DataFrame of
        them. Other statements are Spark's."""
        from ..operators import statements

        def work() -> Any:
            out = statements.run(self, sql, args)
            if out is None:
                self._named(sql)
                return self.spark.sql(sql, args=args)
            return out

        return self.watched("execute", "", sql, self.observer.raw_args(sql, args), work, lambda out: out if isinstance(out, int) else None)

    # transactions

    def tx(self, work: Callable[[], Any], *, mode: tx.Mode | None = None, isolation: tx.Isolation | None = None, read_only: bool | None = None, retries: int | None = None) -> Any:
        """Calls ``work`` in a transaction with this engine's options, unless others are given."""
        o = self.options
        options = tx.Options(mode or o.mode, isolation or o.isolation, o.read_only if read_only is None else read_only, o.retries if retries is None else retries)
        return tx.run(self.store, work, options, mode)

    def lock(self, model: type[Model], how: str) -> None:
        if self.store is not None and (frame := tx.current(self.store)) is not None:
            frame.lock(model.__meta__.table, how)

    # observing

    def on(self, model: type[Model], event: str, call: Callable[[Any], None]) -> Callable[[], None]:
        return self.hooks.on(model, event, call)

    def observe(self, op: str, q: Query, seconds: float, rows: int | None, error: Exception | None) -> None:
        self.observer.tell(QueryInfo(op, q.model.__meta__.table, describe(q), self.observer.query_args(q), seconds, rows, error, lambda: q.sql(redact=self.observer.redacted)))

    def told(self, op: str, model: type[Model], sql: Callable[[], str], args: list, work: Callable[[], Any], rows: Callable[[Any], int | None]) -> Any:
        """Calls a write and tells of it, and of its error if it fails."""
        return self.watched(op, model.__meta__.table, f"{op} {model.__meta__.table}", args, work, rows, sql)

    def watched(self, op: str, table: str, text: str, args: list, work: Callable[[], Any], rows: Callable[[Any], int | None], sql: Callable[[], str] | None = None) -> Any:
        """Calls ``work`` and tells of it, and of its error if it fails."""
        began = time.perf_counter()
        try:
            out = work()
        except Exception as e:
            self.observer.tell(QueryInfo(op, table, text, args, time.perf_counter() - began, None, e, sql or (lambda: text)))
            raise
        self.observer.tell(QueryInfo(op, table, text, args, time.perf_counter() - began, rows(out), None, sql or (lambda: text)))
        return out


def _loose(schema: Any) -> Any:
    """The schema with nullable columns: files hold what was written, keys are checked on writing."""
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


__all__ = ["Engine", "register"]
