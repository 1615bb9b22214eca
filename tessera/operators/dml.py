"""Writes on versioned tables, as DataFrame algebra over the current version."""

from __future__ import annotations

import datetime
import decimal
import json
import math
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import AffectedMismatch, ConstraintError
from ..functions.refs import And, ColumnRef, Predicate
from ..model import Model
from ..plans.lower import Scope, quoted
from ..sources.store import Store, Version, cast_to

#: Rows given as Python objects whose keys, if they are no more, are sent to all tasks, so that the table that they are
#: looked up in is neither moved nor sorted.
SENT_ROWS = 100_000


# values of computed upserts


@dataclass(frozen=True)
class Value:
    """An expression over the stored row (``tgt``) and the incoming one (``src``)."""

    sql: str

    def __add__(self, other: Any) -> Value:
        return Value(f"({self.sql} + {literal(other).sql})")

    def __sub__(self, other: Any) -> Value:
        return Value(f"({self.sql} - {literal(other).sql})")

    def __mul__(self, other: Any) -> Value:
        return Value(f"({self.sql} * {literal(other).sql})")


def excluded(c: ColumnRef) -> Value:
    """The incoming value of a column."""
    return Value(quoted("src", c.name))


def stored(c: ColumnRef) -> Value:
    """The value that the table holds."""
    return Value(quoted("tgt", c.name))


def literal(v: Any) -> Value:
    """A value as a literal of its own type. Text and bytes go as hexadecimal digits, so no setting about escapes matters."""
    if isinstance(v, Value):
        return v
    if v is None:
        return Value("NULL")
    if isinstance(v, bool):
        return Value(str(v).lower())
    if isinstance(v, int):
        return Value(repr(v) if abs(v) < 1 << 63 else f"CAST('{v}' AS DECIMAL(38, 0))")
    if isinstance(v, float):
        return Value(f"CAST('{v!r}' AS DOUBLE)" if math.isfinite(v) else f"CAST('{'NaN' if math.isnan(v) else 'Infinity' if v > 0 else '-Infinity'}' AS DOUBLE)")
    if isinstance(v, decimal.Decimal):
        _, digits, exponent = v.as_tuple()
        scale = max(0, -exponent)
        return Value(f"CAST('{v:f}' AS DECIMAL({max(len(digits) + max(0, exponent), scale, 1)}, {scale}))")
    if isinstance(v, (bytes, bytearray)):
        return Value(f"X'{bytes(v).hex()}'")
    if isinstance(v, datetime.datetime):
        kind = "TIMESTAMP_NTZ" if v.tzinfo is None else "TIMESTAMP"
        return Value(f"{kind}'{v.isoformat(sep=' ')}'")
    if isinstance(v, datetime.date):
        return Value(f"DATE'{v.isoformat()}'")
    if isinstance(v, (list, tuple)):
        return Value(f"array({', '.join(literal(x).sql for x in v)})")
    return Value(f"CAST(X'{str(v).encode().hex()}' AS STRING)")


def expression(sql: str) -> Value:
    return Value(f"({sql})")


@dataclass(frozen=True, eq=False)
class Insert:
    """Rows to add: instances, patches (dicts by column) or a DataFrame of any size.

    A single row leaves out what was not set, so defaults apply; a batch sends null for it.
    """

    engine: Any
    model: type[Model]
    rows: Any
    keys: tuple[str, ...] = ()
    action: str | None = None
    sets: Any = None

    def on_conflict(self, keys: list[ColumnRef], columns: list[ColumnRef]) -> Insert:
        """Rows whose keys exist overwrite these columns with their values."""
        return replace(self, keys=_names(keys), action="set", sets={c.name: excluded(c) for c in columns})

    def on_conflict_do_nothing(self, keys: list[ColumnRef]) -> Insert:
        return replace(self, keys=_names(keys), action="nothing")

    def on_conflict_set(self, keys: list[ColumnRef], sets: dict[ColumnRef, Any]) -> Insert:
        """Rows whose keys exist set these columns to expressions over the stored and the incoming row."""
        return replace(self, keys=_names(keys), action="set", sets={c.name: literal(v) for c, v in sets.items()})

    def frame(self, v: Version) -> DataFrame:
        """The incoming rows under the table's schema, in their order (column order_)."""
        spark, schema = self.engine.spark, v.struct
        if isinstance(self.rows, DataFrame):
            have = set(self.rows.columns)
            df = self.rows.select(*(F.col(quoted(f.name)) if f.name in have else F.lit(None).alias(f.name) for f in schema))
            return cast_to(df, schema).withColumn("order_", F.monotonically_increasing_id())
        patches = self.patches()
        defaults = {**v.defaults, **self.engine.defaults.get(self.model.__meta__.table, {})} if len(patches) == 1 else {}
        loose = T.StructType([T.StructField(f.name, f.dataType) for f in schema] + [T.StructField("order_", T.LongType())])
        return spark.createDataFrame([(*({**defaults, **p}.get(f.name) for f in schema), i) for i, p in enumerate(patches)], loose).coalesce(1)

    def patches(self) -> list[dict[str, Any]]:
        """Column values of rows that are not a DataFrame; documents of JSON fields as text."""
        rows = list(self.rows) if isinstance(self.rows, (list, tuple)) else [self.rows]
        return [stored_form(self.model, r.patch() if isinstance(r, Model) else dict(r)) for r in rows]

    def _few(self) -> bool:
        """Whether the keys of the incoming rows are sent to all tasks. Spark knows the size of a DataFrame's rows, which are
        written, and decides by itself."""
        return not isinstance(self.rows, DataFrame) and (not isinstance(self.rows, (list, tuple)) or len(self.rows) <= SENT_ROWS)

    def sql(self) -> str:
        """The statement as text that can be pasted, for logs and previews; nothing is written."""
        from ..render import insert_sql

        return insert_sql(self)

    def execute(self) -> DataFrame:
        """Writes, and returns the rows written (of an upsert: as they are now stored)."""
        args = [] if isinstance(self.rows, DataFrame) else [a for r in self.patches() for a in self.engine.observer.values(r)]
        return self.engine.told("insert", self.model, self.sql, args, lambda: self.engine.write(self._execute), lambda out: None)

    def _execute(self) -> DataFrame:
        engine, meta = self.engine, self.model.__meta__
        targets = self.rows if isinstance(self.rows, (list, tuple)) else [self.rows]
        targets = [r for r in targets if isinstance(r, Model)]
        for r in targets:
            engine.hooks.fire(self.model, "before_create", r)
        v = engine.version(self.model)
        src, path = self.frame(v), None
        if isinstance(self.rows, DataFrame):
            # written once, so that keys, checks and the result see the same rows, however the source is evaluated
            path = engine.store.scratch(src)
            src = engine.spark.read.schema(src.schema).parquet(f"{engine.store.root}/{path}")
        try:
            src, top = _with_keys(src, v, meta.pk)
            if self.action is None:
                _check_new(engine, v, src, few=self._few())
                segment = engine.store.write(cast_to(src, v.struct), meta.table)
                engine.stage(self.model, v.with_segments([*v.segments, segment], top))
                out = engine.store.read(v, [segment])
            else:
                out = self._upsert(v, src, top)
        finally:
            if path:
                engine.store.delete(path)
        for r, row in zip(targets, _in_order(src, meta.pk) if targets and not isinstance(self.rows, DataFrame) else []):
            r._values.update({k: row[k] for k in meta.pk})
        for r in targets:
            engine.hooks.fire(self.model, "after_create", r)
        return out

    def _upsert(self, v: Version, src: DataFrame, top: int | None) -> DataFrame:
        engine, table, names = self.engine, self.model.__meta__.table, [f.name for f in v.struct]
        keys = list(self.keys)
        if src.groupBy(*keys).count().where(F.col("count") > 1).where(_all_set(keys)).limit(1).count():
            raise ConstraintError(f"two incoming rows have the same {', '.join(keys)}")
        src = src.drop("order_")
        same = lambda a, b: [F.col(f"{a}.`{k}`") == F.col(f"{b}.`{k}`") for k in keys]
        both = lambda: _all(same("tgt", "src"))
        mine = src.select(*keys)
        mine = (F.broadcast(mine) if self._few() else mine).alias("src")
        others = [u for u in (v.pk, *v.unique) if u and set(u) != set(keys)]
        if self.action == "nothing":
            # the keys that exist are found first, among the incoming ones: what is built and sent never is the table
            old = engine.store.read(v).select(*keys).alias("tgt").join(mine, both(), "left_semi")
            new = src.alias("src").join(old.alias("tgt"), both(), "left_anti")
            _check_new(engine, v, new, others, few=self._few())
            segment = engine.store.write(cast_to(new, v.struct), table)
            engine.stage(self.model, v.with_segments([*v.segments, segment], top))
            return engine.store.read(v, [segment])
        # only files with a matching row are rewritten; the rest stays as it is
        hit = [tuple(r[0]) for r in engine.store.with_file(v).alias("tgt").join(mine, both(), "left_semi").select("file_").distinct().collect()] if v.segments else []
        old = engine.store.read_files(v, hit).withColumn("old_", F.lit(True)).alias("tgt")
        merged = old.join(src.withColumn("new_", F.lit(True)).alias("src"), both(), "full")

        def pick(c: str) -> Column:
            value = F.expr(self.sets[c].sql) if c in self.sets else F.col(f"tgt.`{c}`")
            # by the presence of rows, not of values: an incoming null overwrites, a stored null stays
            return F.when(F.col("old_").isNull(), F.col(f"src.`{c}`")).when(F.col("new_").isNull(), F.col(f"tgt.`{c}`")).otherwise(value).alias(c)

        # what was written and what was only carried along go to segments of their own, so the result needs no second join
        rows = merged.select(*map(pick, names), F.col("new_").isNotNull().alias("written_"))
        segment, carried = _parts(engine.store, rows, v, table)
        after = engine.store.replaced(v, hit, [*segment, *carried], top)
        changed = [u for u in (v.pk, *v.unique) if u and (u in others or set(u) & set(self.sets))]
        if changed:
            _check_added(engine.store, after, segment, changed)
        engine.stage(self.model, after)
        return engine.store.read(v, segment)


@dataclass(frozen=True, eq=False)
class Update:
    """Changes to rows: a patch of columns, which may be values or SQL expressions (``expression``)."""

    engine: Any
    model: type[Model]
    patch: dict[str, Any]
    target: Model | None = None
    predicates: tuple[Predicate, ...] = ()
    expected: int | None = None

    def where(self, *p: Predicate) -> Update:
        return replace(self, predicates=(*self.predicates, *p))

    def all_fields(self) -> Update:
        """Every column of the instance, set or not."""
        values = self.target._values
        return replace(self, patch={c: values.get(c) for c in self.model.__meta__.columns})

    def expect(self, n: int) -> Update:
        """Fails with AffectedMismatch, and writes nothing, unless exactly n rows match."""
        return replace(self, expected=n)

    def condition(self) -> Predicate:
        if self.predicates:
            return And(self.predicates)
        meta = self.model.__meta__
        keys = {k: (self.target._values if self.target is not None else self.patch).get(k) for k in meta.pk}
        if any(x is None for x in keys.values()):
            raise ValueError("an update needs a condition or the values of the primary key")
        return And(tuple(ColumnRef(meta.table, k).eq(x) for k, x in keys.items()))

    def changes(self) -> dict[str, Any]:
        """What is set, by column; documents of JSON fields as text."""
        meta = self.model.__meta__
        patch = self.patch if self.target is None or set(self.patch) == set(meta.columns) else self.target.patch()
        return stored_form(self.model, {k: x for k, x in patch.items() if k not in meta.pk or self.predicates and self.target is None})

    def sql(self) -> str:
        """The statement as text that can be pasted, for logs and previews; nothing is written."""
        from ..render import update_sql

        return update_sql(self)

    def execute(self) -> int:
        """Writes, and returns how many rows matched."""
        return self.run()[0]

    def run(self) -> tuple[int, DataFrame]:
        """Writes, and returns how many rows matched, and those rows as they are stored now."""
        args = self.engine.observer.values(self.changes()) + self.engine.observer.args(And(self.predicates) if self.predicates else None)
        return self.engine.told("update", self.model, self.sql, args, lambda: self.engine.write(self._execute), lambda out: out[0])

    def _execute(self) -> tuple[int, DataFrame]:
        engine = self.engine
        engine.hooks.fire(self.model, "before_update", self.target)
        patch = self.changes()
        if not patch:
            raise ValueError("an update needs at least one column")
        out = rewrite(engine, self.model, self.condition(), patch, self.expected)
        engine.hooks.fire(self.model, "after_update", self.target)
        return out


@dataclass(frozen=True, eq=False)
class Delete:
    """Rows to remove; of a model with soft deletion, to mark as deleted now."""

    engine: Any
    model: type[Model]
    predicates: tuple[Predicate, ...] = ()
    everything: bool = False
    expected: int | None = None
    hard: bool = False

    def where(self, *p: Predicate) -> Delete:
        return replace(self, predicates=(*self.predicates, *p))

    def delete_all(self) -> Delete:
        """Says that no condition is meant."""
        return replace(self, everything=True)

    def expect(self, n: int) -> Delete:
        return replace(self, expected=n)

    def sql(self) -> str:
        """The statement as text that can be pasted, for logs and previews; nothing is written."""
        from ..render import delete_sql

        return delete_sql(self)

    def execute(self) -> int:
        return self.run()[0]

    def run(self) -> tuple[int, DataFrame]:
        """Writes, and returns how many rows matched, and those rows as they were (soft deletion: as they are now)."""
        if not self.predicates and not self.everything:
            raise ValueError("a delete without a condition needs delete_all()")
        args = self.engine.observer.args(And(self.predicates) if self.predicates else None)
        return self.engine.told("delete", self.model, self.sql, args, lambda: self.engine.write(self._execute), lambda out: out[0])

    def _execute(self) -> tuple[int, DataFrame]:
        engine, meta = self.engine, self.model.__meta__
        engine.hooks.fire(self.model, "before_delete", None)
        p = And(self.predicates) if self.predicates else None
        if meta.soft_delete and not self.hard:
            alive = ColumnRef(meta.table, meta.soft_delete).is_null()
            p = alive if p is None else And((p, alive))
            out = rewrite(engine, self.model, p, {meta.soft_delete: expression("current_timestamp()")}, self.expected)
        else:
            out = rewrite(engine, self.model, p, None, self.expected)
        engine.hooks.fire(self.model, "after_delete", None)
        return out


def rewrite(engine: Any, model: type[Model], p: Predicate | None, patch: dict[str, Any] | None, expected: int | None) -> tuple[int, DataFrame]:
    """Changes (or with no patch removes) the matching rows, file by file; a null condition matches nothing.

    Returns how many rows matched, and those rows: as stored now, or as they were before they were removed.
    """
    meta, store = model.__meta__, engine.store
    v = engine.version(model)
    scope = Scope([meta.table], meta.table)
    found = F.lit(True) if p is None else scope.predicate(p)
    matched = F.coalesce(found, F.lit(False))
    counts = store.touched(v, found, meta.table)
    n = sum(counts.values())
    if expected is not None and n != expected:
        raise AffectedMismatch(f"{meta.table}: {n} rows match, {expected} expected")
    if not n:
        return 0, engine.spark.createDataFrame([], v.struct)
    df = store.read_files(v, counts).alias(meta.table)
    if patch is None:
        # what goes is written, too, so that the result does not hang on files that a clean-up may take
        rows = df.select("*", matched.alias("written_"))
    else:
        value = lambda x: F.expr(x.sql) if isinstance(x, Value) else F.lit(x)
        df = df.select("*", matched.alias("written_"))
        new = {c: F.when(F.col("written_"), value(x)).otherwise(F.col(quoted(c))) for c, x in patch.items()}
        rows = df.select(*(new.get(f.name, F.col(quoted(f.name))).alias(f.name) for f in v.struct), "written_")
    segment, carried = _parts(store, rows, v, meta.table)
    after = store.replaced(v, counts, carried if patch is None else [*segment, *carried])
    if patch is not None and (changed := [u for u in (v.pk, *v.unique) if set(u) & set(patch)]):
        _check_added(store, after, segment, changed)
    engine.stage(model, after)
    return n, store.read(v, segment)


def _parts(store: Store, rows: DataFrame, v: Version, table: str) -> tuple[list[str], list[str]]:
    """New segments of rows whose written_ is true, and of the others."""
    return store.write_parts(rows.select(*(F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in v.struct), "written_"), table, "written_")


def stored_form(model: type[Model], patch: dict[str, Any]) -> dict[str, Any]:
    """Values as tables hold them: documents of JSON fields become text."""
    fields = model.__meta__.by_column
    return {k: json.dumps(x, ensure_ascii=False) if k in fields and fields[k].json and x is not None and not isinstance(x, (str, Value)) else x for k, x in patch.items()}


def _names(keys: Any) -> tuple[str, ...]:
    return tuple(k.name if isinstance(k, ColumnRef) else k for k in keys)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _all_set(keys: list[str]) -> Column:
    return _all([F.col(quoted(k)).isNotNull() for k in keys])


def _in_order(src: DataFrame, pk: list[str]) -> list:
    return src.orderBy("order_").select(*pk).collect()


def _with_keys(src: DataFrame, v: Version, pk: list[str]) -> tuple[DataFrame, int | None]:
    """Rows without a single integer key get the next ones in their order; and the largest key known now."""
    if len(pk) != 1 or not isinstance(v.struct[pk[0]].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        return src, None
    k = pk[0]
    known, missing = src.agg(F.max(k), F.count(F.when(F.col(quoted(k)).isNull(), 1))).first()
    top = max(v.max_key or 0, known or 0)
    if missing:
        # numbered within partitions from counted offsets, so that no task sees all rows
        # order_ holds the partition in its upper bits
        todo = src.where(F.col(quoted(k)).isNull()).withColumn("part_", F.shiftright("order_", 33))
        n, at = {}, top
        for r in sorted(todo.groupBy("part_").count().collect()):
            n[r["part_"]], at = at, at + r["count"]
        first = F.create_map(*(F.lit(x) for p in n.items() for x in p))[F.col("part_")]
        number = first + F.row_number().over(Window.partitionBy("part_").orderBy("order_"))
        kind = v.struct[k].dataType
        todo = todo.withColumn(k, number.cast(kind)).drop("part_")
        src, top = src.where(F.col(quoted(k)).isNotNull()).unionByName(todo), at
    return src, top


def _check_new(engine: Any, v: Version, src: DataFrame, keys: list[tuple[str, ...]] | None = None, few: bool = False) -> None:
    """No incoming row may repeat a key of the table or of another incoming row.

    The table is the side that streams: Spark builds the right side of a semi-join, which the incoming keys are.
    """
    for u in (v.pk, *v.unique) if keys is None else keys:
        if u:
            mine = src.where(_all_set(list(u))).select(*u)
            if mine.groupBy(*u).count().where("count > 1").limit(1).count():
                raise ConstraintError(f"two incoming rows have the same {', '.join(u)}")
            if v.segments and engine.store.read(v).select(*u).join(F.broadcast(mine) if few else mine, list(u), "left_semi").limit(1).count():
                raise ConstraintError(f"there is a row with the same {', '.join(u)}")


def _check_added(store: Store, after: Version, segment: list[str], keys: list[tuple[str, ...]]) -> None:
    """No row of a new segment may share a key with another row of the version."""
    for u in keys:
        mine = store.read(after, segment).where(_all_set(list(u))).select(*u)
        if store.read(after).select(*u).join(mine, list(u), "left_semi").groupBy(*u).count().where("count > 1").limit(1).count():
            raise ConstraintError(f"two rows would have the same {', '.join(u)}")
