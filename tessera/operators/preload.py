"""Relations as nested columns: one join per relation and level, whatever the number of parents.

Preloads come after limit and offset, so only rows of the result are joined. Where the result is not the whole table, children
are cut to those of the result by a left semi join before they are aggregated, which keeps a parent outside the result,
however many children it has, out of the shuffle; of a whole table each table is scanned once.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Model, lookup


def tree(paths: tuple[str, ...]) -> dict[str, dict]:
    """``("a.b", "a.c")`` to ``{"a": {"b": {}, "c": {}}}``."""
    out: dict[str, dict] = {}
    for p in paths:
        at = out
        for part in p.split("."):
            at = at.setdefault(part, {})
    return out


def apply(q: Any, df: DataFrame) -> DataFrame:
    cut = bool(q.predicates or q.joins or q.most > 0 or q.skip > 0 or q.distinct_rows)
    return nest(q, q.model, df, tree(q.paths), cut)


def nest(q: Any, model: type[Model], df: DataFrame, wanted: dict[str, dict], cut: bool) -> DataFrame:
    """``df`` of a model's rows with a nested column for each wanted relation. cut: ``df`` is not the whole table, so that
    it pays to leave out other rows' children before they are aggregated."""
    parents = df
    for name, below in wanted.items():
        if (r := model.__meta__.relations.get(name)) is None:
            raise ValueError(f"{model.__name__} has no relation {name!r}")
        df = one(q, model, df, parents if cut else None, name, r, below)
    return df


def rows_of(q: Any, model: type[Model]) -> DataFrame:
    meta = model.__meta__
    df = q.scan(model).select(*meta.columns)
    return df.where(F.col(meta.soft_delete).isNull()) if q.scoped_relations and meta.soft_delete else df


def one(q: Any, model: type[Model], df: DataFrame, parents: DataFrame | None, name: str, r: Any, below: dict[str, dict]) -> DataFrame:
    target = r.model()
    own, far = model.__meta__, target.__meta__
    local = r.local or (own.pk[0] if r.kind != "belongs_to" else None)
    remote = r.remote or far.pk[0]
    child = rows_of(q, target)
    keys = parents.select(F.col(local).alias("k_")).where("k_ is not null").distinct() if parents is not None else None
    if r.kind == "many_to_many":
        link = q.scan(lookup(r.through) if isinstance(r.through, str) else r.through).select(F.col(r.through_local).alias("k_"), F.col(r.through_remote).alias("c_"))
        if keys is not None:
            link = link.join(keys, "k_", "left_semi")
            child = child.join(link.select("c_").distinct(), F.col(remote) == F.col("c_"), "left_semi")
        child = nest(q, target, child, below, keys is not None)
        child = link.join(child, F.col("c_") == F.col(remote)).drop("c_")
    else:
        if keys is not None:
            child = child.join(keys, F.col(remote) == F.col("k_"), "left_semi")
        child = nest(q, target, child, below, keys is not None).withColumn("k_", F.col(remote))
    # the key leads, so that sorting structs sorts by it
    lead = [*far.pk, *(c for c in far.columns if c not in far.pk), *below]
    row = F.struct(*lead)
    if r.kind in ("has_many", "many_to_many"):
        order = F.struct(*far.pk)
        pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("r"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
        value = F.transform(pairs, lambda x: x["r"])
        nested = child.groupBy("k_").agg(value.alias(name))
    elif r.kind == "has_one":
        nested = child.groupBy("k_").agg(F.max_by(row, F.struct(*far.pk)).alias(name))
    else:
        nested = child.groupBy("k_").agg(F.first(row).alias(name)) if remote not in far.pk else child.select("k_", row.alias(name))
    out = df.join(nested, F.col(local) == F.col("k_"), "left").drop("k_")
    if r.kind in ("has_many", "many_to_many"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out
