"""Writes, transactions, hooks, drift and logs on versioned tables."""

import logging

import pytest

from tessera import tx
from tessera.errors import AffectedMismatch, CommitConflict, ConstraintError, ReadOnly, SchemaDrift
from tessera.model import Field, Model, register, soft_delete
from tessera.operators.dml import excluded, expression, stored
from tessera.sources import schema
from tessera.sources.engine import Engine


class WUsers(Model, table="w_users"):
    id = Field("bigint", pk=True)
    name = Field("string")
    age = Field("int")
    password = Field("string")


class WItems(Model, table="w_items"):
    id = Field("bigint", pk=True)
    name = Field("string")
    deleted_at = soft_delete()


class WRoles(Model, table="w_roles"):
    user_id = Field("bigint", pk=True)
    role_id = Field("bigint", pk=True)
    name = Field("string")


class WCategory(Model, table="w_category"):
    id = Field("bigint", pk=True)
    w_user_id = Field("bigint")


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, warehouse=str(tmp_path / "w"))
    e.create(WUsers)
    e.insert_batch(WUsers, [WUsers(id=1, name="alice", age=30), WUsers(id=2, name="bob", age=17), WUsers(id=3, name="carol", age=None)]).execute()
    return e


def names(e, q=None):
    return {r.id: r.name for r in (q or e.query(WUsers)).all()}


def test_insert(engine):
    u = WUsers(name="dave")
    engine.insert(u).execute()
    assert u.id == 4 and names(engine)[4] == "dave"
    with pytest.raises(ConstraintError):
        engine.insert(WUsers(id=1, name="again")).execute()
    with pytest.raises(ConstraintError):
        engine.insert_batch(WUsers, [{"id": 8}, {"id": 8}]).execute()
    engine.defaults["w_users"] = {"age": 5}
    engine.insert(WUsers(id=9)).execute()
    assert engine.query(WUsers).where(WUsers.id == 9).one().age == 5


def test_upsert(engine):
    u = WUsers
    engine.insert_batch(u, [{"id": 1, "age": 10}, {"id": 3, "age": 1}, {"id": 7, "age": 2}]).on_conflict_set([u.id], {u.age: stored(u.age) + excluded(u.age)}).execute()
    assert {r.id: r.age for r in engine.query(u).all()} == {1: 40, 2: 17, 3: None, 7: 2}
    assert names(engine)[1] == "alice"
    engine.insert_batch(u, [{"id": 1, "name": None}]).on_conflict([u.id], [u.name]).execute()
    assert names(engine)[1] is None
    engine.insert_batch(u, [{"id": 1, "name": "x"}, {"id": 8, "name": "y"}]).on_conflict_do_nothing([u.id]).execute()
    assert names(engine)[1] is None and names(engine)[8] == "y"
    with pytest.raises(ConstraintError):
        engine.insert_batch(u, [{"id": 1}, {"id": 1}]).on_conflict([u.id], [u.name]).execute()


def test_update(engine):
    u = WUsers
    assert engine.update(WUsers(id=2, age=0)).execute() == 1
    r = engine.query(u).where(u.id == 2).one()
    assert (r.age, r.name) == (0, "bob")
    assert engine.update(u, {"age": expression("age + 1")}).where(u.age >= 0).execute() == 2
    with pytest.raises(AffectedMismatch):
        engine.update(u, {"name": "x"}).where(u.id == 99).expect(1).execute()
    assert engine.update(u, {"name": "x"}).where(u.id == 99).execute() == 0
    with pytest.raises(ValueError):
        engine.update(WUsers(id=2)).execute()
    with pytest.raises(ValueError):
        engine.update(u, {"name": "x"}).execute()
    row = engine.query(u).where(u.id == 1).one()
    row.age = None
    assert row.patch() == {"age": None}


def test_delete(engine):
    u = WUsers
    assert engine.delete(u).where(u.age < 100).execute() == 2
    assert names(engine) == {3: "carol"}
    with pytest.raises(ValueError):
        engine.delete(u).execute()
    assert engine.delete_by_id(u, 3) == 1 and engine.query(u).count() == 0
    with pytest.raises(ValueError):
        engine.delete_by_ids(u, {"nope": 1})


def test_only_touched_segments_are_rewritten(engine):
    before = engine.store.head()[1]["w_users"].segments
    engine.insert(WUsers(id=50, name="x")).execute()
    engine.update(WUsers(id=50, name="y")).execute()
    after = engine.store.head()[1]["w_users"].segments
    assert before[0] in after and len(after) == 2
    assert engine.store.vacuum() == 1 and names(engine)[50] == "y"


def test_composite_keys(engine):
    engine.create(WRoles)
    engine.insert_batch(WRoles, [WRoles(user_id=1, role_id=10, name="a"), WRoles(user_id=1, role_id=20, name="b"), WRoles(user_id=2, role_id=10, name="c")]).execute()
    assert engine.update(WRoles(user_id=1, role_id=20, name="z")).execute() == 1
    assert engine.delete_by_ids(WRoles, {"user_id": 1, "role_id": 10}) == 1
    assert sorted(r.name for r in engine.query(WRoles).all()) == ["c", "z"]


def test_soft_delete(engine):
    i = WItems
    engine.create(i)
    engine.insert_batch(i, [WItems(id=1, name="a"), WItems(id=2, name="b")]).execute()
    assert engine.delete(i).where(i.id == 1).execute() == 1
    assert engine.delete(i).where(i.id == 1).execute() == 0
    assert engine.query(i).count() == 1 and engine.query(i).unscoped().count() == 2


def test_transactions(engine):
    u = WUsers

    def broken():
        engine.delete(u).delete_all().execute()
        assert engine.query(u).count() == 0
        raise RuntimeError

    with pytest.raises(RuntimeError):
        engine.tx(broken)
    assert engine.query(u).count() == 3

    def nested(mode):
        def inner():
            engine.insert(WUsers(id=101, name="bob2")).execute()
            raise RuntimeError

        def work():
            engine.insert(WUsers(id=100, name="alice2")).execute()
            with pytest.raises(RuntimeError):
                engine.tx(inner, mode=mode)
            engine.insert(WUsers(id=102, name="carol2")).execute()

        engine.tx(work)
        found = {100, 101, 102} & set(names(engine))
        engine.delete(u).where(u.id >= 100).execute()
        return found

    assert nested("savepoint") == {100, 102} and nested("reuse") == {100, 101, 102}
    with pytest.raises(ReadOnly):
        engine.tx(lambda: engine.insert(WUsers(id=5)).execute(), read_only=True)


def test_conflicts_and_retries(engine):
    u, other, calls, sleeps = WUsers, Engine(engine.spark, warehouse=engine.store.root), [], []

    def work():
        calls.append(1)
        engine.query(u).count()
        if len(calls) == 1:
            other.insert(WUsers(id=60, name="o")).execute()
        engine.insert(WUsers(id=61, name="m")).execute()

    with pytest.raises(CommitConflict):
        engine.tx(work)
    other.delete(u).where(u.id >= 60).execute()
    calls.clear()
    tx.run(engine.store, work, tx.Options(retries=2), sleep=sleeps.append)
    assert len(calls) == 2 and len(sleeps) == 1 and 0.0025 <= sleeps[0] <= 0.005
    assert {60, 61} <= set(names(engine))

    def locked():
        engine.query(u).for_update().df()
        other.insert(WUsers(id=70)).execute()

    with pytest.raises(CommitConflict):
        engine.tx(locked)
    with pytest.raises(CommitConflict):
        engine.tx(lambda: (other.insert(WUsers(id=71)).execute(), engine.query(u).for_update(nowait=True).df()))


def test_hooks(engine):
    seen = []
    off = [engine.on(WUsers, e, lambda t, e=e: seen.append(e)) for e in ("before_create", "after_create", "before_update", "after_update", "before_delete", "after_delete")]
    engine.insert(WUsers(id=20, name="h")).execute()
    engine.update(WUsers(id=20, name="i")).execute()
    engine.delete_by_id(WUsers, 20)
    assert seen == ["before_create", "after_create", "before_update", "after_update", "before_delete", "after_delete"]
    for f in off:
        f()

    def refuse(_):
        raise PermissionError

    engine.on(WUsers, "before_create", refuse)
    with pytest.raises(PermissionError):
        engine.insert(WUsers(id=21)).execute()
    assert 21 not in names(engine)


def test_drift_and_relations(engine):
    catalog = schema.load(engine)
    assert schema.bind(catalog, WUsers) == [] and schema.bind(catalog, WItems)[0].kind == "table_missing"
    table = catalog["w_users"]
    catalog["w_users"] = schema.TableInfo(table.name, (*table.columns[:-1], schema.Column("email", "string", True)), ("name",))
    assert [d.kind for d in schema.bind(catalog, WUsers)] == ["model_extra_column", "missing_column", "pk_mismatch"]
    with pytest.raises(SchemaDrift):
        schema.must_bind(catalog, WUsers)
    engine.create(WCategory, foreign=[("w_user_id", "w_users", "id")])
    added = schema.auto_relations(schema.load(engine))
    assert (WCategory, "w_user") in added and (WUsers, "w_categories") in added
    engine.insert(WCategory(id=1, w_user_id=2)).execute()
    assert engine.query(WCategory).preload("w_user").one().w_user.get().name == "bob"
    assert [schema.plural(x) for x in ("Post", "Box", "Category", "Day", "Church")] == ["Posts", "Boxes", "Categories", "Days", "Churches"]
    with pytest.raises(ValueError):
        register(WUsers, "elsewhere")


def test_logs(engine, caplog):
    caplog.set_level(logging.DEBUG, "tessera")
    seen = []
    engine.observer.hooks += [seen.append, lambda i: 1 / 0]
    engine.query(WUsers).where(WUsers.password == "hunter2", WUsers.age > 3).all()
    assert seen[-1].args == [("password", "***"), ("age", 3)] and "hunter2" not in caplog.text
    engine.observer.add_sensitive("age")
    engine.insert(WUsers(id=77, age=44)).execute()
    assert ("age", "***") in seen[-1].args
    engine.observer.slow = 0.0
    engine.query(WUsers).count()
    assert caplog.records[-1].levelno == logging.WARNING
    engine.observer.slow, engine.observer.redact = 9.0, False
    with pytest.raises(Exception):
        engine.query(WUsers).where(WUsers.name.compare(">", object())).all()
    engine.query(WUsers).where(WUsers.password == "open").all()
    assert seen[-1].args == [("password", "open")]


def test_raw_statements(engine):
    run = engine.execute
    assert run("INSERT INTO w_users (id, name) VALUES (?, ?), (11, 'it''s (a), b')", [10, "x"]) == 2
    assert names(engine)[10] == "x"
    got = run("INSERT INTO w_users (name, age) SELECT 'gen', 5 RETURNING id, name").collect()
    assert [(r.id, r.name) for r in got] == [(12, "gen")]
    assert run("UPDATE w_users SET name = concat(name, '-', :tag), age = coalesce(age, 0) + 1 WHERE id IN (1, 2)", {"tag": "where, set"}) == 2
    assert names(engine)[1] == "alice-where, set"
    got = run("update w_users set age = 7 where id = 3 returning id, age + 1 AS next").collect()
    assert [(r.id, r.next) for r in got] == [(3, 8)]
    assert [r.id for r in run("DELETE FROM w_users WHERE age = 7 RETURNING id").collect()] == [3]
    assert run("DELETE FROM w_users WHERE name LIKE '%;%' OR id > :low", {"low": 9}) == 3
    assert run("DELETE FROM w_users") == 2 and engine.query(WUsers).count() == 0
    assert run("SELECT 1 AS one").first().one == 1
