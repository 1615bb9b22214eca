"""File-level writes, keys, bound values, logs, rendered text and JSON fields."""

import datetime
import decimal
import io
import logging
import math
import random

import pytest

from tessera.errors import ConstraintError, ReadOnly
from tessera.functions import count, raw, sum_
from tessera.functions.refs import SqlText
from tessera.model import Field, Model, has_many
from tessera.observe import SENSITIVE, DebugSql
from tessera.operators.dml import expression
from tessera.sources import schema
from tessera.sources.engine import Engine


class SRows(Model, table="s_rows"):
    id = Field("bigint", pk=True)
    name = Field("string")
    n = Field("int")
    password = Field("string")
    children = has_many("s_children", fk="row_id")
    others = has_many("s_children", fk="other_id")


class SChildren(Model, table="s_children"):
    id = Field("bigint", pk=True)
    row_id = Field("bigint")
    other_id = Field("bigint")


class STypes(Model, table="s_types"):
    id = Field("bigint", pk=True)
    b = Field("binary")
    f = Field("double")
    d = Field("date")
    t = Field("timestamp_ntz")
    m = Field("decimal(20,4)")
    s = Field("string")


class SJson(Model, table="s_json"):
    id = Field("bigint", pk=True)
    meta = Field("string", json="role string, level int, tags array<string>")


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, warehouse=str(tmp_path / "w"))


def test_one_changed_row_rewrites_one_file(engine):
    store = engine.store
    engine.create(SRows, engine.spark.range(1000).selectExpr("id", "cast(id as string) name", "cast(id as int) n", "cast(null as string) password").repartitionByRange(100, "id"))
    segment = store.head()[1]["s_rows"].segments[0]
    files = store.files(segment)
    assert len(files) == 100
    engine.update(SRows, {"name": "x"}).where(SRows.id == 555).expect(1).execute()
    v = store.head()[1]["s_rows"]
    assert len(v.live[segment]) == 99 and len(v.segments) <= 3
    engine.delete_by_id(SRows, 7)
    engine.insert_batch(SRows, [{"id": 8, "name": "y"}, {"id": 2000, "name": "z"}]).on_conflict([SRows.id], [SRows.name]).execute()
    assert len(store.head()[1]["s_rows"].live[segment]) in (97, 98)
    rows = {r.id: r.name for r in engine.query(SRows).all()}
    assert len(rows) == 1000 and (rows[555], rows[8], rows[2000], 7 in rows) == ("x", "y", "z", False)
    store.vacuum()
    assert len(store.files(segment)) == len(store.head()[1]["s_rows"].live[segment])
    assert engine.compact(SRows) > 90 and engine.compact(SRows) == 0
    assert {r.id: r.name for r in engine.query(SRows).all()} == rows


def test_random_writes_against_a_dict(engine):
    rnd, want = random.Random(3), {}
    engine.create(SRows)
    for _ in range(14):
        what = rnd.choice(["insert", "update", "delete", "upsert", "compact"])
        ids = rnd.sample(range(30), 4)
        if what == "insert":
            new = [i for i in ids if i not in want]
            if new:
                engine.insert_batch(SRows, [{"id": i, "n": i} for i in new]).execute()
            want |= {i: i for i in new}
        elif what == "update":
            hit = [i for i in ids if i in want]
            assert engine.update(SRows, {"n": expression("n + 100")}).where(SRows.id.in_(ids)).execute() == len(hit)
            want |= {i: want[i] + 100 for i in hit}
        elif what == "delete":
            assert engine.delete(SRows).where(SRows.id.in_(ids[:2])).execute() == sum(i in want for i in ids[:2])
            want = {i: n for i, n in want.items() if i not in ids[:2]}
        elif what == "upsert":
            out = engine.insert_batch(SRows, [{"id": i, "n": -i} for i in ids]).on_conflict([SRows.id], [SRows.n]).execute()
            want |= {i: -i for i in ids}
            assert {r.id: r.n for r in out.collect()} == {i: -i for i in ids}
        else:
            engine.compact(SRows)
        assert {r.id: r.n for r in engine.query(SRows).all()} == want


def test_keys_are_checked_in_upserts(engine):
    engine.create(SRows, unique=[["name"]])
    engine.insert_batch(SRows, [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]).execute()
    for refused in (
        lambda: engine.insert_batch(SRows, [{"id": 1, "name": "c"}]).on_conflict([SRows.name], [SRows.n]),
        lambda: engine.insert_batch(SRows, [{"id": 1, "name": "c"}]).on_conflict_do_nothing([SRows.name]),
        lambda: engine.insert_batch(SRows, [{"id": 2, "name": "a"}]).on_conflict([SRows.id], [SRows.name]),
        lambda: engine.insert_batch(SRows, [{"id": 3, "name": "a"}]).on_conflict_do_nothing([SRows.id]),
    ):
        with pytest.raises(ConstraintError):
            refused().execute()
    engine.insert_batch(SRows, [{"id": 2, "name": "b", "n": 5}]).on_conflict([SRows.name], [SRows.n]).execute()
    assert sorted((r.id, r.name, r.n) for r in engine.query(SRows).all()) == [(1, "a", None), (2, "b", 5)]
    with pytest.raises(ConstraintError):
        engine.update(SRows, {"name": "a"}).where(SRows.id == 2).execute()


def test_generated_keys_are_those_stored(engine):
    engine.create(SRows)
    rows = engine.spark.range(0, 500, 1, 7).selectExpr("uuid() AS name", "cast(id as int) AS n").repartition(5)
    out = {r.id: r.name for r in engine.insert_batch(SRows, rows).execute().collect()}
    assert sorted(out) == list(range(1, 501)) and out == {r.id: r.name for r in engine.query(SRows).all()}


def test_returning_is_what_is_stored(engine):
    engine.create(SRows)
    engine.insert_batch(SRows, [{"id": i} for i in range(5)]).execute()
    got = {r.id: r.name for r in engine.execute("UPDATE s_rows SET name = uuid() WHERE id > 1 RETURNING id, name").collect()}
    assert got == {r.id: r.name for r in engine.query(SRows).all() if r.id > 1}
    gone = engine.execute("DELETE FROM s_rows WHERE id = 4 RETURNING id, name")
    assert engine.execute("DELETE FROM s_rows WHERE id = 99") == 0
    assert [(r.id, r.name) for r in gone.collect()] == [(4, got[4])]


def test_values_keep_their_type(engine):
    engine.create(STypes)
    values = [b"\x00\xff'", math.inf, datetime.date(2024, 2, 29), datetime.datetime(2024, 1, 2, 3, 4, 5, 678), decimal.Decimal("-12.3400"), "it's \\n \\ 'x' -- ?"]
    engine.execute("INSERT INTO s_types (id, b, f, d, t, m, s) VALUES (1, ?, ?, ?, ?, ?, ?)", values)
    engine.spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")
    try:
        engine.execute("INSERT INTO s_types (id, b, f, d, t, m, s) VALUES (2, :b, :f, :d, :t, :m, :s)", dict(zip("bfdtms", values)))
    finally:
        engine.spark.conf.unset("spark.sql.parser.escapedStringLiterals")
    for r in engine.query(STypes).all():
        assert [bytes(r.b), r.f, r.d, r.t, r.m, r.s] == values
    assert engine.execute("UPDATE s_types SET f = ? WHERE s = ? AND b = ?", [math.nan, values[-1], values[0]]) == 2
    assert all(math.isnan(r.f) for r in engine.query(STypes).all())


def test_raw_knows_tables_and_ctes_their_arguments(engine):
    engine.create(SRows)
    engine.insert_batch(SRows, [{"id": i, "n": i} for i in range(10)]).execute()
    assert engine.raw("SELECT max(n) AS n FROM s_rows WHERE id < ?", [5]).first().n == 4
    assert [r.id for r in engine.raw("SELECT * FROM s_rows WHERE id = :i", {"i": 3}, SRows)] == [3]
    engine.insert(SRows(id=50, n=50)).execute()
    assert engine.raw("SELECT max(n) AS n FROM s_rows").first().n == 50

    class SLow(Model, table="s_low"):
        id = Field("bigint", pk=True)

    q = engine.query(SLow).with_("s_high", "SELECT id FROM s_rows WHERE id > :x", {"x": 5}).with_("s_low", "SELECT id FROM s_high WHERE id < :x", {"x": 9})
    assert sorted(r.id for r in q.all()) == [6, 7, 8]


def test_preload_under_a_limit_has_all_children(engine):
    engine.create(SRows, engine.spark.range(200).selectExpr("id", "'x' AS name", "1 AS n", "'' AS password").repartition(9))
    engine.create(SChildren, engine.spark.range(1000).selectExpr("id", "id % 200 AS row_id", "(id * 7) % 200 AS other_id").repartition(9))
    rows = engine.query(SRows).where(SRows.name == "x").limit(20).preload("children", "others").all()
    assert len(rows) == 20 and all(len(r.children) == 5 and len(r.others) == 5 for r in rows)
    plan = engine.query(SRows).preload("children").df()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2


def test_read_only_writes_no_file(engine):
    engine.create(SRows)
    before = sorted(str(s.getPath()) for s in engine.store._fs.listStatus(engine.store._path(engine.store.root)))
    with pytest.raises(ReadOnly):
        engine.tx(lambda: engine.insert(SRows(id=1)).execute(), read_only=True)
    assert before == sorted(str(s.getPath()) for s in engine.store._fs.listStatus(engine.store._path(engine.store.root))) and not engine.store.head()[1]["s_rows"].segments


def test_engines_on_one_store_share_its_transaction(engine):
    engine.create(SRows)
    joined, apart, seen = Engine(engine.spark, store=engine.store), Engine(engine.spark, warehouse=engine.store.root), []

    def work():
        engine.insert(SRows(id=1)).execute()
        joined.insert(SRows(id=2)).execute()
        seen.append((engine.query(SRows).count(), joined.query(SRows).count(), apart.query(SRows).count()))

    engine.tx(work)
    assert seen == [(2, 2, 0)] and apart.query(SRows).count() == 2


def test_everything_is_told(engine, caplog):
    caplog.set_level(logging.DEBUG, "tessera")
    engine.create(SRows)
    seen = []
    engine.observer.hooks.append(seen.append)
    s = SRows
    engine.insert(s(id=1, name="a", password="hunter2")).execute()
    assert engine.query(s).where(SqlText("name = 'a'")).all()[0].id == 1 and seen[-1].args == []
    engine.query(s).group_by(s.name).having(raw("max(password)", ">", "hunter3")).select(s.name, count()).df()
    q = engine.query(s).join(s.alias("t"), s.id.eq_col(s.alias("t").id) & (s.alias("t").password == "hunter2")).where(s.n.eq(1)).group_by(s.name).having(raw("max(s_rows.password)", ">", "hunter3")).select(s.name, sum_(s.n))
    q.count()
    assert seen[-1].args == [("password", "***"), ("n", 1), ("password", "***")] and "hunter" not in seen[-1].sql()
    for broken in (lambda: engine.insert(s(id=1)).execute(), lambda: engine.execute("UPDATE s_rows SET n = nothing"), lambda: engine.raw("SELECT nothing"), lambda: engine.query(s).union(engine.query(s).where(SqlText("nothing"))).all()):
        n = len(seen)
        with pytest.raises(Exception):
            broken()
        assert len(seen) > n and all(x.error is not None for x in seen[n:]) and caplog.records[-1].levelno == logging.ERROR
    engine.execute("UPDATE s_rows SET password = ? WHERE name = ?", ["hunter4", "a"])
    engine.execute("INSERT INTO s_rows (id, password) VALUES (?, ?), (?, ?)", [5, "hunter5", 6, "hunter6"])
    engine.raw("SELECT 1 FROM s_rows WHERE password = :p", {"p": "hunter7"})
    assert "hunter" not in caplog.text and {*SENSITIVE} <= engine.observer.sensitive and len(SENSITIVE) == 12


def test_text_can_be_pasted(engine):
    engine.create(SRows)
    s = SRows
    engine.insert_batch(s, [{"id": i, "name": f"n'{i}\\", "n": i % 3, "password": "pw"} for i in range(12)]).execute()
    t = s.alias("t")
    queries = [
        engine.query(s).where(s.id > 3, s.name.in_(["n'5\\", "n'7\\"]) | s.n.between(0, 1), ~s.name.is_null()).order_by(s.id.desc()).limit(4).offset(1),
        engine.query(s).join(t, s.n.eq_col(t.n)).where(t.id.eq(2)).select(s.id, t.id.as_("other")),
        engine.query(s).group_by(s.n).having(raw("count(*)", ">", 3)).select(s.n, count().as_("c"), sum_(s.id).as_("total")).order_by(s.n.asc()),
        engine.query(s).where(s.id.in_query(engine.query(s).where(s.n == 1).select(s.id))).distinct().select(s.n),
        engine.query(s).select(s.id, sum_(s.id).over([s.n], [s.id.desc()]).as_("running")),
        engine.query(s).select(s.name).union(engine.query(s).where(s.id < 3).select(s.password)).order_by(s.name.asc()).limit(5),
        engine.query(s).select(s.id).except_(engine.query(s).where(s.id < 2).select(s.id)),
    ]
    for q in queries:
        assert sorted(map(tuple, engine.raw(q.sql()).collect())) == sorted(map(tuple, q.df().collect())), q.sql()
    assert engine.insert(s(id=1, name="it's", password="x")).sql() == "INSERT INTO `s_rows` (`id`, `name`, `password`) VALUES (1, 'it\\'s', '***')"
    assert engine.update(s(id=1, n=2)).sql() == "UPDATE `s_rows` SET `n` = 2 WHERE (`s_rows`.`id` = 1)"
    assert engine.delete(s).where(s.password == "x").sql() == "DELETE FROM `s_rows` WHERE `s_rows`.`password` = '***'"
    out = io.StringIO()
    handler = DebugSql(out)
    engine.observer.logger = logging.Logger("pasted", logging.DEBUG)
    engine.observer.logger.addHandler(handler)
    engine.query(s).where(s.password == "secret", s.n == 1).count()
    line = out.getvalue()
    assert line.count("\n") == 1 and "`n` = 1" in line and "'***'" in line and "secret" not in line and " -- count " in line


def test_json_fields(engine):
    engine.create(SJson)
    doc = {"role": "admin", "level": 5, "tags": ["go", "é"]}
    engine.insert(SJson(id=1, meta=doc)).execute()
    engine.insert_batch(SJson, [SJson(id=2, meta=None), {"id": 3, "meta": '{"role": "user"}'}]).execute()
    rows = {r.id: r.meta for r in engine.query(SJson).all()}
    assert rows == {1: doc, 2: None, 3: {"role": "user"}}
    m = SJson.meta
    got = engine.query(SJson).where(m.document("level") > 4).select(SJson.id, m.document("role").as_("role")).df().collect()
    assert [tuple(r) for r in got] == [(1, "admin")]
    engine.update(SJson(id=2, meta={"level": 7})).execute()
    assert [r.level for r in engine.query(SJson).select(m.document("level")).order_by(m.document("level").desc()).df().collect()][:2] == [7, 5]
    with pytest.raises(ValueError):
        SJson.id.document("x")


def test_defaults_and_indexes(engine):
    engine.create(SRows, unique=[["name"]], defaults={"n": 9}, indexes=[["n", "name"]])
    engine.insert(SRows(id=1, name="x")).execute()
    assert engine.query(SRows).one().n == 9
    t = schema.load(engine)["s_rows"]
    assert t.column("n").default == 9 and t.indexes == (("id",), ("name",), ("n", "name"))
