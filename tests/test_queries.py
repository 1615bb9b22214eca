"""Queries over small literal tables."""

import pytest

from tessera.errors import NoRows
from tessera.functions import ColumnRef, avg, count, count_gt, dense_rank, exists, lag, lead, max_, min_, not_exists, rank, raw, row_number, sum_
from tessera.model import Field, Model, has_many, has_one, belongs_to, many_to_many, snake
from tessera.sources.engine import Engine


class TUsers(Model, table="t_users"):
    id = Field("bigint", pk=True)
    name = Field("string")
    dept_id = Field("bigint")
    dept = belongs_to("t_depts", fk="dept_id")
    posts = has_many("t_posts", fk="uid")
    profile = has_one("t_profiles", fk="uid")
    tags = many_to_many("t_tags", through="t_links", left="user_id", right="tag_id")


class TDepts(Model, table="t_depts"):
    id = Field("bigint", pk=True)
    name = Field("string")


class TPosts(Model, table="t_posts"):
    id = Field("bigint", pk=True)
    uid = Field("bigint")
    comments = has_many("t_comments", fk="post_id")


class TComments(Model, table="t_comments"):
    id = Field("bigint", pk=True)
    post_id = Field("bigint")


class TProfiles(Model, table="t_profiles"):
    id = Field("bigint", pk=True)
    uid = Field("bigint")


class TTags(Model, table="t_tags"):
    label = Field("string")
    id = Field("bigint", pk=True)


class TLinks(Model, table="t_links"):
    user_id = Field("bigint", pk=True)
    tag_id = Field("bigint", pk=True)


class TEmps(Model, table="t_emps"):
    id = Field("bigint", pk=True)
    dept = Field("string")
    salary = Field("bigint")


ROWS = {
    TUsers: [(1, "alice", 1), (2, "bob", 1), (3, "carol", 2), (4, "dave", 1), (5, "eve", 999), (6, "nil", None)],
    TDepts: [(1, "D1"), (2, "D2")],
    TPosts: [(100, 1), (101, 1), (102, 2)],
    TComments: [(20, 100), (21, 100), (22, 102)],
    TProfiles: [(10, 1), (11, 1)],
    TTags: [("a", 10), ("b", 11), ("c", 12)],
    TLinks: [(1, 10), (1, 11), (2, 10), (2, 12), (2, 77)],
    TEmps: [(1, "eng", 100), (2, "eng", 200), (3, "eng", 150), (4, "mkt", 120), (5, "mkt", 90)],
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("source"))
    for m, rows in ROWS.items():
        spark.createDataFrame(rows, m.__meta__.schema).coalesce(1).write.parquet(f"{root}/{m.__meta__.table}.parquet")
    return Engine(spark, root)


def rows(q):
    return sorted((tuple(r) for r in q.df().collect()), key=str)


def test_snake():
    assert [snake(x) for x in ("IDCard", "HTTPServer", "userName", "id")] == ["id_card", "http_server", "user_name", "id"]


def test_predicates(engine):
    u = TUsers
    ids = lambda *p: [r.id for r in engine.query(u).where(*p).order_by(u.id.asc()).all()]
    assert ids(u.name.like("%a%"), u.id.lt(5)) == [1, 3, 4]
    assert ids(u.name.not_like("%a%")) == [2, 5, 6]
    assert ids(u.dept_id.eq(None)) == [] and ids(u.dept_id.eq_distinct(None)) == [6] and ids(u.dept_id.ne_distinct(1)) == [3, 5, 6]
    assert ids(u.id.in_([])) == [] and len(ids(u.id.not_in([]))) == 6
    assert ids(u.id.between(2, 3)) == [2, 3] and ids(u.id.not_between(2, 5)) == [1, 6]
    assert ids((u.id == 1) | (u.id == 2) & (u.name == "bob")) == [1, 2]
    assert ids(~(u.id > 1)) == [1] and ids(u.id.eq(1).or_(None, u.id.eq(3))) == [1, 3]
    with pytest.raises(TypeError):
        bool(u.id == 1)


def test_joins(engine):
    u, d = TUsers, TDepts
    on = u.dept_id == d.id
    assert len(rows(engine.query(u).join(d, on).select(u.name, d.name.as_("dept")))) == 4
    left = rows(engine.query(u).left_join(d, on).select(u.name, d.name.as_("dept")))
    assert len(left) == 6 and ("eve", None) in left
    assert len(rows(engine.query(u).cross_join(d).select(u.id))) == 12
    a, b = u.alias("a"), u.alias("b")
    assert rows(engine.query(a).join(b, (a.dept_id == b.dept_id) & (a.id < b.id)).select(a.id.as_("x"), b.id.as_("y"))) == [(1, 2), (1, 4), (2, 4)]
    with pytest.raises(ValueError):
        engine.query(u).join(u, on).df()
    with pytest.raises(ValueError):
        engine.query(u).where(d.id == 1).df()


def test_groups(engine):
    u = TUsers
    q = engine.query(u).where(u.dept_id.lt(10)).group_by(u.dept_id).select(u.dept_id, count().as_("n"))
    assert rows(q) == [(1, 3), (2, 1)]
    assert rows(q.having(count_gt(9)).having(count_gt(1))) == [(1, 3)]
    assert rows(q.having(raw("sum(id)", ">", 3))) == [(1, 3)]
    assert [r[0] for r in q.order_by(count().asc()).df().collect()] == [2, 1]
    assert q.count() == 2 and engine.query(u).select(u.dept_id).distinct().count() == 4
    e = TEmps
    assert rows(engine.query(e).select(sum_(e.salary), avg(e.salary), min_(e.salary), max_(e.salary), count(e.salary))) == [(660, 132.0, 90, 200, 5)]
    with pytest.raises(ValueError):
        engine.query(u).group_by(u.dept_id).select(u.name, count()).df()


def test_windows(engine):
    e = TEmps
    over = lambda x: rows(engine.query(e).where(e.dept == "eng").select(e.id, x.as_("w")))
    by = ([e.dept], [e.salary.desc()])
    assert over(row_number().over(*by)) == over(rank().over(*by)) == over(dense_rank().over(["dept"], ["salary desc"])) == [(1, 3), (2, 1), (3, 2)]
    assert over(lag(e.salary).over(*by)) == [(1, 150), (2, None), (3, 200)]
    assert over(lead(e.salary).over(*by)) == [(1, None), (2, 150), (3, 100)]
    assert over(sum_(e.salary).over([e.dept])) == [(1, 450), (2, 450), (3, 450)]
    assert over(sum_(e.salary).over([e.dept], [e.id.asc()])) == [(1, 100), (2, 300), (3, 450)]
    q = engine.query(e).select(e.id, row_number().over((), [e.salary.desc()]).as_("w"))
    assert [r.id for r in q.order_by(row_number().over((), [e.salary.desc()]).asc()).df().collect()] == [2, 3, 4, 1, 5]
    with pytest.raises(ValueError):
        engine.query(e).select(rank()).df()
    with pytest.raises(ValueError):
        row_number().over((), ["salary; drop"])


def test_order_and_limits(engine):
    u = TUsers
    q = engine.query(u).order_by(u.dept_id.asc(), u.id.desc())
    assert [r.id for r in q.all()] == [6, 4, 2, 1, 3, 5]
    assert [r.id for r in q.limit(2).offset(1).all()] == [4, 2]
    assert len(q.limit(0).all()) == len(q.limit(-1).all()) == 6 and q.limit(2).count() == 6
    assert [r[0] for r in engine.query(u).select(u.name).order_by(u.id.desc()).limit(1).df().collect()] == ["nil"]
    assert q.one().id == 6
    with pytest.raises(NoRows):
        engine.query(u).where(u.id == 99).one()


def test_subqueries(engine):
    u, p = TUsers, TPosts
    mine = engine.query(p).where(p.uid == u.id)
    assert [r.name for r in engine.query(u).where(exists(mine)).order_by(u.id.asc()).all()] == ["alice", "bob"]
    assert engine.query(u).where(not_exists(mine)).count() == 4
    assert engine.query(u).where(exists(mine) | (u.name == "eve")).count() == 3
    some = engine.query(p).select(p.uid)
    assert engine.query(u).where(u.id.in_query(some)).count() == 2
    assert engine.query(u).where(u.id.not_in_query(some)).count() == 4
    assert engine.query(u).where(u.id.not_in_query(engine.query(u).select(u.dept_id))).count() == 0


def test_set_operations(engine):
    u, d = TUsers, TDepts
    a, b = engine.query(u).select(u.dept_id.as_("k")), engine.query(d).select(d.id.as_("k"))
    assert rows(a.union(b)) == [(1,), (2,), (999,), (None,)]
    assert a.union_all(b).count() == 8
    assert rows(a.intersect(b)) == [(1,), (2,)] and rows(a.except_(b)) == [(999,), (None,)]
    k = ColumnRef(None, "k")
    assert [r[0] for r in a.limit(1).union(b).order_by(k.desc()).limit(2).offset(1).df().collect()] == [2, 1]
    with pytest.raises(ValueError):
        a.union(engine.query(d).select(d.name)).df()


def test_preloads(engine):
    u = TUsers
    got = engine.query(u).order_by(u.id.asc()).preload("posts.comments", "profile", "dept", "tags").all()
    by = {r.name: r for r in got}
    assert [len(r.posts) for r in got] == [2, 1, 0, 0, 0, 0]
    assert [len(p.comments) for p in by["alice"].posts] == [2, 0]
    assert by["alice"].profile.get().id == 11 and by["bob"].profile.is_none
    assert by["carol"].dept.get().name == "D2" and by["eve"].dept.is_none and by["nil"].dept.is_none
    assert [t.id for t in by["alice"].tags] == [10, 11] and [t.label for t in by["bob"].tags] == ["a", "c"]
    assert not got[0].posts.all()[0].comments.all()[0].patch()
    plain = engine.query(u).order_by(u.id.asc()).one()
    from tessera.errors import NotLoaded

    with pytest.raises(NotLoaded):
        plain.posts.all()
    assert plain.posts.to_json() is None and by["carol"].posts.to_json() == []
    with pytest.raises(ValueError):
        engine.query(u).preload("nothing").df()
    with pytest.raises(ValueError):
        engine.query(u).preload("posts").count()


def test_raw(engine):
    engine.views(TUsers)
    assert [r.name for r in engine.raw("SELECT * FROM t_users WHERE id = ?", [2], TUsers)] == ["bob"]


def test_plans_reach_the_scan(engine, capsys):
    engine.query(TUsers).where(TUsers.id > 3).select(TUsers.name).explain()
    text = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in text and "ReadSchema: struct<id:bigint,name:string>" in text
