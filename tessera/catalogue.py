"""The registered queries of the data layer, one or more for each operator, and their SQL equivalents."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tx
from .errors import AffectedMismatch, ConstraintError, NoRows, ReadOnly, SchemaDrift
from .functions import avg, count, count_gt, count_gte, count_lt, dense_rank, exists, lag, lead, max_, min_, not_exists, rank, raw, row_number, sum_
from .model import Model
from .operators.dml import Insert, excluded, literal, stored
from .sources.engine import Engine
from .tables import AutoNation, AutoRegion, BigOrders, ClientAccounts, Customer, Documents, Events, Labels, Lineitem, Nation, NationName, Orders, Part, PartTree, Region, Supplier

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Registers a function of an engine under its name, with its SQL equivalent."""

    def register(f: Callable[[Engine], Any]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Engine(spark, sf_dir))
            return out if isinstance(out, DataFrame) else out.df()

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def stored_query(sql: str, *tables: type[Model]) -> Callable:
    """The same for functions that write: they get an engine with versioned copies of some tables, and a fresh warehouse.

    The warehouse is in ``spark.checkpoint.dir``, which executors share; a temporary folder serves in local mode only.
    """

    def register(f: Callable[[Engine], Any]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            engine = Engine(spark, sf_dir, _warehouse(spark))
            for m in tables:
                engine.create(m, _copy(engine, m))
            out = f(engine)
            return out if isinstance(out, DataFrame) else out.df()

        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _warehouse(spark: SparkSession) -> str:
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="tessera-")
    return f"{root}/warehouse-{uuid.uuid4().hex}"


def _copy(engine: Engine, m: type[Model]) -> DataFrame:
    if m is ClientAccounts:
        return engine.read(Customer).select("c_custkey", "c_name", "c_acctbal", F.lit(None).cast("timestamp").alias("deleted_at"))
    return engine.read(m)


_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("""
    SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, rank() OVER (ORDER BY round(sum(o_totalprice), 2) DESC) AS place
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name HAVING count(*) > 5 ORDER BY place, n_name LIMIT 10""")
def flagship(e: Engine) -> DataFrame:
    q = e.query(Orders).join(Customer, Orders.o_custkey == Customer.c_custkey).join(Nation, Customer.c_nationkey == Nation.n_nationkey)
    total = sum_(Orders.o_totalprice)
    place = rank().over((), [total.desc()])
    q = q.group_by(Nation.n_name).having(count_gt(5)).select(Nation.n_name, count().as_("n_orders"), total.as_("total"), place.as_("place"))
    return q.order_by(place.asc(), Nation.n_name.asc()).limit(10).df().withColumn("total", F.round("total", 2))


# sources and projection


@query("SELECT * FROM region")
def scan_all(e):
    return e.query(Region)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_all_nation(e):
    return e.query(Nation)


@query("SELECT c_custkey AS id, c_name AS customer_name, c_mktsegment FROM customer")
def project_alias(e):
    return e.query(Customer).select(Customer.c_custkey.as_("id"), Customer.c_name.as_("customer_name")).select(Customer.c_mktsegment)


# predicates


@query(f"""SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' AND o_totalprice > 1000 AND o_totalprice >= 2000
    AND o_totalprice < 300000 AND o_totalprice <= 250000""")
def filter_compare(e):
    o = Orders
    return e.query(o).where(o.o_orderstatus.eq("O"), o.o_orderpriority.ne("5-LOW"), o.o_totalprice.gt(1000.0), o.o_totalprice.gte(2000.0), o.o_totalprice.lt(300000.0), o.o_totalprice.lte(250000.0))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%'")
def filter_like(e):
    return e.query(Part).where(Part.p_name.like("%1%")).select(Part.p_partkey, Part.p_name)


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%1%'")
def filter_not_like(e):
    return e.query(Part).where(Part.p_name.not_like("%1%")).select(Part.p_partkey, Part.p_name)


def _labelled(e):
    return e.query(Documents).left_join(Labels, Documents.doc_id == Labels.doc_id).select(Documents.doc_id, Labels.quality)


_LABELLED = "SELECT documents.doc_id, quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id WHERE "


@query(_LABELLED + "quality IS NOT DISTINCT FROM NULL")
def filter_null_safe(e):
    return _labelled(e).where(Labels.quality.eq_distinct(None))


@query(_LABELLED + "quality IS DISTINCT FROM 1")
def filter_null_safe_ne(e):
    return _labelled(e).where(Labels.quality.ne_distinct(1))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(e):
    return e.query(Customer).where(Customer.c_mktsegment.in_(["BUILDING", "MACHINERY"])).select(Customer.c_custkey)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def filter_not_in(e):
    return e.query(Customer).where(Customer.c_mktsegment.not_in(["BUILDING", "MACHINERY"])).select(Customer.c_custkey)


@query("SELECT c_custkey FROM customer WHERE false")
def filter_in_empty(e):
    return e.query(Customer).where(Customer.c_custkey.in_([])).select(Customer.c_custkey)


@query("SELECT c_custkey FROM customer WHERE true")
def filter_not_in_empty(e):
    return e.query(Customer).where(Customer.c_custkey.not_in([])).select(Customer.c_custkey)


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(e):
    return e.query(Part).where(Part.p_size.between(10, 20)).select(Part.p_partkey, Part.p_size)


@query("SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 10 AND 20")
def filter_not_between(e):
    return e.query(Part).where(Part.p_size.not_between(10, 20)).select(Part.p_partkey, Part.p_size)


@query(_LABELLED + "quality IS NULL")
def filter_is_null(e):
    return _labelled(e).where(Labels.quality.is_null())


@query(_LABELLED + "quality IS NOT NULL")
def filter_is_not_null(e):
    return _labelled(e).where(Labels.quality.is_not_null())


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey = n_nationkey AND n_regionkey < c_nationkey")
def filter_columns(e):
    q = e.query(Customer).join(Nation, Customer.c_nationkey.eq_col(Nation.n_nationkey))
    return q.where(Nation.n_regionkey.compare("<", Customer.c_nationkey)).select(Customer.c_custkey)


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_orderstatus = 'F') AND (o_totalprice > 50000 OR o_orderpriority = '1-URGENT')")
def bool_mixed(e):
    o = Orders
    return e.query(o).where((o.o_orderstatus.eq("O") | o.o_orderstatus.eq("F")) & o.o_totalprice.gt(50000.0).or_(o.o_orderpriority.eq("1-URGENT"), None)).select(o.o_orderkey)


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' AND o_totalprice > 50000)")
def bool_not(e):
    return e.query(Orders).where(~(Orders.o_orderstatus.eq("O").and_(Orders.o_totalprice.gt(50000.0)))).select(Orders.o_orderkey)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000")
def where_stacked(e):
    return e.query(Orders).where(Orders.o_orderstatus.eq("O")).where(Orders.o_totalprice.gt(50000.0)).select(Orders.o_orderkey)


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(e):
    return e.query(Orders).join(Customer, Orders.o_custkey == Customer.c_custkey).select(Orders.o_orderkey, Customer.c_name)


@query("SELECT documents.doc_id, quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id AND quality = 1")
def join_left(e):
    return e.query(Documents).left_join(Labels, (Documents.doc_id == Labels.doc_id) & (Labels.quality == 1)).select(Documents.doc_id, Labels.quality)


@query("SELECT labels.doc_id AS label_id, documents.doc_id FROM documents RIGHT JOIN labels ON documents.doc_id = labels.doc_id AND lang = 'en'")
def join_right(e):
    return e.query(Documents).right_join(Labels, (Documents.doc_id == Labels.doc_id) & (Documents.lang == "en")).select(Labels.doc_id.as_("label_id"), Documents.doc_id)


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 0")
def join_full(e):
    return e.query(Supplier).full_join(Customer, (Supplier.s_suppkey == Customer.c_custkey) & (Customer.c_acctbal > 0.0)).select(Supplier.s_suppkey, Customer.c_custkey)


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(e):
    return e.query(Region).cross_join(Nation).select(Region.r_name, Nation.n_name)


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey > n_nationkey")
def join_theta(e):
    return e.query(Supplier).join(Nation, Supplier.s_nationkey > Nation.n_nationkey).select(Supplier.s_suppkey, Nation.n_nationkey)


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(e):
    a, b = Nation.alias("a"), Nation.alias("b")
    return e.query(a).join(b, (a.n_regionkey == b.n_regionkey) & (a.n_nationkey < b.n_nationkey)).select(a.n_name.as_("a_name"), b.n_name.as_("b_name"))


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def join_multi(e):
    q = e.query(Orders).join(Customer, Orders.o_custkey == Customer.c_custkey).join(Nation, Customer.c_nationkey == Nation.n_nationkey)
    return q.join(Region, Nation.n_regionkey == Region.r_regionkey).where(Region.r_name == "ASIA").select(Orders.o_orderkey, Customer.c_name, Nation.n_name, Region.r_name)


# subqueries


def _big(e):
    return e.query(Orders).where(Orders.o_custkey == Customer.c_custkey, Orders.o_totalprice > 200000.0)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_exists(e):
    return e.query(Customer).where(exists(_big(e))).select(Customer.c_custkey)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_not_exists(e):
    return e.query(Customer).where(not_exists(_big(e))).select(Customer.c_custkey)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def in_subquery(e):
    return e.query(Customer).where(Customer.c_custkey.in_query(e.query(Orders).where(Orders.o_totalprice > 200000.0).select(Orders.o_custkey))).select(Customer.c_custkey)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def not_in_subquery(e):
    return e.query(Customer).where(Customer.c_custkey.not_in_query(e.query(Orders).where(Orders.o_totalprice > 200000.0).select(Orders.o_custkey))).select(Customer.c_custkey)


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def exists_or(e):
    return e.query(Customer).where((Customer.c_acctbal < 0.0) | exists(_big(e))).select(Customer.c_custkey)


@query("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def exists_aliased(e):
    c, o = Customer.alias("c"), Orders.alias("o")
    return e.query(c).where(exists(e.query(o).where(o.o_custkey == c.c_custkey, o.o_orderstatus == "P"))).select(c.c_custkey)


# aggregation


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def agg_global(e):
    p = Orders.o_totalprice
    df = e.query(Orders).select(count().as_("n"), sum_(p).as_("total"), avg(p).as_("mean"), min_(p).as_("least"), max_(p).as_("most")).df()
    return df.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS n, max(l_discount) AS most FROM lineitem
    GROUP BY l_returnflag, l_linestatus""")
def agg_group(e):
    q = e.query(Lineitem).group_by(Lineitem.l_returnflag, Lineitem.l_linestatus)
    df = q.select(Lineitem.l_returnflag, Lineitem.l_linestatus, sum_(Lineitem.l_quantity).as_("qty"), count().as_("n"), max_(Lineitem.l_discount).as_("most")).df()
    return df.withColumn("qty", F.col("qty").cast("bigint"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def agg_having(e):
    return e.query(Orders).group_by(Orders.o_custkey).having(count_gte(12)).select(Orders.o_custkey, count().as_("n"))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) < 8")
def agg_having_lt(e):
    return e.query(Orders).group_by(Orders.o_custkey).having(count_gt(100)).having(count_lt(8)).select(Orders.o_custkey)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 3000000")
def agg_having_sum(e):
    return e.query(Orders).group_by(Orders.o_custkey).having(raw("sum(o_totalprice)", ">", 3000000.0)).select(Orders.o_custkey, count().as_("n"))


@query("SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY count(*) DESC, c_nationkey LIMIT 5")
def agg_order_by_count(e):
    return e.query(Customer).group_by(Customer.c_nationkey).select(Customer.c_nationkey).order_by(count().desc(), Customer.c_nationkey.asc()).limit(5)


@query("SELECT count(quality) AS labelled, count(*) AS n FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id")
def agg_count_col(e):
    return e.query(Documents).left_join(Labels, Documents.doc_id == Labels.doc_id).select(count(Labels.quality).as_("labelled"), count().as_("n"))


@query("SELECT DISTINCT n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def agg_distinct(e):
    return e.query(Orders).group_by(Orders.o_custkey).select(count().as_("n")).distinct()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(e):
    return e.query(Orders).select(Orders.o_orderstatus, Orders.o_orderpriority).distinct()


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_terminal(e):
    n = e.query(Orders).where(Orders.o_orderstatus == "O").limit(5).count()
    return e.spark.createDataFrame([(n,)], "n bigint")


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def count_grouped(e):
    n = e.query(Orders).group_by(Orders.o_custkey).select(Orders.o_custkey).count()
    return e.spark.createDataFrame([(n,)], "n bigint")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def one_terminal(e):
    o = e.query(Orders).where(Orders.o_orderstatus == "O").order_by(Orders.o_totalprice.desc(), Orders.o_orderkey.asc()).one()
    return e.spark.createDataFrame([(o.o_orderkey,)], "o_orderkey bigint")


# windows


def _window(item, label="w", *more):
    return lambda e: e.query(Orders).select(Orders.o_orderkey, item.as_(label), *more)


_BY = ([Orders.o_custkey], [Orders.o_totalprice.desc(), Orders.o_orderkey.asc()])
_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey)"


@query(f"SELECT o_orderkey, row_number() {_OVER} AS w FROM orders")
def win_row_number(e):
    return _window(row_number().over(*_BY))(e)


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS w FROM orders")
def win_rank(e):
    return _window(rank().over([Orders.o_custkey], ["o_orderpriority"]))(e)


@query("SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) AS w FROM orders")
def win_dense_rank(e):
    return _window(dense_rank().over(["o_custkey"], ["o_orderpriority desc"]))(e)


@query(f"SELECT o_orderkey, lag(o_totalprice) {_OVER} AS w FROM orders")
def win_lag(e):
    return _window(lag(Orders.o_totalprice).over(*_BY))(e)


@query(f"SELECT o_orderkey, lead(o_totalprice) {_OVER} AS w FROM orders")
def win_lead(e):
    return _window(lead(Orders.o_totalprice).over(*_BY))(e)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS w FROM lineitem")
def win_running_sum(e):
    x = Lineitem
    df = e.query(x).select(x.l_orderkey, x.l_partkey, x.l_suppkey, x.l_linenumber, sum_(x.l_quantity).over([x.l_orderkey], [x.l_linenumber]).as_("w")).df()
    return df.withColumn("w", F.col("w").cast("bigint"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS w, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM orders")
def win_partition_total(e):
    return _window(count().over([Orders.o_custkey]), "w", max_(Orders.o_totalprice).over([Orders.o_custkey]).as_("most"))(e)


@query("SELECT n_nationkey, count(*) OVER () AS w FROM nation")
def win_global(e):
    return e.query(Nation).select(Nation.n_nationkey, count().over().as_("w"))


@query("SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS place FROM orders GROUP BY o_custkey ORDER BY place, o_custkey LIMIT 20")
def win_over_groups(e):
    place = rank().over((), [count().desc()])
    return e.query(Orders).group_by(Orders.o_custkey).select(Orders.o_custkey, count().as_("n"), place.as_("place")).order_by(place.asc(), Orders.o_custkey.asc()).limit(20)


# order and limit


@query(f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(e):
    return e.query(Orders).where((Orders.o_orderstatus == "O") & (Orders.o_totalprice > 100000.0)).order_by(Orders.o_totalprice.desc(), Orders.o_orderkey.asc()).limit(10)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 13")
def limit_offset(e):
    return e.query(Orders).select(Orders.o_orderkey).order_by(Orders.o_orderkey.asc()).limit(7).offset(13)


@query("SELECT n_name FROM nation ORDER BY n_nationkey OFFSET 20")
def offset_alone(e):
    return e.query(Nation).select(Nation.n_name).order_by(Nation.n_nationkey.asc()).offset(20).limit(0)


@query("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def order_unselected(e):
    return e.query(Customer).select(Customer.c_name).order_by(Customer.c_acctbal.desc(), Customer.c_custkey.asc()).limit(5)


# set operations


def _nations(e):
    return e.query(Customer).where(Customer.c_acctbal > 5000.0).select(Customer.c_nationkey.as_("k")), e.query(Supplier).where(Supplier.s_acctbal > 0.0).select(Supplier.s_nationkey.as_("k"))


_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0"


@query(f"{_A} UNION {_B}")
def set_union(e):
    a, b = _nations(e)
    return a.union(b)


@query(f"{_A} UNION ALL {_B}")
def set_union_all(e):
    a, b = _nations(e)
    return a.union_all(b)


@query(f"{_A} INTERSECT {_B}")
def set_intersect(e):
    a, b = _nations(e)
    return a.intersect(b)


@query("SELECT n_nationkey AS k FROM nation EXCEPT " + _B.replace("> 0", "> 5000"))
def set_except(e):
    return e.query(Nation).select(Nation.n_nationkey.as_("k")).except_(e.query(Supplier).where(Supplier.s_acctbal > 5000.0).select(Supplier.s_nationkey.as_("k")))


@query(f"SELECT * FROM ({_A} UNION {_B}) ORDER BY k DESC LIMIT 5 OFFSET 2")
def set_tail_order(e):
    from .functions import ColumnRef

    a, b = _nations(e)
    return a.order_by(Customer.c_nationkey.asc()).limit(1).union(b).order_by(ColumnRef(None, "k").desc()).limit(5).offset(2)


# common table expressions and raw SQL


@query("WITH big_orders AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_orderkey, c_name FROM big_orders JOIN customer ON o_custkey = c_custkey")
def cte(e):
    e.views(Orders)
    q = e.query(BigOrders).with_("big_orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > :low", {"low": 200000.0})
    return q.join(Customer, BigOrders.o_custkey == Customer.c_custkey).select(BigOrders.o_orderkey, Customer.c_name)


@query("WITH a AS (SELECT * FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_orderkey, o_custkey, o_totalprice FROM a WHERE o_totalprice > 150000) SELECT o_orderkey FROM b")
def cte_multi(e):
    e.views(Orders)
    q = e.query(BigOrders).with_("open_orders", "SELECT * FROM orders WHERE o_orderstatus = 'O'")
    return q.with_("big_orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM open_orders WHERE o_totalprice > 150000").select(BigOrders.o_orderkey)


@query("""WITH RECURSIVE t(p_partkey, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 1
    UNION ALL SELECT part.p_partkey, depth + 1 FROM part JOIN t ON part.p_partkey // 10 = t.p_partkey) SELECT p_partkey, depth FROM t""")
def cte_recursive(e):
    e.views(Part)
    sql = "SELECT p_partkey, 0 FROM part WHERE p_partkey = :root UNION ALL SELECT part.p_partkey, depth + 1 FROM part JOIN part_tree ON part.p_partkey div 10 = part_tree.p_partkey"
    return e.query(PartTree).with_("part_tree", sql, {"root": 1}, recursive=True, columns=("p_partkey", "depth"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 48 AND l_returnflag = 'R'")
def raw_sql(e):
    e.views(Lineitem)
    return e.raw("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > ? AND l_returnflag = ?", [48, "R"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 50")
def json_field(e):
    k = Events.props.document("k")
    return e.query(Events).where(k > 50).select(Events.event_id, k.as_("k"))


# preloads, in flat form


def _flat(df, key, name, child):
    rows = F.array_sort(F.transform(name, lambda r: r[child]))
    return df.select(key, F.size(name).cast("bigint").alias("n"), F.array_join(rows, ",").alias("keys"))


@query("""SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS keys
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY c_custkey""")
def preload_has_many(e):
    return _flat(e.query(Customer).where(Customer.c_acctbal > 0.0).preload("orders").df(), "c_custkey", "orders", "o_orderkey")


@query("""SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS keys
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def preload_has_many_all(e):
    return _flat(e.query(Customer).preload("orders").df(), "c_custkey", "orders", "o_orderkey")


@query("SELECT documents.doc_id, quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id")
def preload_has_one(e):
    return e.query(Documents).preload("label").df().select("doc_id", F.col("label.quality").alias("quality"))


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def preload_belongs_to(e):
    return e.query(Nation).preload("region").df().select("n_name", F.col("region.r_name").alias("r_name"))


@query("""SELECT p_partkey, count(s_suppkey) AS n, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS keys
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE p_size < 10 GROUP BY p_partkey""")
def preload_m2m(e):
    return _flat(e.query(Part).where(Part.p_size < 10).preload("suppliers").df(), "p_partkey", "suppliers", "s_suppkey")


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_items FROM customer
    LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def preload_nested(e):
    df = e.query(Customer).preload("orders.items").df()
    items = F.aggregate("orders", F.lit(0), lambda n, o: n + F.size(o["items"]))
    return df.select("c_custkey", F.size("orders").cast("bigint").alias("n_orders"), items.cast("bigint").alias("n_items"))


# writes: the state afterwards

_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@stored_query(f"{_SUPPLIER} UNION ALL SELECT 900001, 'new', 3, NULL", Supplier)
def insert(e):
    e.insert(Supplier(s_suppkey=900001, s_name="new", s_nationkey=3)).execute()
    return e.query(Supplier)


@stored_query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, NULL FROM nation", Nation)
def insert_batch(e):
    rows = e.read(Nation).select((F.col("n_nationkey") + 100).alias("n_nationkey"), "n_name")
    e.insert_batch(Nation, rows).execute()
    return e.query(Nation)


@stored_query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + x, 'n' || x, 1 FROM (VALUES (1), (2), (3)) t(x)", Nation)
def insert_generated_keys(e):
    e.insert_batch(Nation, [Nation(n_name=f"n{x}", n_regionkey=1) for x in (1, 2, 3)]).execute()
    return e.query(Nation)


@stored_query("""SELECT s_suppkey, CASE WHEN s_suppkey = 1 THEN 'one' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_suppkey = 1 THEN NULL ELSE s_acctbal END AS s_acctbal
    FROM supplier UNION ALL SELECT 900001, 'new', 4, 1.5""", Supplier)
def upsert_overwrite(e):
    rows = [{"s_suppkey": 1, "s_name": "one", "s_nationkey": 99, "s_acctbal": None}, {"s_suppkey": 900001, "s_name": "new", "s_nationkey": 4, "s_acctbal": 1.5}]
    e.insert_batch(Supplier, rows).on_conflict([Supplier.s_suppkey], [Supplier.s_name, Supplier.s_acctbal]).execute()
    return e.query(Supplier)


@stored_query(f"{_SUPPLIER} UNION ALL SELECT 900001, 'new', 4, 1.5", Supplier)
def upsert_do_nothing(e):
    rows = [{"s_suppkey": 1, "s_name": "one", "s_nationkey": 99, "s_acctbal": None}, {"s_suppkey": 900001, "s_name": "new", "s_nationkey": 4, "s_acctbal": 1.5}]
    e.insert_batch(Supplier, rows).on_conflict_do_nothing([Supplier.s_suppkey]).execute()
    return e.query(Supplier)


@stored_query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey < 5 THEN (s_acctbal + 10) * 2 - 1 ELSE s_acctbal END AS s_acctbal FROM supplier", Supplier)
def upsert_accumulate(e):
    rows = e.read(Supplier).where("s_suppkey < 5").withColumn("s_acctbal", F.lit(10.0))
    total = (stored(Supplier.s_acctbal) + excluded(Supplier.s_acctbal)) * literal(2) - literal(1)
    e.insert_batch(Supplier, rows).on_conflict_set([Supplier.s_suppkey], {Supplier.s_acctbal: total}).execute()
    return e.query(Supplier)


@stored_query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 5000 THEN 0 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier", Supplier)
def update_partial(e):
    e.update(Supplier, {"s_nationkey": 0}).where(Supplier.s_acctbal > 5000.0).execute()
    return e.query(Supplier)


@stored_query("SELECT s_suppkey, CASE WHEN s_suppkey = 7 THEN 'seven' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier", Supplier)
def update_by_pk(e):
    e.update(Supplier(s_suppkey=7, s_name="seven")).expect(1).execute()
    return e.query(Supplier)


@stored_query(f"{_SUPPLIER} WHERE NOT s_acctbal < 1000", Supplier)
def delete_where(e):
    e.delete(Supplier).where(Supplier.s_acctbal < 1000.0).execute()
    return e.query(Supplier)


@stored_query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 3", Nation)
def delete_by_id(e):
    e.delete_by_id(Nation, 3)
    return e.query(Nation)


@stored_query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey = 1 AND l_linenumber = 1)", Lineitem)
def delete_composite(e):
    e.delete_by_ids(Lineitem, {"l_orderkey": 1, "l_linenumber": 1})
    x = Lineitem
    return e.query(x).select(x.l_orderkey, x.l_partkey, x.l_suppkey, x.l_linenumber)


@stored_query("SELECT c_custkey, c_name FROM customer WHERE NOT c_acctbal < 0", ClientAccounts)
def soft_delete(e):
    a = ClientAccounts
    e.delete(a).where(a.c_acctbal < 0.0).execute()
    e.delete(a).where(a.c_acctbal < 0.0).expect(0).execute()
    return e.query(a).select(a.c_custkey, a.c_name)


@stored_query("SELECT c_custkey, c_acctbal < 0 AS deleted FROM customer", ClientAccounts)
def soft_delete_unscoped(e):
    a = ClientAccounts
    e.delete(a).where(a.c_acctbal < 0.0).execute()
    return e.query(a).unscoped().df().select("c_custkey", F.col("deleted_at").isNotNull().alias("deleted"))


@stored_query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 2 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 100, 'x', 1", Nation)
def tx_commit(e):
    def work():
        e.insert(Nation(n_nationkey=100, n_name="x", n_regionkey=1)).execute()
        e.update(Nation, {"n_regionkey": 9}).where(Nation.n_nationkey == 2).execute()

    e.tx(work)
    return e.query(Nation)


@stored_query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'alice', 1 UNION ALL SELECT 102, 'carol', 1", Nation)
def tx_savepoint(e):
    def undone():
        e.insert(Nation(n_nationkey=101, n_name="bob", n_regionkey=1)).execute()
        raise RuntimeError

    def work():
        e.insert(Nation(n_nationkey=100, n_name="alice", n_regionkey=1)).execute()
        try:
            tx.run(e.store, undone, e.options)
        except RuntimeError:
            pass
        e.insert(Nation(n_nationkey=102, n_name="carol", n_regionkey=1)).execute()

    e.tx(work)
    return e.query(Nation)


@stored_query("SELECT n_nationkey, n_name, n_regionkey FROM nation", Nation)
def tx_rollback(e):
    def work():
        e.delete(Nation).delete_all().execute()
        raise RuntimeError

    try:
        e.tx(work)
    except RuntimeError:
        pass
    return e.query(Nation)


@stored_query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 5 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey <> 8 UNION ALL SELECT 900001, 'raw', 4, NULL", Supplier)
def raw_write(e):
    e.execute("UPDATE supplier SET s_acctbal = s_acctbal + ? WHERE s_nationkey = ?", [5, 3])
    e.execute("DELETE FROM supplier WHERE s_suppkey = :key", {"key": 8})
    e.execute("INSERT INTO supplier (s_suppkey, s_name, s_nationkey) VALUES (?, ?, ?)", [900001, "raw", 4])
    return e.query(Supplier)


@stored_query("SELECT n_nationkey, n_name || '!' AS shout FROM nation WHERE n_regionkey = 1", Nation)
def raw_returning(e):
    return e.execute("UPDATE nation SET n_name = concat(n_name, '!') WHERE n_regionkey = 1 RETURNING n_nationkey, n_name AS shout")


# further writes, checks and observation; small results are put into frames


def _rows(e, rows, schema):
    return e.spark.createDataFrame(rows, schema)


def _refused(work, error):
    """Whether a call raises an error."""
    try:
        work()
    except error:
        return True
    return False


@stored_query(f"{_SUPPLIER} UNION ALL SELECT 900001, 'refused 2', 0, 0", Supplier)
def upsert_unique_conflict(e):
    """Upserts by one key that would repeat another one write nothing."""
    keys = lambda: e.insert_batch(Supplier, [{"s_suppkey": 1, "s_name": "nobody has this name", "s_nationkey": 1, "s_acctbal": 0.0}])
    n = sum(_refused(f(keys(), [Supplier.s_name]).execute, ConstraintError) for f in (Insert.on_conflict_do_nothing, lambda i, k: i.on_conflict(k, [Supplier.s_acctbal])))
    e.insert(Supplier(s_suppkey=900001, s_name=f"refused {n}", s_nationkey=0, s_acctbal=0.0)).execute()
    return e.query(Supplier)


@stored_query("SELECT s_suppkey, s_acctbal * 2 AS doubled, true AS same FROM supplier WHERE s_nationkey = 3", Supplier)
def update_returning(e):
    """What RETURNING gives is what is stored, however often the expression would change."""
    got = e.execute("UPDATE supplier SET s_acctbal = s_acctbal * 2, s_name = uuid() WHERE s_nationkey = ? RETURNING s_suppkey, s_acctbal AS doubled, s_name", [3])
    now = e.query(Supplier).select(Supplier.s_suppkey, Supplier.s_name.as_("now")).df()
    return got.join(now, "s_suppkey").select("s_suppkey", "doubled", (F.col("s_name") == F.col("now")).alias("same"))


@stored_query("SELECT s_suppkey, CASE WHEN s_suppkey = 7 THEN 'seven' ELSE s_name END AS s_name, CASE WHEN s_suppkey <> 7 THEN s_nationkey END AS s_nationkey, CASE WHEN s_suppkey <> 7 THEN s_acctbal END AS s_acctbal FROM supplier", Supplier)
def update_all_fields(e):
    e.update(Supplier(s_suppkey=7, s_name="seven")).all_fields().execute()
    return e.query(Supplier)


@stored_query(f"{_SUPPLIER}", Supplier)
def expect_mismatch(e):
    e.tx(lambda: _refused(e.update(Supplier, {"s_name": "x"}).where(Supplier.s_nationkey == 3).expect(1_000_000).execute, AffectedMismatch))
    _refused(e.delete(Supplier).where(Supplier.s_nationkey == 3).expect(1_000_000).execute, AffectedMismatch)
    return e.query(Supplier)


@stored_query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'alice', 1 UNION ALL SELECT 101, 'bob', 1", Nation)
def tx_reuse(e):
    def inner():
        e.insert(Nation(n_nationkey=101, n_name="bob", n_regionkey=1)).execute()
        raise RuntimeError

    def work():
        e.insert(Nation(n_nationkey=100, n_name="alice", n_regionkey=1)).execute()
        _refused(lambda: e.tx(inner, mode="reuse"), RuntimeError)

    e.tx(work)
    return e.query(Nation)


@stored_query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'retried 1', 1", Nation)
def tx_retry(e):
    """Another commit comes between; the transaction runs again."""
    other, calls = Engine(e.spark, e.source, e.store.root), []

    def work():
        n = len(calls)
        e.query(Nation).count()
        calls.append(n)
        if not n:
            other.delete_by_id(Nation, 100)
            other.update(Nation(n_nationkey=1, n_regionkey=99)).execute()
            other.update(Nation(n_nationkey=1, n_regionkey=1)).execute()
        e.insert(Nation(n_nationkey=100, n_name=f"retried {n}", n_regionkey=1)).execute()

    e.tx(work, retries=3)
    return e.query(Nation)


@stored_query("SELECT count(*) AS inside, 25 AS outside FROM (SELECT * FROM nation UNION ALL SELECT 100, 'x', 1)", Nation)
def tx_ambient(e):
    """An engine over the same store takes part in the open transaction, one of its own over the same folder does not."""
    joined, apart, seen = Engine(e.spark, e.source, store=e.store), Engine(e.spark, e.source, e.store.root), []

    def work():
        e.insert(Nation(n_nationkey=100, n_name="x", n_regionkey=1)).execute()
        seen.append((joined.query(Nation).count(), apart.query(Nation).count()))
        raise RuntimeError

    _refused(lambda: e.tx(work), RuntimeError)
    return _rows(e, seen, "inside bigint, outside int")


@stored_query("SELECT true AS written, true AS locked, true AS created", Nation)
def tx_read_only(e):
    new = lambda: e.insert(Nation(n_nationkey=100)).execute()
    n = len(e.store.files(e.store.head()[1]["nation"].segments[0]))
    out = [_refused(lambda: e.tx(f, read_only=True), ReadOnly) for f in (new, lambda: e.delete(Nation).delete_all().execute(), lambda: e.create(Region))]
    assert n == len(e.store.files(e.store.head()[1]["nation"].segments[0]))
    return _rows(e, [tuple(out)], "written boolean, locked boolean, created boolean")


@stored_query("SELECT * FROM (VALUES (1, 'before_create'), (2, 'after_create'), (3, 'before_update'), (4, 'after_update'), (5, 'before_delete'), (6, 'refused')) t(n, event)", Nation)
def hooks(e):
    seen = []

    def refuse(_):
        raise PermissionError

    for event in ("before_create", "after_create", "before_update", "after_update", "before_delete"):
        e.on(Nation, event, lambda _, event=event: seen.append(event))
    e.on(Nation, "before_delete", refuse)
    e.insert(Nation(n_nationkey=100, n_name="x")).execute()
    e.update(Nation(n_nationkey=100, n_name="y")).execute()
    if _refused(lambda: e.delete_by_id(Nation, 100), PermissionError) and e.query(Nation).where(Nation.n_nationkey == 100).count() == 1:
        seen.append("refused")
    return _rows(e, list(enumerate(seen, 1)), "n int, event string")


@stored_query("""SELECT * FROM (VALUES (1, 'select', false, 25), (2, 'insert', false, NULL), (3, 'insert', true, NULL), (4, 'update', false, 1), (5, 'raw', true, NULL),
    (6, 'execute', true, NULL), (7, 'count', false, 1)) t(n, op, failed, n_rows)""", Nation)
def query_log(e):
    """Reads, writes, raw statements and set operations are told, with the errors of those that fail."""
    seen = []
    e.query(Nation).count()
    e.observer.hooks.append(seen.append)
    e.query(Nation).all()
    e.insert(Nation(n_nationkey=100, n_name="x")).execute()
    _refused(e.insert(Nation(n_nationkey=100, n_name="x")).execute, ConstraintError)
    e.update(Nation(n_nationkey=100, n_name="y")).execute()
    _refused(lambda: e.raw("SELECT nothing FROM nation"), Exception)
    _refused(lambda: e.execute("UPDATE nation SET n_name = nothing WHERE true"), Exception)
    e.query(Nation).union(e.query(Nation)).count()
    told = [x for x in seen if not (x.op == "update" and x.error)]
    return _rows(e, [(i, x.op, x.error is not None, x.rows) for i, x in enumerate(told, 1)], "n int, op string, failed boolean, n_rows int")


@stored_query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 3 AND 9 AND n_name LIKE 'N%' AND n_name NOT IN ('it''s', 'x')", Nation)
def rendered_sql(e):
    """The text of a query, run as it is, gives the rows of the query."""
    n = Nation
    q = e.query(n).where(n.n_nationkey.between(3, 9), n.n_name.like("N%"), n.n_name.not_in(["it's", "x"])).select(n.n_nationkey, n.n_name).order_by(n.n_name.desc())
    return e.raw(q.sql())


@stored_query("SELECT * FROM (VALUES ('INSERT INTO `nation` (`n_nationkey`, `n_name`) VALUES (1, ''it\\''s'')', 25)) t(text, n)", Nation)
def insert_preview(e):
    text = e.insert(Nation(n_nationkey=1, n_name="it's")).sql()
    return _rows(e, [(text, e.query(Nation).count())], "text string, n int")


@stored_query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) + 1 AS k FROM events WHERE event_id < 100 UNION ALL SELECT -1, 7", Events)
def json_write(e):
    """Documents go in and come out as Python objects; queries read parts of them."""
    e.insert(Events(event_id=-1, props={"k": 6})).execute()
    rows = e.query(Events).where(Events.event_id < 100).all()
    e.delete(Events).where(Events.event_id < 100).execute()
    e.insert_batch(Events, [Events(event_id=r.event_id, props={"k": r.props["k"] + 1}) for r in rows]).execute()
    return e.query(Events).where(Events.event_id < 100).select(Events.event_id, Events.props.document("k").as_("k"))


@stored_query("""SELECT * FROM (VALUES ('n_nationkey', 'int', false, NULL, true), ('n_name', 'string', true, 'none', true), ('n_regionkey', 'int', true, NULL, false)) t(name, type, nullable, fallback, indexed)""")
def introspection(e):
    from .sources import schema

    e.create(Nation, unique=[["n_name"]], defaults={"n_name": "none"}, indexes=[["n_name", "n_regionkey"]])
    t = schema.load(e)["nation"]
    first = {x[0] for x in t.indexes}
    return _rows(e, [(c.name, c.type, c.nullable, c.default, c.name in first) for c in t.columns], "name string, type string, nullable boolean, fallback string, indexed boolean")


@stored_query("SELECT * FROM (VALUES ('missing_column', 'extra'), ('model_extra_column', 'n_regionkey'), ('pk_mismatch', '')) t(kind, name)", Nation)
def schema_drift(e):
    from .sources import schema

    t = schema.load(e)["nation"]
    table = schema.TableInfo("nation", (*t.columns[:-1], schema.Column("extra", "string", True)), ("n_name",))
    found = schema.bind({"nation": table}, Nation)
    assert _refused(lambda: schema.must_bind({"nation": table}, Nation), SchemaDrift) and not schema.bind(schema.load(e), Nation)
    return _rows(e, [(d.kind, d.column) for d in found], "kind string, name string")


@stored_query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def auto_relations(e):
    """Relations from the foreign keys of tables; rows are loaded through them."""
    from .sources import schema

    source = Engine(e.spark, e.source)
    e.create(AutoRegion, source.read(Region).toDF("id", "name"))
    e.create(AutoNation, source.read(Nation).toDF("id", "name", "region_id"), foreign=[("region_id", "auto_region", "id")])
    schema.auto_relations(schema.load(e, "auto_region", "auto_nation"))
    rows = e.query(AutoNation).preload("region").all()
    assert sum(len(r.auto_nations) for r in e.query(AutoRegion).preload("auto_nations").all()) == len(rows)
    return _rows(e, [(r.id, r.name, r.region.get().name) for r in rows], "n_nationkey int, n_name string, r_name string")


@stored_query("SELECT n_nationkey AS key, n_name AS name FROM nation", Nation)
def sinks(e):
    """Rows as instances of another model, as JSON, and one by one."""
    into = e.query(Nation).select(Nation.n_nationkey.as_("key"), Nation.n_name.as_("name")).all_into(NationName)
    first = e.query(Nation).order_by(Nation.n_nationkey.asc()).one()
    assert first.to_dict()["n_nationkey"] == 0 and _refused(e.query(Nation).where(Nation.n_nationkey == -1).one, NoRows)
    return _rows(e, [(r.key, r.name) for r in into], "key int, name string")


@stored_query(f"{_SUPPLIER}", Supplier)
def compaction(e):
    """Many small files become one; the rows stay."""
    rows = e.read(Supplier)
    e.delete(Supplier).delete_all().execute()
    for k in range(3):
        e.insert_batch(Supplier, rows.where(F.pmod("s_suppkey", F.lit(3)) == k).repartition(4)).execute()
    assert e.compact(Supplier) > 2 and e.compact(Supplier) == 0
    return e.query(Supplier)
