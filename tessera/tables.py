"""Models of the tables that the registered queries use."""

from __future__ import annotations

from .model import Field, Model, belongs_to, has_many, has_one, many_to_many, soft_delete


class Region(Model, table="region"):
    r_regionkey = Field("int", pk=True)
    r_name = Field("string")


class Nation(Model, table="nation"):
    n_nationkey = Field("int", pk=True)
    n_name = Field("string")
    n_regionkey = Field("int")
    region = belongs_to("region", fk="n_regionkey")


class Customer(Model, table="customer"):
    c_custkey = Field("bigint", pk=True)
    c_name = Field("string")
    c_nationkey = Field("int")
    c_acctbal = Field("double")
    c_mktsegment = Field("string")
    orders = has_many("orders", fk="o_custkey")
    nation = belongs_to("nation", fk="c_nationkey")


class Supplier(Model, table="supplier"):
    s_suppkey = Field("bigint", pk=True)
    s_name = Field("string")
    s_nationkey = Field("int")
    s_acctbal = Field("double")


class Part(Model, table="part"):
    p_partkey = Field("bigint", pk=True)
    p_name = Field("string")
    p_brand = Field("string")
    p_type = Field("string")
    p_size = Field("int")
    p_retailprice = Field("double")
    suppliers = many_to_many("supplier", through="lineitem", left="l_partkey", right="l_suppkey")


class Orders(Model, table="orders"):
    o_orderkey = Field("bigint", pk=True)
    o_custkey = Field("bigint")
    o_orderstatus = Field("string")
    o_totalprice = Field("double")
    o_orderdate = Field("timestamp_ntz")
    o_orderpriority = Field("string")
    items = has_many("lineitem", fk="l_orderkey")


class Lineitem(Model, table="lineitem"):
    l_orderkey = Field("bigint", pk=True)
    l_partkey = Field("bigint", pk=True)
    l_suppkey = Field("bigint", pk=True)
    l_linenumber = Field("int", pk=True)
    l_quantity = Field("double")
    l_extendedprice = Field("double")
    l_discount = Field("double")
    l_tax = Field("double")
    l_returnflag = Field("string")
    l_linestatus = Field("string")
    l_shipdate = Field("timestamp_ntz")


class Events(Model, table="events"):
    event_id = Field("bigint", pk=True)
    ts = Field("timestamp_ntz")
    user_id = Field("bigint")
    event_type = Field("string")
    value = Field("double")
    props = Field("string", json="k int")


class Documents(Model, table="documents"):
    doc_id = Field("bigint", pk=True)
    text = Field("string")
    lang = Field("string")
    source = Field("string")
    n_chars = Field("bigint")
    label = has_one("labels", fk="doc_id")


class Labels(Model, table="labels"):
    doc_id = Field("bigint", pk=True)
    quality = Field("int")
    toxic = Field("int")


class ClientAccounts(Model, table="client_accounts"):
    """A writable copy of customers with soft deletion."""

    c_custkey = Field("bigint", pk=True)
    c_name = Field("string")
    c_acctbal = Field("double")
    deleted_at = soft_delete()


class PartTree(Model, table="part_tree"):
    """Rows of a common table expression."""

    p_partkey = Field("bigint", pk=True)
    depth = Field("int")


class BigOrders(Model, table="big_orders"):
    """Rows of a common table expression."""

    o_orderkey = Field("bigint", pk=True)
    o_custkey = Field("bigint")
    o_totalprice = Field("double")


class NationName(Model, table="nation_name"):
    key = Field("int", pk=True)
    name = Field("string")


class AutoRegion(Model, table="auto_region"):
    id = Field("int", pk=True)
    name = Field("string")


class AutoNation(Model, table="auto_nation"):
    id = Field("int", pk=True)
    name = Field("string")
    region_id = Field("int")
