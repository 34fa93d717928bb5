"""Filters, projections, joins, aggregates, order and catalog queries."""

import pyarrow as pa
from pyspark.sql import functions as sf

from tabframe import (
    AVG, C, CASE, CMP, COL, COUNT, DATE, EXTRACT, F, JOIN, MAX, MIN, Q, SUBSTRING, SUM,
)
from tabframe.plans.durable import shared_folder
from tabframe.sources import infer_datetimes
from workload.registry import query

COSTLY = 400000


@query("""
    select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty,
      round(sum(l_extendedprice), 2) as sum_base_price,
      round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price,
      round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
      round(avg(l_quantity), 2) as avg_qty, round(avg(l_extendedprice), 2) as avg_price,
      round(avg(l_discount), 2) as avg_disc, count(*) as count_order
    from lineitem where l_shipdate <= date '2000-09-01'
    group by l_returnflag, l_linestatus""", digits=2)
def pricing_summary(ws):
    price = F("l_extendedprice") * (1 - F("l_discount"))
    return (
        ws.lineitem.filter(Q("l_shipdate", DATE("2000-09-01"), CMP.LTE))
        .project(("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount",
                  {price: "disc_price"}, {price * (1 + F("l_tax")): "charge"}))
        .aggregate(("l_returnflag", "l_linestatus", {SUM("l_quantity"): "sum_qty"},
                    {SUM("l_extendedprice"): "sum_base_price"}, {SUM("disc_price"): "sum_disc_price"},
                    {SUM("charge"): "sum_charge"}, {AVG("l_quantity"): "avg_qty"},
                    {AVG("l_extendedprice"): "avg_price"}, {AVG("l_discount"): "avg_disc"},
                    {COUNT("*"): "count_order"}), ("l_returnflag", "l_linestatus"))
        .order(["l_returnflag", "l_linestatus"], unique=True)
    )


@query("""
    select o_orderkey, o_orderstatus, o_totalprice from orders
    where (o_orderstatus = 'F' or o_totalprice >= 450000) and not (o_orderstatus <> 'F' and o_totalprice < 480000)
      and o_orderdate > date '1996-06-30'""")
def filter_and_or_not(ws):
    finished = Q("o_orderstatus", C("F"))
    return ws.orders.filter(
        (finished | Q("o_totalprice", 450000, CMP.GTE))
        & ~(Q("o_orderstatus", C("F"), CMP.NE) & Q("o_totalprice", 480000, CMP.LT)),
        Q("o_orderdate", DATE("1996-06-30"), CMP.GT),
    ).project(("o_orderkey", "o_orderstatus", "o_totalprice"))


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '5-LOW')")
def filter_in_list(ws):
    return ws.orders.filter(Q("o_orderpriority", ("1-URGENT", "5-LOW"), CMP.IN)).project(
        ("o_orderkey", "o_orderpriority"))


@query("""select o_orderkey, o_custkey from orders
    where o_orderpriority not in ('1-URGENT', '5-LOW') and o_custkey not in (1, 2, 3)""")
def filter_not_in_list(ws):
    return ws.orders.filter(
        Q("o_orderpriority", ("1-URGENT", "5-LOW"), CMP.NOTIN), Q("o_custkey", (1, 2, 3), CMP.NOTIN)
    ).project(("o_orderkey", "o_custkey"))


@query("select p_partkey, p_name from part where p_name like '%ring' or p_name like '_ed%'")
def filter_like(ws):
    return ws.part.filter(Q("p_name", C("%ring"), CMP.LIKE) | Q("p_name", C("_ed%"), CMP.LIKE)).project(
        ("p_partkey", "p_name"))


@query("select p_partkey, p_name from part where p_name not like '%ring'")
def filter_not_like(ws):
    return ws.part.filter(Q("p_name", C("%ring"), CMP.NOTLIKE)).project(("p_partkey", "p_name"))


def costly(ws):
    return ws.orders.filter(Q("o_totalprice", COSTLY, CMP.GT))


def customers_with_costly_orders(ws):
    return ws.customer.join(costly(ws), "c_custkey", "o_custkey", ("c_custkey", "c_acctbal", "c_mktsegment"),
                            ("o_orderkey", "o_totalprice"), JOIN.LEFT)


GAPS = """(select c_custkey, c_acctbal, c_mktsegment, o_orderkey, o_totalprice from customer
    left join (select * from orders where o_totalprice > 400000) o on c_custkey = o_custkey)"""


@query(f"select c_custkey, c_mktsegment from {GAPS} where o_orderkey is null")
def filter_null(ws):
    return customers_with_costly_orders(ws).filter(Q("o_orderkey", operator=CMP.NULL)).project(
        ("c_custkey", "c_mktsegment"))


@query(f"select c_custkey, o_orderkey from {GAPS} where o_orderkey is not null")
def filter_not_null(ws):
    return customers_with_costly_orders(ws).filter(Q("o_orderkey", operator=CMP.NNL)).project(
        ("c_custkey", "o_orderkey"))


@query("""select l_orderkey, l_linenumber, l_quantity from lineitem
    where l_extendedprice * (1 - l_discount) / l_quantity > 2000 + 50 * l_linenumber and -l_tax > -0.05""")
def filter_arith(ws):
    unit = Q("l_extendedprice") * (1 - Q("l_discount")) / Q("l_quantity")
    return ws.lineitem.filter(
        Q(unit, 2000 + 50 * Q("l_linenumber"), CMP.GT), Q(-Q("l_tax"), -0.05, CMP.GT)
    ).project(("l_orderkey", "l_linenumber", "l_quantity"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def filter_in_subquery(ws):
    return ws.customer.filter(Q("c_custkey", costly(ws).project("o_custkey"), CMP.IN)).project("c_custkey")


@query("""select c_custkey from customer
    where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)""")
def filter_not_in_subquery(ws):
    return ws.customer.filter(Q("c_custkey", costly(ws).project("o_custkey"), CMP.NOTIN)).project("c_custkey")


@query(f"select o_orderkey from orders where o_orderkey not in (select o_orderkey from {GAPS})")
def filter_not_in_null_subquery(ws):
    keys = customers_with_costly_orders(ws).project("o_orderkey")
    return ws.orders.filter(Q("o_orderkey", keys, CMP.NOTIN)).project("o_orderkey")


@query("""select c_custkey from customer
    where c_acctbal < 0 or c_custkey in (select o_custkey from orders where o_totalprice > 490000)""")
def filter_in_subquery_or(ws):
    rich = ws.orders.filter(Q("o_totalprice", 490000, CMP.GT)).project("o_custkey")
    return ws.customer.filter(Q("c_acctbal", 0, CMP.LT) | Q("c_custkey", rich, CMP.IN)).project("c_custkey")


@query("""select c_custkey from customer where c_mktsegment = 'MACHINERY' or
    c_custkey not in (select o_custkey from orders where o_totalprice > 400000)""")
def filter_not_in_subquery_or(ws):
    member = Q("c_custkey", costly(ws).project("o_custkey"), CMP.NOTIN)
    return ws.customer.filter(Q("c_mktsegment", C("MACHINERY")) | member).project("c_custkey")


@query("""select c_custkey from customer
    where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)""")
def filter_exists(ws):
    return ws.customer.filter(Q([("c_custkey", "o_custkey")], costly(ws), CMP.EXISTS)).project("c_custkey")


@query("""select c_custkey from customer
    where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)""")
def filter_not_exists(ws):
    return ws.customer.filter(Q([("c_custkey", "o_custkey")], costly(ws), CMP.NOTEXISTS)).project("c_custkey")


@query("""select c_custkey from customer
    where exists (select 1 from orders where o_totalprice > 499000) and c_acctbal > 9000""")
def filter_exists_uncorrelated(ws):
    top = ws.orders.filter(Q("o_totalprice", 499000, CMP.GT))
    return ws.customer.filter(Q(None, top, CMP.EXISTS), Q("c_acctbal", 9000, CMP.GT)).project("c_custkey")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > (select avg(o_totalprice) from orders)")
def filter_scalar_subquery(ws):
    mean = ws.orders.aggregate(AVG("o_totalprice"))
    return ws.orders.filter(Q("o_totalprice", mean, CMP.GT)).project(("o_orderkey", "o_totalprice"))


def quantified(name, sign, quantifier, operator, bound):
    """Compare part prices (with the sizes as the sub-column) under one quantifier."""
    sql = f"""select p_partkey from part where p_retailprice - 900 {sign} {quantifier}
        (select p_size from part where p_retailprice < {bound})"""

    def build(ws):
        sizes = ws.part.filter(Q("p_retailprice", bound, CMP.LT)).project("p_size")
        return ws.part.filter(Q(Q("p_retailprice") - 900, sizes, operator)).project("p_partkey")

    build.__name__ = name
    query(sql)(build)


for _quantifier, _short in (("all", "ALL"), ("any", "ANY")):
    for _tag, _sign in (("GT", ">"), ("GTE", ">="), ("LT", "<"), ("LTE", "<=")):
        quantified(f"filter_{_quantifier}_{_tag.lower()}", _sign, _quantifier, CMP[_tag + _short],
                   {("all", "LT"): 900.3, ("all", "LTE"): 900.3}.get((_quantifier, _tag), 950))
quantified("filter_all_empty", ">", "all", CMP.GTALL, 0)
quantified("filter_any_empty", "<", "any", CMP.LTANY, 0)


@query(f"select o_orderkey from orders where o_totalprice >= all (select o_totalprice from {GAPS})")
def filter_all_null(ws):
    prices = customers_with_costly_orders(ws).project("o_totalprice")
    return ws.orders.filter(Q("o_totalprice", prices, CMP.GTEALL)).project("o_orderkey")


@query("select p_partkey, p_retailprice as price, p_size + 1 as next_size, -p_size as minus_size from part")
def project_alias(ws):
    return ws.part.project(("p_partkey", {"p_retailprice": "price"}, {F("p_size") + 1: "next_size"},
                            {-F("p_size"): "minus_size"}))


@query("select p_partkey, 7 as seven, 'x''y' as text, p_retailprice / 2 as p_retailprice from part")
def project_const(ws):
    return ws.part.project(("p_partkey", {F(C(7)): "seven"}, {F(C("x'y")): "text"}, F("p_retailprice") / 2))


@query("""select o_orderkey, cast(extract(year from o_orderdate) as integer) as y,
    cast(extract(month from o_orderdate) as integer) as m,
    cast(extract(day from o_orderdate) as integer) as d from orders""")
def project_extract(ws):
    return ws.orders.project(("o_orderkey", {EXTRACT("o_orderdate", F.OP.YEAR): "y"},
                              {EXTRACT("o_orderdate", F.OP.MONTH): "m"}, {EXTRACT("o_orderdate", F.OP.DAY): "d"}))


@query("select p_partkey, substring(p_name, 1, 3) as head3, substring(p_brand, 7) as brand_no from part")
def project_substring(ws):
    return ws.part.project(("p_partkey", {SUBSTRING("p_name", 1, 3): "head3"}, {SUBSTRING("p_brand", 7): "brand_no"}))


@query("""select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then p_type end as size_class
    from part""")
def project_case(ws):
    return ws.part.project(("p_partkey", {CASE((
        (Q("p_size", 10, CMP.LT), C("small")), (Q("p_size", 30, CMP.LT), "p_type"))): "size_class"}))


@query("select p_partkey, case when p_size > 25 then p_size else 0 end as big from part")
def project_case_zero(ws):
    return ws.part.project(("p_partkey", {CASE(((Q("p_size", 25, CMP.GT), "p_size"),), 0): "big"}))


@query("""select c_custkey, c_name, o_orderkey, o_totalprice from customer
    join orders on c_custkey = o_custkey""")
def join_inner(ws):
    return ws.customer.join(ws.orders, "c_custkey", "o_custkey", ("c_custkey", "c_name"),
                            ("o_orderkey", "o_totalprice"))


@query(f"select c_custkey, o_orderkey, o_totalprice as price from {GAPS}")
def join_left(ws):
    return ws.customer.join(costly(ws), "c_custkey", "o_custkey", ("c_custkey",),
                            ("o_orderkey", {"o_totalprice": "price"}), JOIN.LEFT)


@query("""select o_orderkey, c_custkey, c_name from (select * from orders where o_totalprice > 400000)
    right join customer on c_custkey = o_custkey""")
def join_right(ws):
    return costly(ws).join(ws.customer, "o_custkey", "c_custkey", ("o_orderkey",), ("c_custkey", "c_name"), JOIN.RIGHT)


@query("""select c_custkey, o_orderkey, o_custkey from (select * from customer where c_acctbal > 5000)
    full join (select * from orders where o_totalprice > 400000) on c_custkey = o_custkey""")
def join_full(ws):
    wealthy = ws.customer.filter(Q("c_acctbal", 5000, CMP.GT))
    return wealthy.join(costly(ws), "c_custkey", "o_custkey", ("c_custkey",), ("o_orderkey", "o_custkey"), JOIN.OUTER)


@query("select c_custkey, r_name from customer cross join region")
def join_cross(ws):
    return ws.customer.join(ws.region, None, None, ("c_custkey",), ("r_name",), JOIN.CROSS_JOIN)


@query("""select l_orderkey, l_linenumber, c_custkey, s_suppkey, n_name from lineitem
    join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey
    join nation on s_nationkey = n_nationkey""")
def join_multi_key(ws):
    bought = ws.lineitem.join(ws.orders, "l_orderkey", "o_orderkey",
                              ("l_orderkey", "l_linenumber", "l_suppkey"), ("o_custkey",))
    bought = bought.join(ws.customer, "o_custkey", "c_custkey",
                         ("l_orderkey", "l_linenumber", "l_suppkey"), ("c_custkey", "c_nationkey"))
    near = bought.join(ws.supplier, ("l_suppkey", "c_nationkey"), ("s_suppkey", "s_nationkey"),
                       ("l_orderkey", "l_linenumber", "c_custkey"), ("s_suppkey", "s_nationkey"))
    return near.join(ws.nation, "s_nationkey", "n_nationkey",
                     ("l_orderkey", "l_linenumber", "c_custkey", "s_suppkey"), ("n_name",))


@query("""select a.o_orderkey, a.o_totalprice, b.o_totalprice as other_price, b.o_orderstatus as other_status
    from orders a join orders b on a.o_custkey = b.o_orderkey""")
def join_self(ws):
    orders = ws.orders
    return orders.join(orders, "o_custkey", "o_orderkey", ("o_orderkey", "o_totalprice"),
                       ({"o_totalprice": "other_price"}, {"o_orderstatus": "other_status"}))


@query("select * from nation join region on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey")
def join_all_columns(ws):
    places = ws.nation.join(ws.region, "n_regionkey", "r_regionkey", COL.ALL, COL.ALL)
    return places.join(ws.customer, "n_nationkey", "c_nationkey", COL.ALL, COL.ALL)


@query("""select count(*) as n, round(sum(l_quantity), 2) as qty, round(avg(l_discount), 6) as disc,
    min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem""", digits=6)
def agg_global(ws):
    return ws.lineitem.aggregate(({COUNT("*"): "n"}, {SUM("l_quantity"): "qty"}, {AVG("l_discount"): "disc"},
                                  {MIN("l_extendedprice"): "low"}, {MAX("l_extendedprice"): "high"}))


@query("""select l_returnflag, count(distinct l_suppkey) as suppliers, round(sum(distinct l_quantity), 4) as qty,
    round(avg(distinct l_tax), 4) as tax, min(distinct l_linenumber) as low, max(distinct l_linenumber) as high
    from lineitem group by l_returnflag""", digits=4)
def agg_distinct(ws):
    return ws.lineitem.aggregate(
        ("l_returnflag", {COUNT("l_suppkey", distinct=True): "suppliers"}, {SUM("l_quantity", distinct=True): "qty"},
         {AVG("l_tax", distinct=True): "tax"}, {MIN("l_linenumber", distinct=True): "low"},
         {MAX("l_linenumber", distinct=True): "high"}), "l_returnflag")


@query("""select l_returnflag, round(avg(distinct l_orderkey::bigint * 1000000000000) / 1e9, 3) as mean,
    count(distinct l_orderkey) as n from lineitem group by 1""", digits=3)
def agg_distinct_large(ws):
    """The sum of the distinct keys has more than 64 bits, their mean hasn't."""
    keys = ws.lineitem.project(("l_returnflag", "l_orderkey", {F("l_orderkey") * 1_000_000_000_000: "large"}))
    found = keys.agg(("l_returnflag", {AVG("large", distinct=True): "mean"}, {COUNT("l_orderkey", distinct=True): "n"}), "l_returnflag")
    return found.project(("l_returnflag", {F("mean") / 1e9: "mean"}, "n"))


@query("""select o_custkey, count(*) as orders, round(sum(o_totalprice), 2) as spent from orders
    group by o_custkey having count(*) > 10 and sum(o_totalprice) > 3000000""", digits=2)
def agg_having(ws):
    spent = ws.orders.agg(("o_custkey", {COUNT("*"): "orders"}, {SUM("o_totalprice"): "spent"}), "o_custkey")
    return spent.filter(Q("orders", 10, CMP.GT), Q("spent", 3000000, CMP.GT))


@query("""select cast(extract(year from o_orderdate) as integer) as y, o_orderstatus, count(*) as n,
    round(sum(o_totalprice), 2) as total from orders group by 1, 2""", digits=2)
def agg_expr_group(ws):
    by_year = ws.orders.project(({EXTRACT("o_orderdate", F.OP.YEAR): "y"}, "o_orderstatus", "o_totalprice"))
    return by_year.agg(("y", "o_orderstatus", {COUNT("*"): "n"}, {SUM("o_totalprice"): "total"}), ("y", "o_orderstatus"))


@query("""select o_orderpriority, round(sum(o_totalprice), 2) as sum_o_totalprice, count(*) as count_,
    count(o_custkey) as count_o_custkey from orders group by o_orderpriority""", digits=2)
def agg_default_alias(ws):
    return ws.orders.agg(("o_orderpriority", SUM("o_totalprice"), COUNT("*"), COUNT("o_custkey")), "o_orderpriority")


@query("select distinct o_orderstatus, o_orderpriority from orders")
def distinct_rows(ws):
    return ws.orders.project(("o_orderstatus", "o_orderpriority")).distinct()


@query("select o_orderkey, o_orderstatus, o_totalprice from orders order by o_orderstatus, o_totalprice desc")
def order_multi(ws):
    return ws.orders.project(("o_orderkey", "o_orderstatus", "o_totalprice")).order(
        ["o_orderstatus#asc", "o_totalprice#desc"])


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25")
def topk(ws):
    return ws.customer.order(["c_acctbal#desc", "c_custkey"], unique=True).project(("c_custkey", "c_acctbal")).top(25)


@query("select * from orders order by o_orderkey limit 5")
def head_ordered(ws):
    return ws.orders.order("o_orderkey", unique=True).top()


@query("select * from (select * from orders order by o_orderkey desc limit 7) order by o_orderkey")
def tail_ordered(ws):
    return ws.orders.order("o_orderkey", unique=True).bottom(7)


@query("select * from customer")
def save_roundtrip(ws):
    path = f"{shared_folder(ws._spark)}/tabframe_saved_customer"
    return ws._saveTblrData(ws.customer.project(tuple(ws.customer.cells)), "tabframe_saved_customer", drop=True, path=path)


@query("select o_orderpriority, count(*) as n from orders group by o_orderpriority")
def bind_and_sql(ws):
    ws.all_orders = ws.orders
    return ws._executeQry("select o_orderpriority, count(*) as n from all_orders group by o_orderpriority")


@query("""select o_orderpriority, count(*) as n, 4000 as least from orders where o_totalprice > 4000 * 10 and o_orderstatus = 'F'
    group by o_orderpriority""")
def bind_value(ws):
    """Plain values by name, in a query in capitals over a named frame."""
    ws.least, ws.status = 4000, "F"
    ws.done = ws.orders.filter(Q("o_orderstatus", C("F")))
    return ws._executeQry("""SELECT O_ORDERPRIORITY AS o_orderpriority, COUNT(*) AS n, least FROM DONE
        WHERE O_TOTALPRICE > :least * 10 AND O_ORDERSTATUS = status GROUP BY O_ORDERPRIORITY""")


@query("""select o_orderpriority, year, n, row_number() over (order by n desc, o_orderpriority, year) - 1 as place from
    (select o_orderpriority, year(o_orderdate)::int as year, count(*) as n from orders group by 1, 2)""")
def fetch_cdata(ws):
    """A summary fetched in order, ten rows at a time, and given back as a frame with its places."""
    years = ws.orders.project(("o_orderpriority", {EXTRACT("o_orderdate", F.OP.YEAR): "year"}))
    counts = years.agg(("o_orderpriority", "year", {COUNT("*"): "n"}), ["o_orderpriority", "year"])
    rows = pa.concat_tables(counts.order(["n#desc", "o_orderpriority", "year"], unique=True).fetch(10))
    return ws._spark.createDataFrame(rows.append_column("place", pa.array(range(rows.num_rows), pa.int64())))


@query("""select unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings',
    'pages', 'benchmark', 'labels', 'conversations']) as tableName, (select count(*) from nation) as nations""")
def list_tables(ws):
    """The stored tables of the folder, beside a count over one of them."""
    found = ws._tables().where("tableName not like 'tabframe%'").crossJoin(ws.nation.agg({COUNT("*"): "nations"}).df)
    return found


@query("select count(*) as n, false as there, 25 as kept from customer")
def drop_table(ws):
    """A table is saved, read, dropped and gone; the table it came from stays."""
    saved = ws._saveTblrData(ws.customer.project(("c_custkey", "c_name")), "tabframe_dropped_customer", drop=True)
    rows = saved.numRows
    ws._dropTable("tabframe_dropped_customer")
    there = "tabframe_dropped_customer" in [r.tableName for r in ws._tables().collect()]
    return ws.nation.agg({COUNT("*"): "kept"}).df.select(sf.lit(rows).alias("n"), sf.lit(there).alias("there"), sf.col("kept").cast("int").alias("kept"))


@query("""select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey
    group by n_name""")
def raw_sql(ws):
    joined = ws._executeQry("select n_name, c_acctbal from customer join nation on c_nationkey = n_nationkey")
    return joined.agg(("n_name", {COUNT("*"): "n"}), "n_name")


@query("select count(*) as numRows, 11 as numColumns from lineitem")
def table_shape(ws):
    """Rows and columns of a table; the rows come from file footers."""
    width = len(ws.lineitem.columns)
    return ws.lineitem.agg({COUNT("*"): "numRows"}).project(("numRows", {F(C(width)): "numColumns"}))


@query("select o_orderstatus, count(*) as n from orders group by o_orderstatus")
def load_data(ws):
    """Rows computed once and kept in the shared folder, then used."""
    kept = ws.orders.project(("o_orderkey", "o_orderstatus")).loadData(keep="durable")
    return kept.agg(("o_orderstatus", {COUNT("*"): "n"}), "o_orderstatus")


@query("select o_orderkey, cast(o_orderdate as date) as day from orders")
def infer_dates(ws):
    """Text columns become dates where every value is one."""
    texts = ws._executeQry("select o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') as day from orders")
    return infer_datetimes(texts)


@query(r"select p_partkey, p_name from part where p_name not like '%\%'")
def filter_like_backslash(ws):
    """A backslash in a pattern is a character like others."""
    return ws.part.filter(Q("p_name", C(r"%\%"), CMP.NOTLIKE)).project(("p_partkey", "p_name"))
