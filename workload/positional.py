"""Row positions, slices and stacks."""

import numpy as np

from tabframe import CMP, COUNT, EXTRACT, F, MAX, MIN, Q
from workload.registry import query

RANKED = "(select *, row_number() over (order by o_orderkey) - 1 as pos from orders)"
BY_PRICE = "(select *, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as pos from orders)"
FOUR = "o_orderkey, o_custkey, o_totalprice, o_orderstatus"


def by_key(ws):
    """Orders by their unique key."""
    return ws.orders.order("o_orderkey", unique=True).project(
        ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))


def by_price(ws):
    return ws.orders.order(["o_totalprice#desc", "o_orderkey"], unique=True).project(
        ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))


@query(f"select pos, {FOUR} from {BY_PRICE}")
def position(ws):
    return by_price(ws).positions().withColumnRenamed("__pos", "pos")


@query("""select o_orderstatus, min(pos) as first_pos, max(pos) as last_pos, count(distinct pos) as n
    from (select o_orderstatus, row_number() over (order by o_orderstatus) - 1 as pos from orders) group by 1""")
def position_hot_key(ws):
    """Positions under a key of three values: the ties are many, the ranges exact."""
    placed = ws.orders.order("o_orderstatus").positions().withColumnRenamed("__pos", "pos")
    return ws._toTable(ws.orders._of(placed), "placed").agg(_span("o_orderstatus"), "o_orderstatus")


@query("""select event_type, min(pos) as first_pos, max(pos) as last_pos, count(distinct pos) as n
    from (select event_type, row_number() over (order by event_type) - 1 as pos from events
          join nation on user_id % 25 = n_nationkey) group by 1""")
def position_copies(ws):
    """Positions of rows with many exact copies."""
    copies = ws.nation.join(ws._executeQry("select user_id % 25 as k, event_type from events"),
                            "n_nationkey", "k", None, ("event_type",))
    placed = copies.order("event_type").positions().withColumnRenamed("__pos", "pos")
    return copies._of(placed).agg(_span("event_type"), "event_type")


def _span(name):
    return (name, {MIN("pos"): "first_pos"}, {MAX("pos"): "last_pos"}, {COUNT("pos", distinct=True): "n"})


@query("select count(*) as n, min(pos) as low, max(pos) as high, count(distinct pos) as d from "
       "(select row_number() over () - 1 as pos from lineitem)")
def position_of_scan(ws):
    """Positions in file order need no shuffle and cover 0..n-1 once."""
    placed = ws.lineitem.positions().select("__pos").withColumnRenamed("__pos", "pos")
    return ws.lineitem._of(placed).agg(({COUNT("*"): "n"}, {MIN("pos"): "low"}, {MAX("pos"): "high"},
                                        {COUNT("pos", distinct=True): "d"}))


@query(f"select pos as row_pos, format('r_{{:010d}}', pos) as row_name from {RANKED}")
def row_labels(ws):
    names = by_key(ws).rowNames
    return names.positions().withColumnRenamed("__pos", "row_pos")


@query(f"select {FOUR} from {BY_PRICE} where pos >= 100 and pos < 2100")
def slice_range(ws):
    return by_price(ws)[100:2100]


@query(f"select {FOUR} from {BY_PRICE} where pos >= 3 and (pos - 3) % 7 = 0")
def slice_step(ws):
    return by_price(ws)[3::7]


@query(f"""select (n - 1 - pos) // 4 as pos, o_orderkey from
    (select *, count(*) over () as n from {BY_PRICE}) where pos % 4 = (n - 1) % 4""")
def slice_backwards(ws):
    return by_price(ws)[::-4, "o_orderkey"].positions().withColumnRenamed("__pos", "pos")


@query(f"""select {FOUR} from (select *, count(*) over () as n from {BY_PRICE}) where pos >= n - 50 and pos < n - 10""")
def slice_negative(ws):
    return by_price(ws)[-50:-10]


@query(f"select {FOUR} from {BY_PRICE} order by pos desc limit 1")
def slice_last_row(ws):
    return by_price(ws)[-1]


MONTHS = """(select row_number() over (order by y, m) - 1 as pos, n, top from
    (select extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, count(*) as n,
     max(o_totalprice) as top from orders group by 1, 2))"""


def monthly(ws):
    """Number of orders and highest price per month: as many rows as there are months."""
    dated = ws.orders.project(({EXTRACT("o_orderdate", F.OP.YEAR): "y"}, {EXTRACT("o_orderdate", F.OP.MONTH): "m"},
                               "o_totalprice"))
    rows = dated.agg(("y", "m", {COUNT("*"): "n"}, {MAX("o_totalprice"): "top"}), ("y", "m"))
    return rows.order(["y", "m"], unique=True).project(("n", "top"))


PICKS = (5, 3, 3, 1400, 0, -1)


@query(f"""select k::bigint as pos, o_orderkey, o_totalprice from {RANKED}
    join (select * from (values (0, 5), (1, 3), (2, 3), (3, 1400), (4, 0)) as t(k, src)
          union all select 5, max(o_orderkey) from orders) on pos = src""")
def slice_list(ws):
    return by_key(ws)[list(PICKS), ["o_orderkey", 2]].positions().withColumnRenamed("__pos", "pos")


@query(f"select {FOUR} from {RANKED} where pos < (select count(*) from orders where o_totalprice > 250000)")
def slice_mask(ws):
    """A mask that is a frame itself: true for the dear orders, by falling price."""
    mask = by_price(ws).project({Q("o_totalprice", 250000, CMP.GT): "dear"})
    return by_key(ws)[mask]


@query(f"select n, top from {MONTHS} where pos % 3 = 0")
def slice_mask_array(ws):
    """A mask that is an array, on the months of orders."""
    months = monthly(ws)
    return months[np.arange(months.numRows) % 3 == 0]


@query(f"select o_totalprice, o_orderkey from {RANKED} where pos < 500")
def slice_cols(ws):
    return by_key(ws)[:500, [2, "o_orderkey"]]


@query(f"select o_custkey, o_totalprice from {RANKED} where pos between 10 and 19")
def slice_of_slice(ws):
    return by_key(ws)[5:100][5:15, 1:3]


@query("""select o_orderkey, o_totalprice from
    (select *, row_number() over (order by o_orderkey) - 1 as pos from orders where o_totalprice > 250000)
    where pos >= 20 and pos < 40""")
def slice_of_filter(ws):
    dear = by_key(ws).filter(Q("o_totalprice", 250000, CMP.GT))
    return dear[20:40, ("o_orderkey", "o_totalprice")]


@query("""select c_custkey as id, c_acctbal as balance from customer union all
    select s_suppkey, s_acctbal from supplier""")
def vstack(ws):
    customers = ws.customer.project(({"c_custkey": "id"}, {"c_acctbal": "balance"}))
    return customers.vstack([ws.supplier.project(("s_suppkey", "s_acctbal"))])


@query("""select row_number() over (order by part, id) - 1 as pos, id, balance from
    (select 0 as part, c_custkey as id, c_acctbal as balance from customer union all
     select 1, s_suppkey, s_acctbal from supplier)""")
def vstack_positions(ws):
    customers = ws.customer.order("c_custkey", unique=True).project(({"c_custkey": "id"}, {"c_acctbal": "balance"}))
    suppliers = ws.supplier.order("s_suppkey", unique=True).project(("s_suppkey", "s_acctbal"))
    return customers.vstack(suppliers).positions().withColumnRenamed("__pos", "pos")


@query(f"""select a.o_orderkey as a_o_orderkey, a.o_totalprice as a_o_totalprice, b.o_orderkey as b_o_orderkey,
    b.o_totalprice as b_o_totalprice from {RANKED} a join {BY_PRICE} b on a.pos = b.pos""")
def hstack_prefix(ws):
    both = ("o_orderkey", "o_totalprice")
    return by_key(ws).project(both).hstack([by_price(ws).project(both)], ["a_", "b_"])


@query("select o_orderkey, o_totalprice, o_totalprice as twin_o_totalprice from orders")
def hstack_same_rows(ws):
    """Two projections of one table are set side by side without a join."""
    orders = ws.orders
    return orders.project(("o_orderkey", "o_totalprice")).hstack([orders.project("o_totalprice")], [None, "twin_"])


@query("select o_orderkey, 1.0::double as _c0_, 1.0::double as _c1_ from orders")
def gen_ones(ws):
    orders = by_key(ws).project("o_orderkey")
    return orders.hstack([ws._ones((orders.numRows, 2))])


@query("select count(*) as n, true as inside, true as centred from orders")
def gen_rand(ws):
    """One random number per order: all in [0, 1), their mean near one half."""
    return _random_summary(ws, ws._rand(ws.orders.numRows, "x", seed=11), 0.5, 1.0)


@query("select count(*) as n, true as inside, true as centred from orders")
def gen_randn(ws):
    return _random_summary(ws, ws._randn(ws.orders.numRows, "x", seed=11), 0.0, 12.0)


def _random_summary(ws, numbers, centre, bound):
    from pyspark.sql import functions as sf

    paired = by_key(ws).project("o_orderkey").hstack([numbers])
    x = sf.col("x")
    return paired.df.agg(
        sf.count("o_orderkey").alias("n"), (sf.max(sf.abs(x)) < bound).alias("inside"),
        (sf.abs(sf.avg(x) - centre) < 0.05).alias("centred"))
