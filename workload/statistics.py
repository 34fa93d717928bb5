"""Column summaries and describe."""

from workload.registry import query
from workload.relational import GAPS, customers_with_costly_orders


@query("""select sum(p_partkey)::bigint as p_partkey, cast(null as double) as p_name,
    cast(null as double) as p_brand, cast(null as double) as p_type, sum(p_size)::bigint as p_size,
    round(sum(p_retailprice), 2) as p_retailprice from part""", digits=2)
def col_sum(ws):
    return ws.part.sum()


@query("select round(avg(p_size), 6) as p_size, round(avg(p_retailprice), 6) as p_retailprice from part", digits=6)
def col_avg(ws):
    return ws.part.avg(["p_size", "p_retailprice"])


@query(f"""select count(c_custkey) as c_custkey, count(c_acctbal) as c_acctbal, count(c_mktsegment) as c_mktsegment,
    count(o_orderkey) as o_orderkey, count(o_totalprice) as o_totalprice from {GAPS}""")
def col_count(ws):
    return customers_with_costly_orders(ws).count()


@query("""select count(distinct p_name) as p_name, count(distinct p_brand) as p_brand,
    count(distinct p_size) as p_size from part""")
def col_countd(ws):
    return ws.part.countd(["p_name", "p_brand", "p_size"])


@query(f"""select count(*) filter (c_custkey is null) as c_custkey, count(*) filter (o_orderkey is null) as o_orderkey
    from {GAPS}""")
def col_countn(ws):
    return customers_with_costly_orders(ws).countn(["c_custkey", "o_orderkey"])


@query("select min(p_name) as p_name, min(p_size) as p_size, min(p_retailprice) as p_retailprice from part")
def col_min(ws):
    return ws.part.min(["p_name", "p_size", "p_retailprice"])


@query("select max(o_orderdate) as o_orderdate from orders")
def col_max(ws):
    return ws.orders.max("o_orderdate")


def described(table, columns):
    """SQL of ``describe``: one SELECT per metric, over (column, is_number) pairs."""
    # Metric, SQL, and whether text columns have it.
    metrics = [
        ("count", "count({})", True), ("unique", "count(distinct {})", True),
        ("nulls", "count(*) filter ({} is null)", True), ("max", "max({})", True), ("min", "min({})", True),
        ("avg", "avg({})", False), ("median", "median({})", False), ("25%", "quantile_cont({}, 0.25)", False),
        ("50%", "quantile_cont({}, 0.5)", False), ("75%", "quantile_cont({}, 0.75)", False),
        ("stddev", "stddev_pop({})", False),
    ]

    def value(column, is_number, sql, for_text):
        if is_number:
            return f"round(cast({sql.format(column)} as double), 6) as {column}"
        return f"cast({sql.format(column) if for_text else 'null'} as varchar) as {column}"

    return " union all ".join(
        f"select '{metric}' as metric, {', '.join(value(c, n, sql, t) for c, n in columns)} from {table}"
        for metric, sql, t in metrics)


@query(described("supplier", [("s_suppkey", True), ("s_nationkey", True), ("s_acctbal", True)]), digits=6)
def describe_numeric(ws):
    return ws.supplier.project(("s_suppkey", "s_nationkey", "s_acctbal")).describe()


@query(described("customer", [("c_name", False), ("c_mktsegment", False), ("c_nationkey", True)]), digits=6)
def describe_text(ws):
    return ws.customer.project(("c_name", "c_mktsegment", "c_nationkey")).describe()


@query(described("documents", [("text", False), ("doc_id", True)]), digits=6)
def describe_long_text(ws):
    """Texts are described whole, however long."""
    return ws.documents.project(("text", "doc_id")).describe()


@query("""select unnest([0.1, 0.5, 0.99])::double as point,
    unnest([quantile_cont(l_extendedprice, 0.1), quantile_cont(l_extendedprice, 0.5),
            quantile_cont(l_extendedprice, 0.99)]) as price,
    unnest([quantile_cont(l_quantity, 0.1), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.99)])
      as quantity from lineitem""", digits=4)
def exact_quantiles(ws):
    found = ws.lineitem.quantiles([0.1, 0.5, 0.99], ["l_extendedprice", "l_quantity"])
    return found.project(("point", {"l_extendedprice": "price"}, {"l_quantity": "quantity"}))
