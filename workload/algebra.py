"""Arithmetic on whole frames, transposes and matrix products."""

import numpy as np
from pyspark.sql import functions as sf

from tabframe import AVG, C, COUNT, F, MAX, MIN, SUM, Frame, multiply_long
from tabframe.operators.matrix import long_form
from workload.positional import BY_PRICE, MONTHS, RANKED, monthly
from workload.registry import query

DIM = 64


def sizes(ws):
    return ws.part.order("p_partkey", unique=True).project(("p_partkey", "p_size", "p_retailprice"))


def vectors(ws):
    """The embeddings as a frame of 64 columns."""
    rows = ws.embeddings.order("vec_id", unique=True)
    spread = rows.unsorted().select("vec_id", *(sf.get("embedding", sf.lit(j)).cast("double").alias(f"e{j}")
                                                for j in range(DIM)))
    return Frame.of(spread).order("vec_id", unique=True).project(tuple(f"e{j}" for j in range(DIM)))


VECTORS = "(select vec_id, generate_subscripts(embedding, 1) - 1 as j, unnest(embedding)::double as v from embeddings)"


def scalar_query(name, sql, build, digits=None):
    def run(ws):
        return build(sizes(ws))

    run.__name__ = name
    columns = ", ".join(f"{sql.format(c)} as {c}" for c in ("p_partkey", "p_size", "p_retailprice"))
    query(f"select {columns} from part", digits=digits)(run)


# Sums and products of whole numbers stay whole (bigint); division and powers are double.
scalar_query("alg_add", "{0} + 3::bigint", lambda x: x + 3)
scalar_query("alg_sub", "{0} - 2::bigint", lambda x: x - 2)
scalar_query("alg_mul", "{0} * 4::bigint", lambda x: 4 * x)
scalar_query("alg_div", "{0} / 7::double", lambda x: x / 7)
scalar_query("alg_rsub", "1000::bigint - {0}", lambda x: 1000 - x)
scalar_query("alg_rdiv", "100 / nullif({0}, 0)::double", lambda x: 100 / x)
scalar_query("alg_pow", "round(pow({0}::double, 2), 6)", lambda x: x ** 2, digits=6)
scalar_query("alg_chain", "(({0}::double * 2 + 1) / 3 - 5) * ({0}::double * 2 + 1)",
             lambda x: ((x * 2 + 1) / 3 - 5) * (x * 2 + 1))


def pair(ws):
    """Orders in two different row orders, to be combined by position."""
    both = ("o_orderkey", "o_totalprice")
    a = ws.orders.order("o_orderkey", unique=True).project(both)
    return a, ws.orders.order(["o_totalprice#desc", "o_orderkey"], unique=True).project(both)


def frame_query(name, sql, build):
    def run(ws):
        a, b = pair(ws)
        return build(a, b).positions().withColumnRenamed("__pos", "pos")

    run.__name__ = name
    columns = ", ".join(f"{sql.format(c)} as {c}" for c in ("o_orderkey", "o_totalprice"))
    query(f"select a.pos, {columns} from {RANKED} a join {BY_PRICE} b on a.pos = b.pos")(run)


frame_query("alg_frame_add", "a.{0} + b.{0}", lambda a, b: a + b)
frame_query("alg_frame_sub", "a.{0} - b.{0}", lambda a, b: a - b)
frame_query("alg_frame_mul", "a.{0} * (b.{0} / 1000)", lambda a, b: a * (b / 1000))
frame_query("alg_frame_div", "a.{0} / nullif(b.{0}, 0)", lambda a, b: a / b)
frame_query("alg_frame_broadcast_col", "a.{0} - b.o_totalprice", lambda a, b: a - b[:, 1])


@query(f"select pos, o_orderkey * 10::bigint as o_orderkey, o_totalprice * 0.5::double as o_totalprice from {RANKED}")
def alg_array_row(ws):
    """A (1, k) array has one number per column."""
    a, _ = pair(ws)
    weighted = a * np.array([[10, 0.5]], dtype=object)
    return weighted.positions().withColumnRenamed("__pos", "pos")


@query(f"select pos, pos / 2 - n as n, pos / 2 - top as top from {MONTHS}")
def alg_array_col(ws):
    """An (n,) array has one number per row; here on the left of the months of orders."""
    months = monthly(ws)
    return (np.arange(months.numRows) / 2 - months).positions().withColumnRenamed("__pos", "pos")


@query(f"select pos, n + 2 * pos as n, top + (2 * pos + 1) as top from {MONTHS}")
def alg_array_cells(ws):
    """An (n, k) array goes cell by cell."""
    months = monthly(ws)
    result = months + np.arange(2 * months.numRows).reshape(-1, 2)
    return result.positions().withColumnRenamed("__pos", "pos")


@query("""select s_suppkey, round(s_suppkey - s_acctbal / 1000, 6) as left_part, round(s_acctbal / 1000 * 2, 6) as right_part
    from supplier""", digits=6)
def alg_same_rows(ws):
    """Columns of one table are combined without a join."""
    supplier = ws.supplier
    money = supplier.project("s_acctbal") / 1000
    parts = (supplier.project("s_suppkey") - money).project({"s_suppkey": "left_part"})
    return supplier.project("s_suppkey").hstack([parts, (money + money).project({"s_acctbal": "right_part"})])


@query("""select round(p_size + 2 * p_retailprice, 6) as u, round(3 * p_size - p_retailprice / 2, 6) as w from part""",
       digits=6)
def matmul_small(ws):
    """part (n x 2) @ a two-row frame computed from part as well."""
    right = Frame.of(ws.part.unsorted().agg(
        sf.array(sf.struct(sf.lit(0).cast("bigint").alias("__pos"), (sf.min("p_size") * 1.0).alias("u"),
                           (sf.min("p_size") * 3.0).alias("w")),
                 sf.struct(sf.lit(1).cast("bigint").alias("__pos"), (sf.min("p_size") * 2.0).alias("u"),
                           (sf.min("p_size") * -0.5).alias("w"))).alias("lines")
    ).select(sf.inline("lines")))
    return ws.part.project(("p_size", "p_retailprice")) @ right


@query("""select round(p_size + 2 * p_retailprice, 6) as r_0000000000,
    round(3 * p_size - p_retailprice / 2, 6) as r_0000000001 from part""", digits=6)
def matmul_array(ws):
    return ws.part.project(("p_size", "p_retailprice")) @ np.array([[1.0, 3.0], [2.0, -0.5]])


@query(f"""select 0::bigint as pos, sum(n)::double as n, round(sum(top), 4) as top from {MONTHS}
    union all select 1, sum(n * (pos % 3))::double, round(sum(top * (pos % 3)), 4) from {MONTHS}""", digits=4)
def rmatmul_array(ws):
    """A (2, n) array from the left of the months of orders."""
    months = monthly(ws)
    left = np.vstack([np.ones(months.numRows), np.arange(months.numRows) % 3])
    return (left @ months).positions().withColumnRenamed("__pos", "pos")


@query("""select unnest([0, 1]) as pos, unnest([round(sum(p_size * p_size), 2), round(sum(p_retailprice * p_size), 2)])
    ::double as p_size, unnest([round(sum(p_size * p_retailprice), 2), round(sum(p_retailprice * p_retailprice), 2)])
    as p_retailprice from part""", digits=2)
def gram(ws):
    """X.T @ X over two columns: one aggregation, no join."""
    x = ws.part.project(("p_size", "p_retailprice"))
    return (x.T @ x).positions().withColumnRenamed("__pos", "pos").withColumn("pos", sf.col("pos").cast("int"))


GRAM = f"""select a.j as i, b.j as j, round(sum(a.v * b.v), 6) as v from {VECTORS} a
    join {VECTORS} b on a.vec_id = b.vec_id group by all"""


@query(f"select i::bigint as i, j::bigint as j, v from ({GRAM})", digits=6)
def gram_wide(ws):
    """X.T @ X over 64 columns: partial products per task."""
    x = vectors(ws)
    return long_form(x.T @ x)


@query(f"select i::bigint as i, j::bigint as j, v from ({GRAM})", digits=6)
def matmul_long(ws):
    """The same product of two long forms, block by block."""
    cells = long_form(vectors(ws))
    return multiply_long(cells.select(sf.col("j").alias("i"), sf.col("i").alias("j"), "v"), cells)


@query("""select unnest([0, 0, 0, 1, 1, 1, 2, 2, 2])::bigint as i, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2])::bigint as j,
    round(unnest([sum(q * q), sum(q * p), sum(q * d), sum(p * q), sum(p * p), sum(p * d), sum(d * q), sum(d * p), sum(d * d)]), 2) as v
    from (select l_quantity as q, l_extendedprice / 1000 as p, l_discount * 100 as d from lineitem)""", digits=2)
def matmul_tall(ws):
    """X.T @ X in long form over all rows of lineitem, numbered by file."""
    x = ws.lineitem.project(("l_quantity", "l_extendedprice", "l_discount")) * np.array([[1.0, 0.001, 100.0]])
    cells = long_form(x)
    return multiply_long(cells.select(sf.col("j").alias("i"), sf.col("i").alias("j"), "v"), cells)


@query("""select round(sum(o_totalprice * 1.0), 2) as total, round(sum(o_totalprice * o_custkey) / 1e6, 2) as by_customer
    from orders""", digits=2)
def matmul_two_frames(ws):
    """a.T @ b for frames of different tables, aligned by position."""
    a = ws._ones(ws.orders.numRows, "one")
    b = ws.orders.order("o_orderkey", unique=True).project(("o_totalprice", "o_custkey"))
    weighted = b.project(("o_totalprice",)).hstack([(b.project("o_totalprice") * b.project("o_custkey") / 1e6)
                                                    .project({"o_totalprice": "by_customer"})])
    return (a.T @ weighted).project(({"o_totalprice": "total"}, "by_customer"))


@query(f"select j::bigint as i, (row_number() over (partition by j order by vec_id) - 1) as j, v from {VECTORS}")
def transpose_long(ws):
    return vectors(ws).T.long()


@query("""select label, max(v) filter (p like '1%') as r_0000000000, max(v) filter (p like '2%') as r_0000000001,
    max(v) filter (p like '3%') as r_0000000002, max(v) filter (p like '4%') as r_0000000003,
    max(v) filter (p like '5%') as r_0000000004 from
    (select 'n' as label, o_orderpriority as p, count(*)::double as v from orders group by 2
     union all select 'total', o_orderpriority, round(sum(o_totalprice), 2) from orders group by 2) group by label""", digits=2)
def transpose_small_wide(ws):
    """Five summary rows of orders become five columns."""
    rows = ws.orders.agg(("o_orderpriority", {COUNT("*"): "n"}, {SUM("o_totalprice"): "total"}), "o_orderpriority")
    wide = rows.order("o_orderpriority", unique=True).project(("n", "total")).T.to_frame()
    label = sf.when(sf.col("__pos") == 0, "n").otherwise("total").alias("label")
    return wide.positions().select(label, *wide.cells)


@query("""select cast(p_partkey as double) as p_partkey, cast(p_size as double) as p_size, p_retailprice from part""")
def matrix_view(ws):
    return sizes(ws).to_matrix()


@query("""select round((avg(x.a) - 2) * 2, 4) as a, round(max(x.b), 4) as b, round(min(x.b), 4) as low from
    (select l_quantity as a, l_extendedprice / 1000 as b from lineitem) x""", digits=4)
def algebra_then_sql(ws):
    """Algebra feeds relational operators without leaving the plan."""
    x = ws.lineitem.project(({"l_quantity": "a"}, {"l_extendedprice": "b"})) * np.array([[1.0, 0.001]])
    return ((x.project("a") - 2) * 2).hstack([x.project("b")]).agg(({AVG("a"): "a"}, {MAX("b"): "b"}, {MIN("b"): "low"}))


def regression(ws):
    """Quantity, discount and ones of lineitem, and its price in thousands, over the same rows."""
    lines = ws.lineitem
    return (lines.project(({"l_quantity": "q"}, {"l_discount": "d"}, {F(C(1.0)): "one"})),
            lines.project({"l_extendedprice": "y"}) / 1000)


@query("""select unnest([0, 1, 2])::bigint as pos, unnest([round(0.5 - 1e-9 * sum(q * e), 6), round(2 - 1e-9 * sum(d * e), 6), round(1 - 1e-9 * sum(e), 6)]) as w
    from (select q, d, 0.5 * q + 2 * d + 1 - y as e from
    (select l_quantity as q, l_discount as d, l_extendedprice / 1000 as y from lineitem))""", digits=6)
def linreg_step(ws):
    """A step down the gradient of least squares: products and differences in one pass, and one aggregation."""
    x, y = regression(ws)
    w = np.array([[0.5], [2.0], [1.0]])
    slope = x.T @ (x @ w - y)
    return (slope * -1e-9 + w).project({next(iter(slope.cells)): "w"}).positions().withColumnRenamed("__pos", "pos")


@query("""select round(regr_slope(y, q), 6) as slope, round(regr_intercept(y, q), 6) as intercept, round(sum(pow(y - regr, 2)) / count(*), 5) as error from
    (select q, y, regr_slope(y, q) over () * q + regr_intercept(y, q) over () as regr from
    (select l_quantity as q, l_extendedprice / 1000 as y from lineitem))""", digits=6)
def linreg_normal(ws):
    """Normal equations: two small products of tall frames are solved, and the errors of all rows summed up."""
    x, y = regression(ws)
    x = x.project(("q", "one"))
    beta = np.linalg.solve((x.T @ x).matrix, (x.T @ y).matrix)
    rest = (y - x @ beta) ** 2
    slope, intercept = (float(b) for b in beta[:, 0])
    found = rest.agg({AVG(next(iter(rest.cells))): "error"}).project(({F(C(slope)): "slope"}, {F(C(intercept)): "intercept"}, "error"))
    return found.df.withColumn("error", sf.round("error", 5))
