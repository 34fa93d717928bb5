"""User functions, loading and names for results."""

import uuid

import numpy as np
import pyarrow.fs
from pyspark.sql import functions as sf

from tabframe import AVG, CMP, COUNT, F, Frame, MAX, Q, SUM
from tabframe.plans.durable import shared_folder
from workload.algebra import VECTORS, vectors
from workload.registry import query


@query("""select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net,
    l_quantity > 25 as large from lineitem""", digits=4)
def udf_table(ws):
    """A function over batches returning a dict of arrays."""

    def net_price(batch):
        rows = batch.rows
        return {"l_orderkey": rows["l_orderkey"], "l_linenumber": rows["l_linenumber"],
                "net": rows["l_extendedprice"] * (1 - rows["l_discount"]), "large": rows["l_quantity"] > 25}

    needed = ws.lineitem.project(("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"))
    return needed._U(net_price, schema="l_orderkey bigint, l_linenumber int, net double, large boolean")


@query("""select count(*) as n, round(sum(v), 4) as s, round(max(v), 4) as m from
    (select l_quantity * 2 + 1 as v from lineitem) where v > 50""", digits=4)
def udf_then_sql(ws):
    """A function returning (matrix, names), filtered and aggregated afterwards."""

    def scale(batch, factor):
        return batch.matrix * factor + 1, ["v"]

    scaled = ws.lineitem.project("l_quantity")._U(scale, 2.0, schema="v double")
    return scaled.filter(Q("v", 50, CMP.GT)).agg(({COUNT("*"): "n"}, {SUM("v"): "s"}, {MAX("v"): "m"}))


@query("select o_orderstatus, round(avg(o_totalprice), 4) as avg_o_totalprice from orders group by 1", digits=4)
def udf_plan(ws):
    """A function of the whole frame that adds to the plan."""
    return ws.orders._U(lambda frame: frame.agg(("o_orderstatus", AVG("o_totalprice")), "o_orderstatus"))


@query("""select event_type, count(*) as n, round(avg(value), 6) as mean, round(var_pop(value), 6) as spread
    from events group by event_type""", digits=6)
def udf_groups(ws):
    """Mean and variance by folding partial states of every group."""

    def partial(batch):
        x = batch.rows["value"]
        return {"n": len(x), "mean": x.mean(), "m2": ((x - x.mean()) ** 2).sum()}

    def merge(states):
        rows = states.rows
        n, mean, m2 = rows["n"], rows["mean"], rows["m2"]
        middle = (n * mean).sum() / n.sum()
        return {"n": n.sum(), "mean": middle, "m2": (m2 + n * (mean - middle) ** 2).sum()}

    def finish(state):
        return {"n": state["n"], "mean": state["mean"], "spread": state["m2"] / state["n"]}

    return ws.events.project(("event_type", "value")).fold_groups(
        "event_type", partial, merge, "n bigint, mean double, m2 double", finish,
        "n bigint, mean double, spread double")


@query("""select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total, max(o_totalprice) as most from orders group by 1""",
       digits=2)
def udf_groups_many(ws):
    """A state for every customer: as many groups as there are."""

    def partial(batch):
        x = batch.rows["o_totalprice"]
        return {"n": len(x), "total": x.sum(), "most": x.max()}

    def merge(states):
        rows = states.rows
        return {"n": rows["n"].sum(), "total": rows["total"].sum(), "most": rows["most"].max()}

    def finish(state):
        return {"n": state["n"], "total": round(state["total"], 2), "most": state["most"]}

    return ws.orders.project(("o_custkey", "o_totalprice")).fold_groups(
        "o_custkey", partial, merge, "n bigint, total double, most double", finish, "n bigint, total double, most double")


@query(f"""select round(sum(v * v), 5) as norm2, round(sum(v), 5) as total from {VECTORS} group by vec_id""", digits=5)
def udf_matrix(ws):
    """A function over n x 64 arrays."""

    def norms(matrix):
        return np.column_stack([(matrix ** 2).sum(axis=1), matrix.sum(axis=1)])

    return vectors(ws).map_matrix(norms, cols=["norm2", "total"])


@query("select s_suppkey * 2.0::double as s_suppkey, s_acctbal * 2.0::double as s_acctbal from supplier")
def udf_matrix_in_place(ws):
    return ws.supplier.project(("s_suppkey", "s_acctbal"))._XP(lambda matrix: matrix * 2)


def moments(batch):
    """Rows, means and sums of squared distances from them, of every column."""
    x = batch.matrix
    return len(x), x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), ((x - x.mean(axis=0)) ** 2).sum(axis=0) if len(x) else np.zeros(x.shape[1])


def moments_together(a, b):
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + step ** 2 * (a[0] * b[0] / n)


@query("""select l_orderkey::double as l_orderkey, round(l_quantity - avg(l_quantity) over (), 3) as l_quantity,
    round(l_extendedprice - avg(l_extendedprice) over (), 3) as l_extendedprice from lineitem""", digits=3)
def udf_matrix_centred(ws):
    """Columns less their means over the whole table, which are folded first."""
    x = ws.lineitem.project(("l_orderkey", "l_quantity", "l_extendedprice"))
    mean = x.fold(moments, moments_together, lambda s: s[1] * np.array([0, 1, 1]))
    return x._XP(lambda matrix, mean: matrix - mean, state=mean)


@query("""select l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) over ()) /
    stddev_pop(l_extendedprice) over (), 6) as z from lineitem""", digits=6)
def udf_standardise(ws):
    """A function over batches that is given the moments of the whole table."""
    needed = ws.lineitem.project(("l_orderkey", "l_linenumber", "l_extendedprice"))
    known = needed.project("l_extendedprice").fold(moments, moments_together, lambda s: (s[1][0], np.sqrt(s[2][0] / s[0])))

    def standardise(batch, state):
        rows = batch.rows
        return {"l_orderkey": rows["l_orderkey"], "l_linenumber": rows["l_linenumber"],
                "z": (rows["l_extendedprice"] - state[0]) / state[1]}

    return needed._U(standardise, schema="l_orderkey bigint, l_linenumber int, z double", state=known)


@query("""select o_orderkey, round((r1 + 1) * x + (2 * r1 - 1) * y, 6) as s1, round((r4 + 1) * x + (2 * r4 - 1) * y, 6) as s4,
    round(sqrt(x * x + y * y), 6) as norm from (select o_orderkey, o_totalprice / 1000 as x, o_custkey::double as y,
    (select r_regionkey from region order by 1 limit 1 offset 1) as r1, (select max(r_regionkey) from region) as r4 from orders)""",
       digits=6)
def xp_two_frames(ws):
    """Two matrices out of one pass over orders, beside a whole matrix made of the regions."""
    orders = ws.orders.unsorted().selectExpr("o_orderkey", "o_totalprice / 1000 as x", "cast(o_custkey as double) as y")
    weights = ws.region.order("r_regionkey", unique=True).project(({F("r_regionkey") + 1: "u"}, {F("r_regionkey") * 2 - 1: "w"}))

    def both(matrix, weights):
        return {"scores": (matrix @ weights.T)[:, [1, 4]], "norms": np.sqrt((matrix ** 2).sum(axis=1))}

    found = Frame.of(orders).map_matrices(both, [weights], {"scores": ["s1", "s4"], "norms": ["norm"]}, keep="o_orderkey")
    return found["scores"].join(found["norms"], "o_orderkey", "o_orderkey", ("o_orderkey", "s1", "s4"), ("norm",))


def orders_by_year(ws):
    """Orders written in a format of no reader's: lines of key and price, a folder for each year."""
    folder = f"{shared_folder(ws._spark).rstrip('/')}/orders-{uuid.uuid4().hex}"
    lines = ws.orders.unsorted().select(sf.year("o_orderdate").alias("year"), sf.concat_ws("|", "o_orderkey", "o_totalprice").alias("value"))
    lines.write.partitionBy("year").text(folder)
    return folder


def read_lines(part):
    """The lines of a year's files, a million bytes at a time."""
    files, folder = pyarrow.fs.FileSystem.from_uri(part["folder"]) if "://" in part["folder"] else (pyarrow.fs.LocalFileSystem(), part["folder"])
    for info in files.get_file_info(pyarrow.fs.FileSelector(folder)):
        if info.is_file and info.base_name.startswith("part-"):
            with files.open_input_stream(info.path) as stream:
                rest = b""
                while data := stream.read(1 << 20):
                    *lines, rest = (rest + data).split(b"\n")
                    if lines:
                        yield fields_of(lines, part["year"])
                if rest:
                    yield fields_of([rest], part["year"])


def fields_of(lines, year):
    keys, prices = zip(*(line.split(b"|") for line in lines))
    return {"o_orderkey": np.array(keys, np.int64), "o_totalprice": np.array(prices, np.float64), "year": np.full(len(lines), year)}


def loaded_orders(ws):
    folder = orders_by_year(ws)
    years = [r.y for r in ws.orders.unsorted().select(sf.year("o_orderdate").alias("y")).distinct().collect()]  # a row a year
    parts = [{"folder": f"{folder}/year={y}", "year": y} for y in sorted(years)]
    return ws._L(read_lines, parts=parts, schema="o_orderkey bigint, o_totalprice double, year int",
                 within=lambda part: {"year": (part["year"], part["year"])})


@query("select o_orderkey, o_totalprice from orders")
def load_partitioned(ws):
    """An outside loader called once per year of orders, on the executors."""
    return loaded_orders(ws).project(("o_orderkey", "o_totalprice"))


@query("""select year(o_orderdate) as year, count(*) as n, round(sum(o_totalprice), 2) as total from orders
    where year(o_orderdate) between 1996 and 1997 and o_totalprice > 100000 group by 1""", digits=2)
def load_source(ws):
    """The same loader below a filter, which leaves two of its parts to be read."""
    wanted = loaded_orders(ws).filter(Q("year", 1996, CMP.GTE), Q("year", 1997, CMP.LTE), Q("o_totalprice", 100000, CMP.GT))
    return wanted.agg(("year", {COUNT("*"): "n"}, {SUM("o_totalprice"): "total"}), "year")


@query("select c_custkey, c_name from customer")
def read_files(ws):
    """A Spark reader by format name."""
    return ws.read("parquet", f"{ws._path}/customer.parquet").project(("c_custkey", "c_name"))
