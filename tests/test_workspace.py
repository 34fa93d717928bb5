import datetime

import numpy as np
import pytest

from tabframe import CMP, Frame, Q, Workspace
from tabframe.sources import MissingTableError, infer_datetimes
from tests.helpers import frame, placed, rows


@pytest.fixture
def ws(spark):
    return Workspace(spark, "/root/testdata/sf0.001")


def test_tables(ws):
    assert ws.nation is ws.nation
    assert ws.nation.shape == (25, 3)
    column = ws.nation.columns["n_name"]
    assert (column.tableName, column.type, column.pos) == ("nation", "string", 1)
    assert "lineitem" in [r[0] for r in ws._tables().collect()]
    with pytest.raises(KeyError):
        ws.nowhere
    assert not hasattr(ws, "nowhere")


def test_names(ws):
    ws.rich = ws.customer.filter(Q("c_acctbal", 9000, CMP.GT))
    ws["rich"] = ws.customer.filter(Q("c_acctbal", 9500, CMP.GT))
    assert ws.rich.numRows == ws._executeQry("select * from rich").numRows > 0
    with pytest.raises(TypeError):
        ws.nation = ws.rich
    del ws.rich
    with pytest.raises(MissingTableError):
        ws.rich
    with pytest.raises(AttributeError):
        ws._toTable(ws.nation.distinct())


def test_save_and_drop(spark, ws):
    regions = ws.region.project(("r_regionkey", "r_name"))
    saved = ws._saveTblrData(regions, "tabframe_test_regions", drop=True)
    assert rows(saved) == rows(regions)
    with pytest.raises(ValueError):
        ws._saveTblrData(regions, "tabframe_test_regions")
    with pytest.raises(TypeError):
        ws._saveTblrData(saved, "other")
    fewer = saved.filter(Q("r_regionkey", 2, CMP.LT))
    again = ws._saveTblrData(fewer, "tabframe_test_regions", drop=True)
    assert again.numRows == 2 and ws.tabframe_test_regions.numRows == 2
    assert placed(again[0])[0] == placed(again)[0]
    del ws.tabframe_test_regions
    with pytest.raises(MissingTableError):
        ws.tabframe_test_regions
    with pytest.raises(MissingTableError):
        del ws.tabframe_test_regions


def test_types_round_trip(spark, ws, tmp_path):
    moment = datetime.datetime(2020, 1, 2, 3, 4, 5)
    data = [(1, 2, 3, 4, 1.5, 2.5, "s", bytearray(b"b"), moment.date(), "03:04:05", moment), (None,) * 11]
    types = frame(spark, data, "i8 byte, i16 short, i32 int, i64 long, f32 float, f64 double, s string, b binary,"
                               " d date, tm string, ts timestamp_ntz")
    saved = ws._saveTblrData(types, "tabframe_test_types", drop=True, path=f"{tmp_path}/types")
    assert saved.schema == types.schema
    assert rows(saved.project(("i64", "f32", "d", "ts"))) == rows(types.project(("i64", "f32", "d", "ts")))
    ws._dropTable("tabframe_test_types")


def test_infer_datetimes(spark):
    texts = frame(spark, [("2020-01-02", "2020-01-02", "2020-01-02 03:04:05", "03:04:05", None),
                          (None, "later", "2021-02-03 00:00:00", "04:05:06", None)],
                  "a string, b string, c string, t string, e string")
    kinds = [f.dataType.simpleString() for f in infer_datetimes(texts).schema]
    assert kinds == ["date", "string", "timestamp_ntz", "string", "string"]


def test_generators(ws):
    assert placed(ws._ones(3)) == [(1.0,)] * 3
    assert list(ws._ones((2, 2)).cells) == ["_c0_", "_c1_"]
    assert list(ws._ones((2, 2), ["a", "b"]).cells) == ["a", "b"]
    with pytest.raises(TypeError):
        ws._ones((2, 2), ["a"])
    x = ws._rand((1000, 2), seed=4)
    assert placed(x) == placed(ws._rand((1000, 2), seed=4))
    data = np.array(placed(x))
    assert (data >= 0).all() and (data < 1).all() and abs(data.mean() - 0.5) < 0.05
    normal = np.array(placed(ws._randn((1000,))))
    assert abs(normal.mean()) < 0.2 and 0.8 < normal.std() < 1.2


def test_loaders(spark, ws, tmp_path):
    def squares(part, power):
        for low in range(part["low"], part["high"], 2):
            n = np.arange(low, min(low + 2, part["high"]))
            yield {"n": n, "p": n ** power}

    parts = [{"low": 0, "high": 5}, {"low": 5, "high": 8}]
    loaded = ws._L(squares, 2, parts=parts, schema="n long, p long")
    assert rows(loaded) == [(n, n * n) for n in range(8)]
    with pytest.raises(TypeError):
        ws._L(squares)
    for fmt in ("csv", "json", "orc", "parquet"):
        ws.nation.df.write.format(fmt).save(f"{tmp_path}/{fmt}")
        read = ws.read(fmt, f"{tmp_path}/{fmt}", schema=None if fmt in ("orc", "parquet") else ws.nation.schema)
        assert rows(read.project(("n_nationkey", "n_name"))) == rows(ws.nation.project(("n_nationkey", "n_name")))


def test_filters_leave_parts_unread(spark, ws, tmp_path):
    def numbers(part):
        (tmp_path / f"read{part}").touch()
        n = np.arange(part * 10, part * 10 + 10)
        return np.column_stack([n, n / 2]), ["n", "half"]

    def read(*conditions):
        for mark in tmp_path.glob("read*"):
            mark.unlink()
        loaded = ws._L(numbers, parts=range(5), schema="n long, half double", within=lambda part: {"n": (part * 10, part * 10 + 9)})
        return len(rows(loaded.filter(*conditions))), sorted(int(m.name[4:]) for m in tmp_path.glob("read*"))

    assert read(Q("n", 25, CMP.GTE), Q("n", 31, CMP.LT)) == (6, [2, 3])
    assert read(Q("n", 17)) == (1, [1]) and read(Q("n", 1000, CMP.GT)) == (0, [])
    assert read(Q("n", [3, 44], CMP.IN)) == (2, [0, 4])
    assert read(Q("half", 20.0, CMP.GTE)) == (10, [0, 1, 2, 3, 4])  # nothing is known of this column
    assert ws._L(numbers, parts=[], schema="n long, half double").numRows == 0


def test_materialize_and_fetch(spark, ws):
    for keep in ("cache", "durable"):
        kept = ws.orders.order("o_orderkey", unique=True).loadData(keep=keep)
        assert placed(kept[:2].project("o_orderkey")) == [(0,), (1,)]
        assert kept.isCached == (keep == "cache")
    numbers = ws.part.project(("p_size",)).loadData(matrix=True)
    assert numbers.schema[0].dataType.simpleString() == "double"
    assert ws.nation.cdata.num_rows == 25
    spark.conf.set("spark.tabframe.fetchRows", "10")
    with pytest.raises(ValueError):
        ws.nation.cdata
    spark.conf.unset("spark.tabframe.fetchRows")


def test_long_fetch_is_in_order(spark, ws):
    dear = ws.orders.order(["o_totalprice#desc", "o_orderkey"], unique=True).project(("o_orderkey", "o_totalprice"))
    want = sorted((tuple(r) for r in dear.df.collect()), key=lambda r: (-r[1], r[0]))
    whole = lambda t: list(zip(*(c.to_pylist() for c in t.columns)))
    assert whole(dear.cdata) == want
    spark.conf.set("spark.tabframe.topRows", "100")
    spark.conf.set("spark.tabframe.rowsPerBucket", "300")
    assert whole(dear.cdata) == want
    parts = list(dear.fetch(400))
    assert [p.num_rows for p in parts] == [400] * (len(want) // 400) + [len(want) % 400] * bool(len(want) % 400)
    assert [r for p in parts for r in whole(p)] == want
    spark.conf.set("spark.tabframe.fetchRows", "200")
    with pytest.raises(ValueError, match="fetch"):
        dear.cdata
    for name in ("topRows", "rowsPerBucket", "fetchRows"):
        spark.conf.unset(f"spark.tabframe.{name}")
    assert ws.nation.filter(Q("n_nationkey", 99)).order("n_nationkey").cdata.num_rows == 0


def test_sql_result_is_a_frame(ws):
    assert isinstance(ws._executeQry("select n_name from nation"), Frame)
    with pytest.raises(NotImplementedError):
        ws._executeQry("select 1", resultFormat="row")


def test_stateless_operators_take_streams(spark, ws, tmp_path):
    stream = spark.readStream.schema(ws.orders.schema).parquet("/root/testdata/sf0.001/orders.parquet*")
    dear = Frame.of(stream).filter(Q("o_totalprice", 400000, CMP.GT)).project(("o_orderkey", "o_totalprice"))
    query = (dear.df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
             .trigger(availableNow=True).start(f"{tmp_path}/out"))
    query.awaitTermination(60)
    want = ws.orders.filter(Q("o_totalprice", 400000, CMP.GT)).project(("o_orderkey", "o_totalprice"))
    assert rows(ws.read("parquet", f"{tmp_path}/out")) == rows(want)


def test_names_in_sql(spark, ws):
    ws.rich = ws.customer.filter(Q("c_acctbal", 9000, CMP.GT))
    n = ws.rich.numRows
    count = lambda sql: ws._executeQry(sql).df.first()[0]
    assert count("SELECT COUNT(*) FROM RICH") == count("-- all\n/* of */ select count(*) from `Rich`") == n
    assert count("select count(*) from (select * from Customer where c_acctbal > 9000)") == n
    assert count("with poor as (select * from customer where c_acctbal <= 9000) select (select count(*) from customer) - count(*) from poor") == n
    assert count("with rich as (select 1 as one) select count(*) from rich") == 1  # the query's own name
    assert count("select count(*) from customer where c_custkey in (select c_custkey from RICH)") == n
    assert count("select count(*) from nation where n_name <> 'from rich select'") == 25
    wide = ", ".join(f"{i} as c{i}" for i in range(60))
    assert count(f"select {wide}, (select count(*) from rich) as m".replace("0 as c0,", "(select count(*) from rich) as c0,", 1)) == n
    assert [t.name for t in spark.catalog.listTables() if t.name.lower() == "rich"] == []


def test_workspaces_have_names_of_their_own(spark, ws):
    other = Workspace(spark, "/root/testdata/sf0.001")
    ws.some, other.some = ws.nation.filter(Q("n_regionkey", 1)), ws.nation.filter(Q("n_regionkey", 1, CMP.NE))
    mine, theirs = (w._executeQry("select count(*) as n from some") for w in (ws, other))
    assert (mine.df.first().n, theirs.df.first().n) == (5, 20)
    del ws.some
    with pytest.raises(Exception, match="some"):
        ws._executeQry("select * from some")
    assert other._executeQry("select count(*) as n from some").df.first().n == 20


def test_values(spark, ws):
    ws.k, ws.name, ws.day, ws.none = 5, "o'x", datetime.date(1996, 1, 1), None
    ws.size = np.float64(2.5)
    assert (ws.k, ws.name) == (5, "o'x")
    row = ws._executeQry("select :k as a, k + 1 as b, K as c, :name as d, name as e, :day as f, none is null as g, size * 2 as h").df.first()
    assert tuple(row) == (5, 6, 5, "o'x", "o'x", datetime.date(1996, 1, 1), True, 5.0)
    few = ws._executeQry("select n_name from nation where n_nationkey < k")
    ws.k = 7
    assert few.numRows == 5 and ws._executeQry("select n_name from nation where n_nationkey < k").numRows == 7
    hidden = ws._executeQry("select k from (select 1 as k)")  # a column comes first
    assert rows(hidden) == [(1,)]
    del ws.k
    with pytest.raises(Exception, match="k"):
        ws._executeQry("select k")
    with pytest.raises(Exception, match="k"):
        ws._executeQry("select :k")
    other = Workspace(spark, "/root/testdata/sf0.001")
    with pytest.raises(KeyError):
        other.name
    ws.anything = {"a": [1, 2]}
    assert ws.anything == {"a": [1, 2]}


def test_kinds_of_names_are_not_mixed(ws):
    ws.k, ws.f = 5, ws.nation.filter(Q("n_regionkey", 1))
    for name, value in (("k", ws.f), ("f", 5), ("nation", 5)):
        with pytest.raises(TypeError):
            setattr(ws, name, value)


def test_saving_with_a_path(spark, ws, tmp_path):
    path = f"{tmp_path}/kept"
    saved = ws._saveTblrData(ws.nation.project(("n_nationkey", "n_name")), "tabframe_test_path", drop=True, path=path)
    assert saved.numRows == 25
    again = ws._saveTblrData(saved.filter(Q("n_nationkey", 5, CMP.LT)), "tabframe_test_path", drop=True, path=path)  # reads itself
    assert again.numRows == 5 and ws.tabframe_test_path.numRows == 5

    def breaks(batch):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        ws._saveTblrData(ws.nation._U(breaks, schema="x long"), "tabframe_test_path", drop=True, path=path)
    assert Workspace(spark).tabframe_test_path.numRows == 5
    assert rows(ws._executeQry("select count(*) as n from tabframe_test_path")) == [(5,)]
    ws._dropTable("tabframe_test_path")


@pytest.mark.parametrize("kept", [True, False])
def test_savers_of_one_name(spark, ws, tmp_path, kept):
    import threading

    failed = []

    def save(n):
        try:
            frame = ws.nation.filter(Q("n_nationkey", n, CMP.LT)).project("n_nationkey")
            Workspace(spark)._saveTblrData(frame, "tabframe_test_race", drop=True, path=f"{tmp_path}/race" if kept else None)
        except Exception as error:  # the name may be taken between dropping and naming
            failed.append(error)

    savers = [threading.Thread(target=save, args=(n,)) for n in (3, 9)]
    for saver in savers:
        saver.start()
    for saver in savers:
        saver.join()
    assert len(failed) <= 1 and Workspace(spark).tabframe_test_race.numRows in (3, 9)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tabframe_test_race_")]
    ws._dropTable("tabframe_test_race")
