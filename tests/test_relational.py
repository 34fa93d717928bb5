import random

import pytest
from pyspark.sql import functions as sf

from tabframe import AVG, COL, COUNT, JOIN, MAX, MIN, SUM, C, CMP, Frame, Q, F
from tabframe.plans import skew
from tests.helpers import frame, ordered, rows


@pytest.fixture(scope="module")
def left(spark):
    return frame(spark, [(1, "a", 1.0), (2, "b", 2.0), (2, "c", 3.0), (None, "d", 4.0), (5, "e", 5.0)],
                 "k int, s string, v double")


@pytest.fixture(scope="module")
def right(spark):
    return frame(spark, [(1, "a", 10.0), (2, "b", 20.0), (2, "z", 30.0), (None, "d", 40.0), (7, "q", 50.0)],
                 "k int, t string, w double")


def pairs(kind):
    """Expected (v, w) pairs of a join on k."""
    inner = [(1.0, 10.0), (2.0, 20.0), (2.0, 30.0), (3.0, 20.0), (3.0, 30.0)]
    left_only = [(4.0, None), (5.0, None)]
    right_only = [(None, 40.0), (None, 50.0)]
    return sorted({
        JOIN.INNER: inner, JOIN.LEFT: inner + left_only, JOIN.RIGHT: inner + right_only,
        JOIN.OUTER: inner + left_only + right_only,
    }[kind], key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("kind", [JOIN.INNER, JOIN.LEFT, JOIN.RIGHT, JOIN.OUTER])
@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_joins(spark, left, right, kind, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        assert rows(left.join(right, "k", "k", ("v",), ("w",), kind)) == pairs(kind)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_projection(left, right):
    both = left.join(right, ["k", "s"], ("k", "t"), COL.ALL, ({"k": "k2"}, "w"))
    assert list(both.cells) == ["k", "s", "v", "k2", "w"]
    assert rows(both) == [(1, "a", 1.0, 1, 10.0), (2, "b", 2.0, 2, 20.0)]
    with pytest.raises(ValueError):
        left.join(right, "k", "k", ("k",), ("k",))
    with pytest.raises(AttributeError):
        left.join(right, ["k", "s"], ["k"])
    with pytest.raises(AttributeError):
        left.join(right, "k", "k", ("nothing",), ())


def test_cross_and_self_join(left):
    assert len(rows(left.join(left, None, None, ("v",), ({"v": "u"},), JOIN.CROSS_JOIN))) == 25
    assert len(rows(left.join(left, "k", "k", ("v",), ({"v": "u"},)))) == 6


def test_join_spellings():
    assert JOIN.FULL_OUTER_JOIN is JOIN.OUTER and JOIN.JOIN is JOIN.INNER
    assert JOIN.LEFT_OUTER is JOIN.LEFT and CMP.GREATERTHAN is CMP.GT and CMP.NL is CMP.NULL


def test_aggregate(left):
    got = left.aggregate(("k", COUNT("*"), {SUM("v"): "total"}, AVG("v"), MIN("s"), MAX("s")), "k")
    assert list(got.cells) == ["k", "count_", "total", "avg_v", "min_s", "max_s"]
    assert rows(got) == [(None, 1, 4.0, 4.0, "d", "d"), (1, 1, 1.0, 1.0, "a", "a"),
                         (2, 2, 5.0, 2.5, "b", "c"), (5, 1, 5.0, 5.0, "e", "e")]
    assert rows(left.agg(({COUNT("k"): "a"}, {COUNT("k", distinct=True): "b"}))) == [(4, 3)]
    assert rows(left.agg("k", "k")) == [(None,), (1,), (2,), (5,)]
    with pytest.raises(AttributeError):
        left.agg(("s", COUNT("*")), "k")


def test_distinct_aggregates(spark):
    t = frame(spark, [(1, 2), (1, 2), (1, 5), (2, None)], "g int, x int")
    got = t.agg(("g", {SUM("x", distinct=True): "s"}, {AVG("x", distinct=True): "a"},
                 {COUNT("*", distinct=True): "n"}), "g")
    assert rows(got) == [(1, 7, 3.5, 3), (2, None, None, 1)]


def test_empty_input(left):
    nothing = left.filter(Q("v", 100, CMP.GT))
    assert rows(nothing.agg((COUNT("*"), SUM("v")))) == [(0, None)]
    assert rows(nothing.agg(("k", COUNT("*")), "k")) == []
    assert nothing.shape == (0, 3)


def test_order_head_tail(left):
    up = left.order(["k#desc", "v"])
    assert [r[2] for r in ordered(up)] == [5.0, 2.0, 3.0, 1.0, 4.0]
    assert list(up.head(2)["v"]) == [5.0, 2.0]
    assert list(up.tail(2)["v"]) == [1.0, 4.0]
    assert [r[2] for r in ordered(left.order("k").order("v#desc"))] == [5.0, 4.0, 3.0, 2.0, 1.0]
    assert [r[0] for r in ordered(left.order("v#desc").project("s").top(2))] == ["e", "d"]
    with pytest.raises(ValueError):
        left.order("k#sideways")


def test_average_of_large_distinct_numbers(spark):
    t = frame(spark, [(2**62,), (2**62 + 2,), (2**62 + 2,), (2**62 + 4,), (None,)], "x long")
    assert rows(t.agg(({AVG("x", distinct=True): "a"}, {AVG("x"): "b"}))) == [(float(2**62 + 2), float(2**62 + 2))]
    assert rows(frame(spark, [(0.5,), (0.5,), (1.0,)], "x double").agg({AVG("x", distinct=True): "a"})) == [(0.75,)]


def test_distinct(spark):
    assert rows(frame(spark, [(1, None), (1, None), (2, 3)], "a int, b int").distinct()) == [(1, None), (2, 3)]


def test_having_and_expression_groups(left):
    halves = left.project(({F("v") / 2: "h"}, "k")).agg(("k", {SUM("h"): "h"}), "k").filter(Q("h", 2, CMP.GT))
    assert rows(halves) == [(2, 2.5), (5, 2.5)]
    assert rows(left.filter(Q("s", C("e"))).project("v")) == [(5.0,)]


@pytest.fixture
def skewed(spark):
    """Full joins look for frequent keys in these tests, however small the tables."""
    spark.conf.set("spark.tabframe.skewBytes", "0")
    spark.conf.set("spark.tabframe.skewRows", "20")
    yield
    spark.conf.unset("spark.tabframe.skewBytes")
    spark.conf.unset("spark.tabframe.skewRows")


@pytest.mark.parametrize("hot", [("l",), ("r",), ("l", "r"), ()])
def test_full_join_with_frequent_keys(spark, skewed, hot):
    sides = {}
    for side in "lr":
        keys = [i % 37 for i in range(60)] + [None] * 30 + [100 if side == "l" else 200] * 3
        keys += ([7] * 90 + [300 if side == "l" else 400] * 50) if side in hot else []
        sides[side] = [(k, i % 2, f"{side}{i}") for i, k in enumerate(keys)]
    left, right = (frame(spark, sides[s], f"{s}k long, {s}b int, {s}v string") for s in "lr")
    for f in (left, right):
        f.rowset.df = f.rowset.df.repartition(5)
    got = left.join(right, ["lk", "lb"], ["rk", "rb"], COL.ALL, COL.ALL, JOIN.OUTER)
    want = []
    for x in sides["l"]:
        match = [y for y in sides["r"] if x[0] is not None and x[:2] == y[:2]]
        want += [x + y for y in match] or [(*x, None, None, None)]
    want += [(None, None, None, *y) for y in sides["r"] if y[0] is None or not any(x[:2] == y[:2] for x in sides["l"])]
    assert rows(got) == sorted(want, key=lambda r: tuple((v is not None, v) for v in r))


def test_full_join_reads_each_input_once(spark, skewed):
    """A column that differs at every reading is the same in all rows that come from one row."""
    left = frame(spark, [(i % 5,) for i in range(100)], "k long")
    left = Frame.of(left.unsorted().select("k", sf.monotonically_increasing_id().alias("id"), sf.rand().alias("x")))
    right = frame(spark, [(i,) for i in (0, 0, 1, 9)], "k2 long")
    got = left.join(right, "k", "k2", COL.ALL, COL.ALL, JOIN.OUTER).df.collect()
    values = {}
    for r in got:
        values.setdefault(r.id, set()).add(r.x)
    assert len(got) == 20 * 2 + 20 + 60 + 1 and all(len(v) == 1 for v in values.values())


def test_frequent_keys(spark):
    rng = random.Random(2)
    keys = [("a", 1)] * 400 + [("b", None)] * 300 + [("c", 2)] * 200 + [(f"k{rng.randrange(500)}", 0) for _ in range(600)]
    rng.shuffle(keys)
    table = spark.createDataFrame(keys, "x string, y int").repartition(7)
    total, found = skew.frequent(table, ["x", "y"])
    assert total == 1200 and 0 < found["a", 1] <= 400 and 0 < found["c", 2] <= 200 and ("b", None) not in found
    few = skew.compressed({"a": 9, "b": 5, "c": 5, "d": 1}, 2)
    assert few == {"a": 4}
