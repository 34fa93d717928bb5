import math

import numpy as np
import pytest

from tabframe import C, CMP, Q
from tabframe.plans import quantiles
from tests.helpers import frame, ordered

LONG = "a longer text than twenty characters"


@pytest.fixture(scope="module")
def small(spark):
    return frame(spark, [(1, "a"), (2, "b"), (None, "a"), (4, None), (10, LONG)],
                 "n int, s string")


def test_summaries(small):
    assert small.sum("n").value() == 17
    assert small.sum().value() == {"n": 17, "s": None}
    assert small.avg(["n"]).value() == 4.25
    assert small.count().value() == {"n": 4, "s": 4}
    assert small.countd().value() == {"n": 4, "s": 3}
    assert small.countn().value() == {"n": 1, "s": 1}
    assert small.max("s").value() == "b"
    assert small.min("n").value() == 1
    assert small.countd("n", approximate=True).value() == 4
    with pytest.raises(AttributeError):
        small.sum("nothing")


def test_describe(spark, small):
    expected = {"count": 4, "unique": 4, "nulls": 1, "max": 10, "min": 1, "avg": 4.25,
                "median": 3, "25%": 1.75, "50%": 3, "75%": 5.5, "stddev": 3.491060010942235}
    for limit in ("100", "2"):
        spark.conf.set("spark.tabframe.exactQuantileRows", limit)
        got = {metric: (n, s) for metric, n, s in ordered(small.describe().order("metric"))}
        assert {metric: n for metric, (n, _) in got.items()} == pytest.approx(expected)
        assert got["max"][1] == "b" and got["avg"][1] is None
        assert small.project("s").filter(Q("s", C("a l%"), CMP.LIKE)).describe().df.where("metric = 'max'").first()[1] == LONG
    spark.conf.unset("spark.tabframe.exactQuantileRows")
    assert [r[1] for r in sorted(map(tuple, small.describe().positions().collect()))][:2] == ["count", "unique"]


def test_describe_large_and_small_numbers(spark):
    got = dict(ordered(frame(spark, [(1e300,), (0.001,)], "v double").describe().order("metric")))
    assert got["max"] == 1e300 and got["min"] == 0.001


@pytest.mark.parametrize("most", [128, 2])
def test_exact_quantiles(spark, most, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST", most)
    rng = np.random.default_rng(3)
    hot = np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000))
    table = frame(spark, [(float(v), None if i % 3 else i, None) for i, v in enumerate(hot)],
                  "v double, w int, e double")
    points = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = ordered(table.quantiles(points, ["v", "w", "e"]))
    assert [g[0] for g in got] == points
    for p, v, w, e in got:
        assert v == pytest.approx(np.quantile(hot, p), abs=1e-12)
        assert w == pytest.approx(np.quantile(np.arange(0, 3000, 3), p))
        assert e is None


@pytest.mark.parametrize("values", [
    [5.0] * 900, [float(i) for i in range(1000)], [-1e300, -0.0, 0.0, 5e-324, 1e-300, -5e-324, 1e300, 3.0], [float("inf"), -float("inf"), 2.0, 1.0],
    [float(2**53 + 2 * i) for i in range(7)], [1.0], [2.5, 2.5, -2.5],
])
def test_selection_settles_every_bit(spark, values):
    table = frame(spark, [(v,) for v in values], "v double")
    table.rowset.df = table.rowset.df.repartition(5)
    ranks = [i / (len(values) - 1) if len(values) > 1 else 0.0 for i in range(0, len(values), max(1, len(values) // 7))]
    got = [r[1] for r in ordered(table.quantiles(ranks, ["v"]))]
    assert got == [sorted(values)[math.floor((len(values) - 1) * p)] for p in ranks] or got == pytest.approx(np.quantile(values, ranks))


def test_nan_is_largest_and_nothing_is_null(spark):
    nan = float("nan")
    table = frame(spark, [(nan,), (1.0,), (None,), (2.0,)], "v double")
    low, high = ordered(table.quantiles([0.0, 1.0]))
    assert low == (0.0, 1.0) and high[1] != high[1]
    assert ordered(frame(spark, [], "v double").quantiles([0.5])) == [(0.5, None)]


def test_bits_are_in_order():
    values = np.array([-np.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan])
    bits = quantiles.ordered_bits(values)
    assert (np.diff(bits.astype(object)) > 0).all() and [quantiles.from_bits(int(b)) for b in bits[:-1]] == values[:-1].tolist()
