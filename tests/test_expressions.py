import datetime
import itertools

import numpy as np
import pytest

from tabframe import C, CASE, CMP, DATE, EXTRACT, F, Q, SUBSTRING
from tests.helpers import frame, rows


@pytest.fixture(scope="module")
def nulls(spark):
    return frame(spark, [(1, 5, "ab"), (2, None, "cd"), (3, 7, None), (4, 5, "a'b"), (4, 5, "a'b")],
                 "k int, x int, s string")


def keys(result):
    return [r[0] for r in rows(result.project("k"))]


@pytest.mark.parametrize("predicate, expected", [
    (Q("x", 5), [1, 4, 4]),
    (Q("x", np.int64(5), CMP.NE), [3]),
    (Q("x", 5, CMP.GREATERTHAN), [3]),
    (Q("x", 5.0, CMP.GTE), [1, 3, 4, 4]),
    (Q("x", "k", CMP.LT), []),
    (Q("x", "k", CMP.LESSTHANOREQUAL), []),
    (Q("x", operator=CMP.NULL), [2]),
    (Q("x", operator=CMP.NOTNULL), [1, 3, 4, 4]),
    (~Q("x", 5), [3]),
    (Q("x", 5) | Q("s", C("cd")), [1, 2, 4, 4]),
    (Q("x", 5) & Q("k", 1), [1]),
    (Q("x", (5, 9), CMP.IN), [1, 4, 4]),
    (Q("x", (5, 9), CMP.NOTIN), [3]),
    (Q("s", C("a'b")), [4, 4]),
    (Q("s", C("a%"), CMP.LIKE), [1, 4, 4]),
    (Q("s", C("a_"), CMP.NOTLIKE), [2, 4, 4]),
    (Q((Q("x") * 2 - 1) / 3, -Q("k") + 8, CMP.EQ), []),
    (Q(10 - Q("x"), 5), [1, 4, 4]),
    (Q(35 / Q("x"), 7), [1, 4, 4]),
    (Q(1 + Q("x"), 2 * Q("k"), CMP.GT), [1, 3]),
])
def test_predicates(nulls, predicate, expected):
    assert keys(nulls.filter(predicate)) == expected


def test_filter_is_a_conjunction_and_checks_names(nulls):
    assert keys(nulls.filter(Q("x", 5), Q("k", 2, CMP.GT))) == [4, 4]
    with pytest.raises(AttributeError):
        nulls.filter(Q("missing", 1))
    with pytest.raises(TypeError):
        Q("x", 5) & "k"
    with pytest.raises(TypeError):
        nulls.filter(Q("x", True))


def test_date(spark):
    days = frame(spark, [(1, datetime.date(2020, 1, 31)), (2, datetime.date(2021, 12, 5))], "k int, d date")
    assert keys(days.filter(Q("d", DATE("2020-06-01"), CMP.GT))) == [2]
    parts = days.project(tuple({EXTRACT("d", op): op.value} for op in (F.OP.YEAR, F.OP.MONTH, F.OP.DAY)))
    assert rows(parts) == [(2020, 1, 31), (2021, 12, 5)]
    with pytest.raises(ValueError):
        DATE("31/01/2020")


def test_projection(nulls):
    got = nulls.project(({F("x") + 1: "y"}, F("k") * 2, {F(C("t'")): "t"}, {F(C(None)): "n"}, F(C(3))))
    assert list(got.cells) == ["y", "k", "t", "n", "col_4"]
    assert rows(got)[0] == (None, 4, "t'", None, 3)
    with pytest.raises(ValueError):
        nulls.project(("k", {"x": "k"}))
    with pytest.raises(AttributeError):
        nulls.project("nothing")


def test_substring(spark):
    words = frame(spark, [("hello",), (None,)], "s string")
    got = words.project(({SUBSTRING("s", 2, 3): "a"}, {SUBSTRING("s", 3): "b"}, {SUBSTRING("s", 1, 0): "c"}))
    assert rows(got) == [(None, None, None), ("ell", "llo", "hello")]


def test_case(spark):
    numbers = frame(spark, [(1,), (5,), (9,)], "x int")
    zero = CASE(((Q("x", 4, CMP.GT), "x"),), 0)
    missing = CASE(((Q("x", 8, CMP.GT), C(1)), (Q("x", 4, CMP.GT), F("x") * 2)))
    got = numbers.project(({zero: "zero"}, {missing: "missing"}))
    assert rows(got) == [(0, None), (5, 10), (9, 1)]
    assert list(numbers.project(missing).cells) == ["case_x"]


SETS = {"empty": [], "plain": [1, 3], "null": [1, None], "only null": [None]}
PLAIN = {"GT": lambda a, b: a > b, "GTE": lambda a, b: a >= b, "LT": lambda a, b: a < b, "LTE": lambda a, b: a <= b}


def three_valued(results, quantifier):
    results = list(results)
    decisive, rest = (False, True) if quantifier == "ALL" else (True, False)
    if decisive in results:
        return decisive
    return None if None in results else rest


def outcomes(probe, test):
    """x -> True, False or None, the three-valued outcome of a test."""
    seen = CASE(((test, C(True)), (~test, C(False))))
    return dict(rows(probe.project(("x", {seen: "seen"}))))


@pytest.mark.parametrize("quantifier, name", list(itertools.product(("ALL", "ANY"), PLAIN)))
def test_quantified_truth_table(spark, quantifier, name):
    probe = frame(spark, [(0,), (1,), (2,), (4,), (None,)], "x int")
    for values in SETS.values():
        sub = frame(spark, [(v,) for v in values], "y int")
        got = outcomes(probe, Q("x", sub, CMP[name + quantifier]))
        assert got == {
            x: three_valued((None if x is None or v is None else PLAIN[name](x, v) for v in values), quantifier)
            for x in (0, 1, 2, 4, None)
        }


@pytest.mark.parametrize("values", SETS.values(), ids=SETS)
def test_membership_truth_table(spark, values):
    probe = frame(spark, [(1,), (2,), (None,)], "x int")
    sub = frame(spark, [(v,) for v in values], "y int")
    want = {x: three_valued((None if x is None or v is None else x == v for v in values), "ANY")
            for x in (1, 2, None)}
    assert outcomes(probe, Q("x", sub, CMP.IN)) == want
    # As whole conditions of a filter these are semi and anti joins.
    for test, wanted in ((Q("x", sub, CMP.IN), True), (~Q("x", sub, CMP.IN), False), (Q("x", sub, CMP.NOTIN), False)):
        assert rows(probe.filter(test)) == [(x,) for x in (None, 1, 2) if want[x] is wanted]


def test_exists(spark):
    outer = frame(spark, [(1, "a"), (2, "b"), (None, "c")], "k int, s string")
    inner = frame(spark, [(1, "a"), (1, "a"), (2, "x"), (None, "c")], "j int, t string")
    both = [("k", "j"), ("s", "t")]
    assert rows(outer.filter(Q(both, inner, CMP.EXISTS))) == [(1, "a")]
    assert rows(outer.filter(Q(both, inner, CMP.NOTEXISTS))) == [(None, "c"), (2, "b")]
    assert rows(outer.filter(Q("k", 2) | Q(both, inner, CMP.EXISTS))) == [(1, "a"), (2, "b")]
    assert len(rows(outer.filter(Q(None, inner, CMP.EXISTS)))) == 3
    assert rows(outer.filter(~Q(None, inner, CMP.EXISTS))) == []


def test_scalar_subquery_needs_one_row(spark):
    t = frame(spark, [(1,), (2,), (3,)], "x int")
    assert rows(t.filter(Q("x", t.max("x"), CMP.LT))) == [(1,), (2,)]
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        rows(t.filter(Q("x", t)))
    with pytest.raises(TypeError):
        t.filter(Q("x", t.project(("x", {"x": "y"}))))
