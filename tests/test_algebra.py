import numpy as np
import pytest

from tabframe import CMP, Frame, Q, multiply_long
from tabframe.operators.matrix import long_form
from tabframe.operators.positional import array_frame
from tests.helpers import frame, placed, rows

INF, NAN = float("inf"), float("nan")
RNG = np.random.default_rng(5)
A, B = RNG.normal(size=(9, 3)).round(3), RNG.normal(size=(9, 3)).round(3)


def values(x):
    x = x.to_frame() if hasattr(x, "to_frame") else x
    return np.array(placed(x), dtype=float)


@pytest.fixture
def a(spark):
    return array_frame(spark, A, ["x", "y", "z"])


@pytest.fixture
def b(spark):
    """The second matrix as stored rows whose order is given by a key column."""
    data = [(i, *map(float, row)) for i, row in enumerate(B)]
    stored = frame(spark, data[::-1], "k int, p double, q double, r double")
    return stored.order("k", unique=True).project(("p", "q", "r"))


@pytest.mark.parametrize("build", [
    lambda x: x + 2, lambda x: 2 + x, lambda x: x - 1.5, lambda x: 1.5 - x, lambda x: x * 3, lambda x: 3 * x,
    lambda x: x / 4, lambda x: 4 / x, lambda x: x ** 2, lambda x: ((x + 1) * 2 - 3) / 4,
    lambda x: x + np.float32(0.5), lambda x: np.int64(3) * x, lambda x: x - x * 2,
])
def test_scalars(a, build):
    np.testing.assert_allclose(values(build(a)), build(A))


@pytest.mark.parametrize("op", ["__add__", "__sub__", "__mul__", "__truediv__"])
def test_frames(a, b, buckets, op):
    result = getattr(a, op)(b)
    assert list(result.cells) == ["x", "y", "z"]
    np.testing.assert_allclose(values(result), getattr(A, op)(B))


def test_same_rows_need_no_join(a):
    both = a[:, 0] + a[:, 2]
    assert a.project("x").rowset is a.project("z").rowset
    assert "Join" not in (a.project("x") * a.project("z")).df._jdf.queryExecution().toString()
    np.testing.assert_allclose(values(both), (A[:, :1] + A[:, 2:]))


def test_one_column_goes_with_all(a, b):
    np.testing.assert_allclose(values(a * b[:, 1]), A * B[:, 1:2])
    np.testing.assert_allclose(values(b[:, 1] - a), B[:, 1:2] - A)
    with pytest.raises(ValueError):
        a + b[:, :2]
    with pytest.raises(ValueError):
        a + b[:5]


@pytest.mark.parametrize("array", [np.array([[1.0, 2, 3]]), np.arange(9), np.arange(9).reshape(9, 1), B])
def test_arrays(a, buckets, array):
    wide = array.reshape(-1, 1) if array.ndim == 1 else array
    np.testing.assert_allclose(values(a + array), A + wide)
    np.testing.assert_allclose(values(array - a), wide - A)


def test_nulls_zero_and_whole_numbers(spark):
    x = frame(spark, [(1, None), (2, 0.0), (2147483647, 4.0)], "i int, d double").order("i", unique=True)
    assert placed(x + 1) == [(2, None), (3, 1.0), (2147483648, 5.0)]
    assert placed(1 / x)[1] == (0.5, None)
    assert placed(x * x)[2] == (2147483647 ** 2, 16.0)
    with pytest.raises(TypeError):
        frame(spark, [("a",)], "s string") + 1
    with pytest.raises(TypeError):
        x ** "2"


def test_products(a, b, buckets):
    right = RNG.normal(size=(3, 2))
    named = array_frame(a.spark, right, ["u", "w"])
    np.testing.assert_allclose(values(a @ right), A @ right)
    np.testing.assert_allclose(values(a @ right[:, 0]), A @ right[:, :1])
    product = a @ named
    assert list(product.cells) == ["u", "w"]
    np.testing.assert_allclose(values(product), A @ right)
    np.testing.assert_allclose(values(a.T @ b), A.T @ B)
    np.testing.assert_allclose(values(a.T @ a), A.T @ A)
    left = RNG.normal(size=(4, 9))
    np.testing.assert_allclose(values(left @ a), left @ A)
    np.testing.assert_allclose(values(a @ b.T), A @ B.T)
    np.testing.assert_allclose(values(a.T @ B), A.T @ B)
    np.testing.assert_allclose(values((right.T @ a.T)), right.T @ A.T)
    np.testing.assert_allclose(values(right.T @ a.T @ b), right.T @ A.T @ B)
    with pytest.raises(ValueError):
        a @ np.ones((4, 2))
    with pytest.raises(ValueError):
        a @ b


def test_associative_and_identity(a, b):
    square = RNG.normal(size=(3, 3))
    np.testing.assert_allclose(values((a @ square) @ square), values(a @ (square @ square)))
    np.testing.assert_allclose(values(a @ np.eye(3)), A)
    np.testing.assert_allclose(values(a + b), values(b + a))


def test_transpose(a, b, buckets):
    assert a.T.T is a
    assert a.T.shape == (3, 9)
    wide = a.T.to_frame()
    assert list(wide.cells)[:2] == ["r_0000000000", "r_0000000001"]
    np.testing.assert_allclose(values(wide), A.T)
    np.testing.assert_allclose(values((a.T * 2 + b.T)[1:]), (A.T * 2 + B.T)[1:])
    np.testing.assert_allclose(values(a.T - np.arange(3)), A.T - np.arange(3).reshape(3, 1))
    np.testing.assert_allclose(values(wide + a.T), 2 * A.T)
    np.testing.assert_allclose(values(a.T + wide), 2 * A.T)


def test_wide_transpose_is_bounded(spark):
    tall = Frame.of(spark.range(600).withColumnRenamed("id", "v")).order("v", unique=True)
    with pytest.raises(ValueError, match="long"):
        tall.T.to_frame()
    assert tall.T.long().count() == 600


def test_long_products(a, b, buckets):
    product = multiply_long(a.T.long(), long_form(b)).collect()
    got = np.zeros((3, 3))
    for i, j, v in product:
        got[i, j] = v
    np.testing.assert_allclose(got, A.T @ B)
    sparse = a.spark.createDataFrame([(0, 5, 2.0), (700, 900, 3.0)], "i long, j long, v double")
    other = a.spark.createDataFrame([(5, 1, 10.0), (900, 800, 0.0), (6, 6, 1.0)], "i long, j long, v double")
    assert sorted(map(tuple, multiply_long(sparse, other).collect())) == [(0, 1, 20.0), (700, 800, 0.0)]


def cells(spark, *lines):
    return spark.createDataFrame(list(lines), "i long, j long, v double")


@pytest.mark.parametrize("settings", [{}, {"blockSide": "2", "blockCells": "3"}])
def test_long_products_of_absent_and_infinite_cells(spark, settings):
    """[inf, 1] times [absent, 2] is 2, as is [inf, 1] times [NULL, 2]; inf times a 0 that is there isn't a number."""
    for name, value in settings.items():
        spark.conf.set(f"spark.tabframe.{name}", value)
    left = cells(spark, (0, 0, INF), (0, 1, 1.0), (1, 1, None), (2, 0, -INF), (2, 5, INF))
    absent, null = cells(spark, (1, 0, 2.0)), cells(spark, (0, 0, None), (1, 0, 2.0))
    assert rows(multiply_long(left, absent)) == rows(multiply_long(left, null)) == [(0, 0, 2.0)]
    zero = multiply_long(left, cells(spark, (0, 0, 0.0), (1, 0, 2.0), (5, 1, 1.0))).collect()
    assert sorted((r.i, r.j, str(r.v)) for r in zero) == [(0, 0, "nan"), (2, 0, "nan"), (2, 1, "inf")]
    nothing = cells(spark)
    assert rows(multiply_long(left, nothing)) == rows(multiply_long(nothing, left)) == rows(multiply_long(left, cells(spark, (77, 0, 1.0)))) == []
    for name in settings:
        spark.conf.unset(f"spark.tabframe.{name}")


@pytest.mark.parametrize("density", [0.02, 0.6, 1.0])
@pytest.mark.parametrize("settings", [{}, {"blockSide": "16", "blockCells": "200"}])
def test_long_products_at_every_density(spark, density, settings):
    for name, value in settings.items():
        spark.conf.set(f"spark.tabframe.{name}", value)
    rng = np.random.default_rng(7)
    x, y = (np.where(rng.random(shape) < density, rng.normal(size=shape), 0) for shape in ((40, 70), (70, 30)))
    long = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, v double")
    got = np.zeros((40, 30))
    for i, j, v in multiply_long(long(x), long(y).repartition(7)).collect():
        got[i, j] = v
    np.testing.assert_allclose(got, x @ y, atol=1e-12)
    for name in settings:
        spark.conf.unset(f"spark.tabframe.{name}")


def test_matrix_views(a, b):
    np.testing.assert_allclose(b.order("p").to_matrix().matrix, B[B[:, 0].argsort()])
    assert set(a.rows) == {"x", "y", "z"}


def _same(got, expected):
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert [str(v) for v in a] == [str(v) for v in b]


def test_products_of_nulls_and_infinities(spark, buckets):
    """One result at every size: NULL makes a row's product NULL and adds nothing to a sum; NaN stays."""
    x = frame(spark, [(0, None, INF), (1, 2.0, 3.0), (2, NAN, 1.0)], "k int, a double, b double").order("k", unique=True)
    ab = x.project(("a", "b"))
    _same(placed(ab @ np.array([[1.0, 0.0], [1.0, 2.0]])), [(None, None), (5.0, 6.0), (NAN, NAN)])
    finite = x.filter(Q("k", 2, CMP.LT)).project(("a", "b"))
    _same(placed(finite.T @ finite), [(4.0, 6.0), (6.0, INF)])
    nothing = x.filter(Q("k", 9, CMP.GT)).project(("a", "b"))
    _same(placed(nothing.T @ nothing), [(None, None), (None, None)])
