import numpy as np
import pyarrow as pa
import pytest

from tabframe import COUNT
from tabframe.operators import userfunc
from tests.helpers import frame, rows


@pytest.fixture(scope="module")
def table(spark):
    return frame(spark, [("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)], "g string, x double")


def test_dict_and_matrix_results(table):
    doubled = table._U(lambda batch: {"y": batch.rows["x"] * 2, "g": batch.rows["g"]}, schema="g string, y double")
    assert rows(doubled) == [(None, 14.0), ("a", 2.0), ("a", 6.0), ("b", 10.0)]
    shifted = table.project("x")._U(lambda batch, by: (batch.matrix + by, ["z"]), 1, schema="z double")
    assert rows(shifted) == [(2.0,), (4.0,), (6.0,), (8.0,)]


@pytest.mark.parametrize("function", [
    lambda batch: 5, lambda batch: (batch.matrix, ["a", "b"]), lambda batch: {"other": batch.rows["x"]},
])
def test_wrong_results(table, function):
    with pytest.raises(Exception, match="TypeError"):
        rows(table.project("x")._U(function, schema="z double"))


def test_plan_functions(table):
    assert rows(table._U(lambda f: f.agg(COUNT("*")))) == [(4,)]
    with pytest.raises(TypeError):
        table._U(lambda f: {"x": [1]})


def test_matrix_function(table):
    assert rows(table.project("x")._XP(np.negative)) == [(-7.0,), (-5.0,), (-3.0,), (-1.0,)]
    widened = table.project("x").map_matrix(lambda m: np.hstack([m, m ** 2]), cols=["x", "x2"])
    assert rows(widened)[-1] == (7.0, 49.0)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_fold_groups(spark, partitions):
    data = [("hot" if i % 3 else f"k{i % 5}", float(i)) for i in range(900)]
    table = frame(spark, data, "g string, x double")
    table.rowset.df = table.rowset.df.repartition(partitions)

    def partial(batch):
        return {"n": len(batch), "s": batch.rows["x"].sum()}

    def merge(states):
        return {"n": states.rows["n"].sum(), "s": states.rows["s"].sum()}

    got = table.fold_groups("g", partial, merge, "n long, s double", lambda s: {"mean": s["s"] / s["n"]},
                            "mean double")
    want = {g: np.mean([x for h, x in data if h == g]) for g, _ in data}
    assert {g: m for g, m in rows(got)} == pytest.approx(want)


@pytest.mark.parametrize("fan", ["2", "64"])
def test_groups_of_two_keys_in_small_batches(spark, fan):
    spark.conf.set("spark.tabframe.mergeFanIn", fan)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    data = [(None if i % 7 == 0 else f"k{i % 4}", i % 3, float("nan") if i % 50 == 0 else float(i)) for i in range(400)]
    table = frame(spark, data, "g string, h int, x double")
    table.rowset.df = table.rowset.df.repartition(9)
    got = table.fold_groups(["g", "h"], lambda b: {"n": len(b), "most": np.nan_to_num(b.rows["x"], nan=-1.0).max()},
                            lambda s: {"n": s.rows["n"].sum(), "most": s.rows["most"].max()}, "n long, most double", lambda s: s, "n long, most double")
    want = {}
    for g, h, x in data:
        n, most = want.get((g, h), (0, -1.0))
        want[g, h] = n + 1, most if x != x else max(most, x)
    assert rows(got) == sorted(((*k, *v) for k, v in want.items()), key=lambda r: tuple((v is not None, v) for v in r))
    spark.conf.unset("spark.tabframe.mergeFanIn")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_share_the_arrays_of_their_batch(monkeypatch):
    """Columns become arrays once for all groups of a batch, masked only in groups that have NULLs; a state that is alone
    passes as it is."""
    made, convert = [], userfunc._numpy
    monkeypatch.setattr(userfunc, "_numpy", lambda column: made.append(len(column)) or convert(column))
    n = 300
    arrow = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("x", pa.float64()), ("s", pa.string()), ("l", pa.list_(pa.int64()))])
    k = sorted([*range(n), *range(0, n, 3)])
    batch = pa.RecordBatch.from_pydict({
        "k": k, "n": [None if i % 4 == 0 else i for i in k], "x": [float("nan") if i % 5 == 0 else i / 3 for i in k],
        "s": [None if i % 2 else f"s{i}" for i in k], "l": [[i, -i] for i in k]}, schema=arrow)
    seen = []

    def merge(states):
        rows = states.rows
        assert set(rows) == set(states.columns) and len(states) == 2
        masked = isinstance(rows["n"], np.ma.MaskedArray)
        assert masked == (rows["s"][0] is not None and int(rows["s"][0][1:]) % 4 == 0)
        seen.append(len(states))
        return {"n": None if masked else rows["n"].sum(), "x": rows["x"].max(), "s": rows["s"][0], "l": list(rows["l"][1])}

    first = [i for i in range(len(k)) if i == 0 or k[i] != k[i - 1]]
    out = userfunc._settled(batch, first, ["k"], merge, 64, arrow)
    assert len(seen) == n // 3 and len(made) == 4
    want = [{"k": i, "n": None if i % 4 == 0 else i * (1 if i % 3 else 2), "s": None if i % 2 else f"s{i}", "l": [i, -i]} for i in range(n)]
    got = out.to_pylist()
    assert [{c: r[c] for c in r if c != "x"} for r in got] == want and out.schema == arrow
    assert all(r["x"] != r["x"] if r["k"] % 5 == 0 else r["x"] == r["k"] / 3 for r in got)


def test_nulls_and_large_whole_numbers_survive(spark):
    big = 2 ** 62 + 1
    table = frame(spark, [(big, None), (None, 1.0), (big, float("nan"))], "k long, x double")
    same = table._U(lambda batch: batch.rows, schema="k long, x double")
    got = same.df.collect()
    assert sorted(r["k"] or 0 for r in got) == [0, big, big]
    assert sum(r["x"] is None for r in got) == 1
    counted = table.fold_groups("k", lambda b: {"n": len(b)}, lambda s: {"n": s.rows["n"].sum()}, "n long",
                                lambda s: s, "n long")
    assert rows(counted) == [(None, 1), (big, 2)]


# -- states of whole tables --------------------------------------------------------


def total(batch):
    x = batch.matrix
    return len(x), x.sum(axis=0)


def both(a, b):
    return a[0] + b[0], a[1] + b[1]


@pytest.fixture(params=[3, 10_000])
def batch_rows(request, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_centring_is_the_same_at_every_batch_size(spark, batch_rows, partitions):
    table = frame(spark, [(float(i), float(i * i)) for i in range(500)], "x double, y double")
    table.rowset.df = table.rowset.df.repartition(partitions)
    mean = table.fold(total, both, lambda s: s[1] / s[0])
    assert mean.tolist() == [249.5, sum(i * i for i in range(500)) / 500]
    got = rows(table._XP(lambda m, mean: m - mean, state=mean))
    assert max(r[0] for r in got) == 249.5 and len(got) == 500


def test_fold_in_levels(spark):
    spark.conf.set("spark.tabframe.mergeFanIn", "2")
    table = frame(spark, [(float(i),) for i in range(300)], "x double")
    table.rowset.df = table.rowset.df.repartition(23)
    assert table.fold(total, both)[0] == 300
    spark.conf.unset("spark.tabframe.mergeFanIn")


def test_fold_of_nothing(spark):
    empty = frame(spark, [], "x double, y double")
    n, sums = empty.fold(total, both)
    assert n == 0 and sums.tolist() == [0.0, 0.0]


def test_states_that_grow_raise(spark, table):
    spark.conf.set("spark.tabframe.foldBytes", "2000")
    long = frame(spark, [(float(i),) for i in range(5000)], "x double")
    with pytest.raises(Exception, match="must not grow"):
        long.fold(lambda b: b.matrix, lambda a, b: np.vstack([a, b]))
    spark.conf.unset("spark.tabframe.foldBytes")


@pytest.mark.parametrize("function", [
    lambda m: m - m.mean(axis=0), lambda m: m.cumsum(axis=0), lambda m: m[::-1], lambda m: m.sum(axis=0, keepdims=True),
])
def test_functions_that_look_at_other_rows_raise(spark, function):
    table = frame(spark, [(float(i),) for i in range(1, 9)], "x double").order("x", unique=True)
    table.rowset.df = table.rowset.df.coalesce(1)
    with pytest.raises(Exception, match="looks at other rows"):
        rows(table.map_matrix(function))


def test_functions_of_rows_pass(spark):
    table = frame(spark, [(float(i), None if i % 3 else 1.0) for i in range(1, 90)], "x double, y double")
    assert len(rows(table.map_matrix(lambda m: m @ np.array([[1.0, 0.3], [0.7, 1 / 3]])))) == 89
    kept = table._U(lambda b: {"x": b.rows["x"][b.rows["x"] > 50]}, schema="x double")
    assert len(rows(kept)) == 39
    noisy = table.map_matrix(lambda m: m + np.random.random(m.shape), check=False)
    assert len(rows(noisy)) == 89


def test_matrices_in_and_out(spark, batch_rows):
    table = frame(spark, [(i, float(i), float(2 * i)) for i in range(1, 40)], "k long, x double, y double")
    weights = frame(spark, [(1, 1.0, 0.0), (0, 2.0, None)], "at long, u double, w double").order("at", unique=True).project(("u", "w"))

    def work(matrix, shift, weights, row):
        product = matrix @ np.nan_to_num(weights)
        return {"product": product + shift + row, "large": matrix[matrix[:, 0] > 30]}

    with pytest.raises(Exception, match="TypeError"):
        table.project(("x", "y")).map_matrices(work, [weights, np.array([[1.0, 1.0]])], {"product": ["a", "b"]}, state=0.5)
    found = table.project(("x", "y")).map_matrices(
        work, [weights, np.array([[1.0, 1.0]])], {"product": ["a", "b"], "large": ["x", "y"]}, state=0.5)
    assert rows(found["product"]) == [(2.0 * i + 2 * i + 1.5, 1.5) for i in range(1, 40)]
    assert rows(found["large"]) == [(float(i), 2.0 * i) for i in range(31, 40)]
    beside = table.map_matrices(lambda m: {"sum": m.sum(axis=1)}, (), {"sum": ["s"]}, keep="k")
    assert rows(beside["sum"]) == [(i, 3.0 * i) for i in range(1, 40)]


def test_whole_matrices_are_small(spark, table):
    spark.conf.set("spark.tabframe.smallCells", "3")
    with pytest.raises(ValueError, match="too many"):
        table.project("x").map_matrices(lambda m, o: {"r": m}, [table.project("x")], {"r": ["x"]})
    spark.conf.unset("spark.tabframe.smallCells")
    with pytest.raises(ValueError, match="order"):
        table.project("x").map_matrices(lambda m, o: {"r": m}, [table.project("x")], {"r": ["x"]})
