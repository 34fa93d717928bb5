import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabframe import CMP, Frame, Q, Workspace
from tabframe.operators import NoOrderError
from tests.helpers import frame, placed, rows


def numbers(spark, n=20):
    """Values 0..n-1 in mixed storage order, ordered by a unique key."""
    shuffled = [(i * 7 % n, str(i * 7 % n)) for i in range(n)]
    return frame(spark, shuffled, "v int, s string").order("v", unique=True)


SLICES = [slice(3, 9), slice(None), slice(2, 18, 5), slice(-6, -1), slice(None, None, -3), slice(15, 2, -4),
          slice(30, 40), slice(5, 2), slice(-100, 3), 4, -1, -20, 19, 25]


def test_slices_match_lists(spark, buckets):
    x = numbers(spark).project("v")
    for item in SLICES:
        picked = item if isinstance(item, slice) else slice(item, item + 1 or None)
        assert [r[0] for r in placed(x[item])] == list(range(20))[picked], item


def test_picks_and_masks(spark, buckets):
    x = numbers(spark).project("v")
    for picks in ([3, 1, 1, -1], np.array([0, 19]), np.arange(20) % 4 == 1, []):
        want = np.arange(20)[np.array(picks, dtype=None if len(picks) else int)]
        assert [r[0] for r in placed(x[picks])] == want.tolist()
    with pytest.raises(IndexError):
        x[[20]]
    with pytest.raises(IndexError):
        x[np.array([True])]


def test_column_picks(spark):
    x = numbers(spark)
    for columns, names in [(0, ["v"]), ("s", ["s"]), (slice(None), ["v", "s"]), (["s", 0], ["s", "v"]), (-1, ["s"])]:
        assert list(x[:2, columns].cells) == names
    with pytest.raises(KeyError):
        x[:, "nothing"]


def test_slice_of_filter_and_slice(spark, buckets):
    x = numbers(spark)
    even = x.filter(Q("v", tuple(range(0, 20, 2)), CMP.IN))
    assert [r[0] for r in placed(even[2:5].project("v"))] == [4, 6, 8]
    assert [r[0] for r in placed(x[5:][::2][1:3].project("v"))] == [7, 9]
    assert [r[0] for r in placed(x[5:15].filter(Q("v", 8, CMP.GT))[:3].project("v"))] == [9, 10, 11]


def test_order_is_required(spark):
    with pytest.raises(NoOrderError):
        frame(spark, [(1,)], "v int")[0]


def test_ties_and_copies_keep_every_row(spark, buckets):
    """A third of the rows share one key; many are exact copies."""
    data = [("hot", i % 4) for i in range(40)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)] * 30
    x = frame(spark, data, "k string, v int")
    up = placed(x.order("k"))
    assert [r[0] for r in up] == sorted((k for k, _ in data), key=lambda k: (k is not None, k or ""))
    assert sorted(up, key=repr) == sorted(data, key=repr)
    down = placed(x.order(["k#desc", "v"]))
    assert [r[0] for r in down] == [r[0] for r in reversed(up)]
    assert sorted(down, key=repr) == sorted(data, key=repr)


def test_positions_of_files(spark, tmp_path, buckets):
    spark.range(100).repartition(5).write.parquet(f"{tmp_path}/t.parquet")
    t = Workspace(spark, str(tmp_path)).t
    assert sorted(r[0] for r in placed(t)) == list(range(100))
    assert len(placed(t[10:20])) == 10
    odd = t.filter(Q("id", tuple(range(1, 100, 2)), CMP.IN))
    kept = [r[0] for r in placed(t) if r[0] % 2]
    assert [r[0] for r in placed(odd)] == kept
    assert list(t.tail(3)["id"]) == [r[0] for r in placed(t)][-3:]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, 0.0, -1.5, float("inf"), 2.0]), st.integers(-3, 3)), max_size=30))
def test_positions_any_partitioning(spark, data):
    data = [(a, b, i) for i, (a, b) in enumerate(data)]
    expected = sorted(data, key=lambda r: (-r[1], r[0] is not None, r[0] or 0.0, r[2]))
    for partitions, per_bucket in ((1, 100), (5, 3)):
        spark.conf.set("spark.tabframe.rowsPerBucket", str(per_bucket))
        df = spark.createDataFrame(data, "a double, b int, c int").repartition(partitions)
        x = Frame.of(df).order(["b#desc", "a", "c"], unique=True)
        assert placed(x) == expected
    spark.conf.unset("spark.tabframe.rowsPerBucket")


def test_vstack(spark, buckets):
    x = numbers(spark, 5)
    y = frame(spark, [(9, "nine"), (8, "eight")], "a int, b string").order("a")
    stacked = x.vstack([y, {"p": np.array([70, 71]), "q": np.array(["u", "w"])}])
    assert list(stacked.cells) == ["v", "s"]
    assert [r[0] for r in placed(stacked)] == [0, 1, 2, 3, 4, 8, 9, 70, 71]
    assert [r[0] for r in placed(stacked[4:7].project("v"))] == [4, 8, 9]
    assert stacked.shape == (9, 2)
    with pytest.raises(TypeError):
        x.vstack(x.project("v"))


def test_hstack(spark, buckets):
    x = numbers(spark, 6)
    backwards = x.order("v#desc", unique=True)
    side = x.hstack([backwards], ["a_", "b_"])
    assert placed(side) == [(i, str(i), 5 - i, str(5 - i)) for i in range(6)]
    assert placed(side[2:4, ["b_v", 0]]) == [(3, 2), (2, 3)]
    with pytest.raises(ValueError):
        x.hstack([backwards])
    with pytest.raises(ValueError):
        x.project("v").hstack([backwards[:4].project("s")])
    same = x.project("v").hstack([x.project("s")])
    assert same.rowset is x.project("s").rowset


def test_row_names(spark):
    assert placed(numbers(spark, 2).rowNames) == [("r_0000000000",), ("r_0000000001",)]


def test_distinct_after_stack_is_a_set_union(spark):
    x = numbers(spark, 3).project("v")
    assert rows(x.vstack(x).distinct()) == [(0,), (1,), (2,)]


@pytest.mark.parametrize("partitions", ["1", "4", "17"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.tabframe.rowsPerBucket", "6")
    try:
        x = numbers(spark, 30).project("v")
        y = numbers(spark, 30).order("v#desc", unique=True).project("v")
        assert placed(x + y) == [(29,)] * 30
        assert placed(x.hstack([y], ["a", "b"])[::7]) == [(i, 29 - i) for i in range(0, 30, 7)]
        assert placed(x.T @ y) == [(sum(i * (29 - i) for i in range(30)),)]
        assert sorted(map(tuple, x.T.long().collect()))[7] == (0, 7, 7.0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.tabframe.rowsPerBucket")


def test_slices_of_hot_keys(spark, buckets):
    """Slices under a key with many ties hold the right keys and cover every row once."""
    data = [("hot", i) for i in range(30)] + [(f"k{i}", i) for i in range(30)]
    x = frame(spark, data, "k string, v int").order("k")
    pieces = [placed(x[low:low + 17]) for low in range(0, 60, 17)]
    together = [r for piece in pieces for r in piece]
    assert [r[0] for r in together] == sorted(k for k, _ in data)
    assert sorted(together) == sorted(data)


def test_long_heads_go_by_position(spark):
    spark.conf.set("spark.tabframe.topRows", "3")
    try:
        x = numbers(spark).project("v")
        assert list(x.head(3)["v"]) == [0, 1, 2] and list(x.tail(3)["v"]) == [17, 18, 19]
        assert list(x.head(5)["v"]) == [0, 1, 2, 3, 4] and list(x.tail(5)["v"]) == [15, 16, 17, 18, 19]
        backwards = x.order("v#desc")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert list(backwards.head(9)["v"]) == [*range(19, 10, -1)] and list(backwards.tail(9)["v"]) == [*range(8, -1, -1)]
    finally:
        spark.conf.unset("spark.tabframe.topRows")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_heads_beyond_what_the_driver_takes(spark):
    spark.conf.set("spark.tabframe.fetchRows", "3")
    try:
        with pytest.raises(ValueError):
            numbers(spark).head(4)
        assert numbers(spark).top(4).df.count() == 4
    finally:
        spark.conf.unset("spark.tabframe.fetchRows")


def test_fetched_rows_are_in_order(spark, buckets):
    x = numbers(spark)
    assert x[::-3].rows["v"].tolist() == list(range(20))[::-3]
    assert x.order("v#desc").rows["s"].tolist() == [str(i) for i in reversed(range(20))]


def test_mask_frames(spark, buckets):
    x = numbers(spark)
    even = x.project({Q("v", tuple(range(0, 20, 2)), CMP.IN): "m"})
    assert [r[0] for r in placed(x.project("v")[even])] == list(range(0, 20, 2))
    backwards = x.order("v#desc", unique=True).project({Q("v", 15, CMP.GT): "m"})
    assert [r[0] for r in placed(x.project("v")[backwards])] == [0, 1, 2, 3]
    with pytest.raises(IndexError):
        x[x.project("v")]
