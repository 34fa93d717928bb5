"""Dense row positions without sorting the data in one task.

A position is ``offset[bucket] + rank inside the bucket``.  Buckets are ranges
of the sort key, cut at sampled keys, so that they are of similar size; only
the sampled keys and one count per bucket ever reach the driver.  The bucket of
a row depends on its key alone, never on a partition number, so lost executors
and re-run tasks give the same positions.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as sf

from tabframe.plans.durable import durable
from tabframe.plans.settings import setting

POS = "__pos"
FILE, ROW = "__file", "__row"
BUCKET = "__bucket"
_PROBE = "__probe"
_COPIES = "__copies"


@dataclass(frozen=True)
class SortKey:
    """One sort column; NULLs come first ascending and last descending."""

    column: Column
    descending: bool = False

    def ordering(self) -> Column:
        return self.column.desc() if self.descending else self.column.asc()

    def reversed(self) -> SortKey:
        return SortKey(self.column, not self.descending)

    def at_or_after(self, edge: Column) -> Column:
        """Not before a non-null value in this order."""
        if self.descending:
            return (self.column <= edge) | self.column.isNull()
        return self.column >= edge


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return sf.col("`" + name.replace("`", "``") + "`")


def arrow_scalar(spark: SparkSession, values: pa.Array) -> Column:
    """A driver-side array as one array-valued scalar in the plan."""
    offsets = pa.array([0, len(values)], pa.int32())
    return spark.createDataFrame(pa.table({"v": pa.ListArray.from_arrays(offsets, values)})).scalar()


def identity_hash(df: DataFrame) -> Column:
    return sf.xxhash64(*(named(c) for c in df.columns))


def key_groups(keys: list[SortKey]) -> list[tuple[Column, bool]]:
    """Runs of keys of one direction as structs, which Spark compares as a whole."""
    runs = itertools.groupby(enumerate(keys), key=lambda entry: entry[1].descending)
    return [(sf.struct(*(key.column.alias(f"k{i}") for i, key in run)), down) for down, run in runs]


def is_reached(groups: list[tuple[Column, Column, bool]]) -> Column:
    """Whether a key, given as (own, bound, descending) groups, is at or after the bound."""
    own, bound, down = groups[0]
    if len(groups) == 1:
        return own <= bound if down else own >= bound
    return (own < bound if down else own > bound) | ((own == bound) & is_reached(groups[1:]))


def sample_bounds(df: DataFrame, keys: list[SortKey], rows: int, buckets: int) -> pa.Array:
    """Sorted distinct split keys, taken evenly from a bounded random sample."""
    wanted = buckets * setting(df.sparkSession, "samplesPerBucket")
    groups = key_groups(keys)
    fields = [group.alias(f"g{g}") for g, (group, _) in enumerate(groups)]
    ordering = [SortKey(sf.col(f"g{g}"), down).ordering() for g, (_, down) in enumerate(groups)]
    sample = df.select(*fields).sample(min(1.0, wanted / rows), seed=17)
    table = sample.orderBy(*ordering).toArrow().combine_chunks()
    step = table.num_rows / buckets
    picks = sorted({int(step * i) for i in range(1, buckets)}) if table.num_rows else []
    picked = table.take(picks).to_struct_array()
    return picked.combine_chunks() if isinstance(picked, pa.ChunkedArray) else picked


def with_bucket(df: DataFrame, keys: list[SortKey], bounds: pa.Array, first: int = 0) -> DataFrame:
    """Add the range bucket of each row by binary search over the bounds.

    Buckets are numbered from ``first``.
    """
    df = df.withColumn(BUCKET, sf.lit(0))
    if not len(bounds):
        return df.withColumn(BUCKET, sf.lit(first))
    ladder = arrow_scalar(df.sparkSession, bounds)
    groups = key_groups(keys)
    own = [f"__own{g}" for g in range(len(groups))]
    df = df.withColumns({name: group for name, (group, _) in zip(own, groups)})
    for power in reversed(range(len(bounds).bit_length())):
        step = 1 << power
        index = sf.col(BUCKET) + sf.lit(step - 1)
        df = df.withColumn(_PROBE, sf.get(ladder, index))
        tests = [(sf.col(name), sf.col(_PROBE)[f"g{g}"], down)
                 for g, (name, (_, down)) in enumerate(zip(own, groups))]
        reached = (index < sf.lit(len(bounds))) & is_reached(tests)
        df = df.withColumn(BUCKET, sf.col(BUCKET) + sf.when(reached, sf.lit(step)).otherwise(sf.lit(0)))
    return df.withColumn(BUCKET, sf.col(BUCKET) + sf.lit(first)).drop(_PROBE, *own)


@dataclass(frozen=True)
class Placement:
    """Rows with positions, their number, and a cheaper way to a range of them."""

    placed: DataFrame
    rows: int
    narrow: Callable[[int, int], DataFrame] | None = None

    def between(self, low: int, high: int) -> DataFrame:
        """Rows at positions ``low`` to ``high``, both included."""
        if high < low:
            return self.placed.filter(sf.lit(False))
        source = self.narrow(low, high) if self.narrow else self.placed
        return source.filter(sf.col(POS).between(low, high))


class _Buckets:
    """Rows cut into key ranges, each of known size."""

    def __init__(self, df: DataFrame, keys: list[SortKey], rows: int, weight: str | None = None):
        spark = df.sparkSession
        self.keys, self.weight = keys, weight
        wanted = min(math.ceil(rows / setting(spark, "rowsPerBucket")), setting(spark, "maxBuckets"))
        self.bounds = sample_bounds(df, keys, rows, wanted) if wanted > 1 else pa.array([])
        self.source, self.df = df, with_bucket(df, keys, self.bounds)
        total = sf.sum(weight) if weight else sf.count(sf.lit(1))
        sizes = {r[0]: r[1] for r in self.df.groupBy(BUCKET).agg(total).collect()}
        width = max(sizes, default=0) + 1
        self.starts = [0, *itertools.accumulate(sizes.get(b, 0) for b in range(width))]

    @property
    def rows(self) -> int:
        return self.starts[-1]

    def place(self, inside: list[SortKey], df: DataFrame | None = None) -> DataFrame:
        """Add the first position of each row, ranking by ``inside`` in a bucket."""
        df = self.df if df is None else df
        window = Window.partitionBy(BUCKET).orderBy(*(k.ordering() for k in inside))
        if self.weight:
            earlier = window.rowsBetween(Window.unboundedPreceding, -1)
            before = sf.coalesce(sf.sum(self.weight).over(earlier), sf.lit(0))
        else:
            before = sf.row_number().over(window) - 1
        offsets = arrow_scalar(df.sparkSession, pa.array(self.starts, pa.int64()))
        return df.withColumn(POS, sf.get(offsets, sf.col(BUCKET)) + before).drop(BUCKET)

    def narrow(self, low: int, high: int) -> DataFrame:
        """Positions of the buckets that hold ``low`` to ``high`` only.

        Rows outside the key range of these buckets are dropped before the
        shuffle; a plain leading key even narrows what is read from files.
        """
        first = max(bisect.bisect_right(self.starts, low) - 1, 0)
        last = bisect.bisect_right(self.starts, high) - 1
        rows = self.source
        if first > 0:
            rows = self._from(rows, first - 1)
        if last < len(self.bounds):
            rows = self._until(rows, last)
        kept = self.bounds[first:last] if len(self.bounds) else self.bounds
        return self.place(self.keys, with_bucket(rows, self.keys, kept, first))

    def _from(self, rows: DataFrame, index: int) -> DataFrame:
        key, edge = self.keys[0], self._edge(index)
        if edge is not None:
            rows = rows.filter(key.at_or_after(edge))
        return rows.filter(self._reached(index))

    def _until(self, rows: DataFrame, index: int) -> DataFrame:
        key, edge = self.keys[0], self._edge(index)
        if edge is not None:
            rows = rows.filter(key.reversed().at_or_after(edge))
        return rows.filter(~self._reached(index))

    def _reached(self, index: int) -> Column:
        bound = sf.get(arrow_scalar(self.source.sparkSession, self.bounds[index:index + 1]), sf.lit(0))
        groups = key_groups(self.keys)
        return is_reached([(own, bound[f"g{g}"], down) for g, (own, down) in enumerate(groups)])

    def _edge(self, index: int) -> Column | None:
        """The leading key of a bound, where it is of a type with a plain literal."""
        value = self.bounds[index]["g0"]["k0"]
        kind = value.type
        plain = pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind)
        return sf.lit(value.as_py()) if plain and value.is_valid else None


def number_by_key(df: DataFrame, keys: list[SortKey], unique: bool) -> Placement:
    """Positions 0..n-1 in key order.

    Ties are broken by where a row was read from, else by all its columns; rows
    equal in every column are counted first and expanded again at the end, so a
    large group of copies is never sorted or shuffled row by row.
    """
    if unique:
        return _number_unique(df, keys, df.count())
    if FILE in df.columns:
        return _number_unique(df, [*keys, SortKey(sf.col(FILE)), SortKey(sf.col(ROW))], df.count())
    digest = SortKey(identity_hash(df))
    per_hash = df.groupBy(digest.column.alias("h")).count()
    rows, most = per_hash.agg(sf.sum("count"), sf.max("count")).first()
    if (most or 1) == 1:
        return _number_unique(df, [*keys, digest], rows or 0)
    return _number_copies(df, [*keys, digest], most)


def _number_unique(df, keys, rows):
    if rows == 0:
        return Placement(df.withColumn(POS, sf.lit(0).cast("long")), 0)
    buckets = _Buckets(df, keys, rows)
    return Placement(buckets.place(keys), buckets.rows, buckets.narrow)


def _number_copies(df, keys, most):
    names = df.columns
    chunk = setting(df.sparkSession, "copiesPerChunk")
    # Kept, as three passes follow over what may be a costly input.
    kinds = durable(df.groupBy(*(named(c) for c in names)).agg(sf.count(sf.lit(1)).alias(_COPIES)))
    buckets = _Buckets(kinds, keys, kinds.count(), _COPIES)
    # Different rows may share a hash: all columns decide inside a bucket.
    placed = buckets.place([*keys, *(SortKey(named(c)) for c in names)])
    pieces = sf.sequence(sf.lit(0).cast("long"), sf.expr(f"({_COPIES} - 1) div {chunk}"))
    placed = placed.withColumn("__piece", sf.explode(pieces))
    if most > chunk:
        placed = placed.repartition(sf.col(POS), sf.col("__piece"))
    first = sf.col("__piece") * chunk
    last = sf.least(first + chunk, sf.col(_COPIES)) - 1
    expanded = placed.withColumn("__copy", sf.explode(sf.sequence(first, last)))
    position = (sf.col(POS) + sf.col("__copy")).alias(POS)
    return Placement(expanded.select(*(named(c) for c in names), position), buckets.rows)


def number_by_file(df: DataFrame) -> Placement:
    """Positions of a whole, unfiltered file scan: file offset plus row in the file.

    The rows are not shuffled.  The offsets have one row per file, and are
    broadcast unless there are very many files.
    """
    per_file = df.groupBy(FILE).agg((sf.max(ROW) + 1).alias("rows"))
    rows, files = per_file.agg(sf.sum("rows"), sf.count(sf.lit(1))).first()
    running = Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    start = sf.coalesce(sf.sum("rows").over(running), sf.lit(0))
    offsets = per_file.select(sf.col(FILE).alias("__from"), start.alias("__start"))
    if files <= setting(df.sparkSession, "broadcastFiles"):
        offsets = sf.broadcast(offsets)
    placed = df.join(offsets, sf.col(FILE) == sf.col("__from"))
    placed = placed.withColumn(POS, sf.col("__start") + sf.col(ROW))
    return Placement(placed.drop("__from", "__start"), rows or 0)
