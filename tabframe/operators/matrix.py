"""Transpose and matrix products.

Three recipes, chosen by shape:

* rows of a frame times a small matrix: a projection, no shuffle;
* ``X.T @ Y`` over the same rows: one aggregation with map-side partial sums;
* both sides large: long form ``(i, j, v)``, multiplied block by block.

Cells that are NULL make a projected row NULL and add nothing to a sum.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as sf

from tabframe.operators.positional import align, array_frame
from tabframe.plans.position import POS
from tabframe.plans.settings import setting

_LONG = "i bigint, j bigint, v double"


def label(index: int) -> str:
    """Name of the row or column at an index."""
    return f"r_{index:010d}"


class Transposed:
    """``X.T``: algebra on it stays on the columns of ``X``.

    Anything else goes through ``to_frame``, which needs a bounded row count;
    ``long`` has no such bound.
    """

    __array_ufunc__ = None

    def __init__(self, source):
        self.source = source

    @property
    def T(self):
        return self.source

    @property
    def shape(self):
        n, k = self.source.shape
        return k, n

    @property
    def spark(self):
        return self.source.spark

    def long(self) -> DataFrame:
        """Cells ``(i, j, v)`` of the transpose, one row per cell."""
        return long_form(self.source).select(sf.col("j").alias("i"), sf.col("i").alias("j"), "v")

    def to_frame(self):
        """A wide frame with one column per source row, named ``r_0000000000`` on.

        The first hidden position column follows the order of the source columns.
        """
        placed = self.source.rowset.positioned()
        rows = self.source.rowset.count()
        limit = setting(self.spark, "transposeRows")
        if rows > limit:
            raise ValueError(f"{rows} rows are too many columns (limit {limit}); use .long()")
        values = self.source.to_matrix().cells
        cells = [sf.struct(sf.lit(i).alias("i"), c.alias("v")) for i, c in enumerate(values.values())]
        flat = placed.select(sf.col(POS), sf.inline(sf.array(*cells)))
        pick = [sf.max(sf.when(sf.col(POS) == q, sf.col("v"))).alias(label(q)) for q in range(rows)]
        wide = flat.groupBy("i").agg(*pick)
        wide = wide.select(sf.col("i").cast("bigint").alias(POS), *(label(q) for q in range(rows)))
        return self.source._of(wide, rows=len(values))

    @property
    def rowNames(self) -> list[str]:
        return list(self.source.cells)

    def _combine(self, other, op):
        """Element-wise work is done on the sources and transposed back."""
        if isinstance(other, np.ndarray) and other.ndim:
            other = other.reshape(1, -1) if other.ndim == 1 else other.T
        if isinstance(other, Transposed):
            other = other.source
        elif hasattr(other, "rowset"):
            other = Transposed(other).to_frame()
        return Transposed(op(self.source, other))

    def __add__(self, other):
        return self._combine(other, operator.add)

    def __radd__(self, other):
        return self._combine(other, lambda x, y: y + x)

    def __sub__(self, other):
        return self._combine(other, operator.sub)

    def __rsub__(self, other):
        return self._combine(other, lambda x, y: y - x)

    def __mul__(self, other):
        return self._combine(other, operator.mul)

    def __rmul__(self, other):
        return self._combine(other, lambda x, y: y * x)

    def __truediv__(self, other):
        return self._combine(other, operator.truediv)

    def __rtruediv__(self, other):
        return self._combine(other, lambda x, y: y / x)

    def __pow__(self, power):
        return self._combine(power, operator.pow)

    def __matmul__(self, other):
        return multiply(self, other)

    def __rmatmul__(self, other):
        return multiply(other, self)

    def __getitem__(self, item):
        return self.to_frame()[item]

    def __getattr__(self, name):
        if name.startswith("_") or name == "rowset":
            raise AttributeError(name)
        return getattr(self.to_frame(), name)


def long_form(frame) -> DataFrame:
    """Cells ``(i, j, v)`` of a frame: row position, column index, value."""
    values = sf.array(*frame.to_matrix().cells.values())
    placed = frame.rowset.positioned().select(POS, sf.posexplode(values).alias("j", "v"))
    return placed.select(sf.col(POS).alias("i"), sf.col("j").cast("bigint").alias("j"), "v")


def multiply(left, right):
    """Matrix product of frames, transposed frames and arrays."""
    if isinstance(left, np.ndarray) and isinstance(right, Transposed):
        return Transposed(multiply(right.source, left.T))
    if isinstance(left, np.ndarray):
        left = np.atleast_2d(left)
        return _tall_product(array_frame(right.spark, left.T), right, list(right.cells))
    if isinstance(left, Transposed) and isinstance(right, Transposed):
        return Transposed(multiply(right.source, left.source))
    if isinstance(left, Transposed):
        if isinstance(right, np.ndarray):
            right = array_frame(left.spark, right)
        return _tall_product(left.source, right, list(right.cells))
    if isinstance(right, np.ndarray):
        matrix = right.reshape(-1, 1) if right.ndim == 1 else right
        return _project_product(left, matrix, [label(j) for j in range(matrix.shape[1])])
    if isinstance(right, Transposed):
        rows = right.source.numRows
        if rows > setting(left.spark, "transposeRows"):
            raise ValueError(f"{rows} result columns; use multiply_long(x.long(), y.T.long())")
        return _project_product(left, _fetch(right.source, rows).T, [label(j) for j in range(rows)])
    if right.numRows != len(left.cells):
        raise ValueError(f"{len(left.cells)} columns times {right.numRows} rows")
    return _project_product(left, _fetch(right, len(left.cells)), list(right.cells))


def _fetch(frame, rows: int) -> np.ndarray:
    """A frame of a known small number of rows as an object array in row order."""
    values = frame.to_matrix()
    table = values.positions().orderBy(POS).toArrow()
    if table.num_rows != rows:
        raise ValueError(f"expected {rows} rows, found {table.num_rows}")
    return np.array([table[n].to_pylist() for n in values.cells], dtype=object).T.reshape(rows, -1)


def _project_product(left, matrix: np.ndarray, names: list[str]):
    """Rows of ``left`` times a driver-side matrix, as columns over the same rows."""
    if matrix.shape[0] != len(left.cells):
        raise ValueError(f"{len(left.cells)} columns times {matrix.shape[0]} rows")
    cells = list(left.to_matrix().cells.values())
    if matrix.size <= setting(left.spark, "literalCells"):
        products = [_dot(cells, matrix[:, j]) for j in range(matrix.shape[1])]
    else:
        result = _batch_product(np.array(matrix, dtype=object))(sf.array(*cells))
        products = [sf.get(result, sf.lit(j)) for j in range(matrix.shape[1])]
    return left._derive(left.rowset, dict(zip(names, products)))


def _dot(cells: list[Column], weights) -> Column:
    terms = [c * sf.lit(None if w is None else float(w)).cast("double") for c, w in zip(cells, weights)]
    return functools.reduce(operator.add, terms)


def _batch_product(matrix: np.ndarray):
    """Rows of arrays times ``matrix``; as in ``_dot`` a product with NULL is NULL, and NaN stays NaN."""
    unknown = np.equal(matrix, None).astype(bool)
    weights, null_columns = np.where(unknown, 0.0, matrix).astype("float64"), unknown.any(axis=0)

    @sf.arrow_udf("array<double>")
    def product(rows: pa.Array) -> pa.Array:
        values, missing = _dense(rows)
        out = values @ weights
        null = missing.any(axis=1)[:, None] | null_columns
        offsets = np.arange(len(rows) + 1, dtype="int32") * weights.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel(), mask=null.ravel()))

    return product


def _tall_product(x, y, names: list[str]):
    """``x.T @ y``: sums over the shared rows, partial sums before the shuffle."""
    same = x is y
    x, y = x.to_matrix(), y.to_matrix()
    rowset, (xs, ys) = align([x, y])
    xs, ys = list(xs.values()), list(ys.values())
    if len(xs) * len(ys) <= setting(x.spark, "aggregateCells"):
        sums = [sf.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(ys)]
        line = [
            sf.struct(sf.lit(i).cast("bigint").alias(POS),
                      *(sf.col(f"s{i}_{j}").alias(n) for j, n in enumerate(names)))
            for i in range(len(xs))
        ]
        wide = rowset.df.agg(*sums).select(sf.inline(sf.array(*line)))
    else:
        vectors = rowset.df.select(sf.array(*xs).alias("x"), *([] if same else [sf.array(*ys).alias("y")]))
        sums = vectors.mapInArrow(_partial_products, _LONG + ", n bigint").groupBy("i", "j").agg(
            sf.when(sf.sum("n") > 0, sf.sum("v")).alias("v"))
        every = x.spark.range(len(xs)).select(sf.col("id").alias("i"))  # also where there are no rows
        cells = every.join(sums, "i", "left")
        pick = [sf.max(sf.when(sf.col("j") == j, sf.col("v"))).alias(n) for j, n in enumerate(names)]
        wide = cells.groupBy(sf.col("i").alias(POS)).agg(*pick)
    return x._of(wide, rows=len(xs))


def _dense(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Equal-length lists of one batch as a 2-D array, NULL cells as zero, and which cells are NULL."""
    flat = column.flatten()
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return values, flat.is_null().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _batch_sums(x, no_x, y, no_y):
    """Sums of products over the rows of a batch, and how many products there are: those without NULL."""
    if not (no_x.any() or no_y.any()):
        return x.T @ y, np.full((x.shape[1], y.shape[1]), float(len(x)))
    n = (~no_x).T.astype("float64") @ (~no_y).astype("float64")
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        # zeros cannot stand for NULL beside infinities
        rows = [np.where(no_x[:, [i]] | no_y, 0.0, x[:, [i]] * y).sum(axis=0) for i in range(x.shape[1])]
        return np.array(rows), n
    return x.T @ y, n


def _partial_products(batches):
    """One k x m partial sum per task, however many rows the task reads."""
    total = count = None
    for batch in batches:
        if batch.num_rows:
            x = _dense(batch.column(0))
            part, n = _batch_sums(*x, *(_dense(batch.column(1)) if batch.num_columns > 1 else x))
            total, count = (part, n) if total is None else (total + part, count + n)
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel()), pa.array(count.ravel().astype("int64"))],
            names=["i", "j", "v", "n"])


def multiply_long(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two long-form matrices ``(i, j, v)``; cell keys must be unique.

    A cell that is absent or NULL adds nothing, whatever stands opposite; a result cell to which nothing is added is
    absent.

    The product is cut into a grid: blocks of rows of ``a``, blocks of columns of ``b``, and bands of what they share. Each
    point of the grid is a task's work, of about ``blockCells`` cells of either side, so the number of bands follows from
    the fullest block as counted. Cells of ``a`` are sent once for each block of columns, those of ``b`` for each of rows.
    """
    spark = a.sparkSession
    side, cells = setting(spark, "blockSide"), setting(spark, "blockCells")
    # aliases, as both may come from one DataFrame
    a, b = (m.where("v is not null").select(*(sf.col(c).alias(c) for c in "ijv")) for m in (a, b))
    fullest = lambda m, c: m.groupBy((sf.floor(sf.col(c) / side)).alias("block")).count().agg(
        sf.max("block"), sf.max("count"), sf.sum("count")).first()
    (rows, row_most, row_all), (columns, column_most, column_all) = fullest(a, "i"), fullest(b, "j")
    if rows is None or columns is None:
        return a.where("false")
    bands = -(-max(row_most, column_most) // cells)
    if row_all + column_all > cells >> 4:  # enough work to be worth a task for every core
        bands = max(bands, spark.sparkContext.defaultParallelism // ((rows + 1) * (columns + 1)))
    block = lambda c: sf.floor(sf.col(c) / side).cast("long")
    band = lambda c: sf.pmod(sf.xxhash64(c), sf.lit(bands))
    every = lambda last: sf.explode(sf.sequence(sf.lit(0).cast("long"), sf.lit(last).cast("long")))
    left = a.select(block("i").alias("r"), every(columns).alias("c"), band("j").alias("b"), "i", "j", "v")
    right = b.select(every(rows).alias("r"), block("j").alias("c"), band("i").alias("b"), "i", "j", "v")
    partial = left.groupBy("r", "c", "b").cogroup(right.groupBy("r", "c", "b")).applyInArrow(_point, _LONG)
    return partial.groupBy("i", "j").agg(sf.sum("v").alias("v"))


#: Products of single cells made at once.
_AT_ONCE = 1 << 21


def _point(left: pa.Table, right: pa.Table) -> pa.Table:
    """The partial product at one point of the grid."""
    (i, k, v), (l, j, w) = ([t.column(c).to_numpy() for c in "ijv"] for t in (left, right))
    shared = np.intersect1d(k, l)
    keep, other = np.isin(k, shared), np.isin(l, shared)
    (i, k, v), (l, j, w) = (i[keep], np.searchsorted(shared, k[keep]), v[keep]), (np.searchsorted(shared, l[other]), j[other], w[other])
    rows, i = np.unique(i, return_inverse=True)
    columns, j = np.unique(j, return_inverse=True)
    dense = min(len(i) / max(1, len(rows) * len(shared)), len(j) / max(1, len(columns) * len(shared))) > 0.05
    if dense and np.isfinite(v).all() and np.isfinite(w).all():
        x, there = _filled((len(rows), len(shared)), i, k, v)
        y, here = _filled((len(shared), len(columns)), l, j, w)
        r, c = np.nonzero(there @ here)  # where any product is
        return pa.table({"i": rows[r], "j": columns[c], "v": (x @ y)[r, c]})
    # zeros cannot stand for absent cells beside infinities, and would be too many: only cells that are there meet
    order = np.argsort(l, kind="stable")
    l, j, w = l[order], j[order], w[order]
    begin = np.searchsorted(l, np.arange(len(shared) + 1))
    times = (begin[1:] - begin[:-1])[k]
    ends = np.cumsum(times)
    parts, at = [], 0
    while at < len(k):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right")))
        number = times[at:to]
        own = np.repeat(np.arange(at, to), number)
        opposite = np.repeat(begin[k[at:to]] - (np.cumsum(number) - number), number) + np.arange(number.sum())
        with np.errstate(invalid="ignore", over="ignore"):
            key, place = np.unique(i[own] * len(columns) + j[opposite], return_inverse=True)
            total = np.zeros(len(key))
            np.add.at(total, place, v[own] * w[opposite])
        parts.append((key, total))
        at = to
    key = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in parts)])
    total = np.concatenate([np.zeros(0), *(t for _, t in parts)])
    return pa.table({"i": rows[key // max(1, len(columns))] if len(key) else key, "j": columns[key % max(1, len(columns))] if len(key) else key, "v": total})


def _filled(shape, i, k, v):
    """Cells as a matrix with zeros, and which of its cells are there."""
    values, there = np.zeros(shape), np.zeros(shape, np.float32)
    values[i, k], there[i, k] = v, 1
    return values, there
