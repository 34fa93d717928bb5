"""User Python functions over tables, matrices and groups.

Functions run on Arrow batches inside tasks.  None of them ever sees a whole
table or a whole group: what a function must know of a table or group is folded
from partial states first, and the state is handed to every batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as sf
from pyspark.sql import types as st
from pyspark.sql.pandas.types import to_arrow_schema

from tabframe.functions.expressions import is_frame
from tabframe.operators.relational import items
from tabframe.plans.durable import durable
from tabframe.plans.fold import fold
from tabframe.plans.position import named
from tabframe.plans.settings import setting

#: Rows of a task's first batch on which a function shows that it looks at single rows only.
PROBED = 32


class Batch:
    """Some rows of a frame as arrays, as a user function sees them."""

    def __init__(self, data: pa.RecordBatch):
        self._data = data

    @property
    def rows(self) -> dict[str, np.ndarray]:
        """Columns as arrays; numbers with NULLs as masked arrays."""
        return {name: _numpy(self._data.column(i)) for i, name in enumerate(self.columns)}

    @property
    def matrix(self) -> np.ndarray:
        """All columns as one n x c float64 array, NULL as NaN."""
        columns = (c.cast(pa.float64()).fill_null(np.nan) for c in self._data.columns)
        return np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])

    @property
    def columns(self) -> list[str]:
        return self._data.schema.names

    def __len__(self):
        return self._data.num_rows


class _Whole:
    """A batch whose columns become arrays once, for all its parts."""

    def __init__(self, data: pa.RecordBatch):
        self.data, self.arrays = data, None

    def part(self, start: int, stop: int) -> Batch:
        return _Part(self, start, stop)

    def rows(self, start: int, stop: int) -> dict[str, np.ndarray]:
        if self.arrays is None:
            self.arrays = [(name, *_masked(_numpy(self.data.column(i)))) for i, name in enumerate(self.data.schema.names)]
        out = {}
        for name, values, mask in self.arrays:
            values = values[start:stop]
            if mask is not None and mask[start:stop].any():
                values = np.ma.MaskedArray(values, mask[start:stop])
            out[name] = values
        return out


class _Part(Batch):
    """Rows of a batch next to each other."""

    def __init__(self, whole: _Whole, start: int, stop: int):
        self._whole, self._start, self._stop = whole, start, stop

    @property
    def _data(self):
        return self._whole.data.slice(self._start, len(self))

    @property
    def rows(self) -> dict[str, np.ndarray]:
        return self._whole.rows(self._start, self._stop)

    @property
    def columns(self) -> list[str]:
        return self._whole.data.schema.names

    def __len__(self):
        return self._stop - self._start


def _masked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    return (values.data, np.ma.getmaskarray(values)) if isinstance(values, np.ma.MaskedArray) else (values, None)


def _numpy(column: pa.Array) -> np.ndarray:
    kind = column.type
    number = pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)
    if not (number and column.null_count):
        return column.to_numpy(zero_copy_only=False)
    filled = column.fill_null(False if pa.types.is_boolean(kind) else 0)
    mask = column.is_null().to_numpy(zero_copy_only=False)
    return np.ma.MaskedArray(filled.to_numpy(zero_copy_only=False), mask)


def as_columns(result, who: str) -> dict[str, np.ndarray]:
    """Check a function result: a dict of arrays or ``(matrix, names)``."""
    if isinstance(result, dict):
        return {n: v if isinstance(v, np.ma.MaskedArray) else np.asarray(v) for n, v in result.items()}
    if isinstance(result, tuple) and len(result) == 2:
        matrix, names = result
        if matrix.shape[1] != len(names):
            raise TypeError(f"{who} returned {matrix.shape[1]} columns but {len(names)} names")
        return {name: matrix[:, j] for j, name in enumerate(names)}
    raise TypeError(f"{who} must return a dict of arrays or a (matrix, names) pair")


def as_batch(result, who: str, schema: pa.Schema) -> pa.RecordBatch:
    """A checked result in the order and with the types of the declared schema."""
    columns = as_columns(result, who)
    if set(columns) != set(schema.names):
        raise TypeError(f"{who} returned columns {list(columns)} but the schema has {schema.names}")
    return pa.RecordBatch.from_arrays([_arrow(columns[f.name], f.type) for f in schema], schema=schema)


def _arrow(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if isinstance(values, np.ma.MaskedArray):
        return pa.array(values.data, mask=np.ma.getmaskarray(values)).cast(kind)
    return pa.array(values.tolist(), kind) if values.dtype == object else pa.array(values).cast(kind)


def parse_schema(schema) -> st.StructType:
    return schema if isinstance(schema, st.StructType) else st.StructType.fromDDL(schema)


class UserFunctions:
    """User-function part of a frame."""

    def _U(self, func: Callable, *args, schema=None, state=None, **kwargs):
        """Apply ``func``.

        Without a ``schema`` it gets the frame itself, and returns a frame (more plan). With one it runs on the
        executors: see ``map_batches``.
        """
        if schema is None:
            result = func(self, *args, **kwargs)
            if not is_frame(result):
                raise TypeError(f"{func.__name__} returned no frame; give a schema to run it on batches")
            return result
        return self.map_batches(func, *args, schema=schema, state=state, **kwargs)

    def map_batches(self, func: Callable, *args, schema, state=None, check: bool = True, **kwargs):
        """Apply ``func`` to one ``Batch`` at a time; it returns a dict of arrays or ``(matrix, names)``.

        Where batches end says nothing about the data, so each row's result must follow from the row alone, and from
        ``state``, which is handed to ``func`` after the batch: what it must know of the whole table (see ``fold``). A
        function that looks at other rows of its batch is found out on the first rows and raises; ``check=False`` lets
        it pass, for functions that draw random numbers.
        """
        schema = parse_schema(schema)
        arrow = to_arrow_schema(schema)
        name = getattr(func, "__name__", "the function")
        extra = args if state is None else (state, *args)
        apply = lambda data: as_batch(func(Batch(data), *extra, **kwargs), name, arrow)

        def run(batches):
            unknown = check
            for data in batches:
                if unknown and data.num_rows > 1:
                    _look_at_rows(apply, data, name)
                    unknown = False
                yield apply(data)

        return self._of(self.unsorted().mapInArrow(run, schema))

    def map_matrix(self, func: Callable, *args, cols=None, state=None, check: bool = True, **kwargs):
        """Apply ``func`` to n x c arrays; results go back under the old names or ``cols``.

        NULL cells are NaN in the arrays, and NaN in the result becomes NULL. An array has some rows of the frame; the
        rules of ``map_batches`` hold, also for ``state``.
        """
        names = list(cols or self.cells)
        schema = st.StructType([st.StructField(n, st.DoubleType()) for n in names])

        def on_matrix(batch: Batch, *extra):
            return _nullable(func(batch.matrix, *extra, **kwargs)), names

        on_matrix.__name__ = getattr(func, "__name__", "the function")
        return self.to_matrix().map_batches(on_matrix, *args, schema=schema, state=state, check=check)

    _XP = map_matrix

    def fold(self, partial: Callable, merge: Callable, finish: Callable | None = None):
        """A value folded from all rows, for use as a ``state``.

        ``partial(batch)`` summarizes some rows as any picklable state; ``merge(a, b)`` puts two states together and
        must be associative and commutative; ``finish(state)`` turns the last one into the result, else it is the state.
        A table without rows has the state of a batch without rows.

        Each task folds its rows into one state. States are merged in a tree, a bounded number at a time, and none may be
        larger than ``foldBytes``, so a state that grows with the table raises instead of filling a task or the driver.
        """
        frame = self.unsorted()
        state = fold(frame, lambda data: partial(Batch(data)), merge)
        state = partial(Batch(_no_rows(frame.schema))) if state is None else state
        return finish(state) if finish else state

    def map_matrices(self, func: Callable, others: Iterable = (), results: dict | None = None, keep=(), state=None, check=True):
        """Several matrices in and out: this frame's rows stream by, ``others`` are there whole.

        ``func(matrix, *others)`` (or ``func(matrix, state, *others)``) gets some rows as an n x c array and each of
        ``others`` (frames or arrays of at most ``smallCells`` cells) as a whole array in row order; it returns a dict of
        arrays by name. ``results`` declares them: name to column names. Columns of ``keep`` stay beside every result that
        has a row for each row of the frame; other results have the rows they have. Returns a dict of frames.

        The frame is read and the function run once for all results, which are kept in shared storage.
        """
        small = [_whole(other) for other in others]
        keep = items(keep) if keep else []
        kinds = {f.name: f for f in self.schema}
        missing = [k for k in keep if k not in kinds]
        if missing:
            raise AttributeError(f"no columns {missing}")
        kept = [kinds[k] for k in keep]
        tags = list(results)
        values = st.ArrayType(st.DoubleType())
        schema = st.StructType([st.StructField("tag", st.IntegerType()), st.StructField("cells", values), *kept])
        arrow = to_arrow_schema(schema)
        source = self._derive(self.rowset, {n: c for n, c in self.cells.items() if n not in keep}).to_matrix()
        extra = small if state is None else [state, *small]
        who = getattr(func, "__name__", "the function")
        width = len(source.cells)

        def apply(data):
            found = func(Batch(data.select(range(width))).matrix, *extra)
            if not isinstance(found, dict) or set(found) != set(tags):
                raise TypeError(f"{who} must return a dict with the results {tags}")
            out = []
            for tag, name in enumerate(tags):
                cells = _nullable(found[name])
                if cells.shape[1] != len(results[name]):
                    raise TypeError(f"{who} returned {cells.shape[1]} columns for {name}, not {len(results[name])}")
                if keep and len(cells) != data.num_rows:
                    raise TypeError(f"{who} returned {len(cells)} rows for {name}; only rows of the frame have {keep}")
                offsets = np.arange(len(cells) + 1, dtype="int32") * cells.shape[1]
                lists = pa.ListArray.from_arrays(offsets, pa.array(cells.data.ravel(), mask=np.ma.getmaskarray(cells).ravel()))
                beside = [data.column(width + i) for i in range(len(keep))]
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), tag, "int32")), lists.cast(arrow.field("cells").type), *beside], schema=arrow))
            return pa.Table.from_batches(out, arrow).combine_chunks()

        def run(batches):
            unknown = check
            for data in batches:
                if unknown and data.num_rows > 1:
                    _look_at_rows(apply, data, who, "tag")
                    unknown = False
                yield from apply(data).to_batches()

        rows = source.rowset.df.select(*source._selected(), *(self.cells[k].alias(k) for k in keep))
        found = durable(rows.mapInArrow(run, schema))
        return {name: self._of(found.where(sf.col("tag") == tag).select(
            *(named(k) for k in keep), *(sf.get("cells", sf.lit(j)).alias(c) for j, c in enumerate(results[name]))))
            for tag, name in enumerate(tags)}

    def fold_groups(self, by, partial: Callable, merge: Callable, state, finish: Callable, schema):
        """Fold every group from partial states.

        ``partial(batch)`` summarizes some rows of one group as a dict of values;
        ``merge(states)`` does the same for a batch of earlier states and must be
        associative and commutative; ``finish(state)`` gives the result dict.
        ``state`` and ``schema`` declare their columns, without the group's.

        Each task sorts some of its rows by group and summarizes the slices. States
        are shuffled and sorted by group, under several salts first, and merged as
        they stream by, ``mergeFanIn`` at a time: no task ever holds a group.
        """
        by = items(by)
        kinds = {f.name: f for f in self.schema}
        keys = [kinds[k] for k in by]
        state, schema = parse_schema(state), parse_schema(schema)
        states, results = st.StructType(keys + state.fields), st.StructType(keys + schema.fields)
        fan = setting(self.spark, "mergeFanIn")

        def summarize(batches):
            for chunk in _chunks(batches):
                chunk, first = _sorted_by(chunk, by)
                ends = [*first[1:], chunk.num_rows]
                whole = _Whole(chunk)
                found = [partial(whole.part(a, b)) for a, b in zip(first, ends)]
                yield _lines(chunk, by, first, found, to_arrow_schema(states))

        def merge_some(batches):
            return _merged(batches, by, merge, fan, to_arrow_schema(states))

        def merge_all(batches):
            for batch in _merged(batches, by, merge, fan, to_arrow_schema(states)):
                found = [finish(values) for values in batch.select(state.names).to_pylist()]
                yield _lines(batch, by, range(batch.num_rows), found, to_arrow_schema(results))

        keyed = [named(k) for k in by]
        parts = self.unsorted().mapInArrow(summarize, states)
        salted = parts.withColumn("__salt", sf.spark_partition_id() % fan).repartition(*keyed, "__salt").drop("__salt")
        merged = salted.sortWithinPartitions(*keyed).mapInArrow(merge_some, states)
        return self._of(merged.repartition(*keyed).sortWithinPartitions(*keyed).mapInArrow(merge_all, results))


#: Rows and bytes of a task that are sorted by group at once.
_CHUNK_ROWS, _CHUNK_BYTES = 1 << 17, 1 << 26


def _chunks(batches):
    """Batches put together to larger ones."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= _CHUNK_ROWS or size >= _CHUNK_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _codes(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """A number for each row that is equal where all of ``by`` are; NULL is a value like others."""
    out = np.zeros(batch.num_rows, np.int64)
    for k in by:
        own = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out = np.unique(out * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return out


def _sorted_by(batch: pa.RecordBatch, by: list[str]) -> tuple[pa.RecordBatch, list[int]]:
    """The rows group by group, and where groups start."""
    codes = _codes(batch, by)
    order = np.argsort(codes, kind="stable")
    return batch.take(pa.array(order)), _starts(codes[order])


def _starts(codes: np.ndarray) -> list[int]:
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    return np.flatnonzero(new).tolist()


def _merged(batches, by, merge, fan: int, arrow: pa.Schema):
    """States in order of their group, streaming by, as one state a group; the last group of a batch waits for the next."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        first = _starts(_codes(batch, by))
        if first[1:]:
            yield _settled(batch.slice(0, first[-1]), first[:-1], by, merge, fan, arrow)
        rest = batch.slice(first[-1])
        if rest.num_rows >= fan:
            rest = _settled(rest, [0], by, merge, fan, arrow)
    if rest is not None:
        yield _settled(rest, [0], by, merge, fan, arrow)


def _settled(batch, first, by, merge, fan, arrow) -> pa.RecordBatch:
    """One state for each run of rows; a state that is alone is the result."""
    first = np.asarray(first, np.int64)
    ends = np.append(first[1:], batch.num_rows)
    alone = ends - first == 1
    values, found = batch.select(arrow.names[len(by):]), []
    whole = _Whole(values)
    for a, b in zip(first[~alone].tolist(), ends[~alone].tolist()):
        if b - a <= fan:
            found.append(merge(whole.part(a, b)))
            continue
        some = values.slice(a, b - a)
        while some.num_rows > 1:
            lines = [merge(Batch(some.slice(i, fan))) for i in range(0, some.num_rows, fan)]
            some = _lines(some, [], range(len(lines)), lines, values.schema)
        found.append(_row(some, 0))
    merged = _lines(batch, by, first[~alone], found, arrow)
    if not alone.any():
        return merged
    at = pa.array(first[alone])
    kept = pa.RecordBatch.from_arrays([batch.column(f.name).take(at).cast(f.type) for f in arrow], schema=arrow)
    order = np.argsort(np.concatenate([first[alone], first[~alone]]))
    return pa.Table.from_batches([kept, merged]).take(pa.array(order)).combine_chunks().to_batches()[0]


def _row(batch: pa.RecordBatch, i: int) -> dict:
    return {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}


def _lines(batch, by, at, found: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    """Groups of ``batch`` at some rows beside values found for them."""
    keys = [batch.column(k).take(pa.array(list(at), pa.int64())).cast(arrow.field(k).type) for k in by]
    rest = [pa.array([_plain(values[f.name]) for values in found], f.type) for f in list(arrow)[len(by):]]
    return pa.RecordBatch.from_arrays(keys + rest, schema=arrow)


def _no_rows(schema: st.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in arrow], schema=arrow)


def _nullable(result) -> np.ma.MaskedArray:
    """A matrix of a user function, NaN as NULL; one dimension is one column."""
    if isinstance(result, np.ma.MaskedArray):
        result = result.astype("float64").filled(np.nan)
    result = np.asarray(result, dtype="float64")
    result = result.reshape(-1, 1) if result.ndim < 2 else result
    return np.ma.MaskedArray(result, np.isnan(result))


def _whole(other) -> np.ndarray:
    """A small matrix as one array, rows in order."""
    if isinstance(other, np.ndarray):
        cells, limit = other.size, None
        return np.atleast_2d(other)
    if hasattr(other, "to_frame"):
        other = other.to_frame()
    limit = setting(other.spark, "smallCells")
    cells = other.numRows * len(other.cells)
    if cells > limit:
        raise ValueError(f"{cells} cells are too many to be with every batch (smallCells is {limit})")
    values = other.to_matrix()
    ordered = values.rowset.keys or values.rowset.positional or values.rowset.scan
    if not ordered and other.numRows > 1:
        raise ValueError("the rows of a whole matrix need an order; call order(..) first")
    table = (values.positions().orderBy("__pos").drop("__pos") if ordered else values.unsorted()).toArrow()
    return np.column_stack([c.to_numpy().astype("float64") for c in table.columns]) if table.num_columns else np.zeros((0, 0))


def _look_at_rows(apply, data, who: str, by: str | None = None):
    """Raise if the first rows have other results together than in two parts; results named in ``by`` are put together."""
    rows = min(data.num_rows, PROBED)
    cuts = [(0, rows), (0, rows // 2), (rows // 2, rows - rows // 2)]
    whole, *parts = (apply(data.slice(*cut)).to_pylist() for cut in cuts)
    parts = [line for part in parts for line in part]
    if by:
        parts.sort(key=lambda line: line[by])
    if len(whole) != len(parts) or not all(_close(x[c], y[c]) for x, y in zip(whole, parts) for c in x):
        raise ValueError(f"{who} looks at other rows of its batch, which are there by chance: fold a state of the whole table and "
                         "give it as state=, or use check=False if its results are random")


def _close(x, y) -> bool:
    if isinstance(x, list) and isinstance(y, list):
        return len(x) == len(y) and all(map(_close, x, y))
    if isinstance(x, float) and isinstance(y, float):
        return x == y or (x != x and y != y) or abs(x - y) <= 1e-9 * max(abs(x), abs(y))
    return x == y


def _plain(value):
    """The Python value behind a NumPy scalar; a masked one is NULL."""
    if value is np.ma.masked:
        return None
    return value.item() if isinstance(value, np.generic) else value
