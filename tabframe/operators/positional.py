"""Operators that go by row position: slices, row picks, stacks, alignment."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as sf

from tabframe.functions.expressions import is_number
from tabframe.operators.relational import items, unique_names
from tabframe.operators.rowset import RowSet
from tabframe.plans.position import POS, Placement
from tabframe.plans.settings import setting


class Positional:
    """Positional part of a frame."""

    def __getitem__(self, item):
        rows, columns = item if isinstance(item, tuple) else (item, None)
        narrowed = self if columns is None else self._columns(columns)
        return narrowed._rows_at(rows)

    def _columns(self, wanted):
        names = list(self.cells)
        if isinstance(wanted, slice):
            chosen = names[wanted]
        else:
            single = isinstance(wanted, (str, int, np.integer))
            chosen = [w if isinstance(w, str) else names[w] for w in ([wanted] if single else wanted)]
        unique_names(chosen)
        missing = [c for c in chosen if c not in self.cells]
        if missing:
            raise KeyError(f"no columns {missing}")
        return self._derive(self.rowset, {c: self.cells[c] for c in chosen}, self.ordered)

    def _rows_at(self, rows):
        if isinstance(rows, (int, np.integer)):
            rows = slice(int(rows), int(rows) + 1 or None)
        if isinstance(rows, slice):
            return self._range(rows)
        if hasattr(rows, "rowset"):
            return self._masked(rows)
        return self._picked_rows(np.asarray(rows))

    def _range(self, wanted: slice):
        first, stop, step = wanted.start or 0, wanted.stop, wanted.step or 1
        short = stop is not None and 0 <= first and 0 <= stop <= setting(self.spark, "topRows") and step > 0
        if short and self.rowset._placement is None and not self.rowset.positional:
            kept = self.rowset.first(stop).filter((sf.col(POS) >= first) & ((sf.col(POS) - first) % step == 0))
            return self._derive(RowSet(kept.withColumn(POS, sf.floor((sf.col(POS) - first) / step))), self.cells)
        placement = self.rowset.placement()
        start, stop, step = wanted.indices(placement.rows)
        count = len(range(start, stop, step))
        low, high = (start, stop - 1) if step > 0 else (stop + 1, start)
        kept = placement.between(low, high)
        offset = (sf.col(POS) - start) if step > 0 else (start - sf.col(POS))
        if abs(step) > 1:
            kept = kept.filter(offset % abs(step) == 0)
        return self._derive(
            RowSet(kept.withColumn(POS, sf.floor(offset / abs(step))), rows=count), self.cells)

    def _masked(self, mask):
        """Rows where a one-column boolean frame of the same length is true."""
        if [f.dataType.simpleString() for f in mask.schema] != ["boolean"]:
            raise IndexError("a mask frame has one boolean column")
        rowset, (mine, theirs) = align([self, mask])
        (wanted,) = theirs.values()
        return self._derive(rowset.with_rows(rowset.df.filter(wanted)), mine)

    def _picked_rows(self, picks: np.ndarray):
        placement = self.rowset.placement()
        n = placement.rows
        if picks.dtype == bool:
            if picks.shape != (n,):
                raise IndexError(f"mask of shape {picks.shape} for {n} rows")
            picks = np.flatnonzero(picks)
        picks = picks.astype("int64").ravel()
        if len(picks) and (picks.min() < -n or picks.max() >= n):
            raise IndexError(f"row position out of range for {n} rows")
        picks = np.where(picks < 0, picks + n, picks)
        wanted = self.spark.createDataFrame(pa.table({"__out": np.arange(len(picks)), POS: picks}))
        near = placement.between(int(picks.min(initial=n)), int(picks.max(initial=-1)))
        rows = near.join(wanted, POS).drop(POS).withColumnRenamed("__out", POS)
        return self._derive(RowSet(rows, rows=len(picks)), self.cells)

    def vstack(self, otherdatalist):
        """Other frames (or dicts of arrays) below this one, matched by column order."""
        others = items(otherdatalist)
        parts = [self, *(p if hasattr(p, "rowset") else array_frame(self.spark, p) for p in map(wide, others))]
        width = len(self.cells)
        if any(len(p.cells) != width for p in parts):
            raise TypeError(f"every frame must have {width} columns")
        names = list(self.cells)
        rows = _union([p.unsorted().toDF(*names) for p in parts])

        def place():
            moved, total = [], 0
            for part in parts:
                placed = part.positions()
                moved.append(placed.toDF(POS, *names).withColumn(POS, sf.col(POS) + total))
                total += part.rowset.count()
            return Placement(_union(moved), total)

        return self._of(rows, place=place)

    def hstack(self, otherdatalist, colprefixlist=None):
        """Other frames to the right, row by row; all must have the same length."""
        frames = [self, *map(wide, items(otherdatalist))]
        prefixes = colprefixlist or [None] * len(frames)
        if len(prefixes) != len(frames):
            raise ValueError(f"{len(frames)} frames need {len(frames)} prefixes")
        rowset, aligned = align(frames)
        cells = [(f"{p or ''}{name}", cell)
                 for p, part in zip(prefixes, aligned) for name, cell in part.items()]
        unique_names(name for name, _ in cells)
        return self._derive(rowset, dict(cells))

    @property
    def rowNames(self):
        """Row labels as a one-column frame."""
        label = sf.format_string("r_%010d", sf.col(POS)).alias("row_name")
        return self._of(self.rowset.positioned().select(POS, label), rows=self.rowset.count())


def wide(value):
    """A transposed view as the frame it stands for; anything else unchanged."""
    return value.to_frame() if hasattr(value, "to_frame") else value


def _union(dataframes):
    return functools.reduce(lambda a, b: a.union(b), dataframes)


def align(frames):
    """One row set holding all frames side by side, and each frame's cells on it.

    Frames over the same rows need no join.  Others are joined on position.
    """
    rowsets = list(dict.fromkeys(f.rowset for f in frames))
    if len(rowsets) == 1:
        return rowsets[0], [f.cells for f in frames]
    sides, cells = [], [None] * len(frames)
    for number, rowset in enumerate(rowsets):
        columns = {}
        for which, frame in enumerate(frames):
            if frame.rowset is rowset:
                hidden = {name: f"__c{which}_{i}" for i, name in enumerate(frame.cells)}
                columns.update({hidden[n]: cell for n, cell in frame.cells.items()})
                cells[which] = {n: sf.col(h) for n, h in hidden.items()}
        sides.append(rowset.positioned().select(POS, *(c.alias(h) for h, c in columns.items())))
    lengths = {rowset.count() for rowset in rowsets}
    if len(lengths) > 1:
        raise ValueError(f"frames of different lengths {sorted(lengths)} cannot be aligned")
    joined = functools.reduce(lambda a, b: a.join(b, POS), sides)
    return RowSet(joined, rows=lengths.pop()), cells


def array_frame(spark, data, names=None):
    """A frame of driver-side arrays: a dict of columns or a 1-D or 2-D array."""
    from tabframe.operators.frame import Frame

    if not isinstance(data, dict):
        matrix = np.asarray(data)
        matrix = matrix.reshape(-1, 1) if matrix.ndim == 1 else matrix
        names = names or [f"r_{j:010d}" for j in range(matrix.shape[1])]
        data = {name: matrix[:, j] for j, name in enumerate(names)}
    columns = {name: pa.array(np.asarray(values)) for name, values in data.items()}
    lengths = {len(v) for v in columns.values()}
    if len(lengths) != 1:
        raise TypeError("columns of different lengths")
    n = lengths.pop()
    table = pa.table({POS: pa.array(np.arange(n, dtype="int64")), **columns})
    return Frame.of(spark.createDataFrame(table), rows=n)


def is_scalar(value) -> bool:
    return is_number(value) or (isinstance(value, np.ndarray) and value.ndim == 0)
