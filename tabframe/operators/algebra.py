"""Element-wise arithmetic on all columns of a frame at once."""

from __future__ import annotations

import operator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as sf
from pyspark.sql import types as st

from tabframe.functions.expressions import is_number, plain_number
from tabframe.operators.positional import align, array_frame, is_scalar, wide


def _divide(a: Column, b: Column) -> Column:
    """True division; NULL where the divisor is zero."""
    return sf.try_divide(a.cast("double"), b.cast("double"))


class Algebra:
    """Algebraic part of a frame: scalars, frames and arrays on either side.

    Scalar chains and frames over the same rows become one projection.  Whole
    numbers are widened to 64 bits; division and powers are done in doubles.
    """

    def numeric_cells(self) -> dict[str, Column]:
        cells = {}
        for field in self.schema:
            if isinstance(field.dataType, st.IntegralType):
                cells[field.name] = self.cells[field.name].cast("bigint")
            elif isinstance(field.dataType, (st.FractionalType, st.DecimalType)):
                cells[field.name] = self.cells[field.name]
            else:
                raise TypeError(f"column {field.name} of type {field.dataType.simpleString()} is not numeric")
        return cells

    def _combine(self, other, op, swapped=False):
        other = wide(other)
        if is_scalar(other):
            scalar = _scalar(other)
            other_cells = {name: scalar for name in self.cells}
            return self._elementwise(self.rowset, self.numeric_cells(), other_cells, op, swapped)
        if isinstance(other, np.ndarray):
            row = other.shape == (1, len(self.cells))
            if row:
                other_cells = {n: _scalar(v) for n, v in zip(self.cells, other[0])}
                return self._elementwise(self.rowset, self.numeric_cells(), other_cells, op, swapped)
            other = array_frame(self.spark, other)
        if not hasattr(other, "numeric_cells"):
            return NotImplemented
        numbers = [f._derive(f.rowset, f.numeric_cells()) for f in (self, other)]
        rowset, (mine, theirs) = align(numbers)
        return self._elementwise(rowset, mine, theirs, op, swapped)

    def _elementwise(self, rowset, mine, theirs, op, swapped):
        """Pair columns by order; a single column goes with every other column."""
        a, b = list(mine.values()), list(theirs.values())
        names = list(mine if len(a) >= len(b) else theirs)
        if len(a) != len(b) and 1 not in (len(a), len(b)):
            raise ValueError(f"{len(a)} and {len(b)} columns cannot be combined")
        a, b = (side * len(names) if len(side) == 1 else side for side in (a, b))
        pairs = zip(b, a) if swapped else zip(a, b)
        return self._derive(rowset, {n: op(x, y) for n, (x, y) in zip(names, pairs)})

    def __add__(self, other):
        return self._combine(other, operator.add)

    def __radd__(self, other):
        return self._combine(other, operator.add, swapped=True)

    def __sub__(self, other):
        return self._combine(other, operator.sub)

    def __rsub__(self, other):
        return self._combine(other, operator.sub, swapped=True)

    def __mul__(self, other):
        return self._combine(other, operator.mul)

    def __rmul__(self, other):
        return self._combine(other, operator.mul, swapped=True)

    def __truediv__(self, other):
        return self._combine(other, _divide)

    def __rtruediv__(self, other):
        return self._combine(other, _divide, swapped=True)

    def __pow__(self, power, modulo=None):
        if not is_number(power):
            raise TypeError(f"cannot use {type(power).__name__} as a power")
        return self._combine(power, lambda base, p: sf.pow(base.cast("double"), p.cast("double")))

    def __matmul__(self, other):
        from tabframe.operators.matrix import multiply

        return multiply(self, other)

    def __rmatmul__(self, other):
        from tabframe.operators.matrix import multiply

        return multiply(other, self)

    @property
    def T(self):
        """The transpose, kept as a view until it is used."""
        from tabframe.operators.matrix import Transposed

        return Transposed(self)

    def to_matrix(self):
        """The same columns, all as doubles; NULL stays NULL."""
        kinds = {f.name: f.dataType for f in self.schema}
        cells = {n: c if isinstance(kinds[n], st.DoubleType) else c.cast("double")
                 for n, c in self.numeric_cells().items()}
        return self._derive(self.rowset, cells, self.ordered)

    @property
    def matrix(self) -> np.ndarray:
        """The cells as an n x k array on the driver, bounded like ``cdata``."""
        names = list(self.cells)
        data = self.to_matrix().cdata
        return np.column_stack([data[n].to_numpy() for n in names])


def _scalar(value) -> Column:
    number = plain_number(value.item() if isinstance(value, np.ndarray) else value)
    return sf.lit(number).cast("bigint") if isinstance(number, int) else sf.lit(number)
