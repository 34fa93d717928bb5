"""Tables, matrices and user functions on one Spark-backed frame object."""

import sys

from pyspark import cloudpickle

from tabframe.functions import (
    AVG, C, CASE, CMP, COL, COUNT, DATE, EXTRACT, F, JOIN, MAX, MIN, Q, SUBSTRING, SUM,
)
from tabframe.operators import Frame, Transposed, multiply_long
from tabframe.sources import Workspace

# Functions sent to executors carry this package's code with them, so that it
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def head(frame, n=5):
    """Print the first rows."""
    print(frame.head(n))


def tail(frame, n=5):
    """Print the last rows."""
    print(frame.tail(n))


def describe(frame):
    """Print the metrics of every column, numbers with two decimals."""
    print(frame.describe().df.toPandas().to_string(float_format="{:.2f}".format, na_rep=""))


def tables(workspace):
    """Print the stored tables."""
    names = workspace._tables()
    names.show(max(1, names.count()), truncate=False)


__all__ = [
    "AVG", "C", "CASE", "CMP", "COL", "COUNT", "DATE", "EXTRACT", "F", "Frame", "JOIN", "MAX",
    "MIN", "Q", "SUBSTRING", "SUM", "Transposed", "Workspace", "describe", "head",
    "multiply_long", "tables", "tail",
]
