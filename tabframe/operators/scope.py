"""Compiling expressions against a frame, with subqueries as joins and scalars."""

from __future__ import annotations

import functools
import itertools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as sf

from tabframe.functions.expressions import CMP, Q

_fresh = itertools.count()

_COMPARE = {CMP.GT: operator.gt, CMP.GTE: operator.ge, CMP.LT: operator.lt, CMP.LTE: operator.le}


class Scope:
    """Resolves names of one frame; joins needed by subqueries widen ``rows``."""

    def __init__(self, frame):
        self.cells = frame.cells
        self.rows = frame.rowset.df
        self._frame = frame

    def column(self, name: str) -> Column:
        if name not in self.cells:
            raise AttributeError(f"no column {name!r} among {list(self.cells)}")
        return self.cells[name]

    def kind(self, name: str):
        """The type of a column."""
        return self._frame.schema[name].dataType

    def scalar(self, frame) -> Column:
        """A one-row, one-column frame as a value; more rows fail at run time."""
        return _single(frame).unsorted().scalar()

    # -- ALL / ANY ---------------------------------------------------------

    def quantified(self, left: Column, comparison: CMP, quantifier: str, frame) -> Column:
        """Compare with a whole sub-column by means of its one-row summary."""
        values = _single(frame).unsorted().toDF("v")
        summary = values.agg(
            sf.struct(
                sf.count(sf.lit(1)).alias("n"),
                sf.count_if(sf.col("v").isNull()).alias("nulls"),
                sf.min("v").alias("low"),
                sf.max("v").alias("high"),
            )
        ).scalar()
        compare = _COMPARE[comparison]
        rising = comparison in (CMP.GT, CMP.GTE)
        # ALL must beat the hardest value, ANY only the easiest one.
        edge = summary["high"] if rising == (quantifier == "all") else summary["low"]
        met = compare(left, edge)
        decided, otherwise = (~met, True) if quantifier == "all" else (met, False)
        unknown = sf.lit(None).cast("boolean")
        return (
            sf.when(summary["n"] == 0, sf.lit(otherwise))
            .when(decided, sf.lit(not otherwise))
            .when(left.isNull() | (summary["nulls"] > 0), unknown)
            .otherwise(sf.lit(otherwise))
        )

    # -- IN / EXISTS inside larger predicates ------------------------------

    def member(self, needle: Column, frame) -> Column:
        """Three-valued ``needle IN (frame)``."""
        values = _single(frame).unsorted().toDF("v")
        counts = _null_counts(values)
        found = self._mark([needle], values)
        unknown = sf.lit(None).cast("boolean")
        return (
            sf.when(counts["n"] == 0, sf.lit(False))
            .when(found, sf.lit(True))
            .when(needle.isNull() | (counts["nulls"] > 0), unknown)
            .otherwise(sf.lit(False))
        )

    def exists(self, pairs, frame) -> Column:
        if not pairs:
            return frame.unsorted().exists()
        outer, inner = self._pairs(pairs, frame)
        return self._mark(outer, inner)

    def _pairs(self, pairs, frame):
        pairs = [pairs] if isinstance(pairs, tuple) else list(pairs)
        outer = [self.column(o) for o, _ in pairs]
        return outer, frame.project(tuple({i: f"k{n}"} for n, (_, i) in enumerate(pairs))).unsorted()

    def _mark(self, outer: list[Column], inner) -> Column:
        mark = f"__mark{next(_fresh)}"
        keys, condition = _match(outer, inner)
        self.rows = self.rows.join(keys.withColumn(mark, sf.lit(True)), condition, "left")
        return sf.col(mark).isNotNull()

    # -- IN / EXISTS as a whole condition of a filter ----------------------

    def keep(self, test: Q) -> None:
        """Apply a subquery test to the rows as a semi or anti join."""
        if test.op in (CMP.EXISTS, CMP.NOTEXISTS):
            wanted = test.op is CMP.EXISTS
            if not test.left:
                found = test.right.unsorted().exists()
                self.rows = self.rows.filter(found if wanted else ~found)
                return
            outer, inner = self._pairs(test.left, test.right)
        else:
            wanted = test.op is CMP.IN
            needle = Q(test.left).compile(self)
            outer, inner = [needle], _single(test.right).unsorted().toDF("v")
            if not wanted:
                # NULL passes NOT IN only of nothing; nothing passes if there is a NULL.
                possible = sf.when(needle.isNull(), "empty").otherwise("full")
                self.rows = self.rows.filter(_kind(inner) <= possible)
        keys, condition = _match(outer, inner)
        self.rows = self.rows.join(keys, condition, "left_semi" if wanted else "left_anti")


def _single(frame):
    frame = frame.to_frame() if hasattr(frame, "to_frame") else frame
    if len(frame.cells) != 1:
        raise TypeError("a subquery used as a value must have exactly one column")
    return frame


def _kind(values) -> Column:
    """``empty``, ``full`` (no NULL) or ``null``, in this alphabetical order."""
    kind = (sf.when(sf.count(sf.lit(1)) == 0, "empty")
            .when(sf.count_if(sf.col("v").isNull()) == 0, "full").otherwise("null"))
    return values.agg(kind).scalar()


def _null_counts(values) -> Column:
    null = sf.col("v").isNull()
    counts = sf.struct(sf.count(sf.lit(1)).alias("n"), sf.count_if(null).alias("nulls"))
    return values.agg(counts).scalar()


def _match(outer: list[Column], inner):
    """Distinct non-null inner keys under fresh names, and the equality condition.

    Removing repeats first keeps a hot inner key from reaching one task.
    """
    names = [f"__key{next(_fresh)}" for _ in outer]
    keys = inner.toDF(*names).dropna().distinct()
    condition = functools.reduce(operator.and_, (o == sf.col(n) for o, n in zip(outer, names)))
    return keys, condition
