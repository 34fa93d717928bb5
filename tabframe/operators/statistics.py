"""Column summaries and ``describe``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as sf
from pyspark.sql import types as st

from tabframe.operators.relational import items
from tabframe.plans.position import POS
from tabframe.plans.quantiles import exact_quantiles
from tabframe.plans.settings import setting

# The metrics of describe, in order.
METRICS = ["count", "unique", "nulls", "max", "min", "avg", "median", "25%", "50%", "75%", "stddev"]
_POINTS = {"median": 0.5, "25%": 0.25, "50%": 0.5, "75%": 0.75}


def nulls(column: Column) -> Column:
    return sf.count_if(column.isNull())


class Statistics:
    """Statistics part of a frame; each summary is one pass and one row."""

    def _summary(self, function, collist, numbers_only=False):
        names = list(self.cells) if collist is None else items(collist)
        types = {f.name: f.dataType for f in self.schema}
        missing = [n for n in names if n not in types]
        if missing:
            raise AttributeError(f"no columns {missing}")
        columns = [
            sf.lit(None).cast("double").alias(n)
            if numbers_only and not isinstance(types[n], st.NumericType)
            else function(self.cells[n]).alias(n)
            for n in names
        ]
        return self._of(self.rowset.df.agg(*columns), rows=1)

    def sum(self, collist=None):
        return self._summary(sf.sum, collist, numbers_only=True)

    def avg(self, collist=None):
        return self._summary(sf.avg, collist, numbers_only=True)

    def count(self, collist=None):
        return self._summary(sf.count, collist)

    def countd(self, collist=None, approximate=False):
        return self._summary(sf.approx_count_distinct if approximate else sf.count_distinct, collist)

    def countn(self, collist=None):
        """How many values are NULL."""
        return self._summary(nulls, collist)

    def max(self, collist=None):
        return self._summary(sf.max, collist)

    def min(self, collist=None):
        return self._summary(sf.min, collist)

    def value(self):
        """The single row of a summary: one value, or a dict by column."""
        rows = self.unsorted().head(2)
        if len(rows) != 1:
            raise ValueError("value() needs exactly one row")
        return rows[0][0] if len(self.cells) == 1 else rows[0].asDict()

    def quantiles(self, points, collist=None):
        """Exact quantiles as a frame: a row per point, in the order given, with ``point`` and the columns as doubles; NULL
        for a column without values."""
        names = list(self.numeric_cells()) if collist is None else items(collist)
        points = [float(p) for p in points]
        found = exact_quantiles(self.rowset.df, {n: self.cells[n] for n in names}, points)
        lines = [(i, p, *(found.get((n, p)) for n in names)) for i, p in enumerate(points)]
        schema = st.StructType([st.StructField(POS, st.LongType()), st.StructField("point", st.DoubleType()),
                                *(st.StructField(n, st.DoubleType()) for n in names)])
        return self._of(self.spark.createDataFrame(lines, schema), rows=len(points))

    def describe(self):
        """Eleven metrics by row, the columns by column: doubles for numeric columns, whole text for others, NULL where a
        metric has no meaning."""
        numbers = [f.name for f in self.schema if isinstance(f.dataType, st.NumericType)]
        # few values are ranked within the one aggregation below, which is the same but for the passes
        large = numbers and self.numRows > setting(self.spark, "exactQuantileRows")
        points = exact_quantiles(self.rowset.df, {n: self.cells[n] for n in numbers}, sorted(set(_POINTS.values()))) if large else None
        measured, lines = [], []
        for c, name in enumerate(self.cells):
            for metric, column in _metrics(name, self.cells[name], name in numbers, points):
                measured.append(column.alias(f"{metric}_{c}"))
        for position, metric in enumerate(METRICS):
            values = [
                (sf.col(f"{metric}_{c}") if n in numbers or position < 5 else sf.lit(None)).cast(
                    "double" if n in numbers else "string").alias(n)
                for c, n in enumerate(self.cells)
            ]
            lines.append(sf.struct(sf.lit(position).cast("bigint").alias(POS),
                                   sf.lit(metric).alias("metric"), *values))
        row = self.rowset.df.agg(*measured)
        return self._of(row.select(sf.inline(sf.array(*lines))), rows=len(METRICS))


def _metrics(name, cell, numeric, points):
    yield "count", sf.count(cell)
    yield "unique", sf.count_distinct(cell)
    yield "nulls", nulls(cell)
    yield "max", sf.max(cell)
    yield "min", sf.min(cell)
    if numeric:
        yield "avg", sf.avg(cell)
        for metric, point in _POINTS.items():
            known = points is not None and sf.lit(points.get((name, point))).cast("double")
            yield metric, known if points is not None else sf.percentile(cell, sf.lit(point))
        yield "stddev", sf.stddev_pop(cell)
