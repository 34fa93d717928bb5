"""Outside data as a Spark data source: parts planned on the driver, pruned by the query's filters, read on executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as st
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema

from tabframe.operators.userfunc import as_batch

#: Filters that can rule a part out, with the test that its lowest and highest value must pass for it to stay.
_TESTS: dict[type, Callable] = {
    EqualTo: lambda low, high, v: (low is None or low <= v) and (high is None or v <= high),
    EqualNullSafe: lambda low, high, v: v is None or (low is None or low <= v) and (high is None or v <= high),
    GreaterThan: lambda low, high, v: high is None or high > v,
    GreaterThanOrEqual: lambda low, high, v: high is None or high >= v,
    LessThan: lambda low, high, v: low is None or low < v,
    LessThanOrEqual: lambda low, high, v: low is None or low <= v,
    In: lambda low, high, v: any((low is None or low <= x) and (high is None or x <= high) for x in v if x is not None),
}


def may_hold(bounds: dict, condition) -> bool:
    """Whether a part whose columns lie within ``bounds`` can have rows for a filter; what isn't known may hold."""
    test = _TESTS.get(type(condition))
    column = ".".join(getattr(condition, "attribute", ()))
    if test is None or column not in bounds:
        return True
    try:
        return test(*bounds[column], condition.value)
    except TypeError:  # a bound that can't be compared with the value says nothing
        return True


class Reader(DataSourceReader):
    """Reads the parts that are left, some of them in each task."""

    def __init__(self, parts: list, func: Callable, schema: st.StructType, within: Callable | None, tasks: int):
        self.parts, self.func, self.schema, self.within, self.tasks = parts, func, schema, within, tasks

    def pushFilters(self, filters):
        if self.within:
            self.parts = [p for p in self.parts if all(may_hold(self.within(p), f) for f in filters)]
        return filters  # a part that stays may have other rows as well

    def partitions(self):
        tasks = max(1, min(self.tasks, len(self.parts)))
        return [InputPartition(self.parts[i::tasks]) for i in range(tasks)]

    def read(self, partition) -> Iterator:
        arrow, name = to_arrow_schema(self.schema), getattr(self.func, "__name__", "the loader")
        for part in partition.value:
            result = self.func(part)
            for piece in result if isinstance(result, Iterator) else [result]:
                yield as_batch(piece, name, arrow)


def load(spark: SparkSession, func: Callable, parts, schema: st.StructType, within: Callable | None, tasks: int):
    """A DataFrame over what ``func(part)`` gives for each of ``parts``.

    Nothing is read until rows are asked for, and then only parts that the query's filters on columns of ``within(part)``
    (name to lowest and highest value, None for no bound) leave. Turns on Spark's pushing of filters into Python sources.
    """
    parts, name = list(parts), f"tabframe_{uuid.uuid4().hex}"

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(parts, func, schema, within, tasks)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    return spark.read.format(name).load()
