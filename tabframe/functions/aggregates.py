"""Aggregate functions used by ``Frame.aggregate``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as sf
from pyspark.sql.types import IntegralType


class Aggregate:
    """One aggregate over one named column, optionally over its distinct values."""

    kind = ""

    def __init__(self, srcColName: str, distinct: bool = False):
        self.source, self.distinct = srcColName, distinct

    def default_alias(self) -> str:
        return f"{self.kind}_{'' if self.source == '*' else self.source}"

    def compile(self, scope) -> Column:
        column = scope.column(self.source)
        return self.over_distinct(column) if self.distinct else self.over_all(column)

    def over_all(self, column: Column) -> Column:
        raise NotImplementedError

    def over_distinct(self, column: Column) -> Column:
        raise NotImplementedError


class COUNT(Aggregate):
    """Non-null values, or rows for ``"*"``."""

    kind = "count"

    def compile(self, scope):
        return sf.count(sf.lit(1)) if self.source == "*" else super().compile(scope)

    def over_all(self, column):
        return sf.count(column)

    def over_distinct(self, column):
        return sf.count_distinct(column)


class SUM(Aggregate):
    kind = "sum"

    def over_all(self, column):
        return sf.sum(column)

    def over_distinct(self, column):
        return sf.sum_distinct(column)


class AVG(Aggregate):
    kind = "avg"

    def over_all(self, column):
        return sf.avg(column)

    def compile(self, scope):
        column = scope.column(self.source)
        if not self.distinct:
            return sf.avg(column)
        # whole numbers are summed as decimals: their sum may have more than 64 bits where their mean hasn't
        whole = isinstance(scope.kind(self.source), IntegralType)
        total = sf.sum_distinct(column.cast("decimal(38,0)")).cast("double") if whole else sf.sum_distinct(column)
        return total / sf.count_distinct(column)


class MIN(Aggregate):
    kind = "min"

    def over_all(self, column):
        return sf.min(column)

    over_distinct = over_all


class MAX(Aggregate):
    kind = "max"

    def over_all(self, column):
        return sf.max(column)

    over_distinct = over_all
