from tabframe.functions.aggregates import AVG, COUNT, MAX, MIN, SUM, Aggregate
from tabframe.functions.expressions import (
    ARITH, C, CASE, CMP, COL, DATE, EXTRACT, F, JOIN, Q, SUBSTRING, Expression,
)

__all__ = [
    "ARITH", "AVG", "Aggregate", "C", "CASE", "CMP", "COL", "COUNT", "DATE", "EXTRACT",
    "Expression", "F", "JOIN", "MAX", "MIN", "Q", "SUBSTRING", "SUM",
]
