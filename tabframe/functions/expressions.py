"""Column expressions for predicates (``Q``) and projections (``F``).

Expressions are small immutable trees built by the caller.  ``compile(scope)``
turns a tree into a ``pyspark.sql.Column``; the scope resolves visible column
names and knows how to bring a sub-frame into the plan.  No SQL text is built,
so literals never need quoting.
"""

from __future__ import annotations

import datetime
import functools
import operator
from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as sf


class JOIN(Enum):
    """Join kinds; the value is the Spark join type."""

    INNER = INNER_JOIN = JOIN = "inner"
    LEFT = LEFT_OUTER = LEFT_OUTER_JOIN = "left"
    RIGHT = RIGHT_OUTER = RIGHT_OUTER_JOIN = "right"
    OUTER = FULL_OUTER = FULL_OUTER_JOIN = "full"
    CROSS_JOIN = "cross"


class COL(Enum):
    """Which columns of a join side survive."""

    NONE = "none"
    ALL = "all"


class CMP(Enum):
    """Comparison, membership and logical operators of a predicate."""

    EQ = EQUAL = "eq"
    NE = NOTEQUAL = "ne"
    GT = GREATERTHAN = "gt"
    GTE = GREATERTHANOREQUAL = "gte"
    LT = LESSTHAN = "lt"
    LTE = LESSTHANOREQUAL = "lte"
    GTALL, GTEALL, LTALL, LTEALL = "gt all", "gte all", "lt all", "lte all"
    GTANY, GTEANY, LTANY, LTEANY = "gt any", "gte any", "lt any", "lte any"
    IN, NOTIN = "in", "not in"
    EXISTS, NOTEXISTS = "exists", "not exists"
    LIKE, NOTLIKE = "like", "not like"
    NULL = NL = "null"
    NOTNULL = NNL = "not null"
    AND, OR, NOT = "and", "or", "not"


class ARITH(Enum):
    """Arithmetic shared by predicates and projections."""

    ADD, SUBTRACT, MULTIPLY, DIVIDE, NEGATIVE = "add", "sub", "mul", "div", "neg"


_ARITHMETIC = {
    ARITH.ADD: operator.add,
    ARITH.SUBTRACT: operator.sub,
    ARITH.MULTIPLY: operator.mul,
    ARITH.DIVIDE: operator.truediv,
}


def _verbatim(pattern: Column) -> Column:
    """A LIKE pattern in which a backslash is a character like others."""
    return sf.replace(pattern, sf.lit("\\"), sf.lit("\\\\"))


_BINARY = {
    **_ARITHMETIC,
    CMP.EQ: operator.eq,
    CMP.NE: operator.ne,
    CMP.GT: operator.gt,
    CMP.GTE: operator.ge,
    CMP.LT: operator.lt,
    CMP.LTE: operator.le,
    CMP.AND: operator.and_,
    CMP.OR: operator.or_,
    CMP.LIKE: lambda text, pattern: sf.like(text, _verbatim(pattern)),
    CMP.NOTLIKE: lambda text, pattern: ~sf.like(text, _verbatim(pattern)),
}

_UNARY = {
    ARITH.NEGATIVE: operator.neg,
    CMP.NOT: operator.invert,
    CMP.NULL: Column.isNull,
    CMP.NOTNULL: Column.isNotNull,
}

_OPPOSITE = {
    CMP.IN: CMP.NOTIN, CMP.NOTIN: CMP.IN,
    CMP.EXISTS: CMP.NOTEXISTS, CMP.NOTEXISTS: CMP.EXISTS,
}

# quantified operator -> (plain comparison, quantifier)
_QUANTIFIED = {
    CMP.GTALL: (CMP.GT, "all"), CMP.GTEALL: (CMP.GTE, "all"),
    CMP.LTALL: (CMP.LT, "all"), CMP.LTEALL: (CMP.LTE, "all"),
    CMP.GTANY: (CMP.GT, "any"), CMP.GTEANY: (CMP.GTE, "any"),
    CMP.LTANY: (CMP.LT, "any"), CMP.LTEANY: (CMP.LTE, "any"),
}


def is_number(value) -> bool:
    """Python and NumPy ints and floats; booleans are not numbers here."""
    return isinstance(value, (int, float, np.integer, np.floating)) and not isinstance(value, bool)


def plain_number(value):
    """The built-in int or float behind a NumPy scalar."""
    if not is_number(value):
        raise TypeError(f"{type(value).__name__} is not a supported number")
    return value.item() if isinstance(value, np.generic) else value


def is_frame(value) -> bool:
    return hasattr(value, "rowset") or hasattr(value, "to_frame")


class Expression:
    """Base of everything that compiles to a Column."""

    def compile(self, scope) -> Column:
        raise NotImplementedError

    def default_alias(self):
        """Name used by a projection when the caller gives none."""
        return None


class C(Expression):
    """A constant: number, string, boolean, date, timestamp or None."""

    def __init__(self, value):
        self.value = value.item() if isinstance(value, np.generic) else value

    def compile(self, scope=None):
        return sf.lit(self.value)


class DATE(C):
    """A date constant written ``YYYY-MM-DD``; checked when it is built."""

    def __init__(self, text: str):
        super().__init__(datetime.datetime.strptime(text, "%Y-%m-%d").date())

    def __str__(self):
        return self.value.isoformat()


def compile_operand(value, scope) -> Column:
    """A bare string names a column; anything else is an expression, number or frame."""
    if isinstance(value, Expression):
        return value.compile(scope)
    if isinstance(value, str):
        return scope.column(value)
    if is_number(value):
        return sf.lit(plain_number(value))
    if is_frame(value):
        return scope.scalar(value)
    raise TypeError(f"cannot use {type(value).__name__} in an expression")


def _literal(value) -> Column:
    """An item of an IN list, where strings are constants."""
    return value.compile() if isinstance(value, C) else sf.lit(C(value).value)


class _Arithmetic(Expression):
    """Operator overloads; results have the same class as the operand."""

    def _node(self, first, second, op):
        raise NotImplementedError

    def __add__(self, other):
        return self._node(self, other, ARITH.ADD)

    def __radd__(self, other):
        return self._node(other, self, ARITH.ADD)

    def __sub__(self, other):
        return self._node(self, other, ARITH.SUBTRACT)

    def __rsub__(self, other):
        return self._node(other, self, ARITH.SUBTRACT)

    def __mul__(self, other):
        return self._node(self, other, ARITH.MULTIPLY)

    def __rmul__(self, other):
        return self._node(other, self, ARITH.MULTIPLY)

    def __truediv__(self, other):
        return self._node(self, other, ARITH.DIVIDE)

    def __rtruediv__(self, other):
        return self._node(other, self, ARITH.DIVIDE)

    def __neg__(self):
        return self._node(self, None, ARITH.NEGATIVE)


class Q(_Arithmetic):
    """A predicate (or an arithmetic term inside one).

    ``Q("a", C(3), CMP.GT)``, ``Q("a")`` for a bare column,
    ``Q("k", frame, CMP.IN)`` for a subquery and
    ``Q([("outer", "inner")], frame, CMP.EXISTS)`` for a correlated EXISTS.
    """

    OP = ARITH

    def __init__(self, col1=None, col2=None, operator=CMP.EQ):
        self.left, self.right, self.op = col1, col2, operator
        if operator is CMP.EQ and col2 is None:
            self.op = None

    def _node(self, first, second, op):
        return Q(first, second, op)

    def __and__(self, other):
        return self._logical(other, CMP.AND)

    def __or__(self, other):
        return self._logical(other, CMP.OR)

    def _logical(self, other, op):
        if not isinstance(other, Q):
            raise TypeError(f"{op.name} needs two predicates")
        return Q(self, other, op)

    def __invert__(self):
        return Q(self, None, CMP.NOT)

    def default_alias(self):
        for side in (self.left, self.right):
            if isinstance(side, str):
                return side
            alias = side.default_alias() if isinstance(side, Expression) else None
            if alias:
                return alias
        return None

    @property
    def is_subquery_test(self):
        """True for a test a filter can turn into a semi or anti join."""
        exists = self.op in (CMP.EXISTS, CMP.NOTEXISTS)
        member = self.op in (CMP.IN, CMP.NOTIN) and is_frame(self.right)
        return exists or member

    def conjuncts(self):
        """The predicates joined by AND at the top of this tree."""
        if self.op is CMP.AND:
            for side in (self.left, self.right):
                yield from side.conjuncts() if isinstance(side, Q) else (Q(side),)
        elif self.op is CMP.NOT and isinstance(self.left, Q) and self.left.is_subquery_test:
            yield Q(self.left.left, self.left.right, _OPPOSITE[self.left.op])
        else:
            yield self

    def compile(self, scope):
        if self.op is None:
            return compile_operand(self.left, scope)
        if self.op in (CMP.EXISTS, CMP.NOTEXISTS):
            found = scope.exists(self.left, self.right)
            return ~found if self.op is CMP.NOTEXISTS else found
        left = compile_operand(self.left, scope)
        if self.op in _UNARY:
            return _UNARY[self.op](left)
        if self.op in (CMP.IN, CMP.NOTIN):
            if is_frame(self.right):
                found = scope.member(left, self.right)
            else:
                found = left.isin([_literal(v) for v in self.right])
            return ~found if self.op is CMP.NOTIN else found
        if self.op in _QUANTIFIED:
            comparison, quantifier = _QUANTIFIED[self.op]
            return scope.quantified(left, comparison, quantifier, self.right)
        return _BINARY[self.op](left, compile_operand(self.right, scope))


class F(_Arithmetic):
    """A projected expression; a bare string is a column name."""

    class OP(Enum):
        ADD, SUBTRACT, MULTIPLY, DIVIDE, NEGATIVE = "add", "sub", "mul", "div", "neg"
        YEAR, MONTH, DAY = "year", "month", "day"

    def __init__(self, col1, col2=None, operator=None):
        self.left, self.right, self.op = col1, col2, operator
        if isinstance(operator, F.OP) and operator.value in {a.value for a in ARITH}:
            self.op = ARITH(operator.value)

    def _node(self, first, second, op):
        return F(first, second, op)

    default_alias = Q.default_alias

    def compile(self, scope):
        left = compile_operand(self.left, scope)
        if self.op is None:
            return left
        if self.op is ARITH.NEGATIVE:
            return -left
        if self.op in _DATE_PARTS:
            return _DATE_PARTS[self.op](left)
        return _ARITHMETIC[self.op](left, compile_operand(self.right, scope))


_DATE_PARTS = {F.OP.YEAR: sf.year, F.OP.MONTH: sf.month, F.OP.DAY: sf.dayofmonth}


class EXTRACT(F):
    """``EXTRACT("o_orderdate", F.OP.YEAR)``."""

    def __init__(self, col, extractoperator=None):
        if extractoperator not in _DATE_PARTS:
            raise TypeError("EXTRACT takes F.OP.YEAR, F.OP.MONTH or F.OP.DAY")
        super().__init__(col, None, extractoperator)


class SUBSTRING(F):
    """Part of a string, one-based; without a length it runs to the end."""

    def __init__(self, col, fromidx=1, len=None):
        super().__init__(col)
        self.start, self.length = fromidx, len

    def compile(self, scope):
        text = compile_operand(self.left, scope)
        if self.length:
            return sf.substring(text, self.start, self.length)
        return sf.substr(text, sf.lit(self.start))


class CASE(F):
    """First matching branch; a missing default gives NULL, a default of 0 gives 0."""

    def __init__(self, cases, deflt=None):
        super().__init__(None)
        self.cases, self.default = tuple(cases), deflt

    def default_alias(self):
        named = (c.default_alias() for c, _ in self.cases if isinstance(c, Expression))
        first = next((name for name in named if name), None)
        return f"case_{first}" if first else None

    def compile(self, scope):
        branches = [(c.compile(scope), compile_operand(v, scope)) for c, v in self.cases]
        start = sf.when(*branches[0])
        chain = functools.reduce(lambda acc, branch: acc.when(*branch), branches[1:], start)
        return chain if self.default is None else chain.otherwise(compile_operand(self.default, scope))
