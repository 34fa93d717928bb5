"""Relational operators: filter, project, join, aggregate, order, distinct, top."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import functions as sf

from tabframe.functions.aggregates import Aggregate
from tabframe.functions.expressions import COL, JOIN, Expression, compile_operand
from tabframe.operators.scope import Scope
from tabframe.plans.position import SortKey
from tabframe.plans.settings import setting
from tabframe.plans.skew import full_join


def items(value) -> list:
    """One item or several: strings, expressions and dicts count as one."""
    return list(value) if isinstance(value, (tuple, list)) else [value]


def _aliased(value):
    """(source, alias or None) pairs of a projection list."""
    for item in items(value):
        if isinstance(item, dict):
            yield from item.items()
        else:
            yield item, None


def unique_names(names) -> None:
    names = list(names)
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"column names used twice: {repeated}; give them aliases")


class Relational:
    """Relational part of a frame; every method is lazy."""

    def filter(self, *selcols):
        """Rows for which every predicate is true."""
        scope = Scope(self)
        parts = [part for predicate in selcols for part in predicate.conjuncts()]
        tests = [part for part in parts if part.is_subquery_test]
        conditions = [part.compile(scope) for part in parts if not part.is_subquery_test]
        if conditions:
            scope.rows = scope.rows.filter(functools.reduce(operator.and_, conditions))
        for test in tests:
            scope.keep(test)
        return self._derive(self.rowset.with_rows(scope.rows), self.cells)

    def project(self, projcols):
        """Named, renamed or computed columns over the same rows."""
        scope = Scope(self)
        cells = []
        for position, (source, alias) in enumerate(_aliased(projcols)):
            column = compile_operand(source, scope)
            if alias is None:
                default = source.default_alias() if isinstance(source, Expression) else source
                alias = default or f"col_{position}"
            cells.append((alias, column))
        unique_names(name for name, _ in cells)
        rowset = self.rowset
        if scope.rows is not rowset.df:
            rowset = rowset.widened(scope.rows)
        return self._derive(rowset, dict(cells))

    def join(self, otherTable, src1joincols, src2joincols,
             cols1=COL.NONE, cols2=COL.NONE, join=JOIN.INNER):
        """Equi-join; only the requested columns of each side survive."""
        other = otherTable.to_frame() if hasattr(otherTable, "to_frame") else otherTable
        keys1, keys2 = items(src1joincols or []), items(src2joincols or [])
        if join is not JOIN.CROSS_JOIN and (len(keys1) != len(keys2) or not keys1):
            raise AttributeError("a join needs the same number of columns from both sides")
        picks1, picks2 = self._picked(cols1), other._picked(cols2)
        names = [alias for _, alias in picks1 + picks2]
        unique_names(names)
        left, right = self._side("l", picks1, keys1), other._side("r", picks2, keys2)
        if join is JOIN.CROSS_JOIN:
            rows = left.crossJoin(right)
        else:
            pairs = [sf.col(f"__lk{i}") == sf.col(f"__rk{i}") for i in range(len(keys1))]
            rows = _joined(left, right, functools.reduce(operator.and_, pairs), join, len(keys1))
        hidden = [f"__l{i}" for i in range(len(picks1))] + [f"__r{i}" for i in range(len(picks2))]
        return self._of(rows.select(*(sf.col(h).alias(n) for h, n in zip(hidden, names))))

    def _picked(self, spec):
        """(source, alias) pairs a join keeps from this side."""
        if spec is None or spec is COL.NONE:
            return []
        if spec is COL.ALL:
            return [(name, name) for name in self.cells]
        return [(source, alias or source) for source, alias in _aliased(spec)]

    def _side(self, tag, picks, keys):
        scope = Scope(self)
        columns = [scope.column(source).alias(f"__{tag}{i}") for i, (source, _) in enumerate(picks)]
        columns += [scope.column(key).alias(f"__{tag}k{i}") for i, key in enumerate(keys)]
        return self.rowset.df.select(*columns)

    def aggregate(self, projcols, groupcols=None):
        """Aggregates per group (or overall); the output is exactly ``projcols``."""
        scope = Scope(self)
        groups = items(groupcols) if groupcols else []
        outputs, aggregates = [], []
        for source, alias in _aliased(projcols):
            if isinstance(source, Aggregate):
                hidden = f"__a{len(aggregates)}"
                aggregates.append(source.compile(scope).alias(hidden))
                outputs.append((hidden, alias or source.default_alias()))
            elif source in groups:
                outputs.append((f"__g{groups.index(source)}", alias or source))
            else:
                scope.column(source)
                raise AttributeError(f"{source!r} is neither aggregated nor grouped")
        unique_names(name for _, name in outputs)
        keys = [scope.column(g).alias(f"__g{i}") for i, g in enumerate(groups)]
        rows = scope.rows
        if aggregates:
            rows = rows.groupBy(*keys).agg(*aggregates)
        else:
            rows = rows.select(*keys).distinct()
        return self._of(rows.select(*(sf.col(h).alias(n) for h, n in outputs)))

    agg = aggregate

    def order(self, orderlist, unique=False):
        """Order by ``name``, ``name#asc`` or ``name#desc``.

        ``unique=True`` promises that no two rows share the key, which saves the
        tie breaker when positions are worked out.
        """
        scope = Scope(self)
        keys = []
        for item in items(orderlist):
            name, _, direction = item.partition("#")
            if direction not in ("", "asc", "desc"):
                raise ValueError(f"unknown direction {direction!r}")
            keys.append(SortKey(scope.column(name), direction == "desc"))
        return self._derive(self.rowset.reordered(keys, unique), self.cells, ordered=True)

    def distinct(self):
        """Different rows only."""
        return self._of(self.unsorted().distinct())

    def top(self, n=5):
        """The first ``n`` rows as a frame; any ``n`` rows if there is no order."""
        ordered = self.rowset.keys or self.rowset.positional
        if ordered and self._is_long(n):
            return self._in_order(self[:n])
        rows = self.rowset.sorted() if ordered else self.rowset.df
        return self._derive(self.rowset.with_rows(rows.limit(n)), self.cells, ordered=self.ordered)

    def bottom(self, n=5):
        """The last ``n`` rows as a frame, in order."""
        if self._is_long(n):
            return self._in_order(self[-n:])
        last = self.rowset.sorted(backwards=True).limit(n)
        return self._derive(self.rowset.with_rows(last), self.cells, ordered=True)

    def _in_order(self, part):
        return self._derive(part.rowset, part.cells, ordered=True)

    def _is_long(self, n):
        """Too many rows for the one task that merges a top-n; positions have no such task."""
        return n > setting(self.spark, "topRows")


def _joined(left, right, condition, join, width):
    if join is not JOIN.OUTER:
        return left.join(right, condition, join.value)
    return full_join(left, right, [f"__lk{i}" for i in range(width)], [f"__rk{i}" for i in range(width)])
