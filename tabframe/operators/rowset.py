"""Row sets: the rows a frame's columns are computed over, and their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as sf

from tabframe.plans.position import (
    FILE, POS, ROW, Placement, SortKey, identity_hash, number_by_file, number_by_key,
)

_RANK = "__rank"


class NoOrderError(ValueError):
    """The rows have no defined order, so they have no positions."""


class RowSet:
    """A DataFrame of rows plus what is known about their order.

    Frames that share a RowSet are aligned row by row, so combining their
    columns is a projection.  Positions are worked out at most once.

    ``scan`` marks rows read from files (perhaps filtered): file and row number
    identify them.  They are asked for only when an order needs them, because a
    scan that carries them reads more than its columns.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: tuple[SortKey, ...] = (),
        unique: bool = False,
        scan: bool = False,
        whole: bool = False,
        place: Callable[[], Placement] | None = None,
        rows: int | None = None,
    ):
        self.df, self.keys, self.unique, self.scan, self.whole = df, keys, unique, scan, whole
        self._place, self._rows, self._placement = place, rows, None

    def placement(self) -> Placement:
        if self._placement is None:
            if POS in self.df.columns:
                self._placement = Placement(self.df, self.count())
            else:
                self._placement = self._place() if self._place else self._number()
            self._rows = self._placement.rows
        return self._placement

    def positioned(self) -> DataFrame:
        """The rows with their dense zero-based position in ``__pos``."""
        return self.df if POS in self.df.columns else self.placement().placed

    def _number(self) -> Placement:
        if self.keys and self.unique:
            return number_by_key(self.df, list(self.keys), unique=True)
        rows = self._identified()
        if self.whole and not self.keys:
            return number_by_file(rows)
        if not self.keys and FILE not in rows.columns:
            raise NoOrderError("these rows have no order; call order(..) first")
        return number_by_key(rows, list(self.keys), unique=False)

    def _identified(self) -> DataFrame:
        """The rows with file and row number, where they come from a scan.

        As a tie breaker a hash of the file name does, which is shorter to move.
        """
        if not self.scan or FILE in self.df.columns:
            return self.df
        file = sf.col("_metadata.file_path")
        file = sf.xxhash64(file) if self.keys else file
        return self.df.select("*", file.alias(FILE), sf.col("_metadata.row_index").alias(ROW))

    @property
    def positional(self) -> bool:
        """Positions are part of the rows already, or of how they were put together."""
        return POS in self.df.columns or self._place is not None

    def count(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    def with_rows(self, df: DataFrame) -> RowSet:
        """Row set over some of these rows (a filter or semi join), order kept."""
        if POS not in df.columns:
            return RowSet(df, self.keys, self.unique, self.scan)
        ranked = df.drop(_RANK).withColumnRenamed(POS, _RANK)
        return RowSet(ranked, (SortKey(sf.col(_RANK)),), unique=True)

    def widened(self, df: DataFrame) -> RowSet:
        """Row set of the same rows with more columns."""
        return RowSet(df, self.keys, self.unique, self.scan, rows=self._rows)

    def reordered(self, keys: list[SortKey], unique: bool) -> RowSet:
        return RowSet(self.df.drop(POS), tuple(keys), unique, self.scan, rows=self._rows)

    def sort_keys(self) -> tuple[DataFrame, list[SortKey]]:
        """The rows and keys that put them in one definite order; ties are broken."""
        rows = self.positioned() if self.positional and not self.keys else self.df
        if POS in rows.columns and not self.keys:
            keys = [SortKey(sf.col(POS))]
        elif self.keys and self.unique:
            keys = list(self.keys)
        else:
            rows = self._identified()
            if FILE in rows.columns:
                keys = [*self.keys, SortKey(sf.col(FILE)), SortKey(sf.col(ROW))]
            elif self.keys:
                keys = [*self.keys, SortKey(identity_hash(rows))]
            else:
                raise NoOrderError("these rows have no order; call order(..) first")
        return rows, keys

    def sorted(self, backwards: bool = False) -> DataFrame:
        """The rows in order; ties are broken, so that it is one definite order."""
        rows, keys = self.sort_keys()
        return rows.orderBy(*((k.reversed() if backwards else k).ordering() for k in keys))

    def first(self, n: int) -> DataFrame:
        """The first rows, at most ``n``, with their positions: a top-n and a ranking of what it leaves, so that positions
        of the others need not be worked out."""
        rows, keys = self.sort_keys()
        order = [k.ordering() for k in keys]
        return rows.orderBy(*order).limit(n).withColumn(POS, (sf.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
