"""The frame: one object for relational, algebraic and user-function work."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as st

from tabframe.operators.algebra import Algebra
from tabframe.operators.positional import Positional
from tabframe.operators.relational import Relational
from tabframe.operators.rowset import RowSet
from tabframe.operators.statistics import Statistics
from tabframe.operators.userfunc import UserFunctions
from tabframe.plans.durable import durable
from tabframe.plans.position import POS, named
from tabframe.plans.settings import setting


@dataclass(frozen=True)
class TableName:
    """Where a stored table lives; present on base tables only."""

    schema: str | None
    name: str


@dataclass(frozen=True)
class ColumnInfo:
    """Metadata of one visible column."""

    schemaName: str | None
    tableName: str | None
    columnName: str
    type: str
    size: int | None
    pos: int
    nullable: bool


class Frame(Relational, Positional, Algebra, Statistics, UserFunctions):
    """Named columns (``cells``) over a row set.

    A frame is a plan: nothing runs until rows are asked for.  Where an
    operator must look at the data first (positions, small matrices) only
    counts, sampled keys or arrays of checked size come to the driver.
    """

    __array_ufunc__ = None  # NumPy arrays leave mixed arithmetic to the frame
    __hash__ = object.__hash__

    def __init__(self, rowset: RowSet, cells: dict[str, Column],
                 ordered: bool = False, table: TableName | None = None):
        self.rowset, self.cells, self.ordered, self.table = rowset, cells, ordered, table

    @classmethod
    def of(cls, df: DataFrame, **rowset_options) -> Frame:
        """A frame over a DataFrame; columns starting with ``__`` stay hidden."""
        cells = {c: named(c) for c in df.columns if not c.startswith("__")}
        return cls(RowSet(df, **rowset_options), cells)

    def _of(self, df: DataFrame, **rowset_options) -> Frame:
        return Frame.of(df, **rowset_options)

    def _derive(self, rowset: RowSet, cells: dict[str, Column], ordered: bool = False) -> Frame:
        return Frame(rowset, cells, ordered)

    # -- plans and metadata ------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.rowset.df.sparkSession

    def unsorted(self) -> DataFrame:
        """The visible columns, in no particular order."""
        return self.rowset.df.select(*self._selected())

    def _selected(self) -> list[Column]:
        return [cell.alias(name) for name, cell in self.cells.items()]

    @property
    def df(self) -> DataFrame:
        """The frame as a DataFrame, sorted if it was just ordered."""
        return self.rowset.sorted().select(*self._selected()) if self.ordered else self.unsorted()

    def positions(self) -> DataFrame:
        """``__pos`` and the visible columns."""
        return self.rowset.positioned().select(POS, *self._selected())

    @cached_property
    def schema(self) -> st.StructType:
        return self.unsorted().schema

    @property
    def columns(self) -> dict[str, ColumnInfo]:
        owner = self.table or TableName(None, None)
        return {
            field.name: ColumnInfo(
                owner.schema, owner.name, field.name, field.dataType.simpleString(),
                _size(field.dataType), position, field.nullable,
            )
            for position, field in enumerate(self.schema)
        }

    @property
    def numRows(self) -> int:
        return self.rowset.count()

    @property
    def shape(self) -> tuple[int, int]:
        return self.numRows, len(self.cells)

    # -- materializing and fetching ----------------------------------------

    def loadData(self, matrix: bool = False, keep: str = "cache") -> Frame:
        """Compute once and keep: ``cache`` on executors, ``durable`` in shared storage."""
        source = self.to_matrix() if matrix else self
        rows = source.rowset.df
        kept = durable(rows) if keep == "durable" else rows.persist(StorageLevel.MEMORY_AND_DISK)
        old = source.rowset
        rowset = RowSet(kept, old.keys, old.unique, rows=kept.count())
        return Frame(rowset, source.cells, source.ordered, source.table)

    @property
    def isCached(self) -> bool:
        return self.rowset.df.is_cached

    @property
    def cdata(self):
        """All rows, in order, as an Arrow table; refuses more rows than ``fetchRows``, see ``fetch``.

        Long results come as they are, with their positions, and are put in order here: no task merges them.
        """
        limit = setting(self.spark, "fetchRows")
        in_order = self.rowset.keys or self.rowset.positional
        if in_order and self.numRows > setting(self.spark, "topRows"):
            self._fetchable(self.numRows, "write them out, take them by fetch() or raise fetchRows")
            table = self.positions().toArrow()
            return table.sort_by(POS).drop_columns([POS]).combine_chunks()
        rows = self.rowset.sorted() if in_order else self.rowset.df
        table = rows.select(*self._selected()).limit(limit + 1).toArrow()
        self._fetchable(table.num_rows, "write them out, take them by fetch() or raise fetchRows")
        return table

    def fetch(self, size: int = 1 << 16):
        """All rows in order, however many, as a stream of Arrow tables of at most ``size`` rows; each is a query of its own
        over the rows of some positions."""
        placement = self.rowset.placement()
        for low in range(0, placement.rows, size):
            rows = placement.between(low, min(low + size, placement.rows) - 1)
            yield rows.select(POS, *self._selected()).toArrow().sort_by(POS).drop_columns([POS]).combine_chunks()

    @property
    def rows(self) -> dict:
        """All columns as NumPy arrays, with the same bound as ``cdata``."""
        data = self.cdata.to_pandas()
        return {name: data[name].to_numpy() for name in data}

    def head(self, n=5):
        """The first ``n`` rows as pandas; refuses more than ``fetchRows``, see ``top``."""
        return self.top(self._fetchable(n)).df.toPandas()

    def tail(self, n=5):
        """The last ``n`` rows as pandas, with the same bound; see ``bottom``."""
        return self.bottom(self._fetchable(n)).df.toPandas()

    def _fetchable(self, n: int, instead: str = "take them as a frame or raise fetchRows") -> int:
        limit = setting(self.spark, "fetchRows")
        if n > limit:
            raise ValueError(f"more than {limit} rows; {instead}")
        return n

    def __repr__(self):
        return f"Frame[{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in self.schema)}]"


def _size(dtype: st.DataType) -> int | None:
    """Bits of a fixed-size number or date."""
    # Declared sizes of the column types.
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "float": 24, "double": 53, "date": 32}
    return bits.get(dtype.simpleString())
