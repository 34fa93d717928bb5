"""The workspace: tables, views, SQL, saving and loading over a Spark session."""

from __future__ import annotations

import datetime
import decimal
import numbers
import re
import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tabframe.operators.frame import Frame, TableName
from tabframe.operators.positional import wide
from tabframe.sources import generators, loaders


class MissingTableError(KeyError, AttributeError):
    """No table, view or variable of this name."""


#: The start of a query, and of one that has named queries of its own.
_QUERY = re.compile(r"\s*(?:(?:--[^\n]*\n|/\*.*?\*/)\s*)*(with\s+(?:recursive\s+)?|select\b|from\b|values\b|table\b|\()", re.I | re.S)
_RELATION = re.compile(r"'UnresolvedRelation \[([^\]]*)\], \[")
_SCALARS = (numbers.Number, str, datetime.date, datetime.timedelta, decimal.Decimal, bytes, type(None))


#: One saver of this driver at a time drops and names tables: dropping one deletes its folder, which another may just have filled.
_NAMING = threading.Lock()


class Workspace:
    """Access to tables by attribute, and a place to name frames and values.

    ``path`` is an optional folder of ``<table>.parquet`` files; other tables
    come from the session catalog.  ``ws.orders`` reads a table, ``ws.x = frame``
    names a frame, ``ws.k = 5`` any other object, and ``del ws.x`` drops a table
    or a name.  Frames and plain values can be used in SQL by their names.  Names
    belong to one workspace: others in the same session don't see them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, dbName: str | None = None):
        self._spark, self._path, self._db = spark, path and path.rstrip("/"), dbName
        self._names: dict[str, Frame] = {}
        self._values: dict[str, object] = {}
        self._views: dict[str, tuple[str, Frame]] = {}
        self._id = uuid.uuid4().hex
        self._tables_read: dict[tuple, Frame] = {}

    # -- tables ------------------------------------------------------------

    @property
    def dbName(self) -> str:
        return self._db or self._spark.catalog.currentDatabase()

    def _getDBTable(self, relName: str, dbName: str | None = None) -> Frame:
        """A stored table as a frame; asked for twice it is the same frame."""
        known = (dbName, relName)
        if known not in self._tables_read:
            self._tables_read[known] = self._read_table(relName, dbName)
        return self._tables_read[known]

    def _read_table(self, relName: str, dbName: str | None) -> Frame:
        if dbName is None and self._is_file(relName):
            rows = self._spark.read.parquet(f"{self._path}/{relName}.parquet")
            return self._base(rows, TableName(None, relName))
        full = f"{dbName or self.dbName}.{relName}"
        try:
            known = self._spark.catalog.tableExists(full)
        except AnalysisException:
            known = False
        if not known:
            raise MissingTableError(f"no table {relName} in {dbName or self.dbName}")
        return self._base(self._spark.table(full), TableName(dbName or self.dbName, relName))

    def _base(self, rows: DataFrame, table: TableName) -> Frame:
        """A base table; rows of files can be told apart by file and row number."""
        try:
            rows.select("_metadata.file_path", "_metadata.row_index")
            scan = True
        except AnalysisException:
            scan = False
        frame = Frame.of(rows, scan=scan, whole=scan)
        frame.table = table
        return frame

    def _files(self) -> list[str]:
        """Tables of the folder, listed through Hadoop's file system."""
        if not self._path:
            return []
        folder = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        system = folder.getFileSystem(self._spark._jsc.hadoopConfiguration())
        names = [status.getPath().getName() for status in system.listStatus(folder)]
        return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))

    def _is_file(self, name: str) -> bool:
        if not self._path:
            return False
        file = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}.parquet")
        return file.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(file)

    def _tables(self) -> DataFrame:
        """Names of the stored tables."""
        stored = [t.name for t in self._spark.catalog.listTables(self.dbName) if not t.isTemporary]
        names = sorted({*stored, *self._files()})
        return self._spark.createDataFrame([(n,) for n in names], "tableName string")

    # -- names -------------------------------------------------------------

    def __getattr__(self, name: str) -> Frame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name in self._names:
            return self._names[name]
        if name in self._values:
            return self._values[name]
        return self._getDBTable(name)

    def __setattr__(self, name: str, value) -> None:
        if name.startswith("_"):
            object.__setattr__(self, name, value)
            return
        is_frame = hasattr(value, "rowset") or hasattr(value, "to_frame")
        if name in (self._values if is_frame else self._names):
            raise TypeError(f"{name} is already the name of {'a value' if is_frame else 'a frame'}")
        try:
            self._getDBTable(name)
        except MissingTableError:
            if is_frame:
                self._toTable(value, name)
            else:
                self._values[name] = value
            return
        raise TypeError(f"{name} is already a stored table")

    def __delattr__(self, name: str) -> None:
        if name in self._names:
            self._dropTblUDF(self._names[name], name)
        elif name in self._values:
            del self._values[name]
        else:
            self._dropTable(name)

    def __getitem__(self, name: str) -> Frame:
        return getattr(self, name)

    def __setitem__(self, name: str, value) -> None:
        setattr(self, name, value)

    # -- SQL ---------------------------------------------------------------

    def _executeQry(self, sql: str, resultFormat: str = "column") -> Frame:
        """Run SQL over stored tables, named frames and named values; lazy like any frame.

        Which names a query uses is taken from Spark's own parse of it, so their case doesn't matter, and what stands in
        a text or comment isn't one.  A name means, first, a named query (``with``) of the SQL itself, then a frame of this
        workspace, a table of its folder, and a table of the catalog.  A plain value named ``k`` is ``:k`` or, where no
        column has that name, ``k``.  Statements that are no queries see the catalog only.
        """
        if resultFormat != "column":
            raise NotImplementedError("only the column format is supported")
        start = _QUERY.match(sql)
        if not start:
            return Frame.of(self._spark.sql(sql))
        # every column, however many there are
        plan = self._spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString(True, False, 1 << 20, False, False)
        own = {n.lower() for names in re.findall(r"CTE \[([^\]]*)\]", plan) for n in names.split(", ")}
        known = {n.lower(): n for n in self._files()} | {n.lower(): n for n in self._names}
        used = sorted({n.lower() for n in _RELATION.findall(plan)} & known.keys() - own)
        named = ", ".join(f"{quoted(known[n])} AS (SELECT * FROM {quoted(self._view(known[n]))})" for n in used)
        if named:
            at, opening = start.start(1), start.group(1)
            rest = sql[at + len(opening):] if opening.lower().startswith("with") else sql[at:]
            more = ", " if opening.lower().startswith("with") else " "
            sql = f"{sql[:at]}{opening if more == ', ' else 'WITH '}{named}{more}{rest}"
        values = {n: v for n, v in self._values.items() if isinstance(v, _SCALARS)}
        marked = {n: _plain(v) for n, v in values.items() if f"namedparameter({n})" in plan}
        bare = [n for n in values if re.search(rf"'{re.escape(n)}(?![\w.])", plan, re.I)]
        try:
            # the plan keeps what a variable is when it is made, so the variable need not outlive this call
            for name in bare:
                self._spark.sql(f"DECLARE OR REPLACE VARIABLE {quoted(name)} = :v", args={"v": _plain(values[name])})
            return Frame.of(self._spark.sql(sql, args=marked or None))
        finally:
            for name in bare:
                self._spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {quoted(name)}")

    def _view(self, name: str) -> str:
        """A view, of a name that only this workspace uses, of a frame or a table of the folder."""
        frame = self._names[name] if name in self._names else self._getDBTable(name)
        view, seen = self._views.get(name, (f"tabframe_{self._id}_{len(self._views)}", None))
        if seen is not frame:
            frame.unsorted().createOrReplaceTempView(view)
            self._views[name] = view, frame
        return view

    def _toTable(self, tblrData: Frame, tableName: str | None = None, infer: bool = False) -> Frame:
        """Name a frame so that SQL can use it; ``infer`` recognizes dates in text."""
        frame = wide(tblrData)
        name = tableName or (frame.table and frame.table.name)
        if not name:
            raise AttributeError("the frame has no table name; give one")
        frame = loaders.infer_datetimes(frame) if infer else frame
        self._names[name] = frame
        return frame

    def _dropTblUDF(self, tblrData: Frame | None, tableName: str | None = None) -> None:
        """Forget a name given by ``_toTable``."""
        name = tableName or (tblrData is not None and tblrData.table and tblrData.table.name)
        if not name:
            raise AttributeError("the frame has no table name; give one")
        self._names.pop(name, None)
        if name in self._views:
            self._spark.catalog.dropTempView(self._views.pop(name)[0])

    # -- saving ------------------------------------------------------------

    def _saveTblrData(self, tblrData: Frame, tableName: str, dbName: str | None = None,
                      drop: bool = False, path: str | None = None) -> Frame:
        """Write a frame as a stored table and return that table.

        An existing table is replaced only with ``drop``, and only after the new
        rows are written, so a table may be replaced by a frame that reads it, and
        a write that fails leaves the old rows.  Every write goes to a new folder,
        so savers of one name don't touch each other's files: the last one wins.
        With a ``path`` these folders are kept there; the one that the table is in
        is the table's location.  Without, files belong to the catalog.
        """
        frame = wide(tblrData)
        if frame.table is not None:
            raise TypeError(f"already a table: {frame.table.name}")
        database = dbName or self.dbName
        full = quoted(database, tableName)
        if self._spark.catalog.tableExists(full) and not drop:
            raise ValueError(f"{database}.{tableName} already exists")
        version = uuid.uuid4().hex
        if path:
            location = f"{path.rstrip('/')}/version={version}"
            frame.df.write.mode("errorifexists").format("parquet").save(location)
            with _NAMING:
                self._refuse_existing(full, drop)
                # nothing but the catalog changes now
                self._spark.sql(f"DROP TABLE IF EXISTS {full}")
                self._spark.catalog.createTable(full, location, "parquet", frame.df.schema)
        else:
            staged = quoted(database, f"{tableName}_{version}")
            frame.df.write.mode("errorifexists").format("parquet").saveAsTable(staged)
            try:
                with _NAMING:
                    self._refuse_existing(full, drop)
                    self._spark.sql(f"DROP TABLE IF EXISTS {full}")
                    self._spark.sql(f"ALTER TABLE {staged} RENAME TO {full}")
            except Exception:
                self._spark.sql(f"DROP TABLE IF EXISTS {staged}")
                raise
        self._forget(tableName)
        if tableName in self._names:
            self._dropTblUDF(None, tableName)
        with _NAMING:
            # a reader may have come between dropping and naming, and left what it saw
            self._spark.catalog.refreshTable(full)
            return self._getDBTable(tableName, dbName)

    def _refuse_existing(self, full: str, drop: bool) -> None:
        if not drop and self._spark.catalog.tableExists(full):
            raise ValueError(f"{full} was made meanwhile")

    def _dropTable(self, tableName: str, dbName: str | None = None) -> None:
        database = dbName or self.dbName
        if not self._spark.catalog.tableExists(f"{database}.{tableName}"):
            raise MissingTableError(f"no table {database}.{tableName}")
        self._spark.sql(f"DROP TABLE {quoted(database, tableName)}")
        self._forget(tableName)

    def _forget(self, name: str) -> None:
        for known in [k for k in self._tables_read if k[1] == name]:
            del self._tables_read[known]

    # -- loading and generating --------------------------------------------

    def _L(self, func, *args, parts=None, schema=None, within=None, **kwargs) -> Frame:
        """Load external data with ``func``, part by part on the executors; see ``load_parts``."""
        if parts is None or schema is None:
            raise TypeError("give the parts to load and the schema of the result")
        return loaders.load_parts(self._spark, func, parts, schema, *args, within=within, **kwargs)

    def read(self, fmt: str, path: str, schema=None, **options) -> Frame:
        """Read files with a Spark reader: parquet, orc, csv, json or text."""
        reader = self._spark.read.format(fmt).options(**options)
        reader = reader.schema(schema) if schema else reader
        return self._base(reader.load(path), None)

    def _ones(self, shape, cols=None) -> Frame:
        return generators.ones(self._spark, shape, cols)

    def _rand(self, shape, cols=None, seed=None) -> Frame:
        return generators.rand(self._spark, shape, cols, seed)

    def _randn(self, shape, cols=None, seed=None) -> Frame:
        return generators.randn(self._spark, shape, cols, seed)


def _plain(value):
    """The Python value behind a NumPy scalar."""
    return value.item() if hasattr(value, "item") else value


def quoted(*parts: str) -> str:
    """A dotted name with its parts quoted for SQL."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)
