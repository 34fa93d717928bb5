"""Loading data that Spark has no reader for, and recognizing dates in text."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as sf
from pyspark.sql import types as st
from pyspark.sql.pandas.types import to_arrow_schema

from tabframe.operators.frame import Frame
from tabframe.operators.userfunc import as_batch, parse_schema
from tabframe.plans.settings import setting
from tabframe.sources import custom


def load_parts(spark: SparkSession, func: Callable, parts, schema, *args, within: Callable | None = None, **kwargs) -> Frame:
    """Call ``func(part, ...)`` once per part, on the executors.

    ``parts`` describes the pieces: file names, key ranges, dates.  The function gets one description and returns, or
    yields piece by piece, a dict of arrays or ``(matrix, names)``.

    A list (of anything that can be pickled) is a data source of Spark's own kind: with ``within(part)``, which tells the
    lowest and highest value of columns in a part, parts that a later filter rules out are never read.  A DataFrame is for
    more descriptions than a list should have; the function gets its rows as dicts, and ``within`` has no use.
    """
    schema = parse_schema(schema)
    if not isinstance(parts, DataFrame):
        @functools.wraps(func)
        def call(part):
            return func(part, *args, **kwargs)

        return Frame.of(custom.load(spark, call, parts, schema, within, setting(spark, "loadTasks")))
    arrow = to_arrow_schema(schema)
    spread = parts.repartition(max(1, min(parts.count(), setting(spark, "loadTasks"))))

    def run(batches):
        for batch in batches:
            for part in batch.to_pylist():
                result = func(part, *args, **kwargs)
                for piece in result if isinstance(result, Iterator) else [result]:
                    yield as_batch(piece, func.__name__, arrow)

    return Frame.of(spread.mapInArrow(run, schema))


# Text formats recognized as dates and timestamps.
DATE_FORMAT = "yyyy-MM-dd"
TIMESTAMP_SHAPE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def infer_datetimes(frame: Frame) -> Frame:
    """Turn text columns into dates or timestamps where every value is one.

    All values are looked at, in one pass; times of day stay text.
    """
    texts = [f.name for f in frame.schema if isinstance(f.dataType, st.StringType)]
    if not texts:
        return frame
    parsers = {"date": _as_date, "timestamp": _as_timestamp}
    checks = []
    for c, name in enumerate(texts):
        cell = frame.cells[name]
        checks.append(sf.count(cell).alias(f"all_{c}"))
        checks += [sf.count(parse(cell)).alias(f"{kind}_{c}") for kind, parse in parsers.items()]
    seen = frame.rowset.df.agg(*checks).first()
    cells = dict(frame.cells)
    for c, name in enumerate(texts):
        for kind, parse in parsers.items():
            if seen[f"all_{c}"] and seen[f"{kind}_{c}"] == seen[f"all_{c}"]:
                cells[name] = parse(frame.cells[name])
    return Frame(frame.rowset, cells, frame.ordered)


def _as_date(cell):
    return sf.when(sf.length(cell) == len(DATE_FORMAT), sf.try_to_timestamp(cell, sf.lit(DATE_FORMAT)).cast("date"))


def _as_timestamp(cell):
    # not by way of a timestamp with zone, in which some hours of the session's zone are missing
    return sf.when(cell.rlike(TIMESTAMP_SHAPE), cell.try_cast("timestamp_ntz"))
