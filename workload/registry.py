"""Registering queries by name."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as sf
from pyspark.sql import types as st

from tabframe import Workspace

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, digits: int | None = None):
    """Register a function of a workspace; ``digits`` rounds doubles in its result."""

    def register(build):
        @functools.wraps(build)
        def run(spark, sf_dir) -> DataFrame:
            result = build(Workspace(spark, sf_dir))
            df = result if isinstance(result, DataFrame) else result.df
            return df if digits is None else rounded(df, digits)

        QUERIES[build.__name__] = run
        if sql:
            ORACLES[build.__name__] = " ".join(sql.split())
        return build

    return register


def rounded(df: DataFrame, digits: int) -> DataFrame:
    doubles = {f.name for f in df.schema if isinstance(f.dataType, st.DoubleType)}
    return df.select(*(sf.round(c, digits).alias(c) if c in doubles else c for c in df.columns))
