"""Frames of generated numbers."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as sf

from tabframe.operators.frame import Frame
from tabframe.plans.position import POS
from tabframe.plans.settings import setting


def generated(spark: SparkSession, shape, cols, value) -> Frame:
    """``shape`` is n, (n,) or (n, k); ``value(j)`` is the Column of column j.

    The number of partitions follows from n alone, so seeded values are the same
    on every cluster and on every recomputation; it stays below what a scheduler handles well.
    """
    n, k = shape if isinstance(shape, tuple) and len(shape) == 2 else (*_as_tuple(shape), 1)
    names = [cols] if isinstance(cols, str) else list(cols or (f"_c{j}_" for j in range(k)))
    if len(names) != k:
        raise TypeError(f"{k} columns need {k} names, got {len(names)}")
    parts = min(max(1, math.ceil(n / setting(spark, "rowsPerBucket"))), 1 << 16)
    rows = spark.range(0, n, 1, parts).select(
        sf.col("id").alias(POS), *(value(j).alias(name) for j, name in enumerate(names)))
    return Frame.of(rows, rows=n)


def _as_tuple(shape):
    return shape if isinstance(shape, tuple) else (shape,)


def ones(spark, shape, cols=None) -> Frame:
    return generated(spark, shape, cols, lambda j: sf.lit(1.0))


def rand(spark, shape, cols=None, seed=None) -> Frame:
    """Uniform in [0, 1)."""
    return generated(spark, shape, cols, _seeded(sf.rand, seed))


def randn(spark, shape, cols=None, seed=None) -> Frame:
    """Standard normal."""
    return generated(spark, shape, cols, _seeded(sf.randn, seed))


def _seeded(function, seed):
    first = random.randrange(1 << 31) if seed is None else seed

    def value(j: int) -> Column:
        return function(first + j)

    return value
