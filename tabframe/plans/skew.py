"""Full joins in which a few keys have very many rows.

Spark can split the rows of one key at run time for every equi-join but a full one.  So frequent keys are found first, by a
summary of bounded size, and salted; all other keys are joined as they are, in the same one join.
"""

from __future__ import annotations

import collections
import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as sf

from tabframe.plans.fold import fold
from tabframe.plans.settings import setting

#: Counters of a summary: a key of more than one in so many rows is in it.
COUNTERS = 1024
_SALT = "__salt"


def compressed(counts: dict, most: int) -> dict:
    """Misra and Gries: at most ``most`` counters; what is taken from one is taken from all."""
    if len(counts) <= most:
        return counts
    cut = sorted(counts.values(), reverse=True)[most]
    return {key: n - cut for key, n in counts.items() if n > cut}


def frequent(df: DataFrame, names: list[str]) -> tuple[int, dict]:
    """How many rows have no NULL among ``names``, and (with their least number of rows) all keys that more than one in
    COUNTERS + 1 of them have."""

    def partial(batch: pa.RecordBatch):
        keys = batch.select(names).drop_null()
        if not keys.num_rows:
            return 0, {}
        codes = np.zeros(keys.num_rows, np.int64)
        for column in keys.columns:
            own = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            codes = np.unique(codes * (int(own.max()) + 1) + own, return_inverse=True)[1]
        _, first, n = np.unique(codes, return_index=True, return_counts=True)
        kept = compressed(dict(zip(first.tolist(), n.tolist())), COUNTERS)
        named = keys.take(pa.array(list(kept), pa.int64()))
        return keys.num_rows, dict(zip(zip(*(c.to_pylist() for c in named.columns)), kept.values()))

    def merge(a, b):
        counts = collections.Counter(a[1])
        counts.update(b[1])
        return a[0] + b[0], compressed(dict(counts), COUNTERS)

    return fold(df.select(*names), partial, merge) or (0, {})


def _among(names: list[str], keys: list[tuple], kinds: list[str]) -> Column:
    """Whether the key of a row is one of ``keys``."""
    if not keys:
        return sf.lit(False)
    values = [sf.struct(*(sf.lit(v).cast(kind).alias(n) for n, v, kind in zip(names, key, kinds))) for key in keys]
    return sf.coalesce(sf.struct(*names).isin(values), sf.lit(False))


def full_join(left: DataFrame, right: DataFrame, lefts: list[str], rights: list[str]) -> DataFrame:
    """The full outer join on equal keys; each input is read once by it.

    Large inputs are read once more before, for the summaries of their keys. Rows of a key that has more than ``skewRows``
    rows on one side are dealt over salts, and the other side's rows of it are there under each. Of these copies the
    matched ones are all wanted; an unmatched one is none, since its key is on the frequent side. Rows with a NULL in
    their key match nothing and are dealt out as well.
    """
    spark = left.sparkSession
    limit = setting(spark, "skewRows")
    equal = [sf.col(x) == sf.col(y) for x, y in zip(lefts, rights)]
    if max(_bytes(left), _bytes(right)) < setting(spark, "skewBytes"):
        return left.join(right, functools.reduce(operator.and_, equal), "full")
    kinds = [dict(d.dtypes)[c] for d, names in ((left, lefts), (right, rights)) for c in names]
    same, kinds = kinds[: len(lefts)] == kinds[len(lefts):], kinds[: len(lefts)]
    # keys of two types can't be looked up as values of one
    found = [frequent(d, names)[1] if same else {} for d, names in ((left, lefts), (right, rights))]
    hot = [{k: n for k, n in counts.items() if n >= limit} for counts in found]
    # a key that is frequent on both sides is salted on the one with more rows
    mine = [k for k, n in hot[0].items() if n >= hot[1].get(k, 0)]
    theirs = [k for k in hot[1] if k not in set(mine)]
    most = max([*(hot[0][k] for k in mine), *(hot[1][k] for k in theirs)], default=0)
    salts = int(min(1024, -(-most // limit)))
    if salts < 2:
        salts = 2 if mine or theirs else 1

    def salted(side: DataFrame, names, own, other, mark):
        missing = functools.reduce(operator.or_, (sf.col(c).isNull() for c in names))
        dealt = sf.pmod(sf.xxhash64(*side.columns) + sf.spark_partition_id(), sf.lit(max(salts, 64))).cast("int")
        one = sf.when(missing, dealt).when(_among(names, own, kinds), dealt % salts).otherwise(0)
        every = sf.sequence(sf.lit(0), sf.lit(salts - 1))
        return side.withColumn(f"{_SALT}_{mark}", sf.explode(sf.when(_among(names, other, kinds), every).otherwise(sf.array(one)))).withColumn(
            f"__in_{mark}", sf.lit(True))

    a, b = salted(left, lefts, mine, theirs, "l"), salted(right, rights, theirs, mine, "r")
    joined = a.join(b, functools.reduce(operator.and_, [*equal, sf.col(f"{_SALT}_l") == sf.col(f"{_SALT}_r")]), "full")
    copy = (sf.col("__in_r").isNull() & _among(lefts, theirs, kinds)) | (sf.col("__in_l").isNull() & _among(rights, mine, kinds))
    return joined.where(~copy).drop(f"{_SALT}_l", f"{_SALT}_r", "__in_l", "__in_r")


def _bytes(df: DataFrame) -> int:
    """Spark's estimate of the size, from file sizes and statistics alone."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
