"""What the corpus operators share: tables, text buffers, written intermediates, components."""

from __future__ import annotations

import ctypes
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as sf

from tabframe.plans.durable import shared_folder

#: ASCII white space, as a class of a regular expression.
SPACE = r"[\x20\x09-\x0D]"

# The code of these operators travels with the functions sent to executors.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch_rows: int | None = None, batch_bytes: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors. The shuffles that made it
    are given up at once, not when the driver happens to collect its garbage. ``batch_rows``, ``batch_bytes``: rows that go
    to a Python worker at a time at most, and bytes of them, about, where the session's number would be many MB of long
    values; both the executor and the worker hold a batch outside the heap, twice while it grows."""
    path, conf = fresh_folder(df.sparkSession, name), df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows and not 0 < int(conf.get(rows)) <= batch_rows:
        wanted[rows] = str(batch_rows)
    if batch_bytes and int(str(conf.get(size)).removesuffix("b")) > batch_bytes:
        wanted[size] = str(batch_bytes)
    before = {key: conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            conf.set(key, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame) -> int:
    """Partitions for an exchange that follows ``df``: the session's number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def held_out(key="doc_id"):
    """True for rows kept away from learning: crc32 of the id as text, modulo 3, is 1."""
    return sf.coalesce(sf.crc32(sf.col(key).cast("string")) % 3 == 1, sf.lit(False))


class Texts:
    """UTF-8 bytes of some texts in one buffer; text ``i`` is ``data[starts[i]:starts[i + 1]]``."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        kind = pa.large_binary()
        column = column.cast(pa.large_string()).cast(kind) if not pa.types.is_binary(column.type) else column.cast(kind)
        if column.null_count:
            column = column.fill_null(b"")
        _, offsets, data = column.buffers()
        starts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[starts[0] : starts[-1]]
        self.starts = starts - starts[0]

    def __len__(self):
        return len(self.starts) - 1

    @property
    def lengths(self):
        return np.diff(self.starts)


def pieces(batch: pa.RecordBatch, column: str, size: int = 4 << 20):
    """Slices of a batch with about ``size`` bytes of ``column``; a longer text is alone in its slice."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def tidy(run):
    """``run`` over the batches of a task; before and after it, what Arrow and the C library hold without using it goes back
    to the system: Python workers outlive their tasks, and what one stage has left would stand beside what the next needs."""

    def unused():
        pa.default_memory_pool().release_unused()
        # numpy's arrays are the C library's; one that can't do this has no such function
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)

    def tidied(batches):
        unused()
        yield from run(batches)
        unused()

    return tidied


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``; a component is named by its smallest node.

    Two-phase star contraction: every node passes the smallest node it knows to its larger neighbours, then to its
    smaller ones, until only stars are left. An edge stays an edge, so no node's neighbours are ever gathered in one row.
    """
    now = written(edges.select(sf.col(left).alias("u"), sf.col(right).alias("v")).where("u <> v").select(
        sf.greatest("u", "v").alias("u"), sf.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        ends = now.select(sf.col("u").alias("node"), sf.lit(1).alias("up"), sf.lit(0).alias("down")).union(
            now.select("v", sf.lit(0), sf.lit(1))).groupBy("node").agg(sf.sum("up").alias("up"), sf.max("down").alias("down"))
        # a star's edges lead to its centre, which leads nowhere: from then on nothing would change
        if ends.where((sf.col("up") > 1) | (sf.col("up") > 0) & (sf.col("down") > 0)).isEmpty():
            break
        both = now.union(now.select(sf.col("v"), sf.col("u")))
        least = both.groupBy("u").agg(sf.least(sf.min("v"), sf.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(sf.col("v").alias("u"), sf.col("m").alias("v")).union(
            least.where("m < u").select("u", sf.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(sf.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(sf.col("v").alias("u"), sf.col("m").alias("v")).union(
            least.select("u", sf.col("m").alias("v"))).distinct()
        now = written(small, "edges")
    return now.groupBy(sf.col("u").alias("node")).agg(sf.min("v").alias("component")).union(
        now.select(sf.col("v").alias("node"), sf.col("v").alias("component")).distinct())
