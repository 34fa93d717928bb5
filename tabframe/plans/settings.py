"""Limits read from the session, so one cluster-wide setting governs every job."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name -> default; set with spark.conf.set("spark.tabframe.<name>", value)
DEFAULTS = {
    "rowsPerBucket": 1 << 16,        # target rows of one position bucket
    "maxBuckets": 1 << 15,           # most range buckets (bounds kept on the driver)
    "samplesPerBucket": 20,          # sampled keys per range bound
    "copiesPerChunk": 1 << 16,       # rows one task expands from a repeated row at a time
    "broadcastFiles": 1_000_000,     # most files whose offsets are broadcast
    "literalCells": 10_000,          # largest matrix written into the plan as literals
    "aggregateCells": 100,           # largest matrix product done as one aggregate
    "topRows": 1 << 16,              # most rows taken by a top-n merge; beyond, by position
    "transposeRows": 500,            # most rows a wide transpose may have
    "fetchRows": 1_000_000,          # most rows brought to the driver by cdata
    "loadTasks": 10_000,             # most tasks of an external load
    "exactQuantileRows": 1 << 16,    # most rows whose values describe() ranks in one aggregation
    "blockSide": 1024,               # rows or columns of a block in the product of two large matrices
    "blockCells": 1 << 20,           # cells of a block, about, that a task has of either matrix
    "mergeFanIn": 64,                # partial states merged per task by a user fold
    "foldBytes": 1 << 23,            # largest state of a fold over a whole frame
    "skewBytes": 1 << 28,            # estimated bytes from which on a full join looks for frequent keys
    "skewRows": 1 << 20,             # rows of a key from which on a full join deals them out
    "smallCells": 1 << 20,           # most cells of a matrix that is whole beside every batch
}


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(f"spark.tabframe.{name}", str(DEFAULTS[name])))
