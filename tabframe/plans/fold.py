"""Folding all rows of a DataFrame into one state of bounded size."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as sf

from tabframe.plans.settings import setting

_KIND = "part long, state binary"


def fold(df: DataFrame, partial: Callable, merge: Callable):
    """The state of all rows, or None where there are no rows.

    ``partial(batch)`` gives the state of an Arrow batch, ``merge(a, b)`` that of two states together. Each task makes one
    state; states are merged in a tree, ``mergeFanIn`` at a time. None may have more than ``foldBytes`` when pickled.
    """
    limit, fan = setting(df.sparkSession, "foldBytes"), setting(df.sparkSession, "mergeFanIn")

    def packed(part, state):
        data = pickle.dumps(state)
        if len(data) > limit:
            raise ValueError(f"a state of {len(data)} bytes is larger than foldBytes ({limit}); it must not grow with the rows")
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "state": pa.array([data], pa.binary())})

    def summarize(batches):
        for state in folded((partial(data) for data in batches if data.num_rows), merge):
            yield packed(TaskContext.get().partitionId(), state)

    def merge_some(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_pylist()
        order = sorted(range(len(parts)), key=parts.__getitem__)
        states = (pickle.loads(table.column("state")[i].as_py()) for i in order)
        return pa.Table.from_batches([packed(parts[order[0]], state) for state in folded(states, merge)])

    states = df.mapInArrow(summarize, _KIND)
    for level in (fan, fan * fan):
        states = states.groupBy(sf.expr(f"part div {level}")).applyInArrow(merge_some, _KIND)
    last = states.groupBy(sf.lit("all")).applyInArrow(merge_some, _KIND).first()
    return pickle.loads(last.state) if last else None


def folded(states, merge) -> list:
    """The states as one, or none."""
    last = None
    for n, state in enumerate(states):
        last = state if n == 0 else merge(last, state)
    return [] if last is None else [last]
