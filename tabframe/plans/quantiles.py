"""Exact quantiles by radix selection, without ranking a column anywhere.

The bits of a double, with the sign turned round, order like the double itself.  Four passes settle 16 bits of every wanted
value each: a pass counts the values that agree with what is settled so far by their next 16 bits.  A count is a row per
non-empty slot, so what a task holds and sends is bounded, whatever the values are and however often they come.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as sf

#: Bits settled in a pass; the passes settle all 64.
BITS = 16
SLOTS = 1 << BITS
PASSES = range(64 // BITS)
#: Counts of slots that a task has at once: 64 MB. More columns and points take more jobs a pass.
MOST = 128


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order; -0.0 is 0.0, and NaN comes last."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_bits(bits: int) -> float:
    own = bits & ~(1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.uint64(own).view(np.float64))


@dataclass
class Wanted:
    """A value that is looked for: the one of ``rank`` (from 0) among those of column ``c`` whose first bits are ``prefix``."""

    c: int
    rank: int
    prefix: int = 0


def histogram(rows: DataFrame, prefixes: list[tuple[int, int]], done: int) -> DataFrame:
    """(p, slot, n): for each (column, prefix) how many values that begin with the prefix have which next bits."""
    columns = sorted({c for c, _ in prefixes})

    def run(batches):
        totals = np.zeros((len(prefixes), SLOTS), np.int64)
        for batch in batches:
            for c in columns:
                bits = ordered_bits(batch.column(c).drop_null().to_numpy(zero_copy_only=False))
                slots = (bits >> np.uint64(64 - BITS - done)) & np.uint64(SLOTS - 1)
                begin = bits >> np.uint64(64 - done) if done else np.zeros_like(bits)
                for p, (own, prefix) in enumerate(prefixes):
                    if own == c:
                        totals[p] += np.bincount(slots[begin == np.uint64(prefix)].astype(np.int64), minlength=SLOTS)
        p, slot = np.nonzero(totals)
        yield pa.RecordBatch.from_pydict({"p": p, "slot": slot, "n": totals[p, slot]})

    return rows.mapInArrow(run, "p long, slot long, n long").groupBy("p", "slot").agg(sf.sum("n").alias("n"))


def _settled(rows: DataFrame, prefixes: list[tuple[int, int]], done: int, ranks) -> list:
    """The slots of all prefixes in which their ranks lie; ``ranks`` makes the array column of them for some prefixes."""
    found = []
    for first in range(0, len(prefixes), MOST):
        some = prefixes[first : first + MOST]
        found += [(first + r.p, r) for r in _reached(histogram(rows, some, done), ranks(first, len(some)))]
    return found


def _reached(counts: DataFrame, ranks: Column) -> list:
    """The slots in which the ranks (an array column over ``p`` and ``total``) lie: p, slot, values before it, rank."""
    own = Window.partitionBy("p")
    upto = sf.sum("n").over(own.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select("p", "slot", "n", upto.alias("upto"), sf.sum("n").over(own).alias("total"))
    hits = placed.select("p", "slot", (sf.col("upto") - sf.col("n")).alias("before"), "upto", "total", sf.explode(ranks).alias("rank"))
    return hits.where((sf.col("rank") >= sf.col("before")) & (sf.col("rank") < sf.col("upto"))).distinct().collect()


def exact_quantiles(df: DataFrame, columns: dict[str, Column], points: list[float]) -> dict:
    """``{(name, point): value}`` with linear interpolation; columns without values are left out.

    Four jobs, each a pass over the columns, for all columns and points at once; what comes back is a row per wanted value.
    NULL is no value, and NaN is larger than any number.
    """
    names = list(columns)
    if not names or not points:
        return {}
    rows = df.select(*(columns[n].cast("double").alias(f"v{c}") for c, n in enumerate(names)))
    # the first pass also tells how many values there are, and with that the ranks
    target = [(sf.col("total") - 1) * sf.lit(float(p)) for p in points]
    ranks = sf.array_distinct(sf.array(*(f(t).cast("long") for t in target for f in (sf.floor, sf.ceil))))
    found = _settled(rows, [(c, 0) for c in range(len(names))], 0, lambda first, count: ranks)
    totals = {c: r.total for c, r in found}
    wanted = {(c, r["rank"]): Wanted(c, r["rank"] - r.before, r.slot) for c, r in found}
    for step in PASSES[1:]:
        prefixes = sorted({(w.c, w.prefix) for w in wanted.values()})
        places = {p: i for i, p in enumerate(prefixes)}
        asked = [sorted({w.rank for w in wanted.values() if (w.c, w.prefix) == p}) for p in prefixes]

        def ranks(first, count, asked=asked):
            lists = [sf.array(*(sf.lit(r).cast("long") for r in some)) for some in asked[first : first + count]]
            return sf.get(sf.array(*lists), sf.col("p").cast("int"))

        found = {(p, r["rank"]): r for p, r in _settled(rows, prefixes, step * BITS, ranks)}
        for w in wanted.values():
            row = found[places[w.c, w.prefix], w.rank]
            w.prefix, w.rank = w.prefix << BITS | row.slot, w.rank - row.before
    result = {}
    for c, total in totals.items():
        for point in points:
            at = (total - 1) * float(point)
            low, high = (from_bits(wanted[c, f(at)].prefix) for f in (math.floor, math.ceil))
            share = at - math.floor(at)
            result[names[c], point] = low if low == high or not share else (1 - share) * low + share * high
    return result
