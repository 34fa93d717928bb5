"""Numeric features of UTF-8 texts, and small linear models, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as sf

from tabframe.llm.common import held_out, written

#: Bytes looked at together in a long text.
BLOCK = 1 << 22
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gram_counts(data: np.ndarray, size: int, orders=(2, 3), lower=True, seed: int = 1) -> np.ndarray:
    """How often each of ``size`` (a power of two) hashed byte n-grams occurs in a text, whole and of any length."""
    out = np.zeros(size, np.int64)
    most = max(orders)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + most - 1]
        part = (LOWER[part] if lower else part).astype(np.uint32)
        for n in orders:
            # a gram belongs to the block that it starts in
            count = min(len(part) - n + 1, BLOCK)
            if count <= 0:
                continue
            code = np.full(count, seed * 0x9E3779B1 + n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                code = (code ^ part[i : i + count]) * np.uint32(0x01000193)
            code ^= code >> np.uint32(15)
            out += np.bincount(code & np.uint32(size - 1), minlength=size)
    return out


def shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies: vectors of length one, or zero."""
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def sampled(rows: DataFrame, label: str, per_label: int, key=("doc_id", "text"), seed: int = 7) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of ``key``, so that reruns agree.

    Labels are counted first: a summary of few rows. A label with fewer rows is taken whole.
    """
    counts = rows.groupBy(label).count().collect()
    chance = sf.pmod(sf.xxhash64(sf.lit(seed), *key), sf.lit(1 << 20)) / (1 << 20)
    share = sf.lit(0.0)
    for found, n in counts:
        share = sf.when(sf.col(label).eqNullSafe(sf.lit(found)), min(1.0, per_label / n)).otherwise(share)
    return rows.where(chance < share) if counts else rows


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_label: int, unlabelled: int, most: int) -> DataFrame:
    """Rows of ``docs`` with ``label``: a bounded sample of each of the labels 0 and 1 and of rows without (label -1), of
    rows that aren't held out and whose texts have at most ``most`` bytes. An id with both labels counts as 1.

    Ids alone are joined and sampled; about 2 * ``per_label`` + ``unlabelled`` of them are then looked up, which is
    what is broadcast.
    """
    marks = labels.where(sf.col(column).isin(0, 1)).groupBy("doc_id").agg(sf.max(column).alias("label"))
    ids = docs.where(~held_out() & (sf.octet_length("text") <= most)).select("doc_id").distinct()
    ids = ids.join(marks, "doc_id", "left").withColumn("label", sf.coalesce("label", sf.lit(-1)))
    chosen = sampled(ids.where("label >= 0"), "label", per_label, ("doc_id",))
    if unlabelled:
        chosen = chosen.union(sampled(ids.where("label < 0"), "label", unlabelled, ("doc_id",)))
    return docs.where(sf.octet_length("text") <= most).join(sf.broadcast(written(chosen, "sample")), "doc_id")


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """Logistic regressions on shared inputs, one per column of the 0/1 targets, fitted by accelerated gradient steps."""

    def __init__(self, steps: int = 200, decay: float = 1e-4):
        self.steps, self.decay = steps, decay

    def fit(self, x, y, weights=None):
        x = np.asarray(x, np.float64)
        y = np.asarray(y, np.float64).reshape(len(x), -1)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        x = np.hstack([x, np.ones((len(x), 1))]) / np.sqrt(x.shape[1] + 1)
        w = np.ones(y.shape) if weights is None else np.broadcast_to(np.asarray(weights, float).reshape(len(x), -1), y.shape)
        w = w / w.sum(0)
        beta = ahead = np.zeros((x.shape[1], y.shape[1]))
        # inputs are scaled so that this step is safe
        step = 1 / (0.25 * max(1e-9, np.linalg.eigvalsh((x * w.max(1)[:, None]).T @ x)[-1]) + self.decay)
        for i in range(self.steps):
            slope = x.T @ (w * (sigmoid(x @ ahead) - y)) + self.decay * ahead
            new = ahead - step * slope
            beta, ahead = new, new + (i / (i + 3)) * (new - beta)
        self.beta = beta
        return self

    def logits(self, x):
        x = np.clip((np.asarray(x, np.float64) - self.mean) / self.scale, -8, 8)
        return (x @ self.beta[:-1] + self.beta[-1]) / np.sqrt(x.shape[1] + 1)


def powers(count: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Powers of an odd number modulo 2 ** 64."""
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes hashed together; powers up to there, and of the inverse.
PART = 1 << 15
POWERS = powers(PART), powers(PART, pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_bounds(data: np.ndarray, inside: np.ndarray):
    """Starts and ends of the runs of bytes for which ``inside`` (by byte value) is true."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = inside[data]
    turn = np.diff(flags)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, ordered stretches of ``data``: a polynomial in its bytes, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        # sums from the start of a part on, brought back to the start of each stretch; a longer stretch is a part by itself
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + PART, "right")))
        part = data[first : ends[to - 1]]
        up, down = POWERS if len(part) <= PART else (powers(len(part)), POWERS[1][:1])
        sums = np.zeros(len(part) + 1, np.uint64)
        np.add(part, 1, out=sums[1:], dtype=np.uint64)
        sums[1:] *= up[: len(part)]
        np.cumsum(sums, out=sums)
        begin = starts[at:to] - first
        out[at:to] = (sums[ends[at:to] - first] - sums[begin]) * down[begin]
        at = to
    return mixed(out + (ends - starts).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
