"""Near copies among embeddings: tiles in the order of principal components, compared leading dimensions first."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as sf

from tabframe.llm.common import components, table, written

#: Least cosine of a link.
COSINE = 0.95
#: Vectors in a tile, about; vectors that the components and the cuts between tiles are fitted on.
TILE, SAMPLE = 2048, 8192
#: Leading dimensions after which products are bounded; the box of a tile covers the first ones.
LEADING = (8, 16, 32)
#: Rows of a tile that are compared at once.
ROWS = 512
#: Slack of the bounds: far more than rounding, far less than matters; of bounds in single precision.
SLACK, ROUNDING = 1e-9, 1e-5
#: Bytes of vectors in a file of tiles, about, and files at least; bytes of tiles that go to a Python worker at a time.
FILE_BYTES, LEAST_FILES, BATCH_BYTES = 4 << 20, 8, 4 << 20


class Axes:
    """Principal components of a sample, and cuts along the first two; other dimensionalities keep their own axes."""

    def __init__(self, sample: np.ndarray, tiles: int):
        self.size = sample.shape[1] if sample.size else 0
        self.turn = np.linalg.eigh(sample.T @ sample)[1][:, ::-1] if sample.size else np.zeros((0, 0))
        turned = sample @ self.turn
        strips = max(1, int(np.ceil(np.sqrt(tiles))))
        cut = lambda x, n: np.quantile(x, np.arange(1, n) / n) if len(x) and n > 1 else np.zeros(0)
        self.first = cut(turned[:, 0], strips) if self.size else np.zeros(0)
        strip = np.searchsorted(self.first, turned[:, 0]) if self.size else np.zeros(0, int)
        self.second = [cut(turned[strip == i, 1], -(-tiles // strips)) if self.size > 1 else np.zeros(0) for i in range(strips)]

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors along the axes."""
        x = _unit(x)
        return x @ self.turn if x.shape[1] == self.size else x

    def tile(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != self.size:
            return np.full(len(x), -1)
        turned = self.turned(x)
        strip = np.searchsorted(self.first, turned[:, 0])
        return np.array([s * 100_000 + np.searchsorted(self.second[s], t) for s, t in zip(strip, turned[:, 1] if self.size > 1 else turned[:, 0])], np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length one."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # scale first: squares must stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, e of the vectors that can link: no nulls, only finite components, not zero. Single precision stays so, which
    is half the bytes wherever vectors go; other kinds become arrays of double."""
    kind = dict(vectors.dtypes)["embedding"]
    e = sf.col("embedding") if kind == "array<float>" else sf.col("embedding").cast("array<double>")
    fine = sf.forall(e, lambda v: v.isNotNull() & ~sf.isnan(v) & (sf.abs(v) != float("inf")))
    some = sf.exists(e, lambda v: v != 0)
    return vectors.where(sf.col("vec_id").isNotNull() & fine & some).select(sf.col("vec_id").cast("long"), e.alias("e")).distinct()


def tiled(vectors: DataFrame, size: int = TILE) -> tuple[DataFrame, Axes]:
    """One row per tile: tile, dim, ids and x (packed numbers), low and high (its box along the leading axes)."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors", batch_bytes=BATCH_BYTES)
    total = rows.count()
    dims = {d: n for d, n in rows.groupBy(sf.size("e")).count().collect()}
    main = max(dims, key=lambda d: (dims[d], d), default=0)
    chance = sf.pmod(sf.xxhash64("vec_id", "e"), sf.lit(1 << 20)) < int(min(1, SAMPLE / max(1, total)) * (1 << 20)) + 1
    sample = rows.where((sf.size("e") == main) & chance).select("e").toPandas()["e"]
    x = np.array(sorted(map(tuple, sample)), np.float64).reshape(len(sample), main)
    if x.size:
        x = _unit(x)
    axes = Axes(x, -(-total // size))
    shared = spark.sparkContext.broadcast(axes)  # of fixed size but for the cuts, one per tile
    kind = _kind(rows)

    def place(batches):
        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch.column("e")))
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                x = np.asarray(part.column("e").flatten(), kind).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("vec_id"), "dim": pa.array(np.full(len(x), d), pa.int32()),
                    "tile": pa.array(shared.value.tile(x), pa.int64()), "x": [v.tobytes() for v in x]})

    # placed twice, first to be counted alone: that costs a product, and a table of all vectors less
    placed = rows.mapInArrow(place, "vec_id long, dim int, tile long, x binary")
    # a crowded tile is split by hash, so that none grows with a group of copies
    crowds = written(placed.groupBy("dim", "tile").count().select("dim", "tile", sf.ceil(sf.col("count") / size).alias("parts")), "crowds", batch_bytes=BATCH_BYTES)
    placed = placed.join(sf.broadcast(crowds), ["dim", "tile"]).withColumn(
        "part", sf.pmod(sf.xxhash64("vec_id", "x"), sf.col("parts"))).drop("parts")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.frombuffer(v, kind) for v in rows["x"]])
        lead = shared.value.turned(x)[:, : LEADING[0]]
        return pd.DataFrame({
            "name": [f"{rows['dim'].iloc[0]}.{rows['tile'].iloc[0]}.{rows['part'].iloc[0]}"], "dim": [rows["dim"].iloc[0]],
            "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "low": [lead.min(0)], "high": [lead.max(0)]})

    # files of a few tiles: pairs of tiles are made from pairs of files
    files = max(LEAST_FILES, total * max(1, main) * kind.itemsize // FILE_BYTES)
    keys = ["dim", "tile", "part"]
    packed = placed.repartition(files, *keys).groupBy(*keys).applyInPandas(
        pack, "name string, dim int, ids binary, x binary, low array<double>, high array<double>")
    return written(packed, "tiles", batch_bytes=BATCH_BYTES), axes


def _kind(rows: DataFrame) -> np.dtype:
    return np.dtype(np.float32 if dict(rows.dtypes)["e"] == "array<float>" else np.float64)


def tile_pairs(tiles: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Tiles (a, ids, x) and (b, ids2, x2) whose boxes are near enough to hold a link, each pair once, and each tile with itself.

    Boxes that meet nothing are rare where vectors lie all around, so that a tile meets most others: as rows of an exchange,
    pairs would be the vectors once for each tile. Here tasks read two files of tiles each and nothing is exchanged.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK)
    left = tiles.select(sf.col("name").alias("a"), "dim", "ids", "x", "low", "high")
    right = tiles.select(sf.col("name").alias("b"), sf.col("dim").alias("dim2"), sf.col("ids").alias("ids2"), sf.col("x").alias("x2"),
                         sf.col("low").alias("low2"), sf.col("high").alias("high2"))
    gap1, gap2 = (sf.zip_with(low, high, lambda x, y: x - y) for low, high in (("low", "high2"), ("low2", "high")))
    gaps = sf.zip_with(gap1, gap2, lambda x, y: sf.pow(sf.greatest(x, y, sf.lit(0.0)), 2.0))
    near = sf.aggregate(gaps, sf.lit(0.0), lambda s, x: s + x) <= reach**2 + SLACK
    met = left.hint("shuffle_replicate_nl").join(right, (sf.col("a") <= sf.col("b")) & (sf.col("dim") == sf.col("dim2")) & near)
    return met.select("a", "b", "dim", "ids", "ids2", "x", "x2")


class Side:
    """The vectors of a tile: unit vectors, these along the axes, and for each of LEADING the first of these with the norm of
    what follows, in single precision."""

    def __init__(self, x: np.ndarray, axes: Axes):
        self.unit = _unit(x)
        self.turned = axes.turned(self.unit)
        self.tails = {d: np.sqrt(np.maximum(0, 1 - (self.turned[:, :d] ** 2).sum(1))) for d in LEADING}
        self.lead = {d: np.hstack([self.turned[:, :d], self.tails[d][:, None]]).astype(np.float32) for d in LEADING}


def linked(x, y, axes: Axes, cosine: float = COSINE):
    """Indexes (i, j) of the pairs of rows of ``x`` and ``y`` with at least this cosine, a block of rows at a time.

    Products of leading dimensions are bounded by the norms of what follows, as one product more; pairs that cannot reach the
    cosine are left. When few pairs are open, their other dimensions are multiplied pair by pair. The last word is the cosine
    of the vectors as they are, in double precision.
    """
    a, b = (v if isinstance(v, Side) else Side(v, axes) for v in (x, y))
    least, start = cosine - SLACK, 0
    for at in range(0, len(a.unit), ROWS):
        part = slice(at, at + ROWS)
        pairs = None
        for step, d in enumerate(LEADING):
            if pairs is None and step >= start:
                open_ = a.lead[d][part] @ b.lead[d].T >= np.float32(cosine - ROUNDING)
                if np.count_nonzero(open_) < 0.005 * open_.size:
                    # blocks of a tile are alike: the next one begins where few pairs were open
                    pairs, start = np.divmod(np.flatnonzero(open_), len(b.unit)), step
            elif pairs is not None:
                i, j = pairs
                total = np.einsum("ij,ij->i", a.turned[part][i, :d], b.turned[j, :d])
                fit = total + a.tails[d][part][i] * b.tails[d][j] >= least
                pairs = i[fit], j[fit]
        if pairs is None:
            start = 0
            i, j = np.nonzero(a.unit[part] @ b.unit.T >= cosine)
        else:
            i, j = pairs
            fit = np.einsum("ij,ij->i", a.unit[part][i], b.unit[j]) >= cosine
            i, j = i[fit], j[fit]
        yield i + at, j


def forest(i, j, size: int) -> np.ndarray:
    """For nodes 0 to size - 1 and links (i, j), the smallest node of each node's component."""
    root = np.arange(size)
    while len(i):
        p, q = root[i], root[j]
        apart = p != q
        if not apart.any():
            break
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return root


def _compare(shared, cosine, kind):
    def run(batches):
        last, x = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                at = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                ids, others = np.frombuffer(at["ids"], np.int64), np.frombuffer(at["ids2"], np.int64)
                if at["a"] != last:  # a tile meets those of a file one after the other
                    last, x = at["a"], Side(np.frombuffer(at["x"], kind).reshape(len(ids), -1), shared.value)
                own = at["a"] == at["b"]
                y = x if own else Side(np.frombuffer(at["x2"], kind).reshape(len(others), -1), shared.value)
                count, count2 = np.zeros(len(ids), np.int64), np.zeros(len(others), np.int64)
                root = np.arange(len(ids) + len(others))
                for i, j in linked(x, y, shared.value, cosine):
                    other = ids[i] != others[j]
                    if own:
                        other &= i < j
                    i, j = i[other], j[other]
                    count += np.bincount(i, minlength=len(ids))
                    count2 += np.bincount(j, minlength=len(others))
                    # links and what is known so far, as one forest
                    known = np.flatnonzero(root != np.arange(len(root)))
                    shift = 0 if own else len(ids)
                    root = forest(np.concatenate([i, known]), np.concatenate([j + shift, root[known]]), len(root))
                names = np.concatenate([ids, others])
                counts = np.concatenate([count, count2])
                some = np.flatnonzero((counts > 0) | (root != np.arange(len(root))))
                yield pa.RecordBatch.from_pydict({"vec_id": names[some], "n": counts[some], "other": names[root[some]]})

    return run


def near_copies(vectors: DataFrame, cosine: float = COSINE, size: int = TILE) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors with at least this cosine are linked, whatever their other columns. Vectors that are null or zero, or
    hold null or non-finite components, link with nothing, nor do vectors of unlike length. A vec_id stands for all its
    rows: repeated rows are one vector and each get its result; links between different vectors of one id don't
    count. A row without vec_id links with nothing and is kept. Tiles of about ``size`` vectors are compared in pairs,
    each by one task, which returns counts and a spanning forest, never the links of a group one by one.
    """
    tiles, axes = tiled(vectors, size)
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    compare = _compare(shared, cosine, _kind(usable(vectors)))
    found = written(tile_pairs(tiles, cosine).mapInArrow(compare, "vec_id long, n long, other long"), "links", batch_bytes=BATCH_BYTES)
    counts = found.groupBy("vec_id").agg(sf.sum("n").alias("n_links"))
    groups = components(found.select("vec_id", "other"), "vec_id", "other").withColumnRenamed("node", "vec_id")
    own = sf.col("vec_id").cast("long")
    named = sf.coalesce("component", own)
    return vectors.select(own.alias("vec_id")).join(counts, "vec_id", "left").join(groups, "vec_id", "left").select(
        "vec_id", sf.coalesce("n_links", sf.lit(0).cast("long")).alias("n_links"), named.alias("component_id"),
        sf.coalesce(sf.col("vec_id") == named, sf.lit(True)).alias("kept"))


def op6_embeddings(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "embeddings"))
