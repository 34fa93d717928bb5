"""Documents whose sets of word shingles are alike: a join on prefixes whose length adapts to what they would cost."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as sf

from tabframe.llm import common
from tabframe.llm.common import Texts, components, pieces, table, tidy
from tabframe.llm.embeddings import forest
from tabframe.llm.features import IS_SPACE, LOWER, mixed, word_bounds, word_hashes

#: Words of a shingle; a link needs 100 * common >= PERCENT * all.
SHINGLE, PERCENT = 5, 75
#: How far prefixes may be lengthened, in shares of a set: each step asks for as many more common shingles.
STEPS = (0.05, 0.1, 0.2, 0.4, 0.75)
#: Sets in which a task has a shingle, from which on the shingle counts as frequent there; and from which on it is hot.
FREQUENT, HOT = 2, 64
#: Entries that a task merges at once; pairs are looked at an eighth as many at a time.
MERGED = 1 << 21
#: Bytes that go to a Python worker at a time, and bytes of packed rows that it hands back, about.
BATCH_BYTES, PACKED = 8 << 20, 2 << 20
#: Bytes of text whose entries go to a bucket, about, and buckets at least.
BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 32
#: Sets that picked a shingle, from which on they are a crowd; sets in a tile of one; shingles that are counted together.
CROWD, TILE, COLUMNS = 16, 512, 4096
#: Parts that the pairs of a hub go to, at least; bytes of shingles in a part of a hub that needs more, about.
SALTS, PART_BYTES = 16, 4 << 20
OFTEN = (1 << 31) - 1
#: An entry: a shingle (the part its bucket doesn't tell), a set, its size and how many shingles it must share.
ENTRY = np.dtype([("low", "<u4"), ("set", "<i8"), ("size", "<u4"), ("need", "<u4"), ("hot", "u1")])
#: A shingle that a set shares with others: in how many sets it is, and the least need among the others.
SHARED = np.dtype([("set", "<i8"), ("token", "<i8"), ("size", "<u4"), ("need", "<u4"), ("count", "<u4"), ("other", "<u4")])
ENTRIES, REPLIES = 0, 1
ROWS = "bucket long, kind int, rows binary"
PAIRS = "a long, b long, pairs binary"
BASE = np.uint64(0x9E3779B97F4A7C15)
written = partial(common.written, batch_bytes=BATCH_BYTES)


def shingles(texts: Texts):
    """The distinct shingle hashes of each text, in order of hash: all of them joined, and the number of each text."""
    data = LOWER[texts.data]
    inside = ~IS_SPACE[data]
    flags = np.zeros(len(data) + 1, bool)
    flags[texts.starts[:-1][np.diff(texts.starts) > 0]] = True  # words end with their text
    begin = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | flags[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | np.concatenate([flags[1:-1], [True]]))) + 1 if len(data) else begin
    words = np.concatenate([np.zeros(0, np.uint64), *(
        word_hashes(data, begin[i : i + (1 << 18)], end[i : i + (1 << 18)]) for i in range(0, len(begin), 1 << 18))])
    first = np.searchsorted(begin, texts.starts)
    count = np.diff(first)
    # of every SHINGLE words in a row, also where they cross texts; these are left out
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE if len(rolled) else 0):
        rolled += words[i : i + len(rolled)]
        rolled *= BASE
    rolled = mixed(rolled)
    full = np.where(count < SHINGLE, count > 0, count - SHINGLE + 1)
    ends = np.cumsum(full)
    token = np.empty(int(full.sum()), np.uint64)
    for at, n, size, end in zip(first.tolist(), count.tolist(), full.tolist(), ends.tolist()):
        if n >= SHINGLE:
            # texts are sorted one by one: values alone, without their places
            token[end - size : end] = np.sort(rolled[at : at + size])
        elif n:
            token[end - 1] = mixed(np.array([_sequence(words[at : at + n])], np.uint64))[0]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    new[(ends - full)[full > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return token[new], kept[ends] - kept[ends - full]


def _sequence(words) -> int:
    token = len(words)  # sequences of unlike length differ
    for word in words.tolist():
        token = (token + word) * int(BASE) % (1 << 64)
    return token


def set_ids(token, count) -> np.ndarray:
    """An id of each set of shingles by its content; 0 for the empty one."""
    out = np.zeros(len(count), np.uint64)
    some = count > 0
    starts = np.cumsum(count) - count
    if some.any():
        out[some] = mixed(np.add.reduceat(mixed(token ^ BASE), starts[some]) + count[some].astype(np.uint64))
    return out.view(np.int64)


def required(size):
    """Shingles that a set of this size shares at least with any it links to."""
    return -(-PERCENT * size // 100)


def lengths(size, step: int):
    """Length of the prefix and the shingles to be shared in it, for sizes and a step of STEPS."""
    need = np.minimum(1 + (size * STEPS[step]).astype(np.int64), np.maximum(1, required(size)))
    return size - required(size) + need, need


def least_other(size):
    """The least need that any set can have that a set of this size links to."""
    return lengths(required(size), 0)[1]


def _repeated(token, times: int) -> np.ndarray:
    """Whether each shingle is there at least so many times: values are sorted alone, and only the shingles that agree in
    some of their bits with one that is are looked up."""
    inside = np.sort(token)
    often = np.unique(inside[times - 1 :][inside[times - 1 :] == inside[: len(inside) - times + 1]])
    del inside
    out = np.zeros(len(token), bool)
    if len(often):
        slots = np.zeros(1 << 22, bool)
        slots[often & np.uint64(len(slots) - 1)] = True
        for at in range(0, len(token), 1 << 18):
            part = token[at : at + (1 << 18)]
            maybe = np.flatnonzero(slots[part & np.uint64(len(slots) - 1)])
            place = np.minimum(np.searchsorted(often, part[maybe]), len(often) - 1)
            out[at + maybe] = often[place] == part[maybe]
    return out


def adapted(token, count):
    """The prefix of each set: its length and need. ``token`` are the sets' shingles in order, ``count`` of each.

    The cost of a prefix is judged by how many of its shingles are frequent among the sets at hand. A set none of whose
    shingles is frequent keeps the shortest prefix; others take the first step at which the frequent ones are too few for
    what is needed, so that they cost nothing; where there is none, the set is likely a near copy, and the
    second step does.
    """
    frequent = np.zeros(len(token) + 1, np.int32 if len(token) < OFTEN else np.int64)
    np.cumsum(_repeated(token, FREQUENT), out=frequent[1:])
    start = np.cumsum(count) - count
    length, need = lengths(count, 0)
    seen = frequent[start + length] - frequent[start]
    open_ = seen > 0
    middle = lengths(count, 1)
    length, need = np.where(open_, middle[0], length), np.where(open_, middle[1], need)
    for step in range(1, len(STEPS)):
        longer, more = lengths(count, step)
        fits = open_ & (frequent[start + longer] - frequent[start] < 0.8 * more)
        length, need = np.where(fits, longer, length), np.where(fits, more, need)
        open_ &= ~fits
    return length, need


def _pack(found):
    kinds = {"bucket": pa.int64(), "kind": pa.int32(), "rows": pa.binary()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in found], t) for c, t in kinds.items()})


def _dealt(rows, buckets, kind):
    order = np.argsort(buckets, kind="stable")
    named, at = np.unique(buckets[order], return_index=True)
    return [{"bucket": int(b), "kind": kind, "rows": part.tobytes()} for b, part in zip(named, np.split(rows[order], at[1:]))] if len(rows) else []


def _sent(rows, buckets, kind):
    """Batches of a row for each bucket, with what goes there: some buckets at a time, so that rows aren't held thrice."""
    if (buckets[1:] < buckets[:-1]).any():
        order = np.argsort(buckets, kind="stable")
        rows, buckets = rows[order], buckets[order]
    new = np.ones(len(buckets), bool)
    new[1:] = buckets[1:] != buckets[:-1]
    at = np.flatnonzero(new)
    named, ends, first = buckets[at], np.append(at[1:], len(rows)), 0
    while first < len(named):
        to = max(first + 1, int(np.searchsorted(ends, at[first] + PACKED // rows.itemsize, "right")))
        yield _pack([{"bucket": int(named[i]), "kind": kind, "rows": rows[at[i] : ends[i]].tobytes()} for i in range(first, to)])
        first = to


def _taken(values, start, length):
    """Stretches of ``values``, joined; no place is made for each value."""
    return np.concatenate([values[:0], *(values[a:b] for a, b in zip(start.tolist(), (start + length).tolist()))])


def _replies(token, sets, size, need, hot):
    """What sets share with others, from entries in order of shingle and set, each pair once. ``hot``: entries that stand
    for many; their own sets have their replies already."""
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    often = np.diff(np.append(first, len(token)))
    # least need among the others: the least, or for the entry that has it the second least
    order = np.lexsort((need, group))
    least = need[order][first] if len(first) else need[:0]
    second = np.where(often > 1, need[order][np.minimum(first + 1, len(token) - 1)], OFTEN) if len(first) else least
    alone = np.zeros(len(token), bool)
    alone[order[first]] = True
    any_hot = np.bincount(group, hot, len(first)) > 0
    keep = (often[group] > 1) & ~hot
    out = np.zeros(int(keep.sum()), SHARED)
    out["set"], out["token"], out["size"], out["need"] = sets[keep], token[keep].view(np.int64), size[keep], need[keep]
    out["count"] = np.where(any_hot, OFTEN, often)[group][keep]
    out["other"] = np.where(alone, second[group], least[group])[keep]
    return out


def _index(buckets: int):
    def flush(held):
        token, count, sets = (np.concatenate(x) for x in zip(*held))
        held.clear()
        # copies among these texts are one set
        _, once = np.unique(sets, return_index=True)
        once = once[count[once] > 0]
        start = (np.cumsum(count) - count)[once]
        own, sets = count[once], sets[once]
        token = _taken(token, start, own)
        length, need = adapted(token, own)
        token = _taken(token, np.cumsum(own) - own, length)
        sets, size, need = np.repeat(sets, length), *(np.repeat(x.astype(np.int32), length) for x in (own, need))
        # a shingle goes by its owner and part of its hash, mixed again because prefixes have the least hashes
        token = mixed(token ^ BASE)
        slot = ((token >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        token = (slot << np.uint64(32)) | (token & np.uint64(0xFFFFFFFF))
        order = np.argsort(token, kind="stable")  # sets are in order already
        token, sets, size, need = token[order], sets[order], size[order], need[order]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        often = np.diff(np.append(np.flatnonzero(new), len(token)))
        hot = np.repeat(often, often) >= HOT
        if hot.any():
            replies = _replies(token[hot], sets[hot], size[hot], need[hot], np.zeros(int(hot.sum()), bool))
            replies["count"] = OFTEN
            # a set of another batch may have a smaller need than all here, and only the owner would hear of it
            replies["other"] = least_other(replies["size"].astype(np.int64))
            yield from _sent(replies, replies["set"] % buckets, REPLIES)
            del replies
        # of a hot shingle the owner gets the two sets with the least needs, as the others see them
        crowded = np.flatnonzero(hot)
        rank = crowded[np.lexsort((need[crowded], token[crowded]))]
        sent = ~hot
        sent[rank[np.arange(len(rank)) - np.searchsorted(token[rank], token[rank]) < 2]] = True
        rows = np.zeros(int(sent.sum()), ENTRY)
        token = token[sent]
        rows["low"], rows["set"], rows["size"], rows["need"], rows["hot"] = token & np.uint64(0xFFFFFFFF), sets[sent], size[sent], need[sent], hot[sent]
        del sets, size, need, hot, sent, order, new
        yield from _sent(rows, (token >> np.uint64(32)).astype(np.int64), ENTRIES)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 21):
                token, count = shingles(Texts(piece.column("text")))
                held.append((token, count, set_ids(token, count)))
                size += len(token)
                if size >= MERGED:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _own(buckets: int):
    """A bucket of shingles: every set that shares one hears so."""

    def run(part: pa.Table) -> pa.Table:
        kind = np.asarray(part.column("kind"))
        out = part.filter(pa.array(kind != ENTRIES)).to_pylist()
        blobs = part.filter(pa.array(kind == ENTRIES))
        if blobs.num_rows:
            bucket = part.column("bucket")[0].as_py()
            rows = np.concatenate([np.frombuffer(b, ENTRY) for b in blobs.column("rows").to_pylist()])
            # hot entries first among those of one set, so that they are the ones kept
            rows = rows[np.lexsort((1 - rows["hot"], rows["set"], rows["low"]))]
            new = np.ones(len(rows), bool)
            new[1:] = (rows["low"][1:] != rows["low"][:-1]) | (rows["set"][1:] != rows["set"][:-1])
            rows = rows[new]
            token = rows["low"].astype(np.uint64) | np.uint64(bucket << 32)
            replies = _replies(token, rows["set"], rows["size"].astype(np.int64), rows["need"].astype(np.int64), rows["hot"] > 0)
            out += _dealt(replies, replies["set"] % buckets, REPLIES)
        return pa.Table.from_batches([_pack(out)])

    return run


def _picked(part: pa.Table) -> pa.Table:
    """A bucket of sets: each takes the rarest of its shared shingles, as many as could be the first in common."""
    rows = np.concatenate([np.zeros(0, SHARED), *(np.frombuffer(b, SHARED) for b in part.column("rows").to_pylist())])
    # a set may hear of a shingle more than once: from tasks that have its copies, and from the owner
    rows = rows[np.lexsort((rows["other"], -rows["count"].astype(np.int64), rows["token"], rows["set"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["set"][1:] != rows["set"][:-1]) | (rows["token"][1:] != rows["token"][:-1])
    rows = rows[new]
    rows = rows[np.lexsort((rows["token"], rows["count"], rows["set"]))]
    new = np.ones(len(rows), bool)
    new[1:] = rows["set"][1:] != rows["set"][:-1]
    first = np.flatnonzero(new)
    common = np.diff(np.append(first, len(rows)))
    group = np.cumsum(new) - 1
    left = common[group] - (np.arange(len(rows)) - first[group]) if len(rows) else np.zeros(0, np.int64)
    keep = left >= np.minimum(rows["need"], rows["other"])
    rows, left, share = rows[keep], left[keep], (common[group] / (rows["size"] - required(rows["size"].astype(np.int64)) + rows["need"]))[keep]
    return pa.table({"token": pa.array(rows["token"]), "set": pa.array(rows["set"]), "size": pa.array(rows["size"].astype(np.int64)),
                     "need": pa.array(rows["need"].astype(np.int64)), "left": pa.array(left.astype(np.int64)), "common": pa.array(share)})


def _ids(batches):
    for batch in batches:
        for piece in pieces(batch, "text", 1 << 21):
            token, count = shingles(Texts(piece.column("text")))
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "set": set_ids(token, count), "size": pa.array(count, pa.int64())})


def _members(batches):
    for batch in batches:
        for piece in pieces(batch, "text", 1 << 21):
            token, count = shingles(Texts(piece.column("text")))
            ends = np.cumsum(count)
            # of rows with one id, those whose text has the set
            own = np.flatnonzero(set_ids(token, count) == np.asarray(piece.column("set"), np.int64))
            yield pa.RecordBatch.from_pydict({
                "set": piece.column("set").take(pa.array(own)), "tokens": pa.array([token[ends[i] - count[i] : ends[i]].tobytes() for i in own], pa.binary())})


def _nameless(batches):
    for batch in batches:
        for piece in pieces(batch, "text", 1 << 21):
            token, count = shingles(Texts(piece.column("text")))
            ends = np.cumsum(count)
            yield pa.RecordBatch.from_pydict({
                "set": set_ids(token, count), "tokens": pa.array([token[e - n : e].tobytes() for e, n in zip(ends, count)], pa.binary())})


def _verified(pairs: pa.Table, hubs: pa.Table) -> pa.Table:
    """Pairs with a hub that pass the contract: hub's shingles once, the others' one by one."""
    if not hubs.num_rows or not pairs.num_rows:
        return pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})
    own = np.frombuffer(hubs.column("own")[0].as_py(), np.uint64)
    fit = []
    for tokens in pairs.column("theirs"):
        other = np.frombuffer(tokens.as_py(), np.uint64)
        place = np.minimum(np.searchsorted(own, other), len(own) - 1)
        common = int((own[place] == other).sum())
        fit.append(100 * common >= PERCENT * (len(own) + len(other) - common))
    found = pairs.filter(pa.array(fit))
    return pa.table({"x": found.column("x"), "y": found.column("y")})


def _salted(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y, size) with the salt of their part; size is that of y. A hub whose partners have more than SALTS times
    PART_BYTES of shingles gets more parts; there are few of these, as each has that many bytes."""
    large = pairs.groupBy("x").agg(sf.ceil(sf.sum("size") * 8 / PART_BYTES).alias("parts")).where(sf.col("parts") > SALTS)
    parts = sf.coalesce("parts", sf.lit(SALTS))
    return pairs.join(sf.broadcast(large), "x", "left").withColumn("salt", sf.pmod(sf.xxhash64("y"), parts)).drop("parts")


def _links(pairs: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of the pairs (x, y) that are links: each set's shingles go to its pairs, a hub's once to each salted part."""
    pairs, sized = pairs.drop("size"), pairs
    if pairs.isEmpty():
        return pairs
    named = pairs.select(sf.col("x").alias("set")).union(pairs.select("y")).distinct()
    members = _shingles_of(named, docs, ids)
    salted = _salted(sized).drop("size")
    left = salted.join(members.select(sf.col("set").alias("y"), sf.col("tokens").alias("theirs")), "y")
    hubs = salted.select(sf.col("x").alias("hub"), sf.col("salt").alias("part")).distinct().join(
        members.select(sf.col("set").alias("hub"), sf.col("tokens").alias("own")), "hub")
    return written(left.groupBy("x", "salt").cogroup(hubs.groupBy("hub", "part")).applyInArrow(_verified, "x long, y long"), "links")


def _crowds(strong: DataFrame) -> DataFrame:
    """set, crowds: up to eight shingles of each set that at least CROWD sets have picked, the most frequent ones, each with
    the number of tiles of its crowd."""
    often = strong.groupBy("token").agg(sf.count("*").alias("n"), _tiles(sf.count("*"), sf.sum("size"))).where(sf.col("n") >= CROWD)
    rank = Window.partitionBy("set").orderBy(sf.desc("n"), "token")
    return written(strong.join(often, "token").select("set", "token", "tiles", sf.row_number().over(rank).alias("place")).where(
        "place <= 8").groupBy("set").agg(sf.collect_list(sf.struct("token", "tiles")).alias("crowds")), "crowds")


def _tiles(sets, size):
    """In how many tiles so many sets go, with so many shingles in all: bounded in sets and in bytes."""
    return sf.greatest(sf.ceil(sets / TILE), sf.ceil(size * 8 / PART_BYTES)).alias("tiles")


def _common(token: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets have in common, by products of 0/1 matrices, some thousand shingles at a time."""
    flat, row = np.concatenate(token), np.repeat(np.arange(len(token)), [len(t) for t in token])
    names, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.zeros((len(token), len(token)), np.float32)
    shared = often > 1  # others add to the diagonal alone
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        some = np.zeros((len(token), min(COLUMNS, int(shared.sum()) - at)), np.float32)
        some[row[a:b], column[a:b] - at] = 1
        common += some @ some.T
    return common


def _linked(sets: np.ndarray, token: list[np.ndarray], pairs: np.ndarray | None = None):
    """The links among sets, as a forest; with ``pairs`` (their places) only these are looked at."""
    size = np.array([len(t) for t in token], np.int64)
    if pairs is None or len(pairs) > 2 * len(token):
        common = _common(token)
        fits = 100.0 * common >= PERCENT * (size[:, None] + size[None] - common.astype(np.float64))
        if pairs is None:
            i, j = np.nonzero(np.triu(fits, 1))
        else:
            i, j = pairs[fits[pairs[:, 0], pairs[:, 1]]].T
    else:
        found = []
        for i, j in pairs.tolist():
            place = np.minimum(np.searchsorted(token[i], token[j]), size[i] - 1)
            common = int((token[i][place] == token[j]).sum())
            found.append(100 * common >= PERCENT * (size[i] + size[j] - common))
        i, j = pairs[np.array(found, bool)].T if len(pairs) else (size[:0], size[:0])
    root = forest(i, j, len(token))
    far = np.flatnonzero(root != np.arange(len(token)))
    return pa.RecordBatch.from_pydict({"x": pa.array(sets[root[far]]), "y": pa.array(sets[far])})


def _block(part: pa.Table) -> pa.Table:
    """Two tiles of a crowd: links among all their sets."""
    return pa.Table.from_batches([_linked(np.asarray(part.column("set")), [np.frombuffer(t.as_py(), np.uint64) for t in part.column("tokens")])])


def _crowd_links(crowds: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Links within crowds: tiles of each are compared in pairs inside tasks, which return forests."""
    members = _shingles_of(crowds.select("set"), docs, ids)
    placed = crowds.select("set", sf.explode("crowds").alias("c")).select(
        "set", sf.col("c.token").alias("token"), sf.col("c.tiles").cast("int").alias("tiles")).withColumn(
        "tile", sf.pmod(sf.xxhash64("set"), sf.col("tiles")).cast("int"))
    other = sf.explode(sf.sequence(sf.lit(0), sf.col("tiles") - 1)).alias("other")
    met = placed.select("set", "token", "tile", other).select(
        "set", "token", sf.least("tile", "other").alias("a"), sf.greatest("tile", "other").alias("b"))
    return written(met.join(members, "set").groupBy("token", "a", "b").applyInArrow(_block, "x long, y long"), "links")


def _reached(sets, rows: int):
    """Places of two sets, one in a row and one in the row ``rows`` further on (or back), that could link by what the first
    shares with others: only sets that share what they need reach others, and only those of a size that could link."""
    strong = np.flatnonzero(sets.left >= sets.need)
    base = (sets.row[strong] + rows) % (2 * rows) * OFTEN
    low = np.searchsorted(sets.order, base + required(sets.size[strong]))
    count = np.searchsorted(sets.order, base + 100 * sets.size[strong] // PERCENT, "right") - low
    ends, at = np.cumsum(count), 0
    while at < len(strong):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - count[at] + (MERGED >> 3), "right")))
        i = np.repeat(strong[at:to], count[at:to])
        j = np.arange(len(i)) + np.repeat(low[at:to] - (ends[at:to] - count[at:to] - (ends[at] - count[at])), count[at:to])
        fits = (sets.group[i] != sets.group[j]) & (sets.need[i] <= sets.left[j]) & (sets.need[i] <= sets.need[j])
        yield i[fits], j[fits]
        at = to


def _met(batches):
    """Packs of sets that share a shingle, two in a row or one with itself: the pairs that could link, by the tiles of their
    sets. A pair that meets at several shingles of a batch is sent once, unless there are too many pairs to be held."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sets = _Pack(pa.concat_arrays([batch.column("rows"), batch.column("other")]))
        names, first, code = np.unique(sets.set, return_index=True, return_inverse=True)
        found, held = [], 0
        for i, j in _reached(sets, batch.num_rows):
            found.append(np.unique(np.minimum(code[i], code[j]) * len(names) + np.maximum(code[i], code[j])))
            held += len(found[-1])
            if held > MERGED >> 3:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
                if held > MERGED >> 4:
                    yield _by_tiles(sets, first, found[0])
                    found, held = [], 0
        if held:
            yield _by_tiles(sets, first, np.unique(np.concatenate(found)))


def _by_tiles(sets, first, met):
    """The pairs ``met`` (by the numbers of their sets, whose places are ``first``) that were in no crowd together, packed by
    their two tiles."""
    rows = [np.zeros((0, 4), np.int64)]
    for part in range(0, len(met), MERGED >> 4):
        some = met[part : part + (MERGED >> 4)]
        i, j = first[some // len(first)], first[some % len(first)]
        apart = ~(sets.crowds[i][:, :, None] == sets.crowds[j][:, None, :]).any((1, 2))
        rows.append(np.stack([c[k[apart]] for c in (sets.tile, sets.set) for k in (i, j)], axis=1))
    rows = np.concatenate(rows)
    turned = (rows[:, 0] > rows[:, 1]) | (rows[:, 0] == rows[:, 1]) & (rows[:, 2] > rows[:, 3])
    rows[turned] = rows[turned][:, [1, 0, 3, 2]]
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    parts = np.split(np.ascontiguousarray(rows[:, 2:]), np.flatnonzero(new)[1:]) if len(rows) else []
    return pa.RecordBatch.from_pydict({"a": pa.array(rows[new, 0]), "b": pa.array(rows[new, 1]), "pairs": pa.array([r.tobytes() for r in parts], pa.binary())})


class _Pack:
    """Lists of sets that picked a shingle, as arrays in order of list and size."""

    def __init__(self, column: pa.ListArray):
        flat = column.flatten()
        count = np.asarray(pa.compute.list_value_length(column), np.int64)
        row, size = np.repeat(np.arange(len(count)), count), np.asarray(flat.field("size"), np.int64)
        order = np.lexsort((size, row))
        self.row, self.size, self.order = row, size[order], row * OFTEN + size[order]
        self.set, self.need, self.left, self.group, self.tile = (
            np.asarray(flat.field(c), np.int64)[order] for c in ("set", "need", "left", "group", "tile"))
        # crowds of a set, filled up with numbers that no two places share
        self.crowds = -1 - np.arange(len(flat) * 8, dtype=np.int64).reshape(-1, 8)
        within = flat.field("crowds")
        number = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(within), 0), np.int64)
        column = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        self.crowds[np.repeat(np.arange(len(number)), number), column] = np.asarray(within.flatten(), np.int64)
        self.crowds = self.crowds[order]


def _once(part: pa.Table) -> pa.Table:
    """All pairs between two tiles, each once: sets meet at several shingles, in several batches."""
    held, size = [], 0
    for p in part.column("pairs"):
        held.append(np.frombuffer(p.as_py(), np.int64).reshape(-1, 2))
        size += len(held[-1])
        if size > MERGED >> 3:
            held = [_distinct(held)]
            size = 0  # of what is added to it
    return part.slice(0, 1).set_column(2, "pairs", pa.array([_distinct(held).tobytes()], pa.binary()))


def _distinct(held):
    pairs = np.concatenate(held)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
    return pairs[new]


def _sets_of(batches):
    """The sets of the pairs between two tiles, each once."""
    for batch in batches:
        found = [np.unique(np.frombuffer(p.as_py(), np.int64)) for p in batch.column("pairs")]
        times = [len(f) for f in found]
        flat = np.concatenate([np.zeros(0, np.int64), *found])
        tiles = [np.repeat(np.asarray(batch.column(c), np.int64), times) for c in "ab"]
        yield pa.RecordBatch.from_pydict({"c": tiles[0], "d": tiles[1], "set": flat})


def _compared(pairs: pa.Table, members: pa.Table) -> pa.Table:
    """The pairs between two tiles that are links."""
    wanted = np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(p.as_py(), np.int64).reshape(-1, 2) for p in pairs.column("pairs"))])
    sets = np.asarray(members.column("set"))
    order = np.argsort(sets)
    token = [np.frombuffer(members.column("tokens")[i].as_py(), np.uint64) for i in order.tolist()]
    return pa.Table.from_batches([_linked(sets[order], token, np.searchsorted(sets[order], wanted))])


def _rest_links(index: DataFrame, known: DataFrame, crowds: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Links between sets that share a shingle both have picked, aren't joined yet and were in no crowd together.

    The sets that picked a shingle are packed, and packs meet in pairs inside tasks. Sets go to tiles by the most frequent of
    their shingles, so that sets that meet are mostly in one tile; pairs are sent packed by their two tiles, and the shingles
    of a set once for all its pairs between these. So no row is of a single pair.
    """
    groups = known.select(sf.col("node").alias("set"), "component")
    live = index.join(groups, "set", "left").withColumn("group", sf.coalesce("component", "set")).drop("component", "common")
    apart = live.groupBy("token").agg(sf.count("*").alias("n"), (sf.min("group") != sf.max("group")).alias("apart")).where("apart").drop("apart")
    live = written(live.join(apart, "token"), "apart")
    leads = live.groupBy("set").agg(sf.max_by("token", sf.struct("n", "token")).alias("lead"), sf.max("size").alias("size"))
    parts = leads.groupBy("lead").agg(_tiles(sf.count("*"), sf.sum("size")))
    tile = sf.xxhash64("lead", sf.pmod(sf.xxhash64("set"), sf.col("tiles"))).alias("tile")
    tiles = leads.join(parts, "lead").select("set", tile).join(
        crowds.select("set", sf.col("crowds.token").alias("crowds")), "set", "left")
    tiles = written(tiles, "tiles")
    fields = sf.struct("set", "size", "need", "left", "group", "tile", "crowds")
    # a group with many of a token's sets has packs of its own, which don't meet each other
    large = live.groupBy("token", "group").agg(sf.count("*").alias("most")).where(sf.col("most") >= TILE)
    rest = sf.col("n") - sf.coalesce("taken", sf.lit(0))
    parted = live.join(large, ["token", "group"], "left").join(
        large.groupBy("token").agg(sf.sum("most").alias("taken")), "token", "left")
    pack = sf.pmod(sf.xxhash64("set"), sf.ceil(sf.coalesce("most", rest) / TILE)).alias("pack")
    lot = sf.when(sf.col("most").isNotNull(), sf.col("group")).otherwise(0).alias("lot")
    packs = parted.join(tiles, "set").groupBy("token", lot, pack).agg(sf.collect_list(fields).alias("rows"))
    packs = written(packs, "packs")
    other = packs.select("token", sf.col("lot").alias("lot2"), sf.col("pack").alias("pack2"), sf.col("rows").alias("other"))
    meet = "lot < lot2 or lot = lot2 and lot = 0 and pack <= pack2"
    found = packs.join(other, "token").where(meet).select("rows", "other").mapInArrow(tidy(_met), PAIRS)
    met = written(found.groupBy("a", "b").applyInArrow(_once, PAIRS), "pairs")
    if met.isEmpty():
        return met.select(sf.col("a").alias("x"), sf.col("b").alias("y"))
    needed = met.mapInArrow(tidy(_sets_of), "c long, d long, set long")
    members = _shingles_of(needed.select("set").distinct(), docs, ids)
    sent = needed.join(members, "set")
    return written(met.groupBy("a", "b").cogroup(sent.groupBy("c", "d")).applyInArrow(_compared, "x long, y long"), "links")


def _shingles_of(sets: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """set, tokens: the shingles of each set, taken from one document that has it."""
    lead = ids.join(sets, "set", "left_semi").groupBy("set").agg(sf.min("doc_id").alias("lead"))
    texts = docs.join(lead, sf.col("doc_id") == sf.col("lead")).select("set", "text")
    # sets that only rows without id have: these rows are read once more and keep the sets that are wanted
    nameless = docs.where("doc_id is null").select("text").mapInArrow(tidy(_nameless), "set long, tokens binary").join(
        lead.where("lead is null"), "set", "left_semi").dropDuplicates(["set"])
    return written(texts.mapInArrow(tidy(_members), "set long, tokens binary").union(nameless), "members")


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) with further links (x, y): a component that is known counts as one node."""
    if links.isEmpty():
        return known
    ends = links
    for end in "xy":
        named = known.select(sf.col("node").alias(end), sf.col("component").alias(f"of_{end}"))
        ends = ends.join(named, end, "left").withColumn(f"of_{end}", sf.coalesce(f"of_{end}", end))
    more = written(components(ends, "of_x", "of_y"), "joined")
    new = more.join(known.select("node"), "node", "left_anti")
    wider = more.select(sf.col("node").alias("component"), sf.col("component").alias("wider"))
    return known.join(wider, "component", "left").select("node", sf.coalesce("wider", "component").alias("component")).union(
        new.select("node", "component"))


def set_groups(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, component) of every set that links: components of links between sets, enough of them to join all that are
    linked, each with at least the wanted similarity."""
    text = sf.encode(sf.coalesce("text", sf.lit("")), "utf-8").alias("text")
    size = docs.agg(sf.sum(sf.octet_length("text"))).first()[0] or 0
    # by size alone: entries go from every bucket to every other, so more buckets than the texts need are many small rows
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    dealt = docs.select(text).mapInArrow(tidy(_index(buckets)), ROWS).groupBy("bucket").applyInArrow(_own(buckets), ROWS)
    index = written(dealt.groupBy("bucket").applyInArrow(
        _picked, "token long, set long, size long, need long, left long, common double"), "index")
    docs = docs.select("doc_id", text)
    strong = index.where("left >= need")
    other = index.select("token", sf.col("set").alias("y"), sf.col("size").alias("size2"), sf.col("need").alias("need2"), sf.col("left").alias("left2"))
    # first each set against the hub of each of its shingles: the one that shares most
    hubs = strong.groupBy("token").agg(sf.max_by(sf.struct("set", "size", "need"), sf.struct("common", "set")).alias("hub")).select(
        "token", sf.col("hub.set").alias("x"), sf.col("hub.size").alias("size"), sf.col("hub.need").alias("need"))
    fits_hub = (sf.least("need", "need2") <= sf.col("left2")) & (100 * sf.least("size", "size2") >= PERCENT * sf.greatest("size", "size2"))
    tried = written(hubs.join(other, "token").where(fits_hub & (sf.col("x") != sf.col("y"))).select(
        "x", "y", sf.col("size2").alias("size")).distinct(), "pairs")
    links = _links(tried, docs, ids)
    # then all pairs in crowds that picked a shingle, inside tasks
    crowds = _crowds(strong)
    if not crowds.isEmpty():
        links = links.union(_crowd_links(crowds, docs, ids))
    # then what shares a shingle, isn't joined yet and was in no crowd together
    known = written(components(links, "x", "y"), "joined")
    return _joined(known, _rest_links(index, known, crowds, docs, ids))


def similar(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    A document's set holds its shingles of five words, lower case (A to Z only), split at ASCII white space; of fewer
    words the whole sequence; a null, empty or blank text has none and links with nothing. Documents link when their
    sets have at least 75 % of their shingles in common. component_id is the smallest doc_id that links lead to. Copies
    are one set from the start. A row without doc_id takes part but names no component, so that a group of such rows
    only has component_id null; repeated rows each get their result. Other columns are not looked at.

    Two sets that link share at least k shingles among the first ``size - required + k`` of each, for every k. Each set
    chooses k by what its prefix would cost. Of a pair, the smaller k holds. So a set that shares fewer shingles than
    that is left before any pair is made, and of the rest only pairs are made that meet in their rarest shared shingles.
    """
    text = sf.encode(sf.coalesce("text", sf.lit("")), "utf-8").alias("text")
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, set long, size long"
    ids = written(docs.select("doc_id", text).mapInArrow(tidy(_ids), kind), "sets")
    some = ids.where("size > 0")
    groups = set_groups(docs, some)
    lowest = some.groupBy("set").agg(sf.min("doc_id").alias("lowest"))
    named = lowest.join(groups.withColumnRenamed("node", "set"), "set", "left").withColumn("component", sf.coalesce("component", "set"))
    names = named.groupBy("component").agg(sf.min("lowest").alias("component_id"))
    by_set = written(named.join(names, "component").select("set", "component_id"), "components")
    found = some.join(by_set, "set").select("doc_id", sf.col("size").alias("n_shingles"), "component_id")
    return found.union(ids.where("size = 0").select("doc_id", "size", "doc_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group: the one that names it, and once if its row is repeated. Empty documents
    and rows without id stay."""
    keep = similar(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns).union(
        docs.where("doc_id is null"))


def op3_jaccard_join(spark, sf_dir):
    return similar(table(spark, sf_dir, "documents"))
