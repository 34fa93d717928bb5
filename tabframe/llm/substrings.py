"""Long repeated passages, removed by prefix-free parsing and suffix arrays of the phrases that repeat."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as sf

from tabframe.llm.common import Texts, pieces, table, tasks, written
from tabframe.llm.features import mixed

#: Bytes of a string that must not occur again, and of the grams whose rolling hashes trigger phrases.
LENGTH, GRAM = 100, 48
#: Starts of strings in a phrase at most; bytes that are parsed together; phrases that a task merges at once.
LONGEST, STRETCH, MERGED = 63, 1 << 19, 1 << 18
#: Different phrases of one trigger that a task sends on; a trigger with more is hot.
DISTINCT = 4
#: Text bytes in a bucket of documents or of phrases, about.
BUCKET_BYTES = 4 << 20
ROOT = 0x9E3779B97F4A7C15
INVERSE = pow(ROOT, -1, 1 << 64)
#: A phrase: its trigger's hash, its own, its document (less a base) and place, and the strings that start in it.
PHRASE = np.dtype([("trigger", "<u8"), ("low", "<u4"), ("high", "<u2"), ("doc", "<u4"), ("at", "<u4"), ("count", "u1")])
#: Marks beside the count: a phrase of a hot trigger, sent for all of them; a phrase with its trigger at two places.
HOT, TWICE = 128, 64
#: A stretch of starts of strings in a document; trigger and hot are used for those that are still to be compared.
SPAN = np.dtype([("doc", "<i8"), ("at", "<u4"), ("count", "u1")])
OPEN = np.dtype([("trigger", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("count", "u1"), ("hot", "u1")])
PHRASES, REMOVED, COMPARED = 0, 1, 2
ROWS = "bucket long, kind int, base long, rows binary, bytes binary"


class Rolling:
    """Rolling hashes of stretches of bytes: polynomials modulo 2 ** 64 from one running sum."""

    powers = {}

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        known = Rolling.powers.get("up", np.zeros(0, np.uint64))
        if len(known) < n:
            for name, root in (("up", ROOT), ("down", INVERSE)):
                values = np.full(max(n, STRETCH + LENGTH), root, np.uint64)
                values[0] = 1
                Rolling.powers[name] = np.multiply.accumulate(values)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Rolling.powers["up"][: n - 1], out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        """Hashes of the stretches of ``width`` bytes from every place."""
        count = len(self.sums) - width
        if count <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[width:] - self.sums[:count]) * Rolling.powers["down"][:count])

    def of(self, starts, ends) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * Rolling.powers["down"][starts] + (ends - starts).astype(np.uint64))


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def parse(data: np.ndarray, starts: np.ndarray):
    """Phrases of texts ``data[starts[i]:starts[i + 1]]``: trigger, own hash, text, place, count of string starts, and
    whether the trigger is at two places, without which no two strings of a phrase are equal.

    Every string of LENGTH bytes has a trigger, the least rolling hash of its grams; a phrase is a run of starts whose
    strings share their trigger, with the bytes of these strings. So a phrase's last LENGTH - 1 bytes overlap what
    follows, and equal strings lie in phrases of equal trigger wherever they are.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), empty, empty, empty, empty > 0
    rolling = Rolling(data)
    grams, span = rolling.all(GRAM), LENGTH - GRAM + 1
    trigger = least(grams, span)
    # starts whose string leaves the text
    turn = np.zeros(len(data) + 1, np.int8)
    ends = starts[1:][np.diff(starts) > 0]
    begins = starts[:-1][np.diff(starts) > 0]
    np.add.at(turn, np.maximum(begins, ends - LENGTH + 1), 1)
    np.add.at(turn, ends, -1)
    inside = np.cumsum(turn[: len(trigger)], dtype=np.int8) == 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (trigger[1:] != trigger[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (trigger[1:] != trigger[:-1])
    begin = np.flatnonzero(new)
    count = np.flatnonzero(last) - begin + 1
    if len(count) and count.max() > LONGEST:
        parts = -(-count // LONGEST)
        turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, count = np.repeat(begin, parts) + turn * LONGEST, np.repeat(count, parts) - turn * LONGEST
        count = np.minimum(count, LONGEST)
    # grams that are the trigger of some string around them, and how many of them are a phrase's own
    around = ~least(~np.concatenate([np.zeros(span - 1, np.uint64), trigger, np.zeros(span - 1, np.uint64)]), span)
    triggers = np.flatnonzero(grams == around)
    low, high = np.searchsorted(triggers, begin), np.searchsorted(triggers, begin + count + span - 1)
    near = high - low
    index = np.arange(near.sum()) + np.repeat(low - (np.cumsum(near) - near), near)
    own = grams[triggers[index]] == np.repeat(trigger[begin], near)
    twice = np.bincount(np.repeat(np.arange(len(begin)), near), own, len(begin)) > 1
    text = np.searchsorted(starts, begin, "right") - 1
    return trigger[begin], rolling.of(begin, begin + count + LENGTH - 1), text, begin - starts[text], count, twice


def stretches(batch: pa.RecordBatch):
    """(keys, bytes, starts, offset of the first start in its text) of parts of a batch; long texts come in stretches
    that overlap so that every string is in one of them."""
    for piece in pieces(batch, "text", STRETCH):
        texts, keys = Texts(piece.column("text")), np.asarray(piece.column("key"), np.int64)
        if len(texts.data) <= STRETCH:
            yield keys, texts.data, texts.starts, 0
            continue
        for i, key in enumerate(keys):
            data = texts.data[texts.starts[i] : texts.starts[i + 1]]
            for at in range(0, max(1, len(data) - LENGTH + 1), STRETCH):
                part = data[at : at + STRETCH + LENGTH - 1]
                yield keys[i : i + 1], part, np.array([0, len(part)]), at


def _rows(bucket, kind, base, rows, data=b""):
    return {"bucket": int(bucket), "kind": kind, "base": int(base), "rows": rows.tobytes(), "bytes": data}


def _pack(found):
    kinds = {"bucket": pa.int64(), "kind": pa.int32(), "base": pa.int64(), "rows": pa.binary(), "bytes": pa.binary()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in found], t) for c, t in kinds.items()})


def _dealt(rows, buckets, kind, base=0):
    """``rows`` in one blob per bucket."""
    order = np.argsort(buckets, kind="stable")
    named, at = np.unique(buckets[order], return_index=True)
    return [_rows(b, kind, base, part) for b, part in zip(named, np.split(rows[order], at[1:]))] if len(rows) else []


def _slot(hashes, buckets: int):
    """Buckets of hashes; triggers are least ones, so they are mixed again to spread."""
    return (((mixed(hashes ^ np.uint64(ROOT)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _merged(trigger, own, doc, at):
    """Order by trigger, phrase and corpus order; which are the first of their phrase, and each trigger's index."""
    order = np.lexsort((at, doc, own, trigger))
    t, o = trigger[order], own[order]
    first = np.ones(len(order), bool)
    first[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
    group = np.cumsum(np.concatenate([[0], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    return order, first, group


def _spans(doc, at, count):
    out = np.zeros(len(doc), SPAN)
    out["doc"], out["at"], out["count"] = doc, at, count
    return out


def _opened(trigger, doc, at, count, hot):
    out = np.zeros(len(doc), OPEN)
    out["trigger"], out["doc"], out["at"], out["count"], out["hot"] = trigger, doc, at, count, hot
    return out


def _parse(buckets: int, docs: int):
    """Phrases of a task's texts, to the owners of their triggers; equal phrases of the task are merged first."""

    def flush(held):
        trigger, own, doc, at, count, twice = (np.concatenate(x) for x in zip(*held))
        own &= np.uint64((1 << 48) - 1)
        order, first, group = _merged(trigger, own, doc, at)
        trigger, own, doc, at, count, twice = (x[order] for x in (trigger, own, doc, at, count, twice))
        hot = np.bincount(group[first])[group] > DISTINCT
        later = ~first
        out = _dealt(_spans(doc[later], at[later], count[later]), doc[later] % docs, REMOVED)
        sent = first & hot
        out += _dealt(_opened(trigger[sent], doc[sent], at[sent], count[sent], 1), doc[sent] % docs, COMPARED)
        # of a hot trigger one phrase goes to the owner, marked
        lead = np.ones(len(group), bool)
        lead[1:] = group[1:] != group[:-1]
        sent = first & (~hot | lead)
        trigger, own, doc, at, marks = (x[sent] for x in (trigger, own, doc, at, count | HOT * hot | TWICE * twice))
        base = int(doc.min()) if len(doc) else 0
        for low in range(base, int(doc.max()) + 1 if len(doc) else 0, 1 << 32):
            near = (doc >= low) & (doc < low + (1 << 32))
            if near.any():
                rows = np.zeros(int(near.sum()), PHRASE)
                rows["trigger"], rows["low"], rows["high"] = trigger[near], own[near] & np.uint64(0xFFFFFFFF), own[near] >> np.uint64(32)
                rows["doc"], rows["at"], rows["count"] = doc[near] - low, at[near], marks[near]
                out += _dealt(rows, _slot(rows["trigger"], buckets), PHRASES, low)
        return _pack(out)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for keys, data, starts, offset in stretches(batch):
                trigger, own, text, at, count, twice = parse(data, starts)
                held.append((trigger, own, keys[text], at + offset, count, twice))
                size += len(trigger)
                if size >= MERGED:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _own(docs: int):
    """A bucket of triggers: later occurrences of a phrase are removed; phrases whose trigger has others too,
    or is in them twice, are open."""

    def run(part: pa.Table) -> pa.Table:
        kind = np.asarray(part.column("kind"))
        # what is settled already passes through
        out = [r for r in part.filter(pa.array(kind != PHRASES)).to_pylist()]
        blobs = part.filter(pa.array(kind == PHRASES))
        if blobs.num_rows:
            rows = [np.frombuffer(b, PHRASE) for b in blobs.column("rows").to_pylist()]
            base = np.repeat(np.asarray(blobs.column("base"), np.int64), [len(r) for r in rows])
            rows = np.concatenate(rows)
            doc, at = rows["doc"] + base, rows["at"].astype(np.int64)
            own = rows["low"].astype(np.uint64) | (rows["high"].astype(np.uint64) << np.uint64(32))
            order, first, group = _merged(rows["trigger"], own, doc, at)
            doc, at, trigger, count = doc[order], at[order], rows["trigger"][order], rows["count"][order]
            marked, twice, count = (count & HOT) > 0, (count & TWICE) > 0, count & LONGEST
            hot = np.bincount(group, marked)[group] > 0
            shared = np.bincount(group, first)[group] > 1
            later = ~first
            out += _dealt(_spans(doc[later], at[later], count[later]), doc[later] % docs, REMOVED)
            sent = first & (hot | shared | twice) & ~marked
            out += _dealt(_opened(trigger[sent], doc[sent], at[sent], count[sent], hot[sent]), doc[sent] % docs, COMPARED)
        return pa.Table.from_batches([_pack(out)])

    return run


def _cut(buckets: int):
    """The bytes of open phrases, from their documents to the owners of their triggers; of hot triggers each string goes
    by its own hash, once for all that this task has of it."""

    def run(texts: pa.Table, rows: pa.Table) -> pa.Table:
        out, blobs = [], [np.frombuffer(b, OPEN) for b in rows.column("rows").to_pylist()]
        if not blobs:
            return pa.Table.from_batches([_pack(out)])
        rows = np.concatenate(blobs)
        rows = rows[np.lexsort((rows["at"], rows["doc"]))]
        keys = np.asarray(texts.column("key"), np.int64)
        text = dict(zip(keys.tolist(), texts.column("text")))
        docs, at = np.unique(rows["doc"], return_index=True)
        cold, windows = {}, []
        for doc, part in zip(docs.tolist(), np.split(rows, at[1:])):
            data = np.frombuffer(text[doc].as_py() or b"", np.uint8)
            hot = part[part["hot"] > 0]
            own = part[part["hot"] == 0]
            for row, slot in zip(own, _slot(own["trigger"], buckets).tolist()):
                cold.setdefault(slot, []).append(
                    (row, data[row["at"] : int(row["at"]) + int(row["count"]) + LENGTH - 1].tobytes()))
            if len(hot):
                count = hot["count"].astype(np.int64)
                place = np.repeat(hot["at"].astype(np.int64), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                low, high = int(place.min()), int(place.max())
                hashes = Rolling(data[low : high + LENGTH]).all(LENGTH)[place - low]
                windows.append((hashes, np.full(len(place), doc), place, data))
        if windows:
            hashes, doc, place = (np.concatenate([w[i] for w in windows]) for i in range(3))
            of = np.repeat(np.arange(len(windows)), [len(w[0]) for w in windows])
            order = np.lexsort((place, doc, hashes))
            hashes, doc, place, of = hashes[order], doc[order], place[order], of[order]
            new = np.ones(len(order), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            slots = _slot(hashes, buckets)
            bytes_of = lambda k: windows[of[k]][3][place[k] : place[k] + LENGTH].tobytes()
            start = 0
            later = []
            for k in range(len(order)):
                if new[k]:
                    start = k
                same = k > start and bytes_of(k) == bytes_of(start)
                if same:
                    later.append(k)
                else:
                    row = _opened(hashes[k : k + 1], doc[k : k + 1], place[k : k + 1], 1, 1)[0]
                    cold.setdefault(int(slots[k]), []).append((row, bytes_of(k)))
            if later:
                later = np.array(later)[np.lexsort((place[later], doc[later]))]
                spans = joined(doc[later], place[later])
                out += _dealt(spans, spans["doc"] % buckets, REMOVED)
        for bucket, found in cold.items():
            out.append(_rows(bucket, COMPARED, 0, np.array([r for r, _ in found], OPEN), b"".join(b for _, b in found)))
        return pa.Table.from_batches([_pack(out)])

    return run


def suffix_order(data: np.ndarray, places: np.ndarray):
    """The part of a suffix array that is about ``places``: their order by the LENGTH bytes from each, and which equal the
    one before."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    offsets = [*range(0, LENGTH - 7, 8), LENGTH - 8] if LENGTH % 8 else [*range(0, LENGTH, 8)]
    columns = [words[places + o].astype(np.uint64) for o in offsets]
    order = np.lexsort(columns[::-1])
    same = np.ones(len(order), bool)
    same[:1] = False
    for column in columns:
        same[1:] &= column[order][1:] == column[order][:-1]
    return order, same


def _compare(docs: int):
    """A bucket of open phrases: the suffix array of the dictionary they form, with their places in the corpus, shows
    each string's first occurrence; the others are removed."""

    def run(part: pa.Table) -> pa.Table:
        kind = np.asarray(part.column("kind"))
        out = []
        for blob in part.filter(pa.array(kind == REMOVED)).column("rows").to_pylist():
            rows = np.frombuffer(blob, SPAN)
            out += _dealt(rows, rows["doc"] % docs, REMOVED)
        blobs = part.filter(pa.array(kind == COMPARED))
        if blobs.num_rows:
            rows = np.concatenate([np.frombuffer(b, OPEN) for b in blobs.column("rows").to_pylist()])
            data = np.frombuffer(b"".join(blobs.column("bytes").to_pylist()), np.uint8)
            count = rows["count"].astype(np.int64)
            base = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
            turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = np.repeat(base, count) + turn
            doc, at = np.repeat(rows["doc"], count), np.repeat(rows["at"].astype(np.int64), count) + turn
            # only strings whose hash comes again need their order
            hashes = Rolling(data).all(LENGTH)[place]
            order = np.argsort(hashes, kind="stable")
            again = np.zeros(len(order), bool)
            equal = hashes[order][1:] == hashes[order][:-1]
            again[1:] |= equal
            again[:-1] |= equal
            some = order[again]
            some = some[np.lexsort((at[some], doc[some]))]  # corpus order, which a stable order keeps among equals
            once = np.ones(len(some), bool)  # a phrase may have come twice
            once[1:] = (doc[some][1:] != doc[some][:-1]) | (at[some][1:] != at[some][:-1])
            some = some[once]
            order, same = suffix_order(data, place[some])
            later = some[order[same]]
            later = later[np.lexsort((at[later], doc[later]))]
            spans = joined(doc[later], at[later])
            out += _dealt(spans, spans["doc"] % docs, REMOVED)
        return pa.Table.from_batches([_pack(out)])

    return run


def joined(doc, at):
    """Spans of neighbouring starts, from starts in corpus order."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc)))
    count = at[np.append(first[1:], len(doc)) - 1] - at[first] + 1 if len(first) else count
    parts = -(-count // LONGEST)
    turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return _spans(np.repeat(doc[first], parts), np.repeat(at[first], parts) + turn * LONGEST,
                  np.minimum(LONGEST, np.repeat(count, parts) - turn * LONGEST))


def _removed(texts: pa.Table, rows: pa.Table):
    """Each text's bytes with its merged removed stretches."""
    blobs = [np.frombuffer(b, SPAN) for b in rows.column("rows").to_pylist()]
    spans = np.concatenate(blobs) if blobs else np.zeros(0, SPAN)
    spans = spans[np.lexsort((spans["at"], spans["doc"]))]
    for row in range(texts.num_rows):
        key = texts.column("key")[row].as_py()
        data = texts.column("text")[row].as_py() or b""
        a, b = np.searchsorted(spans["doc"], [key, key + 1])
        start = spans["at"][a:b].astype(np.int64)
        end = np.maximum.accumulate(start + spans["count"][a:b] + LENGTH - 1)
        new = np.ones(len(start), bool)
        new[1:] = start[1:] > end[:-1]
        first = np.flatnonzero(new)
        yield row, data, start[first], end[np.append(first[1:], len(end)) - 1] if len(first) else end


def _digest(texts: pa.Table, rows: pa.Table) -> pa.Table:
    out = {"doc_id": texts.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    for _, data, start, end in _removed(texts, rows):
        kept = hashlib.sha256()
        for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)]):
            kept.update(data[a:b])
        out["n_bytes"].append(len(data))
        out["n_removed"].append(int((end - start).sum()))
        out["n_spans"].append(len(start))
        out["kept_sha256"].append(kept.hexdigest())
    kinds = {"doc_id": pa.int64(), "kept_sha256": pa.string()}
    return pa.table({c: v if c == "doc_id" else pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def _kept(texts: pa.Table, rows: pa.Table) -> pa.Table:
    kept = [b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)]))
            for _, data, start, end in _removed(texts, rows)]
    return pa.table({"doc_id": texts.column("doc_id"), "kept": pa.array(kept, pa.binary())})


def _keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id, text (bytes): ``key`` is in corpus order and names one row. Ids that are null or repeat get other
    keys: rows are ordered by id, null last, then text, and numbered in that order where they lie."""
    rows = docs.select(sf.col("doc_id").cast("long").alias("doc_id"), sf.encode(sf.coalesce("text", sf.lit("")), "utf-8").alias("text"))
    odd = rows.groupBy("doc_id").count().where("doc_id is null or count > 1 or doc_id < 0").limit(1).count()
    if not odd:
        return rows.select(sf.col("doc_id").alias("key"), "doc_id", "text")
    order = [sf.asc_nulls_last("doc_id"), sf.col("text")]
    return written(rows.repartitionByRange(tasks(rows), *order).sortWithinPartitions(*order).select(
        sf.monotonically_increasing_id().alias("key"), "doc_id", "text"), "keyed")


def _spread(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The documents by key, the stretches to be removed, and the number of buckets."""
    keyed = _keyed(docs)
    size = keyed.agg(sf.sum(sf.octet_length("text"))).first()[0] or 0
    buckets = max(tasks(docs), size // BUCKET_BYTES)
    texts = keyed.withColumn("bucket", sf.pmod("key", sf.lit(buckets)))
    parsed_ = keyed.select("key", "text").mapInArrow(_parse(buckets, buckets), ROWS)
    settled = written(parsed_.groupBy("bucket").applyInArrow(_own(buckets), ROWS), "phrases")
    open_ = settled.where(sf.col("kind") == COMPARED)
    cut = texts.select("bucket", "key", "text").groupBy("bucket").cogroup(open_.groupBy("bucket")).applyInArrow(_cut(buckets), ROWS)
    compared = written(cut.groupBy("bucket").applyInArrow(_compare(buckets), ROWS), "compared")
    removed = settled.where(sf.col("kind") == REMOVED).union(compared)
    return texts, removed, buckets


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and kept (bytes): each text without the bytes covered by a string of LENGTH bytes that also starts earlier.

    Earlier means in a document with a smaller id or earlier in the same one; strings are judged on the input. A null
    text is empty; texts shorter than LENGTH bytes stay whole. Rows that share an id are documents of their own in
    the order of their texts, and rows without id come last. Other columns, whatever their names, are not looked at.

    Documents are parsed into phrases by triggers, so that equal strings lie in phrases of one trigger. Phrases that
    occur again are settled by their hashes; where phrases of one trigger differ, their bytes meet at the trigger's
    owner, which orders the suffixes of the distinct phrases. Tasks merge what they have before they send it: of any
    phrase or string, however frequent, an owner gets no more than one from each batch of a task.
    """
    texts, removed, _ = _spread(docs)
    return texts.groupBy("bucket").cogroup(removed.groupBy("bucket")).applyInArrow(_kept, "doc_id long, kept binary")


def repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what ``without_repeats`` leaves."""
    texts, removed, _ = _spread(docs)
    return texts.groupBy("bucket").cogroup(removed.groupBy("bucket")).applyInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_dedup(spark, sf_dir):
    return repeats(table(spark, sf_dir, "documents"))
