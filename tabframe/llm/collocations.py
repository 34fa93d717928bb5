"""Phrases whose words belong together: Apriori-safe candidates, counted by broadcast double-array tries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as sf

from tabframe.llm.common import Texts, pieces, table, written
from tabframe.llm.features import LOWER, mixed, word_bounds, word_hashes

#: Words of a phrase, at most; how often a candidate occurs at least; phrases of a language that are returned.
WORDS, LEAST, TOP = 4, 30, 2000
#: A candidate goes if a longer one that holds it is at least this often there, in percent.
COVERED = 80
#: Bits of a filter of hashes, as a power of two: fixed in size; where it fills up it only filters less.
FILTER_BITS = 26
#: Candidates of one trie: about 100 bytes each are broadcast. More candidates are counted in more passes.
TRIE_PHRASES = 1 << 19
#: Bytes of text looked at together, and words that are hashed together.
PIECE_BYTES, BLOCK = 4 << 20, 1 << 18
#: States whose counts are sent together, and in how many parts counts are added up first.
SLICE, SALTS = 4096, 512
SUMS = "slice long, salt long, n binary"
#: Symbols of a trie: a word is a few of them, so that there are few however many words there are. Children that a state must
#: have to get a stretch of the double array for itself.
SYMBOLS, MANY = 64, 8
BASE = np.uint64(0x9E3779B97F4A7C15)
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IN_WORD = ~BREAK
IN_WORD[[0x20, 0x09]] = False


class Words:
    """The words of some texts in order: lower case (A to Z only), their language, and whether the next one follows in the
    same piece."""

    def __init__(self, batch: pa.RecordBatch):
        lang = pc.dictionary_encode(batch.column("lang"))
        self.langs = lang.dictionary.cast(pa.large_string())
        column = batch.column("text").cast(pa.large_string())
        texts = Texts(pc.binary_join_element_wise(column, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))
        self.data = LOWER[texts.data]
        self.starts, self.ends = word_bounds(self.data, IN_WORD)
        piece = np.cumsum(BREAK[self.data], dtype=np.int64)[self.starts]  # every text ends with a break
        self.joined = np.append(piece[1:] == piece[:-1], False)[: len(piece)]
        count = np.diff(np.searchsorted(self.starts, texts.starts))
        self.lang = np.repeat(np.asarray(lang.indices, np.int64), count)

    def __len__(self):
        return len(self.starts)

    def hashes(self):
        return np.concatenate([np.zeros(0, np.uint64), *(
            word_hashes(self.data, self.starts[i : i + BLOCK], self.ends[i : i + BLOCK]) for i in range(0, len(self), BLOCK))])

    def texts(self, at=None, size: int = 1) -> pa.Array:
        """``size`` words each from the places ``at`` (all if None) on, joined by spaces."""
        at = np.arange(len(self)) if at is None else at
        lengths = [self.ends[at + i] - self.starts[at + i] + (i + 1 < size) for i in range(size)]
        offsets = np.concatenate([[0], np.cumsum(sum(lengths))])
        out = np.full(offsets[-1], 32, np.uint8)
        begin = offsets[:-1].copy()
        for i in range(size):
            width = self.ends[at + i] - self.starts[at + i]
            within = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            out[np.repeat(begin, width) + within] = self.data[np.repeat(self.starts[at + i], width) + within]
            begin += lengths[i]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))

    def lang_names(self, at) -> pa.Array:
        return self.langs.take(pa.array(self.lang[at]))


def lang_hashes(langs: pa.Array) -> np.ndarray:
    texts = Texts(langs)
    out = np.zeros(len(langs), np.uint64)
    some = texts.lengths > 0
    out[some] = word_hashes(texts.data, texts.starts[:-1][some], texts.starts[1:][some])
    return out


def extended(hashes, words):
    """Hashes of phrases that are one word longer."""
    return mixed((hashes ^ words) * BASE + words)


def phrase_hashes(words: Words, most: int):
    """For each number of words up to ``most`` the hashes of all phrases, by place; those that aren't within a piece mean
    nothing."""
    own = words.hashes()
    out = [extended(lang_hashes(words.langs)[words.lang], own)] if len(own) else [own]
    for i in range(1, most):
        out.append(extended(out[-1], np.append(own[i:], np.zeros(min(i, len(own)), np.uint64))))
    return out


def in_piece(words: Words, size: int):
    """Places where ``size`` words stand in one piece."""
    fits = np.ones(len(words), bool)
    for i in range(size - 1):
        fits &= np.append(words.joined[i:], np.zeros(min(i, len(words)), bool))
    return fits


def filter_of(hashes: DataFrame) -> np.ndarray:
    """A set of hashes (column ``h``) as bits: what is in it is always found, a little else is too. The bits are merged in
    Spark, and at most 2 ** FILTER_BITS of them come back."""
    place = sf.shiftrightunsigned("h", 64 - FILTER_BITS)
    found = hashes.select(place.alias("p")).groupBy(sf.shiftright("p", 6).alias("slot")).agg(
        sf.bit_or(sf.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[np.asarray(found.column("slot"))] = np.asarray(found.column("bits")).view(np.uint64)
    return bits


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - (6 + (len(bits) - 1).bit_length()))
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _batches(run):
    """Apply ``run`` to the words of pieces of batches."""

    def over(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                words = Words(piece)
                if len(words):
                    yield from run(words)

    return over


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, f: all words of each language."""

    def run(words):
        rows = pa.table({"lang": words.lang, "word": words.texts()}).group_by(["lang", "word"], use_threads=False).aggregate([([], "count_all")])
        yield pa.RecordBatch.from_pydict({"lang": words.langs.take(rows.column("lang").combine_chunks()), "word": rows.column("word").combine_chunks(),
                                          "n": rows.column("count_all").combine_chunks()})

    return texts.mapInArrow(_batches(run), "lang string, word string, n long").groupBy("lang", "word").agg(sf.sum("n").alias("f"))


def hashed(phrases: DataFrame) -> DataFrame:
    """h of (lang, word)."""

    def run(batches):
        for batch in batches:
            texts = Texts(batch.column("word"))
            own = word_hashes(texts.data, texts.starts[:-1], texts.starts[1:])
            yield pa.RecordBatch.from_pydict({"h": extended(lang_hashes(batch.column("lang")), own).view(np.int64)})

    return phrases.select("lang", "word").mapInArrow(run, "h long")


def supported(texts: DataFrame, below: np.ndarray, sizes: tuple[int, ...], shorter: int) -> DataFrame:
    """h of phrases of ``sizes`` words that occur LEAST times at least, all of whose phrases of ``shorter`` words are in
    ``below``. Hashes that collide are added up, so that nothing that is frequent is left out."""
    send = texts.sparkSession.sparkContext.broadcast(below)

    def run(words):
        hashes = phrase_hashes(words, max(sizes))
        known = has(send.value, hashes[shorter - 1]) & in_piece(words, shorter)
        found = []
        for size in sizes:
            able = in_piece(words, size)
            for i in range(size - shorter + 1):
                able &= np.append(known[i:], np.zeros(min(i, len(words)), bool))
            found.append(hashes[size - 1][able])
        h, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": n.astype(np.int64)})

    counted = texts.mapInArrow(_batches(run), "h long, n long").groupBy("h").agg(sf.sum("n").alias("n"))
    out = written(counted.where(sf.col("n") >= LEAST).select("h"), "phrases")
    send.destroy()
    return out


def spelled(texts: DataFrame, hashes: DataFrame) -> DataFrame:
    """lang, phrase of the phrases of two and more words whose hash is in ``hashes``."""
    send = texts.sparkSession.sparkContext.broadcast(filter_of(hashes))

    def run(words):
        for size, own in list(enumerate(phrase_hashes(words, WORDS), 1))[1:]:
            at = np.flatnonzero(in_piece(words, size) & has(send.value, own))
            h, first = np.unique(own[at], return_index=True)
            if len(h):
                yield pa.RecordBatch.from_pydict({
                    "h": h.view(np.int64), "lang": words.lang_names(at[first]), "phrase": words.texts(at[first], size)})

    rows = texts.mapInArrow(_batches(run), "h long, lang string, phrase string").distinct()
    out = written(rows.join(hashes, "h", "left_semi").select("lang", "phrase"), "phrases")
    send.destroy()
    return out


class Trie:
    """A double-array trie over words: from state ``s`` symbol ``c`` leads to ``base[s] + c`` if ``check`` there is ``s``. The
    symbols of a word are the digits of its number. The first states are the roots, one for each language."""

    def __init__(self, langs: pa.Array, phrases: pa.Array):
        """``states`` has the state of each phrase."""
        names = pc.dictionary_encode(langs)
        self.langs, root = lang_hashes(names.dictionary), np.asarray(names.indices, np.int64)
        words = pc.split_pattern(phrases, " ")
        size = np.asarray(pc.list_value_length(words), np.int64)
        coded = pc.dictionary_encode(words.flatten())
        texts = Texts(coded.dictionary)
        hashes = word_hashes(texts.data, texts.starts[:-1], texts.starts[1:])
        order = np.argsort(hashes)
        self.hashes, self.lengths = hashes[order], texts.lengths[order].astype(np.int32)
        number = np.empty(len(hashes), np.int64)
        number[order] = np.arange(len(hashes))  # a word's number is its place in the table that it is looked up in
        number = number[np.asarray(coded.indices, np.int64)]
        first, roots = np.cumsum(size) - size, len(self.langs)
        digits = symbols(number, len(hashes))
        self.used = np.zeros(roots, bool)
        self.used[:roots] = True
        self.base, self.check, state = np.zeros(roots, np.int64), np.full(roots, -1, np.int64), root.copy()
        alive = np.arange(len(size))
        for level in range(int(size.max(initial=0))):
            alive = alive[size[alive] > level]
            for digit in digits:
                keys, inverse = np.unique(state[alive] * SYMBOLS + digit[first[alive] + level], return_inverse=True)
                state[alive] = self._placed(keys // SYMBOLS, keys % SYMBOLS)[inverse]
        self.states = state
        # beyond the last state there are slots that no state has, so that no step leaves the arrays
        self.base = np.append(self.base, np.zeros(SYMBOLS)).astype(np.int32)
        self.check = np.append(self.check, np.full(SYMBOLS, -1)).astype(np.int32)
        del self.used

    def _room(self, size: int):
        more = size - len(self.used)
        if more > 0:
            self.used = np.append(self.used, np.zeros(more, bool))
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def _placed(self, parent, symbol):
        """States for the edges (parent, symbol), which are in order: those of one parent keep their distances.

        MANY children and more get a stretch for themselves. Smaller families draw places, all at once, and keep theirs if it
        is free and no other has drawn it; there are three times as many slots as states. Single children take any free slot.
        """
        out = np.empty(len(parent), np.int64)
        new = np.ones(len(parent), bool)
        new[1:] = parent[1:] != parent[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(parent)))
        family = np.cumsum(new) - 1
        large = count >= MANY
        begin = len(self.used) + (np.cumsum(large) - 1) * SYMBOLS
        edge = large[family]
        out[edge] = begin[family[edge]] + symbol[edge]
        self._room(len(self.used) + int(large.sum()) * SYMBOLS)
        self.used[out[edge]] = True
        rng = np.random.default_rng(1)
        for least, most in ((4, MANY), (2, 4)):  # larger ones first
            left = np.flatnonzero((count >= least) & (count < most))
            while len(left):
                self._room(3 * int(self.used.sum() + count[left].sum()) + 2 * SYMBOLS)
                # no more at once than leave most of the slots alone
                fit = max(1, int(np.searchsorted(np.cumsum(count[left]), len(self.used) // 8)))
                some, number = left[:fit], count[left[:fit]]
                edge = np.repeat(first[some] - (np.cumsum(number) - number), number) + np.arange(number.sum())
                who = np.repeat(np.arange(len(some)), number)
                slot = rng.integers(0, len(self.used) - SYMBOLS, len(some))[who] + symbol[edge]
                holder = np.full(len(self.used), -1, np.int32)
                holder[slot] = who
                bad = np.bincount(who, self.used[slot] | (holder[slot] != who), len(some)) > 0
                good = ~bad[who]
                out[edge[good]] = slot[good]
                self.used[slot[good]] = True
                left = np.concatenate([some[bad], left[fit:]])
        alone = first[count == 1]
        self._room(int(self.used.sum()) + len(alone) + SYMBOLS)
        free = np.flatnonzero(~self.used[SYMBOLS:])  # far enough from the start for any symbol
        if len(free) < len(alone):
            self._room(len(self.used) + len(alone) - len(free))
            free = np.flatnonzero(~self.used[SYMBOLS:])
        free = free[: len(alone)] + SYMBOLS
        out[alone] = free
        self.used[free] = True
        self.check[out] = parent
        self.base[parent] = out - symbol
        return out

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name in TRIE}

    @classmethod
    def opened(cls, row) -> Trie:
        out = cls.__new__(cls)
        for name, kind in TRIE.items():
            setattr(out, name, np.frombuffer(row[name], kind))
        return out

    def counts(self, words: Words) -> np.ndarray:
        """How often each state is reached from any place: all places advance together, word by word."""
        own = words.hashes()
        found = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        known = (self.hashes[found] == own) & (self.lengths[found] == words.ends - words.starts)
        steps = symbols(found, len(self.hashes))
        root = np.array([np.append(np.flatnonzero(self.langs == h), -1)[0] for h in lang_hashes(words.langs)])[words.lang]
        at = np.flatnonzero(known & (root >= 0))
        state, total = root[at], np.zeros(len(self.base), np.int64)
        for level in range(WORDS):
            if level:
                at, state = at[words.joined[at + level - 1]], state[words.joined[at + level - 1]]
                at, state = at[known[at + level]], state[known[at + level]]
            for symbol in steps:
                step = self.base[state] + symbol[at + level]
                able = self.check[step] == state
                at, state = at[able], step[able]
            total += np.bincount(state, minlength=len(total))
        return total


def symbols(number, words: int) -> list:
    """The digits of words' numbers below ``words``, the first one first."""
    places = max(1, -(-(words - 1).bit_length() // (SYMBOLS - 1).bit_length()))
    return [number // SYMBOLS**place % SYMBOLS for place in reversed(range(places))]


TRIE = {"langs": np.uint64, "hashes": np.uint64, "lengths": np.int32, "base": np.int32, "check": np.int32}


def _built(part: pa.Table) -> pa.Table:
    """The trie of a shard, and the state of each of its phrases."""
    part = part.combine_chunks().sort_by([("lang", "ascending"), ("phrase", "ascending")])
    trie = Trie(part.column("lang").combine_chunks(), part.column("phrase").combine_chunks())
    n, blank = part.num_rows, lambda c: pa.array([None] * part.num_rows + [trie.packed()[c]], pa.binary())
    own = {c: pa.array([*part.column(c).to_pylist(), None], pa.string()) for c in ("lang", "phrase")}
    shard = part.column("shard")[0].as_py()
    return pa.table({"shard": pa.array([shard] * (n + 1), pa.int64()), "state": pa.array([*trie.states.tolist(), None], pa.int64()),
                     **own, **{c: blank(c) for c in TRIE}})


def _summed(part: pa.Table) -> pa.Table:
    """Counts of the same states from several tasks, added up."""
    total = np.sum([np.frombuffer(n.as_py(), np.int64) for n in part.column("n")], axis=0)
    return pa.table({"slice": part.column("slice")[:1], "salt": part.column("salt")[:1], "n": pa.array([total.tobytes()], pa.binary())})


def _states(batches):
    for batch in batches:
        for at, n in zip(batch.column("slice"), batch.column("n")):
            total = np.frombuffer(n.as_py(), np.int64)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"state": some + at.as_py() * SLICE, "f": total[some]})


def phrase_counts(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, phrase, f of ``phrases`` (lang, phrase): shards of bounded size are built into tries inside tasks; each trie
    is broadcast and runs over all texts, whose counts of states are then summed."""
    spark, total = texts.sparkSession, phrases.count()
    shards = max(1, -(-total // TRIE_PHRASES))
    kind = "shard long, state long, lang string, phrase string, " + ", ".join(f"{c} binary" for c in TRIE)
    dealt = phrases.withColumn("shard", sf.pmod(sf.xxhash64("lang", "phrase"), sf.lit(shards)))
    built = written(dealt.groupBy("shard").applyInArrow(_built, kind), "tries")
    found = None
    for shard in range(shards if total else 0):
        row = built.where(sf.col("state").isNull() & (sf.col("shard") == shard)).select(*TRIE).first()
        if row is None:
            continue
        send = spark.sparkContext.broadcast(row.asDict())

        def run(batches):
            trie = Trie.opened(send.value)
            totals = np.zeros(len(trie.base), np.int64)
            for batch in batches:
                for piece in pieces(batch, "text", PIECE_BYTES):
                    words = Words(piece)
                    if len(words):
                        totals += trie.counts(words)
            salt = TaskContext.get().partitionId() % SALTS
            parts = [totals[at : at + SLICE] for at in range(0, len(totals), SLICE)]
            some = [i for i, part in enumerate(parts) if part.any()]
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array(some, pa.int64()), "salt": pa.array([salt] * len(some), pa.int64()),
                "n": pa.array([parts[i].tobytes() for i in some], pa.binary())})

        sums = texts.mapInArrow(run, SUMS).groupBy("slice", "salt").applyInArrow(_summed, SUMS).groupBy("slice").applyInArrow(_summed, SUMS)
        sums = sums.mapInArrow(_states, "state long, f long")
        sums = written(sums.withColumn("shard", sf.lit(shard).cast("long")), "counts")
        send.destroy()
        found = sums if found is None else found.union(sums)
    named = built.where("state is not null").select("shard", "state", "lang", "phrase")
    if found is None:
        return named.select("lang", "phrase", sf.lit(0).cast("long").alias("f"))
    return named.join(found, ["shard", "state"]).select("lang", "phrase", "f")


def _wide(column: str):
    return sf.col(column).cast("decimal(20,0)")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of candidates (lang, phrase, f), without those that a longer one covers."""
    parts = phrases.withColumn("words", sf.split("phrase", " "))
    known = phrases.union(words)
    cut = sf.explode(sf.sequence(sf.lit(1), sf.size("words") - 1))
    cuts = parts.select("lang", "phrase", sf.col("f").alias("a"), "words", cut.alias("k")).select(
        "lang", "phrase", "a", "k", sf.array_join(sf.slice("words", 1, sf.col("k")), " ").alias("left"),
        sf.array_join(sf.expr("slice(words, k + 1, size(words) - k)"), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", sf.col("phrase").alias(side), sf.col("f").alias(name)), ["lang", side])
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", (sf.lit(2_000_000).cast("decimal(7,0)") * _wide("a")).alias("high"),
                       (_wide("l") + _wide("r")).alias("low")).withColumn("score", sf.expr("cast(high div low as bigint)"))
    best = cuts.groupBy("lang", "phrase").agg(sf.max("a").alias("a"), sf.min(sf.struct("score", "k", "l", "r")).alias("best"))
    inner = parts.where("size(words) > 2").select("lang", "f", "words", sf.expr(
        "explode(flatten(transform(sequence(2, size(words) - 1), s -> transform(sequence(1, size(words) - s + 1), "
        "i -> array_join(slice(words, i, s), ' ')))))").alias("phrase")).groupBy("lang", "phrase").agg(sf.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(sf.col("longer").isNull() | (100 * _wide("longer") < COVERED * _wide("a")))
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Texts are lower-cased (A to Z), split at ``.,;:!?`` and line ends into pieces, and these at spaces and tabs into words. A
    candidate has two to WORDS words and occurs at least LEAST times (``a``, overlaps included) in its language, which has ``n``
    words. Of the cuts of a candidate, whose parts occur ``l`` and ``r`` times, the one with the lowest score counts, then the
    one with the shortest first part; the score is floor(2,000,000 a / (l + r)), computed in decimals. Candidates within a longer
    one that is at least COVERED percent as frequent go. Phrases are ranked by score, then a, both descending, then in byte order.

    Words are counted exactly. A longer phrase becomes a candidate if all its shorter ones may be frequent and its hash is: hashes
    that collide are added up, so this leaves out nothing, and what it lets in beyond is dropped when the tries have counted.
    What is broadcast has a bound: filters by FILTER_BITS, tries by TRIE_PHRASES; more candidates mean more passes. Words are
    looked up in a trie by a 64-bit hash and their length.

    A null lang is ``und``; a null, empty or blank text has no words; ids aren't looked at, and repeated rows count again. A
    text is held whole in one task, however long. An empty table, or one without frequent phrases, gives no rows. Of ``docs``,
    lang and text are read; other columns, whatever their names, are not looked at.
    """
    texts = docs.select(sf.coalesce(sf.col("lang"), sf.lit("und")).alias("lang"), sf.coalesce("text", sf.lit("")).alias("text"))
    words = written(word_counts(texts), "words")
    totals = words.groupBy("lang").agg(sf.sum("f").alias("n"))
    words = words.where(sf.col("f") >= LEAST)
    pairs = supported(texts, filter_of(hashed(words)), (2,), 1)
    longer = supported(texts, filter_of(pairs), tuple(range(3, WORDS + 1)), 2)
    phrases = phrase_counts(texts, spelled(texts, pairs.union(longer)))
    phrases = written(phrases.where(sf.col("f") >= LEAST), "phrases")
    best = scored(phrases, words.withColumnRenamed("word", "phrase"))
    rank = sf.row_number().over(Window.partitionBy("lang").orderBy(sf.desc("score"), sf.desc("a"), "phrase"))
    # the limit is on the rank itself, so that Spark cuts each task's candidates before they meet
    ranked = best.withColumn("rank", rank).where(sf.col("rank") <= top).withColumn("rank", sf.col("rank").cast("long"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
with parts as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as part from documents),
lists as (select lang, row_number() over () as piece, list_filter(regexp_split_to_array(part, '[\x20\x09]+'), lambda w: w <> '') as words from parts),
places as (select lang, piece, unnest(words) as w, generate_subscripts(words, 1) as i from lists),
runs as (
    select lang, w as a, lead(w, 1) over p as b, lead(w, 2) over p as c, lead(w, 3) over p as d
    from places window p as (partition by piece order by i)),
grams as (
    select lang, 1 as k, [a] as words from runs union all select lang, 2, [a, b] from runs where b is not null
    union all select lang, 3, [a, b, c] from runs where c is not null union all select lang, 4, [a, b, c, d] from runs where d is not null),
counts as (select lang, k, words, array_to_string(words, ' ') as phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from counts where k = 1 group by lang),
candidates as (select * from counts where k >= 2 and f >= 30),
cuts as (
    select c.lang, c.phrase, c.f as a, k.k as cut, x.f as l, y.f as r, ((2000000::hugeint * c.f) // (x.f + y.f))::bigint as score
    from candidates c join (select unnest([1, 2, 3]) as k) k on k.k < c.k
    join counts x on x.lang = c.lang and x.phrase = array_to_string(c.words[1 : k.k], ' ')
    join counts y on y.lang = c.lang and y.phrase = array_to_string(c.words[k.k + 1 : c.k], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
covered as (
    select c.lang, array_to_string(c.words[i.i + 1 : i.i + s.s], ' ') as phrase, max(c.f) as longer
    from candidates c join (select unnest([2, 3]) as s) s on s.s < c.k join (select unnest([0, 1, 2]) as i) i on i.i + s.s <= c.k
    group by all),
ranked as (
    select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
    from best b left join covered v on v.lang = b.lang and v.phrase = b.phrase
    where v.longer is null or 100::hugeint * v.longer < 80::hugeint * b.a)
select r.lang, rank, phrase, a, l, r.r, n, score from ranked r join totals t on t.lang = r.lang where rank <= 2000
"""
