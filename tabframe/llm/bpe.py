"""Byte-pair encoding and decoding of whole texts by a walk over a trie of distinct words."""

from __future__ import annotations

import array
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as st

from tabframe.llm.common import pieces, table, tidy, written

#: Fixed value of byte-level vocabularies: what counts as one word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for text of ASCII alone, in classes that need no tables of Unicode.
PLAIN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\x20\x09-\x0DA-Za-z0-9]+"
         r"|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
#: Distinct words whose ids a task remembers, about: some tens of MB, whatever the texts. Half of them in turn make room.
REMEMBERED = 100_000
#: Characters of long or of many short texts that are handled at once: their words, as Python strings, take some MB.
STRETCH = 1 << 18
#: Bytes of texts whose ids and digests a task makes at once.
PIECE = 1 << 20
#: Rows that come to a task at once: it holds two such batches, and the JVM one, beside what it has learnt.
BATCH_ROWS = 512
#: Arrays that are joined at once.
JOINED = 1 << 15
NEVER = 1 << 60


def standard_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in
    turn from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _packed(ids: list[int]) -> bytes:
    return array.array("i", ids).tobytes()


class Ragged:
    """Variable-length arrays end to end."""

    def __init__(self, parts, kind):
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.fromiter(itertools.chain.from_iterable(parts), kind, int(self.lengths.sum()))

    def take(self, index):
        """The arrays at ``index``, joined, and their lengths."""
        lengths = self.lengths[index]
        out, at = np.empty(int(lengths.sum()), self.flat.dtype), 0
        # places take many times the bytes that they lead to, so there are never more than those of JOINED arrays
        for first in range(0, len(index), JOINED):
            some = lengths[first : first + JOINED]
            ends = np.cumsum(some)
            places = np.repeat(self.starts[index[first : first + JOINED]] - (ends - some), some)
            places += np.arange(len(places))
            out[at : at + len(places)] = self.flat[places]
            at += len(places)
        return out, lengths


class Vocabulary:
    """A byte-level BPE vocabulary and the trie walk that encodes with it."""

    def __init__(self, text: str):
        made = json.loads(text)
        model, letters = made["model"], byte_letters()
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        spelt = {t: bytes(letters[c] for c in t) for t in model["vocab"] if t not in self.special}
        self.ids = {spelt[t]: i for t, i in model["vocab"].items() if t in spelt}
        self.rank, self.parts = {}, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = (self.ids[spelt[t]] for t in (left, right, left + right))
            self.rank.setdefault((a, b), rank)
            self.parts.setdefault(whole, (a, b, rank))
        size = max([*self.ids.values(), *self.special.values()]) + 1
        letters_of = [b""] * size
        for word, i in self.ids.items():
            letters_of[i] = word
        for word, i in self.special.items():
            letters_of[i] = word.encode()
        self.bytes_of = Ragged(letters_of, np.uint8)
        self.decimal = Ragged([b"%d," % i for i in range(size)], np.uint8)
        #: what tokens start with; what is reached from such a start by one more byte is looked up once, see reach
        self.starts = {word[:n] for word in self.ids for n in range(len(word) + 1)}
        self.edges = {}
        self._forget()
        self.pattern, self.plain = regex.compile(PATTERN), re.compile(PLAIN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.safe = regex.compile(r"(?<=\S) (?=\p{L})")
        self.named = {word: _packed([i]) for word, i in self.special.items()}
        #: ids of words: those met since the last turn, and those of the turn before, which come back when met again
        self.known, self.older = dict(self.named), {}

    def edge(self, token, right: bool):
        """The tokens at the right (or left) end of ``token`` while it is put together, each with the rank of the merge
        that takes it up."""
        if (token, right) not in self.edges:
            out, until, now = [], NEVER, token
            while True:
                out.append((now, until))
                if now not in self.parts:
                    break
                left, last, until = self.parts[now]
                now = last if right else left
            self.edges[token, right] = out
        return self.edges[token, right]

    def stay_apart(self, a, b) -> bool:
        """Whether the text of ``a`` and then ``b`` is encoded as these two tokens: no merge across the border comes
        before the merges that take up its two sides (the left one of equal merges comes first)."""
        for x, x_until in self.edge(a, True):
            for y, y_until in self.edge(b, False):
                rank = self.rank.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def _forget(self):
        """No steps, and for no token any tokens known to stay apart from it or not."""
        self.steps, self.ends, self.tried = {}, {}, 0

    def end(self, word: bytes):
        """The token ``word``, its length and the tokens before it of which it is known whether they stay apart from it;
        one object for all steps that lead to it."""
        if word not in self.ends:
            self.ends[word] = self.ids[word], len(word), {}
        return self.ends[word]

    def reach(self, read: bytes):
        """Of the bytes read, the longest end that a token starts with, and the tokens that they end with, longest first,
        each as in ``end``."""
        state = read
        while state not in self.starts:
            state = state[1:]
        ends = (state[i:] for i in range(len(state)))
        found = self.steps[read] = state, tuple(self.end(e) for e in ends if e in self.ids)
        return found

    def walk(self, words: list[bytes]):
        """Ids of distinct words in sorted order. Going through the trie of the words depth first, each node is given
        the last token of the encoding of its prefix, which follows from nodes above it; shared prefixes come once."""
        steps, states, last, sizes, before = self.steps, [b""], [], [], b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared:], sizes[shared:], states[shared + 1 :]
            state = states[-1]
            for end in range(shared, len(word)):
                read = state + word[end : end + 1]
                state, ends = steps.get(read) or self.reach(read)
                for token, size, fits in ends:
                    if size > end:
                        break
                    left = last[end - size]
                    fit = fits.get(left)
                    if fit is None:
                        fit = fits[left] = self.stay_apart(left, token)
                        self.tried += 1
                    if fit:
                        break
                last.append(token)
                sizes.append(size)
                states.append(state)
            at, found = len(word), []
            while at:
                found.append(last[at - 1])
                at -= sizes[at - 1]
            found.reverse()
            yield found
            before = word

    def learn(self, words: set):
        """Encode the words not yet known."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = dict(self.named), self.known
        if self.tried + len(self.steps) > 4 * REMEMBERED:
            self._forget()
        known, older = self.known, self.older
        fresh = words.difference(known)
        met = fresh.intersection(older)
        known.update((word, older.pop(word)) for word in met)
        fresh = sorted(w.encode() for w in fresh.difference(met))
        for word, found in zip(fresh, self.walk(fresh)):
            known[word.decode()] = _packed(found)

    def stretches(self, text: str):
        """Parts of a text that split into words independently, few of them much longer than STRETCH."""
        for part in self.split.split(text) if self.split else [text]:
            at = 0
            while part not in self.special and len(part) - at > STRETCH:
                # a space between a visible character and a letter always starts a word
                cut = self.safe.search(part, at + STRETCH)
                if not cut:
                    break
                yield part[at : cut.start()]
                at = cut.start()
            if at < len(part):
                yield part[at:]

    def encode(self, texts):
        """Ids of all texts, joined, and the number of ids of each."""
        ids, counts, group, weight = [], [], [], 0
        for n, text in enumerate(texts):
            counts.append(0)
            for part in self.stretches(text):
                group.append((n, part))
                weight += len(part)
                if weight >= STRETCH:
                    self._encode(group, ids, counts)
                    group, weight = [], 0
        self._encode(group, ids, counts)
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.asarray(counts, np.int64)

    def _encode(self, group, ids, counts):
        split = [[part] if part in self.special else (self.plain if part.isascii() else self.pattern).findall(part) for _, part in group]
        # a special token can't be a word of the pattern: it has both letters and signs
        self.learn(set().union(*split))
        for (n, _), found in zip(group, split):
            got = np.frombuffer(b"".join(map(self.known.__getitem__, found)), np.int32)
            ids.append(got)
            counts[n] += len(got)


def offsets(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _encoded(vocabulary: Vocabulary, batches, column: str, names: list[str]):
    """Batches with the ids of ``column`` as a last column."""
    for batch in batches:
        for piece in pieces(batch, column, PIECE):
            texts = ["" if t is None else t for t in piece.column(column).to_pylist()]
            ids, counts = vocabulary.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets(counts), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), lists], [*names, "ids"])


def _ids(batch):
    lists = batch.column("ids")
    starts = np.asarray(lists.offsets, np.int64)
    return np.asarray(lists.values)[starts[0] : starts[-1]], starts - starts[0]


def _decoded(vocabulary: Vocabulary, batches):
    """Batches with the text of ``ids`` as a last column; bytes that are no UTF-8 become U+FFFD."""
    for batch in batches:
        ids, starts = _ids(batch)
        data, lengths = vocabulary.bytes_of.take(ids)
        data, bounds = data.tobytes(), offsets(lengths)[starts]
        texts = [data[a:b].decode(errors="replace") for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def _digests(vocabulary: Vocabulary, batches):
    for batch in batches:
        ids, starts = _ids(batch)
        data, lengths = vocabulary.decimal.take(ids)
        data, bounds = data.tobytes(), offsets(lengths)[starts]
        # each number is followed by a comma, the last one too
        of_ids = [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
        of_text = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(starts)), "ids_sha256": of_ids, "decoded_sha256": of_text})


def _shared(spark, path):
    """The vocabulary file's text for the executors, which then need not have the file: its size is fixed."""
    with open(path or standard_path(), encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) added: the tokens of each whole text by the byte-level vocabulary at ``path``.

    A null text is empty and has no ids. Texts of any length are handled in stretches; strings of special tokens
    count as these tokens. A column named ids is replaced. Repeated rows and empty tables need nothing special.
    """
    shared = _shared(docs.sparkSession, path)
    names = [c for c in docs.columns if c != "ids"]
    kept = docs.select(*names)
    schema = st.StructType([*kept.schema.fields, st.StructField("ids", st.ArrayType(st.IntegerType()))])
    return kept.mapInArrow(tidy(lambda batches: _encoded(Vocabulary(shared.value), batches, "text", names)), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded`` added, the text of ``ids``; special tokens become their strings. A column of that
    name is replaced; ids must not be null."""
    shared = _shared(encoded.sparkSession, path)
    kept = encoded.select(*(c for c in encoded.columns if c != "decoded"))
    schema = st.StructType([*kept.schema.fields, st.StructField("decoded", st.StringType())])
    return kept.mapInArrow(tidy(lambda batches: _decoded(Vocabulary(shared.value), batches)), schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, from its ids and from the text decoded from these.

    ``docs`` needs doc_id and text, which may be null; other columns, whatever their names, are not looked at. The digests,
    small beside the texts, are written and read again, as texts then come in batches of BATCH_ROWS."""
    shared = _shared(docs.sparkSession, path)

    def run(batches):
        vocabulary = Vocabulary(shared.value)
        return _digests(vocabulary, _decoded(vocabulary, _encoded(vocabulary, batches, "text", ["doc_id"])))

    return written(docs.select("doc_id", "text").mapInArrow(
        tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"),
        "tokens", BATCH_ROWS)


def op10_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
