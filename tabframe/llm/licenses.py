"""Licences in documents: a positional index of licence notices, looked up by the rarest words that a document has."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as sf

from tabframe.llm.common import Texts, pieces, table
from tabframe.llm.features import LOWER, word_bounds, word_hashes

#: Phrases that settle a licence wherever their words stand one after the other.
PHRASES = {"mit": ("under the mit license",), "apache-2": ("apache license version 2",), "cc-by-nc": ("cc by nc",)}
#: Licence notices in their public wording: label, text, and the phrases that must stand in it.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
     "to whom the Software is furnished to do so, subject to the following conditions",
     ("permission is hereby granted free of charge", "subject to the following conditions")),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
     ("apache license version 2", "in compliance with the license")),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice",
     ("redistribution and use in source and binary forms", "following conditions are met")),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission", ("to endorse or promote products",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies",
     ("with or without fee is hereby granted",)),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
     "Free Software Foundation; either version 2 of the License, or (at your option) any later version",
     ("gnu general public license", "version 2 of the license")),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
     "Free Software Foundation, either version 3 of the License, or (at your option) any later version",
     ("gnu general public license", "version 3 of the license")),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
     "the Free Software Foundation", ("gnu lesser general public license",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ("creative commons attribution 4 0",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
     ("creative commons attribution sharealike",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     ("creative commons attribution noncommercial",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
     ("waived all copyright and related or neighboring rights",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("released into the public domain",)),
)
#: Rarest words of a notice by which a document looks it up; how many of them must agree on where it stands.
ANCHORS, AGREE = 8, 2
#: The share of a notice's words, weighed by rarity, that must stand in place; words by which parts of it may be apart.
LEAST, SLACK = 0.7, 16
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass
class Notice:
    label: str
    words: np.ndarray  # numbers of its words
    keys: list[int]  # its mandatory phrases


class Index:
    """The words of notices and phrases, and where each stands in them. Its size depends on the notices alone."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        base = [(label, words_of(p)) for label, some in phrases.items() for p in some]
        keys = [words_of(k) for _, _, some in notices for k in some]
        texts = [words_of(text) for _, text, _ in notices]
        self.words = sorted({w for some in [*(p for _, p in base), *keys, *texts] for w in some})
        number = {w: i for i, w in enumerate(self.words)}
        numbers = lambda some: np.array([number[w] for w in some], np.int64)
        self.base = [label for label, _ in base]  # of the first phrases; mandatory ones follow
        self.phrases = [numbers(p) for _, p in base] + [numbers(k) for k in keys]
        at, self.notices = len(base), []
        for (label, _, some), text in zip(notices, texts):
            self.notices.append(Notice(label, numbers(text), list(range(at, at + len(some)))))
            at += len(some)
        coded = [w.encode() for w in self.words]
        self.longest = max(map(len, coded))
        self.bytes = np.zeros((len(coded), self.longest), np.uint8)
        self.lengths = np.array([len(w) for w in coded])
        self.begins = np.zeros((self.longest + 1, 1 << 16), bool)
        for i, w in enumerate(coded):
            self.bytes[i, : len(w)] = np.frombuffer(w, np.uint8)
            self.begins[len(w), w[0] << 8 | (w[1] if len(w) > 1 else 0)] = True
        ends = np.cumsum(self.lengths)
        hashes = word_hashes(np.frombuffer(b"".join(coded), np.uint8), ends - self.lengths, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.rarity = np.ones(len(self.words))

    def weigh(self, documents: int, having: dict[int, int]):
        """Take the rarity of words (inverse document frequency) from all documents, and choose anchors by it."""
        count = np.array([having.get(i, 0) for i in range(len(self.words))])
        self.rarity = np.log((documents + 1) / (count + 1)) + 1e-3

    def numbered(self, data, starts, ends) -> np.ndarray:
        """The number of each word of lower-case ``data``, -1 for words that no notice has. Bytes decide."""
        out = np.full(len(starts), -1, np.int64)
        lengths = ends - starts
        second = np.where(lengths > 1, data[np.minimum(starts + 1, len(data) - 1)], 0) if len(starts) else starts
        first = data[starts].astype(np.int64) << 8 | second
        some = np.flatnonzero((lengths <= self.longest) & self.begins[np.minimum(lengths, self.longest), first])
        if len(some):
            own = word_hashes(data, starts[some], ends[some])
            found = self.order[np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)]
            at = starts[some][:, None] + np.arange(self.longest)
            inside = np.arange(self.longest) < lengths[some][:, None]
            read = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
            same = (self.lengths[found] == lengths[some]) & (read == self.bytes[found]).all(1)
            out[some[same]] = found[same]
        return out


class Words:
    """The words of some texts as numbers of an index, and where each text's words begin."""

    def __init__(self, column, index: Index):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        texts = Texts(pc.binary_join_element_wise(column, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))
        starts, ends = word_bounds(texts.data, IN_WORD)
        self.number = index.numbered(LOWER[texts.data], starts, ends)
        self.first = np.searchsorted(starts, texts.starts)
        self.count = np.diff(self.first)
        self.known = np.flatnonzero(self.number >= 0)
        self.doc = np.searchsorted(self.first, self.known, "right") - 1


def places(words: Words, phrase: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Where all words of a phrase stand in a row: looked up by its rarest word, then compared at their places."""
    lead = int(np.argmax(rarity[phrase]))
    hits = words.known[words.number[words.known] == phrase[lead]]
    start = hits - lead
    doc = np.searchsorted(words.first, hits, "right") - 1
    start = start[(start >= words.first[doc]) & (start + len(phrase) <= words.first[doc + 1])]
    for i, word in enumerate(phrase):
        start = start[words.number[start + i] == word]
    return start


def aligned(words: Words, notice: Notice, rarity: np.ndarray):
    """Where documents have enough of a notice in place: document, span of starts, and the weighed share of its words."""
    own, at = np.unique(notice.words, return_inverse=True)
    weight = rarity[notice.words]
    hit = np.isin(words.number[words.known], own)
    place, doc, number = words.known[hit], words.doc[hit], words.number[words.known][hit]
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none, none, np.zeros(0)
    # a document must have enough of the notice's words at all
    pairs = np.unique(doc * len(own) + np.searchsorted(own, number))
    mass = np.bincount(at, weight)
    docs, column = pairs // len(own), pairs % len(own)
    share = np.bincount(docs, mass[column], len(words.count))
    able = share[docs] >= LEAST * weight.sum()
    docs, column = docs[able], column[able]
    # the rarest of these words are its anchors
    order = np.lexsort((column, -rarity[own[column]], docs))
    docs, column = docs[order], column[order]
    rank = np.arange(len(docs)) - np.searchsorted(docs, docs)
    anchors = docs[rank < ANCHORS] * len(own) + column[rank < ANCHORS]
    some = np.isin(doc * len(own) + np.searchsorted(own, number), anchors)
    place, doc, number = place[some], doc[some], number[some]
    # postings: every place of the word in the notice says where the notice would start
    spots = np.argsort(at, kind="stable")
    begin = np.searchsorted(at[spots], np.arange(len(own) + 1))
    column = np.searchsorted(own, number)
    times = (begin[1:] - begin[:-1])[column]
    which = np.repeat(begin[column] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    start, doc, column = np.repeat(place, times) - spots[which], np.repeat(doc, times), np.repeat(column, times)
    # different anchors must agree on a start
    votes = np.unique(np.stack([doc, start, column]), axis=1)
    new = np.ones(votes.shape[1], bool)
    new[1:] = (votes[:2, 1:] != votes[:2, :-1]).any(0)
    head = np.flatnonzero(new)
    head = head[np.diff(np.append(head, votes.shape[1])) >= min(AGREE, len(own))]
    doc, start = votes[0, head], votes[1, head]
    if not len(doc):
        return none, none, none, np.zeros(0)
    where = start[:, None] + np.arange(len(notice.words))
    inside = (where >= words.first[doc][:, None]) & (where < words.first[doc + 1][:, None])
    fits = inside & (words.number[np.clip(where, 0, len(words.number) - 1)] == notice.words)
    # starts that are close are parts of one notice with words put in or left out
    apart = np.ones(len(doc), bool)
    apart[1:] = (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > SLACK)
    head = np.flatnonzero(apart)
    fits = np.logical_or.reduceat(fits, head, axis=0)
    last = np.append(head[1:], len(doc)) - 1
    return doc[head], start[head], start[last] + len(notice.words), (fits * weight).sum(1) / weight.sum()


def found(column, index: Index):
    """The result columns of some texts."""
    words = Words(column, index)
    n = len(words.count)
    rows = [places(words, phrase, index.rarity) for phrase in index.phrases]
    of = lambda at: np.searchsorted(words.first, at, "right") - 1
    base = np.sort(np.concatenate([np.zeros(0, np.int64), *rows[: len(index.base)]]))
    doc = of(base)
    number = np.bincount(doc, minlength=n)
    begin = np.cumsum(number) - number
    have = number > 0
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[have] = base[begin[have]] - words.first[:-1][have]
    last[have] = base[(begin + number - 1)[have]] - words.first[:-1][have]
    settled = [set() for _ in range(n)]
    for label, at in zip(index.base, rows):
        for i in np.unique(of(at)):
            settled[i].add(label)
    named, score = [set(s) for s in settled], have.astype(float)
    for notice in index.notices:
        doc, low, high, share = aligned(words, notice, index.rarity)
        fits = share >= LEAST
        for key in notice.keys:
            place = np.searchsorted(rows[key], np.maximum(low - SLACK, words.first[doc]))
            there = np.append(rows[key], np.iinfo(np.int64).max)[place]
            fits &= there <= np.minimum(high + SLACK, words.first[doc + 1]) - len(index.phrases[key])
        np.maximum.at(score, doc[fits], np.minimum(share[fits], 1.0))
        for i in np.unique(doc[fits]):
            named[i].add(notice.label)
    joined = lambda some: pa.array([",".join(sorted(s)) for s in some], pa.string())
    empty = pa.array(~have)
    return {"n_words": pa.array(words.count.astype(np.int64)), "n_base": pa.array(number.astype(np.int64)),
            "first_word": pc.if_else(empty, None, pa.array(first)), "last_word": pc.if_else(empty, None, pa.array(last)),
            "base_labels": joined(settled), "labels": joined(named), "score": pa.array(score)}


def weighed(docs: DataFrame, index: Index) -> Index:
    """Count, over all documents, those that have each licence word: one number a word comes back."""

    def run(batches):
        having, rows = np.zeros(len(index.words), np.int64), 0
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                words = Words(piece.column("text"), index)
                pairs = np.unique(words.doc * len(index.words) + words.number[words.known])
                having += np.bincount(pairs % len(index.words), minlength=len(index.words))
                rows += piece.num_rows
        yield pa.RecordBatch.from_pydict({"word": np.arange(-1, len(index.words)), "n": np.concatenate([[rows], having])})

    counts = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(sf.sum("n").alias("n")).collect()
    counts = {r.word: r.n for r in counts}
    index.weigh(counts.get(-1, 0), counts)
    return index


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of letters, digits and signs beyond ASCII, A to Z in lower case. ``phrases`` (label to phrases) are found
    at every place where their words stand in a row: n_base counts these places, first_word and last_word are the first and
    last of them by the number of their first word (null if there is none), base_labels names them. ``notices`` (label, text,
    mandatory phrases) add labels: a document looks a notice up by the rarest of its words that it has, as counted over all
    documents; places where these agree on a start are compared word by word, and the notice counts where the rarity of words
    in place reaches LEAST and every mandatory phrase stands there too. score is 1 where a phrase stands, else the highest
    such share, else 0. Labels are distinct, sorted and joined by commas; no label is the empty text.

    A null text is empty: no words, no labels. Texts are read whole, however long, in batches of bounded size or alone. Each
    row counts by itself, also repeated rows and those with one id or none. An empty table gives no rows. Of ``docs``, doc_id
    is carried and text is read; other columns are not looked at.
    """
    index = weighed(docs, Index(phrases, notices))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), **found(piece.column("text"), index)})

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, {RESULT}"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def op11_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
