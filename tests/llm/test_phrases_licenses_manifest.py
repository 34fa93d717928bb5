"""Collocations, licence scans and the Merkle manifest against brute force, on documents that are hard in small ways."""

import collections
import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as sf

from tabframe.llm import collocations, licenses, merkle
from tests.llm import helpers

CLASHES = [c for c in ("tree", "at", "n", "node", "now", "name", "first", "path", "child", "__pos", "word", "phrase", "f", "h", "shard", "state")]


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is None, v) for v in r))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    return helpers.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    out = spark.createDataFrame(rows, helpers.SCHEMA).repartition(3)
    return out.withColumns({c: sf.lit("x") for c in CLASHES if c not in out.columns})


# -- Merkle manifest -------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    """The levels of a tree, its leaves first."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def beside(levels, at):
    """For each level what is left and right of a node in its run."""
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        yield "".join(run[: at % 3]), "".join(run[at % 3 + 1 :])
        at //= 3


def manifest(rows):
    by = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        changed = text
        if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            changed = text.replace("\n", "")
        by[source].append((doc_id, leaf_of(doc_id, text, lang, source, n_chars), leaf_of(doc_id, changed, lang, source, n_chars)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = tree([r[1] for r in by[name]])
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for i, name in enumerate(names):
        for at, (doc_id, leaf, changed) in enumerate(by[name]):
            way = [*beside(trees[name], at), *beside(top, i)]
            folded = changed
            for left, right in way:
                folded = digest(left, folded, right)
            root = top[-1][0]
            out.append((doc_id, leaf, trees[name][-1][0], root, digest(*(a + b for a, b in way)), folded, folded == root, name))
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


def test_manifest(docs, rows):
    out = got(merkle.manifest(docs, merkle.tampered()))
    assert out == manifest([r[:5] for r in rows])
    assert 0 < sum(r[6] for r in out) < len(out)


@pytest.mark.parametrize("count", [1, 4, 28])
def test_manifest_of_one_source(spark, count):
    data = [(i, "a\nb", None, "s", i) for i in range(count)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(merkle.manifest(docs, merkle.tampered())) == manifest(data)


def test_manifest_of_odd_rows(spark):
    data = [(None, None, None, None, None), (None, None, None, None, None), (None, "x\n", "", "", 0), (3, "q", "l", "é", 1), (3, "q", "l", "é", 1),
            (3, "p", "l", "é", 1), (-1, "", None, "é", None), (2, "z" * 300_000 + "\n", "l", "z", 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert got(merkle.manifest(docs, merkle.tampered())) == manifest(data)


def test_manifest_in_many_buckets(spark, docs, rows):
    spark.conf.set("spark.tabframe.rowsPerBucket", "7")
    try:
        assert got(merkle.manifest(docs, merkle.tampered())) == manifest([r[:5] for r in rows])
    finally:
        spark.conf.unset("spark.tabframe.rowsPerBucket")


# -- licences --------------------------------------------------------------------


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    places, labels = [], set()
    for label, some in licenses.PHRASES.items():
        for phrase in some:
            size = len(phrase.split())
            here = [i for i in range(len(words)) if words[i : i + size] == phrase.split()]
            places += here
            labels |= {label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENSED = [
    "Under the MIT License. under_the-mit LICENSE! Under the MITLicense", "CC BY-NC 4.0; cc.by.nc CC BY NC", "the Apache License, Version 2.0",
    "apache license version 20", "under the mit", "mit license under the", "under", "", None, " \n", "Ünder the mit license under the mit license",
    "é cc by nc", "cc by ncé", "cc cc by nc by nc", "cc by\x00nc", "a " * 40_000 + "cc by nc " + "b " * 40_000,
]


def test_phrases_of_licenses(spark, docs, rows):
    data = [(i, t) for i, t in enumerate(LICENSED)] + [(7, "cc by nc"), (7, "cc by nc"), (None, "cc by nc")]
    out = licenses.scan(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    want = sorted(((i, *base(t)) for i, t in data), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=str) == want
    assert all((r.score == 1.0) == (r.n_base > 0) and 0 <= r.score <= 1 for r in out)
    plain = licenses.scan(docs).collect()
    assert sorted((r.doc_id, r.n_words) for r in plain) == sorted((r[0], base(r[1])[0]) for r in rows)


def test_notices(spark):
    rng = random.Random(3)
    fill = lambda n: " ".join("".join(rng.choices("klmnop", k=6)) for _ in range(n))
    named = {i: (label, text) for i, (label, text, _) in enumerate(licenses.NOTICES)}
    data = [(i, f"{fill(50)}\n{text}. {fill(30)}") for i, (_, text) in named.items()]
    words = dict(named.values())
    half = " ".join(words["mit"].split()[:20])
    mixed = " ".join(rng.sample(words["isc"].split(), len(words["isc"].split())))
    data += [(100, words["isc"] + " " + fill(9) + " " + words["cc0"]), (101, half), (102, mixed), (103, fill(200)), (104, " the of in and " * 300),
             (105, words["bsd-3"].replace("copyright holder", "Some Company, Inc.")), (106, " * " + words["gpl-2"].replace(" ", "\n * ").upper())]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    for i, (label, _) in named.items():
        assert label in out[i].labels.split(",") and out[i].score >= 0.999
        assert set(out[i].base_labels.split(",")) - {""} <= set(out[i].labels.split(","))
    assert out[100].labels == "cc0,isc" and "bsd-3" in out[105].labels and licenses.LEAST <= out[105].score < 1 and "gpl-2" in out[106].labels
    assert all(out[i].labels == "" and out[i].score == 0 for i in (101, 102, 103, 104))


def test_rarity_decides_the_anchor():
    index = licenses.Index()
    index.weigh(1000, {index.words.index(w): n for w, n in (("under", 900), ("the", 999), ("mit", 500), ("license", 20))})
    assert index.words[max(index.phrases[0], key=lambda w: index.rarity[w])] == "license"
    words = licenses.Words(pa.array(["under the mit license", "license under the mit", None]), index)
    assert licenses.places(words, index.phrases[0], index.rarity).tolist() == [0]


# -- collocations ----------------------------------------------------------------


def collocations_of(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = collections.Counter()
    for (lang, *words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                covered[lang, *words[i : i + k]] = max(covered[lang, *words[i : i + k]], a)
    out = collections.defaultdict(list)
    for p, a in found.items():
        if 100 * covered[p] >= 80 * a:
            continue
        lang, words = p[0], p[1:]
        score, _, l, r = min((2_000_000 * a // (f[lang, *words[:k]] + f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]])
                             for k in range(1, len(words)))
        out[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -score) for lang, some in out.items()
                  for i, (score, a, p, l, r) in enumerate(sorted(some)[:top], 1))


def phrase_rows():
    rng = random.Random(8)
    words = ["der", "The", "the", "of", "a\x00b", "é", "x-y", "q'", "San", "Francisco", "bay", "area"]
    rows = []
    for i in range(300):
        some = [rng.choice(words) for _ in range(rng.randrange(12))]
        if i % 3 == 0:
            some[rng.randrange(len(some) + 1) :] = ["San", "Francisco", "Bay", "Area"][: rng.randrange(2, 5)]
        rows.append((["en", "de", None, "und", "é"][i % 5 if i % 2 else 0], "".join(w + rng.choice(["  ", " ", "\t", " ", " ", ", ", "\n", "."]) for w in some)))
    return rows + [("en", None), ("en", ""), (None, " \n\t"), ("en", "the of " * 2000), ("en", "aa aa aa aa aa aa aa"), *[("fr", "je ne sais quoi")] * 40]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, small, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST", 5)
    if small:  # filters that let much through, many tries, short pieces and few slots
        for name, value in {"FILTER_BITS": 8, "TRIE_PHRASES": 20, "PIECE_BYTES": 900, "BLOCK": 16, "SLICE": 8, "SALTS": 2}.items():
            monkeypatch.setattr(collocations, name, value)
    rows = phrase_rows()
    data = [(lang, text, *["x"] * len(CLASHES)) for lang, text in rows]
    docs = spark.createDataFrame(data, "lang string, text string, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3)
    for top in (2000, 6):
        want = collocations_of(rows, 5, top)
        assert sorted(map(tuple, collocations.collocations(docs, top).collect())) == want and len(want) > 10


def test_trie_is_a_map():
    rng = random.Random(4)
    phrases = sorted({" ".join(rng.choices([f"w{i}" for i in range(30)], k=rng.randrange(2, 5))) for _ in range(3000)})
    langs = ["en" if len(p) % 2 else "de" for p in phrases]
    trie = collocations.Trie(pa.array(langs, pa.large_string()), pa.array(phrases, pa.large_string()))
    assert len(set(trie.states.tolist())) == len(phrases)
    batch = pa.RecordBatch.from_pydict({"lang": langs + ["fr"], "text": phrases + ["w1 w2 w3"]})
    totals = trie.counts(collocations.Words(batch))
    want = collections.Counter()
    for lang, p in zip(langs, phrases):
        words = p.split()
        want.update((lang, " ".join(words[i : i + k])) for k in (2, 3, 4) for i in range(len(words) - k + 1))
    assert totals[trie.states].tolist() == [want[lang, p] for lang, p in zip(langs, phrases)]


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a b", 6 * 10**18)], "lang string, phrase string, f long")
    words = spark.createDataFrame([("en", "a", 7 * 10**18), ("en", "b", 8 * 10**18)], "lang string, phrase string, f long")
    row = collocations.scored(phrases, words).first()
    assert row.score == 2_000_000 * 6 * 10**18 // (15 * 10**18)


@pytest.mark.parametrize("run", [merkle.manifest, licenses.scan, collocations.collocations], ids=lambda f: f.__name__)
def test_empty_tables(run, spark):
    assert run(spark.createDataFrame([], helpers.SCHEMA)).collect() == []


def test_no_frequent_phrase(spark):
    assert collocations.collocations(spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")).collect() == []
