"""Document quality by co-training a view of the text with a view of the page's metadata."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as sf

from tabframe.llm.common import Texts, held_out, pieces, table
from tabframe.llm.features import IS_SPACE, Logistic, gram_counts, labelled_sample, shares, sigmoid, word_bounds, word_hashes

#: Hashed byte n-grams of the view of the text.
GRAMS = 512
#: Slots for sources and for languages in the view of the metadata.
SLOTS = 64
#: Labelled documents of each label and unlabelled documents to learn from, about; texts of at most so many bytes.
LABELLED, UNLABELLED, SAMPLE_BYTES = 1500, 2000, 1 << 16
#: Rounds in which the views exchange pseudo-labels, and how sure one must be to pass a label on.
ROUNDS, SURE = 3, 0.95
#: Pseudo-labels that a view may take over in a round, of each label.
EXCHANGED = 300
#: Documents with at least this score are of good quality.
THRESHOLD = 0.5
TEXT_SIZE, META_SIZE = GRAMS + 8, 2 * SLOTS + 4
WORD = ~IS_SPACE


def text_view(data: np.ndarray) -> np.ndarray:
    """The text itself: n-grams, kinds of characters, and how repetitive its words are."""
    counts = np.bincount(data, minlength=256) if len(data) < 1 << 22 else sum(
        np.bincount(data[i : i + (1 << 22)], minlength=256) for i in range(0, len(data), 1 << 22))
    n = max(1, int(counts.sum()))
    same = words = distinct = 0
    at = 0
    while at < len(data):
        # blocks end at a space
        to = min(len(data), at + (1 << 22))
        if to < len(data):
            spaces = np.flatnonzero(IS_SPACE[data[at:to]])
            to = at + int(spaces[-1]) + 1 if len(spaces) else to
        hashes = word_hashes(data[at:to], *word_bounds(data[at:to], WORD))
        same += int((hashes[1:] == hashes[:-1]).sum())
        words, distinct, at = words + len(hashes), distinct + len(np.unique(hashes)), to
    extra = [counts[65:91].sum() / n, counts[48:58].sum() / n, counts[128:].sum() / n, counts[33:48].sum() / n,
             counts[[124, 36, 37, 38, 35, 42, 33]].sum() / n, same / max(1, words), distinct / max(1, words), words / n]
    return np.concatenate([shares(gram_counts(data, GRAMS, (1, 2), lower=False)), np.array(extra, np.float32)])


def meta_view(source, lang, length: int, lines: int) -> np.ndarray:
    """What is known of the page without reading its words: source, language, sizes."""
    out = np.zeros(META_SIZE, np.float32)
    out[zlib.crc32(f"{source}".encode()) % SLOTS] = 1
    out[SLOTS + zlib.crc32(f"{lang}".encode()) % SLOTS] = 1
    out[2 * SLOTS :] = np.log1p(length), np.log1p(lines), np.log1p(length / (lines + 1)), float(source is None)
    return out


def _views(batch):
    texts = Texts(batch.column("text"))
    spans = list(zip(texts.starts[:-1], texts.starts[1:]))
    text = np.array([text_view(texts.data[a:b]) for a, b in spans], np.float32).reshape(len(spans), TEXT_SIZE)
    lines = [int((texts.data[a:b] == 10).sum()) for a, b in spans]
    sources, langs = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
    meta = np.array([meta_view(s, t, b - a, n) for s, t, (a, b), n in zip(sources, langs, spans, lines)], np.float32)
    return text, meta.reshape(len(spans), META_SIZE)


def _sample_views(batches):
    for batch in batches:
        for piece in pieces(batch, "text"):
            text, meta = _views(piece)
            yield pa.RecordBatch.from_pydict({
                "label": piece.column("label"), "text": [v.tobytes() for v in text], "meta": [v.tobytes() for v in meta]})


class CoTrained:
    """Two views that teach one another, and their calibrated combination."""

    def fit(self, views, labels):
        """``labels``: 1, 0, or -1 for none. A third of the labelled rows is kept for calibration."""
        labels = np.asarray(labels)
        known = np.flatnonzero(labels >= 0)
        learn, check = known[np.arange(len(known)) % 3 > 0], known[np.arange(len(known)) % 3 == 0]
        self.constant = None
        if len(set(labels[learn])) < 2 or len(set(labels[check])) < 2:
            self.constant = float(labels[known].mean()) if len(known) else 0.5
            return self
        given = [{int(i): labels[i] for i in learn} for _ in views]
        free = set(np.flatnonzero(labels < 0).tolist())
        for turn in range(ROUNDS + 1):
            self.models, scales = [], []
            for view, own in zip(views, given):
                rows = np.array(sorted(own))
                model = Logistic().fit(view[rows], np.array([own[i] for i in rows]))
                self.models.append(model)
                scales.append(Logistic(300).fit(model.logits(view[check]), labels[check]))
            if turn == ROUNDS or not free:
                break
            rows = np.array(sorted(free))
            for mine, other in ((0, 1), (1, 0)):
                # what this view is sure of becomes a label for the other one
                p = sigmoid(scales[mine].logits(self.models[mine].logits(views[mine][rows])))[:, 0]
                for label, sure in ((1, p), (0, 1 - p)):
                    best = np.argsort(-sure, kind="stable")[:EXCHANGED]
                    for i in rows[best[sure[best] >= SURE]]:
                        given[other].setdefault(int(i), label)
            free -= set(given[0]) & set(given[1])
        self.scales = scales
        both = np.hstack([s.logits(m.logits(v[check])) for s, m, v in zip(scales, self.models, views)])
        self.combined = Logistic(300).fit(both, labels[check])
        return self

    def score(self, views):
        """Scores of both views and of their combination."""
        if self.constant is not None:
            return [np.full(len(views[0]), self.constant)] * 3
        each = [s.logits(m.logits(v)) for s, m, v in zip(self.scales, self.models, views)]
        return [sigmoid(e)[:, 0] for e in (*each, self.combined.logits(np.hstack(each)))]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> CoTrained:
    """Learn from bounded samples of labelled rows that are not held out and of rows without a label."""
    rows = labelled_sample(docs.select("doc_id", "text", "source", "lang"), labels, "quality", labelled, unlabelled, SAMPLE_BYTES)
    found = rows.select("label", "text", "source", "lang").mapInArrow(
        _sample_views, "label int, text binary, meta binary").toPandas().sort_values(["label", "text", "meta"])
    # rows of both labels are mixed by their content, so that every third one is a fair third
    found = found.assign(order=[zlib.crc32(t + m) for t, m in zip(found["text"], found["meta"])]).sort_values("order", kind="stable")
    views = [np.array([np.frombuffer(v, np.float32) for v in found[c]]).reshape(len(found), size)
             for c, size in (("text", TEXT_SIZE), ("meta", META_SIZE))]
    return CoTrained().fit(views, found["label"].to_numpy(np.int64))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, text_score, meta_score, score, predicted.

    ``labels`` has doc_id and quality (1 good, 0 bad; other values are no label; several labels of one id: good wins).
    Scores, from 0 to 1, are higher where good quality is likelier; predicted is 1 from ``threshold`` on. Null text
    counts as empty, a null source or lang as a value of its own; a null doc_id is not held out and has no label. If
    labels of both kinds are lacking, every score is the share of good labels, or 0.5. Columns besides doc_id, text,
    source and lang are not looked at.
    """
    model = train(docs, labels)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                text, meta, both = model.score(_views(piece))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "text_score": text,
                    "meta_score": meta, "score": both, "predicted": pa.array((both >= threshold).astype(np.int32))})

    return docs.select("doc_id", "text", "source", "lang", held_out().alias("held_out")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, text_score double, meta_score double, score double, predicted int")


def op8_quality(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
