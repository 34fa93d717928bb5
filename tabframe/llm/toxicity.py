"""Toxicity by a bidirectional gated recurrent network with attention over overlapping windows of words."""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as sf

from tabframe.llm.common import Texts, held_out, pieces, table, tidy
from tabframe.llm.features import LOWER, Logistic, labelled_sample, sigmoid, word_bounds, word_hashes

#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 16
#: Buckets of words and of byte 4-grams, and the widths of their vectors; the network's units each way.
WORDS, WORD_WIDTH, GRAMS, GRAM_WIDTH, UNITS = 1 << 17, 5, 1 << 14, 4, 8
WIDTH = WORD_WIDTH + GRAM_WIDTH + 2
#: Bytes at the start of a word that are looked at as a whole, and buckets for them.
HEADS, HEAD_BUCKETS = (4, 5, 6, 7, 8), 1 << 16
#: Labelled documents of each label to learn from, about, and the bytes that such a text may have.
SAMPLE, SAMPLE_BYTES = 1500, 1 << 16
#: Passes over the windows chosen for learning, windows in a step, and its size for weights and for
#: the vectors of words and grams: small, so that these don't learn single texts by heart.
PASSES, BATCH, RATE, LOOKUP_RATE = 4, 64, 0.01, 0.2
THRESHOLD = 0.7
#: Windows that are run together.
TOGETHER = 4096
#: Words that are hashed together.
BLOCK = 1 << 18
#: What a window that isn't there counts as.
NONE = -6.0
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words:
    """The words of some texts: lower case, of letters and digits. A word right after itself counts once."""

    def __init__(self, column):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        texts = Texts(pc.binary_join_element_wise(column, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))
        self.docs = len(texts)
        self.data = np.where(IN_WORD[texts.data], LOWER[texts.data], np.uint8(32))
        self.starts, self.ends = word_bounds(self.data, IN_WORD)
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *(
            word_hashes(self.data, self.starts[i : i + BLOCK], self.ends[i : i + BLOCK]) for i in range(0, len(self.starts), BLOCK))])
        new = np.ones(len(self.starts), bool)
        new[1:] = self.hashes[1:] != self.hashes[:-1]
        first = np.searchsorted(self.starts, texts.starts)
        new[first[:-1][np.diff(first) > 0]] = True
        self.starts, self.ends, self.hashes = self.starts[new], self.ends[new], self.hashes[new]
        self.first = np.searchsorted(self.starts, texts.starts)  # of each text, then the number of words

    def part(self, a: int, b: int):
        """Of words a to b: their buckets, those of their starts of each length (the first for what is shorter), those of
        all their grams, and the number of grams of each word."""
        if a >= b:
            return np.zeros(0, np.int64), np.zeros((0, len(HEADS)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self.starts[a], self.ends[b - 1]
        data = np.full(high - low + 4, 32, np.uint8)
        data[1 : high - low + 1] = self.data[low:high]
        starts, lengths = self.starts[a:b] - low, (self.ends - self.starts)[a:b]
        words = (self.hashes[a:b] & np.uint64(WORDS - 1)).astype(np.int64)
        wide = data.astype(np.uint32)
        heads, head = np.zeros((len(words), len(HEADS)), np.int64), np.zeros(len(words), np.uint32)
        for i in range(max(HEADS)):
            head = (head ^ wide[np.minimum(starts + 1 + i, len(wide) - 1)]) * np.uint32(0x01000193)
            if i + 1 in HEADS:
                code = (head ^ (head >> np.uint32(15))) % np.uint32(HEAD_BUCKETS - 1) + 1
                heads[:, HEADS.index(i + 1)] = np.where(lengths > i, code, 0)
        code = np.zeros(high - low, np.uint32)
        for i in range(4):  # from the byte before to two bytes after
            code = (code ^ wide[i : i + high - low]) * np.uint32(0x01000193)
        code = (code ^ (code >> np.uint32(15))) & np.uint32(GRAMS - 1)
        within = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        return words, heads, code[within].astype(np.int64), lengths

    def windows(self):
        """First word, number of words and text of each window; the last window of a text ends with the text."""
        count = np.diff(self.first)
        full = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, (count > 0).astype(np.int64))
        doc = np.repeat(np.arange(self.docs), full)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
        offset = np.minimum(turn * STRIDE, np.maximum(count[doc] - WINDOW, 0))
        return self.first[doc] + offset, np.minimum(count[doc], WINDOW), doc


class Network:
    """Word and character inputs, a gated recurrent layer each way, attention pooling, one logit per window."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.3 / np.sqrt(shape[-2] if len(shape) > 1 else 1), shape).astype(np.float32)
        self.word = rng.normal(0, 0.05, (WORDS, WORD_WIDTH)).astype(np.float32)
        self.gram = rng.normal(0, 0.05, (GRAMS, GRAM_WIDTH)).astype(np.float32)
        self.peak, self.head = np.zeros(GRAMS, np.float32), np.zeros(HEAD_BUCKETS, np.float32)
        h = UNITS
        self.weights = {"x": small(WIDTH, 6 * h), "bias": np.zeros(6 * h, np.float32), "h": small(2, h, 3 * h),
                        "a": small(2 * h, h), "v": small(h, 1), "o": small(2 * h, 1), "o0": np.zeros(1, np.float32)}

    def start(self, word_odds, gram_odds, head_odds):
        """The first word and gram channels begin as log-odds; those for the highest gram and start of a word stay so."""
        self.head = head_odds.astype(np.float32)
        self.head[0] = 0
        self.word[:, 0], self.gram[:, 0], self.peak = word_odds, gram_odds, gram_odds.astype(np.float32)

    def inputs(self, words, heads, grams, lengths):
        """Inputs of words, and a last row of zeros for what isn't there."""
        x = np.zeros((len(words) + 1, WIDTH), np.float32)
        if len(words):
            at = np.cumsum(lengths) - lengths
            x[:-1, :WORD_WIDTH] = self.word[words]
            x[:-1, WORD_WIDTH:-2] = np.add.reduceat(self.gram[grams], at) / lengths[:, None].astype(np.float32)
            x[:-1, -2] = np.maximum.reduceat(self.peak[grams], at)
            x[:-1, -1] = self.head[heads].max(1)
        return x

    def forward(self, x, index, mask=None, keep=False):
        """Logits of windows: ``index`` (windows, steps) into ``x``; ``mask`` is 0 where there is no word."""
        w, h = self.weights, UNITS
        given = (x @ w["x"] + w["bias"]).reshape(len(x), 2, 3 * h)
        n, steps = index.shape
        state, states, kept = np.zeros((2, n, h), np.float32), np.empty((steps, 2, n, h), np.float32), []
        for t in range(steps):
            g = np.stack([given[index[:, t], 0], given[index[:, steps - 1 - t], 1]])
            u = state @ w["h"]
            gates = 0.5 + 0.5 * np.tanh(0.5 * (g[..., : 2 * h] + u[..., : 2 * h]))
            z, r = gates[..., :h], gates[..., h:]
            c = np.tanh(g[..., 2 * h :] + r * u[..., 2 * h :])
            new = c + z * (state - c)
            if mask is not None:
                m = np.stack([mask[:, t], mask[:, steps - 1 - t]])[..., None]
                new = m * new + (1 - m) * state
            if keep:
                kept.append((state, u, z, r, c))
            states[t, 0], states[steps - 1 - t, 1] = new[0], new[1]
            state = new
        both = states.transpose(0, 2, 1, 3).reshape(steps, n, 2 * h)
        hidden = np.tanh(both @ w["a"])
        mark = (hidden @ w["v"])[..., 0]
        if mask is not None:
            mark = np.where(mask.T > 0, mark, np.float32(-1e9))
        share = np.exp(mark - mark.max(0))
        share /= share.sum(0)
        pooled = np.einsum("tn,tnk->nk", share, both)
        logit = (pooled @ w["o"])[:, 0] + w["o0"][0]
        return (logit, (kept, both, hidden, share, pooled)) if keep else logit

    def gradients(self, x, index, mask, y):
        """Gradients of the mean logistic loss: of the weights, and of the inputs in use."""
        w, h = self.weights, UNITS
        logit, (kept, both, hidden, share, pooled) = self.forward(x, index, mask, True)
        n, steps = index.shape
        d = ((sigmoid(logit) - y) / n).astype(np.float32)
        out = {"o": pooled.T @ d[:, None], "o0": d.sum(keepdims=True)}
        dpool = d[:, None] * w["o"][:, 0]
        dshare = np.einsum("nk,tnk->tn", dpool, both)
        dmark = share * (dshare - (share * dshare).sum(0))
        dboth = share[..., None] * dpool
        dhidden = dmark[..., None] * w["v"][:, 0] * (1 - hidden**2)
        out["v"] = np.einsum("tnk,tn->k", hidden, dmark)[:, None]
        out["a"] = np.einsum("tni,tnk->ik", both, dhidden)
        dboth = (dboth + dhidden @ w["a"].T).reshape(steps, n, 2, h)
        each, out["h"] = np.empty((n, steps, 2, 3 * h), np.float32), np.zeros_like(w["h"])
        back = np.zeros((2, n, h), np.float32)
        for t in reversed(range(steps)):
            state, u, z, r, c = kept[t]
            back = back + np.stack([dboth[t, :, 0], dboth[steps - 1 - t, :, 1]])
            m = np.stack([mask[:, t], mask[:, steps - 1 - t]])[..., None]
            now, back = back * m, back * (1 - m)
            dc = now * (1 - z) * (1 - c**2)
            dz = now * (state - c) * z * (1 - z)
            dr = dc * u[..., 2 * h :] * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], -1)
            dg = np.concatenate([dz, dr, dc], -1)
            out["h"] += np.einsum("dni,dnk->dik", state, du)
            back = back + now * z + du @ w["h"].transpose(0, 2, 1)
            each[:, t, 0], each[:, steps - 1 - t, 1] = dg[0], dg[1]
        dgiven = _summed(each.reshape(n * steps, 6 * h), index.ravel(), len(x))
        out["x"], out["bias"] = x.T @ dgiven, dgiven.sum(0)
        return out, dgiven @ w["x"].T

    def logits(self, words: Words):
        """The logit and the text of every window of ``words``."""
        first, count, doc = words.windows()
        out = np.empty(len(first), np.float32)
        for at in range(0, len(first), TOGETHER):
            some = slice(at, at + TOGETHER)
            low, high = int(first[some].min()), int((first[some] + count[some]).max())
            x = self.inputs(*words.part(low, high))
            for short in (False, True):
                rows = at + np.flatnonzero((count[some] < WINDOW) == short)
                if len(rows):
                    index, mask = placed(first[rows] - low, count[rows], len(x) - 1)
                    out[rows] = self.forward(x, index, mask if short else None)
        return out, doc


def _summed(rows, where, size: int):
    """Sums of ``rows`` by ``where``."""
    order = np.argsort(where, kind="stable")
    named, at = np.unique(where[order], return_index=True)
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[named] = np.add.reduceat(rows[order], at)
    return out


def placed(first, count, none):
    """Indexes of the words of windows, ``none`` where there is none, and a mask."""
    steps = np.arange(WINDOW)
    mask = steps < count[:, None]
    return np.where(mask, first[:, None] + steps, none), mask.astype(np.float32)


def summary(logits, doc, docs: int) -> np.ndarray:
    """Of each text, from the logits of all its windows: the three highest, the sum of probabilities and how many."""
    out = np.full((docs, 5), NONE)
    out[:, 3:] = 0
    if len(logits):
        order = np.lexsort((-logits, doc))
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        for i in range(3):
            rows = order[place == i]
            out[doc[rows], i] = np.maximum(logits[rows], NONE)
        out[:, 3] = np.log1p(np.bincount(doc, sigmoid(logits), docs))
        out[:, 4] = np.log1p(np.bincount(doc, minlength=docs))
    return out


def odds(buckets, bounds, labels, size: int) -> np.ndarray:
    """Log-odds of label 1 for each bucket by the number of texts it is in, drawn to 0 where these are few. Text i has
    ``buckets[bounds[i]:bounds[i + 1]]``."""
    counts = np.zeros((2, size))
    for label, a, b in zip(labels, bounds[:-1], bounds[1:]):
        counts[label, np.unique(buckets[a:b])] += 1
    share = (labels == 1).mean()
    out = np.log((counts[1] + 6 * share) / (counts[0] + 6 * (1 - share))) - np.log(share / (1 - share))
    return np.clip(out, -3, 4)


def compact(words: Words):
    """All parts of ``words``, in small numbers."""
    parts = [words.part(a, min(a + BLOCK, len(words.starts))) for a in range(0, max(1, len(words.starts)), BLOCK)]
    return (np.concatenate([p[i].astype(kind) for p in parts]) for i, kind in enumerate((np.int32, np.uint16, np.uint16, np.int32)))


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 5):
    """A network and what turns the windows of a text into its score. A quarter of the texts is for the latter."""
    rng = np.random.default_rng(seed)
    check = np.arange(len(labels)) % 4 == 3
    mine, ours = Words(texts.filter(pa.array(~check))), labels[~check]
    net = Network(seed)
    words, heads, grams, lengths = compact(mine)
    gram_at = np.concatenate([[0], np.cumsum(lengths)])
    net.start(odds(words, mine.first, ours, WORDS), odds(grams, gram_at[mine.first], ours, GRAMS),
              odds(heads, mine.first, ours, HEAD_BUCKETS))
    first, count, doc = mine.windows()
    hint = np.append(net.word[words, 0] + net.head[heads].max(1), -9)
    lead = np.concatenate([np.zeros(0), *(hint[placed(first[i : i + BATCH], count[i : i + BATCH], len(words))[0]].max(1)
                                          for i in range(0, len(first), BATCH))])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.weights.items()}
    turn = 0
    for step in range(PASSES):
        if step:
            lead = net.logits(mine)[0]
        # a toxic text teaches by its two likeliest windows, another by its two likeliest and two more
        order = np.lexsort((-lead, doc))
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc)) - np.searchsorted(doc, doc)
        other = np.lexsort((rng.random(len(doc)), doc))
        lot = np.empty(len(doc), np.int64)
        lot[other] = np.arange(len(doc)) - np.searchsorted(doc, doc)
        rows = np.flatnonzero((place < 2) | (ours[doc] == 0) & (lot < 2))
        rng.shuffle(rows)
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            index, mask = placed(first[some], count[some], len(words))
            used, where = np.unique(index, return_inverse=True)
            real = used[used < len(words)]
            own = np.concatenate([grams[gram_at[i] : gram_at[i + 1]] for i in real]) if len(real) else grams[:0]
            x = net.inputs(words[real], heads[real], own, lengths[real])
            slopes, dx = net.gradients(x, where.reshape(index.shape), mask, ours[doc[some]])
            turn += 1
            for k, slope in slopes.items():
                m, v = moments[k]
                m += 0.1 * (slope - m)
                v += 0.01 * (slope**2 - v)
                net.weights[k] -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
            dx = dx[: len(real)]
            np.add.at(net.word, words[real], -LOOKUP_RATE * dx[:, :WORD_WIDTH])
            np.add.at(net.gram, own, np.repeat(-LOOKUP_RATE * dx[:, WORD_WIDTH:-2] / lengths[real][:, None], lengths[real], axis=0))
    held = Words(texts.filter(pa.array(check)))
    return net, Logistic(400).fit(summary(*net.logits(held), held.docs), labels[check])


def _state(net: Network, top: Logistic) -> bytes:
    """A fitted model as plain arrays."""
    return pickle.dumps([{k: getattr(net, k) for k in ("word", "gram", "peak", "head", "weights")}, vars(top)])


def _model(state: bytes):
    net, top = Network.__new__(Network), Logistic()
    for made, values in zip((net, top), pickle.loads(state)):
        vars(made).update(values)
    return net, top


def _learnt(part: pa.Table) -> pa.Table:
    """The model that some labelled texts give, or null if a label is lacking."""
    found = part.to_pandas()
    # in an order that follows from the texts alone, and mixes the labels
    found["order"] = [zlib.crc32((t or "").encode()) for t in found["text"]]
    found = found.sort_values(["order", "text", "label"])
    marks = found["label"].to_numpy(np.int64)
    able = min((marks == 0).sum(), (marks == 1).sum()) >= 8
    return pa.table({"model": pa.array([_state(*fit(pa.array(found["text"], pa.large_string()), marks)) if able else None], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes | None:
    """Learn from a bounded sample of labelled documents that are not held out; None if a label is lacking.

    The sample is fitted in one task, and only the weights, whose number is fixed, come to the driver."""
    rows = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", sample, 0, SAMPLE_BYTES)
    row = rows.select("label", "text").groupBy(sf.lit("all")).applyInArrow(_learnt, "model binary").first()
    return bytes(row.model) if row and row.model else None


def scores(model, column) -> np.ndarray:
    words = Words(column)
    net, top = model
    return sigmoid(top.logits(summary(*net.logits(words), words.docs)))[:, 0]


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    ``labels`` has doc_id and toxic (1 or 0; other values are no label; an id with both counts as toxic). The network
    runs over overlapping windows of the whole text; the score, from 0 to 1, follows from the windows' logits.
    predicted is 1 from ``threshold`` on. A text that is null or without words has no window and the score that goes
    with that. A null doc_id is not held out. With fewer than eight labels of either kind there is nothing to learn:
    scores are 0. Of ``docs``, doc_id chooses the rows to learn from and text is scored; nothing else is looked at.
    """
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int"
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # of fixed size

    def run(batches):
        known = model.value and _model(model.value)
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                found = scores(known, piece.column("text")) if known else np.zeros(piece.num_rows)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": found,
                    "predicted": pa.array((found >= threshold).astype(np.int32))})

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(tidy(run), kind)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted to be toxic, with the columns of ``docs``.

    Scores are those of ``score``: whole texts count, a null, empty or blank text has no window and stays unless the model
    takes that for toxic, rows without id and repeated rows are judged each by its text. With too few labels all rows
    stay. An empty table gives no rows. Columns may have any names; only doc_id and text are looked at.
    """
    state = train(docs, labels)
    if state is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        known = _model(model.value)
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                yield piece.filter(pa.array(scores(known, piece.column("text")) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op7_toxicity(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
