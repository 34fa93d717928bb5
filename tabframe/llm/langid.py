"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as sf

from tabframe.llm.common import Texts, held_out, pieces, table
from tabframe.llm.features import Logistic, gram_counts, sampled, shares, sigmoid

#: Hashed byte n-grams.
GRAMS = 2048
#: Documents per language that the bit classifiers learn from, about.
SAMPLE = 600
#: Learn from texts of at most so many bytes.
SAMPLE_BYTES = 1 << 16
#: A decision whose best and second language are closer than this share is ambiguous.
CLOSE = 0.2
SEED = 11
UNKNOWN = "und"


def codewords(count: int, seed: int = SEED) -> np.ndarray:
    """A row of 0 and 1 for each of ``count`` languages: all splits in two for up to five, else the best of many seeded
    codes by the least distance of rows. Each column has both values."""
    if count < 2:
        return np.zeros((count, 0), np.int8)
    if count <= 5:
        columns = [[(c >> i) & 1 for i in range(count)] for c in range(1, 1 << (count - 1))]
        return np.array(columns, np.int8).T
    rng, width, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(count))), (-1, None)
    for _ in range(200):
        code = rng.integers(0, 2, (count, width), np.int8)
        apart = (code[:, None] != code[None]).sum(2) + width * np.eye(count, dtype=np.int64)
        good = apart.min() - width * (np.ptp(code, axis=0) == 0).any()
        if good > best[0]:
            best = (good, code)
    return best[1]


class Codes:
    """Binary classifiers for the bits of the languages' codewords."""

    def __init__(self, names: list[str]):
        self.names, self.code = names, codewords(len(names))

    def fit(self, x, labels):
        if self.code.shape[1]:
            index = {n: i for i, n in enumerate(self.names)}
            which = np.array([index[t] for t in labels])
            count = np.bincount(which, minlength=len(self.names))
            bits = self.code[which]
            # languages weigh alike, whatever their share
            self.model = Logistic(150).fit(x, bits, 1 / count[which])
            loss = np.log1p(np.exp(-(2 * bits - 1) * self.model.logits(x)))
            # a bit that is learned well counts for more
            self.weights = 1 / (0.05 + (loss / count[which][:, None]).sum(0) / len(self.names))
            self.weights /= self.weights.sum()
        return self

    def decode(self, x):
        """Index of the nearest codeword by weighted loss, its score, and whether another is nearly as near."""
        if len(self.names) < 2:
            one = np.zeros(len(x), np.int64)
            return one, np.ones(len(x)), np.zeros(len(x), bool)
        margin = self.model.logits(x)
        signs = (2 * self.code - 1).astype(float)
        loss = (np.log1p(np.exp(np.clip(-margin[:, None, :] * signs[None], -40, 40))) * self.weights).sum(2)
        share = sigmoid(0) * 2 * np.exp(-self.code.shape[1] * (loss - loss.min(1, keepdims=True)) / 2)
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, axis=1)
        return loss.argmin(1), order[:, -1], order[:, -1] - order[:, -2] < CLOSE


def _vectors(texts: Texts):
    return np.array([shares(gram_counts(texts.data[a:b], GRAMS)) for a, b in zip(texts.starts[:-1], texts.starts[1:])])


def _sample_vectors(batches):
    for batch in batches:
        for piece in pieces(batch, "text"):
            vectors = _vectors(Texts(piece.column("text")))
            yield pa.RecordBatch.from_pydict({"label": piece.column("label"), "x": [v.tobytes() for v in vectors]})


def train(docs: DataFrame, sample: int = SAMPLE) -> Codes:
    """Learn from text and lang of rows that are not held out, have both, and are of bounded length; a bounded sample
    of each language. Only vectors of fixed size come to the driver."""
    rows = docs.where(~held_out() & sf.col("lang").isNotNull() & (sf.octet_length("text") <= SAMPLE_BYTES))
    rows = sampled(rows.select("doc_id", "text", sf.col("lang").alias("label")), "label", sample)
    found = rows.select("label", "text").mapInArrow(_sample_vectors, "label string, x binary").toPandas()
    # the fit doesn't depend on the order in which rows arrive
    found = found.sort_values(["label", "x"])
    x = np.array([np.frombuffer(v, np.float32) for v in found["x"]]).reshape(len(found), GRAMS)
    return Codes(sorted(set(found["label"]))).fit(x, list(found["label"]))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, ambiguous.

    Each language has a codeword; a classifier on byte n-grams of the whole text predicts each bit, and the language
    whose codeword has the least weighted loss is chosen. ``score`` is its share among all; ``ambiguous`` flags
    documents with another language nearly as near. A text that is null or has no letter is ``und`` with score 0, and
    so is every text if there is nothing to learn from; a null doc_id is not held out. ``docs`` needs doc_id, text
    and lang; lang serves learning alone, and other columns, whatever their names, are not looked at.
    """
    model = train(docs.select("doc_id", "text", "lang"), sample)
    names = [*model.names, UNKNOWN]

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                letters = np.asarray(piece.column("letters").to_pylist(), bool) & bool(model.names)
                which = np.full(piece.num_rows, len(names) - 1)
                score, close = np.zeros(piece.num_rows), np.zeros(piece.num_rows, bool)
                if letters.any():
                    x = _vectors(Texts(piece.column("text").filter(pa.array(letters))))
                    which[letters], score[letters], close[letters] = model.decode(x)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"),
                    "lang_pred": pa.array([names[i] for i in which], pa.string()), "score": score, "ambiguous": close})

    letters = sf.coalesce(sf.col("text").rlike(r"\p{L}"), sf.lit(False)).alias("letters")
    return docs.select("doc_id", "text", held_out().alias("held_out"), letters).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op9_langid(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
