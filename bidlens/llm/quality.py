"""Quality classifier on supervised subword embeddings.

Each word gives hashed features: itself, and its character n-grams with marked
ends.  A feature has a learned vector, a document is the average of the vectors
of all its features, and a softmax layer tells the labels apart.  Vectors and
layer are trained by stochastic gradient descent in numpy, one document a step,
on a bounded sample: the ``SAMPLE_ROWS`` labelled ids per label with the
smallest id digests that are not held out, one row per id.  Texts of the sample are turned into
feature counts by Spark; a document has at most ``BUCKETS`` of them, so what the
driver gathers is bounded by 2 * SAMPLE_ROWS * BUCKETS counts.

For scoring, vector and layer fold into one number per feature, and these sum up
per word.  Words already seen by a worker process keep theirs (a bounded number
of words), so a text costs one split and one look-up per word.

The sample holds both labels about evenly; the layer's bias is moved to the
shares the labels have among all rows that may be learned from.

Defined results: NULL and empty texts have no features and get the score of the
bias alone; whole texts are scored, however long; labels that are NULL or for
unknown ids are not learned from; an id that is labelled more than once has the
label of most of its rows, 1 on a tie, and counts once; of documents with one id
the smallest text is learned from; repeated documents get the same score; with labels of one kind only,
every score is that label's; an empty table gives no rows; other columns are
carried by ``keep_good`` and ignored by ``score``.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.tables import packed, unpacked, whole_row

BUCKETS = 1 << 16
SAMPLE_ROWS = 1_500
DIMENSIONS = 12
EPOCHS = 12
RATE = 1.0
GRAMS = (2, 3, 4)
KEPT_WORDS = 500_000
HELD_OUT = 1


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == HELD_OUT


def word_buckets(word: str) -> list[int]:
    """The buckets of a word and of its character n-grams."""
    marked = f"<{word}>"
    grams = [marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in (f"={word}", *grams)]


class Model(NamedTuple):
    """What scoring needs: one weight per bucket, and the bias of the log-odds of label 1."""

    weights: np.ndarray
    bias: float


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            found: Counter = Counter()
            for word, times in Counter((batch.column(1)[i].as_py() or "").split()).items():
                for bucket in word_buckets(word):
                    found[bucket] += times
            keys = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), pa.array([keys], pa.list_(pa.int32())),
                 pa.array([[float(found[k]) for k in keys]], pa.list_(pa.float32()))],
                names=["label", "buckets", "counts"])


def usable_labels(labels: DataFrame) -> DataFrame:
    """(id, label) of every id that may be learned from, one row each."""
    votes = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).where(
        "id IS NOT NULL AND label IN (0, 1)").where(~is_held_out(F.col("id")))
    return votes.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """label, buckets, counts of the sampled documents."""
    usable = usable_labels(labels)
    order = [F.md5(F.col("id").cast("string")), F.col("id")]
    chosen = [usable.where(F.col("label") == k).orderBy(*order).limit(rows) for k in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * rows rows at most
    return (docs.select(F.col("doc_id").alias("id"), "text").join(sample, "id")
            .groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")
            .mapInArrow(_counts, "label int, buckets array<int>, counts array<float>"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    sample = training_sample(docs, labels, rows).toArrow()
    y = sample.column("label").to_numpy()
    if len(set(y.tolist())) < 2:
        only = int(y[0]) if len(y) else 1
        return Model(np.zeros(BUCKETS), 20.0 if only else -20.0)
    buckets = [np.asarray(b.as_py(), np.int64) for b in sample.column("buckets")]
    counts = [np.asarray(c.as_py(), np.float64) for c in sample.column("counts")]
    shares = [c / max(c.sum(), 1.0) for c in counts]
    # An order that does not depend on how Spark delivered the rows.
    order = sorted(range(len(y)), key=lambda i: (zlib.crc32(buckets[i].tobytes()), counts[i].sum(), int(y[i])))
    vectors, layer, bias = _descend([buckets[i] for i in order], [shares[i] for i in order],
                                    y[order], np.random.default_rng(seed))
    total = {r["label"]: r["n"] for r in usable_labels(labels).groupBy("label").agg(F.count("*").alias("n")).collect()}
    seen = Counter(y.tolist())
    shift = math.log(total[1] / total[0]) - math.log(seen[1] / seen[0])
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0] + shift))


def _descend(buckets: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, rng: np.random.Generator):
    """Stochastic gradient descent over averaged feature vectors and a softmax layer."""
    vectors = rng.uniform(-1.0, 1.0, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    layer, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = RATE * (1.0 - done / steps)
            done += 1
            hidden = shares[i] @ vectors[buckets[i]]
            logits = hidden @ layer + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[y[i]] -= 1.0
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            # Shares are small for long texts; the root of their squares keeps a step's length even.
            vectors[buckets[i]] -= rate * np.outer(shares[i] / np.sqrt((shares[i] ** 2).sum() + 1e-12), back)
    return vectors, layer, bias


_WORDS: dict[int, dict[str, complex]] = {}


def _word_sums(model: Model) -> dict[str, complex]:
    """Weights and numbers of features per word, as real and imaginary part: one sum adds both."""
    key = zlib.crc32(model.weights.tobytes()) ^ hash(model.bias)
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = {}
    return _WORDS[key]


def score_texts(model: Model, texts: list[str | None]) -> list[float]:
    known = _word_sums(model)
    out = []
    for text in texts:
        words = (text or "").split()
        if len(known) > KEPT_WORDS:
            known.clear()
        for word in set(words).difference(known):
            buckets = word_buckets(word)
            known[word] = complex(model.weights[buckets].sum(), len(buckets))
        both = sum(map(known.__getitem__, words), 0j)
        logit = model.bias + (both.real / both.imag if words else 0.0)
        out.append(1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, logit)))))
    return out


def _scored(docs: DataFrame, model: Model, text: str, keep: Column, keep_type: T.DataType) -> DataFrame:
    """(doc, score) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bidlens.llm.bpe import slices

        for batch in batches:
            scores = [s for _, texts in slices(batch.column(1)) for s in score_texts(model, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())],
                                             names=["doc", "score"])

    schema = T.StructType([T.StructField("doc", keep_type), T.StructField("score", T.DoubleType())])
    return docs.select(keep.alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = _scored(docs, train(docs, labels), text, F.col(doc_id), docs.schema[doc_id].dataType)
    return scored.select(F.col("doc").alias("doc_id"), is_held_out(F.col("doc")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are predicted to be good, with their columns."""
    whole = packed(docs)
    scored = _scored(docs, train(docs, labels), text, whole_row(docs.columns), whole.schema["doc"].dataType)
    return unpacked(scored.where("score >= 0.5"))
