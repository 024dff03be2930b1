"""Quality classifier: averaged embeddings of hashed words and character n-grams, softmax output.

A word's vector is the sum of learned vectors of its features: its own hash and those of the character 3- to 5-grams of
the word with its boundaries; neighbouring words add the hash of their pair. A document's vector is the mean over all
its words, and two logits follow. Vectors and
logits are trained in numpy by stochastic gradient descent with a falling rate. As the output is linear in the mean,
scoring needs only each feature's share of the logit difference: a vector of one number for each bucket.

The model is fitted on at most TRAIN_ROWS labelled rows, those of the least hash of doc_id among the rows whose crc32
of the doc_id as text, modulo 3, is not 1. Whole texts are hashed on the executors; the driver gets their buckets.

Defined cases: a null or empty text has the score of the prior; words of any length count whole; repeated rows get
equal scores; a null doc_id is scored, is never trained on and not held out; a row with several labels trains once with
the least of them; of rows that repeat a doc_id the one of the least buckets and weights trains; without both labels in the training rows every score is the share of label 1, or one half; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, batch, only, texts

BUCKETS = 1 << 16
DIMENSIONS = 16
TRAIN_ROWS = 4_000
EPOCHS, RATE = 8, 0.5
SEED = 7
GRAMS = (3, 4, 5)
CACHE_WORDS = 400_000
BLOCK_WORDS = 50_000  # of a text hashed at once
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_TOP = np.uint64(48)  # leaves 16 bits, a bucket


class WordHashes(dict):
    """word -> hash, for the words met of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def gram_hashes(words: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the 3- to 5-grams of characters inside words, a blank at either end of a word being one of them."""
    x = np.frombuffer((b" " + b" ".join(words) + b" ").decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    blanks = np.concatenate([[0], np.cumsum(x == 32)])
    h = np.zeros(len(x), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(x) - n + 1
        if m <= 0:
            return
        h = h[:m] * _PAIR + x[n - 1 :]
        if n in GRAMS:
            yield (h * np.uint64(2 * n + 1))[blanks[n - 1 : n - 1 + m] == blanks[1 : m + 1]]  # no blank inside


def feature_buckets(words: list[bytes], cache: dict) -> Iterator[np.ndarray]:
    """Buckets of words, of neighbouring pairs, and of character n-grams, each as often as it occurs."""
    for i in range(0, len(words), BLOCK_WORDS):
        own = words[i : i + BLOCK_WORDS + 1]  # with the next block's first word, for the pair
        h = np.fromiter(map(cache.__getitem__, own), np.uint64, len(own))
        hashes = [h[:BLOCK_WORDS], (h[:-1] * _PAIR) ^ h[1:], *gram_hashes(own[:BLOCK_WORDS])]
        yield ((np.concatenate(hashes) * _SPREAD) >> _TOP).astype(np.int64)


def document(text: bytes, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which are counts over its number of words."""
    words = text.split()
    counts = np.zeros(BUCKETS, np.int64)
    for own in feature_buckets(words, cache):
        counts += np.bincount(own, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, (counts[found] / max(len(words), 1)).astype(np.float32)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, quality, buckets, weights of the rows to train on: at most `bound`, one for each id; every task gets the ids."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("buckets", pa.binary()), ("weights", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            made = [document(t, cache) for t in texts(b.column("text"))]
            yield batch(schema, b.column("doc_id"), b.column("quality"), [x.astype("<u2").tobytes() for x, _ in made], [w.astype("<f4").tobytes() for _, w in made])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = arrow_map(joined, run, "doc_id long, quality int, buckets binary, weights binary")
    least = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "buckets", "weights")).alias("row"))  # partial in each task
    return least.select("doc_id", "row.*")


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, float]:
    """(label, buckets, weights) rows -> each bucket's share of the logit difference, and its constant."""
    labels = np.array([y for y, _, _ in rows])
    if len(set(labels.tolist())) < 2:
        share = min(max(labels.mean(), 0.01), 0.99) if len(labels) else 0.5
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (BUCKETS, dimensions)).astype(np.float32)
    out, constant = np.zeros((dimensions, 2), np.float32), np.log(np.array([1 - labels.mean(), labels.mean()], np.float32))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, buckets, weights = rows[i]
            step = rate * (1 - done / steps)
            done += 1
            own = vectors[buckets]
            mean = weights @ own
            logits = mean @ out + constant
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            pull = out @ error
            out -= step * np.outer(mean, error)
            constant -= step * 0.1 * error
            vectors[buckets] = own - (step * weights)[:, None] * pull
    return vectors @ (out[:, 1] - out[:, 0]), float(constant[1] - constant[0])


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    got = training_rows(docs, labels, bound).toArrow().sort_by("doc_id")
    rows = [
        (y, np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(w, "<f4"))
        for y, b, w in zip(got["quality"].to_pylist(), got["buckets"].to_pylist(), got["weights"].to_pylist(), strict=True)
    ]
    return fit(rows)


def score(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = only(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, bound))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, constant = shared.value
        cache = WordHashes()
        for b in batches:
            scores = []
            for text in texts(b.column("text")):
                words = text.split()
                total = sum(float(share[own].sum(dtype=np.float64)) for own in feature_buckets(words, cache)) / max(len(words), 1)
                scores.append(1 / (1 + np.exp(-np.clip(constant + total, -60, 60))))
            yield batch(schema, b.column("doc_id"), b.column("held_out"), scores, [int(s >= 0.5) for s in scores])

    return arrow_map(docs.withColumn("held_out", held_out()), run, "doc_id long, held_out boolean, score double, predicted int")
