"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Unigrams and bigrams of words are hashed to 2^18 buckets. Two multinomials are counted over them: one from every raw
document, one from the trusted documents. A document's score is the sum over its features of
log p_trusted - log p_raw, divided by the number of features; it is kept if the score is at least a fixed threshold.
Weights are whole millionths made from whole counts, so every run and every partitioning gives the same verdicts.

Defined cases: a null or blank text has no words, all counts zero, score zero, and fails the base rules (fewer than 50
words); a repeated row gets the same verdict each time; a null doc_id is passed through and never trusted; a document
with several label rows is trusted if any of them says so; with no trusted document at all every weight is zero and
the method keeps what the base rules keep; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, batch, only, release, texts

BITS = 18
SMOOTHING = 4.0  # pseudo-count of each bucket at the trusted text's total
THRESHOLD = -0.2
TRUSTED_BLOCK = 8_000_000  # ids of trusted documents that a task holds at once (8 bytes each)
SCALE = 1_000_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CACHE_WORDS = 100_000
HELD = 1 << 18  # features that wait to be counted at once

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """word -> hash, for the words met of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class _Tally:
    """Counts of buckets; features are held until there are enough of them to be counted at once."""

    def __init__(self, bits: int):
        self.counts, self.held, self.n = np.zeros(1 << bits, np.int64), [], 0

    def add(self, f: np.ndarray) -> None:
        self.held.append(f)
        self.n += len(f) + 16  # an array's head, so that many short or empty texts are bounded too
        if self.n >= HELD:
            self.total()

    def total(self) -> np.ndarray:
        if self.held:
            self.counts += np.bincount(np.concatenate(self.held), minlength=len(self.counts))
            self.held, self.n = [], 0
        return self.counts


def features(words: list[bytes], cache: dict, bits: int = BITS) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams."""
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if len(h) > 1:
        h = np.concatenate([h, (h[:-1] * _MIX) ^ h[1:]])
    return ((h * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that stands twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    k = len(ids)
    if k >= 1 << 21:  # 64 bits don't hold three ids
        _, pair = np.unique(x[:-1] * k + x[1:], return_inverse=True)
        windows = pair[:-1] * k + x[2:]
    else:
        windows = (x[:-2] * k + x[1:-1]) * k + x[2:]
    _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
    hit = counts[at] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.split():
            seen.add(line)
    return n


def base(text: bytes) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """Words, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. bytes.split() parts at 20 and 09-0D alone."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    return words, (len(words), chars, len(_SYMBOLS.findall(text)), duplicate_lines(text), repeated_words(words))


def count_buckets(docs: DataFrame, trusted_ids, bits: int = BITS, raw_too: bool = True) -> DataFrame:
    """docs(doc_id, text) -> bucket, raw, trusted: counts summed in each task before the shuffle.

    trusted_ids: a broadcast sorted array; documents whose id is in it count as trusted. raw_too: all rows count as raw,
    else none does and only trusted ones are split.
    """
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("trusted", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, cache, all_, good = trusted_ids.value, _Words(), _Tally(bits), _Tally(bits)
        for b in batches:
            flags = _among(b.column("doc_id"), ids)
            column = b.column("text") if raw_too else b.column("text").filter(pa.array(flags))
            for text, yes in zip(texts(column), flags if raw_too else flags[flags], strict=True):
                f = features(text.split(), cache, bits)
                if raw_too:
                    all_.add(f)
                if yes:
                    good.add(f)
        raw, trusted = all_.total(), good.total()
        at = np.flatnonzero(raw + trusted)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield batch(schema, part.astype(np.int32), raw[part], trusted[part])

    rows = arrow_map(docs, count, "bucket int, raw long, trusted long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def _among(column: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Which of the column's ids are in the sorted array; a null is not."""
    if not len(ids):
        return np.zeros(len(column), bool)
    x = column.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    return (ids[at] == x) & column.is_valid().to_numpy(zero_copy_only=False)


def totals(docs: DataFrame, labels: DataFrame, bits: int = BITS, block: int = TRUSTED_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """raw, trusted counts of each bucket, over all documents and over all that a label trusts (quality 1 and no toxicity).

    Trusted ids are dealt by their hash into blocks of about `block`, and a block at a time is sent to the tasks, so no
    text is shuffled. Each further block is one more reading of the documents, of which only those of its hash go to
    Python and only trusted ones are split. At most 2^bits rows a block reach the driver, however large the corpus.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    blocks = max(1, -(-good.count() // block))
    raw, trusted = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for k in range(blocks):
        own = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k
        shared = spark.sparkContext.broadcast(np.sort(good.where(own).toArrow()["doc_id"].to_numpy()))
        rows = count_buckets(docs if k == 0 else docs.where(own), shared, bits, k == 0).toArrow()
        at = rows["bucket"].to_numpy()
        raw[at] += rows["raw"].to_numpy()
        trusted[at] += rows["trusted"].to_numpy()
        shared.destroy()
    return raw, trusted


def weights(raw: np.ndarray, trusted: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log-likelihood ratio of each bucket in millionths."""
    total, good = raw.sum(), trusted.sum()
    if not good:
        return np.zeros(len(raw), np.int32)
    ratio = np.log(trusted + smoothing) - np.log(raw * (good / total) + smoothing)  # both multinomials at the trusted total
    return np.rint(ratio * SCALE).astype(np.int32)


def _judge(shared, bits: int, threshold: float):
    limit = round(threshold * SCALE)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table, cache = shared.value, _Words()
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")}
            for text in texts(b.column("text")):
                words, counts = base(text)
                f = features(words, cache, bits)
                total = int(table[f].sum(dtype=np.int64)) if len(f) else 0
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                row = (*counts, failed, total / (SCALE * len(f)) if len(f) else 0.0, not failed and total >= limit * len(f))
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            yield b, out

    return judge


def score(docs: DataFrame, labels: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, score, kept."""
    docs = only(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(weights(*totals(docs, labels, bits), smoothing))
    judge = _judge(shared, bits, threshold)
    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, out in judge(batches):
            yield batch(schema, b.column("doc_id"), *out.values())

    return arrow_map(docs, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with all their columns as they were. Only texts travel to Python; nothing is shuffled for the verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(weights(*totals(docs, labels, bits), smoothing))
    judge = _judge(shared, bits, threshold)

    @F.arrow_udf("boolean")
    def verdict(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        named = (pa.record_batch([c], names=["text"]) for c in column)
        try:
            for _, out in judge(named):
                yield pa.array(out["kept"], pa.bool_())
        finally:
            release()

    return docs.where(verdict(F.col("text")))
