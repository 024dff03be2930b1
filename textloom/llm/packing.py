"""Best-two-fit packing of whole documents into sequences of a fixed number of tokens.

Tokens of a text end with the id 0. Only longer documents are cut; all their pieces but the first are full. The
remaining pieces are packed by their lengths: a bin is filled greedily, longest piece that fits first; then, while it
has a gap, its smallest piece may give way to the two unpacked pieces that fill the widened gap best. Lengths are
whole numbers up to the sequence length, so a histogram of them holds all that packing needs: the driver packs the
histogram (at most 2,048 rows whatever the corpus), making each bin as often as its pieces allow, and gets patterns
(bin, how often). Every piece then has a rank among those of its length, and the rank names its bin and place.

Ranks come from counts of each length in each lane, a lane being the pieces that one task of the tokenizing pass
wrote: the pass numbers its pieces of a length itself, and lanes' starts are running sums over the lanes' counts. No
key's rows are ever gathered, however common a length.

Ids are those of `tokenizers` for the given file. Texts of Latin letters, digits, common marks and white space go
through tiktoken on the same vocabulary, which yields the same ids at a quarter of the cost; all others, texts that
hold the special token's string, and texts with a run of LONG_RUN blanks or of LONG_RUN other characters, for which
tiktoken's matcher has no room on its stack, go through tokenizers itself.

Defined cases: a null or empty text is one piece of one id; repeated rows and null doc_ids keep their own pieces; an
empty table gives an empty result; a text of any length is cut as above; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, batch, cut, only

LENGTH = 2048
LONG_RUN = 4096

_RUN = re.compile(r"\s{%d}|\S{%d}" % (LONG_RUN, LONG_RUN))
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞€]*")


class Encoder:
    """Ids of texts, one array each."""

    def __init__(self, vocabulary: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.whole.encode_special_tokens = True
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and _PLAIN.fullmatch(text) and "<|endoftext|>" not in text and (len(text) < LONG_RUN or not _RUN.search(text)):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, ranks: str | None) -> Encoder:
    """One encoder for each worker process."""
    if (key := (vocabulary, ranks)) not in _encoders:
        _encoders[key] = Encoder(vocabulary, ranks)
    return _encoders[key]


def cut_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of the pieces of n ids."""
    first = n % length
    return ([first] if first else []) + [length] * (n // length)


def pack(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a bin, how many such bins) that use every piece of the histogram once."""
    left = np.zeros(length + 1, np.int64)
    for size, n in histogram.items():
        if not 0 < size <= length or n < 0:
            raise ValueError("lengths lie between 1 and the sequence's")
        left[size] = n
    patterns = []
    while left.any():
        own = left.copy()
        bin_, gap = [], length
        while gap and len(fits := np.flatnonzero(own[1 : gap + 1])):
            size = int(fits[-1]) + 1
            n = min(int(own[size]), gap // size)
            bin_ += [size] * n
            own[size] -= n
            gap -= n * size
        if gap and len(bin_) > 1 and (pair := _best_two(own, gap + bin_[-1], bin_[-1])):
            own[bin_.pop()] += 1
            bin_ += pair
        sizes, need = np.unique(bin_, return_counts=True)
        times = int((left[sizes] // need).min())
        left[sizes] -= need * times
        patterns.append((tuple(bin_), times))
    return patterns


def _best_two(own: np.ndarray, room: int, least: int) -> list[int] | None:
    """The two pieces with the greatest sum over `least` and up to `room`."""
    sizes = np.flatnonzero(own[: room + 1])
    if not len(sizes):
        return None
    at = np.searchsorted(sizes, room - sizes, side="right") - 1  # the longest partner that fits each size
    ok = at >= 0
    same = ok & (sizes[at] == sizes) & (own[sizes] < 2)  # a size can't pair with its only piece
    at[same] -= 1
    ok &= at >= 0
    sums = np.where(ok, sizes + sizes[at], 0)
    best = int(sums.argmax())
    return [int(sizes[best]), int(sizes[at[best]])] if sums[best] > least else None


def _pieces(vocabulary: str, ranks: str | None, length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("lane", pa.int64()), ("number", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(vocabulary, ranks), np.zeros(length + 1, np.int64)
        for b in batches:
            rows = []
            for doc, lane, text in zip(b.column("doc_id").to_pylist(), b.column("lane").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                start = 0
                for piece, size in enumerate(cut_lengths(len(ids), length)):
                    rows.append((doc, piece, start, size, zlib.crc32(ids[start : start + size].tobytes()), lane, int(seen[size])))
                    seen[size] += 1
                    start += size
            yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 7))

    return run


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    lanes = only(docs, "doc_id", "text").withColumn("lane", F.spark_partition_id().cast("long"))
    pieces = cut(arrow_map(lanes, _pieces(vocabulary, ranks, length), "doc_id long, piece int, start long, length long, ids_crc32 long, lane long, number long"), "pieces")
    counts = pieces.groupBy("lane", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("lane", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    shared = spark.sparkContext.broadcast(_places(pack(histogram, length)))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = _locate(shared.value, b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield batch(schema, *[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], sequence, offset)

    ranked = pieces.join(starts, ["lane", "length"]).withColumn("rank", F.col("first") + F.col("number")).drop("lane", "number", "first")
    return arrow_map(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> first ranks of its runs, each run's first sequence and offset. A run: a place of a pattern, over all bins of it."""
    runs: dict[int, list[tuple[int, int]]] = {}
    times_of: dict[int, list[int]] = {}
    sequence = 0
    for bin_, times in patterns:
        offset = 0
        for size in bin_:
            runs.setdefault(size, []).append((sequence, offset))
            times_of.setdefault(size, []).append(times)
            offset += size
        sequence += times
    return {s: (np.cumsum([0, *times_of[s][:-1]]), *map(np.array, zip(*r, strict=True))) for s, r in runs.items()}


def _locate(places: dict, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
    for size in np.unique(lengths):
        mine = lengths == size
        firsts, sequences, offsets = places[int(size)]
        at = np.searchsorted(firsts, ranks[mine], side="right") - 1
        sequence[mine] = sequences[at] + ranks[mine] - firsts[at]
        offset[mine] = offsets[at]
    return sequence, offset
