"""Benchmark decontamination by winnowing.

Words of both sides are hashed in grams of k consecutive words, and of each `width` consecutive gram hashes the least is
kept. With k = 7 and width = 7 any 13 words that a document shares with an item hold at least one gram kept on both
sides. Items of fewer than 13 words are one window each, and get grams and widths of their own class of length
(CLASSES), so that each class guarantees spans as short as its shortest item. Only classes that the benchmark has are
looked for.

1. The benchmark's windows are a table: the window's words, its class, its fingerprint, and the set of items holding it.
2. One pass over the documents winnows each text. A Bloom filter of a fixed size over the benchmark's fingerprints
   travels with it; a fingerprint that it lets through goes on, with the words around it. A filter that a huge benchmark
   fills lets more through and is right all the same.
3. These fingerprints are joined with the benchmark's, the hits extended to every window around them, and the windows
   joined with the benchmark's by their words. So hash collisions add nothing and winnowing loses no window.
4. Hit words and item sets are put together for each document, from narrow rows; no text is shuffled.

There is one path for benchmarks of every size, and Spark decides by its own size check what it broadcasts.

Defined cases: null or wordless texts have no words, no hits, and are not contaminated; wordless items have no
windows; items of one id count once, a window that several items share counts for each, and an item without an id hits
but has no name; repeated document rows
each get their row; an empty benchmark leaves every document clean; texts of any length are looked through whole; other
columns, whatever their names, are ignored by `check` and passed on by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import bloom
from textloom.llm.common import batch, broadcast_if_small, cut, cut_map, free_name, only, texts

WINDOW = 13
GRAM = 7
SHARE = 20  # contaminated where SHARE * n_hit >= n_words
CHUNK_WORDS = 1 << 16  # winnowed at once
PART_BYTES = 1 << 20  # of texts taken together

#: upper to lower case; every other ASCII character that is no letter or digit becomes a space
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def classes(window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(least length, gram, width) of each class of window length, longest first; width = least length - gram + 1."""
    out = [(window, min(gram, window))]
    while (least := out[-1][0]) > 1:
        below = max(1, least * 5 // 8)
        out.append((below, (below + 1) // 2 if below > 3 else below))
    return [(n, g, n - g + 1) for n, g in out]


def class_of(size: int, steps: list[tuple[int, int, int]]) -> int:
    return next(i for i, (least, _, _) in enumerate(steps) if size >= least)


_rng = np.random.default_rng(20_013)
_LETTERS = _rng.integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(1 << 16, _BASE | np.uint64(1)))  # used over again by longer words


class Words:
    """The words of some texts: where each begins and ends in one buffer, and which are a text's."""

    def __init__(self, texts_: list[bytes]):
        self.buffer = b" ".join(t.translate(_TABLE) for t in texts_)
        here = np.frombuffer(self.buffer, np.uint8) != 32
        edges = np.flatnonzero(here[1:] != here[:-1]) + 1
        edges = np.concatenate([[0] if len(here) and here[0] else [], edges, [len(here)] if len(here) and here[-1] else []]).astype(np.int64)
        self.starts, self.ends = edges[::2], edges[1::2]
        places = np.cumsum([0] + [len(t) + 1 for t in texts_])
        self.first = np.searchsorted(self.starts, places)  # a text's words are first[i] to first[i + 1]

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> list[int]:
        return np.diff(self.first).tolist()

    def hashes(self, begin: int, end: int) -> np.ndarray:
        """A hash of each word from begin to end. Words of one hash may differ; the words themselves decide later."""
        starts, ends = self.starts[begin:end], self.ends[begin:end]
        if not len(starts):
            return np.empty(0, np.uint64)
        part = np.frombuffer(self.buffer, np.uint8)[starts[0] : ends[-1]]
        lengths = ends - starts
        at = np.cumsum(lengths) - lengths
        x = _LETTERS[part[part != 32]]
        x *= _POWERS[(np.arange(len(x)) - np.repeat(at, lengths)) & (len(_POWERS) - 1)]
        h = np.add.reduceat(x, at)
        return (h ^ (h >> np.uint64(32))) * _MIX

    def some(self, begin: int, end: int) -> list[str]:
        return [w.decode("utf-8", "replace") for w in self.buffer[self.starts[begin] : self.ends[end - 1]].split()] if end > begin else []


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = hashes * _BASE
    x ^= x >> np.uint64(29)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h * _MIX) ^ x[i : i + n]
    return h ^ (h >> np.uint64(31))


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the kept hashes: the last least one of each `width` consecutive hashes (of all, where there are fewer)."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    width = min(width, n)
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    at = np.arange(n - width + 1) + width - 1 - view.argmin(axis=1)  # never falls, as ties go to the last
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def fingerprint(hashes: np.ndarray, gram: int, width: int) -> int:
    """The fingerprint that a document holding a window keeps too: the least hash of its first `width` grams."""
    return int(gram_hashes(hashes, gram)[:width].min().view(np.int64))


# ---- the benchmark's tables


def _windows(steps: list[tuple[int, int, int]]):
    schema = pa.schema([("item", pa.string()), ("size", pa.int32()), ("class", pa.int32()), ("fp", pa.int64()), ("span", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column("item").to_pylist(), texts(b.column("text")), strict=True):
                words = Words([text])
                size = min(steps[0][0], len(words))
                if not size:
                    continue
                kind, h = class_of(size, steps), words.hashes(0, len(words))
                _, gram, width = steps[kind]
                for i in range(len(words) - size + 1):
                    rows.append((item, size, kind, fingerprint(h[i : i + size], gram, width), " ".join(words.some(i, i + size))))
                    if len(rows) >= 1 << 15:
                        yield batch(schema, *zip(*rows, strict=True))
                        rows = []
            if rows:
                yield batch(schema, *zip(*rows, strict=True))

    return run


def windows(benchmark: DataFrame, steps: list[tuple[int, int, int]]) -> DataFrame:
    """item, size, class, fp, span of each item's windows, as a table in the shared folder."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    return cut_map(rows, _windows(steps), "item string, size int, class int, fp long, span string", "windows")


# ---- the documents


_HITS = pa.list_(pa.struct([("class", pa.int32()), ("fp", pa.int64()), ("from", pa.int32()), ("words", pa.list_(pa.string()))]))


def candidates(words: Words, kinds: list[int], steps: list[tuple[int, int, int]], table: np.ndarray) -> Iterator[tuple[int, int, int, int, list[str]]]:
    """(text, class, fingerprint, place of the first word in its text, words) around each kept gram that the filter lets through."""
    longest = steps[0][0]
    for at in range(0, len(words), CHUNK_WORDS):
        stop = min(len(words), at + CHUNK_WORDS + longest - 1)  # every window begins in one chunk and ends in it
        h = words.hashes(at, stop)
        for kind in kinds:
            least, gram, width = steps[kind]
            if len(h) < least:
                continue
            most = longest if kind == 0 else steps[kind - 1][0] - 1  # a window of this class is no longer
            grams = gram_hashes(h, gram)
            kept = winnow(grams, width)
            kept = kept[bloom.passes(table, grams[kept])]
            for p, text in zip(kept.tolist(), (np.searchsorted(words.first, kept + at, side="right") - 1).tolist(), strict=True):
                low, high = int(words.first[text]), int(words.first[text + 1])
                begin, end = max(low, at, at + p - width + 1), min(high, stop, at + p + most)
                if end - begin >= least:
                    yield text, kind, int(grams[p].view(np.int64)), begin - low, words.some(begin, end)


def _parts(column: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in runs of about PART_BYTES; a longer one is a run of its own."""
    held, weight = [], 0
    for t in column:
        if held and weight + len(t) > PART_BYTES:
            yield held
            held, weight = [], 0
        held.append(t)
        weight += len(t)
    if held:
        yield held


def _look(shared, kinds: list[int], steps: list[tuple[int, int, int]], extra: list[tuple[str, pa.DataType]]):
    schema = pa.schema([*extra, ("rid", pa.int64()), ("n_words", pa.int64()), ("hits", _HITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            rids, ns, hits = [], [], []
            for part in _parts(texts(b.column("text"))):
                words, at = Words(part), len(rids)
                ns += words.counts()
                rids += range(number + at, number + at + len(part))
                hits += [None] * len(part)
                for text, c, f, p, around in candidates(words, kinds, steps, shared.value):
                    hits[at + text] = hits[at + text] or []
                    hits[at + text].append({"class": c, "fp": f, "from": p, "words": around})
            number += len(rids)
            yield batch(schema, *[b.column(n) for n, _ in extra], rids, ns, hits)

    return run


def _fresh_windows(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """rid, start, size, span of every window, of a size that its class has, within the words around each hit."""
    opened = hits.join(F.broadcast(sizes), "class")  # at most a row for each length up to WINDOW
    starts = F.sequence(F.lit(0), F.size("words") - F.col("size"))
    rows = opened.where(F.size("words") >= F.col("size")).select("rid", "from", "size", "words", F.explode(starts).alias("i"))
    span = F.array_join(F.expr("slice(words, i + 1, size)"), " ")
    return rows.select("rid", (F.col("from") + F.col("i")).alias("start"), "size", span.alias("span")).distinct()


def _verdicts(found: DataFrame, held: DataFrame) -> DataFrame:
    """found(rid, n_words, hits), held(item, size, class, fp, span) -> rid, n_hit, n_items, items_sha256 of rows with hits."""
    hits = found.where("hits is not null").select("rid", F.explode("hits").alias("h")).select("rid", "h.*")
    met = hits.join(held.select("class", "fp").distinct(), ["class", "fp"], "left_semi")
    sizes = held.select("class", "size").distinct()
    sets = held.groupBy("span", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = cut(sets.withColumn("gid", F.sha2(F.concat_ws("\x01", "items"), 256)), "spans")
    hit = cut(_fresh_windows(met, sizes).join(spans.select("span", "size", "gid"), ["span", "size"]).select("rid", "start", "size", "gid"), "hits")
    places = hit.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("places"))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(F.greatest(a["end"], p["start"] + p["size"]).alias("end"), (a["n"] + F.greatest(p["start"] + p["size"] - F.greatest(a["end"], p["start"]), F.lit(0))).alias("n")),
    )["n"]
    groups = spans.select("gid", "items").dropDuplicates(["gid"])
    named = hit.select("rid", "gid").distinct().join(groups, "gid").groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    told = named.select("rid", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return places.select("rid", covered.alias("n_hit")).join(told, "rid")


def _found(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, bits: int, extra: list[tuple[str, pa.DataType, str]]) -> tuple[DataFrame, DataFrame]:
    """A row of each document (extra columns, rid, n_words, hits), and the verdicts of those with hits."""
    steps = classes(window, gram)
    held = windows(only(benchmark, "item_id", "text"), steps)
    table, kinds = bloom.build(held, "fp", bits, "class")
    shared = docs.sparkSession.sparkContext.broadcast(table)
    columns = "".join(f"{n} {ddl}, " for n, _, ddl in extra)
    ddl = f"{columns}rid long, n_words long, hits array<struct<class:int,fp:long,from:int,words:array<string>>>"
    found = cut_map(docs, _look(shared, kinds, steps, [(n, t) for n, t, _ in extra]), ddl, "looked")
    return found, _verdicts(found, held)


def check(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = bloom.BITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found, verdicts = _found(docs, benchmark, window, gram, bits, [("doc_id", pa.int64(), "long")])
    told = found.select("doc_id", "rid", "n_words").join(verdicts, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return told.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = bloom.BITS, share: int | None = None) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns as they were.

    share: where given, a document goes only if share times its hit words are at least its words. Documents to go are
    told by the digest of their text, so rows of one text go or stay together.
    """
    key = free_name("text_key", docs.columns)
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    found, verdicts = _found(keyed.select(F.col(key).alias("text_key"), "text"), benchmark, window, gram, bits, [("text_key", pa.string(), "string")])
    bad = found.select("text_key", "rid", "n_words").join(verdicts, "rid")
    if share is not None:
        bad = bad.where(share * F.col("n_hit") >= F.col("n_words"))
    gone = cut(bad.select(F.col("text_key").alias(key)).distinct(), "contaminated")
    return keyed.join(broadcast_if_small(gone), key, "left_anti").drop(key)
