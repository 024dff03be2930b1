"""Fuzzy line dedup: character-shingle MinHash, banding, exact Jaccard verification, distributed union-find.

Lines are compared by the sets of 8-character shingles of their normal form (lower case, white space collapsed). Every
line with a word takes part, in any script: lines of fewer than 8 characters, which have no shingle, link if their forms
are equal. Two lines link if the Jaccard similarity of their sets is 0.8 or more; of every component the line that
comes first, by doc_id and line number, is kept.

1. Each task signs the lines it meets: 32 minima, as 8 bands of 4 rows. A pair at 0.8 shares a band with probability
   0.985, one at 0.9 with 0.9998. Equal lines share a hash and are signed once a task.
2. Bands are dealt out by their hash and sorted; a bucket streams by and each member is paired with the bucket's first
   (its lead), so a bucket of n lines gives n - 1 pairs, never n squared, and no bucket is held.
3. Pairs are verified on the lines' forms, which the signing pass wrote aside; a Bloom filter of fixed size over the
   candidates keeps all others from the shuffle, and no document is read or moved again. Where a member fails against its lead,
   the bucket's failures are compared with each other, and with those members that the triangle inequality of
   Jaccard distance still allows: a member x linked to the lead can be within 0.2 of a failure y only if
   j(x) <= j(y) + 0.2. Comparisons inside one component are skipped; links alone are put out. Shingles are compared as
   numbers that hold their characters, so the comparison stays exact; in a bucket, bits of a fixed number tell first
   which pairs differ too much.
4. Links are united by large-star and small-star rounds, and occurrences by a minimum over each component. A component's
   minimum is a table before occurrences are joined with it, so that Spark can split the occurrences of a very common line.

Defined cases: null and empty texts have no lines to drop; documents of a null doc_id are returned as they are and their
lines count for nobody; rows that repeat a doc_id are one document, so a line is not its own duplicate; ties are decided by
(doc_id, line); a document all of whose lines with a word are dropped leaves `dedup`'s result; an empty table gives an
empty result; other columns, whatever their names, are passed on by `dedup` and ignored by `report`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import bloom
from textloom.llm.common import arrow_map, batch, cut_map, cut_rows, free_name, gather, only
from textloom.operators.components import connected

GRAM = 8
SIMILARITY = 0.8
BANDS, ROWS = 8, 4
SEED = 20_011
CHUNK_CHARS = 50_000  # of new lines signed at once: their arrays stay in a core's cache
CHUNK_LINES = 5_000
SEEN_LINES = 300_000
FEW = 4096  # members of a bucket up to which it is compared without an index
MARKS = 2048  # bits that a set of shingles is first compared by

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 2**31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 2**32, BANDS * ROWS).astype(np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = {k: np.uint64(pow(int(_STEP), k, 1 << 64)) for k in (1, 2, 4)}
_CLOSE = (1 + SIMILARITY) / (1 - SIMILARITY)  # times the differing shingles: the least sum of sizes at SIMILARITY


def normal(line: str) -> str | None:
    """The form in which a line is compared; None if it has no word."""
    return " ".join(line.lower().split()) or None


_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def normal_lines(text: str) -> list[str | None]:
    """normal() of each line of a text."""
    if "  " in text or any(c in text for c in _BLANKS):
        return [normal(line) for line in text.split("\n")]
    return [line.strip(" ") or None for line in text.lower().split("\n")]  # nothing within a line to collapse


def line_hash(form: str) -> int:
    value = xxhash.xxh3_64_intdigest(form.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def bands(forms: list[str]) -> np.ndarray:
    """Band hashes of each form: an array of BANDS numbers a line."""
    x = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, forms), np.int64, len(forms))
    starts = np.cumsum(lengths) - lengths
    for step in (1, 2, 4):  # polynomials over 2, 4 and GRAM characters
        x = x[:-step] * _POWERS[step] + x[step:]
    h = np.concatenate([x, [np.uint64(0)]])  # one more, that the last edge has a place
    h ^= h >> np.uint64(32)
    h *= _MIX
    short = (h >> np.uint64(32)).astype(np.uint32)
    edges = np.stack([starts, starts + lengths - GRAM + 1], axis=1).ravel()
    v = np.empty_like(short)
    out = np.empty((len(forms), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(forms), band + 1, np.uint64) * _STEP
        for row in range(ROWS):
            k = band * ROWS + row
            np.multiply(short, _FACTORS[k], out=v)
            np.add(v, _SHIFTS[k], out=v)
            key = (key ^ np.minimum.reduceat(v, edges)[::2]) * _MIX
            key ^= key >> np.uint64(31)
        out[:, band] = key
    return out.view(np.int64)


def shingles(form: str) -> frozenset[str]:
    return frozenset(form[i : i + GRAM] for i in range(len(form) - GRAM + 1))


def _chunks(forms: list[str]) -> Iterator[list[str]]:
    """The forms in runs of about CHUNK_CHARS characters."""
    own, chars = [], 0
    for form in forms:
        own.append(form)
        chars += len(form)
        if chars >= CHUNK_CHARS:
            yield own
            own, chars = [], 0
    if own:
        yield own


def _codes(forms: list[str]) -> np.ndarray:
    return np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), "<u4")


def shingle_sets(forms: list[str]) -> list[np.ndarray] | list[frozenset[str]]:
    """The set of shingles of each form, all of one kind.

    Forms of at most 256 different characters between them give sorted arrays of numbers that hold a byte for each of
    GRAM characters, so equal numbers are equal shingles; such arrays are compared only with those of the same call.
    Others give sets of strings.
    """
    known = np.zeros(256, bool)
    for some in _chunks(forms):
        x = _codes(some)
        if (top := int(x.max())) >= len(known):
            known = np.concatenate([known, np.zeros(top + 1 - len(known), bool)])
        known[x] = True
    if np.count_nonzero(known) > 256:
        return [shingles(form) for form in forms]
    place = (np.cumsum(known) - 1).astype(np.uint64)
    out = []
    for some in _chunks(forms):
        x = place[_codes(some)]
        for step in (1, 2, 4):
            x = x[:-step] << np.uint64(8 * step) | x[step:]
        at = 0
        for form in some:
            own = np.sort(x[at : at + len(form) - GRAM + 1])
            first = np.empty(len(own), bool)
            first[0] = True
            np.not_equal(own[1:], own[:-1], out=first[1:])
            out.append(own[first])
            at += len(form)
    return out


def _shared(a: np.ndarray | frozenset, b: np.ndarray | frozenset) -> int:
    if isinstance(a, frozenset):
        return len(a & b)
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def jaccard(a: np.ndarray | frozenset, b: np.ndarray | frozenset) -> float:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return min(len(a), len(b)) / max(len(a), len(b))  # no more than this, which fails
    both = _shared(a, b)
    return both / (len(a) + len(b) - both)


_LINES = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("h", pa.int64()), ("fresh", pa.bool_()), ("bands", pa.list_(pa.int64())), ("form", pa.string())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    docs, lines, hashes, forms, fresh = [], [], [], [], []
    chars = 0

    def flush():
        signed, own = iter(bands(forms).tolist()) if forms else iter(()), iter(forms)
        out = batch(_LINES, docs, lines, hashes, fresh, [next(signed) if new else None for new in fresh], [next(own) if new else None for new in fresh])
        for x in (docs, lines, hashes, forms, fresh):
            x.clear()
        return out

    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            for number, form in enumerate(normal_lines(text)):
                if form is None:
                    continue
                h = line_hash(form)
                new = len(form) >= GRAM and h not in seen  # a line without a shingle is compared by its hash alone
                if new:
                    if len(seen) >= SEEN_LINES:
                        seen.clear()
                    seen.add(h)
                    forms.append(form)
                    chars += len(form)
                docs.append(doc)
                lines.append(number)
                hashes.append(h)
                fresh.append(new)
                if chars >= CHUNK_CHARS or len(docs) >= CHUNK_LINES:
                    yield flush()
                    chars = 0
    if docs:
        yield flush()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, h sorted by both -> key, h, lead for each distinct member but the first of a bucket."""
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("lead", pa.int64())])
    key0 = h0 = lead0 = None
    for b in batches:
        key, h = b.column("key").to_numpy(), b.column("h").to_numpy()
        if not len(key):
            continue
        begins = np.concatenate([[key0 is None or key[0] != key0], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(begins, np.arange(len(key)), -1))
        lead = np.where(at >= 0, h[np.maximum(at, 0)], lead0 if lead0 is not None else 0)
        before = np.concatenate([[h0 if h0 is not None else 0], h[:-1]])
        take = ~begins & (h != before) & (h != lead)
        if take.any():
            yield batch(schema, key[take], h[take], lead[take])
        key0, h0, lead0 = key[-1], h[-1], lead[-1]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("lead", pa.int64()), ("j", pa.float64())])

    def measured(pairs: list[tuple[int, str, str]]) -> Iterator[float]:
        forms, last = [], None
        for lead, x, y in pairs:
            if lead != last:
                forms.append(y)
                last = lead
            forms.append(x)
        sets, last, own = iter(shingle_sets(forms)), None, None
        for lead, _, _ in pairs:
            if lead != last:
                last, own = lead, next(sets)
            yield jaccard(next(sets), own)

    for b in batches:
        found, pairs, chars = [], [], 0
        for pair in zip(*(b.column(c).to_pylist() for c in ("lead", "form", "lead_form")), strict=True):
            pairs.append(pair)
            chars += len(pair[1])
            if chars >= CHUNK_CHARS:
                found += measured(pairs)
                pairs, chars = [], 0
        found += measured(pairs)
        yield batch(schema, b.column("h"), b.column("lead"), found)


def _prefix(own: np.ndarray | frozenset) -> list:
    """The first shingles in an order that all sets share; sets at SIMILARITY or more have one of these in common."""
    n = len(own)
    most = n - math.ceil(SIMILARITY * n - 1e-9) + 1
    return sorted(own, key=hash)[:most] if isinstance(own, frozenset) else own[np.argsort(own * _STEP)[:most]].tolist()


def _marks(sets: list[np.ndarray] | list[frozenset]) -> np.ndarray:
    """MARKS bits for each set, those that its shingles hash to, as rows of 64-bit words."""
    out = np.empty((len(sets), MARKS // 64), np.uint64)
    for at in range(0, len(sets), 1000):
        some = sets[at : at + 1000]
        bits = np.zeros((len(some), MARKS), bool)
        for row, own in zip(bits, some, strict=True):
            row[[hash(s) % MARKS for s in own] if isinstance(own, frozenset) else (own * _STEP >> np.uint64(32)) % np.uint64(MARKS)] = True
        out[at : at + 1000] = np.packbits(bits, axis=1).view(np.uint64)
    return out


def bucket_links(members: list[tuple[int, float, str]]) -> list[tuple[int, int]]:
    """Links that unite what pairs at SIMILARITY or more unite, between failures (j under SIMILARITY) and among failures and linked members.

    Linked members are one component from the start. Sets that differ in d shingles are at SIMILARITY or more only if
    _CLOSE * d <= the sum of their sizes, and differ in as many at least as their marks do, so pairs whose marks say no are not
    compared; all others are, exactly. In buckets of more than FEW members candidates share a shingle of both prefixes
    too, so unlike lines do not even meet.
    """
    if len(members) < 2:
        return []
    root = {h: h if j < SIMILARITY else None for h, j, _ in members}  # None: the lead's component

    def find(h):
        while h is not None and root[h] != h:
            h = root[h]
        return h

    links, at = [], {}
    indexed = len(members) > FEW
    members = sorted(members, key=lambda m: (m[1] < SIMILARITY, m[0]))  # linked members first
    sets = shingle_sets([form for _, _, form in members])
    marks, sizes = _marks(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    for i, (h, j, _) in enumerate(members):
        first = _prefix(sets[i]) if indexed else ()
        if j < SIMILARITY and i:
            near = np.array(sorted({k for s in first for k in at.get(s, ())}), np.int64) if indexed else slice(i)
            apart = np.bitwise_count(marks[near] ^ marks[i]).sum(axis=1, dtype=np.int64)
            hope = np.flatnonzero(_CLOSE * apart <= (sizes[near] + sizes[i]) * (1 + 1e-9))
            for k in (near[hope] if indexed else hope).tolist():
                g, its, _ = members[k]
                if find(h) == find(g) or (its >= SIMILARITY and its > j + 1 - SIMILARITY + 1e-9):
                    continue
                if jaccard(sets[i], sets[k]) >= SIMILARITY:
                    links.append((h, g))
                    top, below = find(g), find(h)
                    if below is None:
                        top, below = below, top
                    root[below] = top
        for s in first:
            at.setdefault(s, []).append(i)
    return links


def _residue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, h, j, form sorted by key -> links of each bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    key0, held = None, []
    for b in batches:
        out = []
        for key, *row in zip(*(b.column(c).to_pylist() for c in ("key", "h", "j", "form")), strict=True):
            if key != key0:
                out += bucket_links(held)
                held.clear()
                key0 = key
            held.append(tuple(row))
        if out:
            yield batch(schema, *zip(*out, strict=True))
    if last := bucket_links(held):
        yield batch(schema, *zip(*last, strict=True))


def _forms(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, form of the wanted lines, one row each."""
    table, _ = bloom.build(wanted, "h")
    shared = lines.sparkSession.sparkContext.broadcast(table)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bloom.passes(shared.value, b.column("h").to_numpy())))

    hoped = arrow_map(lines.where("fresh").select("h", "form"), pick, "h long, form string")
    return cut_rows(hoped.join(wanted, "h", "left_semi").dropDuplicates(["h"]), "forms")


def line_components(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """lines(doc_id, line, h), their number, and found(node, root): the linked hashes with the least of their component."""
    docs = only(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    lines = cut_map(docs, _sign, "doc_id long, line int, h long, fresh boolean, bands array<long>, form string", "lines")
    n = lines.count()
    keyed = lines.where("fresh").select("h", F.explode("bands").alias("key"))
    stars = cut_map(keyed.repartition("key").sortWithinPartitions("key", "h"), _stars, "key long, h long, lead long", "stars")
    pairs = stars.select("h", "lead").distinct()
    wanted = cut_rows(stars.select(F.explode(F.array("h", "lead")).alias("h")).distinct(), "wanted", n)
    forms = _forms(lines, wanted)
    told = pairs.join(forms, "h").join(forms.select(F.col("h").alias("lead"), F.col("form").alias("lead_form")), "lead").select("h", "lead", "form", "lead_form")
    measured = cut_map(told, _measure, "h long, lead long, j double", "measured")
    links = measured.where(F.col("j") >= SIMILARITY).select(F.col("h").alias("a"), F.col("lead").alias("b"))
    more = _residual_links(stars, measured, forms)
    return lines.select("doc_id", "line", "h"), connected(links.unionByName(more), lambda df: cut_rows(df, "links", n)), n


def _residual_links(stars: DataFrame, measured: DataFrame, forms: DataFrame) -> DataFrame:
    members = cut_rows(stars.join(measured, ["h", "lead"]), "members")
    failed = F.when(F.col("j") < SIMILARITY, F.col("j"))
    # sums by bucket are tables before rows are joined with them, so that Spark can split the rows of a very full bucket
    hopes = cut_rows(members.groupBy("key").agg((F.max(failed) + 1 - SIMILARITY + 1e-9).alias("reach"), F.count("*").alias("n")).where("reach is not null and n > 1").drop("n"), "hopes")
    met = cut_rows(members.join(hopes, "key").where((F.col("j") < SIMILARITY) | (F.col("j") <= F.col("reach"))).select("key", "h", "j"), "met")
    several = cut_rows(met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several")
    told = met.join(several, "key").join(forms, "h").select("key", "h", "j", "form")
    return arrow_map(told.repartition("key").sortWithinPartitions("key"), _residue, "a long, b long")


def drops(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, dropped (array of line numbers) of the documents that lose lines; and the number of lines that took part."""
    lines, found, n = line_components(docs)
    rooted = cut_rows(lines.join(found, lines.h == found.node, "left").select("doc_id", "line", F.coalesce("root", "h").alias("root")), "rooted", n)
    place = F.struct("doc_id", "line")
    first = rooted.groupBy("root").agg(F.min(place).alias("keep"), F.max(place).alias("last")).where("keep <> last").select("root", "keep")
    gone = rooted.join(cut_rows(first, "first", n), "root").where(place != F.col("keep"))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("dropped")), n


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers from 0, comma-joined) of every document."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    gone, n = drops(docs)
    told = gather(own.join(gone, "doc_id", "left"), n)
    return told.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def _rest(text: pa.Array, dropped: pa.Array) -> pa.Array:
    """Texts without the dropped lines; null where no word is left."""
    out = []
    for t, gone in zip(text.to_pylist(), dropped.to_pylist(), strict=True):
        kept = None
        if t is not None:
            gone = set(gone)
            kept = [x for i, x in enumerate(t.split("\n")) if i not in gone]
        out.append("\n".join(kept) if kept and any(map(str.split, kept)) else None)
    return pa.array(out, pa.string())


def dedup(docs: DataFrame) -> DataFrame:
    """The documents without their dropped lines, n_chars (where there is such a column) recounted; those left without a word go."""
    rest = F.arrow_udf(_rest, "string").asNondeterministic()  # so that no filter runs it a second time
    gone, n = drops(docs)
    doc, dropped, left = (free_name(name, docs.columns) for name in ("own_doc_id", "dropped", "rest"))
    found = gone.select(F.col("doc_id").alias(doc), F.col("dropped").alias(dropped))
    met = gather(docs.join(found, docs["doc_id"] == found[doc], "left"), 4 * n)  # rows of text, each far longer than a line's
    touched = F.col(dropped).isNotNull() & F.col("text").isNotNull()
    told = met.withColumn(left, rest(F.when(touched, F.col("text")), F.col(dropped))).where(~touched | F.col(left).isNotNull())
    changed = {"text": F.when(touched, F.col(left)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(touched, F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return told.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
