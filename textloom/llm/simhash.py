"""SimHash near-duplicates, joined exactly by vantage-point trees.

Fingerprints: 64 bits, each set where over half of the XXH64 hashes of a text's four-word shingles have it. Two
fingerprints link at 4 or fewer differing bits; a component's id is the least doc_id in it.

Two fingerprints within 4 bits differ in at most 1 bit in two of their four 16-bit quarters or more (three quarters of
2 bits would make 6). For each quarter a vantage-point tree is grown on a bounded sample of its values: a node holds a
vantage value and a radius, values within the radius go inside, the others outside. A pair that a node parts has its
outer member within radius + 1 of the vantage value (triangle inequality), so only such outer members are also sent
inside, as visitors, and go on to every side that could hold a value within 1 of theirs. A shard is a leaf of one
quarter's tree and, on the second level, a leaf of another's; for some of the six pairs of quarters, the two
fingerprints of a linked pair meet in one shard, of which one of them owns the first leaf. There distances over all 64
bits are exact. Both levels are deep enough together for SHARD_ROWS fingerprints a shard, up to 2^32 shards, whatever
the corpus. A shard reports for each of its fingerprints one link at most, not pairs: it unites fingerprints and
compares only those not yet in one component.

Copies share a fingerprint and count once from the start. Links between distinct fingerprints are united by rounds of
large-star and small-star joins over tables in the shared folder; nothing of the corpus reaches the driver but the
sample and row counts.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer than four words make one
shingle; repeated rows share a component, a null doc_id is carried along but names no component unless all ids of the
component are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, batch, cut, cut_map, free_name, gather, only, texts
from textloom.llm.components import connected

SHINGLE = 4
SEED = 42
BITS = 4  # differing bits at which fingerprints still link
QUARTERS, QUARTER_BITS = 4, 16
QUARTER_REACH = BITS // QUARTERS
SAMPLE_ROWS = 20_000  # distinct fingerprints on which the trees are grown
SHARD_ROWS = 1_000  # fingerprints owned by a shard, about
TASK_ROWS = 200_000  # distinct fingerprints for each task that links shards
PIVOTS = 32
BLOCK = 1 << 18  # distances computed at once: 2 MB
PAIRS = [(q, t) for q in range(QUARTERS) for t in range(q + 1, QUARTERS)]

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes) -> int:
    words = text.translate(_LOWER).split()  # parts at 20 and 09-0D alone
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    for b in batches:
        fp = np.array([fingerprint(t) for t in texts(b.column("text"))], np.uint64)
        yield batch(schema, b.column("doc_id"), fp.view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every document, as a table in the shared folder."""
    return cut_map(only(docs, "doc_id", "text"), _mark, "doc_id long, fp long", "fingerprints")


class Tree:
    """A vantage-point tree over 16-bit values; leaves are numbered from 0. Its depth ends where its sample's values do."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.children: list[list[int]] = []  # node numbers, or -1 - leaf
        self.leaves = 0
        self.root = self._grow(sample, depth)

    def _grow(self, sample: np.ndarray, depth: int) -> int:
        if depth == 0 or len(np.unique(sample)) < 2:
            self.leaves += 1
            return -self.leaves
        vantage, distance = self._choose(sample)
        radius = int(np.sort(distance)[(len(distance) - 1) // 2])
        if radius >= distance.max():
            radius = int(distance.max()) - 1
        node = len(self.vantage)
        self.vantage.append(vantage)
        self.radius.append(radius)
        self.children.append([0, 0])
        inside = distance <= radius
        self.children[node] = [self._grow(sample[inside], depth - 1), self._grow(sample[~inside], depth - 1)]
        return node

    @staticmethod
    def _choose(sample: np.ndarray) -> tuple[int, np.ndarray]:
        """Of a few values of the sample, that with the widest spread of distances."""
        tried = sample[np.linspace(0, len(sample) - 1, min(8, len(sample))).astype(int)]
        distances = [np.bitwise_count(sample ^ v).astype(np.int64) for v in tried]
        best = int(np.argmax([d.var() for d in distances]))
        return int(tried[best]), distances[best]

    def route(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, owned) of every place where a value is owned or visits."""
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        todo = [(self.root, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            node, rows, owned = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, -1 - node, owned))
                continue
            distance = np.bitwise_count(values[rows] ^ np.uint16(self.vantage[node])).astype(np.int64)
            radius = self.radius[node]
            # an owner outside visits the inside where it may meet an owner there; a visitor goes wherever it may
            goes_in = distance <= radius + reach
            goes_out = (distance > radius) | (~owned & (distance > radius - reach))
            todo.append((self.children[node][0], rows[goes_in], owned[goes_in] & (distance[goes_in] <= radius)))
            todo.append((self.children[node][1], rows[goes_out], owned[goes_out]))
        rows = np.concatenate([r for r, _, _ in out]) if out else np.empty(0, np.int64)
        leaf = np.concatenate([np.full(len(r), n, np.int64) for r, n, _ in out]) if out else rows
        return rows, leaf, np.concatenate([o for _, _, o in out]) if out else np.empty(0, bool)


def quarters(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp.view(np.uint64) >> np.uint64(q * QUARTER_BITS)).astype(np.uint16) for q in range(QUARTERS)]


def grow(sample: np.ndarray, n: int) -> list[Tree]:
    """A tree for each quarter, two of them together deep enough for n distinct fingerprints."""
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / SHARD_ROWS) / 2)))
    return [Tree(values, depth) for values in quarters(sample)]


def places(fp: np.ndarray, trees: list[Tree]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, shard, owned) of every shard where a fingerprint is, for each pair of quarters; owned tells of the first quarter's leaf.

    Trees of one leaf part nothing, and one pair is then enough.
    """
    met = []
    for tree, values in zip(trees, quarters(fp), strict=True):
        rows, leaf, owned = tree.route(values, QUARTER_REACH)
        order = np.argsort(rows, kind="stable")
        met.append((rows[order], leaf[order], owned[order], np.bincount(rows, minlength=len(fp))))
    for k, (q, t) in enumerate(PAIRS if max(tree.leaves for tree in trees) > 1 else PAIRS[:1]):
        rows, leaf, owned, _ = met[q]
        _, second, _, visits = met[t]
        times = visits[rows]
        begin = (np.cumsum(visits) - visits)[rows]
        at = np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        shard = (np.repeat(leaf, times) * trees[t].leaves + second[at]) * len(PAIRS) + k
        yield np.repeat(rows, times), shard, np.repeat(owned, times)


def _route(shared):
    schema = pa.schema([("shard", pa.int64()), ("fp", pa.int64()), ("owned", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            for rows, shard, owned in places(fp, shared.value):
                for i in range(0, len(rows), 1 << 16):
                    at = slice(i, i + (1 << 16))
                    yield batch(schema, shard[at], fp[rows[at]], owned[at])

    return run


class _Union:
    """Union-find over places 0..n-1 whose root is the least place of a component."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def unite(self, i: int, others: np.ndarray) -> None:
        roots = {self.find(int(j)) for j in others} | {self.find(i)}
        least = min(roots)
        for r in roots:
            self.parent[r] = least


def shard_links(fp: np.ndarray, owned: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that unite exactly what linked pairs with at least one owned member unite.

    First some pivots are compared with all, which unites large groups; then each owned fingerprint outside the largest
    component is compared with all, and each visitor outside it with the owned members of the largest component that
    are as far from one of its places as the visitor is, give or take `bits` (triangle inequality). Pairs inside the
    largest component need no comparison, so a shard that one group of near copies fills costs a few passes over it.
    """
    n = len(fp)
    if not n:
        return fp, fp
    u = _Union(n)
    bare = fp.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers

    def meet(i: int, near: np.ndarray) -> None:
        near = np.flatnonzero(near if owned[i] else near & owned)
        if len(near):
            u.unite(i, near)

    done = np.zeros(n, bool)
    for k in range(min(PIVOTS, n)):
        i = k * n // min(PIVOTS, n)
        meet(i, np.bitwise_count(bare ^ bare[i]) <= bits)
        done[i] = True
    root = u.roots()
    values, counts = np.unique(root, return_counts=True)
    lead = int(values[counts.argmax()])
    members = np.flatnonzero(owned & ~done & (root == lead))
    todo = np.flatnonzero(owned & ~done & (root != lead))
    size = max(1, BLOCK // n)
    for at in range(0, len(todo), size):
        rows = todo[at : at + size]
        near = np.bitwise_count(bare[rows, None] ^ bare) <= bits
        for k in np.flatnonzero(np.count_nonzero(near, axis=1) > 1):
            i = int(rows[k])
            if (root[near[k]] != root[i]).any():
                meet(i, near[k])
                root = u.roots()
    if len(members):
        far = np.bitwise_count(bare ^ bare[lead]).astype(np.int64)
        visitors = np.flatnonzero(~owned & ~done & (u.roots() != u.find(lead)))
        for distance in np.unique(far[visitors]):
            rows, others = visitors[far[visitors] == distance], members[np.abs(far[members] - distance) <= bits]
            size = max(1, BLOCK // max(len(others), 1))
            for at in range(0, len(rows), size):
                near = (np.bitwise_count(bare[rows[at : at + size], None] ^ bare[others]) <= bits).any(axis=1)
                u.unite(lead, rows[at : at + size][near])
    root = u.roots()
    linked = np.flatnonzero(root != np.arange(n))
    return fp[linked], fp[root[linked]]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; one shard's fingerprints are held at a time, 9 bytes each."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    current = None

    def flush():
        fp, owned = (np.concatenate(x) for x in zip(*held, strict=True))
        a, b = shard_links(fp, owned)
        for i in range(0, len(a), 1 << 16):
            yield batch(schema, a[i : i + (1 << 16)], b[i : i + (1 << 16)])

    for rows in batches:
        shard, fp, owned = rows.column("shard").to_numpy(), rows.column("fp").to_numpy(), rows.column("owned").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for i, j in zip(edges, edges[1:], strict=False):
            if i == j:
                continue
            if current is not None and shard[i] != current:
                yield from flush()
                held.clear()
            current = shard[i]
            held.append((fp[i:j].copy(), owned[i:j].copy()))
    if held:
        yield from flush()


def links(distinct: DataFrame, n: int) -> DataFrame:
    """distinct(fp), n rows -> a, b: links that unite every pair of fingerprints within 4 bits."""
    spark = distinct.sparkSession
    sample = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE_ROWS).toArrow()["fp"].to_numpy()  # the same rows on every run
    shared = spark.sparkContext.broadcast(grow(sample, n))
    routed = arrow_map(distinct, _route(shared), "shard long, fp long, owned boolean")
    dealt = routed.repartition(max(8, -(-n // TASK_ROWS) * 8), "shard")  # stated, so that tasks stay alike as rows grow
    return cut_map(dealt.sortWithinPartitions("shard"), _link, "a long, b long", "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    marked = fingerprints(docs)
    rows = marked.count()
    groups = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", rows)
    n = groups.count()
    found = connected(links(groups.select("fp"), n), n)  # node, root: linked fingerprints alone
    rooted = groups.join(found, groups.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return gather(marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), rows)


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of the least doc_id of each component, with all its columns; of rows that repeat it, one.

    A document without a doc_id counts after all that have one, by a hash of its text.
    """
    stand_in = F.lit(1 << 62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    near = free_name("near_id", docs.columns)
    keyed = docs.withColumn(near, F.coalesce(F.col("doc_id"), stand_in))
    found = near_duplicates(keyed.select(F.col(near).alias("doc_id"), "text"))
    least = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(near)).distinct()
    return keyed.join(least, near, "left_semi").dropDuplicates([near]).select(*[F.col(f"`{c}`") for c in docs.columns])
